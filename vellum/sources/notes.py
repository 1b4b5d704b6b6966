"""Notes and links: readers, the driver tables as a vault, and bulk edits that return the changed notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import markdown
from vellum.functions.text import basename, normal, parent
from vellum.storage import kept, sized, spread

NOTES = "path string, basename string, mtime long, content string"


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """The markdown files below a folder, one row each; paths are relative to it."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    path = F.substring(full, F.lit(len(root.rstrip("/")) + 2), F.length(full))
    mtime = F.unix_millis("_metadata.file_modification_time")
    return files.select(path.alias("path"), basename(path).alias("basename"), mtime.alias("mtime"), F.coalesce("value", F.lit("")).alias("content"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"))


def path_of(number: Column, source: Column) -> Column:
    return F.concat(source, F.lit("/doc-"), F.lpad(number.cast("string"), 6, "0"), F.lit(".md"))


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, basename, mtime, content, title): documents as notes; the title is the first two tokens."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    path = path_of(F.col("doc_id"), F.col("source"))
    first = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), 1, 2)
    return docs.select(path.alias("path"), basename(path).alias("basename"), F.col("doc_id").alias("mtime"), F.coalesce("text", F.lit("")).alias("content"), F.array_join(first, " ").alias("title"))


def line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): written links between documents, one for each order line.

    The order's number gives the source. Targets have even numbers, so odd ones are orphans: of every tenth
    source they follow the part's number, which makes an index note; of the others there are three.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", path_of(F.col("doc_id"), F.col("source")).alias("path"))
    n = docs.count()
    source, part = F.col("l_orderkey") % n, F.col("l_partkey")
    ends = lines.select(source.alias("s"), (2 * F.when(source % 10 == 0, part).otherwise(7 * source + part % 3) % n).alias("d")).groupBy("s", "d").agg(F.count("*").alias("n"))
    src, dst = docs.select(F.col("doc_id").alias("s"), F.col("path").alias("src")), docs.select(F.col("doc_id").alias("d"), F.col("path").alias("dst"))
    return ends.join(src, "s").join(dst, "d").select("src", "dst", "n")


def page_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, target, n): link text of pages that resolves to no note."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", path_of(F.col("doc_id"), F.col("source")).alias("src"))
    n = docs.count()
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    out = pages.select((F.col("page_id") % n).alias("doc_id"), F.explode(hrefs).alias("target")).groupBy("doc_id", "target").agg(F.count("*").alias("n"))
    return out.join(docs, "doc_id").select("src", "target", "n")


def links_of_maps(tables: DataFrame) -> DataFrame:
    """(src, dst, n) of a nested map column resolved: map<string, map<string, long>>."""
    return tables.select(F.explode("resolved").alias("src", "to")).select("src", F.explode("to").alias("dst", "n"))


def list_files(notes: DataFrame, folder: str = "", files: DataFrame | None = None) -> DataFrame:
    """(name, path) of the notes below a folder, every note for an empty one; with files (path, ...) of all of these, other kinds with their extension."""
    rows = notes if files is None else files
    where = F.lit(True) if not folder else F.col("path").startswith(folder.rstrip("/") + "/")
    return rows.filter(where).select(basename(F.col("path")).alias("name"), "path")


def read_note(notes: DataFrame, path: str) -> DataFrame:
    """(path, content, size) of one note; raises if there is none."""
    found = notes.filter(F.col("path") == normal(F.lit(path)))
    if not found.limit(1).count():
        raise FileNotFoundError(path)
    return found.select("path", "content", F.length("content").cast("long").alias("size"))


def properties(notes: DataFrame) -> DataFrame:
    """(path, frontmatter variant): the front matter of each body with the types of its values, an empty object where there is none."""
    rows = markdown.each(notes.select("path", "content"), markdown.front_matter, "string", "json", "content")
    return rows.select("path", F.parse_json("json").alias("frontmatter"))


def outline(notes: DataFrame) -> DataFrame:
    """(path, line, position, level, heading): headings outside front matter and code, lines from 1, positions from 0."""
    may = notes.filter(F.col("content").rlike(r"(?m)^#{1,6}[ \t]"))
    hit = markdown.spans(may).filter("kind = 'heading'")
    return hit.select("path", "line", F.col("lo").alias("position"), "level", F.col("shown").alias("heading"))


def create(notes: DataFrame, new: DataFrame) -> DataFrame:
    """notes with the new (path, content) rows; raises where a path is taken."""
    new = new.withColumn("path", normal(F.col("path")))
    taken = new.join(notes.select("path"), "path", "left_semi").limit(1).collect()
    if taken:
        raise FileExistsError(taken[0]["path"])
    rows = new.select("path", basename(F.col("path")).alias("basename"), F.lit(0).cast("long").alias("mtime"), "content")
    return notes.select("path", "basename", "mtime", "content").unionByName(rows)


def overwrite(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """notes with the content of the edits (path, content), one for a path, in place of their own."""
    e = edits.select(normal(F.col("path")).alias("_p"), F.col("content").alias("_c"))
    return notes.join(e, notes["path"] == e["_p"], "left").withColumn("content", F.coalesce("_c", "content")).drop("_p", "_c")


def append(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """notes with the content of the edits (path, content) put behind their own."""
    e = edits.select(normal(F.col("path")).alias("_p"), F.col("content").alias("_c"))
    return notes.join(e, notes["path"] == e["_p"], "left").withColumn("content", F.concat("content", F.coalesce("_c", F.lit("")))).drop("_p", "_c")


def set_property(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """notes with properties of their front matter set by the edits (path, name, value), value a variant or JSON.

    A value keeps its type. The other lines of a note stay as they are; a note without front matter gets it.
    Several properties of one note are set in the order of their names.
    """
    value = F.to_json("value") if edits.schema["value"].dataType.simpleString() == "variant" else F.col("value")
    rows = edits.select(normal(F.col("path")).alias("_p"), F.struct("name", F.coalesce(value, F.lit("null")).alias("value")).alias("e"))
    rows = rows.groupBy("_p").agg(F.array_sort(F.collect_list("e")).alias("_edits"))
    joined = notes.join(rows, notes["path"] == rows["_p"], "left").drop("_p")

    def new(content: str | None, todo) -> str | None:
        for e in todo if todo is not None else ():
            content = markdown.with_property(content, e["name"], e["value"])
        return content

    return markdown.each(joined, new, "string", "content", "content", "_edits").select(notes.columns)


def links_in(notes: DataFrame) -> DataFrame:
    """(src, lo, hi, kind, form, target, target_lo, target_hi, sub, shown) of every link and embed of the bodies, but for those to addresses with a scheme."""
    may = notes.filter(F.col("content").contains("[[") | F.col("content").contains("]("))
    found = markdown.spans(may).filter("kind in ('link', 'embed') and target <> ''").drop("line", "level")
    return found.filter(~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")).withColumnRenamed("path", "src")


def places(notes: DataFrame) -> DataFrame:
    """(place, dst): for every ending of a path, in lower case and without .md, the note that it names: the one with fewest folders, then the first."""
    low = F.split(F.lower(F.regexp_replace("path", r"\.md$", "")), "/")
    rows = notes.select("path", low.alias("p")).select("path", F.size("p").alias("depth"), F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("place"))
    return rows.groupBy("place").agg(F.min(F.struct("depth", "path")).alias("m")).select("place", F.col("m.path").alias("dst"), F.col("m.depth").alias("depth"))


def resolved(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links with `way` (bare, path or relative) and dst, the path of the note that the target names; null where there is none.

    A bare name means the note of that name in the folder of the link, else the one with fewest folders; a
    path means a note whose path ends with it; a path that starts with ./, ../ or / means that very note.
    """
    clean = F.when(F.col("form") == "address", F.coalesce(F.try_url_decode(F.replace("target", F.lit("+"), F.lit("%2B"))), "target")).otherwise(F.col("target"))
    bare = F.lower(F.regexp_replace(clean, r"\.md$", ""))
    rows = links.withColumn("_t", bare).withColumn("_folder", F.lower(parent(F.col("src"))))
    way = F.when(F.col("_t").rlike(r"^(\.\.?)?/"), "relative").when(F.col("_t").contains("/"), "path").otherwise("bare")
    steps = F.concat(F.when(F.col("_t").startswith("/"), F.array()).otherwise(F.split("_folder", "/")), F.split("_t", "/")).cast("array<string>")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda at, s: F.when(s.isin("", "."), at).when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))))
    rows = rows.withColumn("way", way)
    key = F.when(F.col("way") == "relative", F.array_join(walked, "/")).otherwise(F.col("_t"))
    here = F.when(F.col("way") == "bare", F.when(F.col("_folder") == "", F.col("_t")).otherwise(F.concat("_folder", F.lit("/"), "_t")))
    known = kept(places(notes), "places")
    whole = F.size(F.split("place", "/")) == F.col("depth")
    exact = sized(kept(known.filter(whole).select(F.col("place").alias("_here"), F.col("dst").alias("_near")), "whole-places"))
    ends = sized(known.select(F.col("place").alias("_key"), F.col("dst").alias("_far"), whole.alias("_whole")))
    rows = rows.withColumns({"_key": key, "_here": here}).join(exact, "_here", "left").join(ends, "_key", "left")
    far = F.when((F.col("way") != "relative") | F.col("_whole"), F.col("_far"))
    return rows.withColumn("dst", F.coalesce("_near", far)).select(*links.columns, "way", "dst")


def link_tables(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, n) of the links of the bodies that name a note, and (src, target, n) of those that do not."""
    found = kept(resolved(links_in(notes), notes).select("src", "target", "dst"), "resolved")
    return found.filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n")), found.filter("dst is null").groupBy("src", "target").agg(F.count("*").alias("n"))


def relinked(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """notes, at their old paths, with the links of their bodies written for the paths after the moves (path, to).

    Links to a moved note, and relative links of a moved note, get a new target; part, shown text and form
    stay, and so does what is in code, math or front matter. A bare name stays bare where the new name is
    that of one note only; any other target becomes the new path from the top.
    """
    m = kept(moves.select(normal(F.col("path")).alias("path"), normal(F.col("to")).alias("to")), "moves")
    links = resolved(links_in(notes), notes).filter("dst is not null")
    met = links.join(sized(m.select(F.col("path").alias("dst"), F.col("to").alias("_to"))), "dst", "left").join(sized(m.select(F.col("path").alias("src"), F.lit(True).alias("_moved"))), "src", "left")
    met = met.filter("_to is not null or (_moved and way = 'relative')").withColumn("_to", F.coalesce("_to", "dst"))
    after = notes.select("path").join(m, "path", "left").select(F.lower(basename(F.coalesce("to", "path"))).alias("_name"))
    once = after.groupBy("_name").agg(F.count("*").alias("_same"))
    met = met.withColumn("_name", F.lower(basename(F.col("_to")))).join(once, "_name", "left")
    name = F.when((F.col("way") == "bare") & (F.col("_same") == 1), basename(F.col("_to"))).otherwise(F.concat(F.when(F.col("target").startswith("/"), "/").otherwise(""), F.regexp_replace("_to", r"\.md$", "")))
    name = F.concat(name, F.when(F.lower("target").endswith(".md"), ".md").otherwise(""))
    name = F.when((F.col("form") == "address") & ~F.col("target").contains(" "), F.replace(name, F.lit(" "), F.lit("%20"))).otherwise(name)
    edits = met.withColumn("new", name).filter("new <> target").select("src", F.struct(F.col("target_lo").alias("lo"), F.col("target_hi").alias("hi"), "new").alias("e"))
    edits = edits.groupBy(F.col("src").alias("_p")).agg(F.collect_list("e").alias("_edits"))  # the links of one note
    joined = notes.join(edits, notes["path"] == edits["_p"], "left").drop("_p")
    changed = markdown.each(joined.filter("_edits is not null"), markdown.edited, "string", "content", "content", "_edits")
    return joined.filter("_edits is null").select(notes.columns).unionByName(changed.select(notes.columns))


def move(notes: DataFrame, links: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, links) after the moves (path, to), one for a path: the links of bodies and of the table (src, dst, n) follow."""
    m = moves.select(normal(F.col("path")).alias("_p"), normal(F.col("to")).alias("_to"))
    rows = relinked(notes, moves)
    moved = rows.join(m, rows["path"] == m["_p"], "left").withColumn("path", F.coalesce("_to", "path")).drop("_p", "_to").withColumn("basename", basename(F.col("path")))
    for end in ("src", "dst"):
        links = links.join(m, links[end] == m["_p"], "left").withColumn(end, F.coalesce("_to", end)).drop("_p", "_to")
    return moved.select(notes.columns), links


def delete(notes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, trash) after the deletion of the paths."""
    g = gone.select(normal(F.col("path")).alias("path")).distinct()
    return notes.join(g, "path", "left_anti"), notes.join(g, "path", "left_semi")


def listed_strings(value: Column) -> Column:
    """A variant as an array of strings: the strings of an array, none for anything else."""
    parts = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(F.filter(F.transform(parts, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))), lambda t: t.isNotNull()), F.array().cast("array<string>"))


def folders_of(setting: str) -> list[str]:
    """The folders of a comma-separated setting, trimmed, empty ones left out."""
    return [part.strip() for part in setting.split(",") if part.strip()]


#: Requests by name: a function of the notes and the request's parameters.
REQUESTS = {
    "read": read_note,
    "list_files": list_files,
    "outline": lambda notes, path: outline(notes.filter(F.col("path") == normal(F.lit(path)))),
    "props_of": lambda notes, path: properties(notes.filter(F.col("path") == normal(F.lit(path)))),
    "search_context": lambda notes, query: _mentions().grep(notes, [query]),
    "search_context_batch": lambda notes, queries: _mentions().grep(notes, queries),
    "resolved_links": lambda notes: _both(*link_tables(notes)),
    "mention_index": lambda notes, titles: _mentions().mention_index(notes, titles),
    "autolink_note": lambda notes, path, candidates=None: _mentions().autolink_note(notes, path, candidates),
    "create": create,
    "overwrite": overwrite,
    "append": append,
    "set_prop": set_property,
    "move": lambda notes, moves: move(notes, notes.sparkSession.createDataFrame([], "src string, dst string, n long"), moves)[0],
    "delete": lambda notes, gone: delete(notes, gone)[0],
}


def _both(found: DataFrame, lost: DataFrame) -> DataFrame:
    """(src, target, n, found) of both link tables."""
    return found.select("src", F.col("dst").alias("target"), "n", F.lit(True).alias("found")).unionByName(lost.select("src", "target", "n", F.lit(False).alias("found")))


def _mentions():
    from vellum.operators import mentions

    return mentions


def request(notes: DataFrame, method: str, **parameters) -> DataFrame:
    """The answer to a request of the fixed list; writes give the notes after it."""
    if method not in REQUESTS:
        raise ValueError(f"unknown method: {method}")
    return REQUESTS[method](notes, **parameters)
