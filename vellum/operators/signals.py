"""What needs a look: near-duplicates, orphans, missing, thin and broken links, and one ranked queue of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import BARS
from vellum.functions.text import parent
from vellum.operators.index import NoteIndex
from vellum.operators.pairs import block_pairs, jaccard, ranked, related_all, stem_sets
from vellum.operators.ranks import rank_within
from vellum.storage import kept, sized

#: The kinds of the queue in order, with singular and plural.
KINDS = {
    "duplicates": ("near-duplicate", "near-duplicates"),
    "orphans": ("orphan to adopt", "orphans to adopt"),
    "missing": ("unlinked neighbour", "unlinked neighbours"),
    "dangling": ("broken link", "broken links"),
}


def in_degree(links: DataFrame) -> DataFrame:
    """(path, deg): links to each note, repeats counted."""
    return links.groupBy(F.col("dst").alias("path")).agg(F.sum("n").alias("deg"))


def linked(links: DataFrame) -> DataFrame:
    """(path): notes that something points at."""
    return in_degree(links).filter("deg > 0").select("path")


def written(links: DataFrame) -> DataFrame:
    """(a, b), a <= b: pairs with a link either way."""
    return links.filter("n > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def nearest(index: NoteIndex, path: str, tau: float, near: DataFrame | None) -> DataFrame:
    """related_all(), or what of `near`, its rows for a lower bar, reaches this one."""
    return related_all(index, path, tau) if near is None else near.filter(F.col("score") >= tau)


def near_duplicates(index: NoteIndex, path: str, limit: int | None = 10, near: DataFrame | None = None) -> DataFrame:
    near = nearest(index, path, BARS.orphan, near).filter(F.col("overlap") >= BARS.duplicate)
    return ranked(near.select("path", F.col("overlap").alias("score")), limit)


def adoptable_orphans(index: NoteIndex, links: DataFrame, path: str, limit: int | None = 10, near: DataFrame | None = None) -> DataFrame:
    near = nearest(index, path, BARS.orphan, near).filter(F.col("overlap") >= BARS.propose)
    return ranked(near.join(linked(links), "path", "left_anti").select("path", "score"), limit)


def unlinked_neighbours(index: NoteIndex, links: DataFrame, path: str, limit: int | None = 10, near: DataFrame | None = None) -> DataFrame:
    """Near notes without a link either way. From an excluded note the bar is that of the list."""
    me = index.notes.filter(F.col("path") == path).select("excluded").first()
    loose = bool(me and me["excluded"])
    near = nearest(index, path, BARS.listed if loose else BARS.edge, near)
    near = near if loose else near.filter(F.col("overlap") >= BARS.propose)
    mine = written(links).filter((F.col("a") == path) | (F.col("b") == path)).select(F.when(F.col("a") == path, F.col("b")).otherwise(F.col("a")).alias("path"))
    return ranked(near.join(mine, "path", "left_anti").select("path", "score"), limit)


def stale_links(index: NoteIndex, links: DataFrame) -> DataFrame:
    """(src, dst, score): links between notes that share almost no telling stem; not those of excluded or index notes."""
    few = links.groupBy("src").agg(F.count("*").alias("out")).filter(F.col("out") <= BARS.index_out_degree).select("src")
    judged = index.notes.filter("not excluded").select(F.col("path").alias("src"))
    met = kept(links.select("src", "dst").join(few, "src", "left_semi").join(judged, "src", "left_semi"), "judged")
    ends = kept(met.select(F.explode(F.array("src", "dst")).alias("path")).distinct(), "ends")
    sets = kept(stem_sets(index, ends), "stem-sets")  # of the links' notes only
    x, y = sets.select(F.col("path").alias("src"), F.col("stems").alias("x")), sets.select(F.col("path").alias("dst"), F.col("stems").alias("y"))
    met = met.join(sized(x), "src").join(sized(y), "dst")
    return met.select("src", "dst", jaccard(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")).alias("score")).filter(F.col("score") < BARS.stale)


def dangling_links(dangling: DataFrame, path: str) -> DataFrame:
    return dangling.filter((F.col("src") == path) & (F.col("n") > 0)).select("target").distinct().orderBy("target")


def panel(index: NoteIndex, links: DataFrame, dangling: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """(kind, other, score, unlinked): every signal of one note. A note is listed once, as a duplicate, else an orphan, else related."""
    near = kept(related_all(index, path, min(BARS.orphan, BARS.listed)), "near")
    rows = [
        near_duplicates(index, path, near=near).select(F.lit("duplicates").alias("kind"), F.lit(1).alias("turn"), "path", "score"),
        adoptable_orphans(index, links, path, near=near).select(F.lit("orphans").alias("kind"), F.lit(2).alias("turn"), "path", "score"),
        ranked(nearest(index, path, BARS.listed, near).select("path", "score"), limit).select(F.lit("related").alias("kind"), F.lit(3).alias("turn"), "path", "score"),
    ]
    claimed = rows[0].unionByName(rows[1]).unionByName(rows[2])
    first = F.row_number().over(Window.partitionBy("path").orderBy("turn"))  # at most three rows for a note
    free = unlinked_neighbours(index, links, path, None, near).select("path", F.lit(True).alias("free"))
    listed = claimed.withColumn("claim", first).filter("claim = 1").join(free, "path", "left")
    listed = listed.select("kind", F.col("path").alias("other"), "score", (F.col("kind") == "related").alias("_r"), "free").select("kind", "other", "score", (F.col("_r") & F.coalesce("free", F.lit(False))).alias("unlinked"))
    thin = stale_links(index, links.filter(F.col("src") == path)).select(F.lit("stale").alias("kind"), F.col("dst").alias("other"), "score", F.lit(False).alias("unlinked"))
    broken = dangling_links(dangling, path).select(F.lit("dangling").alias("kind"), F.col("target").alias("other"), F.lit(0.0).alias("score"), F.lit(False).alias("unlinked"))
    return listed.unionByName(thin).unionByName(broken)


def presented(panel_rows: DataFrame, notes: DataFrame, path: str, same_folder: bool = False) -> DataFrame:
    """panel() rows as a list shows them: title, whether another note has it, percent of the section's strongest, two decimals.

    With same_folder only notes in the folder of `path` stay; targets of broken links always do.
    """
    here = notes.select(F.col("path").alias("other"), F.col("basename").alias("name"), parent(F.col("path")).alias("folder"))
    twice = here.groupBy("name").agg(F.count("*").alias("same")).filter("same > 1")
    rows = panel_rows.join(here, "other", "left").join(twice, "name", "left")
    if same_folder:
        rows = rows.filter((F.col("kind") == "dangling") | (F.col("folder") == parent(F.lit(path))))
    most = F.max("score").over(Window.partitionBy("kind"))  # the rows of one note
    percent = F.round(100 * F.col("score") / F.when(most > 0, most).otherwise(1.0)).cast("int")
    return rows.select("kind", "other", F.coalesce("name", "other").alias("title"), F.coalesce(F.col("same") > 1, F.lit(False)).alias("ambiguous"), percent.alias("percent"), F.format_string("%.2f", "score").alias("shown"), "unlinked")


def stale_order(stale: DataFrame, path: str) -> DataFrame:
    """The thin links of one note, the thinnest first."""
    return stale.filter(F.col("src") == path).orderBy("score", "dst")


def next_row(queue: DataFrame, cursor: int, current: str | None) -> DataFrame:
    """The queue's row at the cursor, the open note skipped; no row once the queue is exhausted. The queue is limited."""
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "path"))
    left = queue if current is None else queue.filter(F.col("path") != current)
    return left.withColumn("at", place - 1).filter(F.col("at") == cursor).drop("at")


def queue_signals(index: NoteIndex, links: DataFrame, dangling: DataFrame) -> DataFrame:
    """(path, kind, n, score): how often each note has each signal, and its strongest."""
    pairs = block_pairs(index, BARS.orphan, BARS.propose, written(links))  # no signal is below that overlap
    has = sized(kept(linked(links).withColumn("has", F.lit(True)), "pointed-at"))
    pairs = pairs.join(has.select(F.col("path").alias("a"), F.col("has").alias("has_a")), "a", "left").join(has.select(F.col("path").alias("b"), F.col("has").alias("has_b")), "b", "left")
    say = lambda kind, path, score, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kind).alias("kind"), F.col(path).alias("path"), F.col(score).alias("score")))
    twin = F.array(say("duplicates", "a", "overlap"), say("duplicates", "b", "overlap"))
    near = F.col("score") >= BARS.edge
    other = F.array(say("missing", "a", "score", near), say("missing", "b", "score", near), say("orphans", "a", "score", F.col("has_b").isNull()), say("orphans", "b", "score", F.col("has_a").isNull()))
    offers = F.when(F.col("overlap") >= BARS.duplicate, twin).when(~F.col("known") & (F.col("overlap") >= BARS.propose), F.filter(other, lambda s: s.isNotNull()))
    told = pairs.select(F.explode(offers).alias("s")).select("s.*").groupBy("path", "kind").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    broken = dangling.filter("n > 0").select(F.col("src").alias("path"), "target").distinct().groupBy("path").agg(F.count("*").alias("n"))
    broken = broken.join(index.notes.filter("not excluded").select("path"), "path", "left_semi").select("path", F.lit("dangling").alias("kind"), "n", F.col("n").cast("double").alias("score"))
    return told.unionByName(broken)


def attention_queue(index: NoteIndex, links: DataFrame, dangling: DataFrame, limit: int = 100) -> DataFrame:
    """(path, score, reason): notes by how much they need a look, the four signals fused by rank."""
    told = queue_signals(index, links, dangling)
    placed = rank_within(told, "rn", ["kind"], [F.col("score").desc(), F.col("path")])
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    rows = placed.groupBy("path").agg(F.sum(1.0 / (BARS.rrf + F.col("rn"))).alias("score"), *[count(k).alias(k) for k in KINDS])
    words = [F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(" "), F.when(F.col(k) == 1, one).otherwise(many))) for k, (one, many) in KINDS.items()]
    return rows.orderBy(F.col("score").desc(), "path").limit(limit).select("path", "score", F.concat_ws(", ", *words).alias("reason"))
