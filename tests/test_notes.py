"""Text rules, index, pairs, search and signals on small hand-written notes."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import graph, index, mentions, pairs, search, signals
from vellum.sources import notes as vault

NOTE = "path string, basename string, mtime long, content string, title string"


def frame(spark, rows):
    """rows: {path: content}"""
    return spark.createDataFrame([(p, p.split("/")[-1].removesuffix(".md"), i, c, p.split("/")[-1].removesuffix(".md")) for i, (p, c) in enumerate(rows.items())], NOTE)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,want", [("links", "link"), ("linking", "link"), ("linked", "link"), ("queries", "query"), ("process", "process"), ("status", "status"), ("goes", "goes"), ("its", "its"), ("speed", "speed")])
def test_english_stems(spark, word, want):
    assert one(spark, text.stem(F.lit(word), "en")) == want


def test_italian_stems(spark):
    s = lambda w: one(spark, text.stem(F.lit(w), "it"))
    assert s("casa") == s("case") and s("relazione") == s("relazioni")


def test_cleaning(spark):
    body = "---\ntags: secretone\n---\nkeep `codeword` $mathword$ $$big\nmathword$$ http://x.y/z [[Wiki Link|alias]] ![[embed]]\n```py\nfenced\n```\nmore\n~~~\nopen fence"
    got = one(spark, text.clean(F.lit(body)))
    assert got.split() == ["keep", "Wiki", "Link", "alias", "more"]
    assert one(spark, text.clean(F.lit(None).cast("string"))) == ""


def test_a_long_text_is_cleaned_whole(spark):
    long = "word " * 60_000 + "`code` $x$ " * 1000 + "\n```\n" + "fenced\n" * 1000 + "```\nlast"
    assert len(long) > 300_000
    got = one(spark, text.clean(F.lit(long)))
    assert got.split() == ["word"] * 60_000 + ["last"]
    assert one(spark, text.clean(F.lit(long), 4)) == "word"


def test_folders():
    assert text.prefixes([" /Journal/ ", "", "/", "A/b"]) == ["journal/", "a/b/"]


TOPICS = {
    "geo/a.md": "tectonic plates drift mantle crust seismic volcano basalt",
    "geo/b.md": "tectonic plates mantle crust seismic volcano magma granite",
    "geo/c.md": "plates drift mantle crust volcano basalt magma fault",
    "cook/d.md": "butter flour oven bake dough yeast sugar recipe",
    "cook/e.md": "butter flour oven dough yeast sugar salt kneading",
    "cook/f.md": "flour oven bake dough sugar recipe salt cream",
    "journal/day.md": "tectonic plates drift mantle crust seismic volcano basalt",
}


def test_topics_relate_and_exclusion_is_one_way(spark):
    i = index.build(frame(spark, TOPICS), ["journal"], "en")
    edges = {(r.a, r.b) for r in pairs.edges(i).collect()}
    assert edges == {("geo/a.md", "geo/b.md"), ("geo/a.md", "geo/c.md"), ("geo/b.md", "geo/c.md"), ("cook/d.md", "cook/e.md"), ("cook/d.md", "cook/f.md"), ("cook/e.md", "cook/f.md")}
    assert "journal/day.md" not in {r.path for r in pairs.related(i, "geo/a.md").collect()}
    assert "geo/a.md" in {r.path for r in pairs.related(i, "journal/day.md").collect()}
    members = {r.path: r.community for r in graph.louvain(pairs.edges(i).withColumnRenamed("score", "w")).collect()}
    assert len(set(members.values())) == 2 and members["geo/a.md"] == members["geo/c.md"] != members["cook/d.md"]
    labels = graph.community_labels(graph.louvain(pairs.edges(i).withColumnRenamed("score", "w")), i).collect()
    assert len(labels) == 2 and all(r.label for r in labels)


def test_prefix_filter_loses_no_pair(spark):
    import random

    rnd = random.Random(2)
    rows = {f"n/{k:03}.md": " ".join(rnd.choices([f"word{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(6)], k=rnd.randint(0, 60))) for k in range(90)}
    i = index.build(frame(spark, rows), [], "en")
    sizes = {r.path: r["size"] for r in i.top.select("path", "size").distinct().collect()}
    for tau in (0.08, 0.25, 0.5):
        want = {(r.a, r.b) for r in pairs.candidates(i).collect() if r.shared / (sizes[r.a] + sizes[r.b] - r.shared) >= tau}
        got = [(r.a, r.b) for r in pairs.scored_pairs(i, tau).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def templated():
    rows = {f"t/{k}.md": f"agenda minutes attendees action followup owner filler{chr(97 + k)}xx" for k in range(20)}
    rows |= {"r/x.md": "agenda minutes attendees action followup owner quartz feldspar mica gneiss schist", "r/copy.md": "agenda minutes attendees action followup owner quartz feldspar mica gneiss schist marble"}
    return rows


def test_templates_do_not_relate_but_copies_do(spark):
    i = index.build(frame(spark, templated()), [], "en")
    assert "agenda" not in {r.stem for r in i.disc.collect()}
    assert pairs.related(i, "t/0.md").count() == 0
    dup = signals.near_duplicates(i, "r/x.md").collect()
    assert [r.path for r in dup] == ["r/copy.md"] and dup[0].score > 0.8
    links = spark.createDataFrame([("t/0.md", "r/x.md", 1)], "src string, dst string, n long")
    broken = spark.createDataFrame([("r/x.md", "nowhere", 1), ("r/x.md", "void", 2)], "src string, target string, n long")
    queue = {r.path: r.reason for r in signals.attention_queue(i, links, broken).collect()}
    assert queue["r/x.md"] == "1 near-duplicate, 2 broken links" and queue["r/copy.md"] == "1 near-duplicate"
    assert {(r.src, r.dst) for r in signals.stale_links(i, links).collect()} == {("t/0.md", "r/x.md")}
    assert signals.in_degree(links).collect()[0].deg == 1


def test_search(spark):
    rows = {"a.md": "volcano volcano volcano", "b.md": "volcano " + "filler words here " * 60, "c.md": "nothing", "volcano.md": "unrelated text"}
    i = index.build(frame(spark, rows), [], "en")
    assert [r.path for r in search.bm25(i, "volcanoes volcano").collect()][:2] == ["a.md", "b.md"]
    assert "volcano.md" in {r.path for r in search.search(i, "volcano").collect()}
    assert search.bm25(i, "the").count() == 0 and search.title_hits(i.notes, " ").count() == 0
    got = spark.range(1).select(search.split_scope(F.lit("find path:/notes/Geo/ this")).alias("p")).select("p.*").first()
    assert (got.query, got.scope) == ("find this", "notes/geo/")


def test_snippets():
    body = "x " * 100 + "Needle in hay needle " + "y " * 200
    got = search.pieces_of(" ".join(body.split()), ["needle"])
    assert got[0] == ("…", False) and got[-1] == ("…", False) and sum(h for _, h in got) == 2
    assert search.pieces_of("opening text", ["zzz"]) == [("opening text", False)] and search.pieces_of("", ["a"]) == []
    assert search.pieces_of("abc abcd", ["abc", "abcd"]) == [("abc", True), (" ", False), ("abcd", True)]


def test_mentions_and_grep(spark):
    notes = frame(spark, {"a.md": "a network of NET things", "b.md": "internet only", "c.md": "net\n  The Line \nx"})
    titles = spark.createDataFrame([("net",), ("n",)], "title string")
    got = mentions.mention_index(notes, titles).collect()
    assert [(r.title, r.paths) for r in got] == [("net", ["a.md", "c.md"])]
    assert [(r.path, r.line, r.content) for r in mentions.grep(notes, ["the line"]).collect()] == [("c.md", 2, "The Line")]
    assert mentions.grep(notes, ["net", "net"]).count() == 6 and mentions.grep(notes, []).count() == 0


def test_autolink(spark):
    rows = {"Deep Sea.md": "x", "Sea.md": "y", "n.md": "# Sea heading\nThe deep sea and the Sea, `Sea` and $Sea$ and n.", "m.md": "[[Sea]] has Sea; Seaside [Sea](u)"}
    notes = frame(spark, rows)
    got = {r.path: (r.content, list(r.added)) for r in mentions.autolink(notes).collect()}
    assert got["n.md"] == ("# Sea heading\nThe [[Deep Sea]] and the [[Sea]], `Sea` and $Sea$ and n.", ["Deep Sea", "Sea"])
    assert got["m.md"] == (rows["m.md"], []) and got["Sea.md"][1] == []
    assert tuple(mentions.autolink_totals(mentions.autolink(notes)).first()) == (1, 2)


def test_vault_edits(spark):
    notes = frame(spark, {"a.md": "one", "b.md": "two"})
    edit = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    body = lambda df: {r.path: r.content for r in df.collect()}
    assert body(vault.create(notes, edit(("/x//c.md", "new"))))["x/c.md"] == "new"
    with pytest.raises(FileExistsError):
        vault.create(notes, edit(("a.md", "again")))
    assert body(vault.overwrite(notes, edit(("a.md", "")))) == {"a.md": "", "b.md": "two"}
    assert body(vault.append(notes, edit(("a.md", "+")))) == {"a.md": "one+", "b.md": "two"}
    links = spark.createDataFrame([("b.md", "a.md", 2)], "src string, dst string, n long")
    moved, after = vault.move(notes, links, spark.createDataFrame([("a.md", "d/z.md")], "path string, to string"))
    assert body(moved) == {"d/z.md": "one", "b.md": "two"} and tuple(after.first()) == ("b.md", "d/z.md", 2)
    kept, trash = vault.delete(notes, edit(("a.md", "")))
    assert body(kept) == {"b.md": "two"} and body(trash) == {"a.md": "one"}
    with pytest.raises(FileNotFoundError):
        vault.read_note(notes, "none.md")
    with pytest.raises(ValueError):
        vault.request(notes, "erase")


def test_folder_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.md").write_text("# T\nline\n")
    (tmp_path / "x.txt").write_text("no")
    got = vault.read_folder(spark, str(tmp_path)).collect()
    assert [(r.path, r.basename, r.content) for r in got] == [("sub/n.md", "n", "# T\nline\n")]
    assert vault.read_files(spark, str(tmp_path)).count() == 2
    assert [(r.level, r.heading, r.line) for r in vault.outline(vault.read_folder(spark, str(tmp_path))).collect()] == [(1, "T", 1)]


def test_refresh_counts_only_what_moved(spark):
    old = frame(spark, {"a.md": "alpha", "b.md": "beta", "gone.md": "gamma"})
    new = old.filter("path <> 'gone.md'").withColumn("content", F.lit("delta")).withColumn("mtime", F.when(F.col("path") == "b.md", 99).otherwise(F.col("mtime")))
    got = {(r.path, r.stem) for r in index.refresh(old, index.stem_counts(old), new).collect()}
    assert got == {("a.md", "alpha"), ("b.md", "delta")}
    assert index.unchanged(old, old) and not index.unchanged(old, new)


def test_bridge_keeps_communities_apart_and_layout_fills_the_box(spark):
    rows = [(a, b, 1.0) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 1.0)]
    edges = spark.createDataFrame(rows, "a string, b string, w double")
    got = {r.path: r.community for r in graph.louvain(edges).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "z": 1}
    nodes = spark.createDataFrame([(c,) for c in "abcxyz"] + [("lone",)], "path string")
    placed = graph.layout(edges, nodes).collect()
    assert len(placed) == 7 and all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in placed)
    assert sorted(map(tuple, placed)) == sorted(map(tuple, graph.layout(edges, nodes).collect()))


def test_colours_are_strings(spark):
    assert json.dumps(one(spark, text.community_colour(F.lit(0)))) == '"hsl(212.0, 66%, 70%)"'


def test_one_note_is_linked_with_the_titles_given_or_all(spark):
    notes = vault.create(frame(spark, {}), spark.createDataFrame([("a.md", "see beta and gamma"), ("beta.md", ""), ("gamma.md", "")], "path string, content string")).withColumn("title", F.col("basename"))
    titles = spark.createDataFrame([("beta",)], "title string")
    assert mentions.autolink_note(notes, "a.md", titles).first().content == "see [[beta]] and gamma"
    assert mentions.autolink_note(notes, "a.md").first().content == "see [[beta]] and [[gamma]]"
    assert mentions.autolink_note(notes, "none.md", titles).collect() == []


def test_strings_of_a_variant_list(spark):
    of = lambda j: one(spark, vault.listed_strings(F.parse_json(F.lit(j))))
    assert of('["a", 1, null, "b", ["c"]]') == ["a", "b"] and of('"a"') == [] and of("{}") == []


@pytest.mark.parametrize("seed", [1, 2])
def test_mentions_equal_brute_force(spark, seed):
    import random
    import re

    rnd = random.Random(seed)
    words = ["net", "network", "a", "of net", "c++", "über", "x-y", "the net of", "\u00e9t", "[b]", "b]", "9"]
    join = [" ", "  ", ", ", "", "-", "[", "]", "\n", "_"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(join) for _ in range(rnd.randint(0, n)))
    bodies = {f"{i}.md": rnd.choice([text, lambda n: text(n).upper()])(12) for i in range(40)}
    titles = sorted({text(3) for _ in range(150)} | set(words))
    rows = spark.createDataFrame(list(bodies.items()) + [("null.md", None)], "path string, content string")
    asked = spark.createDataFrame([(t,) for t in titles], "title string")
    starts = {mentions.INDEX_PIECE: (r"(?<![a-z0-9])(?=[a-z0-9])", str), mentions.LINK_PIECE: (r"(?<![a-z0-9_\[])(?=.)", str.lower)}
    for piece, (start, low) in starts.items():
        want = {(t, p) for t in titles for p, c in bodies.items() if len(t) >= 2 and re.search(f"(?s){start}{re.escape(low(t))}", c.lower())}
        assert {tuple(r) for r in mentions.mentions(rows, asked, piece).collect()} == want and len(want) > 100
    assert mentions.mentions(rows, asked.limit(0)).collect() == [] and mentions.mentions(rows.limit(0), asked).collect() == []


def test_no_task_holds_titles_and_none_of_them_is_python(spark):
    rows = frame(spark, {"a.md": "the net of x", "b.md": "networks"}).withColumn("title", F.lit("net"))
    plan = mentions.mentions(rows, spark.createDataFrame([("net",), ("the net",)], "title string"))._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_postings_are_read_by_bucket(spark):
    notes = frame(spark, {f"{i}.md": " ".join(f"word{chr(97 + (i * k) % 26)}{chr(97 + k)}" for k in range(12)) for i in range(40)}).withColumn("title", F.col("basename"))
    i = index.build(notes, lang="en")
    p = index.postings(i, 16)
    stems = ["wordaa", "worddb", "wordgc"]
    rows = {k: search.bm25_of_postings(p, stems[:k]) for k in (1, 3)}
    expected = search.bm25(i, " ".join(stems)).collect()
    assert [(r.path, round(r.score, 9)) for r in rows[3].collect()] == [(r.path, round(r.score, 9)) for r in expected] and expected
    read = {}
    for k, found in rows.items():
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
        read[k] = len(found.inputFiles()) if k == 0 else p.rows.filter(F.col("bucket").isin([r.b for r in spark.createDataFrame([(s,) for s in stems[:k]], "stem string").select(index.stem_bucket(F.col("stem"), 16).alias("b")).collect()])).select(F.input_file_name()).distinct().count()
    assert read[1] < read[3] < len(p.rows.inputFiles())
    assert search.bm25_of_postings(p, []).collect() == []


def test_an_index_is_built_once_for_callers_at_the_same_time(spark):
    import threading

    from vellum.storage import once

    made, got = [], []

    def make():
        made.append(1)
        return object()

    threads = [threading.Thread(target=lambda: got.append(once(spark, ("test", "key"), make))) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(made) == 1 and len({id(x) for x in got}) == 1
    for k in range(40):
        once(spark, ("test", k), make)
    assert len(made) == 41 and once(spark, ("test", "key"), make) is not got[0]


def test_autolink_of_the_tables_equals_plain_code(spark):
    import re

    notes = vault.document_notes(spark, "/root/testdata/sf0.001").collect()
    counts = {}
    for n in notes:
        counts[n.title] = counts.get(n.title, 0) + 1
    titles = sorted((t for t, k in counts.items() if k == 1 and len(t) >= 2), key=lambda t: (-len(t), t))
    want, links = {}, 0
    for n in notes:
        body, mask, added = n.content, [False] * len(n.content), []
        for rule in (r"(?m)^#{1,6}[ \t]\S.*$", r"`[^`\n]+`", r"(?s)\$\$.*?\$\$", r"\$[^$\n]+\$"):
            for m in re.finditer(rule, body):
                mask[m.start() : m.end()] = [True] * (m.end() - m.start())
        for t in titles:
            if t.lower() == n.title.lower():
                continue
            for m in re.finditer(rf"(?<![A-Za-z0-9_\[]){re.escape(t)}(?![A-Za-z0-9_\]])", body, re.I):
                if not any(mask[m.start() : m.end()]):
                    body = f"{body[: m.start()]}[[{t}]]{body[m.end() :]}"
                    mask[m.start() : m.end()] = [True] * (len(t) + 4)
                    added.append(t)
                    break
        want[n.path] = (body, added)
        links += len(added)
    got = {r.path: (r.content, list(r.added)) for r in mentions.autolink(vault.document_notes(spark, "/root/testdata/sf0.001")).collect()}
    assert got == want and links > 20
