"""What must not grow with the tables: rows that are shuffled, rows that a Python worker holds, pairs that are counted."""

from pyspark.sql import functions as F

from vellum import storage
from vellum.operators import diffs, index, mentions, pairs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def noted(spark, texts):
    return spark.createDataFrame([(f"n{i:03}.md", t) for i, t in enumerate(texts)], "path string, content string")


def test_mentions_shuffle_bodies_once_and_nothing_that_is_cut(spark, monkeypatch):
    notes = noted(spark, ["alpha beta and alpha beta again", "the beta gamma", None, "alphabet soup", "gamma, beta"])
    titles = spark.createDataFrame([("alpha beta",), ("beta",), ("gamma",), ("alp",)], "title string")
    found = mentions.mentions(notes, titles)
    assert plan(found).count("Exchange hashpartitioning") == 1
    want = sorted(map(tuple, found.collect()))
    assert want == [("alp", "n000.md"), ("alp", "n003.md"), ("alpha beta", "n000.md"), ("beta", "n000.md"), ("beta", "n001.md"), ("beta", "n004.md"), ("gamma", "n001.md"), ("gamma", "n004.md")]
    monkeypatch.setattr(storage, "BROADCAST", 100)
    assert sorted(map(tuple, mentions.mentions(notes, titles).collect())) == want


def test_python_workers_get_few_texts_at_a_time(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.range(1500).select(F.col("id"), F.lit("a\nb").alias("before"), F.lit("a\nc").alias("after"))
    assert diffs.hunk_ranges(rows).count() == 1500
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == storage.BATCH


def test_pairs_are_counted_inside_two_blocks_and_never_shuffled(spark, monkeypatch):
    words = [f"w{chr(97 + i)}x{chr(97 + j)}" for i in range(6) for j in range(5)]
    texts = [" ".join(words[(3 * i + k * (1 + i % 4)) % len(words)] for k in range(i % 9)) for i in range(25)]
    i = index.build(noted(spark, texts).withColumn("mtime", F.lit(1)), [], "en")
    top, disc = {}, {}
    for rows, sets in ((i.top, top), (i.disc, disc)):
        for r in rows.collect():
            sets.setdefault(r.path, set()).add(r.stem)
    like = lambda s, t: len(s & t) / len(s | t) if s | t else 0.0
    want = {(a, b, len(top[a] & top[b]), like(top[a], top[b]), like(disc.get(a, set()), disc.get(b, set()))) for a in top for b in top if a < b and top[a] & top[b]}
    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(pairs, "GIVEN", 3)
    found = pairs.block_pairs(i, 0.2, 0.1)
    assert {tuple(r) for r in found.collect()} == {w for w in want if w[3] >= 0.2 and w[4] >= 0.1}
    assert {tuple(r) for r in pairs.candidates(i).collect()} == {w[:3] for w in want}
    assert "Join" not in plan(found) and "HashAggregate" not in plan(found)


def test_words_are_counted_where_their_note_is(spark):
    p = plan(index.stem_counts(noted(spark, ["one tested thing", "other things"])))
    assert p.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in p
    assert "_one" in p  # the singular is not put in for each of its uses


def test_one_note_meets_the_others_stems_in_one_pass(spark):
    i = index.build(noted(spark, ["alpha beta gamma", "alpha beta gamma delta", "beta epsilon", ""]).withColumn("mtime", F.lit(1)), [], "en")
    near = pairs.related_all(i, "n000.md")
    assert "LeftSemi" not in plan(near)
    assert [(r.path, r.score, r.overlap) for r in near.orderBy("path").collect()] == [("n001.md", 0.75, 0.75), ("n002.md", 0.25, 0.25)]


def test_notes_go_to_blocks_as_packed_numbers_of_the_stems_that_others_have(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(pairs, "kept", lambda df, name: written.setdefault(name, storage.kept(df, name)))
    texts = [" ".join([f"{a}{b}{c}ord" for a in "bcdfg" for b in "aeiou" for c in "klmn" if (ord(a) + ord(b) + i) % 3] + [f"only{'abcdefgh'[i]}x"]) for i in range(8)]
    i = index.build(noted(spark, texts).withColumn("mtime", F.lit(1)), [], "en")
    pairs.block_pairs(i, 0.2, 0.1)
    for r in written["pair-sets"].collect():
        assert r.told > 60 and len(r.stems) <= r.told - 1  # a byte for a stem, none for the one that no other note has
        assert r.size == 30 and len(r.top) <= 30


def test_packed_sets_come_back_sorted():
    import numpy as np
    import pyarrow as pa

    sets = [[5, 1, 300], [], [2**31 - 1], [127, 128, 16383, 16384, 1 << 21], [], [1]]
    packed = pairs.pack(pa.array(sets, pa.list_(pa.int32())))
    numbers, lengths = pairs.unpack(packed)
    assert [x.tolist() for x in np.split(numbers, np.cumsum(lengths)[:-1])] == [sorted(x) for x in sets]
    numbers, lengths = pairs.unpack(packed.slice(2, 2))
    assert lengths.tolist() == [1, 5] and numbers[0] == 2**31 - 1
    assert len(pairs.unpack(pairs.pack(pa.array([[], []], pa.list_(pa.int32()))))[0]) == 0


def test_shared_stems_are_counted_alike_by_lines_by_lists_and_by_the_notes_own():
    import numpy as np

    draw = np.random.default_rng(1)
    of = lambda n, most: [np.sort(draw.choice(np.arange(1, 900), draw.integers(0, most), replace=False)) for _ in range(n)]
    flat = lambda sets: (np.concatenate(sets).astype(np.int64), np.array([len(x) for x in sets]))
    for most, share in ((30, 8), (700, 2), (700, 64)):
        left, right = of(9, most), of(40, most)
        block = pairs.Block(flat(right), share)
        block.ask(flat(left))
        for a, own in enumerate(left):
            want = [len(np.intersect1d(own, x)) for x in right]
            assert block.every(a).tolist() == want
            assert block.some(a, np.array([3, 7])).tolist() == [want[3], want[7]]


def test_ratios_are_rounded_as_decimals_are(spark):
    from vellum.plans import catalogue

    rows = spark.range(1, 400).withColumnRenamed("id", "m").crossJoin(spark.range(0, 400).withColumnRenamed("id", "k")).filter("k <= m").select((F.col("k") / F.col("m")).alias("x"), F.round(F.col("k") / F.col("m"), 6).alias("want"))
    assert catalogue.rounded_ratio(rows, "x").filter("x <> want").count() == 0


def test_links_are_found_without_a_pattern_for_each_title(monkeypatch):
    import random

    draw = random.Random(7)
    text = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    for _ in range(3000):
        body, title = text(30, "aAbBéß[]_ 1"), text(draw.randrange(2, 5), "aAbBéß _")
        assert list(mentions.found_plain(body, body.lower(), title)) == list(mentions.found_any(body, title))
    assert [mentions.plain(t) for t in ("Straße É", "\u017fea", "\u03a3", "\u03c3\u03b1\u03c2", "\u0131", "\u212a", "\u00b5")] == [True, False, True, False, False, False, False]
    assert mentions.linked_body("the ſea", "x", ["sea"]) == ("the [[sea]]", ["sea"])
    monkeypatch.setattr(mentions, "found_any", None)
    assert mentions.linked_body("The deep sea, Sea and `Sea`", "x", ["sea", "deep sea"]) == ("The [[deep sea]], [[sea]] and `Sea`", ["deep sea", "sea"])


def test_what_is_ahead_of_a_start_is_the_same_by_one_pattern_and_by_pieces(spark, monkeypatch):
    notes = noted(spark, ["alpha, beta gamma\nalpha", "_beta [gamma]] x", "caf\u00e9 \u00e9t\u00e9 b\u00e9", "", None, "alphabetical", "x" * 400 + " beta"])
    titles = spark.createDataFrame([("alpha",), ("beta gamma",), ("gamma]] x",), ("caf\u00e9 \u00e9t\u00e9",), ("b\u00e9",), ("x x",), ("be",), ("a\nb",)], "title string")
    got = []
    for most in (256, 1):
        monkeypatch.setattr(mentions, "AHEAD", most)
        got.append([sorted(map(tuple, mentions.mentions(notes, titles, p).collect())) for p in (mentions.INDEX_PIECE, mentions.LINK_PIECE)])
    assert got[0] == got[1] and ("beta gamma", "n000.md") in got[0][0] and ("caf\u00e9 \u00e9t\u00e9", "n002.md") in got[0][1]
    assert "transform" not in plan(mentions.mentions(notes, titles, mentions.LINK_PIECE)) or mentions.AHEAD == 1


def test_no_pair_is_shuffled_to_meet_the_written_links(spark, monkeypatch):
    from vellum.operators import graph, signals

    words = [f"w{chr(97 + i)}x{chr(97 + j)}" for i in range(6) for j in range(5)]
    texts = [" ".join(words[(k + i // 2) % len(words)] for k in range(12)) for i in range(14)]
    i = index.build(noted(spark, texts).withColumn("mtime", F.lit(1)), [], "en")
    links = spark.createDataFrame([("n001.md", "n000.md", 1), ("n003.md", "n005.md", 2), ("n004.md", "gone.md", 1), ("n002.md", "n006.md", 0)], "src string, dst string, n long")
    every = {tuple(r) for r in pairs.edges(i).select("a", "b").collect()}
    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(storage, "BROADCAST", 0)
    found = graph.graph_edges(i, links)
    assert "Join" not in plan(found)
    got = {(r.a, r.b): r.inferred for r in found.collect()}
    known = {("n000.md", "n001.md"), ("n003.md", "n005.md"), ("gone.md", "n004.md")}
    assert {("n000.md", "n001.md"), ("n003.md", "n005.md"), ("n002.md", "n006.md")} <= every
    assert got == {k: k not in known for k in every | known}
    told = pairs.block_pairs(i, 0.1, 0.1, signals.written(links))
    assert {(r.a, r.b) for r in told.filter("known").collect()} == known - {("gone.md", "n004.md")}
    monkeypatch.setattr(storage, "BROADCAST", 64 << 20)
    lines = plan(signals.queue_signals(i, links, spark.createDataFrame([], "src string, target string, n long"))).splitlines()
    assert not any("SortMergeJoin" in x and "LeftOuter" in x for x in lines)
