"""The pipeline's stages against brute-force versions, each on its own input."""

import random

import pytest

import corpus_pipeline
from vellum.llm import mixing, toxicity
from tests.llm.test_dedup import near_by_definition

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(8)
    root = str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    for i in range(300):
        words = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(20, 120))]
        toxic = i % 5 == 0
        for _ in range(6 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vilefoo", "grimbar"]))
        if i % 7 == 0:
            words.insert(3, "mail a.b@c.org now")
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "s9", 0) for i in range(1, 60, 2)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if name == "toxicity":
            assert docs.columns == COLUMNS
            ids = {r.doc_id for r in after}
            assert sum(i in ids for i in range(0, 300, 5)) <= 3 and sum(i in ids for i in range(300) if i % 5) >= 237
        elif name == "simhash_near_dedup":
            rows = sorted(before, key=lambda r: r.doc_id)
            keep = [rows[i].doc_id for i, r in enumerate(near_by_definition([r.text for r in rows])) if i == r]
            assert docs.columns == COLUMNS and sorted(r.doc_id for r in after) == keep
        elif name == "pii":
            assert len(after) == len(before) and not any("@" in (r.text or "") for r in after)
            assert {r.doc_id: r.text for r in before if "@" not in (r.text or "")}.items() <= {r.doc_id: r.text for r in after}.items()
        elif name == "mixing":
            want = {r.doc_id: r.copies if r["size"] else 1 for r in mixing.mix(spark.read.parquet(f"{tmp_path}/{k - 1}")).collect()}
            got = {}
            for r in after:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert docs.columns == COLUMNS and got == {d: n for d, n in want.items() if n}
        else:
            assert len(after) == len(before) and all(r.round_trip and r.n_pieces == len(r.pieces) for r in after)
        before = after


def test_run_is_the_stages_in_a_row(spark, tables):
    first = sorted((r.doc_id, r.n_pieces) for r in corpus_pipeline.run(spark, tables).collect())
    assert first and first == sorted((r.doc_id, r.n_pieces) for r in corpus_pipeline.run(spark, tables).collect())


def test_empty_tables(spark, tables, tmp_path):
    empty = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, empty, tables).write.parquet(f"{tmp_path}/{k}")
        empty = spark.read.parquet(f"{tmp_path}/{k}")
        assert empty.count() == 0


def test_a_repeated_row_is_mixed_once_for_each(spark):
    rows = [(1, "a b", "s", 0), (1, "a b", "s", 0), (2, "c", None, 0), (None, "d d d", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int").drop("_size")
    want = sum(r.copies for r in mixing.mix(df).collect())
    assert mixing.mixed(df).count() == want and toxicity.Model().features == []
