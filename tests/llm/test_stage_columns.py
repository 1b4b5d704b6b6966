"""Stages keep columns of any name and type, and null and repeated ids."""

from collections import Counter

import public_tokenizers
import pytest

from vellum.llm import mixing, near_copies, pieces, pii, toxicity

WORK = ["_top", "_node", "_least", "_copies", "_gone", "_pii_text", "_pii_all", "_pii_email", "_h1", "_size", "kept0", "n", "key", "size", "row", "name"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pieces string, facts map<string,int>, " + ", ".join(f"`{c}` string" for c in WORK)
TEXT = "the quick brown fox jumps over a lazy dog while many calm cats watch it run away today {} and then they all sleep well at home again"


def rows():
    texts = [TEXT.format("now"), TEXT.format("now"), "mail me at ann@example.org please", None, "", "another text about nothing much " * 4]
    ids = [None, None, 1, 1, 2, 3]
    out = []
    for i, (d, t) in enumerate(zip(ids, texts, strict=True)):
        out.append((d, t, "en", "s", 7, f"p{i}", {"k": i} if i % 2 else None, *[f"{c}-{i}" for c in WORK]))
    return [*out, out[-1], out[-1]]  # repeated rows with a map


def seen(found, without=()):
    drop = {"text", "n_chars", "pieces", *without}
    return Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items() if k not in drop)) for r in found)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_near_copies(docs):
    got = near_copies.deduplicated(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert Counter((r.doc_id, (r.text or "")[:7]) for r in found) == Counter({(None, "the qui"): 1, (1, "mail me"): 1, (1, ""): 1, (3, "another"): 1})
    assert not seen(found) - seen(docs.collect())


def test_redacted(docs):
    got = pii.redacted(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    found = got.collect()
    assert seen(found) == seen(docs.collect()) and {r.text for r in found if r.doc_id == 1} == {"mail me at [EMAIL] please", None}
    assert {r["_pii_text"] for r in found} == {f"_pii_text-{i}" for i in range(6)}


def test_mixed(docs):
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    found = got.collect()
    known = seen(docs.collect())
    assert found and set(seen(found)) <= set(known) and sum(r.text is None or r.text == "" for r in found) == 2


def test_rows_that_differ_in_a_map_only_are_not_one(spark):
    two = spark.createDataFrame([(1, "a b c", "s", {"k": i % 2}) for i in range(6)], "doc_id long, text string, source string, facts map<string,int>")
    units = mixing.taken_of(two.select(*mixing.marked(two, "h1", "h2"), two["doc_id"].alias("id"), "source", mixing.size_of(two["text"]).alias("size")), 11)
    assert units.select("h1", "h2").distinct().count() == 2 and units.count() == 6


def test_kept_and_pieces(docs, spark):
    got = pieces.with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert got.columns == [c for c in docs.columns if c != "pieces"] + ["pieces", "n_pieces", "round_trip"]
    found = got.collect()
    assert seen(found, ("n_pieces", "round_trip")) == seen(docs.collect()) and all(r.n_pieces == 0 for r in found if not r.text)
    labelled = spark.createDataFrame([(i, ("vile awful " if i % 2 else "kind calm ") * 5, "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(labelled, labels)
    assert seen(toxicity.kept(docs, model).collect()) == seen(docs.collect())


def test_empty_tables(docs):
    none = docs.limit(0)
    for stage in (near_copies.deduplicated, pii.redacted, mixing.mixed):
        assert stage(none).collect() == []
