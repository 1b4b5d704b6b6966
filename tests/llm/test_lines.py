import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from vellum.llm import lines
from vellum.llm.lines import LineRuns, deduplicated, line_report

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII)


def brute(texts, least, min_chars=1):
    """(text, n_lines, n_dropped) of each text, by the definition."""
    docs = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    common = {k for k, n in docs.items() if n >= least and len(k) >= min_chars}
    out = []
    for t in texts:
        rows = (t or "").split("\n")
        stay = [x for x in rows if key(x) not in common]
        out.append((t if len(stay) == len(rows) else "\n".join(stay), len(rows), len(rows) - len(stay)))
    return out


TEXTS = ["Home \nOne\n\tHOME\r\n", "home\nTwo", " Home\nÄ\nä", "home\nä", "Ä\nx y", None, "", "\n\n", "x y\n\xa0home", "word\n" * 3000 + "home"]


@pytest.mark.parametrize("least", [1, 2, 4])
@pytest.mark.parametrize("deal", [1, 3, 5])
def test_lines_of_several_batches_go_as_defined(spark, least, deal):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    batches = [docs.filter(F.col("doc_id") % deal == k) for k in range(deal)]
    got = deduplicated(docs, least, batches=batches).orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines"], r["n_dropped"]) for r in got] == brute(TEXTS, least)


def test_short_keys_stay(spark):
    docs = spark.createDataFrame([(i, "ab\nabc\nÄÖ") for i in range(3)], "doc_id long, text string")
    assert {r["text"] for r in deduplicated(docs, 3, min_chars=3).collect()} == {"ab\nÄÖ"}


def test_runs_are_levelled_sorted_and_counts_stay_whole(spark):
    runs = LineRuns(spark, least=2)
    docs = spark.createDataFrame([(i, f"all\nown {i}\npair {i // 2}") for i in range(12)], "doc_id long, text string")
    for k in range(6):
        runs.add(docs.filter((F.col("doc_id") >= 2 * k) & (F.col("doc_id") < 2 * k + 2)))
        assert all(len(level) < runs.fan for level in runs.levels)
    name = runs.runs()[0]
    plan = spark.table(name).join(spark.table(runs.runs()[-1]).hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    totals = sorted(r["docs"] for r in runs.totals().collect())
    assert totals == [1] * 12 + [2] * 6 + [12]
    # `all` is settled by the first batch, so no later run holds it
    held = spark.table(name)
    for other in runs.runs()[1:]:
        held = held.unionByName(spark.table(other))
    assert held.filter("docs = 12").count() == 0
    common = runs.common()
    runs.close()
    assert common.count() == 7 and not spark.catalog.tableExists(name)


def test_repeated_rows_nulls_clashing_names_and_a_hot_key(spark, monkeypatch):
    from vellum.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(None, "same\nmine", {"a": 1}, "r")] * 6 + [(1, "same\nother", {"b": 2}, "k"), (1, "same\nthird", None, None), (2, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keys map<string,int>, _row string")
    got = Counter((r["doc_id"], r["text"], str(r["_keys"]), r["_row"], r["n_dropped"]) for r in deduplicated(docs, 6).collect())
    assert got == Counter({(None, "", "{'a': 1}", "r", 2): 6, (1, "other", "{'b': 2}", "k", 1): 1, (1, "third", "None", None, 1): 1, (2, None, "None", "z", 0): 1})


def test_empty_table_and_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_lines string")
    out = deduplicated(docs)
    assert out.collect() == [] and out.schema["n_lines"].dataType.simpleString() == "bigint"


def test_report_digests_what_is_kept(spark):
    docs = spark.createDataFrame([(i, f"Cookie notice\nbody {i}") for i in range(10)] + [(10, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_report(docs).collect()}
    assert got[3]["kept_sha256"] == hashlib.sha256(b"body 3").hexdigest() and got[3]["n_dropped"] == 1
    assert got[10]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and got[10]["n_lines"] == 1


def test_a_table_of_many_files_is_dealt_by_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(30)], "doc_id long, text string")
    docs.repartition(6).write.parquet(str(tmp_path / "d"))
    batches = lines.batches_of(spark.read.parquet(str(tmp_path / "d")))
    assert len(batches) == 4 and sorted(r["doc_id"] for b in batches for r in b.collect()) == list(range(30))


def test_impossible_parameters_are_refused(spark):
    with pytest.raises(ValueError):
        LineRuns(spark, least=0)
