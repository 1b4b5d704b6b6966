"""Ranks and predecessors against windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.operators.ranks import rank_within, with_previous


def test_ranks_and_predecessors_equal_windows(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "cold", None]), rnd.randrange(50)) for i in range(500)] + [(900, "lone", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k string, v int")
    got = rank_within(df, "r", ["k"], [F.col("v").desc(), F.col("id")])
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), "id")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    got = rank_within(df, "r", [], [F.col("id").desc()])
    assert [r.r for r in got.orderBy(F.col("id").desc()).collect()] == list(range(1, 502))
    got = with_previous(df, "p", "id", ["k"], "id")
    want = df.withColumn("p", F.lag("id").over(Window.partitionBy("k").orderBy("id")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, k string")
    assert rank_within(df, "r", ["k"], [F.col("id")]).count() == 0 and with_previous(df, "p", "id", ["k"], "id").count() == 0
