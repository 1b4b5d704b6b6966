"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target, each of its documents the same expected number of copies, target over size.
The whole part is taken outright; the fractional parts p of a source are rounded together. The largest
open document, of size a, is paired with the next smaller open ones, as many as can give or take what it
needs. Along one direction, by which a fraction q moves in proportion to q*(1-q), mass goes one way or
the other, as far as the first of them has 0 or 1; the way is drawn so that all expectations stay. When
the large document is settled, the next largest is paired. The words taken stay as expected, and what
is left open in the end is, as a rule, one of the smallest documents.

Documents meet first inside buckets of bounded size, by source and a hash of the row, each in one task
among many; every bucket leaves at most one residual, and these meet in a tree: levels of bounded groups
until a source has one. The last residual is rounded by its own fraction. All draws come from a hash of
the seed and the row's key, so a rerun takes the same copies however the rows are dealt.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import WORD, hot_join, numbered, plain, under_safe_names, written

#: Documents of a bucket on average; residuals that meet in one group of the tree.
BUCKET, FAN_IN = 2_000, 256
#: Most words of a mix, in multiples of a source's size; the sources' weights by rank, repeating.
MOST, WEIGHTS = 3, (1, 2, 3)
EPS = 1e-9
#: Seeds that a group is rounded with at most; the residual, in shares of the group's words, that needs no other.
TRIES, NEAR = 24, 0.0005


def name_of(source: Column) -> Column:
    """A source's name, never null: a null source is one of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def draw(seed: int, key: str) -> float:
    return xxhash.xxh64_intdigest(key, seed) / 2.0**64


def pivot(rows: list[tuple[str, float, float]], seed: int) -> tuple[list[tuple[str, int]], tuple[str, float, float] | None]:
    """Rounds (key, size, fraction), largest size first: (key, 0 or 1) of the settled ones, and the one left open."""
    settled = [(k, int(q > 0.5)) for k, _, q in rows if q <= EPS or q >= 1 - EPS]
    units = sorted(((k, b, q) for k, b, q in rows if EPS < q < 1 - EPS), key=lambda u: (-u[1], u[0]))
    if not units:
        return settled, None
    size, part = np.array([u[1] for u in units]), np.array([u[2] for u in units])
    for i, (key, a, _) in enumerate(units):
        step = 0
        while EPS < part[i] < 1 - EPS:
            p, reach = part[i], 16
            while True:
                q, b = part[i + 1 : i + 1 + reach], size[i + 1 : i + 1 + reach]
                slope = np.where((q > EPS) & (q < 1 - EPS), q * (1 - q), 0.0)
                enough = np.flatnonzero(np.cumsum(b * slope) >= a * max(p, 1 - p))
                if len(enough) or i + 1 + reach >= len(units):
                    break
                reach *= 4
            if not slope.any():
                break
            last = enough[0] + 1 if len(enough) else len(q)
            q, b, slope = q[:last], b[:last], slope[:last]
            free = slope > 0
            mass = float((b * slope).sum())
            up, down = min(a * (1 - p), mass * (1 / (1 - q[free])).min()), min(a * p, mass * (1 / q[free]).min())
            if draw(seed, f"{key}|{step}") * (up + down) < down:
                part[i] = p + up / a
                q -= slope * (up / mass)
            else:
                part[i] = p - down / a
                q += slope * (down / mass)
            step += 1
    open_ = [i for i in range(len(units)) if EPS < part[i] < 1 - EPS]  # one at most: it met all others until none was open
    left = (units[open_[0]][0], float(size[open_[0]]), float(part[open_[0]])) if open_ else None
    return settled + [(u[0], int(x > 0.5)) for i, (u, x) in enumerate(zip(units, part, strict=True)) if i not in open_], left


def rounded(rows: list[tuple[str, float, float]], seed: int) -> tuple[list[tuple[str, int]], tuple[str, float, float] | None]:
    """pivot() with the first of TRIES seeds whose residual is at most NEAR of the words, or with the one that leaves least.

    Groups of many documents settle at the first try; the others, of few, are what this is for.
    """
    best, least, words = None, math.inf, sum(b * q for _, b, q in rows)
    for t in range(TRIES):
        settled, left = pivot(rows, seed + 7919 * t)
        error = left[1] * math.sqrt(left[2] * (1 - left[2])) if left else 0.0
        if error < least:
            best, least = (settled, left), error
        if least <= NEAR * words:
            break
    return best


def source_targets(sizes: DataFrame, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size, alike): shares by weight, none above `most` sizes.

    Sources weigh in code-point order, null last. What a capped source cannot take is shared again by
    weight among the others, until none is above; each round is one aggregation over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.sum("alike").alias("n_docs"))
    ranked = numbered(per, "rank", F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])[((F.col("rank") - 1) % len(weights)).cast("int")]
    kept = written(ranked.withColumn("weight", weight).drop("rank"), "sources")
    total = kept.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    rate, capped = None, -1
    while True:
        above = F.lit(False) if rate is None else F.col("weight") * rate > most * F.col("source_size")
        r = kept.agg(F.sum(F.when(above, most * F.col("source_size")).otherwise(0.0)).alias("fixed"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(above.cast("long")).alias("n")).first()
        if r["n"] is None or r["n"] == capped or not r["free"]:
            break
        capped, rate = r["n"], (total - r["fixed"]) / r["free"]
    target = F.least(F.col("weight") * F.lit(float(rate or 0.0)), most * F.col("source_size").cast("double"))
    return kept.select("source", "source_size", "n_docs", target.alias("target"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def marked(docs: DataFrame, *names: str) -> list[Column]:
    """64-bit hashes of all columns of a row, one by name; maps and variants, which have no hash, count by their JSON."""
    row = [plain(docs, c) for c in docs.columns]
    return [F.xxhash64(F.lit(i), *row).alias(name) for i, name in enumerate(names)]


def taken_of(rows: DataFrame, seed: int) -> DataFrame:
    """(h1, h2, nr, id, source, size, source_size, target, copies) from rows (h1, h2, id, source, size); h1 and h2: a row's hash.

    Equal rows are counted first, on the map side, and numbered without a window, so however often a row
    repeats no task holds all its copies; each draws apart.
    """
    alike = written(rows.groupBy("h1", "h2", "id", "source", "size").agg(F.count("*").alias("alike")), "sizes")
    targets = written(source_targets(alike).withColumn("name", name_of(F.col("source"))).drop("source"), "targets")
    joined = hot_join(alike.withColumn("name", name_of(F.col("source"))), targets.withColumn("rows", F.col("n_docs")), "name", "rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9)
    part = F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(0.0)
    each = joined.withColumn("nr", F.explode(F.sequence(F.lit(1), F.col("alike").cast("int"))))
    key = F.concat_ws("#", F.hex("h1"), F.hex("h2"), F.col("nr").cast("string"))
    units = each.withColumns({"copies": F.when(F.col("size") > 0, whole).otherwise(0).cast("long"), "part": part, "key": key})
    units = written(units.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), "key"), F.ceil(F.col("n_docs") / BUCKET))), "units")
    kinds = "name string, slot long, key string, size double, part double, up long"

    def level(rows: pd.DataFrame) -> pd.DataFrame:
        settled, left = rounded(list(zip(rows["key"], rows["size"].astype(float), rows["part"], strict=True)), seed)
        out = [(k, 0.0, 0.0, up) for k, up in settled] + ([(*left, -1)] if left else [])
        got = pd.DataFrame(out, columns=["key", "size", "part", "up"])
        return got.assign(name=rows["name"].iloc[0], slot=rows["slot"].iloc[0])[["name", "slot", "key", "size", "part", "up"]]

    todo, rounds, deepest = units.filter("part > 0").select("name", "slot", "key", F.col("size").cast("double").alias("size"), "part"), [], 0
    while True:
        done = written(todo.groupBy("name", "slot").applyInPandas(level, kinds), f"level{deepest}")
        rounds.append(done.filter("up > 0").select("key", "up"))
        left = done.filter("up < 0")
        most = left.agg(F.max("slot").alias("m")).first()["m"]
        if most is None:
            break
        if most == 0:  # one group for each source: what it left open is rounded by itself
            coin = F.conv(F.substring(F.hex(F.xxhash64(F.lit(seed), "key")), 1, 8), 16, 10).cast("double") / 2.0**32
            rounds.append(left.filter(coin < F.col("part")).select("key", F.lit(1).cast("long").alias("up")))
            break
        todo = left.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("long")).drop("up")
        deepest += 1
    ups = rounds[0]
    for r in rounds[1:]:
        ups = ups.unionByName(r)
    out = units.join(ups, "key", "left")
    return out.select("h1", "h2", "nr", "id", "source", "size", "source_size", "target", (F.col("copies") + F.coalesce("up", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every document; taken = copies * size.

    Size counts the words of the text; a null or empty text has size 0 and is not taken. A null source is
    a source of its own. Rows that repeat in all columns are rounded one by one and draw apart.
    """
    rows = docs.select(*marked(docs, "h1", "h2"), docs[id_col].alias("id"), docs[source_col].alias("source"), size_of(docs[text_col]).alias("size"))
    out = taken_of(rows, seed)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns kept; rows without words stay once.

    A row is known by the hash of all its columns, so rows of one id, source and length with different
    texts are taken each for itself; rows that are equal in all columns are taken together. Null ids, texts
    and sources are values like others; columns may have any names and types, and are left as they are.
    """
    return under_safe_names(docs, [id_col, text_col, source_col], lambda rows: taken_rows(rows, id_col, text_col, source_col, seed))


def taken_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    h1, h2, size, alike, n = ("_h1", "_h2", "_size", "_alike", "_copies")
    counted = docs.select("*", *marked(docs, h1, h2), size_of(docs[text_col]).alias(size))
    rows = counted.select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size).alias("size"))
    taken = taken_of(rows.filter("size > 0"), seed).groupBy(F.col("h1").alias(h1), F.col("h2").alias(h2)).agg(F.sum("copies").cast("int").alias(n), F.count("*").alias(alike))
    taken = written(taken.filter(F.col(n) > 0).withColumn("rows", F.col(alike)), "taken")
    met = hot_join(counted, taken, [h1, h2], "rows")
    if taken.filter(F.col(alike) > 1).limit(1).count():
        met = met.filter(F.col(alike) == 1).unionByName(met.filter(F.col(alike) > 1).dropDuplicates([h1, h2]))
    out = met.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return out.select(*docs.columns).unionByName(docs.filter(size_of(docs[text_col]) == 0))
