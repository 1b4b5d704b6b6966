"""The numbered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm import collocations, fingerprints, html_text, lines, mixing, pieces, pii, simhash, substrings, token_counts, topk, toxicity, whitening
from vellum.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), digest=True)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 20 = 0"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_fingerprints": op2_fingerprints,
        "op3_mix": op3_mix,
        "op4_substrings": op4_substrings,
        "op5_pieces": op5_pieces,
        "op6_topk": op6_topk,
        "op7_pii": op7_pii,
        "op8_token_counts": op8_token_counts,
        "op9_simhash": op9_simhash,
        "op10_main_text": op10_main_text,
        "op11_lines": op11_lines,
        "op12_whitening": op12_whitening,
        "op13_collocations": op13_collocations,
    }


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 20
"""


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11_SQL = f"""
with l as (
  select rid, doc_id, pos, line, translate(trim(line, {SPACES}), {LOWER}) as key from (
    select rid, doc_id, unnest(range(len(s))) as pos, unnest(s) as line from (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)
  )
), common as (select key from l where length(key) >= 1 group by key having count(distinct rid) >= 10)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(c.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.key is null), '')) as kept_sha256
from l left join common c on l.key = c.key group by rid
"""

OP13_SQL = f"""
with pieces as (
  select row_number() over () as id, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') as w
  from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), {LOWER}), '[.,;:!?\n\x0B\x0C\r]')) as piece from documents)
), grams as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, 6) t(k))
), f as (
  select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 100
), total as (select lang, sum(len(w)) as n from pieces group by lang
), cuts as (
  select lang, k as size, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, k)) as cut from f where k > 1
), parts as (
  select c.lang, c.size, c.phrase, c.a, c.cut, l.f as l, r.f as r, n, (1000::hugeint * a * n) // (l.f::hugeint * r.f) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[:c.cut], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.cut + 1 :], ' ')
  join total t on t.lang = c.lang
), best as (
  select lang, size, phrase, a, l, r, n, score from parts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), held as (
  select distinct s.lang, s.phrase from best s join best b on b.lang = s.lang and b.size > s.size and contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') and 100 * b.a >= 100 * s.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from best where (lang, phrase) not in (select (lang, phrase) from held) qualify rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6_SQL, "op11_lines": OP11_SQL, "op13_collocations": OP13_SQL}
