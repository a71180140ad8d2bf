"""The registered queries of this folder: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("op5_exact_dedup")
def op5(spark: SparkSession, d: str) -> DataFrame:
    from .exact_dedup import exact_dedup
    return exact_dedup(read_table(spark, d, "documents")).drop("n_chars", "text_key", "text_key2")


SQL["op5_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@register("op7_token_counts")
def op7(spark: SparkSession, d: str) -> DataFrame:
    from .token_counts import token_counts
    return token_counts(read_table(spark, d, "documents"), limit=512)


@register("op10_bpe_codec")
def op10(spark: SparkSession, d: str) -> DataFrame:
    from .bpe_codec import bpe_digests
    return bpe_digests(read_table(spark, d, "documents"))


@register("op1_topk_search")
def op1(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk_search import topk_search
    return topk_search(read_table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


SQL["op1_topk_search"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@register("op2_simhash_dedup")
def op2(spark: SparkSession, d: str) -> DataFrame:
    from .simhash import near_duplicates
    return near_duplicates(read_table(spark, d, "documents"), words=3, max_bits=2)


@register("op3_packing")
def op3(spark: SparkSession, d: str) -> DataFrame:
    from .packing import pack
    return pack(read_table(spark, d, "documents"), window=2048, end_id=1)


@register("op6_quality")
def op6(spark: SparkSession, d: str) -> DataFrame:
    from .quality import classify
    return classify(read_table(spark, d, "documents"), read_table(spark, d, "labels"), threshold=0.3)


@register("op4_substring_dedup")
def op4(spark: SparkSession, d: str) -> DataFrame:
    from .substring_dedup import substring_dedup
    return substring_dedup(read_table(spark, d, "documents"), length=50)


@register("op8_pii")
def op8(spark: SparkSession, d: str) -> DataFrame:
    from .pii import find_and_replace
    return find_and_replace(read_table(spark, d, "documents"), key=b"trove sample key")


@register("op9_lm_scoring")
def op9(spark: SparkSession, d: str) -> DataFrame:
    from .lm_scoring import is_good, lm_scores
    return lm_scores(read_table(spark, d, "documents"), is_good(read_table(spark, d, "labels")), order=4)


@register("op11_warc")
def op11(spark: SparkSession, d: str) -> DataFrame:
    from ..session import scratch_path
    from .warc import read_records, write_archives
    folder = scratch_path(spark, "warc-archives")
    index = write_archives(read_table(spark, d, "pages"), folder, min_bytes=100)
    return read_records(spark, index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op11_warc"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) > 1 AS again,
         min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM f
"""


@register("op12_lexical_search")
def op12(spark: SparkSession, d: str) -> DataFrame:
    from .lexical_search import lexical_search
    return lexical_search(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), k=10)


SQL["op12_lexical_search"] = r"""
WITH dt AS (
  SELECT doc_id, row_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row_id FROM documents)),
tf AS (SELECT row_id, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT row_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM dl),
it AS (
  SELECT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM it GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM tf, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (
  SELECT q.item_id, tf.row_id, tf.doc_id,
         sum(q.times * w.weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + (75 * dl.n * c.docs) // c.tokens))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN dl USING (row_id), c
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def _with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change of every tenth document: its words from a on
    repeat with period p."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@register("op13_periodic_runs")
def op13(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .periodic_runs import find_runs
    found = find_runs(read_table(spark, d, "documents"), min_length=24, min_repeats=3, rewrite=_with_planted_period)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    s = F.col("strongest")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), s["start"].alias("start"), s["length"].alias("length"),
                        s["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
                        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
