"""Registered queries of tables that change in place, of stored indexes and of
fuzzy titles, each next to its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .ingest_queries import (CAT_LINES_SQL, NEW_ID_BASE, UPDATE_COLS, _item_source, _prep_sql, catalogue_lines, patch_lines)
from .operators import fuzzy as FZ
from .operators.bitmaps import BitmapIndex
from .operators.keyed_table import KeyedTable, cascade
from .operators.keyword import keyword_matches
from .operators.postings import PostingIndex
from .oracle import SQL, q, sqdist
from .registry import list_str, register
from .session import scratch_path, shuffles_dropped, write_scratch
from .sources import fixtures as fx
from .sources import jsonl as J

# ------------------------------------------------------------ fuzzy titles


def misspelt_titles(spark, d):
    """Query set: the titles of every twentieth item in capitals, with one
    character left out and one put at the end."""
    i = fx.items(spark, d).where(F.col("item_id") % 20 == 0).where(F.length("title") > 0)
    at = (F.col("item_id") % F.length("title")).cast("int")
    text = F.concat(F.substring(F.col("title"), F.lit(1), at), F.substring(F.col("title"), at + 2, F.length("title")), F.lit("~"))
    return i.select(F.col("item_id").alias("query_id"), F.upper(text).alias("text"))


@register("fuzzy_title_match")
def q_fuzzy_title_match(spark, d):
    return FZ.fuzzy_title_match(misspelt_titles(spark, d), fx.items(spark, d).select("item_id", "title"), max_edits=2)


# DuckDB's levenshtein counts bytes: every other letter of the titles becomes one capital, which lower-case titles lack.
_ONE_BYTE = "translate({0}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
SQL["fuzzy_title_match"] = q(f"""
asked AS (
  SELECT lower(upper(left(title, CAST(item_id % length(title) AS INTEGER)) || substr(title, CAST(item_id % length(title) AS INTEGER) + 2) || '~')) AS text,
         min(item_id) AS query_id, count(*) AS n_queries
  FROM items WHERE item_id % 20 = 0 AND length(title) > 0 GROUP BY 1),
titles AS (SELECT lower(title) AS title, min(item_id) AS title_id, count(*) AS n_items FROM items WHERE title IS NOT NULL GROUP BY 1),
near AS (
  SELECT *, CAST(levenshtein({_ONE_BYTE.format('text')}, {_ONE_BYTE.format('title')}) AS INTEGER) AS distance
  FROM asked JOIN titles ON abs(length(text) - length(title)) <= 2)
SELECT query_id, n_queries, title_id, n_items, distance FROM near WHERE distance <= 2""")


@register("fuzzy_title_classes")
def q_fuzzy_title_classes(spark, d):
    return FZ.title_classes(fx.items(spark, d))


SQL["fuzzy_title_classes"] = q("""
x AS (SELECT 1)
SELECT item_id, min(item_id) OVER (PARTITION BY lower(title)) AS title_id FROM items WHERE title IS NOT NULL""")


# ------------------------------------------------------------ keyed tables

BUCKETS = 16


def _item_table(spark, d) -> KeyedTable:
    return KeyedTable.create(spark, scratch_path(spark, "items-table"), fx.items(spark, d), "item_id", BUCKETS)


def _item_report(df):
    return df.select("item_id", "title", "score", "cover_url", F.coalesce(F.size("platforms"), F.lit(-1)).alias("n_platforms"))


@register("table_upsert")
def q_table_upsert(spark, d):
    """``upsert_items`` on a stored table: one change, then only the touched
    buckets are written again."""
    t = _item_table(spark, d)
    t.append(_item_source(spark, d).select("item_id", *UPDATE_COLS), UPDATE_COLS)
    t.compact(range(BUCKETS))
    return _item_report(t.read())


SQL["table_upsert"] = SQL["upsert_items"]


@register("table_changes")
def q_table_changes(spark, d):
    """Four changes read through their deltas: an upsert, an asset patch of
    one column, a delete, and an upsert that brings some deleted keys back."""
    t = _item_table(spark, d)
    t.append(_item_source(spark, d).select("item_id", *UPDATE_COLS), UPDATE_COLS)
    patch = J.read_asset_patch_jsonl(patch_lines(spark, d))
    t.append(patch.select("item_id", "cover_url"), ["cover_url"])
    gone = fx.items(spark, d).where(F.col("item_id") % 7 == 0).select("item_id")
    t.append(gone, delete=True)
    t.append(gone.where(F.col("item_id") % 2 == 0).select("item_id", F.lit("back").alias("title")), ["title"])
    return _item_report(t.read())


SQL["table_changes"] = q(f"""
src AS (
  SELECT i.item_id, 'v2 ' || i.title AS title, i.score + 0.5 AS score, i.platforms FROM items i
  WHERE i.item_id IN (SELECT doc_id FROM labels)
  UNION ALL
  SELECT item_id + {NEW_ID_BASE}, split_part(text, chr(10), 1), NULL, NULL FROM benchmark),
one AS (
  SELECT coalesce(i.item_id, s.item_id) AS item_id, CASE WHEN s.item_id IS NOT NULL THEN s.title ELSE i.title END AS title,
         CASE WHEN s.item_id IS NOT NULL THEN s.score ELSE i.score END AS score, i.cover_url,
         CAST(coalesce(len(CASE WHEN s.item_id IS NOT NULL THEN s.platforms ELSE i.platforms END), -1) AS INTEGER) AS n_platforms
  FROM items i FULL OUTER JOIN src s ON s.item_id = i.item_id),
covers AS (
  SELECT page_id AS item_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'https://cdn.example/' || CAST(doc_id AS VARCHAR) || '.jpg' FROM labels),
two AS (
  SELECT coalesce(o.item_id, c.item_id) AS item_id, o.title, o.score,
         CASE WHEN c.item_id IS NOT NULL THEN c.url ELSE o.cover_url END AS cover_url, coalesce(n_platforms, -1) AS n_platforms
  FROM one o FULL OUTER JOIN covers c ON c.item_id = o.item_id
  WHERE coalesce(c.item_id, 1) <> 0 OR o.item_id IS NOT NULL)
SELECT item_id, title, score, cover_url, n_platforms FROM two
WHERE item_id NOT IN (SELECT item_id FROM items WHERE item_id % 7 = 0)
UNION ALL
SELECT item_id, 'back', NULL, NULL, -1 FROM items WHERE item_id % 14 = 0""")


@register("table_cascade")
def q_table_cascade(spark, d):
    """Items and reviews as keyed tables: labelled items go, their reviews with them."""
    items = _item_table(spark, d)
    reviews = KeyedTable.create(spark, scratch_path(spark, "reviews-table"), fx.reviews(spark, d), "review_id", BUCKETS)
    cascade(items, reviews, fx.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")), "item_id")
    reviews.compact(range(BUCKETS))
    left = items.read().select(F.lit("item").alias("kind"), F.col("item_id").alias("id"))
    return left.unionByName(reviews.read().select(F.lit("review").alias("kind"), F.col("review_id").alias("id")))


SQL["table_cascade"] = q("""
x AS (SELECT 1)
SELECT 'item' AS kind, item_id AS id FROM items WHERE item_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'review', review_id FROM reviews WHERE item_id NOT IN (SELECT doc_id FROM labels)""")


@register("review_view_maintained")
def q_review_view_maintained(spark, d):
    """The view after edits, new reviews, reviews that move to another item and
    deletes, kept up to date by changes."""
    from .operators.review_view import ReviewView
    reviews = fx.reviews(spark, d)
    view = ReviewView.create(reviews, scratch_path(spark, "review-view"), BUCKETS)
    edits = reviews.where(F.col("review_id") % 3 == 0).select("review_id", F.when(F.col("review_id") % 2 == 0, F.col("item_id") + 1).otherwise(F.col("item_id")).alias("item_id"),
                                                              F.concat(F.lit("[edited] "), F.col("citation")).alias("citation"))
    new = fx.table(spark, d, "benchmark").select((F.col("item_id") + NEW_ID_BASE).alias("review_id"), "item_id", F.col("text").alias("citation"))
    view.apply(reviews, edits.unionByName(new), reviews.where(F.col("review_id") % 3 == 1).select("review_id"))
    out = view.items_with_reviews(fx.items(spark, d).select("item_id"))
    return out.select("item_id", "review_count", F.md5("reviews_concat").alias("concat_md5"), F.size("reviews_array").alias("n_array"))


SQL["review_view_maintained"] = q(f"""
after_change AS (
  SELECT review_id, CASE WHEN review_id % 3 = 0 AND review_id % 2 = 0 THEN item_id + 1 ELSE item_id END AS item_id,
         CASE WHEN review_id % 3 = 0 THEN '[edited] ' || citation ELSE citation END AS citation
  FROM reviews WHERE review_id % 3 <> 1
  UNION ALL SELECT item_id + {NEW_ID_BASE}, item_id, text FROM benchmark),
agg AS (
  SELECT item_id, count(*) AS n, nullif(string_agg(citation, ' | ' ORDER BY review_id), '') AS all_text FROM after_change GROUP BY item_id)
SELECT i.item_id, coalesce(a.n, 0) AS review_count, md5(a.all_text) AS concat_md5, CAST(coalesce(a.n, 0) AS INTEGER) AS n_array
FROM items i LEFT JOIN agg a ON a.item_id = i.item_id""")


@register("copy_differences")
def q_copy_differences(spark, d):
    """A copy of the items with some rows changed, left out and added."""
    from .operators.verify import copy_differences
    k = F.col("item_id")
    source = write_scratch(fx.items(spark, d).select("item_id", "title", "score", "cover_url"), "copy-source")    # both sides are read twice
    copy = source.where(k % 77 != 5).withColumn("title", F.when(k % 50 == 1, F.concat("title", F.lit("."))).otherwise(F.col("title"))) \
        .withColumn("score", F.when(k % 40 == 3, F.coalesce("score", F.lit(0.0)) + 1).otherwise(F.col("score")))
    added = fx.table(spark, d, "benchmark").select((F.col("item_id") + NEW_ID_BASE).alias("item_id"), F.lit("more").alias("title"),
                                                   F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("cover_url"))
    out = copy_differences(source, copy.unionByName(added), "item_id", ["title", "score", "cover_url"])
    return out.select("item_id", "status", list_str(F.col("columns")).alias("columns"))


SQL["copy_differences"] = q(f"""
x AS (SELECT 1)
SELECT item_id, 'missing' AS status, NULL AS columns FROM items WHERE item_id % 77 = 5
UNION ALL
SELECT item_id, 'changed', concat_ws(', ', CASE WHEN item_id % 50 = 1 AND title IS NOT NULL THEN 'title' END, CASE WHEN item_id % 40 = 3 THEN 'score' END)
FROM items WHERE item_id % 77 <> 5 AND ((item_id % 50 = 1 AND title IS NOT NULL) OR item_id % 40 = 3)
UNION ALL
SELECT item_id + {NEW_ID_BASE}, 'added', NULL FROM benchmark""")


# ------------------------------------------------------------ streaming


@register("stream_upsert")
def q_stream_upsert(spark, d):
    """The catalogue's lines arrive in two lots, each run until its files are
    used up (several epochs, one file each); a second stream brings new
    entries. The result is the table after all of them."""
    from .streaming.upsert import latest_version, stream_upsert
    at = scratch_path(spark, "stream")
    lines = catalogue_lines(spark, d)
    new = fx.table(spark, d, "benchmark").select(F.to_json(F.struct(
        (F.col("item_id") + NEW_ID_BASE).alias("id"), fx.first_line(F.col("text")).alias("title"))).alias("value"))
    first = F.col("line_no") % 3 == 0

    def arrive(rows, folder: str) -> None:
        with shuffles_dropped(spark):
            rows.select("value").write.mode("append").text(f"{at}/{folder}", compression="snappy")

    def run(folder: str) -> None:
        stream_upsert(spark, f"{at}/{folder}", f"{at}/items", checkpoint=f"{at}/checkpoint-{folder}",
                      quarantine_path=f"{at}/quarantine", max_files_per_trigger=4, buckets=BUCKETS,
                      keep_s=0).awaitTermination()              # nobody else has the table

    arrive(lines.where(first), "lines")
    run("lines")
    arrive(lines.where(~first), "lines")
    run("lines")
    arrive(new, "more")
    run("more")
    return latest_version(spark, f"{at}/items", ["title", "score", "cover_url", "platforms"]).select(
        "item_id", "title", "score", "cover_url", list_str(F.col("platforms")).alias("platforms"))


SQL["stream_upsert"] = q(CAT_LINES_SQL + "," + _prep_sql() + f"""
SELECT item_id, title, score, cover_url, array_to_string(platforms, ', ') AS platforms FROM prep
UNION ALL
SELECT item_id + {NEW_ID_BASE}, trim(split_part(text, chr(10), 1), ' ' || chr(9) || chr(10) || chr(13)), NULL, NULL, '' FROM benchmark""")


# ------------------------------------------------------------ stored indexes


@register("keyword_index_search")
def q_keyword_index_search(spark, d):
    """One index, made from the items with even ids and extended by the others,
    answers two query sets: the passages, and the first three words of each."""
    items = fx.item_texts(spark, d)
    index = PostingIndex(spark, scratch_path(spark, "posting-index"))
    index.add(items.where(F.col("item_id") % 2 == 0)).add(items.where(F.col("item_id") % 2 != 0))
    passages = fx.keyword_queries(spark, d)
    words = passages.select("query_id", F.substring_index("text", " ", 3).alias("text"))
    first = keyword_matches(items, passages, ["item_id"], index=index).withColumn("query_set", F.lit("passages"))
    return first.unionByName(keyword_matches(items, words, ["item_id"], index=index).withColumn("query_set", F.lit("words")))


SQL["keyword_index_search"] = q("""
asked AS (
  SELECT 'passages' AS query_set, query_id, text FROM kw_queries
  UNION ALL SELECT 'words', query_id, array_to_string(string_split(text, ' ')[1:3], ' ') FROM kw_queries)
SELECT a.query_id, i.item_id, a.query_set FROM asked a JOIN items i
  ON trim(a.text) <> '' AND (contains(lower(i.title), lower(a.text)) OR contains(lower(i.description), lower(a.text)))""")


def filter_rows(spark, d):
    """A filter row per customer: its nation's name, a part's type, a least
    score and a least year, each set for some of them."""
    c = fx.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(fx.table(spark, d, "nation").select("n_nationkey", "n_name"))         # 25 rows by definition of the schema
    p = fx.table(spark, d, "part").select("p_partkey", "p_type")
    k = F.col("c_custkey")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(p, k == F.col("p_partkey"), "left")
    return j.select(k.alias("query_id"), F.when(k % 2 == 0, F.col("n_name")).alias("platform"), F.when(k % 7 == 0, F.col("p_type")).alias("genre"),
                    F.when(k % 3 == 0, (k % 10).cast("double")).alias("min_score"), F.when(k % 5 != 0, (k % 7 + 1992).cast("int")).alias("min_year"),
                    (k % 4 == 0).alias("scored_only"),
                    F.when(k % 11 == 0, F.array(F.lit("FRANCE"), F.lit("CHINA"), F.col("n_name"))).alias("platforms_any"))


def _filter_index(spark, d) -> BitmapIndex:
    return BitmapIndex.build(fx.items(spark, d).select("item_id", "platforms", "genres", "score", "release_date"), scratch_path(spark, "bitmap-index"))


@register("filter_batch_counts")
def q_filter_batch_counts(spark, d):
    return _filter_index(spark, d).counts(filter_rows(spark, d))


@register("filter_batch_items")
def q_filter_batch_items(spark, d):
    return _filter_index(spark, d).matches(filter_rows(spark, d))


def _passes(f: str, i: str) -> str:
    """The filter row ``f`` on the item ``i``."""
    return f"""
  ({f}.platform IS NULL OR coalesce(list_contains({i}.platforms, {f}.platform), false))
  AND ({f}.genre IS NULL OR coalesce(list_contains({i}.genres, {f}.genre), false))
  AND (CASE WHEN {f}.min_score IS NULL THEN NOT {f}.scored_only OR {i}.score IS NOT NULL
       ELSE coalesce({i}.score >= {f}.min_score, false) OR (NOT {f}.scored_only AND {i}.score IS NULL) END)
  AND ({f}.min_year IS NULL OR coalesce(year({i}.release_date) >= {f}.min_year, false))"""


_FILTER_ROWS = """
asked AS (
  SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS platform,
         CASE WHEN c_custkey % 7 = 0 THEN p_type END AS genre, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 10 AS DOUBLE) END AS min_score,
         CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 7 + 1992 END AS min_year, c_custkey % 4 = 0 AS scored_only,
         CASE WHEN c_custkey % 11 = 0 THEN ['FRANCE', 'CHINA', n_name] END AS platforms_any
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON p_partkey = c_custkey),
it AS (SELECT item_id, platforms, genres, score, release_date FROM items),
hit AS (
  SELECT a.query_id, i.item_id FROM asked a JOIN it i ON """ + _passes("a", "i") + """
  AND (a.platforms_any IS NULL OR coalesce(list_has_any(i.platforms, a.platforms_any), false)))"""
SQL["filter_batch_counts"] = q(_FILTER_ROWS + """
SELECT a.query_id, count(h.item_id) AS matches FROM asked a LEFT JOIN hit h ON h.query_id = a.query_id GROUP BY a.query_id""")
SQL["filter_batch_items"] = q(_FILTER_ROWS + """
SELECT query_id, item_id FROM hit""")


@register("prefilter_hits")
def q_prefilter_hits(spark, d):
    """The 20 nearest descriptions of every vector query among the items that
    pass the query's own filters."""
    from .operators.knn import modality_corpus
    from .plans.search import filtered_hits, with_filter_columns
    k = F.col("query_id")
    asked = with_filter_columns(fx.vector_queries(spark, d)).select(
        "query_id", "embedding", F.when(k % 3 == 0, F.lit("FRANCE")).alias("platform"), "genre", F.when(k % 2 == 0, F.lit(5.0)).alias("min_score"),
        F.when(k % 5 == 0, F.lit(1995)).alias("min_year"), (k % 4 == 0).alias("scored_only"))
    hits = filtered_hits(asked, modality_corpus(fx.item_vectors(spark, d), "description"), fx.items(spark, d), asked, 20)
    return hits.select("query_id", "rank", "vec_id", "item_id", F.round("dist", 6).alias("dist"))


SQL["prefilter_hits"] = q(f"""
asked AS (
  SELECT query_id, embedding, CASE WHEN query_id % 3 = 0 THEN 'FRANCE' END AS platform, NULL::VARCHAR AS genre,
         CASE WHEN query_id % 2 = 0 THEN 5.0::DOUBLE END AS min_score, CASE WHEN query_id % 5 = 0 THEN 1995 END AS min_year,
         query_id % 4 = 0 AS scored_only FROM vec_queries),
pairs AS (
  SELECT a.query_id, v.vec_id, v.item_id, {{sqdist}} AS dist
  FROM asked a, item_vectors v JOIN items i ON i.item_id = v.item_id
  WHERE v.modality = 'description' AND {_passes('a', 'i')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, item_id, round(dist, 6) AS dist FROM ranked WHERE rank <= 20""".replace(
    "{sqdist}", sqdist("a.embedding", "v.embedding")))
