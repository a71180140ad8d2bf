"""Registered catalogue queries (filters, aggregates, shaping, cleaning), each
next to its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import clean as C
from .functions import filters as FL
from .functions import shape as S
from .functions.filters import Filters
from .operators import catalogue as CAT
from .oracle import SQL, q, semantic
from .plans import search as SE
from .registry import list_str, register, reviews_str
from .sources import fixtures as fx

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _items(spark, d) -> DataFrame:
    return fx.items(spark, d)


def _iwr(spark, d) -> DataFrame:
    return CAT.items_with_reviews(fx.items(spark, d), fx.reviews(spark, d))


# ------------------------------------------------------------- aggregates

@register("items_with_reviews")
def q_items_with_reviews(spark, d):
    v = _iwr(spark, d)
    return v.select("item_id", "title", S.date_str(F.col("release_date")).alias("release_date"), "score",
                    list_str(F.col("platforms")).alias("platforms"), "review_count", "reviews_concat",
                    F.size("reviews_array").alias("n_reviews"))


SQL["items_with_reviews"] = q("""
x AS (SELECT 1)
SELECT i.item_id, i.title, strftime(i.release_date, '%Y-%m-%d') AS release_date, i.score,
       array_to_string(i.platforms, ', ') AS platforms, CAST(coalesce(ra.review_count, 0) AS BIGINT) AS review_count,
       ra.reviews_concat, CAST(coalesce(len(ra.reviews_array), 0) AS INTEGER) AS n_reviews
FROM items i LEFT JOIN rev_agg ra ON ra.item_id = i.item_id""")


@register("items_left_join_reviews")
def q_items_left_join_reviews(spark, d):
    j = fx.items(spark, d).select("item_id", "title").join(fx.reviews(spark, d), "item_id", "left")
    return j.select("item_id", "title", F.col("review_id").cast("string").alias("review_id"))


SQL["items_left_join_reviews"] = q("""
x AS (SELECT 1)
SELECT i.item_id, i.title, CAST(r.review_id AS VARCHAR) AS review_id
FROM items i LEFT JOIN reviews r ON r.item_id = i.item_id""")


@register("review_count")
def q_review_count(spark, d):
    return _iwr(spark, d).select("item_id", "review_count")


SQL["review_count"] = q("""
x AS (SELECT 1)
SELECT i.item_id, CAST(coalesce(ra.review_count, 0) AS BIGINT) AS review_count
FROM items i LEFT JOIN rev_agg ra ON ra.item_id = i.item_id""")


@register("reviews_concat")
def q_reviews_concat(spark, d):
    return _iwr(spark, d).select("item_id", "reviews_concat")


SQL["reviews_concat"] = q("""
x AS (SELECT 1)
SELECT i.item_id, ra.reviews_concat FROM items i LEFT JOIN rev_agg ra ON ra.item_id = i.item_id""")


@register("reviews_array")
def q_reviews_array(spark, d):
    v = _iwr(spark, d)
    return v.select("item_id", F.size("reviews_array").alias("n"),
                    F.array_join("reviews_array", " || ").alias("reviews"))


SQL["reviews_array"] = q("""
x AS (SELECT 1)
SELECT i.item_id, CAST(coalesce(len(ra.reviews_array), 0) AS INTEGER) AS n,
       array_to_string(coalesce(ra.reviews_array, []::VARCHAR[]), ' || ') AS reviews
FROM items i LEFT JOIN rev_agg ra ON ra.item_id = i.item_id""")


@register("facet_platforms")
def q_facet_platforms(spark, d):
    return CAT.facet_values(_items(spark, d), "platforms", "platform")


SQL["facet_platforms"] = q("""
x AS (SELECT 1)
SELECT DISTINCT unnest(platforms) AS platform FROM items WHERE platforms IS NOT NULL""")


@register("facet_genres")
def q_facet_genres(spark, d):
    return CAT.facet_values(_items(spark, d), "genres", "genre")


SQL["facet_genres"] = q("""
x AS (SELECT 1)
SELECT DISTINCT g AS genre FROM (SELECT unnest(genres) AS g FROM items WHERE genres IS NOT NULL) WHERE g IS NOT NULL""")


@register("facet_choices")
def q_facet_choices(spark, d):
    return CAT.facet_choices(_items(spark, d), "genres", "genre")


SQL["facet_choices"] = q("""
f AS (SELECT DISTINCT g AS genre FROM (SELECT unnest(genres) AS g FROM items WHERE genres IS NOT NULL) WHERE g IS NOT NULL),
u AS (SELECT 'All' AS genre, 0 AS k UNION ALL SELECT genre, 1 AS k FROM f)
SELECT CAST(row_number() OVER (ORDER BY k, genre) - 1 AS INTEGER) AS pos, genre FROM u""")


@register("distinct_values")
def q_distinct_values(spark, d):
    return CAT.facet_values(_items(spark, d), "developers", "developer")


SQL["distinct_values"] = q("""
x AS (SELECT 1)
SELECT DISTINCT unnest(developers) AS developer FROM items WHERE developers IS NOT NULL""")


@register("score_year_ranges")
def q_score_year_ranges(spark, d):
    return CAT.score_year_ranges(_items(spark, d))


SQL["score_year_ranges"] = q("""
x AS (SELECT 1)
SELECT min(score) AS min_score, max(score) AS max_score, CAST(min(year(release_date)) AS INTEGER) AS min_year,
       CAST(max(year(release_date)) AS INTEGER) AS max_year FROM items""")


@register("review_coverage")
def q_review_coverage(spark, d):
    return CAT.review_coverage(fx.items(spark, d), fx.reviews(spark, d))


SQL["review_coverage"] = q("""
x AS (SELECT 1)
SELECT CAST(count_if(coalesce(len(ra.reviews_array), 0) > 0) AS BIGINT) AS items_with_reviews,
       CAST(sum(coalesce(len(ra.reviews_array), 0)) AS BIGINT) AS total_reviews
FROM items i LEFT JOIN rev_agg ra ON ra.item_id = i.item_id""")


@register("asset_coverage")
def q_asset_coverage(spark, d):
    i = _items(spark, d)
    return i.agg(F.count_if(F.col("cover_url").isNotNull()).cast("bigint").alias("with_cover"),
                 F.count_if(F.coalesce(F.size("screenshot_urls"), F.lit(0)) > 0).cast("bigint").alias("with_screenshots"),
                 F.count(F.lit(1)).cast("bigint").alias("items"))


SQL["asset_coverage"] = q("""
x AS (SELECT 1)
SELECT CAST(count_if(cover_url IS NOT NULL) AS BIGINT) AS with_cover,
       CAST(count_if(coalesce(len(screenshot_urls), 0) > 0) AS BIGINT) AS with_screenshots,
       CAST(count(*) AS BIGINT) AS items FROM items""")


# ---------------------------------------------------------------- filters

@register("filter_platform")
def q_filter_platform(spark, d):
    return _items(spark, d).where(FL.filter_platform(F.col("platforms"), "NATION_7")).select("item_id", "title")


SQL["filter_platform"] = q("""
x AS (SELECT 1)
SELECT item_id, title FROM items WHERE list_contains(platforms, 'NATION_7')""")


@register("filter_genre")
def q_filter_genre(spark, d):
    return _items(spark, d).where(FL.filter_genre(F.col("genres"), "PROMO")).select("item_id", "title")


SQL["filter_genre"] = q("""
x AS (SELECT 1)
SELECT item_id, title FROM items WHERE list_contains(genres, 'PROMO')""")


@register("filter_any_of_lists")
def q_filter_any_of_lists(spark, d):
    f = Filters(genres_any=("widget", "gizmo"), platforms_any=("NATION_1", "NATION_2"), min_score=4.0, min_year=1996)
    return _items(spark, d).where(f.predicate()).select("item_id", "title", "score")


SQL["filter_any_of_lists"] = q("""
x AS (SELECT 1)
SELECT item_id, title, score FROM items
WHERE (score >= 4.0 OR score IS NULL) AND release_date >= DATE '1996-01-01'
  AND len(list_intersect(genres, ['widget', 'gizmo'])) > 0
  AND len(list_intersect(platforms, ['NATION_1', 'NATION_2'])) > 0""")


@register("filter_min_score")
def q_filter_min_score(spark, d):
    i = _items(spark, d)
    return i.select("item_id", "score",
                    FL.filter_min_score(F.col("score"), 6.0, False).alias("with_unscored"),
                    FL.filter_min_score(F.col("score"), 6.0, True).alias("scored_only"),
                    FL.filter_min_score(F.col("score"), None, True).alias("any_scored"))


SQL["filter_min_score"] = q("""
x AS (SELECT 1)
SELECT item_id, score, coalesce(score >= 6.0, false) OR score IS NULL AS with_unscored,
       coalesce(score >= 6.0, false) AS scored_only, score IS NOT NULL AS any_scored FROM items""")


@register("filter_min_year")
def q_filter_min_year(spark, d):
    return _items(spark, d).where(FL.filter_min_year(F.col("release_date"), 1998)) \
        .select("item_id", S.date_str(F.col("release_date")).alias("release_date"))


SQL["filter_min_year"] = q("""
x AS (SELECT 1)
SELECT item_id, strftime(release_date, '%Y-%m-%d') AS release_date FROM items WHERE year(release_date) >= 1998""")


@register("filter_id_set")
def q_filter_id_set(spark, d):
    ids = fx.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    return _items(spark, d).join(ids, "item_id", "left_semi").select("item_id", "title")


SQL["filter_id_set"] = q("""
x AS (SELECT 1)
SELECT item_id, title FROM items WHERE item_id IN (SELECT doc_id FROM labels)""")


@register("filter_keyword")
def q_filter_keyword(spark, d):
    from .operators.keyword import keyword_matches
    m = keyword_matches(_items(spark, d), fx.keyword_queries(spark, d), ["item_id"], wildcards=True)
    return m.select("query_id", "item_id")


SQL["filter_keyword"] = q("""
x AS (SELECT 1)
SELECT q.query_id, i.item_id FROM kw_queries q JOIN items i
  ON lower(i.title) LIKE '%' || lower(q.text) || '%' OR lower(i.description) LIKE '%' || lower(q.text) || '%'""")

COMPOSE = Filters(min_score=3.0, min_year=1995, genre="small")


@register("compose_filters")
def q_compose_filters(spark, d):
    res = SE.keyword_search(_items(spark, d), fx.reviews(spark, d), fx.keyword_queries(spark, d),
                            filters=COMPOSE, with_reviews=False)
    return res.select("query_id", "rank", "item_id", "score")


SQL["compose_filters"] = q("""
m AS (
  SELECT q.query_id, i.* FROM kw_queries q JOIN items i
    ON (contains(lower(i.title), lower(q.text)) OR contains(lower(i.description), lower(q.text)))
  WHERE (i.score >= 3.0 OR i.score IS NULL) AND list_contains(i.genres, 'small') AND year(i.release_date) >= 1995),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, item_id) AS rank FROM m)
SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM r WHERE rank <= 20""")


@register("filter_not_null_asset")
def q_filter_not_null_asset(spark, d):
    i = _items(spark, d)
    return i.where(FL.filter_not_null(F.col("cover_url")) & FL.filter_not_null(F.col("score"))) \
            .select("item_id", "cover_url", "score")


SQL["filter_not_null_asset"] = q("""
x AS (SELECT 1)
SELECT item_id, cover_url, score FROM items WHERE cover_url IS NOT NULL AND score IS NOT NULL""")


# ------------------------------------------------------- sort, limit, rank

@register("top_by_score")
def q_top_by_score(spark, d):
    return CAT.top_by_score(_items(spark, d), 20).select("item_id", "title", "score")


SQL["top_by_score"] = q("""
x AS (SELECT 1)
SELECT item_id, title, score FROM items ORDER BY score DESC NULLS LAST, item_id LIMIT 20""")


def _by_values(spark, d, column: str, alias: str):
    res = SE.search_by_values(_items(spark, d), None, column)
    return res.select(F.col("value").alias(alias), "rank", "item_id", "score")


@register("search_by_genre")
def q_search_by_genre(spark, d):
    return _by_values(spark, d, "genres", "genre")


SQL["search_by_genre"] = q("""
ex AS (SELECT DISTINCT item_id, score, unnest(genres) AS value FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC NULLS LAST, item_id) AS rank FROM ex
      WHERE value IS NOT NULL)
SELECT value AS genre, CAST(rank AS INTEGER) AS rank, item_id, score FROM r WHERE rank <= 20""")


@register("search_by_platform")
def q_search_by_platform(spark, d):
    return _by_values(spark, d, "platforms", "platform")


SQL["search_by_platform"] = q("""
ex AS (SELECT DISTINCT item_id, score, unnest(platforms) AS value FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC NULLS LAST, item_id) AS rank FROM ex
      WHERE value IS NOT NULL)
SELECT value AS platform, CAST(rank AS INTEGER) AS rank, item_id, score FROM r WHERE rank <= 20""")


def _id_sets(spark, d) -> DataFrame:
    """Id sets per query: the items each embedding label points at."""
    e = fx.table(spark, d, "embeddings")
    iv = fx.item_vectors(spark, d)
    return iv.join(e.select(F.col("vec_id").cast("string").alias("vec_id"), "label"), "vec_id") \
             .select(F.col("label").cast("bigint").alias("query_id"), "item_id")


@register("fetch_by_ids")
def q_fetch_by_ids(spark, d):
    res = SE.fetch_by_ids(_items(spark, d), fx.reviews(spark, d), _id_sets(spark, d), filters=Filters(min_score=4.0))
    return res.select("query_id", "rank", "item_id", "score", "review_count")


FETCH_SQL = """
ids AS (SELECT DISTINCT CAST(e.label AS BIGINT) AS query_id, v.item_id FROM item_vectors v
        JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = v.vec_id),
hits AS (SELECT ids.query_id, i.* FROM ids JOIN items i ON i.item_id = ids.item_id {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, item_id) AS rank FROM hits)
"""
SQL["fetch_by_ids"] = q(FETCH_SQL.format(where="WHERE i.score >= 4.0 OR i.score IS NULL") + """
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.item_id, r.score,
       CAST(coalesce(ra.review_count, 0) AS BIGINT) AS review_count
FROM r LEFT JOIN rev_agg ra ON ra.item_id = r.item_id""")


@register("rank_results")
def q_rank_results(spark, d):
    res = SE.fetch_by_ids(_items(spark, d), fx.reviews(spark, d), _id_sets(spark, d), with_reviews=False)
    return res.select("query_id", "rank", "item_id")


SQL["rank_results"] = q(FETCH_SQL.format(where="") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id FROM r""")


@register("point_lookup")
def q_point_lookup(spark, d):
    ids = fx.item_vectors(spark, d).select("item_id").distinct()
    return CAT.point_lookup_cover(_items(spark, d), ids)


SQL["point_lookup"] = q("""
ids AS (SELECT DISTINCT item_id FROM item_vectors)
SELECT ids.item_id, CASE WHEN regexp_matches(i.cover_url, '^https?://') THEN i.cover_url END AS cover_url
FROM ids LEFT JOIN items i ON i.item_id = ids.item_id""")


@register("latest_by_key")
def q_latest_by_key(spark, d):
    c = fx.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("s")) \
            .select("conv_id", "s.turn", "s.role", "s.text")


SQL["latest_by_key"] = q("""
x AS (SELECT 1)
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")


# ---------------------------------------------------------------- shaping

@register("project_result")
def q_project_result(spark, d):
    p = CAT.project_result(_items(spark, d))
    return p.select("item_id", "title", "release_date", "score", list_str(F.col("platforms")).alias("platforms"),
                    list_str(F.col("genres")).alias("genres"), list_str(F.col("developers")).alias("developers"),
                    list_str(F.col("publishers")).alias("publishers"), "cover_url",
                    list_str(F.col("screenshot_urls")).alias("screenshot_urls"))


SQL["project_result"] = q("""
x AS (SELECT 1)
SELECT item_id, title, strftime(release_date, '%Y-%m-%d') AS release_date, score,
       array_to_string(platforms, ', ') AS platforms, array_to_string(genres, ', ') AS genres,
       array_to_string(developers, ', ') AS developers, array_to_string(publishers, ', ') AS publishers,
       cover_url, array_to_string(screenshot_urls, ', ') AS screenshot_urls FROM items""")


@register("explode_reviews")
def q_explode_reviews(spark, d):
    # Long form: positions come from a distributed row number, so no item's
    # reviews are gathered into one task; only reviews of catalogue items.
    revs = fx.reviews(spark, d).join(_items(spark, d).select("item_id"), "item_id", "left_semi")
    return CAT.explode_reviews(revs)


SQL["explode_reviews"] = q(f"""
objs AS (
  SELECT ra.item_id, unnest(list_filter(list_transform(ra.reviews_array,
           lambda x, i: {{'source': 'Critic ' || CAST(i AS VARCHAR), 'review': trim(x, {WS})}}),
           lambda s: s.review IS NOT NULL AND s.review <> '')) AS o
  FROM rev_agg ra JOIN items i ON i.item_id = ra.item_id)
SELECT item_id, o.source AS source, '' AS score, o.review AS review FROM objs""")


@register("release_year")
def q_release_year(spark, d):
    i = _items(spark, d)
    iso = S.date_str(F.col("release_date"))
    us = F.date_format("release_date", "M/d/yyyy")
    yr = F.date_format("release_date", "yyyy")
    return i.select("item_id", S.release_year(iso).alias("from_iso"), S.release_year(us).alias("from_slash"),
                    S.release_year(yr).alias("from_year"), S.release_year(F.lit(None).cast("string")).alias("from_null"))


SQL["release_year"] = q("""
x AS (SELECT 1)
SELECT item_id, split_part(strftime(release_date, '%Y-%m-%d'), '-', 1) AS from_iso,
       split_part(strftime(release_date, '%-m/%-d/%Y'), '/', 3) AS from_slash,
       substring(strftime(release_date, '%Y'), 1, 4) AS from_year, 'Unknown' AS from_null FROM items""")


@register("score_band")
def q_score_band(spark, d):
    return _items(spark, d).select("item_id", "score", S.score_band(F.col("score")).alias("band"))


SQL["score_band"] = q("""
x AS (SELECT 1)
SELECT item_id, score, CASE WHEN score IS NULL OR score <= 0 THEN NULL WHEN score >= 8 THEN 'high'
                            WHEN score >= 6 THEN 'medium' ELSE 'low' END AS band FROM items""")


def _trunc_sql(col: str, n: int) -> str:
    return (f"CASE WHEN length(coalesce({col}, '')) > {n} THEN substring({col}, 1, {n}) || '...' "
            f"ELSE coalesce({col}, '') END")


@register("truncate_text")
def q_truncate_text(spark, d):
    i = _items(spark, d)
    return i.select("item_id", S.truncate_text(F.col("description"), 300).alias("cut_300"),
                    S.truncate_text(F.col("description"), 200).alias("cut_200"),
                    S.truncate_text(F.col("description"), 150).alias("cut_150"))


SQL["truncate_text"] = q(f"""
x AS (SELECT 1)
SELECT item_id, {_trunc_sql('description', 300)} AS cut_300, {_trunc_sql('description', 200)} AS cut_200,
       {_trunc_sql('description', 150)} AS cut_150 FROM items""")


def _jld_sql(col: str) -> str:
    return f"CASE WHEN coalesce(len({col}), -1) > 0 THEN array_to_string({col}, ', ') ELSE 'Unknown' END"


@register("join_list_default")
def q_join_list_default(spark, d):
    i = _items(spark, d)
    return i.select("item_id", S.join_list_default(F.col("platforms")).alias("platforms"),
                    S.join_list_default(F.col("genres")).alias("genres"),
                    S.join_list_default(F.col("screenshot_urls")).alias("screenshots"))


SQL["join_list_default"] = q(f"""
x AS (SELECT 1)
SELECT item_id, {_jld_sql('platforms')} AS platforms, {_jld_sql('genres')} AS genres,
       {_jld_sql('screenshot_urls')} AS screenshots FROM items""")


@register("slice_assets")
def q_slice_assets(spark, d):
    i = _items(spark, d)
    return i.select("item_id", list_str(S.slice_assets(F.col("platforms"), 3)).alias("platforms3"),
                    list_str(S.slice_assets(F.col("screenshot_urls"), 5)).alias("screens5"),
                    list_str(S.slice_assets(F.col("genres"), 10)).alias("genres10"))


SQL["slice_assets"] = q("""
x AS (SELECT 1)
SELECT item_id, array_to_string(coalesce(platforms, []::VARCHAR[])[1:3], ', ') AS platforms3,
       array_to_string(coalesce(screenshot_urls, []::VARCHAR[])[1:5], ', ') AS screens5,
       array_to_string(coalesce(genres, []::VARCHAR[])[1:10], ', ') AS genres10 FROM items""")


@register("result_card")
def q_result_card(spark, d):
    i = _items(spark, d)
    bad_id = F.col("item_id").isNull() | (F.col("item_id") == 0)
    return i.select(
        "item_id", F.coalesce("title", F.lit("Unknown Title")).alias("title"),
        S.release_year(S.date_str(F.col("release_date"))).alias("year"),
        S.join_list_default(F.col("platforms")).alias("platforms"),
        S.join_list_default(F.col("genres")).alias("genres"),
        F.coalesce(F.col("score").cast("string"), F.lit(S.NOT_AVAILABLE)).alias("score"),
        S.truncate_text(F.col("description"), S.DESC_CUT_CARD).alias("short_description"),
        F.coalesce("cover_url", F.lit("")).alias("cover_url"),
        F.size(F.coalesce(F.col("screenshot_urls"), F.array().cast("array<string>"))).alias("n_screenshots"),
        F.when(bad_id, F.lit("Game ID is missing or invalid")).alias("error"))


SQL["result_card"] = q(f"""
x AS (SELECT 1)
SELECT item_id, coalesce(title, 'Unknown Title') AS title, split_part(strftime(release_date, '%Y-%m-%d'), '-', 1) AS year,
       {_jld_sql('platforms')} AS platforms, {_jld_sql('genres')} AS genres,
       coalesce(CAST(score AS VARCHAR), 'N/A') AS score, {_trunc_sql('description', 200)} AS short_description,
       coalesce(cover_url, '') AS cover_url, CAST(coalesce(len(screenshot_urls), 0) AS INTEGER) AS n_screenshots,
       CASE WHEN item_id IS NULL OR item_id = 0 THEN 'Game ID is missing or invalid' END AS error FROM items""")


@register("result_detail")
def q_result_detail(spark, d):
    first = CAT.first_reviews(fx.reviews(spark, d), S.REVIEWS_DETAIL)
    v = _items(spark, d).join(first, "item_id", "left")
    revs = F.coalesce(F.col("reviews"), F.array().cast(first.schema["reviews"].dataType))
    return v.select(
        "item_id", F.substring(S.date_str(F.col("release_date")), 1, 4).alias("year"),
        S.join_list_default(F.col("platforms")).alias("platforms"),
        S.join_list_default(F.col("developers")).alias("developers"),
        S.join_list_default(F.col("publishers")).alias("publishers"),
        list_str(S.slice_assets(F.col("screenshot_urls"), S.SCREENSHOTS_DETAIL)).alias("screenshots"),
        reviews_str(revs).alias("reviews"))


SQL["result_detail"] = q(f"""
x AS (SELECT 1)
SELECT i.item_id, substring(strftime(i.release_date, '%Y-%m-%d'), 1, 4) AS year,
       {_jld_sql('i.platforms')} AS platforms, {_jld_sql('i.developers')} AS developers,
       {_jld_sql('i.publishers')} AS publishers,
       array_to_string(coalesce(i.screenshot_urls, []::VARCHAR[])[1:5], ', ') AS screenshots,
       array_to_string(list_transform(list_filter(list_transform(coalesce(ra.reviews_array, []::VARCHAR[]),
           lambda x, i: {{'source': 'Critic ' || CAST(i AS VARCHAR), 'review': trim(x, {WS})}}),
           lambda s: s.review IS NOT NULL AND s.review <> '')[1:3], lambda s: s.source || ': ' || s.review), ' | ') AS reviews
FROM items i LEFT JOIN rev_agg ra ON ra.item_id = i.item_id""")


# --------------------------------------------------------------- cleaning

@register("strip_html")
def q_strip_html(spark, d):
    p = fx.table(spark, d, "pages")
    return p.select("page_id", C.strip_html(F.col("html")).alias("text"))


SQL["strip_html"] = q(r"""
x AS (SELECT 1)
SELECT page_id, coalesce(regexp_replace(regexp_replace(html, '<[^\n]*?>', '', 'g'),
                                        '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '') AS text FROM pages""")


@register("safe_float")
def q_safe_float(spark, d):
    e = fx.table(spark, d, "events")
    raw = F.get_json_object(F.col("props"), "$.k")
    return e.select("event_id", C.safe_float(raw).alias("k"), C.safe_float(F.col("event_type")).alias("from_type"),
                    C.safe_float(F.lit("")).alias("from_blank"), C.safe_float(F.col("value").cast("string")).alias("v"))


SQL["safe_float"] = q("""
x AS (SELECT 1)
SELECT event_id, TRY_CAST(nullif(trim(CAST(json_extract(props, '$.k') AS VARCHAR)), '') AS DOUBLE) AS k,
       TRY_CAST(nullif(trim(event_type), '') AS DOUBLE) AS from_type, CAST(NULL AS DOUBLE) AS from_blank,
       value AS v FROM events""")


@register("parse_date_multi")
def q_parse_date_multi(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt"),
                                            "o_orderpriority")
    forms = {"iso": "yyyy-MM-dd", "year": "yyyy", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy"}
    cols = [S.date_str(C.parse_date_multi(F.date_format("dt", f))).alias(k) for k, f in forms.items()]
    return o.select("o_orderkey", *cols, S.date_str(C.parse_date_multi(F.col("o_orderpriority"))).alias("junk"))


def _pdm(expr: str) -> str:
    return ("strftime(coalesce(try_strptime(trim({e}), '%Y-%m-%d'), try_strptime(trim({e}), '%Y'), "
            "try_strptime(trim({e}), '%m/%d/%Y'), try_strptime(trim({e}), '%d/%m/%Y')), '%Y-%m-%d')").format(e=expr)


SQL["parse_date_multi"] = q(f"""
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt, o_orderpriority FROM orders)
SELECT o_orderkey, {_pdm("strftime(dt, '%Y-%m-%d')")} AS iso, {_pdm("strftime(dt, '%Y')")} AS year,
       {_pdm("strftime(dt, '%m/%d/%Y')")} AS us, {_pdm("strftime(dt, '%d/%m/%Y')")} AS eu,
       {_pdm('o_orderpriority')} AS junk FROM o""")


@register("trim_default")
def q_trim_default(spark, d):
    i = _items(spark, d)
    return i.select("item_id", C.trim_default(F.col("cover_url")).alias("url"),
                    C.trim_default(F.concat(F.lit("  "), F.col("title"), F.lit("\t"))).alias("title"))


SQL["trim_default"] = q(f"""
x AS (SELECT 1)
SELECT item_id, trim(coalesce(cover_url, ''), {WS}) AS url, trim('  ' || title || chr(9), {WS}) AS title FROM items""")


@register("require_fields")
def q_require_fields(spark, d):
    r = fx.reviews(spark, d).withColumn("citation", C.strip_html(F.col("citation")))
    ok = C.truthy_id(F.col("review_id")) & C.truthy_id(F.col("item_id")) & (F.col("citation") != "")
    return r.where(ok).select("review_id", "item_id", F.length("citation").alias("citation_chars"))


SQL["require_fields"] = q(r"""
c AS (SELECT review_id, item_id, coalesce(regexp_replace(regexp_replace(citation, '<[^\n]*?>', '', 'g'),
                                        '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '') AS citation FROM reviews)
SELECT review_id, item_id, CAST(length(citation) AS INTEGER) AS citation_chars FROM c
WHERE review_id IS NOT NULL AND review_id <> 0 AND item_id IS NOT NULL AND item_id <> 0 AND citation <> ''""")


@register("prefer_local_asset")
def q_prefer_local_asset(spark, d):
    i = _items(spark, d)
    labels = fx.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.lit(True).alias("local"))
    j = i.join(labels, "item_id", "left")
    local_cover = F.when(F.col("local"), F.concat(F.lit("assets/"), F.col("item_id").cast("string"), F.lit("/cover.jpg")))
    local_shots = F.when(F.col("local"), F.array(F.concat(F.lit("assets/"), F.col("item_id").cast("string"),
                                                          F.lit("/screenshot_1.jpg"))))
    return j.select("item_id", C.prefer_local(local_cover, F.col("cover_url")).alias("cover"),
                    list_str(C.prefer_local_list(local_shots, F.col("screenshot_urls"))).alias("screenshots"))


SQL["prefer_local_asset"] = q("""
j AS (SELECT i.*, lb.doc_id IS NOT NULL AS local FROM items i LEFT JOIN labels lb ON lb.doc_id = i.item_id)
SELECT item_id,
       coalesce(CASE WHEN local THEN 'assets/' || CAST(item_id AS VARCHAR) || '/cover.jpg' END, nullif(cover_url, '')) AS cover,
       array_to_string(CASE WHEN local THEN ['assets/' || CAST(item_id AS VARCHAR) || '/screenshot_1.jpg']
                            ELSE screenshot_urls END, ', ') AS screenshots
FROM j""")


# ------------------------------------------------------- remaining inventory

@register("safe_list")
def q_safe_list(spark, d):
    p = fx.table(spark, d, "part")
    raw = F.array(F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), F.lit(""), F.lit(None).cast("string"),
                  F.col("p_name"), F.lit("  "))
    return p.select("p_partkey", list_str(C.safe_list(raw)).alias("items"),
                    F.size(C.safe_list(F.lit(None).cast("array<string>"))).alias("from_null"))


SQL["safe_list"] = q(f"""
x AS (SELECT 1)
SELECT p_partkey, array_to_string(list_filter(list_transform([' ' || p_type || ' ', '', NULL, p_name, '  '],
                                                          lambda v: trim(v, {WS})), lambda v: v IS NOT NULL AND v <> ''), ', ') AS items,
       0 AS from_null FROM part""")


def _semantic_results(spark, d):
    return SE.semantic_search(fx.items(spark, d), fx.reviews(spark, d), fx.item_vectors(spark, d),
                              fx.vector_queries(spark, d))


@register("format_result_line")
def q_format_result_line(spark, d):
    r = _semantic_results(spark, d)
    line = S.format_result_line(F.col("title"), F.col("release_date").cast("date"), F.col("score"),
                                F.col("platforms"), F.col("genres"), F.col("relevance_score"), F.col("description"))
    return r.select("query_id", "item_id", F.length(line).alias("chars"), F.md5(line).alias("line_md5"))


def _line_sql() -> str:
    desc = ("CASE WHEN length(t.description) > 300 THEN substring(t.description, 1, 300) || '...' "
            "ELSE t.description END")
    return ("'🎮 ' || coalesce(t.title, 'Unknown') || ' (' || coalesce(CAST(year(t.release_date) AS VARCHAR), 'Unknown') "
            "|| ')' || chr(10) || '📊 Score: ' || coalesce(CAST(t.score AS VARCHAR), 'None') || '/10' || chr(10) "
            "|| '🖥️ Platforms: ' || array_to_string(coalesce(t.platforms, []::VARCHAR[]), ', ') || chr(10) "
            "|| '🎯 Genres: ' || array_to_string(coalesce(t.genres, []::VARCHAR[]), ', ') || chr(10) "
            "|| CASE WHEN coalesce(t.relevance_score, 0) <> 0 THEN '🔍 Relevance: ' || printf('%.3f', t.relevance_score) || chr(10) ELSE '' END "
            f"|| CASE WHEN coalesce(t.description, '') <> '' THEN '📝 ' || {desc} || chr(10) ELSE '' END")


SQL["format_result_line"] = semantic(select=f"SELECT t.query_id, t.item_id, CAST(length({_line_sql()}) AS INTEGER) AS chars, "
                                            f"md5({_line_sql()}) AS line_md5")


@register("display_score")
def q_display_score(spark, d):
    r = _semantic_results(spark, d)
    return r.select("query_id", "item_id", S.display_score(F.col("relevance_score"), F.lit(None).cast("double"),
                                                           F.col("score")).alias("display_score"))


SQL["display_score"] = semantic(select="""SELECT t.query_id, t.item_id,
       coalesce(printf('%.2f', coalesce(nullif(t.relevance_score, 0), nullif(t.score, 0))), 'N/A') AS display_score""")


@register("knn_cross")
def q_knn_cross(spark, d):
    from .operators import knn as K
    hits = K.knn(fx.vector_queries(spark, d), fx.item_vectors(spark, d), 10, carry=["modality"])
    return hits.select("query_id", "rank", "vec_id", "modality", F.round("dist", 6).alias("dist"))


SQL["knn_cross"] = q("""
pairs AS (SELECT q.query_id, v.vec_id, v.modality,
                 list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p:
                     (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS dist
          FROM vec_queries q, item_vectors v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, modality, round(dist, 6) AS dist FROM r WHERE rank <= 10""")


@register("count_rows")
def q_count_rows(spark, d):
    return _items(spark, d).agg(F.count(F.lit(1)).cast("bigint").alias("items"))


SQL["count_rows"] = q("""
x AS (SELECT 1)
SELECT CAST(count(*) AS BIGINT) AS items FROM items""")


@register("count_not_null")
def q_count_not_null(spark, d):
    i = _items(spark, d)
    return i.agg(*[F.count(c).cast("bigint").alias(f"{c}_n") for c in ("score", "cover_url", "release_date", "screenshot_urls")])


SQL["count_not_null"] = q("""
x AS (SELECT 1)
SELECT CAST(count(score) AS BIGINT) AS score_n, CAST(count(cover_url) AS BIGINT) AS cover_url_n,
       CAST(count(release_date) AS BIGINT) AS release_date_n, CAST(count(screenshot_urls) AS BIGINT) AS screenshot_urls_n
FROM items""")
