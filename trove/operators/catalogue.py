"""Catalogue operators: the items-with-reviews view, facets, ranges, lookups, top-k."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shape import date_str
from ..session import write_scratch

REVIEW_SEP = " | "          # fixed value: separator of the concatenated review text
FACET_ALL = "All"           # fixed value: first facet choice


def reviews_by_item(reviews: DataFrame) -> DataFrame:
    """Aggregate reviews per item *before* joining to items.

    Grouping the view by all item columns (arrays included) would shuffle
    whole item rows; grouping the narrow review table by ``item_id`` first
    is a partial (map-side) aggregate and the join afterwards is 1:1.
    Returns item_id, review_count, reviews_array (ordered by review_id,
    NULL citations kept), reviews_concat (NULLs skipped, NULL when none).
    """
    agg = reviews.groupBy("item_id").agg(
        F.count("review_id").alias("review_count"),
        F.array_sort(F.collect_list(F.struct("review_id", "citation"))).alias("_r"))
    arr = F.transform(F.col("_r"), lambda x: x["citation"])
    return agg.select(
        "item_id", "review_count",
        arr.alias("reviews_array"),
        F.nullif(F.array_join(arr, REVIEW_SEP), F.lit("")).alias("reviews_concat"))


def items_with_reviews(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every item with review_count (0 when none), reviews_concat (NULL when
    none) and reviews_array ([] when none)."""
    r = reviews_by_item(reviews)
    j = items.join(r, "item_id", "left")
    return j.select(
        *[c for c in items.columns],
        F.coalesce(F.col("review_count"), F.lit(0)).cast("bigint").alias("review_count"),
        F.col("reviews_concat"),
        F.coalesce(F.col("reviews_array"), F.array().cast("array<string>")).alias("reviews_array"))


def attach_reviews(hits: DataFrame, reviews: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Reviews for a result set: reviews are first cut to the hit ids (semi
    join; AQE broadcasts the id set when it proves small), then aggregated, so
    the full review table is never grouped for a search.

    ``ids`` (item_id) are the items that may be among the hits, where they are
    known beforehand. Without them the hits, a few rows per query, are stored,
    as they feed both the id set and the join and the search should run once."""
    if ids is None:
        hits = write_scratch(hits, "hits")
        ids = hits
    r = reviews_by_item(reviews.join(ids.select("item_id").distinct(), "item_id", "left_semi"))
    out = hits.join(r, "item_id", "left")
    return out.withColumn("review_count", F.coalesce(F.col("review_count"), F.lit(0)).cast("bigint")) \
              .withColumn("reviews_array", F.coalesce(F.col("reviews_array"), F.array().cast("array<string>")))


def facet_values(items: DataFrame, column: str, alias: str) -> DataFrame:
    """Distinct non-null elements of an array column, sorted."""
    return (items.where(F.col(column).isNotNull())
                 .select(F.explode(column).alias(alias))
                 .where(F.col(alias).isNotNull())
                 .distinct()
                 .orderBy(alias))


def facet_choices(items: DataFrame, column: str, alias: str) -> DataFrame:
    """Facet values with 'All' first; ``pos`` gives the display order."""
    from .tables import global_row_number
    vals = facet_values(items, column, alias)
    first = vals.sparkSession.range(1).select(F.lit(0).alias("pos"), F.lit(FACET_ALL).alias(alias))
    rest = global_row_number(vals, [F.col(alias).asc()], "_rn")
    return first.unionByName(rest.select(F.col("_rn").cast("int").alias("pos"), alias))


def score_year_ranges(items: DataFrame) -> DataFrame:
    return items.agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.min(F.year("release_date")).cast("int").alias("min_year"),
        F.max(F.year("release_date")).cast("int").alias("max_year"))


def point_lookup_cover(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Cover URL per requested id; NULL if the item is absent, the URL empty
    or not http(s)."""
    cov = items.select("item_id", "cover_url")
    j = ids.select("item_id").join(cov, "item_id", "left")
    ok = F.coalesce(F.col("cover_url").rlike(r"^https?://"), F.lit(False))
    return j.select("item_id", F.when(ok, F.col("cover_url")).alias("cover_url"))


def order_by_score() -> list[Column]:
    """Catalogue order: score desc, NULLs last, ties by item id."""
    return [F.col("score").desc_nulls_last(), F.col("item_id").asc()]


def top_by_score(df: DataFrame, n: int) -> DataFrame:
    """``ORDER BY score DESC NULLS LAST LIMIT n`` -> TakeOrderedAndProject."""
    return df.orderBy(*order_by_score()).limit(n)


def top_k_per_query(df: DataFrame, k, order: Sequence[Column], key: str = "query_id",
                    rank_col: str = "rank") -> DataFrame:
    """First k rows per key by ``order``; ``k`` is an int or a column name.

    ``row_number() <= k`` plans as a partial WindowGroupLimit before the
    shuffle and a final one after it, so only k rows per key and partition
    cross the network.
    """
    w = Window.partitionBy(key).orderBy(*order)
    kcol = F.col(k) if isinstance(k, str) else F.lit(int(k))
    ranked = df.withColumn(rank_col, F.row_number().over(w).cast("int"))
    return ranked.where(F.col(rank_col) <= kcol)


def rank_results(df: DataFrame, order: Sequence[Column], key: str = "query_id",
                 rank_col: str = "rank", row: str | None = None, needs: Sequence[str] = ()) -> DataFrame:
    """1-based position of every row in its query's result list.

    A global row number over (key, order), minus that of the key's first row:
    range partitions split a query that holds a third of all rows. If ``row``
    names a column that identifies a row within its key, only the key, that
    column and those that ``order`` ``needs`` are numbered and stored."""
    from .tables import global_row_number
    if row is None:
        numbered = global_row_number(df, [F.col(key).asc(), *order], "_rn")
        first = numbered.groupBy(F.col(key).alias("_key")).agg(F.min("_rn").alias("_first"))
        return numbered.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(
            rank_col, (F.col("_rn") - F.col("_first") + 1).cast("int")).drop("_rn", "_key", "_first")
    narrow = df.select(*dict.fromkeys([key, row, *needs]))
    numbered = write_scratch(global_row_number(narrow, [F.col(key).asc(), *order], "_rn").select(
        F.col(key).alias("_key"), F.col(row).alias("_row"), "_rn"), "ranks")
    first = numbered.groupBy("_key").agg(F.min("_rn").alias("_first")).withColumnRenamed("_key", "_first_key")
    ranks = numbered.join(first, F.col("_key").eqNullSafe(F.col("_first_key"))).select(
        "_key", "_row", (F.col("_rn") - F.col("_first") + 1).cast("int").alias(rank_col))
    return df.join(ranks, F.col(key).eqNullSafe(F.col("_key")) & F.col(row).eqNullSafe(F.col("_row"))).drop("_key", "_row")


def project_result(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Result record columns: date as string, score as double or NULL."""
    cols = [F.col("item_id").cast("bigint").alias("item_id"), "title", "description",
            date_str(F.col("release_date")).alias("release_date"),
            F.col("score").cast("double").alias("score"),
            "platforms", "genres", "developers", "publishers", "cover_url", "screenshot_urls"]
    return df.select(*cols, *extra)


def review_positions(reviews: DataFrame) -> DataFrame:
    """Every review with its 1-based position among its item's reviews
    (ordered by review id), without gathering an item's reviews into one task."""
    return rank_results(reviews, [F.col("review_id").asc()], key="item_id", rank_col="position", row="review_id")


def explode_reviews(reviews: DataFrame) -> DataFrame:
    """Long form of the review objects: item_id, source ('Critic i' with
    the position among the item's reviews kept), score '' and the stripped
    review; blank or NULL reviews are dropped after positions are set."""
    from ..functions.clean import py_strip
    from ..functions.shape import CRITIC_LABEL
    p = review_positions(reviews)
    txt = py_strip(F.col("citation"))
    return p.where(txt.isNotNull() & (txt != "")).select(
        "item_id", F.concat(F.lit(CRITIC_LABEL), F.col("position").cast("string")).alias("source"),
        F.lit("").alias("score"), txt.alias("review"))


def first_reviews(reviews: DataFrame, n: int) -> DataFrame:
    """item_id and ``reviews``: its first n review objects (blank ones left
    out, labels counting all). At most n rows per item and task are shuffled."""
    from ..functions.clean import py_strip
    from ..functions.shape import CRITIC_LABEL
    txt = py_strip(F.col("citation"))
    # positions need ids alone; the texts of the first n join them afterwards
    shown = reviews.where(txt.isNotNull() & (txt != ""))
    top = top_k_per_query(shown, n, [F.col("review_id").asc()], key="item_id", rank_col="_nth")
    place = review_positions(reviews.select("item_id", "review_id"))
    obj = F.struct(F.col("_nth"), F.concat(F.lit(CRITIC_LABEL), F.col("position").cast("string")).alias("source"),
                   F.lit("").alias("score"), txt.alias("review"))
    rows = top.join(place, ["item_id", "review_id"]).groupBy("item_id").agg(F.array_sort(F.collect_list(obj)).alias("_r"))
    return rows.select("item_id", F.transform("_r", lambda r: F.struct(
        r["source"].alias("source"), r["score"].alias("score"), r["review"].alias("review"))).alias("reviews"))


def review_coverage(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items with reviews and the number of their reviews: counts of counts."""
    n = reviews.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id").join(n, "item_id", "left").agg(
        F.count("n").cast("bigint").alias("items_with_reviews"),
        F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("total_reviews"))
