"""The reviews-per-item view, kept up to date from changes of reviews.

The view is a keyed table: per item the number of its reviews and their
(review_id, citation) list in order. A change of some reviews touches the
items that gain, lose or hold one of them; for these the new list is the old
one without the changed reviews, merged with what they now hold. Only those
items' rows are read from the view's buckets and written as one change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_scratch
from .catalogue import REVIEW_SEP
from .keyed_table import KeyedTable

ENTRY = "struct<review_id:bigint,citation:string>"


def _lists(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.col("review_id").cast("long").alias("review_id"), "citation"))).alias("entries"))


class ReviewView:
    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path)

    @classmethod
    def create(cls, reviews: DataFrame, path: str, buckets: int = 64) -> "ReviewView":
        """The view of ``reviews`` (review_id unique, item_id, citation)."""
        rows = _lists(reviews.where("item_id is not null")).select("item_id", F.size("entries").cast("long").alias("review_count"), "entries")
        KeyedTable.create(reviews.sparkSession, path, rows, "item_id", buckets)
        return cls(reviews.sparkSession, path)

    def apply(self, reviews: DataFrame, upserts: DataFrame, deletes: DataFrame | None = None) -> None:
        """After a change: ``reviews`` are all reviews before it, ``upserts``
        (review_id, item_id, citation) the rows that are new or differ, and
        ``deletes`` (review_id) those that go. An id is in one of them."""
        new = write_scratch(upserts.select(F.col("review_id").cast("long").alias("review_id"), "item_id", "citation"), "review-upserts")
        ids = new.select("review_id")
        if deletes is not None:
            ids = ids.unionByName(deletes.select(F.col("review_id").cast("long").alias("review_id")))
        # items that held a changed review, and items that hold it now
        before = reviews.join(ids, "review_id", "left_semi").where("item_id is not null").groupBy("item_id").agg(F.collect_set("review_id").alias("gone"))
        now = _lists(new.where("item_id is not null")).withColumnRenamed("entries", "own")
        delta = write_scratch(before.join(now, "item_id", "full_outer"), "review-delta")
        old = self.table.read().join(delta.select("item_id"), "item_id", "left_semi").select("item_id", "entries")
        none = F.array().cast(f"array<{ENTRY}>")
        kept = F.filter(F.coalesce("entries", none), lambda e: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), e["review_id"]))
        merged = F.array_sort(F.concat(kept, F.coalesce("own", none)))
        rows = delta.join(old, "item_id", "left").select("item_id", merged.alias("entries"))
        self.table.append(rows.select("item_id", F.size("entries").cast("long").alias("review_count"), "entries"), ["review_count", "entries"])
        self.table.compact()

    def items_with_reviews(self, items: DataFrame) -> DataFrame:
        """The items with review_count, reviews_concat and reviews_array, as
        ``catalogue.items_with_reviews`` builds them from scratch."""
        arr = F.transform("entries", lambda e: e["citation"])
        v = self.table.read().select("item_id", "review_count", F.nullif(F.array_join(arr, REVIEW_SEP), F.lit("")).alias("reviews_concat"), arr.alias("reviews_array"))
        j = items.join(v, "item_id", "left")
        return j.select(*items.columns, F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"), "reviews_concat",
                        F.coalesce("reviews_array", F.array().cast("array<string>")).alias("reviews_array"))
