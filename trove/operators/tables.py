"""Table maintenance without a transactional table format: every change is a
new DataFrame (written as a new version by the caller, never over the path
being read)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, write_scratch


def dedupe_first(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: the first by ``order`` (or any, if None)."""
    if order is None:
        return df.dropDuplicates([key])
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(target: DataFrame, source: DataFrame, key: str, update_cols: Sequence[str],
           order: str | None = None, broadcast_rows: int = 200_000,
           broadcast_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE SET update_cols.

    Matched rows take ``update_cols`` from the source and keep every other
    column; new keys are inserted with the source values (columns the source
    lacks are NULL). Duplicate keys in the source resolve to the last by
    ``order`` (the last write wins). Idempotent.

    Physical plan by measured source size: the source is computed once and
    stored. A change batch under the bound is broadcast, so the (large) target
    is streamed through broadcast hash joins and never shuffled: one over its
    rows, and one over its key column that finds which source keys it has; the
    others are new. A larger source uses a full outer join (one shuffle of
    each side); ``KeyedTable`` avoids that one as well.
    """
    from .sizing import measure
    if order is not None:
        cols = [c for c in source.columns if c != key]
        agg = source.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
        source = agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols if c != order])
    else:
        source = source.dropDuplicates([key])
    s = write_scratch(source.select(key, *[F.col(c).alias(f"_s_{c}") for c in update_cols], F.lit(True).alias("_in_s")), "upsert-source")

    def merged(j: DataFrame) -> DataFrame:
        out = []
        for c in target.columns:
            if c == key:
                out.append(F.col(key))
            elif c in update_cols:
                out.append(F.when(F.col("_in_s").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
            else:
                out.append(F.col(c))
        return j.select(*out)

    if measure(s).fits(broadcast_rows, broadcast_bytes):
        kept = merged(target.join(F.broadcast(s), key, "left"))
        known = target.select(key).join(F.broadcast(s.select(key)), key, "left_semi").distinct()
        new = s.join(known, key, "left_anti").select(
            key, *[F.col(f"_s_{c}").alias(c) for c in update_cols])
        return kept.unionByName(new, allowMissingColumns=True).select(*target.columns)
    return merged(target.join(s, key, "full_outer"))


def insert_ignore(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: source rows whose key is new (first
    occurrence within the source wins) are appended."""
    src = dedupe_first(source, key, order)
    if order is not None and order not in target.columns:
        src = src.drop(order)
    new = src.join(target.select(key), key, "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def patch_columns(target: DataFrame, patch: DataFrame, key: str, cols: Sequence[str],
                  keep_existing: bool = False) -> DataFrame:
    """Update ``cols`` for keys in ``patch`` where at least one patched value
    is non-empty. By default all listed columns are overwritten (an absent
    kind becomes NULL); ``keep_existing`` keeps the old value instead.
    Adds ``_patched`` (true for updated rows)."""
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols], F.lit(True).alias("_in_p"))
    j = target.join(p, key, "left")
    any_val = None
    for c in cols:
        col = F.col(f"_p_{c}")
        nz = (col.isNotNull() & (F.coalesce(F.size(col), F.lit(1)) > 0)) if _is_array(patch, c) else \
            (col.isNotNull() & (col != ""))
        any_val = nz if any_val is None else (any_val | nz)
    upd = F.coalesce(F.col("_in_p"), F.lit(False)) & any_val
    out = []
    for c in target.columns:
        if c in cols:
            newv = F.coalesce(F.col(f"_p_{c}"), F.col(c)) if keep_existing else F.col(f"_p_{c}")
            out.append(F.when(upd, newv).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out, F.coalesce(upd, F.lit(False)).alias("_patched"))


def _is_array(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() == "array"


def patch_counts(patch: DataFrame, cols: Sequence[str]) -> DataFrame:
    """updated / skipped over the patch rows (non-empty value in any column)."""
    any_val = None
    for c in cols:
        col = F.col(c)
        nz = (col.isNotNull() & (F.size(col) > 0)) if _is_array(patch, c) else (col.isNotNull() & (col != ""))
        any_val = nz if any_val is None else (any_val | nz)
    return patch.agg(F.count_if(any_val).cast("bigint").alias("updated"),
                     F.count_if(~any_val).cast("bigint").alias("skipped"))


def match_before_update(target: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """How many target rows the patch would touch."""
    return target.join(patch.select(key), key, "left_semi").agg(F.count(F.lit(1)).cast("bigint").alias("matched"))


def delete_by_key(parents: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return parents.join(keys.select(key), key, "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, keys: DataFrame, key: str,
                   child_fk: str) -> tuple[DataFrame, DataFrame]:
    """Delete parents by key; children whose parent went follow (ON DELETE
    CASCADE)."""
    k = keys.select(F.col(key).alias(child_fk))
    return delete_by_key(parents, keys, key), children.join(k, child_fk, "left_anti")


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """1-based position in a global order without a single-partition window.

    The frame is range-partitioned and sorted, each row gets its partition id
    and its position inside the partition; the per-partition counts (one row
    per partition) give each partition's offset. The numbered frame is
    checkpointed into the shared checkpoint folder first so both uses of the
    positions see the same rows even if an executor is lost and the frame is
    recomputed.
    """
    s = df.orderBy(*order)
    tagged = s.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the running sum over this tiny frame is cheap.
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    # monotonically_increasing_id = partition index << 33 | position in partition
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33) + 1
    out = tagged.join(F.broadcast(offs), "_pid").withColumn(name, (F.col("_off") + local).cast("bigint"))
    return out.drop("_pid", "_mid", "_off")


def page_slice(df: DataFrame, order: Sequence[Column], page_size: int) -> DataFrame:
    """Page number (0-based) and position of every row in ``ORDER BY ...
    LIMIT n OFFSET m`` paging, computed in one pass (no rescans)."""
    n = global_row_number(df, order, "_rn")
    return n.withColumn("page", ((F.col("_rn") - 1) / F.lit(page_size)).cast("bigint")) \
            .withColumn("pos_in_page", ((F.col("_rn") - 1) % F.lit(page_size)).cast("int")).drop("_rn")


def one_page(df: DataFrame, order: Sequence[Column], page_size: int, page: int) -> DataFrame:
    """A single page: ``orderBy().offset().limit()``."""
    return df.orderBy(*order).offset(page * page_size).limit(page_size)


def reassign_surrogate_key(df: DataFrame, old_key: str, new_key: str) -> DataFrame:
    """Copy rows in ``old_key`` order and number them 1..N (a serial key).

    Only the keys are numbered and stored, and joined back to the rows; a key
    that several rows have (or no row may have: null) is numbered once per row
    with the rows stored beside it, as the key does not tell them apart."""
    keys = df.select(F.col(old_key).alias("_old"))
    unique = keys.groupBy("_old").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or _old is null").isEmpty()
    if not unique:
        return global_row_number(df, [F.col(old_key).asc()], new_key)
    numbers = write_scratch(global_row_number(keys, [F.col("_old").asc()], new_key), "numbers")
    return df.join(numbers, df[old_key] == numbers["_old"]).drop("_old")


def copy_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A copy of the columns, written as Parquet in the shared folder and read back."""
    return write_scratch(df.select(*columns), "copy")


def write_vectors(vectors: DataFrame, path: str, dims: dict[str, int] | None = None) -> DataFrame:
    """Write item vectors partitioned by modality. Ids are unique within a
    modality: of rows that share both, the smallest (by the other columns in
    order) is kept; a vector of the wrong length for its modality, or none at all, raises."""
    v = vectors
    if dims:
        expected = None
        for m, d in dims.items():
            expected = F.when(F.col("modality") == m, F.lit(d)) if expected is None else \
                expected.when(F.col("modality") == m, F.lit(d))
        # a filter on the check itself: the optimizer cannot drop it
        v = v.where(F.when(expected.isNull() | (F.size("embedding") == expected), F.lit(True))
                    .otherwise(F.raise_error(F.lit("vector of wrong length")).cast("boolean")))
    others = [c for c in v.columns if c not in ("modality", "vec_id")]
    first = v.groupBy("modality", "vec_id").agg(F.min(F.struct(*others)).alias("_r")) \
        .select(*[F.col(f"_r.{c}").alias(c) if c in others else F.col(c) for c in v.columns])
    first.write.mode("errorifexists").partitionBy("modality").parquet(path)
    return first.sparkSession.read.parquet(path)


def write_version(df: DataFrame, base: str | None = None, name: str = "table") -> str:
    """Write ``df`` as a new version folder (under the shared checkpoint
    folder unless ``base`` is given); returns the path."""
    path = base or scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path + "/v")
    return path + "/v"


def result_json(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One JSON document per row."""
    cols = cols or df.columns
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


__all__ = ["upsert", "insert_ignore", "patch_columns", "patch_counts", "match_before_update",
           "delete_by_key", "cascade_delete", "global_row_number", "page_slice", "one_page",
           "reassign_surrogate_key", "copy_table", "write_vectors", "write_version", "result_json"]
