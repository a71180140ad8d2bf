"""Schema enforcement, constraint checks and load verification."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("release_date", T.DateType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("platforms", T.ArrayType(T.StringType())),
    T.StructField("genres", T.ArrayType(T.StringType())),
    T.StructField("developers", T.ArrayType(T.StringType())),
    T.StructField("publishers", T.ArrayType(T.StringType())),
    T.StructField("cover_url", T.StringType()),
    T.StructField("screenshot_urls", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])
REVIEWS_SCHEMA = T.StructType([
    T.StructField("review_id", T.LongType(), False),
    T.StructField("item_id", T.LongType(), False),
    T.StructField("item_title", T.StringType()),
    T.StructField("citation", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
DEFAULT_NOW = ("created_at", "updated_at")


def enforce_schema(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine). Columns are cast to the declared types
    (``try_cast``: a value that does not fit becomes NULL), missing columns
    are added, audit timestamps default to now; rows with NULL in a
    NOT NULL column go to quarantine with the column name as reason."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).try_cast(f.dataType)
        elif f.name in DEFAULT_NOW:
            c = F.current_timestamp().cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        if f.name in DEFAULT_NOW:
            c = F.coalesce(c, F.current_timestamp())
        cols.append(c.alias(f.name))
    typed = df.select(*cols)
    reason = None
    for f in schema.fields:
        if not f.nullable:
            r = F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is null"))
            reason = r if reason is None else F.coalesce(reason, r)
    if reason is None:
        return typed, typed.limit(0).withColumn("reason", F.lit(None).cast("string"))
    tagged = typed.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def check_primary_key(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("count")).where(F.col("count") > 1)


def quarantine_orphans(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, orphans): children whose foreign key has a parent, and the rest."""
    p = parents.select(F.col(pk).alias(fk))
    return children.join(p, fk, "left_semi"), children.join(p, fk, "left_anti")


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table, ordered by table name."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("table")


def _long(m: DataFrame, side: str) -> DataFrame:
    return m.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in m.columns]), F.array(*[F.col(c) for c in m.columns]))).alias("metric", side))


def _text_bytes(df: DataFrame, texts: Sequence[str]):
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in texts if c in df.columns),
               F.lit(0).cast("bigint"))
    return F.coalesce(F.sum(size), F.lit(0)).cast("bigint")


def load_metrics(items: DataFrame, reviews: DataFrame, side: str = "value",
                 texts: Sequence[str] = ("title", "description", "citation")) -> DataFrame:
    """(metric, value) rows: total items, with cover, with screenshots
    (one aggregate pass over items), total reviews and the bytes of their
    ``texts`` columns, so a cut text shows."""
    i = items.agg(F.count(F.lit(1)).cast("bigint").alias("items"),
                  F.count("cover_url").cast("bigint").alias("with_cover"),
                  F.count("screenshot_urls").cast("bigint").alias("with_screenshots"),
                  _text_bytes(items, texts).alias("item_bytes"))
    r = reviews.agg(F.count(F.lit(1)).cast("bigint").alias("reviews"), _text_bytes(reviews, texts).alias("review_bytes"))
    return _long(i, side).unionByName(_long(r, side))


def verify_copy(src_items: DataFrame, src_reviews: DataFrame, dst_items: DataFrame, dst_reviews: DataFrame) -> DataFrame:
    """metric, source, target, match — source and target metrics side by side;
    bytes are those of the copied text columns."""
    copied = [c for c in ("title", "description", "citation") if c in {*dst_items.columns, *dst_reviews.columns}]
    s = load_metrics(src_items, src_reviews, "source", copied)
    t = load_metrics(dst_items, dst_reviews, "target", copied)
    return s.join(t, "metric", "full_outer").withColumn("match", F.col("source") == F.col("target"))


def _leaf_sums(df: DataFrame, key: str, columns: Sequence[str], buckets: int, side: str) -> DataFrame:
    """(leaf, rows, sums of two row hashes) of every bucket of keys."""
    cols = [F.col(key), *[F.col(c) for c in columns]]
    whole = lambda h: F.sum(h.cast("decimal(20,0)"))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("leaf")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), whole(F.xxhash64(*cols)).alias("a"), whole(F.xxhash64(F.lit(7), *cols)).alias("b")).alias(side))


def copy_differences(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str], buckets: int = 4096, fan: int = 64) -> DataFrame:
    """The rows in which a copy differs: key, status ('missing' in the target,
    'added', or 'changed') and the names of the changed columns.

    A checksum tree of two levels: row hashes are summed per bucket of keys,
    and the buckets' sums per ``fan`` buckets. The comparison descends only
    into branches and then buckets whose sums differ, and only the rows of
    those buckets meet in a join; of equal buckets nothing but the sums is
    compared. Keys are unique."""
    from ..session import write_scratch
    leaves = write_scratch(_leaf_sums(source, key, columns, buckets, "s").join(_leaf_sums(target, key, columns, buckets, "t"), "leaf", "full_outer"), "leaf-sums")
    branch = F.floor(F.col("leaf") / fan)
    up = lambda side: F.struct(*[F.sum(F.col(f"{side}.{f}").cast("decimal(38,0)")).alias(f) for f in ("n", "a", "b")])
    branches = leaves.groupBy(branch.alias("branch")).agg(up("s").alias("s"), up("t").alias("t")).where(~F.col("s").eqNullSafe(F.col("t")))
    apart = leaves.join(F.broadcast(branches.select("branch")), branch == F.col("branch"), "left_semi") \
        .where(~F.col("s").eqNullSafe(F.col("t"))).select("leaf")
    apart = F.broadcast(write_scratch(apart, "leaves-apart"))                # ``buckets`` rows at most

    def rows(df: DataFrame, side: str) -> DataFrame:
        own = df.select(F.col(key).alias(f"{side}_key"), F.struct(*columns).alias(side), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("leaf"))
        return own.join(apart, "leaf", "left_semi").drop("leaf")
    met = rows(source, "s").join(rows(target, "t"), F.col("s_key").eqNullSafe(F.col("t_key")), "full_outer")
    status = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "added").otherwise("changed")
    changed = F.filter(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return met.select(F.coalesce("s_key", "t_key").alias(key), status.alias("status"), F.when(status == "changed", changed).alias("columns")) \
        .where((F.col("status") != "changed") | (F.size("columns") > 0))


def sample_rows(items: DataFrame, n: int = 3, title_chars: int = 50) -> DataFrame:
    """First n items (by id) that have a cover: title cut to 50 characters
    and the number of screenshots (0 when none)."""
    return (items.where(F.col("cover_url").isNotNull()).orderBy("item_id").limit(n)
                 .select("item_id", F.substring("title", 1, title_chars).alias("title"), "cover_url",
                         F.coalesce(F.size("screenshot_urls"), F.lit(0)).alias("screenshots")))


def ingest_outcome_stats(outcomes: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """total / processed / successful / failed / skipped and the success
    percentage over the per-line outcomes (one aggregate pass)."""
    o = F.col(outcome_col)
    agg = outcomes.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                       F.count_if(o != "skipped").cast("bigint").alias("processed"),
                       F.count_if(o == "accepted").cast("bigint").alias("successful"),
                       F.count_if(o == "failed").cast("bigint").alias("failed"),
                       F.count_if(o == "skipped").cast("bigint").alias("skipped"))
    return agg.withColumn("success_pct", F.round(F.try_divide(F.col("successful") * 100.0, F.col("total")), 1))


def observe_outcomes(outcomes: DataFrame, name: str = "ingest", outcome_col: str = "outcome"):
    """Attach live load metrics to a per-line outcome frame.

    Returns ``(frame, observation)``: the counts (total, successful, failed,
    skipped) are collected by ``DataFrame.observe`` as the frame is written
    — no second pass over the input — and read with ``observation.get``
    after the action.
    """
    from pyspark.sql import Observation
    obs = Observation(name)
    o = F.col(outcome_col)
    df = outcomes.observe(obs, F.count(F.lit(1)).alias("total"),
                          F.count_if(o == "accepted").alias("successful"),
                          F.count_if(o == "failed").alias("failed"),
                          F.count_if(o == "skipped").alias("skipped"))
    return df, obs
