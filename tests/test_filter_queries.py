"""The registered filter queries answer every filter row of their tables."""

import os

from pyspark.sql import functions as F


def _tables(spark, at):
    k = F.col("id")
    date = F.date_add(F.lit("1990-01-01").cast("date"), (k * 97 % 4000).cast("int"))
    rows = {
        "nation": spark.range(3).select(k.cast("int").alias("n_nationkey"), F.concat(F.lit("N"), k).alias("n_name")),
        "customer": spark.range(60).select(k.alias("c_custkey"), (k % 3).cast("int").alias("c_nationkey")),
        "supplier": spark.range(6).select(k.alias("s_suppkey"), (k % 3).cast("int").alias("s_nationkey")),
        "part": spark.range(40).select(k.alias("p_partkey"), (k % 50).cast("int").alias("p_size"), F.concat(F.lit("T"), k % 2).alias("p_type"),
                                       F.lit("red blue").alias("p_name"), F.lit("B").alias("p_brand")),
        "orders": spark.range(40).select(k.alias("o_orderkey"), date.alias("o_orderdate")),
        "lineitem": spark.range(120).select((k % 40).alias("l_partkey"), (k % 5).alias("l_suppkey")),
        "documents": spark.range(40).select(k.alias("doc_id"), F.lit("a text").alias("text"), F.lit("web").alias("source")),
        "labels": spark.range(0, 40, 2).select(k.alias("doc_id")),
        "pages": spark.range(10).select(k.alias("page_id"), F.lit("u").alias("url")),
    }
    for name, df in rows.items():
        df.coalesce(1).write.parquet(os.path.join(at, f"{name}.parquet"))
    return at


def test_every_customer_is_answered(spark, tmpdir_fresh):
    import __spark_entry__ as e
    d, found = _tables(spark, tmpdir_fresh), e.queries()
    counts = {r.query_id: r.matches for r in found["filter_batch_counts"](spark, d).collect() if r.matches}
    pairs = [tuple(r) for r in found["filter_batch_items"](spark, d).collect()]
    assert len(pairs) == len(set(pairs))
    assert {q: sum(p[0] == q for p in pairs) for q in counts} == counts and {q for q, _ in pairs} == set(counts)
    assert len([q for q in counts if q % 20]) > 30
