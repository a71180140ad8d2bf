"""The build of the items from the driver's tables."""

import re

from trove.sources import fixtures as fx


def test_queries_of_titles_do_not_join_the_texts(spark, tmpdir_fresh):
    tables = {
        "documents": ([(1, "one\nmore", "web"), (2, None, "web"), (3, "three", None)], "doc_id long, text string, source string"),
        "orders": ([(1, "1995-01-01")], "o_orderkey long, o_orderdate string"),
        "part": ([(1, 7, "T", "a b", "B")], "p_partkey long, p_size int, p_type string, p_name string, p_brand string"),
        "labels": ([(1,)], "doc_id long"), "pages": ([(2, "u")], "page_id long, url string"),
        "lineitem": ([(1, 5)], "l_partkey long, l_suppkey long"), "supplier": ([(5, 3)], "s_suppkey long, s_nationkey long"),
        "nation": ([(3, "FRANCE")], "n_nationkey long, n_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmpdir_fresh}/{name}.parquet")
    items = fx.items(spark, tmpdir_fresh)
    got = {r.item_id: (r.title, r.description, r.platforms) for r in items.collect()}
    assert got == {1: ("one", "one\nmore", ["FRANCE"]), 2: (None, None, None), 3: ("three", "three", None)}
    plan = items.select("item_id", "title")._jdf.queryExecution().optimizedPlan().toString()
    joins, below = plan.split("substring_index")
    assert "Join LeftOuter" in joins and not re.search(r"\btext#", joins) and "Join" not in below.split("Relation")[0]


def test_a_side_is_broadcast_by_its_measured_rows(spark, tmpdir_fresh):
    """Numbers in order pack well: the files are small, the rows are not."""
    spark.range(300_000).withColumnRenamed("id", "doc_id").write.parquet(f"{tmpdir_fresh}/labels.parquet")
    spark.range(1000).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmpdir_fresh}/supplier.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    left = spark.range(50)
    many, few = fx.side(spark, tmpdir_fresh, "labels", "doc_id"), fx.side(spark, tmpdir_fresh, "supplier", "s_suppkey")
    many, few = left.join(many, left.id == many.doc_id, "left"), left.join(few, left.id == few.s_suppkey, "left")
    assert "Broadcast" not in plan(many) and "BroadcastHashJoin" in plan(few)
    assert many.where("doc_id is not null").count() == few.where("s_suppkey is not null").count() == 50
