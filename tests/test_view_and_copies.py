"""The maintained review view against the rebuilt one, the checksum tree, ranks from stored keys."""

import random

from pyspark.sql import functions as F

from trove.operators import catalogue as CAT
from trove.operators import tables as TB
from trove.operators import verify as V


def test_view_after_changes_equals_the_rebuilt_view(spark, tmpdir_fresh):
    from trove.operators.review_view import ReviewView
    rng = random.Random(1)
    schema = "review_id long, item_id long, citation string"
    frame = lambda rows: spark.createDataFrame([(r, i, c) for r, (i, c) in rows.items()], schema)
    now = {r: (rng.choice([None, *range(8)]), rng.choice([None, "", f"c{r}"])) for r in range(40)}
    items = spark.range(10).select(F.col("id").alias("item_id"))
    view = ReviewView.create(frame(now), f"{tmpdir_fresh}/view", buckets=4)
    for step in range(4):
        gone = rng.sample(sorted(now), 4)
        changed = {r: (rng.choice([None, *range(10)]), f"n{step}") for r in [*rng.sample([r for r in now if r not in gone], 5), 100 + step, 200 + step]}
        view.apply(frame(now), frame(changed), spark.createDataFrame([(r,) for r in gone], "review_id long") if step else None)
        now = {**{r: v for r, v in now.items() if r not in gone or not step}, **changed}
        want = CAT.items_with_reviews(items, frame({r: v for r, v in now.items()}))
        key = lambda df: sorted(tuple(r) for r in df.select("item_id", "review_count", F.coalesce("reviews_concat", F.lit("-")), F.to_json("reviews_array")).collect())
        assert key(view.items_with_reviews(items)) == key(want)
    # a change writes the lists of its items only
    before = view.table.state().number
    view.apply(frame(now), frame({next(iter(now)): (3, "last")}))
    folder = {f for xs in view.table.state().changes.values() for n, f in xs if n > before}
    assert len(folder) == 1 and spark.read.parquet(f"{view.table.path}/{folder.pop()}").count() <= 2


def test_one_changed_byte_is_named_and_equal_buckets_do_not_meet(spark):
    src = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id")).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    dst = src.withColumn("a", F.when(F.col("k") == 1234, "text 1235").otherwise(F.col("a")))
    out = V.copy_differences(src, dst, "k", ["a", "b"], buckets=256, fan=16)
    assert [tuple(r) for r in out.collect()] == [(1234, "changed", ["a"])]
    out.write.format("noop").mode("overwrite").save()
    # the rows that meet are those of one bucket of 256
    leaf = src.where("k = 1234").select(F.pmod(F.xxhash64("k"), F.lit(256)).alias("x")).first().x
    own = src.where(F.pmod(F.xxhash64("k"), F.lit(256)) == leaf).count()
    apart = [f for f in out.inputFiles() if "leaves-apart" in f]
    assert spark.read.parquet(*{f.rsplit("/", 1)[0] for f in apart}).collect()[0].leaf == leaf and own < 40
    assert V.copy_differences(src, src, "k", ["a", "b"]).count() == 0
    both = V.copy_differences(src.where("k < 10"), src.where("k between 3 and 12").withColumn("b", F.lit(None).cast("long")), "k", ["a", "b"])
    assert {tuple(r) if r.columns is None else (r.k, r.status, tuple(r.columns)) for r in both.collect()} == \
        {(k, "missing", None) for k in range(3)} | {(k, "added", None) for k in range(10, 13)} | {(k, "changed", ("b",)) for k in (4, 6, 8)}


def test_ranks_and_numbers_store_keys_only(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(q, i, rng.choice([None, 1.0, 2.0]), "text " * 50) for q in (1, 2, None) for i in rng.sample(range(100), 40)]
    df = spark.createDataFrame(rows, "query_id long, item_id long, score double, text string").repartition(5)
    stored = []
    for module in (CAT, TB):
        real = module.write_scratch
        monkeypatch.setattr(module, "write_scratch", lambda d, *a, real=real, **k: (stored.append(set(d.columns)), real(d, *a, **k))[1])
    real_cut = TB.cut_lineage
    monkeypatch.setattr(TB, "cut_lineage", lambda d: (stored.append(set(d.columns)), real_cut(d))[1])
    order = [F.col("score").desc_nulls_last(), F.col("item_id").asc()]
    got = {(r.query_id, r.item_id): r.rank for r in CAT.rank_results(df, order, row="item_id", needs=["score"]).collect()}
    for q in (1, 2, None):
        own = sorted((i for p, i, *_ in rows if p == q), key=lambda i: next((s is None, -(s or 0), i) for p, j, s, _ in rows if (p, j) == (q, i)))
        assert [got[q, i] for i in own] == list(range(1, 41))
    assert {(r.query_id, r.item_id): r.rank for r in CAT.rank_results(df, order).collect()} == got
    stored.clear()
    unique = df.where("query_id = 1")
    new = TB.reassign_surrogate_key(unique, "item_id", "n")
    assert [r.n for r in new.orderBy("item_id").collect()] == list(range(1, 41)) and new.columns == [*df.columns, "n"]
    assert all("text" not in cols for cols in stored)
    assert sorted(r.n for r in TB.reassign_surrogate_key(df, "item_id", "n").collect()) == list(range(1, 121))      # repeated keys


def test_cascade_on_keyed_tables(spark, tmpdir_fresh):
    from trove.operators.keyed_table import KeyedTable, cascade
    items = KeyedTable.create(spark, f"{tmpdir_fresh}/i", spark.range(50).select(F.col("id").alias("item_id"), F.lit("t").alias("title")), "item_id", 4)
    reviews = KeyedTable.create(spark, f"{tmpdir_fresh}/r", spark.range(200).select(F.col("id").alias("review_id"), (F.col("id") % 60).alias("item_id")), "review_id", 4)
    keys = spark.createDataFrame([(3,), (3,), (7,), (None,), (999,)], "item_id long")
    cascade(items, reviews, keys, "item_id")
    assert {r.item_id for r in items.read().collect()} == set(range(50)) - {3, 7}
    assert {r.review_id for r in reviews.read().collect()} == {i for i in range(200) if i % 60 not in (3, 7)}
