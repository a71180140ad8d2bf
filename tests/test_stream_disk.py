"""A stream leaves its table behind and nothing of its epochs; merges take some buckets at a time."""

import json
import os

from pyspark.sql import functions as F


def _buckets(path):
    """data/<id>/bucket=<b> that have files."""
    return {os.path.relpath(d, path) for d, _, fs in os.walk(os.path.join(path, "data")) if any(f.endswith(".parquet") for f in fs) and "bucket=" in d}


def _live(table):
    s = table.state()
    return {f"{f}/bucket={b}" for b, f in s.base.items()} | {f"{f}/bucket={b}" for b, xs in s.changes.items() for _, f in xs}


def test_epochs_leave_the_table_only(spark, tmpdir_fresh):
    from trove.operators.keyed_table import KeyedTable
    from trove.session import checkpoint_dir
    from trove.streaming.upsert import latest_version, stream_upsert
    src, target = os.path.join(tmpdir_fresh, "in"), os.path.join(tmpdir_fresh, "items")
    os.makedirs(src)
    for n in range(11):
        with open(os.path.join(src, f"{n:02d}"), "w") as f:
            f.write("".join(json.dumps({"id": i, "title": f"t{n}", "description": "d" * i}) + "\n" for i in range(1 + n, 40 + n)))
        os.utime(f.name, (1_700_000_000 + n,) * 2)                      # files come by their times
    before = set(os.listdir(checkpoint_dir(spark)))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = spark.conf.get(name, None)
    stream_upsert(spark, src, target, checkpoint=os.path.join(tmpdir_fresh, "ck"), max_files_per_trigger=1, buckets=2, keep_s=-1).awaitTermination(240)
    assert spark.conf.get(name, None) == conf
    assert set(os.listdir(checkpoint_dir(spark))) == before             # no lines or merged changes of an epoch
    table = KeyedTable(spark, target)
    assert table.state().base and _buckets(target) == _live(table)      # what was merged is gone
    got = {r.item_id: (r.title, r.n) for r in latest_version(spark, target).select("item_id", "title", F.length("description").alias("n")).collect()}
    assert got == {i: (f"t{min(i - 1, 10)}", i) for i in range(1, 50)}
    some = latest_version(spark, target, ["title"])
    assert some.columns == ["item_id", "title"] and {r.item_id: r.title for r in some.collect()} == {i: t for i, (t, _) in got.items()}


def test_merge_by_lots_of_buckets(spark, tmpdir_fresh, monkeypatch):
    from trove.operators import keyed_table as K
    rows = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("a"), F.lit(1).alias("b"))
    t = K.KeyedTable.create(spark, f"{tmpdir_fresh}/t", rows, "k", 4)
    t.append(spark.range(50, 120).select(F.col("id").alias("k"), F.lit("new").alias("a")), ["a"])
    t.append(spark.range(0, 10).select(F.col("id").alias("k")), delete=True)
    want = sorted(tuple(r) for r in t.read().collect())
    monkeypatch.setattr(K, "MERGE_BYTES", 1)
    number, most = t.state().number, []
    merged = t._merged
    t._merged = lambda state, buckets: merged(state, most.append(len(buckets)) or buckets)
    assert t.compact(range(4), keep_s=-1) == [0, 1, 2, 3] and most == [1, 1, 1, 1] and t.state().number == number + 4
    t._merged = merged
    assert not t.state().changes and _buckets(t.path) == _live(t) and len(_live(t)) == 4
    assert sorted(tuple(r) for r in t.read().collect()) == want and len(want) == 110
    assert {tuple(r) for r in t.read(["b"]).collect()} == {(k, b) for k, _, b in want}
