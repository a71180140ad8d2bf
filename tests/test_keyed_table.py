"""Keyed tables and the stream on them: merges against a plain dictionary,
what is written, replays, and writers that meet."""

import json
import os
import random

from pyspark.sql import functions as F


def files(path):
    return {os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(os.path.join(path, "data")) for n in names if n.endswith(".parquet")}


def bucket_files(table):
    s = table.state()
    return {b: sorted(os.listdir(f"{table.path}/{f}/bucket={b}")) for b, f in s.base.items()}


def make(spark, path, rows=400, buckets=8):
    from trove.operators.keyed_table import KeyedTable
    df = spark.range(rows).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("a"), F.lit(1).alias("b"))
    return KeyedTable.create(spark, path, df, "k", buckets)


def test_changes_against_a_dictionary(spark, tmpdir_fresh, monkeypatch):
    from trove.operators import keyed_table as op
    monkeypatch.setattr(op, "SNAPSHOT", 4)
    rng = random.Random(1)
    t = make(spark, f"{tmpdir_fresh}/t", rows=60)
    want = {i: (f"v{i}", 1) for i in range(60)}
    for step in range(14):
        keys = rng.sample(range(90), 12)
        kind = rng.choice(["a", "b", "ab", "gone"])
        if kind == "gone":
            t.append(spark.createDataFrame([(k,) for k in keys], "k long"), delete=True)
            for k in keys:
                want.pop(k, None)
        else:
            rows = [(k, rng.choice([None, f"s{step}"]), step) for k in keys]
            t.append(spark.createDataFrame(rows, "k long, a string, b int"), list(kind))
            for k, a, b in rows:
                old = want.get(k, (None, None))
                want[k] = (a if "a" in kind else old[0], b if "b" in kind else old[1])
        if step == 8:
            t.compact([0, 3, 5])
        if step == 11:
            t.compact(range(8))
            assert not t.state().changes
        if step % 5 == 3 or step > 10:
            assert {r.k: (r.a, r.b) for r in t.read().collect()} == want
    assert t.read().count() == len(want)


def test_only_touched_buckets_are_written(spark, tmpdir_fresh):
    t = make(spark, f"{tmpdir_fresh}/t")
    before = bucket_files(t)
    t.append(spark.createDataFrame([(7, "x")], "k long, a string"), ["a"])
    (touched,) = t.state().changes
    assert t.compact([touched]) == [touched]
    after = bucket_files(t)
    assert {b for b in after if after[b] != before[b]} == {touched}
    assert t.read().where("k = 7").first().a == "x" and t.read().count() == 400
    assert t.compact() == []


def test_base_is_not_shuffled(spark, tmpdir_fresh):
    """Base files reach the result through broadcast joins only."""
    t = make(spark, f"{tmpdir_fresh}/t")
    t.append(spark.createDataFrame([(7, "x"), (1000, "y")], "k long, a string"), ["a"])
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("LeftAnti")[0]
    assert "BroadcastHashJoin [k" in kept and "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "hashpartitioning" not in plan


def test_changes_beyond_the_broadcast_bound_go_in_groups(spark, tmpdir_fresh, monkeypatch):
    from trove.operators import keyed_table as op
    t = make(spark, f"{tmpdir_fresh}/t")
    t.append(spark.range(100, 500).select(F.col("id").alias("k"), F.lit("g").alias("a")), ["a"])
    monkeypatch.setattr(op, "slice_count", lambda size: 3)
    got = {r.k: (r.a, r.b) for r in t.read().collect()}
    assert got == {**{i: (f"v{i}", 1) for i in range(100)}, **{i: ("g", 1) for i in range(100, 400)}, **{i: ("g", None) for i in range(400, 500)}}


def test_writers_that_meet(spark, tmpdir_fresh):
    """The same epoch is applied once; a taken number is passed over; a base
    that another writer has merged meanwhile is left alone."""
    t = make(spark, f"{tmpdir_fresh}/t", rows=20, buckets=2)
    row = lambda k, a: spark.createDataFrame([(k, a)], "k long, a string")
    assert t.append(row(1, "x"), ["a"], stream="s", epoch=0) is not None
    assert t.append(row(1, "y"), ["a"], stream="s", epoch=0) is None
    assert t.append(row(2, "y"), ["a"], stream="other", epoch=0) is not None
    claim, raced = t._claim, []

    def race(number, entry):
        if not raced:
            raced.append(claim(number, {"kind": "change", "folder": "data/none", "buckets": [], "stream": "third", "epoch": 4}))
        return claim(number, entry)
    t._claim = race
    n = t.append(row(3, "z"), ["a"])
    assert raced == [True] and n == t.state().number and t.state().epochs == {"s": 0, "other": 0, "third": 4}
    t._claim = claim
    assert {r.k: r.a for r in t.read().where("k < 4").collect()} == {0: "v0", 1: "x", 2: "y", 3: "z"}
    merged = t._merged

    def overtaken(state, buckets):
        t._merged = merged
        assert t.compact(buckets) != []
        return merged(state, buckets)
    t._merged = overtaken
    assert t.compact(list(t.state().changes)) == []
    assert {r.k: r.a for r in t.read().where("k < 4").collect()} == {0: "v0", 1: "x", 2: "y", 3: "z"}
    old = files(t.path)
    gone = t.vacuum(older_than_s=-1)
    assert gone and files(t.path) < old and t.read().count() == 20


def test_stream_writes_its_batch_only_and_replays(spark, tmpdir_fresh):
    from trove.operators.keyed_table import KeyedTable
    from trove.streaming.upsert import latest_version, stream_upsert
    src, target, bad = (os.path.join(tmpdir_fresh, x) for x in ("in", "items", "bad"))
    os.makedirs(src)

    def lot(name, lines):
        with open(os.path.join(src, name), "w") as f:
            f.write("\n".join(lines) + "\n")

    def run(checkpoint):
        stream_upsert(spark, src, target, checkpoint=os.path.join(tmpdir_fresh, checkpoint), quarantine_path=bad, buckets=4).awaitTermination(120)
    lot("1", [json.dumps({"id": i, "title": f"t{i}", "description": "long " * 200}) for i in range(1, 800)])
    run("a")
    size = {f: os.path.getsize(os.path.join(target, f)) for f in files(target)}
    lot("2", [json.dumps({"id": 5, "title": "new"}), "broken", json.dumps({"id": 2000, "title": "more"})])
    run("a")
    added = {f for f in files(target) if f not in size}
    assert set(size) <= files(target) and sum(os.path.getsize(os.path.join(target, f)) for f in added) < 20_000
    assert spark.read.parquet(bad).count() == 1
    assert {r.item_id: r.title for r in latest_version(spark, target).where("item_id in (5, 6, 2000)").collect()} == {5: "new", 6: "t6", 2000: "more"}
    # a second stream starts again at epoch 0 and reads both lots
    run("b")
    assert len(KeyedTable(spark, target).state().epochs) == 2 and latest_version(spark, target).count() == 800
    # a commit that the checkpoint has forgotten is replayed without effect
    number = KeyedTable(spark, target).state().number
    for name in os.listdir(os.path.join(tmpdir_fresh, "a", "commits")):
        if name.strip(".").startswith("1"):
            os.remove(os.path.join(tmpdir_fresh, "a", "commits", name))
    run("a")
    assert KeyedTable(spark, target).state().number == number
    assert spark.read.parquet(bad).count() == 2     # one of each stream


def test_empty_table(spark, tmpdir_fresh):
    from trove.operators.keyed_table import KeyedTable
    t = KeyedTable.create(spark, f"{tmpdir_fresh}/t", spark.range(0).select(F.col("id").alias("k"), F.lit("").alias("a")), "k", 4)
    assert t.read().count() == 0
    t.append(spark.createDataFrame([], "k long, a string"), ["a"])
    assert t.read().count() == 0 and t.read().columns == ["k", "a"]


def test_changes_of_long_texts_are_not_broadcast(spark, tmpdir_fresh):
    """What a change weighs counts, not its number of rows: beyond the bound nothing of it passes through the driver."""
    t = make(spark, f"{tmpdir_fresh}/t", rows=60)
    long = F.repeat(F.lit("x"), F.lit(1 << 20))
    t.append(spark.range(20, 100).select(F.col("id").alias("k"), long.alias("a")), ["a"])
    t.append(spark.range(25, 30).select(F.col("id").alias("k")), delete=True)
    out = t.read()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.n, r.b) for r in out.select("k", F.length("a").alias("n"), "b").collect()}
    assert got == {**{i: (len(f"v{i}"), 1) for i in range(20)}, **{i: (1 << 20, 1) for i in range(20, 60) if not 25 <= i < 30},
                   **{i: (1 << 20, None) for i in range(60, 100)}}


def test_structs_are_measured_with_their_texts(spark):
    from trove.operators.sizing import measure
    df = spark.range(10).select(F.struct(F.repeat(F.lit("x"), F.lit(1000)).alias("v"), F.lit(None).cast("string").alias("w")).alias("s"))
    assert measure(df).rows == 10 and measure(df).bytes >= 10_000
