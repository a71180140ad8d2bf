import json
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from trove.operators import tables as TB
from trove.operators import verify as V
from trove.sources import jsonl as J


def test_upsert_idempotent_and_keeps_other_columns(spark):
    t = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c2")], "id long, title string, cover string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "id long, title string")
    once = TB.upsert(t, s, "id", ["title"])
    twice = TB.upsert(once, s, "id", ["title"])
    a = sorted(tuple(r) for r in once.collect())
    assert a == [(1, "a", "c1"), (2, "B", "c2"), (3, "C", None)]
    assert a == sorted(tuple(r) for r in twice.collect())


def test_insert_ignore_first_wins(spark):
    t = spark.createDataFrame([(1, "a")], "id long, title string")
    s = spark.createDataFrame([(1, "x", 0), (2, "first", 1), (2, "second", 2)], "id long, title string, ord int")
    got = sorted(tuple(r) for r in TB.insert_ignore(t, s, "id", order="ord").collect())
    assert got == [(1, "a"), (2, "first")]


def test_patch_one_kind(spark):
    t = spark.createDataFrame([(1, "old", ["s"])], "item_id long, cover_url string, screenshot_urls array<string>")
    p = spark.createDataFrame([(1, "new", None)], "item_id long, cover_url string, screenshot_urls array<string>")
    r = TB.patch_columns(t, p, "item_id", ["cover_url", "screenshot_urls"]).first()
    assert r["cover_url"] == "new" and r["screenshot_urls"] is None and r["_patched"]
    k = TB.patch_columns(t, p, "item_id", ["cover_url", "screenshot_urls"], keep_existing=True).first()
    assert k["screenshot_urls"] == ["s"]


def test_global_row_number_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    got = TB.global_row_number(df, [F.col("k")], "rn").select("k", "rn")
    want = df.select("k", F.row_number().over(Window.orderBy("k")).alias("rn"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    pages = TB.page_slice(df, [F.col("k")], 100)
    assert pages.agg(F.max("page")).first()[0] == 49


def test_cascade_and_orphans(spark):
    parents = spark.createDataFrame([(1,), (2,)], "item_id long")
    kids = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "review_id long, item_id long")
    keys = spark.createDataFrame([(1,)], "item_id long")
    p, k = TB.cascade_delete(parents, kids, keys, "item_id", "item_id")
    assert [r[0] for r in p.collect()] == [2] and sorted(r["review_id"] for r in k.collect()) == [11, 12]
    ok, orphans = V.quarantine_orphans(kids, parents, "item_id", "item_id")
    assert ok.count() + orphans.count() == kids.count() and [r["review_id"] for r in orphans.collect()] == [12]


def write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_catalogue_reader_files(spark, tmpdir_fresh):
    write(tmpdir_fresh, "a.jsonl", [json.dumps({"id": 1, "title": " One ", "moby_score": "7.5",
                                                "platforms": "PC", "release_date": "2/13/1999"}),
                                    "{broken", "", json.dumps({"id": 0, "title": "zero"}),
                                    json.dumps({"id": 2, "title": "Two", "moby_score": ""})])
    write(tmpdir_fresh, "b.jsonl", [json.dumps({"id": 1, "title": "One again", "platforms": ["PC", " ", "Mac"]})])
    lines = J.read_lines(spark, tmpdir_fresh)
    rec, bad = J.read_catalogue_jsonl(lines)
    got = {r["item_id"]: r for r in J.prepare_items(rec).collect()}
    assert got[1]["title"] == "One again" and got[1]["platforms"] == ["PC", "Mac"]
    assert got[2]["score"] is None
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["bad_json", "missing_id"]
    counts = J.count_input_lines(lines).first()
    assert counts["lines"] == 6 and counts["non_blank"] == 5
    superseded = 1  # id 1 occurs on two lines; the last wins
    assert len(got) + len(reasons) + superseded == counts["non_blank"]


def test_reviews_outcomes(spark):
    lines = spark.createDataFrame([
        (1, json.dumps({"review_id": 5, "game_id": 1, "citation": "<p>ok</p>"})),
        (2, json.dumps({"review_id": "x5", "game_id": 1, "citation": "bad id"})),
        (3, json.dumps({"review_id": 6, "game_id": 0, "citation": "no game"})),
        (4, json.dumps({"review_id": 7, "game_id": 1, "citation": "<br>"})),
        (5, "not json"), (6, "   ")], "line_no long, value string")
    r = {row["line_no"]: row for row in J.read_reviews_jsonl(lines).collect()}
    assert r[1]["outcome"] == "accepted" and r[1]["citation"] == "ok"
    assert r[2]["outcome"] == "failed" and r[3]["outcome"] == "skipped" and r[4]["outcome"] == "skipped"
    assert r[5]["reason"] == "bad_json" and 6 not in r
    st = V.ingest_outcome_stats(J.read_reviews_jsonl(lines)).first()
    assert (st["total"], st["successful"], st["failed"], st["skipped"]) == (5, 1, 1, 3)


def test_scan_asset_inventory(spark, tmpdir_fresh):
    for rel in ["12/cover.jpg", "12/screenshot_2.jpg", "12/screenshot_1.jpg", "abc/cover.jpg", "13/notes.txt"]:
        p = os.path.join(tmpdir_fresh, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        open(p, "wb").write(b"x")
    inv = {r["item_id"]: r for r in J.scan_asset_inventory(spark, tmpdir_fresh).collect()}
    assert list(inv) == [12]
    assert inv[12]["cover_path"].endswith("12/cover.jpg")
    assert [p.rsplit("/", 1)[1] for p in inv[12]["screenshot_paths"]] == ["screenshot_1.jpg", "screenshot_2.jpg"]


def test_upsert_both_plans_agree(spark):
    t = spark.createDataFrame([(i, f"t{i}", f"c{i}") for i in range(50)], "id long, title string, cover string")
    s = spark.createDataFrame([(i, f"new{i}") for i in range(40, 60)], "id long, title string")
    small = sorted(tuple(r) for r in TB.upsert(t, s, "id", ["title"]).collect())
    big = sorted(tuple(r) for r in TB.upsert(t, s, "id", ["title"], broadcast_rows=0).collect())
    assert small == big and len(small) == 60


def test_one_page_matches_page_slice(spark):
    df = spark.range(0, 250).select((F.col("id") * 37 % 251).alias("k"))
    page2 = [r["k"] for r in TB.one_page(df, [F.col("k")], 100, 2).collect()]
    sliced = TB.page_slice(df, [F.col("k")], 100).where("page = 2").orderBy("pos_in_page")
    assert page2 == [r["k"] for r in sliced.collect()] and len(page2) == 50


def test_observe_outcomes_live_metrics(spark):
    lines = spark.createDataFrame([(1, json.dumps({"review_id": 5, "game_id": 1, "citation": "ok"})),
                                   (2, "not json")], "line_no long, value string")
    df, obs = V.observe_outcomes(J.read_reviews_jsonl(lines))
    df.write.format("noop").mode("overwrite").save()
    m = obs.get
    assert (m["total"], m["successful"], m["skipped"]) == (2, 1, 1)


def test_cut_lineage_computes_once(spark):
    from trove.session import cut_lineage
    acc = spark.sparkContext.accumulator(0)

    def count_rows(it):
        for pdf in it:
            acc.add(len(pdf))
            yield pdf

    df = spark.range(0, 1000, numPartitions=4).mapInPandas(count_rows, "id long")
    cp = cut_lineage(df)
    assert cp.count() == 1000 and cp.where("id < 10").count() == 10
    assert acc.value == 1000   # computed once: not again for the checkpoint write or later reads
