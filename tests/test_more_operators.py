import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trove.operators import catalogue as CAT
from trove.operators import knn as K
from trove.operators import models as M
from trove.operators import tables as TB
from trove.operators import verify as V
from trove.operators.sizing import hash_slices
from trove.sources import jsonl as J


def test_enforce_schema_quarantines_null_title(spark):
    df = spark.createDataFrame([(1, "a", "7.5"), (2, None, "x"), (None, "c", None)],
                               "item_id long, title string, score string")
    ok, bad = V.enforce_schema(df, V.ITEMS_SCHEMA)
    assert [r["item_id"] for r in ok.collect()] == [1]
    assert ok.first()["score"] == 7.5 and ok.first()["created_at"] is not None
    assert sorted(r["reason"] for r in bad.collect()) == ["item_id is null", "title is null"]


def test_verify_copy_flags_mismatch(spark):
    items = spark.createDataFrame([(1, "u", ["s"]), (2, None, None)], "item_id long, cover_url string, screenshot_urls array<string>")
    reviews = spark.createDataFrame([(1, 1)], "review_id long, item_id long")
    res = {r["metric"]: r for r in V.verify_copy(items, reviews, items.limit(1), reviews).collect()}
    assert res["items"]["match"] is False and res["reviews"]["match"] is True


def test_read_query_params(spark):
    raw = spark.createDataFrame([(1, "  cats ", "All", "", "7", "0", "TRUE"), (2, "  ", "PC", "RPG", "x", "1999", None)],
                                "query_id long, q string, platform string, genre string, score string, year string, scored_only string")
    got = {r["query_id"]: r for r in J.read_query_params(raw).collect()}
    assert got[1]["text"] == "cats" and got[1]["platform"] is None and got[1]["genre"] is None
    assert got[1]["min_score"] == 7.0 and got[1]["min_year"] is None and got[1]["scored_only"] is True
    assert got[2]["error"] == "Query parameter is required" and got[2]["min_score"] is None and got[2]["min_year"] == 1999


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_knn_other_metrics(spark, metric):
    rng = np.random.default_rng(5)
    C = rng.standard_normal((60, 4)).astype(np.float32)
    Q = rng.standard_normal((3, 4)).astype(np.float32)
    corpus = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(C)], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(Q)], "query_id long, embedding array<float>")
    got = K.knn(q, corpus, 5, metric=metric).collect()
    Cd, Qd = C.astype(np.float64), Q.astype(np.float64)
    for qi in range(3):
        if metric == "cosine":
            d = 1 - (Cd @ Qd[qi]) / (np.linalg.norm(Cd, axis=1) * np.linalg.norm(Qd[qi]))
        elif metric == "ip":
            d = 1 - Cd @ Qd[qi]
        else:
            d = np.sqrt(((Cd - Qd[qi]) ** 2).sum(1))
        want = sorted(range(60), key=lambda j: (round(d[j], 12), str(j)))[:5]
        rows = sorted([r for r in got if r["query_id"] == qi], key=lambda r: r["rank"])
        assert [r["vec_id"] for r in rows] == [str(j) for j in want]


def test_items_with_reviews_edges(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    reviews = spark.createDataFrame([(20, 1, "b"), (10, 1, "a"), (30, 1, None)], "review_id long, item_id long, citation string")
    got = {r["item_id"]: r for r in CAT.items_with_reviews(items, reviews).collect()}
    assert got[1]["review_count"] == 3 and got[1]["reviews_concat"] == "a | b"
    assert got[1]["reviews_array"] == ["a", "b", None]
    assert got[2]["review_count"] == 0 and got[2]["reviews_concat"] is None and got[2]["reviews_array"] == []


def test_encode_text_default(spark):
    df = spark.createDataFrame([(1, "cat cat dog"), (2, ""), (3, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in M.encode_text_batch(df, "id", "t").collect()}
    assert len(got) == 3 and all(len(v) == 64 for v in got.values())
    assert math.isclose(sum(x * x for x in got[1]), 1.0, rel_tol=1e-9)
    assert sum(abs(x) for x in got[2]) == 0 and sum(abs(x) for x in got[3]) == 0


def test_rerank_default_and_logits(spark):
    df = spark.createDataFrame([("Red Dragon", "a dragon story in red"), ("", "x"), ("zebra", "none here")], "q string, p string")
    got = [r[0] for r in df.select(M.rerank_default(F.col("q"), F.col("p"))).collect()]
    assert got == [1.0, 0.0, 0.0]
    assert np.allclose(M.logits_to_score(np.array([0.0])), [0.5])
    assert np.allclose(M.logits_to_score(np.array([[0.0, 0.0], [0.0, np.log(3)]])), [0.5, 0.75])


def test_upsert_last_wins_in_source(spark):
    t = spark.createDataFrame([(1, "a")], "id long, title string")
    s = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, title string, ord int")
    assert TB.upsert(t, s, "id", ["title"], order="ord").first()["title"] == "y"


def test_hash_slices_partition_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "query_id")
    parts = hash_slices(df, "query_id", 4)
    ids = sorted(r[0] for p in parts for r in p.collect())
    assert ids == list(range(1000))


def test_review_positions_hot_item(spark):
    # one item holds most reviews and is spread over many partitions
    hot = [(i, 7, f"r{i}") for i in range(2000)]
    cold = [(5000 + i, i % 3, " " if i == 1 else f"c{i}") for i in range(6)]
    df = spark.createDataFrame(hot + cold, "review_id long, item_id long, citation string").repartition(9)
    pos = {(r["item_id"], r["review_id"]): r["position"] for r in CAT.review_positions(df).collect()}
    assert all(pos[(7, i)] == i + 1 for i in range(2000))
    ex = CAT.explode_reviews(df).where("item_id = 1").collect()
    # item 1 has reviews 5001 (blank, dropped) and 5004: the second keeps position 2
    assert [(r["source"], r["review"]) for r in ex] == [("Critic 2", "c4")]
