import numpy as np
import pytest
from pyspark.sql import functions as F

from trove.functions.filters import Filters
from trove.operators import knn as K
from trove.plans import search as SE


def vec_df(spark, rows, id_name="vec_id"):
    return spark.createDataFrame([(str(i) if id_name == "vec_id" else i, [float(x) for x in v]) for i, v in rows],
                                 f"{id_name} {'string' if id_name == 'vec_id' else 'long'}, embedding array<float>")


def brute(Q, C, cids, k):
    out = {}
    for qi, q in enumerate(Q):
        d = ((C.astype(np.float64) - q.astype(np.float64)) ** 2).sum(1)
        order = sorted(range(len(C)), key=lambda j: (d[j], cids[j]))[:k]
        out[qi] = [(cids[j], round(d[j], 9)) for j in order]
    return out


@pytest.mark.parametrize("slices", [None, 3])
def test_exact_knn_matches_brute_force(spark, slices):
    rng = np.random.default_rng(1)
    C = rng.standard_normal((300, 8)).astype(np.float32)
    C[10] = C[20]          # exact duplicate vectors: tie broken by id
    Q = rng.standard_normal((7, 8)).astype(np.float32)
    Q[0] = C[10]           # a query at distance 0
    cids = [str(i) for i in range(len(C))]
    corpus = vec_df(spark, list(enumerate(C))).repartition(5)
    queries = vec_df(spark, list(enumerate(Q)), "query_id")
    kw = {"tile_rows": slices, "block_rows": 40} if slices else {}
    got = K.knn(queries, corpus, 12, **kw).collect()
    want = brute(Q, C, cids, 12)
    for qi in range(len(Q)):
        rows = sorted([r for r in got if r["query_id"] == qi], key=lambda r: r["rank"])
        assert [(r["vec_id"], round(r["dist"], 9)) for r in rows] == want[qi]


def test_knn_k_larger_than_corpus_and_dim_check(spark):
    corpus = vec_df(spark, [(0, [0, 0]), (1, [1, 0])])
    q = vec_df(spark, [(5, [0, 0])], "query_id")
    assert K.knn(q, corpus, 10).count() == 2
    bad = vec_df(spark, [(0, [0, 0, 1])])
    with pytest.raises(Exception) as e:
        K.knn(q, bad, 1).collect()
    assert "length" in str(e.value)


def test_similarity_relative_all_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.0), (2, 2.0)], "query_id long, dist double")
    got = sorted((r[0], r[1]) for r in df.select("query_id", K.similarity_relative(F.col("dist"))).collect())
    assert got == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0)]


def test_knn_approx_recall(spark):
    rng = np.random.default_rng(3)
    C = rng.standard_normal((400, 16)).astype(np.float32)
    Q = (C[:20] + 0.01 * rng.standard_normal((20, 16))).astype(np.float32)
    corpus = vec_df(spark, list(enumerate(C)))
    queries = vec_df(spark, list(enumerate(Q)), "query_id")
    exact = {(r["query_id"], r["vec_id"]) for r in K.knn(queries, corpus, 5).collect()}
    approx = {(r["query_id"], r["vec_id"]) for r in K.knn_approx(queries, corpus, 5, dim=16, bits=3).collect()}
    recall = len(exact & approx) / len(exact)
    assert recall >= 0.5


def catalogue(spark):
    items = spark.createDataFrame([
        (1, "A", "same text", 8.0, ["PC"], ["Action"]),
        (2, "B", "same text", 6.0, ["PC"], ["Action"]),
        (3, "C", "dragon story", None, ["Mac"], ["RPG"]),
        (4, "D", "cat cafe", 9.0, ["PC", "Mac"], ["Sim"]),
    ], "item_id long, title string, description string, score double, platforms array<string>, genres array<string>")
    items = items.select("*", F.lit(None).cast("date").alias("release_date"), F.array().cast("array<string>").alias("developers"),
                         F.array().cast("array<string>").alias("publishers"), F.lit(None).cast("string").alias("cover_url"),
                         F.lit(None).cast("array<string>").alias("screenshot_urls"))
    vecs = spark.createDataFrame([
        ("1", 1, None, "description", [0.0, 0.0]), ("2", 2, None, "description", [0.1, 0.0]),
        ("3", 3, None, "description", [1.0, 1.0]), ("4", 4, None, "description", [0.0, 0.2]),
        ("9", 9, None, "description", [0.05, 0.05]),   # no catalogue entry: drops out
    ], "vec_id string, item_id long, review_id long, modality string, embedding array<float>")
    reviews = spark.createDataFrame([(10, 1, "great"), (11, 1, " "), (12, 4, "nice")],
                                    "review_id long, item_id long, citation string")
    return items, vecs, reviews


def test_semantic_search_quirks(spark):
    items, vecs, reviews = catalogue(spark)
    q = spark.createDataFrame([(100, "same", [0.0, 0.0])], "query_id long, text string, embedding array<float>")
    res = SE.semantic_search(items, reviews, vecs, q, k=3).collect()
    ids = [r["item_id"] for r in sorted(res, key=lambda r: r["rank"])]
    # both items sharing a description are returned once each (joined back by id)
    assert 1 in ids and 2 in ids and len(ids) == len(set(ids)) <= 3
    assert all(0.0 <= r["relevance_score"] <= 1.0 for r in res)
    one = SE.semantic_search(items, reviews, vecs, q, k=1, fetch_factor=1).collect()
    assert len(one) == 1 and one[0]["relevance_score"] > 0  # single candidate is still fused


def test_pre_filter_contains_post(spark):
    items, vecs, reviews = catalogue(spark)
    q = spark.createDataFrame([(100, "x", [0.0, 0.0])], "query_id long, text string, embedding array<float>")
    f = Filters(platform="Mac")
    post = {r["item_id"] for r in SE.semantic_search(items, reviews, vecs, q, k=2, filters=f).collect()}
    pre = {r["item_id"] for r in SE.semantic_search(items, reviews, vecs, q, k=2, filters=f, filter_mode="pre").collect()}
    assert post <= pre and pre == {3, 4}


def test_rerank_fallback_keeps_vector_order(spark):
    items, vecs, reviews = catalogue(spark)
    q = spark.createDataFrame([(100, "x", [0.0, 0.0])], "query_id long, text string, embedding array<float>")

    def broken(a, b):
        raise RuntimeError("down")
    res = SE.semantic_search(items, reviews, vecs, q, k=4, scorer=broken).collect()
    for r in res:
        assert r["relevance_score"] is not None


def test_keyword_search_reviews_and_order(spark):
    items, _, reviews = catalogue(spark)
    q = spark.createDataFrame([(1, "same"), (2, "zzz")], "query_id long, text string")
    res = sorted(SE.keyword_search(items, reviews, q).collect(), key=lambda r: r["rank"])
    assert [r["item_id"] for r in res] == [1, 2]
    assert [x["source"] for x in res[0]["reviews"]] == ["Critic 1"]
    assert res[0]["review_count"] == 2


def test_knn_approx_splits_hot_bucket(spark):
    # every vector points the same way (one bucket); tiny groups force many salts
    rng = np.random.default_rng(9)
    C = (np.abs(rng.standard_normal((300, 6))) + 5.0).astype(np.float32)
    Q = C[:5] + 0.001
    corpus = vec_df(spark, list(enumerate(C)))
    queries = vec_df(spark, list(enumerate(Q)), "query_id")
    exact = {(r["query_id"], r["vec_id"]) for r in K.knn(queries, corpus, 4).collect()}
    approx = {(r["query_id"], r["vec_id"]) for r in
              K.knn_approx(queries, corpus, 4, dim=6, bits=4, max_group_rows=25).collect()}
    assert approx == exact


def test_knn_by_column_meets_only_its_group(spark):
    rng = np.random.default_rng(5)
    C = rng.standard_normal((60, 4)).astype(np.float32)
    corpus = vec_df(spark, list(enumerate(C))).withColumn(
        "kind", F.when(F.col("vec_id").cast("int") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")))
    q = vec_df(spark, [(0, C[0]), (1, C[1])], "query_id").withColumn(
        "kind", F.when(F.col("query_id") == 0, F.lit("odd")).otherwise(F.lit("even")))
    got = K.knn(q, corpus, 3, by="kind", block_rows=7, tile_rows=1).collect()
    for qi, parity in ((0, 1), (1, 0)):
        ids = [i for i in range(60) if i % 2 == parity]
        want = brute([C[qi]], C[ids], [str(i) for i in ids], 3)[0]
        rows = sorted((r for r in got if r["query_id"] == qi), key=lambda r: r["rank"])
        assert [(r["vec_id"], round(r["dist"], 9)) for r in rows] == want


def test_knn_string_query_ids_and_empty_sides(spark):
    corpus = vec_df(spark, [(0, [0, 0]), (1, [1, 0])])
    q = spark.createDataFrame([("a", [0.9, 0.0])], "query_id string, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in K.knn(q, corpus, 1).collect()] == [("a", "1")]
    assert K.knn(q.limit(0), corpus, 1).count() == 0
    assert K.knn(q, corpus.limit(0), 1).count() == 0
    assert K.knn_approx(q, corpus.limit(0), 1, dim=2).count() == 0


@pytest.mark.parametrize("n, spread", [(6_000, 0.15), (24_000, 0.15), (24_000, 0.5), (24_000, None)])
def test_knn_approx_recall_holds_as_the_corpus_grows(spark, monkeypatch, n, spread):
    rng = np.random.default_rng(n)
    if spread:                                                    # groups of 30 around centres of their own
        centres = rng.standard_normal((n // 30, 64))
        draw = lambda m: centres[rng.integers(0, len(centres), m)] + spread * rng.standard_normal((m, 64))
    else:                                                         # no structure at all
        draw = lambda m: rng.standard_normal((m, 64))
    C, Q = draw(n).astype(np.float32), draw(400).astype(np.float32)
    corpus = vec_df(spark, list(enumerate(C)))
    queries = vec_df(spark, list(enumerate(Q)), "query_id")
    used = []
    inner = K._measured_probes
    monkeypatch.setattr(K, "_measured_probes", lambda *a, **kw: used.append((inner(*a, **kw), len(a[3]))) or used[-1][0])
    got = {(r["query_id"], int(r["vec_id"])) for r in K.knn_approx(queries, corpus, 10, dim=64).collect()}
    dist = (C.astype(float) ** 2).sum(1)[None] - 2 * Q.astype(float) @ C.astype(float).T
    true = {(q, int(i)) for q, row in enumerate(np.argpartition(dist, 10, axis=1)[:, :10]) for i in row}
    recall = len(got & true) / len(true)
    (probes, bits), = used
    share = None if probes is None else sum(K.math.comb(bits, r) for r in range(probes + 1)) / 2 ** bits
    print(f"n {n}, spread {spread}: {bits} bits, probes {probes}, buckets visited {share}, recall {recall:.3f}")
    assert recall >= 0.9 and len(got) == 4_000
    if spread == 0.15:
        assert share < 0.4
    else:                                                         # neighbours lie all over the buckets: exact search
        assert share is None and recall == 1


def test_knn_approx_lists_are_never_short(spark):
    rng = np.random.default_rng(8)
    C = rng.standard_normal((200, 8)).astype(np.float32)
    corpus = vec_df(spark, list(enumerate(C)))
    q = vec_df(spark, list(enumerate(C[:15] * -1.0)), "query_id")
    got = K.knn_approx(q, corpus, 12, dim=8, bits=7, probes=0, tile_rows=4).groupBy("query_id").count().collect()
    assert len(got) == 15 and all(r["count"] == 12 for r in got)


def test_search_encodes_texts_and_types_per_row(spark):
    items, _, reviews = catalogue(spark)
    from trove.operators.models import with_text_embedding
    vecs = with_text_embedding(items.select(F.col("item_id").cast("string").alias("vec_id"), "item_id",
                                            F.lit("description").alias("modality"), "description"), "description")
    q = spark.createDataFrame([(7, "dragon"), (8, None)], "query_id long, text string")
    res = SE.semantic_search(items, reviews, vecs, q, k=2).collect()
    assert [r["item_id"] for r in sorted(res, key=lambda r: r["rank"]) if r["query_id"] == 7][0] == 3
    covers = spark.createDataFrame([("1", 1, "cover", [0.0, 0.0]), ("2", 2, "screenshot", [0.0, 0.0])],
                                   "vec_id string, item_id long, modality string, embedding array<float>")
    q = spark.createDataFrame([(1, "covers", [0.0, 1.0]), (2, "screenshots", [0.0, 1.0])],
                              "query_id long, search_type string, embedding array<float>")
    res = SE.image_search(items, covers, q, search_type=None).collect()
    assert {(r["query_id"], r["item_id"]) for r in res} == {(1, 1), (2, 2)}
    with pytest.raises(Exception):
        SE.image_search(items, covers, q.withColumn("search_type", F.lit("x")), search_type=None).collect()


def test_first_reviews_and_ranks_of_a_hot_key(spark):
    from trove.operators import catalogue as CAT
    reviews = spark.createDataFrame([(i, 1, None if i % 3 == 0 else f"r{i}") for i in range(30)] + [(99, 2, " ")],
                                    "review_id long, item_id long, citation string")
    rows = CAT.first_reviews(reviews, 3).collect()
    assert [(r["item_id"], [(x["source"], x["review"]) for x in r["reviews"]]) for r in rows] == \
        [(1, [("Critic 2", "r1"), ("Critic 3", "r2"), ("Critic 5", "r4")])]
    pos = CAT.rank_results(reviews, [F.col("review_id").desc()], key="item_id").collect()
    assert {r["rank"] for r in pos if r["item_id"] == 1} == set(range(1, 31))


def test_display_score_rounds_the_binary_value(spark):
    from trove.functions.shape import display_score
    df = spark.createDataFrame([(0.075,), (0.125,), (0.376,)], "x double")
    none = F.lit(None).cast("double")
    got = [r[0] for r in df.select(display_score(F.col("x"), none, none)).collect()]
    assert got == [f"{v:.2f}" for v in (0.075, 0.125, 0.376)]


def test_a_pair_holds_little_beside_its_best_rows():
    """A tile of queries against one Arrow batch, with the long lists of a shortlist: neither the distances of the whole
    batch nor the vectors of all candidates are held at once. Ties across corpus blocks go to the smaller id."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(4)
    Q, X = rng.normal(size=(4096, 16)), rng.normal(size=(10_000, 16))
    X[7000:7300] = X[0]
    names = [f"v{i:05d}" for i in range(len(X))]
    lists = lambda M: pa.array(list(M), pa.list_(pa.float64()))
    queries = pa.record_batch([pa.array(range(len(Q)), pa.int64()), lists(Q)], names=["query_id", "_vec"])
    corpus = pa.record_batch([lists(X), pa.array(names)], names=["_vec", "vec_id"])
    tracemalloc.start()
    pair = K._Pair(160, "vec_id", ["vec_id"], "sqeuclidean")
    pair.add_queries(queries)
    pair.add_corpus(corpus)
    got = pa.Table.from_batches(pair.result())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    for q in (0, 600, 4095):
        d = ((Q[q] - X) ** 2).sum(1)
        want = sorted(zip(d.round(9), names))[:160]
        own = got.filter(pa.array(got.column("query_id").to_numpy() == q))
        assert sorted(own.column("vec_id").to_pylist()) == sorted(n for _, n in want)
