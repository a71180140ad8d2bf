"""Searches that go on from a distance, and per-query filters before the fetch,
against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trove.operators import knn as K
from trove.plans import search as SE


def brute(Q, X, after=None):
    out = {}
    for q, v in Q.items():
        d = sorted((float(((np.array(v) - np.array(x)) ** 2).sum()), i) for i, x in X.items())
        out[q] = [p for p in d if after is None or after.get(q) is None or p > after[q]]
    return out


@pytest.mark.parametrize("tile_rows,block_rows", [(4096, 65536), (5, 30)])
def test_knn_goes_on_after_a_distance(spark, tile_rows, block_rows):
    rng = np.random.default_rng(2)
    X = {f"v{i:03d}": np.round(rng.normal(size=3)).tolist() for i in range(150)}            # many ties
    Q = {i: np.round(rng.normal(size=3)).tolist() for i in range(20)}
    corpus = spark.createDataFrame(list(X.items()), "vec_id string, embedding array<double>").repartition(4)
    last, want = {}, brute(Q, X)
    seen = {q: [] for q in Q}
    for size in (3, 10, 40, 200):
        q = spark.createDataFrame([(i, v, *(last.get(i) or (None, None))) for i, v in Q.items()],
                                  "query_id long, embedding array<double>, after_dist double, after_id string")
        for r in K.knn(q, corpus, size, tile_rows=tile_rows, block_rows=block_rows).orderBy("query_id", "rank").collect():
            seen[r.query_id].append((r.dist, r.vec_id))
        last = {i: seen[i][-1] for i in Q}
    assert seen == want


def test_per_query_filters_before_the_fetch(spark, monkeypatch):
    rng = random.Random(3)
    n = 400
    items = spark.createDataFrame([(i, f"t{i}", f"d{i}", rng.choice([["PC"], ["Mac"], ["Wii", "PC"], None]), ["g"], rng.choice([None, 3.0, 8.0]),
                                    rng.choice([None, "1990-01-01", "2005-01-01"])) for i in range(n)],
                                  "item_id long, title string, description string, platforms array<string>, genres array<string>, score double, d string") \
        .withColumn("release_date", F.to_date("d")).drop("d").withColumns({c: F.lit(None).cast("string") for c in ("source_url", "cover_url")}) \
        .withColumns({c: F.lit(None).cast("array<string>") for c in ("developers", "publishers", "screenshot_urls")})
    gen = np.random.default_rng(3)
    X = {f"{i}": gen.normal(size=4).tolist() for i in range(n + 20)}                         # the last have no item
    vectors = spark.createDataFrame([(i, int(i), "description", v) for i, v in X.items()], "vec_id string, item_id long, modality string, embedding array<double>")
    asked = [(0, None, None, None, False), (1, "Mac", None, None, False), (2, "Mac", 5.0, 2000, True), (3, "none", None, None, False),
             (4, None, 8.0, 2000, True), (5, "Wii", None, 2030, False), (6, "", None, 0, True)]
    Q = {q: gen.normal(size=4).tolist() for q, *_ in asked}
    q = spark.createDataFrame([(i, f"q{i}", Q[i], p, None, s, y, o) for i, p, s, y, o in asked],
                              "query_id long, text string, embedding array<double>, platform string, genre string, min_score double, min_year int, scored_only boolean")
    rows = {r.item_id: r for r in items.collect()}

    def passes(item, p, s, y, o):
        r = rows.get(item)
        return r is not None and (not p or p in (r.platforms or [])) and (not y or (r.release_date is not None and r.release_date.year >= y)) and \
            ((not o or r.score is not None) if s is None else (r.score is not None and r.score >= s) or (not o and r.score is None))
    full = brute(Q, X)
    sizes, real = [], K.knn

    def counted(queries, corpus, k, **kw):
        sizes.append((k, queries.count()))
        return real(queries, corpus, k, **kw)
    monkeypatch.setattr(K, "knn", counted)
    got = {}
    for r in SE.filtered_hits(q.select("query_id", "embedding"), vectors, items, q, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.dist, r.vec_id))
    want = {i: [h for h in full[i] if passes(int(h[1]), p, s, y, o)][:6] for i, p, s, y, o in asked}
    ids = lambda found: {i: [v for _, v in h] for i, h in found.items() if h}
    assert ids(got) == ids(want)
    # each round asks for fetch, 4 x fetch, ... and only for queries that are short
    assert [k for k, _ in sizes] == [6 * 4 ** r for r in range(len(sizes))] and len(sizes) <= 5
    assert [m for _, m in sizes] == sorted((m for _, m in sizes), reverse=True) and sizes[0][1] == 7 and sizes[1][1] < 7
    res = SE.semantic_search(items, spark.createDataFrame([], "review_id long, item_id long, citation string"), vectors, q, k=3, filter_mode="pre")
    by = {}
    for r in res.collect():
        by.setdefault(r.query_id, set()).add(r.item_id)
    assert set(by) == {i for i, h in want.items() if h} and all(len(by[i]) == min(3, len(want[i])) and by[i] <= {int(v) for _, v in want[i]} for i in by)
    with pytest.raises(ValueError):
        SE.semantic_search(items, None, vectors, q, filter_mode="sometimes")


def test_narrow_filters_do_not_fetch_every_vector(spark, monkeypatch):
    """Queries that few items satisfy end with a search of what passes: no round asks for more than 4 x fetch."""
    n, fetch = 600, 5
    gen = np.random.default_rng(5)
    items = spark.createDataFrame([(i, ["PC"] if i % 100 == 7 else ["Mac"], ["g"], 1.0) for i in range(n)],
                                  "item_id long, platforms array<string>, genres array<string>, score double").withColumn("release_date", F.lit(None).cast("date"))
    X = {f"{i}": gen.normal(size=4).tolist() for i in range(n)}
    X["8"] = X["7"]
    vectors = spark.createDataFrame([(v, int(v), x) for v, x in X.items()], "vec_id string, item_id long, embedding array<double>")
    asked = [(q, ["PC", "Mac", "none", None][q % 4], None, None, None, False) for q in range(40)]
    Q = {q: gen.normal(size=4).tolist() for q, *_ in asked}
    q = spark.createDataFrame([(*a, Q[a[0]]) for a in asked], "query_id long, platform string, genre string, min_score double, min_year int, scored_only boolean, embedding array<double>")
    sizes, real = [], K.knn

    def counted(queries, corpus, k, **kw):
        sizes.append(k)
        return real(queries, corpus, k, **kw)
    monkeypatch.setattr(K, "knn", counted)
    got = {}
    for r in SE.filtered_hits(q.select("query_id", "embedding"), vectors, items, q, fetch).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    platform = lambda v: "PC" if int(v) % 100 == 7 else "Mac"
    want = {i: [v for _, v in h if asked[i][1] in (None, platform(v))][:fetch] for i, h in brute(Q, X).items()}
    assert got == {i: h for i, h in want.items() if h}
    assert sizes == [fetch, 4 * fetch]
