"""Product quantiser against a brute-force version of its rule, and its recall."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F


def vectors(seed, n, dim):
    X = np.random.default_rng(seed).normal(size=(n, dim))
    return X / np.linalg.norm(X, axis=1)[:, None]


def frame(spark, X, name, first=0):
    return spark.createDataFrame([(str(i + first) if name == "vec_id" else i + first, x.tolist()) for i, x in enumerate(X)],
                                 f"{name} {'string' if name == 'vec_id' else 'long'}, embedding array<double>")


def rule(ids, X, Q, k, keep, words, rounds, sample):
    """The stated rule, word by word."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(ids[i].encode()).hexdigest(), ids[i]))[:sample]
    recon = np.empty_like(X)
    for at in range(0, X.shape[1], 2):
        S, A = X[order][:, at:at + 2], X[:, at:at + 2]
        C = [list(c) for c in S[:words]]
        nearest = lambda p: min(range(len(C)), key=lambda w: (sum((a - b) ** 2 for a, b in zip(p, C[w])), w))
        for _ in range(rounds):
            own = [nearest(p) for p in S]
            C = [[round(float(np.mean([p[j] for p, o in zip(S, own) if o == w])), 6) for j in range(S.shape[1])] if w in own else C[w]
                 for w in range(len(C))]
        recon[:, at:at + 2] = [C[nearest(p)] for p in A]
    out = {}
    for qi, q in enumerate(Q):
        near = sorted(range(len(ids)), key=lambda i: (((q - recon[i]) ** 2).sum(), ids[i]))[:keep]
        out[qi] = [ids[i] for i in sorted(near, key=lambda i: (((q - X[i]) ** 2).sum(), ids[i]))[:k]]
    return out


@pytest.mark.parametrize("dim", [8, 5])
def test_search_is_the_stated_rule(spark, tmpdir_fresh, monkeypatch, dim):
    from trove.operators import pq
    monkeypatch.setattr(pq, "WORDS", 7)
    monkeypatch.setattr(pq, "SAMPLE", 90)
    monkeypatch.setattr(pq, "PART_ROWS", 20)
    monkeypatch.setattr(pq.train, "__defaults__", (7, 3))
    X, Q = vectors(1, 150, dim), vectors(2, 25, dim)
    X[100:110] = X[3]                                                   # ties
    ids = [str(i) for i in range(150)]
    want = rule(ids, X, Q, 4, 12, 7, 3, 90)
    index = pq.PqIndex.build(frame(spark, X, "vec_id"), f"{tmpdir_fresh}/index")
    assert index.parts == 8
    for how in ({}, {"tile_rows": 6, "block_rows": 40}):
        got = {}
        for r in index.search(frame(spark, Q, "query_id"), 4, shortlist=12, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
            assert abs(r.dist - ((Q[r.query_id] - X[int(r.vec_id)]) ** 2).sum()) < 1e-12
        assert got == want
    again = pq.PqIndex.open(spark, f"{tmpdir_fresh}/index")
    one = again.search(frame(spark, Q[:1], "query_id"), 4, shortlist=12)
    assert [r.vec_id for r in one.orderBy("rank").collect()] == want[0]
    # a whole shortlist is exact search, by every metric
    from trove.operators.knn import knn
    for metric in ("sqeuclidean", "l2", "cosine", "ip"):
        a = again.search(frame(spark, Q, "query_id"), 3, shortlist=150, metric=metric).collect()
        b = knn(frame(spark, Q, "query_id"), frame(spark, X, "vec_id"), 3, metric=metric).collect()
        assert {(r.query_id, r.rank, r.vec_id, round(r.dist, 9)) for r in a} == {(r.query_id, r.rank, r.vec_id, round(r.dist, 9)) for r in b}


def test_recall_without_clusters(spark, tmpdir_fresh):
    """Vectors without any structure: every true neighbour but a few is found
    among 160 of 6,000 codes, and the codes are a small part of the vectors."""
    import os

    from trove.operators import pq
    from trove.operators.knn import knn
    corpus, queries = frame(spark, vectors(3, 6000, 64), "vec_id"), frame(spark, vectors(4, 100, 64), "query_id")
    corpus.write.parquet(f"{tmpdir_fresh}/corpus")
    corpus = spark.read.parquet(f"{tmpdir_fresh}/corpus")
    index = pq.PqIndex.build(corpus, f"{tmpdir_fresh}/index")
    true = {(r.query_id, r.vec_id) for r in knn(queries, corpus, 20).collect()}
    got = {(r.query_id, r.vec_id) for r in index.search(queries, 20).collect()}
    assert len(got) == len(true) == 2000 and len(got & true) >= 0.95 * len(true)
    import pyarrow.parquet as pq_files
    size = Counter()
    for d, _, files in os.walk(f"{tmpdir_fresh}/index/rows"):
        for f in files:
            if f.endswith(".parquet"):
                meta = pq_files.ParquetFile(os.path.join(d, f)).metadata
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        size[meta.row_group(g).column(c).path_in_schema.split(".")[0]] += meta.row_group(g).column(c).total_compressed_size
    assert size["code"] < size["vector"] / 6


def test_search_reads_the_parts_it_needs(spark, tmpdir_fresh, monkeypatch):
    from trove.operators import pq
    monkeypatch.setattr(pq, "PART_ROWS", 10)
    X = vectors(5, 300, 6)
    index = pq.PqIndex.build(frame(spark, X, "vec_id"), f"{tmpdir_fresh}/index")
    one = index.search(frame(spark, X[:1], "query_id"), 1, shortlist=2)
    assert [r.vec_id for r in one.collect()] == ["0"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    wanted = re.search(r"/rows\], PartitionFilters: \[part#\d+ IN \(([^)]*)\)|PartitionFilters: \[.*?\(?part#\d+ = (\d+)", plan)
    assert index.parts == 30 and wanted and len((wanted[1] or wanted[2]).split(",")) <= 2


def test_empty_and_broken(spark, tmpdir_fresh):
    from trove.operators import pq
    X = vectors(6, 5, 4)
    empty = pq.PqIndex.build(frame(spark, X, "vec_id").limit(0), f"{tmpdir_fresh}/none")
    assert empty.search(frame(spark, X, "query_id"), 3).count() == 0
    index = pq.PqIndex.build(frame(spark, X, "vec_id"), f"{tmpdir_fresh}/index")
    assert index.search(frame(spark, X, "query_id").limit(0), 3).count() == 0
    assert index.search(frame(spark, X, "query_id"), 9).groupBy("query_id").count().select(F.max("count")).first()[0] == 5
    with pytest.raises(Exception, match="length 3"):
        index.search(frame(spark, X[:, :3], "query_id"), 2).collect()
    with pytest.raises(Exception, match="NULL vector"):
        pq.PqIndex.build(spark.createDataFrame([("1", [1.0, 2.0]), ("2", None)], "vec_id string, embedding array<double>"), f"{tmpdir_fresh}/bad")
