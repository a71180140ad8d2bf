"""Nearest-neighbour search for many queries at once.

Both sides stay in DataFrames. The queries are cut into tiles and the corpus
into blocks by a hash of their ids, and every (tile, block) pair is one key of
one shuffle: a tile is copied once per block and a block once per tile, so
each pair costs a bounded tile of queries against a stream of corpus rows.
Within a partition the rows are sorted by pair, queries first; the kernel
keeps one tile, one Arrow batch and a running top k per query in memory,
whatever the size of a block. Only k rows per query and block leave it, and a
final ``row_number() <= k`` per query merges them.

Distances of the candidates are recomputed exactly from the differences, so
the result does not depend on the matrix-product shortcut.

Approximate search (``knn_approx``) uses the same kernel with the bucket of a
random-hyperplane code as part of the pair key.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, write_scratch
from .sizing import DEFAULT_MAX_BYTES, SideSize, measure, slice_count

METRICS = ("sqeuclidean", "l2", "cosine", "ip")
TILE_ROWS = 4_096               # queries of one (tile, block) pair
TILE_BYTES = 32 * 1024 * 1024   # and their vectors' bytes
BLOCK_ROWS = 65_536             # corpus rows of one pair, on average
QUERY_BLOCK = 512       # queries per distance block
CORPUS_BLOCK = 2_048    # and corpus rows: 512 x 2,048 x 8 B = 8 MB
CANDIDATES = 32_768     # pairs whose exact distance is computed at a time
PENDING = 262_144       # candidates of a tile that are kept unsorted at least
RECALL = 0.95           # share of a sample's true neighbours that the visited buckets of approximate search must hold
SAMPLE_QUERIES = 256    # queries of that sample
PAIR = ["_group", "_tile", "_block"]
AFTER = ["after_dist", "after_id"]      # a query's last hit, of queries that go on from there


class DimensionMismatch(ValueError):
    pass


def _to_matrix(arr: pa.Array, dim: int | None, what: str) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, dim or 0))
    if arr.null_count:
        raise DimensionMismatch(f"{what}: NULL vector")
    lens = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    d = int(lens[0]) if dim is None else dim
    if (lens != d).any():
        bad = int(lens[lens != d][0])
        raise DimensionMismatch(f"{what}: vector of length {bad}, expected {d}")
    flat = pc.list_flatten(arr).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(n, d)


def _exact(Q: np.ndarray, C: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distance between paired rows of Q and C."""
    if metric in ("sqeuclidean", "l2"):
        diff = Q - C
        d = np.einsum("ij,ij->i", diff, diff)
        return np.sqrt(d) if metric == "l2" else d
    dot = np.einsum("ij,ij->i", Q, C)
    if metric == "ip":
        return 1.0 - dot
    nq = np.sqrt(np.einsum("ij,ij->i", Q, Q))
    nc = np.sqrt(np.einsum("ij,ij->i", C, C))
    den = nq * nc
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den > 0, 1.0 - dot / den, 1.0)


def _approx_block(Q, qn, C, cn, metric):
    """Distance block Q x C via one matrix product (candidate selection)."""
    g = Q @ C.T
    if metric in ("sqeuclidean", "l2"):
        return qn[:, None] + cn[None, :] - 2.0 * g
    if metric == "ip":
        return 1.0 - g
    den = np.sqrt(qn)[:, None] * np.sqrt(cn)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den > 0, 1.0 - g / den, 1.0)


def _exact_pairs(Q, C, qi, ci, metric: str) -> np.ndarray:
    """Exact distances of the pairs of rows qi of Q and ci of C, some at a time."""
    parts = [_exact(Q[qi[s:s + CANDIDATES]], C[ci[s:s + CANDIDATES]], metric) for s in range(0, len(qi), CANDIDATES)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _block_topk(Q, qn, C, cn, k: int, metric: str, bound, after=None):
    """Candidates (query row, corpus row, exact distance) covering the top k of
    every query within one block, ties at the k-th distance included, as far
    as they may lie within ``bound``, a distance per query. With ``after``, a
    distance per query, the top k from there onward."""
    D = _approx_block(Q, qn, C, cn, metric)
    near = lambda d: 1e-9 * (1.0 + np.abs(np.where(np.isfinite(d), d, 0.0))) + 1e-9 * (1.0 + qn)
    if after is not None:
        slack = near(after)
        D = np.where(D >= (after - slack)[:, None], D, np.inf)
    hit = D <= (bound + near(bound))[:, None]
    if len(C) > k and np.count_nonzero(hit) > 2 * k * len(Q):
        beyond = D if after is None else np.where(D > (after + slack)[:, None], D, np.inf)
        kth = np.minimum(bound, np.partition(beyond, k - 1, axis=1)[:, k - 1])
        hit = D <= (kth + near(kth))[:, None]
    if after is not None:
        hit &= np.isfinite(D)
    qi, ci = np.nonzero(hit)
    return qi, ci, _exact_pairs(Q, C, qi, ci, metric)


def _keep_k(tbl: pa.Table, id_col: str, k: int) -> pa.Table:
    if tbl.num_rows == 0:
        return tbl
    tbl = tbl.sort_by([("_row", "ascending"), ("dist", "ascending"), (id_col, "ascending")])
    q = tbl.column("_row").to_numpy()
    starts = np.r_[0, np.nonzero(q[1:] != q[:-1])[0] + 1]
    group_start = np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    rank = np.arange(len(q)) - group_start
    return tbl.filter(pa.array(rank < k))


class _Pair:
    """The state of one (group, tile, block): its queries and their best rows."""

    def __init__(self, k: int, cid: str, keep: list[str], metric: str, decode=None):
        self.k, self.cid, self.keep, self.metric, self.decode = k, cid, keep, metric, decode
        self.ids, self.vectors, self.after = [], [], []
        self.Q = self.best = None
        self.pending, self.n_pending = [], 0

    def add_queries(self, rb: pa.RecordBatch) -> None:
        dim = self.vectors[0].shape[1] if self.vectors else None
        self.ids.append(rb.column("query_id"))
        self.vectors.append(_to_matrix(rb.column("_vec"), dim, "query"))
        if AFTER[0] in rb.schema.names:
            self.after.append(rb.select(AFTER))

    def add_corpus(self, rb: pa.RecordBatch) -> None:
        if not self.ids:
            return
        if self.Q is None:
            self.Q = np.concatenate(self.vectors)
            self.qn = np.einsum("ij,ij->i", self.Q, self.Q)
            self.bound = np.full(len(self.Q), np.inf)       # distance of a query's k-th best row so far
            if self.after:
                t = pa.Table.from_batches(self.after).combine_chunks()
                self.after_dist = t.column(0).fill_null(-np.inf).to_numpy()
                self.after_id = t.column(1)
        C = self.decode(rb) if self.decode else _to_matrix(rb.column("_vec"), self.Q.shape[1], "corpus")
        if C.shape[1] != self.Q.shape[1]:
            raise DimensionMismatch(f"query: vector of length {self.Q.shape[1]}, expected {C.shape[1]}")
        cn = np.einsum("ij,ij->i", C, C)
        for c in range(0, len(C), CORPUS_BLOCK):
            cols = slice(c, c + CORPUS_BLOCK)
            for q in range(0, len(self.Q), QUERY_BLOCK):
                rows = slice(q, q + QUERY_BLOCK)
                qi, ci, dist = _block_topk(self.Q[rows], self.qn[rows], C[cols], cn[cols], self.k, self.metric, self.bound[rows],
                                           self.after_dist[rows] if self.after else None)
                self._add(rb, qi + q, ci + c, dist)

    def _add(self, rb: pa.RecordBatch, qi: np.ndarray, ci: np.ndarray, dist: np.ndarray) -> None:
        if self.after:
            tied = np.flatnonzero(dist == self.after_dist[qi])
            keep = dist > self.after_dist[qi]
            own = pc.cast(rb.column(self.cid).take(pa.array(ci[tied], pa.int64())), self.after_id.type)
            keep[tied] = pc.greater(own, self.after_id.take(pa.array(qi[tied], pa.int64()))).to_numpy(zero_copy_only=False)
            qi, ci, dist = qi[keep], ci[keep], dist[keep]
        if not len(qi):
            return
        self.pending.append(pa.Table.from_batches([rb.select(self.keep).take(pa.array(ci, pa.int64()))])
                            .add_column(0, "_row", pa.array(qi, pa.int64())).add_column(1, "dist", pa.array(dist, pa.float64())))
        self.n_pending += len(qi)
        if self.n_pending > max(PENDING, self.k * len(self.Q)):
            self._settle()

    def _settle(self) -> None:
        """Sorts the pending candidates into the best rows and tightens the bounds."""
        if not self.pending:
            return
        found = self.pending if self.best is None else [self.best, *self.pending]
        self.pending, self.n_pending = [], 0
        self.best = _keep_k(pa.concat_tables(found), self.cid, self.k)
        row = self.best.column("_row").to_numpy()
        ends = np.searchsorted(row, np.arange(len(self.Q)), side="right")
        full = np.diff(ends, prepend=0) == self.k
        self.bound[full] = self.best.column("dist").to_numpy()[ends[full] - 1]

    def result(self) -> list[pa.RecordBatch]:
        self._settle()
        if self.best is None:
            return []
        ids = pa.chunked_array(self.ids).take(self.best.column("_row"))
        out = self.best.drop_columns(["_row"]).add_column(0, "query_id", ids)
        return out.combine_chunks().to_batches()


def _search_pairs(tiles: DataFrame, blocks: DataFrame, k: int, cid: str, keep: list[str], metric: str,
                  decode=None) -> DataFrame:
    """k nearest rows within every (group, tile, block) pair.

    ``tiles`` holds PAIR, query_id, _vec; ``blocks`` holds PAIR, _vec and the
    ``keep`` columns. Rows of a pair meet through one shuffle on PAIR. With
    ``decode``, a function of a batch of blocks, the blocks' vectors are what
    it returns, and they need no _vec.
    """
    ship_package(tiles.sparkSession)
    rows = tiles.withColumn("_side", F.lit(0)).unionByName(blocks.withColumn("_side", F.lit(1)),
                                                          allowMissingColumns=True)
    rows = rows.repartition(*PAIR).sortWithinPartitions(*PAIR, "_side")
    schema = T.StructType([T.StructField("query_id", tiles.schema["query_id"].dataType),
                           T.StructField("dist", T.DoubleType()),
                           *[T.StructField(c, blocks.schema[c].dataType) for c in keep]])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pair = None, None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            cols = [rb.column(c).to_numpy(zero_copy_only=False) for c in [*PAIR, "_side"]]
            change = np.zeros(rb.num_rows, dtype=bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.r_[0, np.nonzero(change)[0], rb.num_rows]
            for s, e in zip(starts[:-1], starts[1:]):
                here = tuple(c[s] for c in cols[:-1])
                if here != key:
                    if pair is not None:
                        yield from pair.result()
                    key, pair = here, _Pair(k, cid, keep, metric, decode)
                part = rb.slice(s, e - s)
                if cols[-1][s] == 0:
                    pair.add_queries(part)
                else:
                    pair.add_corpus(part)
        if pair is not None:
            yield from pair.result()

    return rows.mapInArrow(fn, schema)


def _spread(n: Column, *by: str) -> Column:
    """Number of a tile or block out of ``n`` from a hash of ``by``."""
    return F.pmod(F.xxhash64(*by), n).cast("int")


def _copies(n: Column) -> Column:
    """One row for each of the numbers 0 .. n - 1."""
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _merge(cand: DataFrame, k: int, cid: str, carry: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("dist").asc(), F.col(cid).asc())
    ranked = cand.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", cid, "dist", *[c for c in carry if c != cid])


def knn(queries: DataFrame, corpus: DataFrame, k: int, *, qid: str = "query_id", qvec: str = "embedding",
        cid: str = "vec_id", cvec: str = "embedding", carry: Sequence[str] = (),
        metric: str = "sqeuclidean", by: str | None = None, tile_rows: int = TILE_ROWS,
        tile_bytes: int = TILE_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest corpus rows for every query.

    Returns query_id, rank (1-based), the corpus id, dist and ``carry``
    columns. Order: distance, then corpus id. Vectors of a length other than
    the queries' raise ``DimensionMismatch``. With ``by``, a column of both
    sides, a query meets only the corpus rows with its value of that column.
    Queries with the columns AFTER (null: none) get the k nearest rows that
    come after that distance and id.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k <= 0:
        raise ValueError("k must be positive")
    # Two counting jobs (one row back each) give the number of tiles and blocks.
    size = measure(queries.select(qid, qvec))
    tiles = slice_count(size, tile_rows, tile_bytes)
    keep = list(dict.fromkeys([cid, *carry]))
    group = (F.col(by) if by else F.lit("")).cast("string").alias("_group")
    left = queries.select(group, F.col(qid).alias("query_id"), F.col(qvec).alias("_vec"), *[c for c in AFTER if c in queries.columns])
    right = corpus.select(group, F.col(cvec).alias("_vec"), *keep)
    if by:
        # a table of both numbers: each group has as many as its own rows ask for
        many = lambda df, rows, name: df.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name))
        sizes = write_scratch(many(left, max(1, -(-size.rows // tiles)), "_tiles").join(many(right, block_rows, "_blocks"), "_group"), "knn-groups")
        sizes = F.broadcast(sizes) if measure(sizes).fits() else sizes
        left, right = left.join(sizes, "_group"), right.join(sizes, "_group")
        tiles, blocks = F.col("_tiles"), F.col("_blocks")
    else:
        tiles, blocks = F.lit(tiles), F.lit(slice_count(SideSize(corpus.count(), 0), block_rows, DEFAULT_MAX_BYTES))
    left = left.select("_group", _spread(tiles, "query_id").alias("_tile"), _copies(blocks).alias("_block"),
                       *[c for c in left.columns if c not in ("_group", "_tiles", "_blocks")])
    right = right.select("_group", _copies(tiles).alias("_tile"), _spread(blocks, cid, "_vec").alias("_block"), "_vec", *keep)
    return _merge(_search_pairs(left, right, k, cid, keep, metric), k, cid, carry)


def similarity_relative(dist: Column | None = None, key: str = "query_id") -> Column:
    """1 - d / max(d) over the query's hit list; an all-zero list gives 1.0."""
    dist = F.col("dist") if dist is None else dist
    mx = F.max(dist).over(Window.partitionBy(key))
    return F.when(mx == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.try_divide(dist, mx))


def similarity_absolute(dist: Column | None = None) -> Column:
    dist = F.col("dist") if dist is None else dist
    return F.lit(1.0) - dist


def hit_list_max(dist: Column | None = None, key: str = "query_id") -> Column:
    dist = F.col("dist") if dist is None else dist
    return F.max(dist).over(Window.partitionBy(key))


def dedupe_hits(hits: DataFrame, key: Sequence[str] = ("query_id", "item_id"),
                order: Sequence[Column] | None = None) -> DataFrame:
    """One hit per (query, item): the best (smallest distance) of its vectors."""
    order = order or (F.col("dist").asc(), F.col("vec_id").asc())
    w = Window.partitionBy(*key).orderBy(*order)
    return hits.withColumn("_d", F.row_number().over(w)).where(F.col("_d") == 1).drop("_d")


MODALITY_OF_SEARCH_TYPE = {"covers": "cover", "screenshots": "screenshot"}
KNOWN_MODALITIES = ("description", "cover", "screenshot", "review")


def modality_corpus(item_vectors: DataFrame, modality: str) -> DataFrame:
    """Vectors of one modality (a partition filter on a modality-partitioned
    table). Unknown names raise; a known but empty modality gives no rows."""
    if modality not in KNOWN_MODALITIES:
        raise ValueError(f"unknown modality {modality!r}")
    return item_vectors.where(F.col("modality") == modality)


def search_type_modality(search_type: str) -> str:
    try:
        return MODALITY_OF_SEARCH_TYPE[search_type]
    except KeyError:
        raise ValueError("search_type must be 'covers' or 'screenshots'") from None


def search_type_column(search_type: Column) -> Column:
    """The modality of a search type given per row; other values raise."""
    out = None
    for name, modality in MODALITY_OF_SEARCH_TYPE.items():
        out = (F if out is None else out).when(search_type == name, F.lit(modality))
    return out.otherwise(F.raise_error(F.lit("search_type must be 'covers' or 'screenshots'")))


# ---------------------------------------------------------------- approximate

def _hyperplanes(dim: int, bits: int, seed: int) -> np.ndarray:
    """Random planes with components +1 or -1, a rule that SQL can repeat: the
    sign is the top bit of md5('seed:plane:component')."""
    sign = lambda b, j: 1.0 if hashlib.md5(f"{seed}:{b}:{j}".encode()).digest()[0] < 128 else -1.0
    return np.array([[sign(b, j) for j in range(dim)] for b in range(bits)])


def _with_bucket(df: DataFrame, vec: str, planes: np.ndarray) -> DataFrame:
    """``df`` with its vectors' bucket: bit b is set on plane b's positive side."""
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("_bucket", T.LongType())])
    weights = 1 << np.arange(planes.shape[0], dtype=np.int64)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            M = _to_matrix(rb.column(vec), planes.shape[1], "vector")
            code = ((M @ planes.T >= 0) * weights).sum(1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(code, pa.int64())],
                                             names=[*rb.schema.names, "_bucket"])

    return df.mapInArrow(fn, schema)


def _measured_probes(queries: DataFrame, corpus: DataFrame, coded: DataFrame, planes: np.ndarray, k: int, *,
                     qid: str, qvec: str, cid: str, cvec: str, metric: str) -> int | None:
    """The least number of differing bits within which a sample of the queries
    finds RECALL of its exact neighbours; None if half of the buckets or more
    lie within it, so that exact search does less."""
    bits = planes.shape[0]
    sample = write_scratch(queries.select(qid, qvec).orderBy(F.xxhash64(qid, F.lit(bits))).limit(SAMPLE_QUERIES), "knn-sample")
    own = _with_bucket(sample.select(F.col(qid).alias("query_id"), F.col(qvec).alias("_vec")), "_vec", planes) \
        .select("query_id", F.col("_bucket").alias("_own"))
    true = knn(sample, corpus, k, qid=qid, qvec=qvec, cid=cid, cvec=cvec, metric=metric)
    found = true.join(own, "query_id").join(coded.select(cid, "_bucket"), cid).groupBy(
        F.bit_count(F.col("_bucket").bitwiseXOR(F.col("_own"))).alias("r")).count().collect()     # bits + 1 rows at most
    within, total = 0, sum(r["count"] for r in found)
    for probes in range(bits + 1):
        within += sum(r["count"] for r in found if r["r"] == probes)
        if 2 * sum(math.comb(bits, r) for r in range(probes + 1)) >= 1 << bits:
            return None
        if within >= RECALL * total:
            return probes
    return None


def knn_approx(queries: DataFrame, corpus: DataFrame, k: int, *, dim: int, bits: int | None = None,
               target_bucket: int = 256, probes: int | None = None, max_group_rows: int = BLOCK_ROWS,
               tile_rows: int = TILE_ROWS, seed: int = 7, qid: str = "query_id", qvec: str = "embedding",
               cid: str = "vec_id", cvec: str = "embedding", metric: str = "sqeuclidean") -> DataFrame:
    """Approximate k nearest neighbours by random-hyperplane buckets.

    Each corpus vector goes to one bucket (its side of ``bits`` fixed
    hyperplanes); a query visits every bucket within ``probes`` differing
    bits of its own. Without ``probes``, up to 2 bits are all visited; with
    more the number comes from the exact neighbours of a bounded sample of the
    queries, of which the visited buckets must hold RECALL, so recall does not
    fall as the corpus grows. Vectors whose neighbours lie in half of the
    buckets or more are searched exactly. A bucket of n vectors is split into ceil(n /
    max_group_rows) blocks and its m visiting queries into ceil(m /
    tile_rows) tiles, so neither side of a hot bucket is gathered. Queries
    whose buckets hold fewer than k vectors are answered by exact search, so
    no list is short. Recall is measured against ``knn``.

    ``bits`` defaults from the corpus size (one count) so that a bucket holds
    about ``target_bucket`` vectors: log2(n / target_bucket), at least 1.
    """
    n = corpus.count()
    if bits is None:
        bits = max(1, math.floor(math.log2(max(n, 1) / target_bucket) + 0.5))
    planes = _hyperplanes(dim, bits, seed)
    # The corpus is coded once; bucket sizes and search read the stored codes.
    coded = write_scratch(_with_bucket(corpus.select(cid, cvec), cvec, planes), "knn-codes")
    if probes is None:
        names = {"qid": qid, "qvec": qvec, "cid": cid, "cvec": cvec, "metric": metric}
        probes = 2 if bits <= 2 or n == 0 else _measured_probes(queries, corpus, coded, planes, k, **names)
        if probes is None:
            return knn(queries, corpus, k, **names)
    flips = [sum(1 << b for b in chosen)
             for r in range(probes + 1) for chosen in itertools.combinations(range(bits), r)]
    own = _with_bucket(queries.select(F.col(qid).alias("query_id"), F.col(qvec).alias("_vec")), "_vec", planes)
    visits = write_scratch(own.withColumn("_bucket", F.explode(F.array(
        *[F.col("_bucket").bitwiseXOR(F.lit(f).cast("long")) for f in flips]))), "knn-visits")
    many = lambda rows, name: F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name)
    sizes = write_scratch(coded.groupBy("_bucket").agg(many(max_group_rows, "_blocks")).join(
        visits.groupBy("_bucket").agg(many(tile_rows, "_tiles")), "_bucket"), "knn-buckets")
    if measure(sizes).fits():
        sizes = F.broadcast(sizes)
    group = F.col("_bucket").cast("string").alias("_group")
    left = visits.join(sizes, "_bucket").select(
        group, _spread(F.col("_tiles"), "query_id").alias("_tile"), _copies(F.col("_blocks")).alias("_block"),
        "query_id", "_vec")
    right = coded.join(sizes, "_bucket").select(
        group, _copies(F.col("_tiles")).alias("_tile"), _spread(F.col("_blocks"), cid, cvec).alias("_block"),
        F.col(cvec).alias("_vec"), cid)
    hits = write_scratch(_merge(_search_pairs(left, right, k, cid, [cid], metric), k, cid), "knn-hits")
    full = hits.where(F.col("rank") == min(k, n)).select(F.col("query_id").alias("_full"))
    short = queries.join(full, F.col(qid) == F.col("_full"), "left_anti")
    if n == 0 or short.isEmpty():
        return hits
    return hits.join(full, F.col("query_id") == F.col("_full"), "left_semi").unionByName(
        knn(short, corpus, k, qid=qid, qvec=qvec, cid=cid, cvec=cvec, metric=metric))
