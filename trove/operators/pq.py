"""Approximate nearest neighbours with a product quantiser.

The dimensions are cut into subspaces, and each subspace gets a codebook of up
to 256 words, trained on a bounded sample. A vector is stored as one byte per
subspace: the number of its nearest word. A search compares the queries with
the words that the codes look up, keeps the ``shortlist`` nearest codes of
every query, and ranks those by the exact distance to their full vectors. So a
search moves the codes of the corpus and the vectors of the shortlists only.
The rule is the same at every size and needs no clusters in the data.

An index is a folder: ``codebook`` (a row per word) and ``rows`` (id, code,
vector) in parts by a hash of the id. A search reads the column of codes of
all parts, and the column of vectors of those parts that hold a shortlisted
id. It is written once and serves any number of searches.

Training: the ``SAMPLE`` vectors with the smallest md5 of their id; the first
of them are the words at first, then ``ROUNDS`` times every word becomes the
mean (6 decimals) of the sample's vectors that are nearest to it. Ties go to
the smaller word; a word without vectors stays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package, write_scratch
from .knn import (BLOCK_ROWS, METRICS, TILE_BYTES, TILE_ROWS, _copies, _exact, _merge, _search_pairs, _spread, _to_matrix)
from .sizing import DEFAULT_MAX_BYTES, SideSize, measure, slice_count

#: Vectors that the codebooks are trained on, at most; rounds of training; words of a codebook.
SAMPLE, ROUNDS, WORDS = 4096, 3, 256
#: Dimensions of a subspace.
SUBSPACE = 2
#: Nearest codes kept for the exact ranking, as a multiple of k.
SHORTLIST = 8
#: Vectors in a part of the stored vectors, and parts at most.
PART_ROWS, MAX_PARTS = 4096, 4096


def _nearest(X: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Number of the nearest word of each row; the first of equal ones."""
    d = np.zeros((len(X), len(words)))
    for j in range(X.shape[1]):
        d += (X[:, j, None] - words[None, :, j]) ** 2
    return d.argmin(1)


def train(sample: np.ndarray, words: int = WORDS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook (words x dimensions) per subspace."""
    books = []
    for at in range(0, sample.shape[1], SUBSPACE):
        X = sample[:, at:at + SUBSPACE]
        C = X[:words].copy()
        for _ in range(rounds):
            own = _nearest(X, C)
            n = np.bincount(own, minlength=len(C))
            for j in range(X.shape[1]):
                total = np.bincount(own, weights=X[:, j], minlength=len(C))
                C[n > 0, j] = np.round(total[n > 0] / n[n > 0], 6)
        books.append(C)
    return books


def encode(books: list[np.ndarray], X: np.ndarray) -> np.ndarray:
    """rows x subspaces, one byte each."""
    out = np.empty((len(X), len(books)), np.uint8)
    at = 0
    for s, C in enumerate(books):
        out[:, s] = _nearest(X[:, at:at + C.shape[1]], C)
        at += C.shape[1]
    return out


def decode(books: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The words that the codes look up, side by side."""
    return np.concatenate([C[codes[:, s]] for s, C in enumerate(books)], axis=1) if len(books) else np.zeros((len(codes), 0))


@dataclass
class PqIndex:
    """A stored index; ``build`` writes one, ``open`` finds it again."""

    spark: SparkSession
    path: str
    books: list[np.ndarray]
    rows: int
    parts: int

    @classmethod
    def build(cls, corpus: DataFrame, path: str, cid: str = "vec_id", cvec: str = "embedding") -> "PqIndex":
        spark = corpus.sparkSession
        ship_package(spark)
        src = corpus.select(F.col(cid).alias("id"), F.col(cvec).alias("vector"))
        sample = src.orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE).collect()          # bounded by SAMPLE
        books = train(_to_matrix(pa.array([r.vector for r in sample], pa.list_(pa.float64())), None, "corpus")) if sample else []
        rows = src.count()
        parts = max(1, min(MAX_PARTS, -(-rows // PART_ROWS)))
        dim = sum(C.shape[1] for C in books)
        shared = spark.sparkContext.broadcast(books)                                                # WORDS x dimensions doubles

        def run(batches):
            for rb in batches:
                codes = encode(shared.value, _to_matrix(rb.column(1), dim, "corpus"))
                yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), rb.column(1)], names=["id", "code", "vector"])
        schema = T.StructType([src.schema["id"], T.StructField("code", T.BinaryType()), src.schema["vector"]])
        coded = src.mapInArrow(run, schema).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        coded.repartition(min(parts, 512), "part").write.partitionBy("part").parquet(f"{path}/rows")
        words = [(rows, parts, s, w, [float(x) for x in c]) for s, C in enumerate(books) for w, c in enumerate(C)]
        spark.createDataFrame(words or [(0, 1, None, None, None)], "rows long, parts int, subspace int, word int, centre array<double>") \
            .coalesce(1).write.parquet(f"{path}/codebook")
        return cls(spark, path, books, rows, parts)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "PqIndex":
        words = spark.read.parquet(f"{path}/codebook").orderBy("subspace", "word").collect()            # WORDS x subspaces at most
        books = [np.array([r.centre for r in words if r.subspace == s]) for s in sorted({r.subspace for r in words if r.subspace is not None})]
        return cls(spark, path, books, words[0].rows, words[0].parts)

    def search(self, queries: DataFrame, k: int, shortlist: int | None = None, qid: str = "query_id", qvec: str = "embedding",
               metric: str = "sqeuclidean", cid: str = "vec_id", tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """query_id, rank (1-based), the corpus id and exact distance of the k
        nearest among every query's ``shortlist`` (default SHORTLIST * k)
        nearest codes. Order: distance, then id. Vectors of another length
        than the index's raise ``DimensionMismatch``."""
        if metric not in METRICS or k <= 0:
            raise ValueError(f"metric must be one of {METRICS} and k positive")
        asked = queries.select(F.col(qid).alias("query_id"), F.col(qvec).alias("_vec"))
        if not self.rows:
            return self.spark.createDataFrame([], T.StructType([asked.schema["query_id"], T.StructField("rank", T.IntegerType()),
                                                                T.StructField(cid, T.StringType()), T.StructField("dist", T.DoubleType())]))
        books, n = self.books, len(self.books)

        def looked_up(rb: pa.RecordBatch) -> np.ndarray:
            code = rb.column("code")
            flat = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), n)
            return decode(books, flat)
        size = measure(asked)
        tiles = slice_count(size, tile_rows, TILE_BYTES)
        blocks = slice_count(SideSize(self.rows, 0), block_rows, DEFAULT_MAX_BYTES)
        one = F.lit("").alias("_group")
        codes = self.spark.read.parquet(f"{self.path}/rows").select("id", "code")
        left = asked.select(one, _spread(F.lit(tiles), "query_id").alias("_tile"), _copies(F.lit(blocks)).alias("_block"), "query_id", "_vec")
        right = codes.select(one, _copies(F.lit(tiles)).alias("_tile"), _spread(F.lit(blocks), "id").alias("_block"), "id", "code")
        most = max(k, shortlist or SHORTLIST * k)
        near = write_scratch(_merge(_search_pairs(left, right, most, "id", ["id"], metric, looked_up), most, "id").select("query_id", "id"), "pq-shortlist")
        return self._ranked(near, asked, k, metric, SideSize(size.rows * most, size.rows * most * 64).fits()).withColumnRenamed("id", cid)

    def _ranked(self, near: DataFrame, asked: DataFrame, k: int, metric: str, small: bool) -> DataFrame:
        """Exact distances of the shortlists, which are broadcast if ``small``.
        Parts of the vectors without a shortlisted id are not read."""
        near = near.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int"))
        parts = [r.part for r in near.select("part").distinct().collect()]                             # MAX_PARTS at most
        vectors = self.spark.read.parquet(f"{self.path}/rows").where(F.col("part").isin(parts)).select("id", "vector")
        pairs = vectors.join((F.broadcast if small else lambda x: x)(near.drop("part")), "id").join(asked, "query_id")
        schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", near.schema["id"].dataType),
                               T.StructField("dist", T.DoubleType())])

        def run(batches):
            for rb in batches:
                if rb.num_rows:
                    Q, C = _to_matrix(rb.column(2), None, "query"), _to_matrix(rb.column(3), None, "corpus")
                    yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(_exact(Q, C, metric))], names=["query_id", "id", "dist"])
        return _merge(pairs.select("query_id", "id", "_vec", "vector").mapInArrow(run, schema), k, "id")


def knn_pq(queries: DataFrame, corpus: DataFrame, k: int, path: str | None = None, cid: str = "vec_id", cvec: str = "embedding", **how) -> DataFrame:
    """Builds an index of ``corpus`` (at ``path``, default: scratch) and searches it."""
    index = PqIndex.build(corpus, path or scratch_path(corpus.sparkSession, "pq-index"), cid, cvec)
    return index.search(queries, k, cid=cid, **how)
