"""Operator 1, exact top-k search with a bit-sliced index.

Rows are cut into blocks. A block stores, for every attribute, the bits of its
quantised values as slices: one bitmap over the block's rows per bit. A query
multiplies and adds the slices with bitmap arithmetic only (carry-save adders
over 64 rows per word), which leaves the score itself as slices. The top rows
are selected from the most significant slice downward; rows that are still
equal after the last slice are the boundary, resolved exactly by id.

Every (query tile, block) pair is one unit of work; both sides travel by an
equi-join on (length, block, shard), blocks in at most ``MAX_SHARDS`` copies.
Per tile and block at most k rows a query come back, so the final ranking
sees k rows per query and block whatever ties the table holds.

Defined results: vectors that are null or empty, or hold a null or non-finite
component, or a finite one that is no long after scaling, take no part, nor do
rows without an id. Sums are as wide as they need to be; a score in the result
that is no long raises. Rows that share an id all take part, as queries (their
rows are ranked together) and as candidates; only a row that repeats both id
and quantised vector counts once. Only vectors of equal length are compared.
Extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, write_scratch

#: Rows per block and queries per tile: what one task holds at a time.
BLOCK_ROWS = 1 << 16
TILE_ROWS = 256
#: Copies of a block, so that the tiles of one block spread over tasks.
MAX_SHARDS = 16


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, q, dim): q holds floor(scale * x) of each component as long."""
    v = F.col(f"`{vec_col}`")

    def scaled(x: Column) -> Column:
        return F.lit(float(scale)) * x.cast("double")

    def whole(x: Column) -> Column:
        # On the double: the floor of an infinity is the smallest long, whose abs raises. False for NaN, too.
        return x.isNotNull() & (scaled(x) >= F.lit(-2.0 ** 63)) & (scaled(x) < F.lit(2.0 ** 63))

    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .where(F.forall("v", whole))
            .select("vec_id", F.transform("v", lambda x: F.floor(scaled(x)).cast("long")).alias("q"))
            .distinct().withColumn("dim", F.size("q")))


class BitSlices:
    """The bit-sliced index of one block: ``slices[first[d] + b]`` is the bitmap
    of bit b of (x_d - low_d); rows are in id order."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        n, dims = matrix.shape
        self.ids, self.n = ids, n
        self.words = -(-n // 64)
        self.low = matrix.min(axis=0)
        spread = matrix.max(axis=0).view(np.uint64) - self.low.view(np.uint64)      # may pass a long
        self.width = [int(x).bit_length() for x in spread]
        self.first = np.concatenate([[0], np.cumsum(self.width)]).astype(int).tolist()
        self.slices = np.zeros((max(1, self.first[-1]), self.words * 8), dtype=np.uint8)
        for d in range(dims):
            x = matrix[:, d].astype(np.uint64) - self.low[d].astype(np.uint64)
            for b in range(self.width[d]):
                packed = np.packbits(((x >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
                self.slices[self.first[d] + b, :len(packed)] = packed
        self.slices = self.slices.view(np.uint64)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return (self.ids.astype("<i8").tobytes(), self.low.astype("<i8").tobytes(),
                np.array(self.width, dtype="u1").tobytes(), self.slices.tobytes())

    @classmethod
    def unpack(cls, ids: bytes, low: bytes, width: bytes, slices: bytes) -> "BitSlices":
        out = cls.__new__(cls)
        out.ids, out.low = np.frombuffer(ids, "<i8"), np.frombuffer(low, "<i8")
        out.n = len(out.ids)
        out.words = -(-out.n // 64)
        out.width = np.frombuffer(width, "u1").astype(int).tolist()
        out.first = np.concatenate([[0], np.cumsum(out.width)]).astype(int).tolist()
        out.slices = np.frombuffer(slices, np.uint64).reshape(-1, out.words)
        out.both = np.concatenate([out.slices, ~out.slices])     # a slice and, behind, its complement
        valid = np.zeros(out.words * 64, dtype=np.uint8)
        valid[:out.n] = 1
        out.valid = np.packbits(valid, bitorder="little").view(np.uint64)
        return out

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the score of every row, lowest first, and the constant that
        the slices leave out. A negative weight adds the complement."""
        constant, flip = 0, len(self.slices)
        at: dict[int, list[int]] = {}
        for d, w in enumerate(query.tolist()):
            constant += w * int(self.low[d])
            width = self.width[d]
            if not w or not width:
                continue
            base = self.first[d]
            if w < 0:
                constant -= -w * ((1 << width) - 1)
                base, w = base + flip, -w
            shift = 0
            while w:
                if w & 1:
                    for b in range(width):
                        at.setdefault(shift + b, []).append(base + b)
                w >>= 1
                shift += 1
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        place, top = 0, max(at, default=-1)
        while place <= top or carried:
            rows = [self.both[at[place]]] if place in at else []
            column = np.concatenate(rows + carried) if rows or carried else np.zeros((0, self.words), np.uint64)
            carried = []
            while len(column) > 2:                      # three bitmaps of one weight -> sum and carry
                t = len(column) // 3
                a, b, c = column[:t], column[t:2 * t], column[2 * t:3 * t]
                half = a ^ b
                carried.append((a & b) | (half & c))
                column = np.concatenate([half ^ c, column[3 * t:]])
            if len(column) == 2:
                carried.append((column[0] & column[1])[None])
                column = (column[0] ^ column[1])[None]
            out.append(column[0] if len(column) else np.zeros(self.words, np.uint64))
            place += 1
        return out, constant

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row places, scores) of the k best rows other than the query's own."""
        slices, constant = self.scores(query)
        equal = self.valid.copy()
        first, end = (int(np.searchsorted(self.ids, own, side)) for side in ("left", "right"))
        if first < end:
            mine = np.zeros(self.words * 64, dtype=np.uint8)
            mine[first:end] = 1
            equal &= ~np.packbits(mine, bitorder="little").view(np.uint64)
        sure = np.zeros(self.words, np.uint64)
        for s in reversed(slices):                      # from the most significant slice downward
            higher = equal & s
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(higher).sum())
            if n > k:
                equal = higher
            else:
                sure = sure | higher
                equal = equal & ~s
                if n == k:
                    break
        chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if len(chosen) < k:                             # the boundary: equal scores, smallest ids first
            tied = np.flatnonzero(np.unpackbits(equal.view(np.uint8), bitorder="little"))
            chosen = np.concatenate([chosen, tied[:k - len(chosen)]])
        wide = len(slices) > 62 or abs(constant) >= 1 << 62      # then with Python's integers
        score = np.full(len(chosen), constant, dtype=object if wide else np.int64)
        for p, s in enumerate(slices):
            bit = ((s[chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            score += bit.astype(score.dtype) << p
        if any(not -1 << 63 <= x < 1 << 63 for x in score if wide):
            raise OverflowError(f"a score of the row {own} is no long")
        return chosen, score.astype(np.int64)


def _runs(frames: Iterator[pd.DataFrame], key: list[str], rows: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(key, ids, matrix) of at most ``rows`` consecutive rows with one key."""
    now, ids, vecs, held = None, [], [], 0

    def done():
        return now, np.concatenate(ids), np.concatenate(vecs)

    for pdf in frames:
        for k, part in pdf.groupby(key, sort=False):
            values, names = np.array(part["q"].tolist(), dtype=np.int64), part["vec_id"].to_numpy(np.int64)
            while len(names):
                if now is not None and (k != now or held >= rows):
                    yield done()
                    ids, vecs, held = [], [], 0
                now = k
                take = rows - held
                ids.append(names[:take])
                vecs.append(values[:take])
                held += len(ids[-1])
                names, values = names[take:], values[take:]
    if held:
        yield done()


def _blocks(frames):
    for (dim, b), ids, matrix in _runs(frames, ["dim", "b"], BLOCK_ROWS):
        i, low, width, slices = BitSlices(ids, matrix).pack()
        yield pd.DataFrame({"dim": [dim], "b": [b], "ids": [i], "low": [low], "width": [width], "slices": [slices]})


def _tiles(frames):
    for (dim, t), ids, matrix in _runs(frames, ["dim", "t"], TILE_ROWS):
        yield pd.DataFrame({"dim": [dim], "t": [t], "q_ids": [ids.astype("<i8").tobytes()],
                            "q_vecs": [matrix.astype("<i8").tobytes()]})


def _search(k: int):
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                block = BitSlices.unpack(r.ids, r.low, r.width, r.slices)
                q_ids = np.frombuffer(r.q_ids, "<i8")
                vecs = np.frombuffer(r.q_vecs, "<i8").reshape(len(q_ids), -1)
                out = [block.top(v, int(i), k) for i, v in zip(q_ids, vecs)]
                yield pd.DataFrame({"query_id": np.repeat(q_ids, [len(p) for p, _ in out]),
                                    "vec_id": block.ids[np.concatenate([p for p, _ in out])],
                                    "score": np.concatenate([s for _, s in out])})
    return run


def topk_search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0,
                id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest integer inner
    product for every row that ``is_query`` (a condition on ``vec_id``) holds for."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = write_scratch(quantised(vectors, id_col, vec_col, scale), "topk-rows")
    queries = rows.where(is_query)
    n_rows, n_queries = rows.count(), queries.count()
    n_blocks, n_tiles = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_queries // TILE_ROWS))
    shards = min(n_tiles, MAX_SHARDS)

    def placed(df: DataFrame, name: str, n: int) -> DataFrame:
        return (df.withColumn(name, F.pmod(F.xxhash64("vec_id", "q", F.lit(name)), F.lit(n)))
                .repartition(n, "dim", name).sortWithinPartitions("dim", name, "vec_id"))

    blocks = placed(rows, "b", n_blocks).mapInPandas(
        _blocks, "dim int, b long, ids binary, low binary, width binary, slices binary")
    tiles = placed(queries, "t", n_tiles).mapInPandas(_tiles, "dim int, t long, q_ids binary, q_vecs binary")
    left = blocks.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    right = (tiles.withColumn("s", F.pmod("t", F.lit(shards)))
             .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))))
    n = max(1, min(n_blocks * shards, 4096))
    pairs = left.repartition(n, "dim", "b", "s").join(right.repartition(n, "dim", "b", "s"), ["dim", "b", "s"])
    found = pairs.select("ids", "low", "width", "slices", "q_ids", "q_vecs").mapInPandas(
        _search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
