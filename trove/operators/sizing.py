"""Proven size bounds before anything is broadcast.

A side is broadcast only after a cheap job shows its row count and byte
size are under a bound. Above the bound callers fall back to a shuffle
plan or process the side in hash slices that each fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_ROWS = 200_000
DEFAULT_MAX_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class SideSize:
    rows: int
    bytes: int

    def fits(self, max_rows: int = DEFAULT_MAX_ROWS, max_bytes: int = DEFAULT_MAX_BYTES) -> bool:
        return self.rows <= max_rows and self.bytes <= max_bytes


def _width(c: Column, dt: T.DataType) -> Column:
    """Column expression for the in-memory bytes of one value."""
    if isinstance(dt, T.StructType):
        width = F.lit(8)
        for f in dt.fields:
            width = width + _width(c.getField(f.name), f.dataType)
        return width
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(dt, T.ArrayType):
        inner = 8 if not isinstance(dt.elementType, (T.StringType,)) else 32
        return F.coalesce(F.size(c), F.lit(0)) * inner + 16
    return F.lit(8)


def measure(df: DataFrame) -> SideSize:
    """Exact row count and byte size of a (query-sized) side: one aggregate
    pass, partial sums per task, one row to the driver."""
    width = None
    for f in df.schema.fields:
        w = _width(F.col(f"`{f.name}`"), f.dataType)
        width = w if width is None else width + w
    r = df.agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.sum(width if width is not None else F.lit(0)), F.lit(0)).alias("b")).first()
    return SideSize(int(r["n"]), int(r["b"]))


def slice_count(size: SideSize, max_rows: int = DEFAULT_MAX_ROWS, max_bytes: int = DEFAULT_MAX_BYTES) -> int:
    """Number of hash slices so each slice fits the bound (at least 1)."""
    by_rows = -(-size.rows // max_rows)
    by_bytes = -(-size.bytes // max_bytes)
    return max(1, by_rows, by_bytes)


def hash_slices(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    """Split ``df`` into ``n`` disjoint slices by a hash of ``key``; together
    they hold every row."""
    if n <= 1:
        return [df]
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(n))
    return [df.where(h == i) for i in range(n)]
