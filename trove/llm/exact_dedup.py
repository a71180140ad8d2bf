"""Operator 5, exact dedup with counting quotient filters.

Each partition builds counting quotient filters over the 64-bit fingerprints
of its texts (white space deleted). A filter is cut by quotient range; ranges
meet in one place and merge losslessly, remainder by sorted remainder, counts
added. Fingerprints counted more than once route their documents to byte
verification, where the normalised bytes themselves are compared; only then
are documents grouped.

A group of any size is folded by partial aggregation before it is shuffled,
and a range holds one entry per filter and distinct fingerprint, so a text
that makes up a third of the rows stays small everywhere.

Defined results: null text counts as empty, all empty texts are one group; a
null id is a row like any other and comes last among equally long texts; of
rows that repeat id and length exactly one is marked kept, so one row of every
group stays. Extra columns are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import TEXT_KEYS, WHITE, map_batches, text_keys, text_slices, texts_of

#: Fingerprints per filter before a partition starts the next one.
FILTER_ROWS = 1 << 19
#: Distinct fingerprints aimed at per quotient range of the merge.
RANGE_ROWS = 1 << 17
#: Repeated fingerprints (8 bytes each) up to which they are broadcast; beyond
#: it the same semi-join shuffles.
BROADCAST_ROWS = 1 << 20


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width:]
    return np.packbits(bits).tobytes()


def _unpack_bits(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - width:] = np.unpackbits(raw, count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).reshape(-1).view(">u8").astype(np.uint64)


def _merge_two(a: tuple, b: tuple) -> tuple:
    """Union of two sorted (fingerprints, counts), counts added: the shorter
    one's entries are placed among the longer one's, nothing is sorted."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    at = np.searchsorted(a[0], b[0])
    same = a[0][np.minimum(at, len(a[0]) - 1)] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    counts = a[1].copy()
    counts[at[same]] += b[1][same]
    return np.insert(a[0], at[~same], b[0][~same]), np.insert(counts, at[~same], b[1][~same])


class CountingQuotientFilter:
    """Sorted (quotient, remainder) slots with run ends and counters.

    ``occupied`` has a bit for each quotient that owns a run, ``run_end`` a bit
    for each slot that ends one, ``remainders`` the slots in order, stored in
    as many bits as they have, and ``extra`` (place, count) for slots counted
    more than once. ``spare`` low bits of every fingerprint are zero and are
    not stored."""

    def __init__(self, quotient_bits: int, spare: int, occupied, run_end, remainders, extra_at, extra_count):
        self.q, self.spare = quotient_bits, spare
        self.occupied, self.run_end = occupied, run_end
        self.remainders, self.extra_at, self.extra_count = remainders, extra_at, extra_count

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, quotient_bits: int, spare: int = 0) -> "CountingQuotientFilter":
        """From sorted distinct fingerprints (uint64) and their counts."""
        shift = np.uint64(64 - quotient_bits)
        quotient = prints >> shift
        occupied = np.zeros(1 << quotient_bits, dtype=bool)
        occupied[quotient.astype(np.int64)] = True
        run_end = np.ones(len(prints), dtype=bool)
        run_end[:-1] = quotient[1:] != quotient[:-1]
        at = np.flatnonzero(counts > 1)
        remainders = (prints & ((np.uint64(1) << shift) - np.uint64(1))) >> np.uint64(spare)
        return cls(quotient_bits, spare, np.packbits(occupied), np.packbits(run_end), remainders, at.astype(np.uint32), counts[at].astype(np.int64))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Back to sorted fingerprints and counts: nothing is lost."""
        n = len(self.remainders)
        ends = np.unpackbits(self.run_end, count=n).astype(bool)
        owners = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q)).astype(np.uint64)
        run = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        counts = np.ones(n, dtype=np.int64)
        counts[self.extra_at] = self.extra_count
        return (owners[run] << np.uint64(64 - self.q)) | (self.remainders << np.uint64(self.spare)), counts

    def to_bytes(self) -> bytes:
        head = np.array([self.q, self.spare, len(self.remainders), len(self.extra_at)], dtype="<i8").tobytes()
        return b"".join([head, self.occupied.tobytes(), self.run_end.tobytes(), _pack_bits(self.remainders, 64 - self.q - self.spare),
                         self.extra_at.astype("<u4").tobytes(), self.extra_count.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CountingQuotientFilter":
        q, spare, n, m = (int(x) for x in np.frombuffer(raw, "<i8", 4))
        width = 64 - q - spare
        at, out = 32, []
        for kind, size in (("u1", ((1 << q) + 7) // 8), ("u1", (n + 7) // 8), ("u1", (n * width + 7) // 8), ("<u4", m), ("<i8", m)):
            out.append(np.frombuffer(raw, kind, size, at))
            at += np.dtype(kind).itemsize * size
        out[2] = _unpack_bits(out[2], width, n)
        return cls(q, spare, *out)

    @classmethod
    def merge(cls, filters: list["CountingQuotientFilter"]) -> tuple[np.ndarray, np.ndarray]:
        """Union with counts added. The slots of a filter are in order, so
        neighbours are merged pair by pair until one sequence is left."""
        parts = [f.entries() for f in filters] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        while len(parts) > 1:
            parts = [_merge_two(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``, in the JVM."""
    for c in WHITE.decode():
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _fingerprints(batches):
    import xxhash
    for b in batches:
        n_chars, fp, sha = [], [], []
        for _, texts in text_slices(b):
            for t in texts:
                bare = t.encode("utf-8").translate(None, WHITE)
                n_chars.append(len(t))
                fp.append(xxhash.xxh64_intdigest(bare, 42))
                sha.append(hashlib.sha256(bare).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_chars, pa.int64()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)),
             pa.array(sha, pa.string()), *b.columns[2:]], names=["doc_id", "n_chars", "fp", "text_sha256", "row", *TEXT_KEYS])


def _build_filters(range_bits: int):
    """Partition -> rows (range, filter bytes)."""
    def flush(held):
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        ranges = (prints >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(prints), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])).tolist() + [len(prints)]
        rows, blobs = [], []
        for a, b in zip(cuts, cuts[1:]):
            rows.append(int(ranges[a]))
            # the range number leads every quotient of the cut, so it is left out of the slots;
            # about as many quotients as slots keep the remainders short
            bits = max(1, min(30, int(b - a).bit_length() - 1))
            blobs.append(CountingQuotientFilter.build(prints[a:b] << np.uint64(range_bits), counts[a:b], bits, range_bits).to_bytes())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "filter"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= FILTER_ROWS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)
    return run


def _merge_range(range_bits: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        prints, counts = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]])
        many = counts > 1
        prints = prints[many]
        if range_bits:
            prints = (prints >> np.uint64(range_bits)) | (np.uint64(key[0]) << np.uint64(64 - range_bits))
        return pd.DataFrame({"fp": prints.view(np.int64), "n": counts[many]})
    return run


def repeated_fingerprints(meta: DataFrame, n_rows: int) -> DataFrame:
    """fp, n of the fingerprints that the merged filters count more than once."""
    range_bits = max(5, int(np.ceil(np.log2(max(1, n_rows / RANGE_ROWS)))))
    filters = map_batches(meta.select("fp"), _build_filters(range_bits), "range long, filter binary")
    return filters.groupBy("range").applyInPandas(_merge_range(range_bits), "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chars and the text's
    keys (``common.text_keys``) per row.

    Of equal texts the row with the most code points stays, then the smallest
    id."""
    src = texts_of(docs, id_col, text_col)
    rows = src.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), *text_keys(F.col("text")))
    # the row number is stored here, and read from here only
    meta = write_scratch(map_batches(rows, _fingerprints, f"doc_id long, n_chars long, fp long, text_sha256 string, row long, "
                                     f"{', '.join(f'{k} long' for k in TEXT_KEYS)}"), "exact-meta")
    repeated = write_scratch(repeated_fingerprints(meta, meta.count()), "exact-repeated")
    n_repeated = repeated.count()
    hit = repeated.select("fp")
    hit = F.broadcast(hit) if n_repeated <= BROADCAST_ROWS else hit
    bare = src.select(normalised(F.col("text")).alias("bare")).withColumn("fp", F.xxhash64("bare"))
    verified = (bare.join(hit, "fp", "left_semi").groupBy("fp", F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"))
                .agg(F.count(F.lit(1)).alias("group_size"), F.min("bare").alias("low"), F.max("bare").alias("high"))
                .select("fp", "text_sha256", F.when(F.col("low") == F.col("high"), F.col("group_size"))
                        .otherwise(F.raise_error(F.lit("texts of one SHA-256 differ in their bytes"))).alias("group_size")))
    first = (meta.join(hit, "fp", "left_semi").groupBy("fp", "text_sha256")
             .agg(F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *TEXT_KEYS, "row")).alias("best")))
    groups = write_scratch(verified.join(first, ["fp", "text_sha256"]), "exact-groups")   # its own exchange, so that a hot group's rows can be split
    joined = meta.join(groups, ["fp", "text_sha256"], "left")
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         (F.col("best").isNull() | (F.col("row") == F.col("best.row"))).alias("kept"), "text_sha256", "n_chars", *TEXT_KEYS)
