"""Operator 4, substring dedup by seed and extend.

A frame is ``length`` consecutive words of one document. Winnowing picks, for
each frame, its smallest ``gram``-word hash: the anchor (seed). Equal frames
pick the same anchor at the same place, so documents can only share a frame if
they share its anchor.

1. Seed: anchors that occur in one document only are dropped; the rest join
   documents on the anchor's hash.
2. Extend: a seed is extended to the left and right over all frames that
   picked it, which gives its reach. Occurrences of a seed with equal reach
   agree in every frame: all but those of the smallest document repeat as a
   whole. This settles the inside of every shared passage with one row per
   occurrence and never pairs occurrences with each other.
3. Where reaches differ (the edges of shared passages), the smallest document
   of each reach extends frame by frame: its frames are compared by hash with
   those of the other reaches of the seed.

Repeats of frames that touch or overlap are one maximal repeat; its words are
removed. Group sizes only ever meet partial aggregation (min, max), whatever
the number of documents that share a passage.

Hashes: 64 bits of a polynomial over word hashes for the seed and again for
the reach or frame, compared together.

Defined results: null text has no words; texts with fewer words than a frame
keep all; rows that repeat an id are judged each against smaller ids only;
null ids count as larger than every id; extra columns are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import MEMO_LIMIT, map_batches, text_slices, texts_of, worker_cache

#: Keys (8 or 16 bytes) up to which a semi-join is broadcast; beyond it the
#: same join shuffles.
BROADCAST_ROWS = 1 << 20
LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n modulo 2 ** 64, kept and grown per worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base & _MASK, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """Hashes of any run of words of one text from prefix sums."""

    def __init__(self, words: list[bytes], memo: dict):
        n = len(words)
        h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n + 1)[:n], dtype=np.uint64)])
        self.back = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.back[start])


class _WordMemo(dict):
    def __missing__(self, word):
        import xxhash
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_MEMO = worker_cache(_WordMemo())


def _hashes(words: list[bytes]) -> WordHashes:
    if len(_MEMO) > MEMO_LIMIT:
        _MEMO.clear()
    return WordHashes(words, _MEMO)


def anchors(words: list[bytes], length: int, gram: int):
    """(first frame, reach in words, seed hash, reach hash) of each winnowed
    anchor; empty for texts shorter than a frame."""
    n = len(words)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    h = _hashes(words)
    g = h.of(np.arange(n - gram + 1), gram)
    per = length - gram + 1
    frames = n - length + 1
    at = np.empty(frames, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, per)
    for k in range(0, frames, 1 << 16):
        at[k:k + (1 << 16)] = view[k:k + (1 << 16)].argmin(axis=1)
    at += np.arange(frames)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [frames]]) - 1
    reach = last - first + length
    cell = _mixed(h.of(first, reach) ^ _mixed(((at[first] - first) << 32 | reach).astype(np.uint64)))
    return first, reach, g[at[first]].view(np.int64), cell.view(np.int64)


def _survey(length: int, gram: int):
    def run(batches):
        for b in batches:
            n_words, sha, lists = [], [], [[], [], [], []]
            for _, texts in text_slices(b):
                for t in texts:
                    words = t.encode("utf-8").split()
                    n_words.append(len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    for held, x in zip(lists, anchors(words, length, gram)):
                        held.append(x)
            cols = [pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.int32())),
                    pa.array(lists[2], pa.list_(pa.int64())), pa.array(lists[3], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), *cols],
                                             names=["doc_id", "d", "th", "n_words", "sha", "first", "reach", "seed", "cell"])
    return run


def _frames(length: int):
    """Hashes of the frames that are asked for."""
    def run(batches):
        for b in batches:
            d, th, seed, at, fh = [], [], [], [], []
            for doc, key, text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                h = _hashes(text.as_py().encode("utf-8").split())
                start = np.concatenate([np.arange(a["first"], a["first"] + a["reach"] - length + 1) for a in asked])
                each = [a["reach"] - length + 1 for a in asked]
                seed.append(np.repeat(np.array([a["seed"] for a in asked], dtype=np.int64), each))
                at.append(start)
                fh.append(h.of(start, length).view(np.int64))
                d.append(np.full(len(start), doc))
                th.append(np.full(len(start), key))
            if d:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (d, th, seed, at, fh)], names=["d", "th", "seed", "at", "fh"])
    return run


def _remove(batches):
    for b in batches:
        removed, sha = [], []
        for text, spans in zip(b.column(3), b.column(4).to_pylist()):
            words = text.as_py().encode("utf-8").split()
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for s in spans:
                edge[s["first"]] += 1
                edge[s["first"] + s["reach"]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join([w for w, x in zip(words, gone.tolist()) if not x])).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                                         names=["d", "th", "n_words", "n_removed", "kept_sha256"])


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a key table if its measured size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeats(docs: DataFrame, length: int = 50, gram: int = 10, id_col: str = "doc_id", text_col: str = "text"):
    """(survey, affected, spans): per-document survey, the texts that may repeat,
    and the word spans (d, th, first, reach) to remove."""
    src = texts_of(docs, id_col, text_col).select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("th"))
    survey = write_scratch(map_batches(src, _survey(length, gram), "doc_id long, d long, th long, n_words long, sha string, "
                                       "first array<int>, reach array<int>, seed array<long>, cell array<long>"), "substring-survey")
    pairs = survey.select("d", "th", F.explode(F.arrays_zip("seed", "first", "reach", "cell")).alias("a")).select("d", "th", "a.*")
    seeds = write_scratch(survey.select("d", F.explode("seed").alias("seed")).groupBy("seed")
                          .agg(F.min("d").alias("low"), F.max("d").alias("high")).where(F.col("low") < F.col("high")).select("seed"), "substring-seeds")
    shared = write_scratch(pairs.join(_few(seeds), "seed", "left_semi").distinct(), "substring-shared")
    cells = shared.groupBy("seed", "cell").agg(F.min("d").alias("low"))
    cells = write_scratch(cells, "substring-cells")
    by_seed = write_scratch(cells.groupBy("seed").agg(F.min("low").alias("least"), F.max("low").alias("most"))
                            .where(F.col("least") < F.col("most")).select("seed", F.lit(True).alias("differ")), "substring-differ")
    cells = cells.join(by_seed, "seed", "left")
    told = shared.join(cells, ["seed", "cell"])
    whole = told.where(F.col("d") > F.col("low")).select("d", "th", "first", "reach")
    ask = (told.where((F.col("d") == F.col("low")) & F.col("differ"))
           .groupBy("d", "th").agg(F.collect_list(F.struct("first", "reach", "seed")).alias("asked")))
    whole = write_scratch(whole, "substring-whole")
    ask = write_scratch(ask, "substring-ask")
    keys = write_scratch(whole.select("d", "th").union(ask.select("d", "th")).distinct(), "substring-keys")
    affected = write_scratch(src.select("d", "th", "text").join(_few(keys), ["d", "th"], "left_semi").dropDuplicates(["d", "th"]), "substring-texts")
    frames = write_scratch(map_batches(affected.join(ask, ["d", "th"]).select("d", "th", "text", "asked"), _frames(length),
                                       "d long, th long, seed long, at long, fh long"), "substring-frames")
    first = frames.groupBy("seed", "fh").agg(F.min("d").alias("low"), F.max("d").alias("high")).where(F.col("low") < F.col("high"))
    edges = (frames.join(write_scratch(first, "substring-repeated"), ["seed", "fh"]).where(F.col("d") > F.col("low"))
             .select("d", "th", F.col("at").cast("int").alias("first"), F.lit(length).alias("reach")))
    return survey, affected, whole.union(edges)


def substring_dedup(docs: DataFrame, length: int = 50, gram: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    survey, affected, spans = repeats(docs, length, gram, id_col, text_col)
    per_doc = spans.groupBy("d", "th").agg(F.collect_list(F.struct("first", "reach")).alias("spans"))
    cut = map_batches(affected.join(per_doc, ["d", "th"]).select("d", "th", F.lit(0).cast("long").alias("n_words"), "text", "spans"), _remove,
                      "d long, th long, n_words long, n_removed long, kept_sha256 string").drop("n_words")
    cut = write_scratch(cut, "substring-cut")
    return (survey.select("doc_id", "d", "th", "n_words", "sha").join(cut, ["d", "th"], "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("kept_sha256", "sha").alias("kept_sha256")))
