"""Operator 13, periodic run detection by recursive frequency splitting.

A run is a maximal stretch of words with smallest period q and a length of at
least max(min_length, min_repeats * q). Each of its words occurs at least
``min_repeats`` times in it, so a word that occurs less often within a segment
can be in no run there: such words split the segment, and the pieces, in which
further words have become rare, are split again until nothing changes. The
segments that survive are scanned lag by lag: a run of period q is a long
stretch of positions whose word returns q words later. Lags of one octave
share a grid of positions, and a stretch that is long enough holds eight grid
positions in a row, so a lag is compared in full only where eight in a row are
equal.

A lag that is a multiple of a smaller period finds that period's run again;
it is the very same stretch, and is left out. Everything is local to a row: no
shuffle, and a text of any length is one row.

Defined results: a null or empty text, or one of white space only, has no
runs and collapses to an empty text; repeated rows each give a row; a null id
stays null; an empty table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"
#: Characters of collapsed text in one Arrow batch.
BATCH_CHARS = 4 << 20
#: Positions that are compared without a coarser grid before.
DIRECT = 4096
#: Words compared with one octave of lags at a time.
CHUNK_CELLS = 1 << 22


def segments(ids: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces of at least ``shortest`` words in which every
    word occurs ``least`` times or more. A split hands the counts on to its
    largest piece, so the work is the words times the logarithm of their
    number, however often the pieces split."""
    found, todo = [], [(0, ids)]
    while todo:
        base, piece = todo.pop()
        if len(piece) < shortest:
            continue
        _, words, counts = np.unique(piece, return_inverse=True, return_counts=True)
        cuts = np.flatnonzero(counts[words] < least)
        if not len(cuts):
            found.append((base, base + len(piece)))
            continue
        order = np.argsort(words, kind="stable")
        first = np.concatenate(([0], np.cumsum(counts)))
        lo, hi = 0, len(piece)
        while len(cuts):
            edges = np.concatenate(([lo - 1], cuts, [hi]))
            sizes = np.diff(edges) - 1
            heir = int(np.argmax(sizes))
            new_lo, new_hi = int(edges[heir]) + 1, int(edges[heir + 1])
            todo += [(base + int(edges[i]) + 1, piece[edges[i] + 1:edges[i + 1]])
                     for i in np.flatnonzero(sizes >= shortest).tolist() if i != heir]
            gone = np.concatenate((words[lo:new_lo], words[new_hi:hi]))
            np.subtract.at(counts, gone, 1)
            lo, hi = new_lo, new_hi
            if hi - lo < shortest:
                break
            rare = np.unique(gone)
            rare = rare[(counts[rare] > 0) & (counts[rare] < least)]
            spots = [p for w in rare.tolist() for p in _within(order[first[w]:first[w + 1]], lo, hi)]
            cuts = np.array(sorted(spots), dtype=np.int64)
        if hi - lo >= shortest:
            found.append((base + lo, base + hi))
    return sorted(found)


def _within(sorted_spots: np.ndarray, lo: int, hi: int) -> list[int]:
    a, b = np.searchsorted(sorted_spots, (lo, hi))
    return sorted_spots[a:b].tolist()


def _odd(step: int) -> int:
    """The greatest odd step up to ``step``: an even one would see only every
    other word of a text whose words alternate."""
    return max(1, (step - 1) | 1)


def _spans(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the stretches of True that are at least ``least`` long."""
    edges = np.diff(np.concatenate(([0], equal.view(np.int8), [0])))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = end - start >= least
    return list(zip(start[keep].tolist(), end[keep].tolist()))


def _stretches(w: np.ndarray, lag: int, lo: int, hi: int, least: int, step: int) -> list[tuple[int, int]]:
    """Maximal stretches of at least ``least`` positions in [lo, hi) whose word
    returns ``lag`` later; long spans are thinned by finer and finer grids."""
    if hi - lo < least:
        return []
    if step <= 1 or hi - lo <= DIRECT:
        return [(lo + a, lo + b) for a, b in _spans(w[lo:hi] == w[lo + lag:hi + lag], least)]
    fine = _odd(step // 4)
    grid = np.arange(lo, hi, fine)
    out = []
    for a, b in _spans(w[grid] == w[grid + lag], max(1, least // fine)):
        out += _stretches(w, lag, max(lo, int(grid[a]) - fine + 1), min(hi, int(grid[b - 1]) + fine), least, fine)
    return out


def lag_scan(w: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the segment ``w``."""
    m = len(w)
    most = m // min_repeats
    needs = lambda q: max(min_length, min_repeats * q) - q  # noqa: E731  positions whose word returns q later
    runs: list[tuple[int, int, int]] = []
    low = 1
    while low <= most:
        high = min(most, 8 if low == 1 else 2 * low - 1)
        step = _odd(min(needs(q) for q in ((low, high) if low > 1 else range(low, high + 1))) // 8)
        runs_now = [r for r in runs if r[1] >= min_repeats * low]           # shorter ones cannot come back
        for lag, spots in _candidates(w, low, high, step):
            known = sorted((s, s + n - lag) for s, n, q in runs_now if lag % q == 0 and n > lag)
            ends = [e for _, e in known]
            fresh = []
            for a, b in spots:
                for x, y in _gaps(known, ends, a, min(b, m - lag)):
                    fresh += _stretches(w, lag, x, y, needs(lag), step)
            new = [(s, e - s + lag, lag) for s, e in fresh]
            runs += new
            runs_now += new
        low = high + 1
    return runs


def _gaps(known: list, ends: list, a: int, b: int) -> list[tuple[int, int]]:
    """[a, b) without the known stretches, which are disjoint and sorted."""
    out = []
    for i in range(bisect_left(ends, a + 1), len(known)):
        s, e = known[i]
        if s >= b:
            break
        if s > a:
            out.append((a, s))
        a = max(a, e)
    if a < b:
        out.append((a, b))
    return out


def _candidates(w: np.ndarray, low: int, high: int, step: int):
    """(lag, spans) of the lags low..high, ascending, that have eight equal grid
    positions in a row; a span reaches to the unequal grid positions beside."""
    m, lags = len(w), high - low + 1
    padded = np.concatenate((w, np.full(high + 1, -1, w.dtype)))
    ahead = np.lib.stride_tricks.sliding_window_view(padded, lags)
    grid = np.arange(0, m - low, step)
    rows = max(64, CHUNK_CELLS // lags)
    by_lag: dict[int, list[np.ndarray]] = {}
    for at in range(0, max(1, len(grid) - 7), rows):
        part = grid[at:at + rows + 7]
        if len(part) < 8:
            break
        same = ahead[part + low] == w[part][:, None]
        for by in (1, 2, 4):
            same = same[:-by] & same[by:]
        if same.any():
            c, r = np.nonzero(same.T)
            cols, begin = np.unique(c, return_index=True)
            for k, hits in zip(cols.tolist(), np.split(at + r, begin[1:])):
                by_lag.setdefault(k, []).append(hits)
    for k in sorted(by_lag):
        hits = np.concatenate(by_lag[k])
        cut = np.flatnonzero(np.diff(hits) > 1)
        first, last = hits[np.concatenate(([0], cut + 1))], hits[np.concatenate((cut, [len(hits) - 1]))] + 7
        # a group's hits overlap the next one's if fewer than 8 rows lie between them; the unequal row still parts them
        yield low + k, [(max(0, int(grid[f]) - step + 1), int(grid[t]) + step) for f, t in zip(first, last)]


def periodic_runs(ids: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) by start, then period."""
    runs = []
    for lo, hi in segments(ids, min_repeats, min_length):
        runs += [(lo + s, n, q) for s, n, q in lag_scan(ids[lo:hi], min_length, min_repeats)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; ties: the first."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def find_runs(docs: DataFrame, min_length: int = 24, min_repeats: int = 3,
              rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, all runs, the strongest run and the collapsed text: the
    words outside of any run's repeats, which are its words after the first
    period, joined by one space. ``rewrite`` may change a row's words first."""
    if min_repeats < 2 or min_length < 8 * min_repeats:
        raise ValueError("runs need two repeats or more, and eight words a repeat")

    def row(doc_id, text: bytes):
        words = text.split()                                # of bytes: at ASCII white space only
        if rewrite:
            words = rewrite(doc_id, words)
        n = len(words)
        if n < min_length:
            return n, [], None, b" ".join(words)
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int32, n)
        runs = periodic_runs(ids, min_length, min_repeats)
        if runs:
            keep = np.ones(n, dtype=bool)
            for s, length, q in runs:
                keep[s + q:s + length] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        return n, runs, strongest(runs), b" ".join(words)

    def pack(ids, out):
        as_run = lambda r: r and {"start": r[0], "length": r[1], "period": r[2]}
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        n, runs, best, text = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([[as_run(r) for r in x] for x in runs], pa.list_(run)),
             pa.array([as_run(x) for x in best], run), pa.array(text, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    def run(batches):
        for b in batches:
            texts, ids, out, size = b.column(1), [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), texts):
                out.append(row(doc_id, text.as_py()))
                ids.append(doc_id)
                size += len(out[-1][3])
                if size >= BATCH_CHARS:
                    yield pack(ids, out)
                    ids, out, size = [], [], 0
            if out:
                yield pack(ids, out)

    rows = texts_of(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, SCHEMA)
