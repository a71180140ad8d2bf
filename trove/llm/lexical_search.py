"""Operator 12, ranked lexical search by an Aho-Corasick document scan.

The terms of all items make one automaton. Each term stands in it between two
boundary bytes, and the scanned text has every byte outside a term turned into
the boundary, so that only whole terms match. Term frequencies are counted
straight from the texts; no index of the documents is made or stored.

Two scans: the first counts documents, terms and, per item term, documents
holding it (a row per term and task, summed on Spark); the second counts again
with the weights at hand, maps each term to its items, and keeps every task's
k best documents of each item. Rows that leave a task are bounded by the items,
and so is all that is broadcast: items are dealt into blocks until a block's
texts fit ``BLOCK_BYTES`` or it holds a single item, and each block has scans
of its own.

Defined results: a null or empty text has no terms and is no document; a
document is a row, so repeated rows rank one below the other; rows without an
id take part and come last among equal scores; items that share an id (or have
none) are one item with the terms of all its rows; an item without terms, or
without a document that scores above 0, has no row; empty tables give no rows;
extra columns are left behind. Texts are never cut.
"""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import map_batches

#: Bytes of item texts that one automaton is built from.
BLOCK_BYTES = 4 << 20
#: Cells (documents x items) scored at a time.
CELLS = 1 << 22
#: Tasks' best rows are ranked in this many groups an item before the last ranking.
GROUPS = 32
#: Sorts after every id.
NO_ID = np.iinfo(np.int64).max

_BOUNDARY = 0x20
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else _BOUNDARY
              for b in range(256))


def folded(text: bytes) -> bytes:
    """UTF-8 bytes with A-Z in lower case, all that is in no term a boundary,
    and a boundary at both ends. No byte of a longer character is a boundary."""
    return b" " + text.translate(_FOLD) + b" "


def n_terms(text: bytes) -> int:
    """Terms of a folded text, with repeats."""
    edge = np.frombuffer(text, np.uint8) == _BOUNDARY
    return int(np.count_nonzero(edge[:-1] & ~edge[1:]))


class Terms:
    """What the tasks get: the terms, each one's items, and from the second
    scan on the weights and the corpus' counts."""

    def __init__(self, items: dict):
        counts = {i: Counter(t for text in texts for t in folded(text).split()) for i, texts in items.items()}
        self.ids = list(items)
        self.terms = sorted({t for c in counts.values() for t in c})
        number = {t: k for k, t in enumerate(self.terms)}
        holders: list[list[tuple[int, int]]] = [[] for _ in self.terms]
        for k, i in enumerate(self.ids):
            for t, n in counts[i].items():
                holders[number[t]].append((k, n))
        self.first = np.concatenate(([0], np.cumsum([len(h) for h in holders]))).astype(np.int64)
        flat = [x for h in holders for x in h]
        self.item = np.array([x[0] for x in flat], np.int64)
        self.times = np.array([x[1] for x in flat], np.int64)
        self.weight = np.zeros(len(self.terms), np.int64)
        self.n_docs = self.n_tokens = 0

    def weigh(self, holding: dict[int, int], n_docs: int, n_tokens: int) -> None:
        self.n_docs, self.n_tokens = n_docs, n_tokens
        for k in range(len(self.terms)):
            self.weight[k] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(k, 0) + 1)))

    def automaton(self):
        a = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            a.add_word(f" {t.decode('latin-1')} ", k)       # one character a byte
        a.make_automaton()
        return a


def _frequencies(automaton, text: bytes) -> Counter:
    return Counter(k for _, k in automaton.iter(text.decode("latin-1")))


class Best:
    """The k best documents of every item so far, as dense arrays."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = np.zeros((n_items, k), np.int64)       # 0: no document
        self.doc = np.full((n_items, k), NO_ID, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores``: documents x items."""
        least, last = self.score[:, -1], self.doc[:, -1]
        better = (scores > least) | ((scores == least) & (scores > 0) & (docs[:, None] < last))
        if len(docs) > self.k:
            at = len(docs) - self.k
            better &= scores >= np.partition(scores, at, axis=0)[at]
        row, item = np.nonzero(better)
        if not len(row):
            return
        touched = np.unique(item)
        item = np.concatenate((item, np.repeat(touched, self.k)))
        score = np.concatenate((scores[better], self.score[touched].ravel()))
        doc = np.concatenate((docs[row], self.doc[touched].ravel()))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        rank = np.arange(len(item)) - np.repeat(start, np.diff(np.concatenate((start, [len(item)]))))
        keep = rank < self.k
        self.score[item[keep], rank[keep]], self.doc[item[keep], rank[keep]] = score[keep], doc[keep]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).where(F.col("text").isNotNull()))


def _count(docs: DataFrame, terms: Broadcast) -> tuple[dict[int, int], int, int]:
    """Documents holding each term, documents, terms of all documents."""
    def run(batches):
        automaton, holding, n_docs, n_tokens = terms.value.automaton(), Counter(), 0, 0
        for b in batches:
            for text in b.column(1):
                text = folded(text.as_py())
                n = n_terms(text)
                if n:
                    n_docs, n_tokens = n_docs + 1, n_tokens + n
                    holding.update(_frequencies(automaton, text).keys())
        rows = [*holding.items(), (-1, n_docs), (-2, n_tokens)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], names=["term", "n"])

    counted = map_batches(docs, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in counted.toLocalIterator()}             # at most a row per item term
    return found, found.pop(-1, 0), found.pop(-2, 0)


def _rank(docs: DataFrame, terms: Broadcast, k: int) -> DataFrame:
    """(item number, doc_id, score) of each task's k best documents of an item."""
    def run(batches):
        t = terms.value
        automaton, n_items = t.automaton(), len(t.ids)
        best = Best(n_items, k)
        most = max(1, CELLS // n_items)
        ids, parts = [], []

        def flush():
            if ids:
                size = np.array([len(p[0]) for p in parts])
                held, value = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                cell = np.repeat(np.arange(len(ids)) * n_items, size)
                width = t.first[held + 1] - t.first[held]
                spot = np.arange(width.sum()) + np.repeat(t.first[held] - (np.cumsum(width) - width), width)
                scores = np.zeros(len(ids) * n_items, np.int64)
                np.add.at(scores, np.repeat(cell, width) + t.item[spot], np.repeat(value, width) * t.times[spot])
                best.add(scores.reshape(len(ids), n_items), np.array(ids, np.int64))
                ids.clear()
                parts.clear()

        work = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = folded(text.as_py())
                tf = _frequencies(automaton, text)
                if not tf:
                    continue
                m = 100 - 75 + (75 * n_terms(text) * t.n_docs) // t.n_tokens
                held, n = np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))
                parts.append((held, t.weight[held] * ((1000000000 * n) // (1000 * n + 8 * m))))
                ids.append(NO_ID if doc_id is None else doc_id)
                work += int((t.first[held + 1] - t.first[held]).sum())
                if len(ids) >= most or work >= CELLS:
                    flush()
                    work = 0
        flush()
        item, rank = np.nonzero(best.score)
        doc = best.doc[item, rank]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(best.score[item, rank])],
                                         names=["item", "doc_id", "score"])

    return map_batches(docs, run, "item long, doc_id long, score long")


def _blocks(items: DataFrame, item: Column, text: Column) -> tuple[DataFrame, int]:
    """(item_id, text, block) and the number of blocks: no block's texts are
    larger than ``BLOCK_BYTES`` unless it holds one item only."""
    rows = items.select(item.alias("item_id"), text.cast("string").cast("binary").alias("text")).where("text is not null")
    sizes = write_scratch(rows.groupBy("item_id").agg(F.sum(F.octet_length("text")).alias("bytes")), "lexical-items")
    n = 1
    while True:
        block = F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))), F.lit(n)).cast("int")
        crowded = (sizes.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("items"))
                   .where((F.col("bytes") > BLOCK_BYTES) & (F.col("items") > 1)))
        if crowded.isEmpty():
            return rows.withColumn("block", block), n
        n *= 2


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of highest
    score above 0 of every item, equal scores by ascending id."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    kind = items.schema[item_col].dataType
    rows, n_blocks = _blocks(items, F.col(f"`{item_col}`"), F.col(f"`{item_text_col}`"))
    ranked = None
    for b in range(n_blocks):
        texts_of_item: dict = {}
        for r in rows.where(F.col("block") == b).toLocalIterator():       # bounded by BLOCK_BYTES
            texts_of_item.setdefault(r.item_id, []).append(bytes(r.text))
        terms = Terms(texts_of_item)
        if not terms.terms:
            continue
        first = spark.sparkContext.broadcast(terms)
        terms.weigh(*_count(texts, first))
        first.destroy()
        if not terms.n_docs:
            continue
        hits = _rank(texts, spark.sparkContext.broadcast(terms), k)
        names = spark.createDataFrame(list(enumerate(terms.ids)), f"item long, item_id {kind.simpleString()}")
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        hits = (hits.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
                .withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= k)
                .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
                .join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        ranked = hits if ranked is None else ranked.unionByName(hits)
    if ranked is None:
        ranked = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return ranked
