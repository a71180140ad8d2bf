"""A stored index for substring search: postings of character triples.

The lower-case text of an item is all triples of neighbouring characters, with
two marks at its end so that every character starts one. Items are numbered
within blocks, and a posting row holds, for a triple and a block, the sorted
numbers of the items that have it, as differences. Building is local to a
task: a block's postings come from one numpy pass over its texts; only the
finished rows are shuffled, into parts by the range of the triple.

A query is answered from the rarest of its triples: their postings are
intersected block by block, and the items that remain are the candidates. A
query of one or two characters takes all triples that start with it. So a
search reads the postings of a few triples of its queries, and no text; the
candidates still have to be checked against the texts, which ``keyword`` does.

``add`` numbers further items in blocks of their own and appends their rows:
nothing that is stored is read or written again. Items that are added twice
are found twice and counted once.
"""

from __future__ import annotations

import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, write_scratch
from .sizing import measure

#: A block is closed at this many triples (with repeats between items) or items.
BLOCK_TRIPLES, BLOCK_ITEMS = 1 << 21, 1 << 16
#: Triples of a query that are intersected, rarest first.
TRIPLES = 4
#: Bits of a character in a triple's number, and the mark behind a text.
BITS, MARK = 21, 0x10FFFF + 1
#: Columns of the stored postings.
POSTINGS = "triple long, block string, n int, items binary, part int"
#: Parts of the postings by range of the triple.
PARTS = 64


def triples(text: str) -> np.ndarray:
    """Sorted distinct triples of a text, one number each."""
    c = np.frombuffer((text).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    c = np.concatenate((c, [MARK, MARK]))
    return np.unique(c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])


def pack(numbers: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Item numbers (below BLOCK_ITEMS), sorted within lists that begin at
    ``start``, as differences of two bytes; a list's first is the number itself."""
    step = np.diff(numbers, prepend=0)
    step[start] = numbers[start]
    return step.astype("<u2")


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u2"), dtype=np.int64)


def _block_rows(texts: list[np.ndarray]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(triples, postings, counts) of a block from its items' triples."""
    size = np.array([len(t) for t in texts])
    gram, item = np.concatenate(texts), np.repeat(np.arange(len(texts)), size)
    order = np.argsort(gram, kind="stable")                # items stay in order within a triple
    gram, item = gram[order], item[order]
    start = np.flatnonzero(np.diff(gram, prepend=-1))
    ends = np.append(start[1:], len(gram)) if len(gram) else start
    offsets = np.append(start, len(gram)).astype(np.int32) * 2
    data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(pack(item, start).tobytes())])
    return gram[start], data, ends - start


def _part(triple: Column) -> Column:
    """Part of a triple: the range of its first character, ASCII spread finely."""
    c = F.shiftright(triple, 2 * BITS).cast("int")
    return F.when(c < 128, F.floor(c / 2.5)).otherwise(F.lit(52) + F.least(F.floor((c - 128) / 1024), F.lit(PARTS - 53))).cast("int")


class PostingIndex:
    """The index in a folder: ``postings`` (part, triple, block, n, items) and
    ``blocks`` (block, ids: the items by number). Without a folder the index
    serves a single call: its rows stay as the tasks wrote them, not dealt into
    parts."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.rows = spark, path and path.rstrip("/"), None

    def add(self, items: DataFrame, item_id: str = "item_id", texts: tuple[str, ...] = ("title", "description")) -> "PostingIndex":
        """Indexes the items' texts (null: none); returns the index itself."""
        ship_package(self.spark)
        kind = items.schema[item_id].dataType
        src = items.select(F.col(item_id).alias("id"), *[F.lower(F.coalesce(F.col(t), F.lit(""))).alias(f"t{k}") for k, t in enumerate(texts)])
        cores = self.spark.sparkContext.defaultParallelism
        if len(src.inputFiles()) < 4 * cores:               # few files have few splits; many need no spreading
            src = src.repartition(cores)
        segment, n_texts = uuid.uuid4().hex[:16], len(texts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, ids, size, number = [], [], 0, 0
            task = TaskContext.get().partitionId()

            def close(id_type):
                name = f"{segment}-{task}-{number}"
                gram, data, counts = _block_rows(held)
                names, rows = ["block", "triple", "n", "items", "ids"], len(gram)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.array([len(ids)], pa.int32()), pa.nulls(1, pa.binary()),
                                                  pa.array([ids], pa.list_(id_type))], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([name] * rows, pa.string()), pa.array(gram), pa.array(counts, pa.int32()), data,
                                                  pa.nulls(rows, pa.list_(id_type))], names=names)
            for rb in batches:
                for row in zip(*(c.to_pylist() for c in rb.columns)):
                    own = [triples(t) for t in row[1:1 + n_texts]]
                    held.append(own[0] if len(own) == 1 else np.unique(np.concatenate(own)))
                    ids.append(row[0])
                    size += len(held[-1])
                    if size >= BLOCK_TRIPLES or len(ids) >= BLOCK_ITEMS:
                        yield from close(rb.column(0).type)
                        held, ids, size, number = [], [], 0, number + 1
                id_type = rb.column(0).type
            if ids:
                yield from close(id_type)

        schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("triple", T.LongType()), T.StructField("n", T.IntegerType()),
                               T.StructField("items", T.BinaryType()), T.StructField("ids", T.ArrayType(kind))])
        rows = write_scratch(src.mapInArrow(run, schema), "postings")
        if self.path is None:
            self.rows = rows if self.rows is None else self.rows.unionByName(rows)
            return self
        rows.where("triple is null").select("block", "ids").write.mode("append").parquet(f"{self.path}/blocks")
        rows.where("triple is not null").select(_part(F.col("triple")).alias("part"), "triple", "block", "n", "items") \
            .repartitionByRange("part", "triple", "block").sortWithinPartitions("part", "triple") \
            .write.mode("append").partitionBy("part").parquet(f"{self.path}/postings")
        return self

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        """(postings, blocks)."""
        if self.path is None:
            return (self.rows.where("triple is not null").select("triple", "block", "n", "items", _part(F.col("triple")).alias("part")),
                    self.rows.where("triple is null").select("block", "ids"))
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings"), self.spark.read.parquet(f"{self.path}/blocks")

    def _wanted(self, pieces: DataFrame) -> DataFrame:
        """(query_id, triple, upto): the ranges of triples that a query's
        literal ``piece`` asks for: each of its triples, or for a shorter piece
        all that start with it."""
        c = lambda i: F.ascii(F.substring("piece", i, F.lit(1))).cast("long")
        n = F.length("piece")
        at = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
        one = F.lit(1).cast("long")

        def span(i):
            first, second, third = c(i), c(i + 1), c(i + 2)
            low = F.shiftleft(first, 2 * BITS) + F.when(n >= 2, F.shiftleft(second, BITS)).otherwise(F.lit(0)) + F.when(n >= 3, third).otherwise(F.lit(0))
            width = F.when(n >= 3, one).when(n == 2, F.shiftleft(one, BITS)).otherwise(F.shiftleft(one, 2 * BITS))
            return F.struct(low.alias("triple"), (low + width - 1).alias("upto"))
        spans = pieces.select("query_id", F.explode(at).alias("i"), "piece").select("query_id", span(F.col("i")).alias("s"))
        return spans.select("query_id", "s.triple", "s.upto").distinct()

    def candidates(self, pieces: DataFrame) -> DataFrame:
        """(query_id, item_id): the items that hold the rarest triples of each
        query's ``piece`` (lower-case, one character or more)."""
        ship_package(self.spark)
        wanted = write_scratch(self._wanted(pieces), "posting-wanted")
        postings, blocks = self._tables()
        whole = wanted.where("triple = upto").select("query_id", "triple")
        if self.path:
            parts = [r[0] for r in wanted.select(F.explode(F.sequence(_part(F.col("triple")), _part(F.col("upto"))))).distinct().collect()]   # PARTS at most
            postings = postings.where(F.col("part").isin(parts))
        # how many items each asked triple has: one narrow pass over the asked parts
        asked = whole.select("triple").distinct()
        small = F.broadcast if measure(asked).fits() else lambda df: df
        asked = small(asked)
        counts = postings.join(asked, "triple", "left_semi").groupBy("triple").agg(F.sum("n").alias("items"))
        ranked = whole.join(counts, "triple", "left").groupBy("query_id").agg(
            F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("items", F.lit(0)).alias("items"), "triple"))), 1, TRIPLES).alias("best"))
        rarest = write_scratch(ranked.where(F.col("best")[0]["items"] > 0)
                               .select("query_id", F.size("best").alias("of"), F.explode("best.triple").alias("triple")), "posting-rarest")
        keys = small(rarest.select("triple").distinct())             # some of the asked ones
        met = (postings.join(keys, "triple", "left_semi").select("triple", "block", "items").join(rarest, "triple")
               .groupBy("query_id", "block").agg(F.max("of").alias("of"), F.collect_list("items").alias("lists"))      # TRIPLES lists at most
               .where(F.size("lists") == F.col("of")).select("query_id", "block", "lists"))
        short = wanted.where("triple < upto").join(whole.select("query_id").distinct(), "query_id", "left_anti")
        if not short.isEmpty():
            # triples that start with a short piece: equal in the first character, then within the range
            first = lambda c: F.shiftright(c, 2 * BITS).alias("first")
            near = short.select("query_id", F.col("triple").alias("low"), "upto", first(F.col("triple")))
            near = F.broadcast(near) if measure(near).fits() else near
            each = postings.select("triple", "block", "items", first(F.col("triple"))).join(near, "first") \
                .where(F.col("triple").between(F.col("low"), F.col("upto"))).select("query_id", "block", F.array("items").alias("lists"))
            met = met.unionByName(each)
        placed = (_intersected(met).groupBy("query_id", "block").agg(F.collect_set("number").alias("numbers"))          # BLOCK_ITEMS numbers at most
                  .join(blocks, "block"))
        return placed.select("query_id", F.explode(F.transform("numbers", lambda i: F.get("ids", i))).alias("item_id")).distinct()


def _intersected(met: DataFrame) -> DataFrame:
    """(query_id, block, number) of the items that are in all of a row's ``lists``."""
    schema = T.StructType([met.schema["query_id"], T.StructField("block", T.StringType()), T.StructField("number", T.IntegerType())])

    def run(batches):
        for rb in batches:
            at, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, lists in enumerate(rb.column(2).to_pylist()):
                lists.sort(key=len)
                held = unpack(lists[0])
                for x in lists[1:]:
                    held = np.intersect1d(held, unpack(x), assume_unique=True)
                numbers.append(held)
                at.append(np.full(len(held), i))
            rows = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([rb.column(0).take(rows), rb.column(1).take(rows), pa.array(np.concatenate(numbers), pa.int32())],
                                             names=["query_id", "block", "number"])
    return met.mapInArrow(run, schema)
