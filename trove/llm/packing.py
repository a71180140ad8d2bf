"""Operator 3, mixture-controlled packing by deficit round-robin.

Every source is a queue of documents. In each round a source earns a quantum
of ``window * share`` tokens; it sends its next packets (a document, or
``packet`` tokens of a longer one) as long as the tokens it has earned cover
them, and what is left is its deficit, carried to the next round. The stream
of packets is cut into windows of ``window`` tokens, so every window holds the
target proportions to within one packet a source.

The queue position of a packet decides its round: the packet that ends at
token e of a queue with quantum q leaves in round ceil(e / q), because that is
the first round by which e tokens have been earned. So deficits carry over
windows and over partitions without any task waiting for another: positions
are running totals, taken in levels (rows of a block of rounds, then blocks,
then groups of blocks), and no group grows with the corpus or with a source.

Token ids are made once and stored as Parquet in the shared folder; the plan
works on lengths only and is joined back to them. All windows are full; the
last tokens go to sequences whose lengths are the powers of two of their
number, so nothing is padded.

Defined results: null text is empty and packs its end token; null sources are
one queue; repeated rows and null ids are documents like any other (rows are
told apart by their place in the stored table); an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import batch_slices, map_batches, texts_of, tokenizer_path, vocabulary_bytes, worker_cache

#: Rounds whose packets are ranked together: about ROUNDS * window tokens.
ROUNDS = 1024
#: Blocks of rounds that are added up together.
BLOCKS = 4096

_ENCODERS = worker_cache()


def _encoder(raw: bytes):
    from . import bpe
    v = bpe.load(raw)
    if id(v) not in _ENCODERS:      # v lives as long as this, in bpe._LOADED
        _ENCODERS[id(v)] = bpe.ByteEncoder(v)
    return _ENCODERS[id(v)]


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str,
              source_col: str) -> DataFrame:
    """Stored (doc_id, queue, part, row, before, n, ids): ``before`` counts the
    tokens of the same queue earlier in the same partition."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches):
        from pyspark import TaskContext
        part, row, earned = TaskContext.get().partitionId(), 0, {}
        for b in batches:
            encoder = _encoder(raw.value)
            kind = "<u2" if max(encoder.v.token_of) < 65536 and end_id < 65536 else "<u4"
            for rows, texts in batch_slices(b, 1):
                before, counts, blobs = [], [], []
                for q, own in zip(rows.column(2).to_pylist(), encoder.encode_all(texts)):
                    ids = np.append(own, np.uint32(end_id))
                    before.append(earned.get(q, 0))
                    earned[q] = before[-1] + len(ids)
                    counts.append(len(ids))
                    blobs.append(ids.astype(kind).tobytes())
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()),
                     pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["doc_id", "queue", "part", "row", "before", "n", "ids"])
                row += n

    src = texts_of(docs, id_col, text_col, source_col).toDF("doc_id", "text", "queue")
    src = src.withColumn("queue", F.when(F.col("queue").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("queue").cast("string"))))
    return write_scratch(map_batches(src, run, "doc_id long, queue string, part int, row long, before long, n long, ids binary"),
                         "packing-ids")


def totals_before(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, base): the sum of ``value`` over all smaller keys, in two levels."""
    blocks = df.groupBy(key).agg(F.sum(value).alias("own")).withColumn("upper", F.floor(F.col(key) / BLOCKS))
    upper = blocks.groupBy("upper").agg(F.sum("own").alias("all"))
    upper = upper.select("upper", (F.sum("all").over(Window.orderBy("upper")) - F.col("all")).alias("start"))
    inner = F.sum("own").over(Window.partitionBy("upper").orderBy(key)) - F.col("own")
    return blocks.withColumn("inner", inner).join(upper, "upper").select(key, (F.col("start") + F.col("inner")).alias("base"))


def _quanta(per_queue: DataFrame, total: int, window: int, targets: dict[str, float] | None) -> DataFrame:
    """(queue, quantum) from target proportions; a queue without one shares what
    the others leave by its tokens (all queues, if none has one)."""
    if not targets:
        return per_queue.select("queue", (F.lit(float(window)) * F.col("tokens") / F.lit(float(total))).alias("quantum"))
    named = F.create_map(*[x for k, v in targets.items() for x in (F.lit("+" + k), F.lit(float(v)))])
    own = named[F.col("queue")]
    left = max(1.0 - sum(targets.values()), 1e-6)
    unnamed = per_queue.where(own.isNull()).agg(F.coalesce(F.sum("tokens"), F.lit(1))).first()[0]
    return per_queue.select("queue", (F.lit(float(window)) * F.coalesce(
        own, F.lit(left) * F.col("tokens") / F.lit(float(unnamed)))).alias("quantum"))


def pack(docs: DataFrame, window: int = 2048, packet: int = 512, end_id: int = 1,
         targets: dict[str, float] | None = None, vocabulary: str | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    source) of sequences of at most ``window`` tokens.

    ``targets`` are token proportions by source; by default each source has the
    proportion of its tokens, so that all queues end together."""
    stored = tokenised(docs, vocabulary or tokenizer_path("byte_bpe_50k.json"), end_id, id_col, text_col, source_col)
    parts = stored.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    parts = write_scratch(parts, "packing-parts")                    # a row per partition and source
    per_queue = parts.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    total = per_queue.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    quanta = _quanta(per_queue, max(1, total), window, targets)
    earlier = F.sum("tokens").over(Window.partitionBy("queue").orderBy("part")) - F.col("tokens")
    bases = parts.select("queue", "part", earlier.alias("queue_base")).join(quanta, "queue")
    packets = (stored.select("queue", "part", "row", "before", "n").join(bases, ["queue", "part"])
               .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / packet))))
               .withColumn("start", F.col("j") * packet)
               .withColumn("len", F.least(F.lit(packet).cast("long"), F.col("n") - F.col("start")))
               .withColumn("end", F.col("queue_base") + F.col("before") + F.col("start") + F.col("len"))
               .withColumn("round", F.ceil(F.col("end") / F.col("quantum")))
               .select("part", "row", "start", "len", "round", "queue", "end", F.floor(F.col("round") / ROUNDS).alias("block")))
    block_base = totals_before(packets, "block", "len")
    rank = Window.partitionBy("block").orderBy("round", "queue", "end")
    placed = (packets.withColumn("inner", F.sum("len").over(rank) - F.col("len"))
              .join(block_base, "block").withColumn("at", F.col("base") + F.col("inner")))
    by_row = placed.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("start", "len", "at"))).alias("packets"))
    cuts = _tail_cuts(total, window)
    full = total // window

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, queue, n, blob, packets_ in zip(*(b.column(i).to_pylist() for i in range(5))):
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                pieces: list[list[int]] = []                          # [start, length, sequence, offset]
                for p in packets_:
                    start, at, left = p["start"], p["at"], p["len"]
                    while left:
                        if at < full * window:
                            seq, begin = at // window, at // window * window
                            stop = begin + window
                        else:
                            k = next(i for i in range(len(cuts) - 1) if cuts[i] <= at < cuts[i + 1])
                            seq, begin, stop = full + k, cuts[k], cuts[k + 1]
                        take = min(left, stop - at)
                        last = pieces[-1] if pieces else None
                        if last and last[2] == seq and last[3] + last[1] == at - begin and last[0] + last[1] == start:
                            last[1] += take
                        else:
                            pieces.append([start, take, seq, at - begin])
                        start, at, left = start + take, at + take, left - take
                out += [(doc, s, m, zlib.crc32(ids[s:s + m].tobytes()), n, seq, off, queue[1:] if queue[0] == "+" else None)
                        for s, m, seq, off in pieces]
            cols = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(cols)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    joined = stored.select("part", "row", "doc_id", "queue", "n", "ids").join(by_row, ["part", "row"])
    return map_batches(joined.select("doc_id", "queue", "n", "ids", "packets"), cut,
                       "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def _tail_cuts(total: int, window: int) -> list[int]:
    """Places that cut the tokens after the last full window into lengths that
    are powers of two."""
    at, left = total // window * window, total % window
    cuts = [at]
    while left:
        size = 1 << int(math.log2(left))
        at, left = at + size, left - size
        cuts.append(at)
    return cuts
