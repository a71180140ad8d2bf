"""Operator 7, token counts: heap-and-linked-list byte-pair merging.

Each distinct word is merged by repeatedly popping the lowest-rank adjacent
pair from a heap over a linked list; its count is its initial symbols minus
its merges, and no identifiers are made. Row-local: no shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
each give a row; a null id stays null; an empty table gives no rows; extra
columns are left behind. Texts are never cut.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_slices, texts_of, tokenizer_path, vocabulary_bytes, worker_cache

_COUNTERS = worker_cache()


def _counter(raw: bytes):
    from . import bpe
    v = bpe.load(raw)
    if id(v) not in _COUNTERS:      # v lives as long as this, in bpe._LOADED
        _COUNTERS[id(v)] = bpe.ByteCounter(v)
    return _COUNTERS[id(v)]


def token_counts(docs: DataFrame, limit: int, vocabulary: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``vocabulary`` is the path of a byte-level BPE file (default
    byte_bpe_50k.json); its size is checked before it is broadcast."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or tokenizer_path("byte_bpe_50k.json")))

    def run(batches):
        counter = None
        for b in batches:
            if counter is None:
                counter = _counter(raw.value)
            n_bytes, n_tokens = [], []
            for _, texts in text_slices(b):
                for t in texts:
                    n_bytes.append(len(t.encode("utf-8")))
                    n_tokens.append(counter.count(t))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    out = map_batches(texts_of(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
