"""Shared helpers of the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: The ASCII white space of the contracts: space and 0x09-0x0D.
WHITE = b" \t\n\x0b\f\r"
#: Entries kept in a worker's per-word memo before it starts afresh.
MEMO_LIMIT = 600_000
#: Characters of the longest key that is kept there.
MEMO_KEY = 128


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             *others: str) -> DataFrame:
    """Project a document frame to (doc_id, text, ...): null text is empty,
    every other column is left behind."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       *[F.col(f"`{c}`") for c in others])


#: Names of the two 64-bit hashes that stand for a text.
TEXT_KEYS = ["text_key", "text_key2"]


def text_keys(text: Column) -> list[Column]:
    """128 bits of a text, as two hashes of the JVM."""
    return [F.xxhash64(text).alias(TEXT_KEYS[0]), F.xxhash64(F.lit(1), text).alias(TEXT_KEYS[1])]


# Tables that a worker keeps between its tasks, and the operator they belong to.
_CACHES: list[dict] = []
_OWNER: list[str] = []


def worker_cache(cache: dict | None = None) -> dict:
    """A dictionary for what an operator keeps between tasks (a vocabulary, a
    memo); it is emptied when the worker goes on to another operator."""
    _CACHES.append({} if cache is None else cache)
    return _CACHES[-1]


def begin_task(owner: str) -> None:
    """A worker serves one operator after the other; it keeps the tables of the
    present one only."""
    if _OWNER != [owner]:
        for cache in _CACHES:
            cache.clear()
        _OWNER[:] = [owner]


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """mapInArrow with this package shipped to the workers. Between tasks a
    worker keeps no memory but its operator's tables."""
    ship_package(df.sparkSession)
    owner = fn.__module__

    def run(batches):
        begin_task(owner)
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, column: str | int = "text", chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about ``chars`` characters,
    so that the Python objects of a batch never exist all at once."""
    col = batch.column(column)
    start, held, size = 0, [], 0
    for i in range(len(col)):
        t = col[i].as_py() or ""
        held.append(t)
        size += len(t)
        if size >= chars:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def batch_slices(batch: pa.RecordBatch, at: int, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows of ``text_slices`` of column ``at`` as batches (views of
    ``batch``) and their texts: what is made of them can leave piece by piece."""
    for start, texts in text_slices(batch, at, chars):
        yield batch.slice(start, len(texts)), texts


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie: TROVE_TOKENIZERS if set, else the
    ``public_tokenizers`` package."""
    folder = os.environ.get("TROVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def vocabulary_bytes(path: str, max_bytes: int = 64 << 20) -> bytes:
    """A vocabulary file read on the driver (size checked) for a broadcast."""
    if os.path.getsize(path) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    with open(path, "rb") as f:
        return f.read()
