"""Operator 10, BPE encoding and decoding by a pair occurrence index.

All new words of a slice of the partition share one index from a pair's rank
to its positions; the active ranks are applied in ascending order and the
lists of the neighbouring pairs updated. Words seen before are remembered (up
to a bound), which changes no result. Row-local: no shuffle.

Defined results: a null or empty text encodes to no ids (digests of the empty
string); repeated rows each give a row; a null id stays null; extra columns
are left behind. Texts are never cut.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_slices, texts_of, tokenizer_path, vocabulary_bytes, worker_cache

_ENCODERS = worker_cache()


def _encoder(raw: bytes):
    from . import bpe
    v = bpe.load(raw)
    if id(v) not in _ENCODERS:      # v lives as long as this, in bpe._LOADED
        _ENCODERS[id(v)] = bpe.PairIndexEncoder(v)
    return _ENCODERS[id(v)]


def _per_text(docs, vocabulary, id_col, text_col, fields, schema):
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or tokenizer_path("word_bpe_49k.json")))
    names = [f.split(" ")[0] for f in schema.split(", ")][1:]

    def run(batches):
        encoder = None
        for b in batches:
            if encoder is None:
                encoder = _encoder(raw.value)
            rows: list[tuple] = []
            for _, texts in text_slices(b):
                rows.extend(fields(runs) for runs in encoder.encode(texts))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, types.get(n, pa.string())) for n, c in zip(names, cols)]],
                names=["doc_id", *names])

    return map_batches(texts_of(docs, id_col, text_col), run, schema)


def _ids(runs) -> str:
    return " ".join([r[1] for r in runs if r[0]])


def _decoded(runs) -> str:
    return " ".join([r[2] for r in runs if r[0]])


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) as the vocabulary's own library gives them."""
    def fields(runs):
        return ([int(x) for x in _ids(runs).split()],)
    return _per_text(docs, vocabulary, id_col, text_col, fields, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """doc_id, text of an array of ids: tokens joined by a space, as the
    library does without a decoder; ids unknown to the vocabulary are left out."""
    spark = encoded.sparkSession
    raw = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or tokenizer_path("word_bpe_49k.json")))

    def run(batches):
        from . import bpe
        for b in batches:
            token_of = bpe.load(raw.value).token_of
            texts = [" ".join(token_of[i] for i in x or () if i in token_of) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    src = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return map_batches(src, run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one
    row-local pass, for comparing corpora without moving their ids."""
    def fields(runs):
        return (sum(r[0] for r in runs), hashlib.sha256(_ids(runs).encode()).hexdigest(),
                hashlib.sha256(_decoded(runs).encode("utf-8")).hexdigest())
    return _per_text(docs, vocabulary, id_col, text_col, fields,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
