"""Model inference as Spark jobs, with pluggable models.

Each job takes a user-supplied model (loaded once per Python worker and fed
Arrow batches through ``mapInPandas``) and has a deterministic default built
only from column expressions, so it runs and tests offline.
"""

from __future__ import annotations

from typing import Callable, Iterator, Optional

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, write_scratch

# Fusion weights.
VECTOR_WEIGHT = 0.7
RERANK_WEIGHT = 0.3
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
DEFAULT_DIM = 64
HIST_BINS = 64


def tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs of a text (whole text, in order)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda t: t != "")


def token_bucket(tok: Column, dim: int = DEFAULT_DIM) -> Column:
    """Stable bucket of a token: first 32 bits of its MD5, modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def _bucket_vectors(buckets: pa.Array, dim: int) -> np.ndarray:
    """L2-normalised counts of the bucket numbers in each row's list."""
    n = len(buckets)
    lens = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(buckets).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n), lens) * dim + flat, minlength=n * dim).reshape(n, dim)
    norm = np.sqrt((counts * counts).sum(1))
    return counts / np.where(norm > 0, norm, 1.0)[:, None]


def stored_vectors(vectors: DataFrame) -> DataFrame:
    """Encoded vectors, stored: a search counts its corpus before it reads it,
    and would encode every text or image once for each."""
    return write_scratch(vectors, "encoded-vectors")


def with_text_embedding(df: DataFrame, text_col: str = "text", encoder: Optional[Callable[[list], np.ndarray]] = None,
                        dim: int = DEFAULT_DIM, out_col: str = "embedding") -> DataFrame:
    """Every row with the vector of its whole text; row-local, no shuffle.

    ``encoder`` maps a list of texts to an (n, dim) array. Default: hashed
    term counts, L2-normalised; texts without tokens (or null) get zeros. The
    tokens are hashed in column expressions and counted per Arrow batch.
    """
    ship_package(df.sparkSession)
    given = "__encoder_input__"
    value = F.coalesce(F.col(text_col), F.lit("")) if encoder else \
        F.transform(tokens(F.col(text_col)), lambda t: token_bucket(t, dim))
    src = df.withColumn(given, value)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    names = df.columns

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows == 0:
                continue
            if encoder:
                vecs = np.asarray(encoder(rb.column(given).to_pylist()), dtype=np.float64).reshape(rb.num_rows, -1)
            else:
                vecs = _bucket_vectors(rb.column(given), dim)
            offsets = pa.array(np.arange(rb.num_rows + 1) * vecs.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(vecs.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in names], lists], names=[*names, out_col])

    return src.mapInArrow(fn, schema)


def encode_text_batch(df: DataFrame, id_col: str, text_col: str,
                      encoder: Optional[Callable[[list], np.ndarray]] = None,
                      dim: int = DEFAULT_DIM) -> DataFrame:
    """text -> vector for every row: (id, embedding)."""
    return with_text_embedding(df.select(id_col, text_col), text_col, encoder, dim).select(id_col, "embedding")


def byte_histogram(blobs: list, bins: int = HIST_BINS) -> np.ndarray:
    """Default image encoder: share of bytes in each of ``bins`` equal ranges
    of the byte value (vectorised per blob with ``bincount``)."""
    width = 256 // bins
    out = np.zeros((len(blobs), bins), dtype=np.float64)
    for r, b in enumerate(blobs):
        if b is None or len(b) == 0:
            continue
        v = np.frombuffer(bytes(b), dtype=np.uint8)
        out[r] = np.bincount(v // width, minlength=bins)[:bins] / len(v)
    return out


def with_image_embedding(df: DataFrame, bytes_col: str = "bytes",
                         encoder: Optional[Callable[[list], np.ndarray]] = None,
                         out_col: str = "embedding") -> DataFrame:
    """Every row with the vector of its bytes, in place of the bytes.
    ``encoder`` gets a list of byte strings (decoding to RGB is the encoder's
    job); default: 64-bin byte histogram, zeros for null or empty bytes."""
    encoder = encoder or byte_histogram
    ship_package(df.sparkSession)
    names = [c for c in df.columns if c != bytes_col]
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def fn(it):
        for pdf in it:
            vecs = np.asarray(encoder(pdf[bytes_col].tolist()), dtype=np.float32)
            yield pdf[names].assign(**{out_col: list(vecs.reshape(len(pdf), -1))})

    return df.mapInPandas(fn, schema)


def encode_image_batch(df: DataFrame, id_col: str, bytes_col: str,
                       encoder: Optional[Callable[[list], np.ndarray]] = None) -> DataFrame:
    """bytes -> vector for every row: (id, embedding)."""
    return with_image_embedding(df.select(id_col, bytes_col), bytes_col, encoder)


def rerank_default(query: Column, passage: Column, max_tokens: Optional[int] = None) -> Column:
    """Share of the query's distinct tokens found in the passage (or, as a
    model with an input limit would see it, among its first ``max_tokens``
    tokens); 0.0 for a query without tokens."""
    qt = F.array_distinct(tokens(query))
    pt = F.slice(tokens(passage), 1, max_tokens) if max_tokens else tokens(passage)
    hit = F.size(F.array_intersect(qt, pt))
    return F.when(F.size(qt) > 0, hit.cast("double") / F.size(qt)).otherwise(F.lit(0.0))


def logits_to_score(logits: np.ndarray) -> np.ndarray:
    """1 logit -> sigmoid; 2 or more -> softmax probability of class 1."""
    z = np.asarray(logits, dtype=np.float64)
    if z.ndim == 1 or z.shape[1] == 1:
        z = z.reshape(-1)
        return 1.0 / (1.0 + np.exp(-z))
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e[:, 1] / e.sum(axis=1)


def rerank_score_batch(pairs: DataFrame, query_col: str = "q_text", passage_col: str = "description",
                       scorer: Optional[Callable[[list, list], np.ndarray]] = None,
                       out_col: str = "rerank_score", max_tokens: Optional[int] = None) -> DataFrame:
    """(query, passage) -> score for every row.

    ``scorer`` returns logits for lists of queries and passages and runs in
    ``mapInPandas``; if it raises, the batch gets NULL scores and the fusion
    falls back to the vector score. Default: ``rerank_default`` over whole
    passages, or their first ``max_tokens`` tokens.
    """
    if scorer is None:
        return pairs.withColumn(out_col, rerank_default(F.col(query_col), F.col(passage_col), max_tokens))
    ship_package(pairs.sparkSession)
    schema = T.StructType(pairs.schema.fields + [T.StructField(out_col, T.DoubleType())])

    def fn(it):
        for pdf in it:
            try:
                s = logits_to_score(scorer(pdf[query_col].fillna("").tolist(),
                                           pdf[passage_col].fillna("").tolist()))
            except Exception:  # noqa: BLE001 - scorer failure -> fallback
                s = np.full(len(pdf), np.nan)
            yield pdf.assign(**{out_col: s})

    return pairs.mapInPandas(fn, schema)


def rerank_fuse(vector_score: Column, rerank_score: Column) -> Column:
    """0.7 x vector + 0.3 x rerank; a missing rerank score keeps the vector
    score (scorer failure fallback)."""
    return F.when(rerank_score.isNull() | F.isnan(rerank_score), vector_score) \
            .otherwise(vector_score * F.lit(VECTOR_WEIGHT) + rerank_score * F.lit(RERANK_WEIGHT))


def generate_answers_batch(prompts: DataFrame, fallback_col: str, prompt_col: str = "prompt",
                           generator: Optional[Callable[[list], list]] = None,
                           out_col: str = "answer") -> DataFrame:
    """prompt -> answer per row with a user generator in ``mapInPandas``;
    rows whose generation fails (or all rows without a generator) get the
    template answer from ``fallback_col``."""
    if generator is None:
        return prompts.withColumn(out_col, F.col(fallback_col))
    ship_package(prompts.sparkSession)
    schema = T.StructType(prompts.schema.fields + [T.StructField(out_col, T.StringType())])

    def fn(it):
        for pdf in it:
            try:
                ans = list(generator(pdf[prompt_col].fillna("").tolist()))
            except Exception:  # noqa: BLE001
                ans = [None] * len(pdf)
            ans = [a if isinstance(a, str) else f for a, f in zip(ans, pdf[fallback_col].tolist())]
            yield pdf.assign(**{out_col: ans})

    return prompts.mapInPandas(fn, schema)
