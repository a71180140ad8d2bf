"""Operator 2, SimHash near-dedup with deletion-variant signatures.

Fingerprints within d bits are found by cutting them into so few segments that
one of them differs by at most one bit (two segments of 32 bits for d = 2),
indexing every segment under each variant with one bit left out, joining equal
variants, and verifying the whole distance.

Work is on distinct fingerprints. A variant with two fingerprints is a pair at
once; a variant with more is self-joined; one with over ``BUCKET`` fingerprints
goes by the exact other way: its members are indexed with *two* bits left out
of all 64, where at most four fingerprints can share a variant, so a crowded
neighbourhood costs a fixed number of rows a member, never the square.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero and links like any other; fewer words than a shingle make one
shingle of the whole sequence; repeated rows give a row each in one component;
null ids are rows, a component of null ids only has a null id. Extra columns
are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import TEXT_KEYS, map_batches, text_keys, text_slices, texts_of
from .components import connected_components

#: Fingerprints of one variant up to which its pairs are compared directly:
#: beyond it 64 * BUCKET comparisons a member cost more than the 2,016
#: variants of the other way.
BUCKET = 4096
#: Shingle hashes counted at a time.
CHUNK = 1 << 18


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit SimHash of a text, as a signed long."""
    import xxhash
    w = text.encode("utf-8").lower().split()        # bytes: A-Z only, white space 0x20 and 0x09-0x0D
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, n, CHUNK):
        part = w[at:min(n, at + CHUNK) + words - 1]
        hashes = b"".join([digest(join(g), 42) for g in zip(*[part[i:] for i in range(words)])]) if len(w) >= words \
            else digest(join(w), 42)
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and text_key (a hash that tells texts of one id apart) of every row."""
    def run(batches):
        for b in batches:
            fp = [fingerprint(t, words) for _, texts in text_slices(b) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2), b.column(3)],
                                             names=["doc_id", "fp", *TEXT_KEYS])
    return map_batches(texts_of(docs, id_col, text_col).select("doc_id", "text", *text_keys(F.col("text"))), run,
                       f"doc_id long, fp long, {', '.join(f'{k} long' for k in TEXT_KEYS)}")


def _spread(fps: DataFrame) -> DataFrame:
    """``fps`` over all shuffle partitions before each row becomes many. By a
    hash of fp, not fp itself: Spark would take the exchange of the aggregate
    below for it, which is coalesced to a task or two as its rows are few."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))


def _variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): every segment with one bit left out; the key holds segment,
    place of the bit and the other bits of the segment, without hashing."""
    segments = max_bits // 2 + 1                     # one of them differs by at most one bit
    size = -(-64 // segments)
    places = _spread(fps).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    segment = F.floor(F.col("p") / size).cast("int")
    value = F.expr(f"shiftrightunsigned(fp, cast(floor(p / {size}) as int) * {size})").bitwiseAND(F.lit((1 << size) - 1))
    without = value.bitwiseAND(F.expr(f"~shiftleft(1L, cast(p % {size} as int))"))
    return places.select(F.struct(segment.alias("g"), (F.col("p") % size).cast("int").alias("i"), without.alias("x")).alias("key")
                         if size > 32 else F.expr("shiftleft(cast(p as bigint), 32)").bitwiseOR(without).alias("key"), "fp")


def _near(a: str, b: str, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links that connect every two fingerprints within ``max_bits``
    (2 or more; the way for crowded variants is for 2 bits, for more bits the
    self-join takes every variant)."""
    if max_bits < 2:
        raise ValueError("max_bits must be 2 or more")
    limit = BUCKET if max_bits == 2 else 1 << 40
    variants = _variants(fps, max_bits)
    buckets = write_scratch(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                            .where(F.col("n") > 1), "variants")
    pairs = buckets.where(F.col("n") == 2).where(_near("a", "b", max_bits)).select("a", "b").distinct()
    some = variants.join(buckets.where(F.col("n").between(3, limit)).select("key"), "key", "left_semi")
    joined = (some.select("key", F.col("fp").alias("a"))
              .join(some.select("key", F.col("fp").alias("b")), "key")
              .where((F.col("a") < F.col("b")) & _near("a", "b", max_bits)).select("a", "b").distinct())
    out = pairs.union(joined)
    crowded = buckets.where(F.col("n") > limit).select("key")
    if not crowded.isEmpty():
        out = out.union(_two_left_out(variants.join(crowded, "key", "left_semi").select("fp").distinct()))
    return out.distinct()


def _two_left_out(fps: DataFrame) -> DataFrame:
    """Links among ``fps`` within two bits: at most four share a variant with
    two of the 64 bits left out, and those are all within two bits."""
    both = (_spread(fps).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(62))))
            .withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(63)))))
    rest = both.select("fp", "i", "j", F.col("fp").bitwiseAND(F.expr("~(shiftleft(1L, i) | shiftleft(1L, j))")).alias("x"))
    shared = rest.groupBy("i", "j", "x").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return (shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
            .where(F.col("a") != F.col("b")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable),
    the text's keys (``common.text_keys``), and kept: whether the row has the id
    and text that stand for its component, which are those of the smallest id
    (no id comes last), then of the smallest keys. A component is known by its
    smallest fingerprint, so rows that share an id may lie in several."""
    own = write_scratch(fingerprints(docs, words, id_col, text_col), "simhash")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *TEXT_KEYS)
    nodes = own.groupBy("fp").agg(F.min(name).alias("low"))
    found = connected_components(links(nodes.select("fp"), max_bits))
    rooted = (nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("low").alias("best"))
    of_fp = rooted.join(least, "root").select("fp", "best")
    return own.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        F.col("best.doc_id").alias("component_id"), *TEXT_KEYS, (name == F.col("best")).alias("kept"))
