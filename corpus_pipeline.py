"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup,
personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of ``docs``. ``run`` writes each stage's
rows as Parquet in the shared folder and reads them back for the next.

Defined results: documents are rows; a stage never needs ids to be unique or
present. Unrelated texts that share an id all stay. Rows that repeat id and
text are one document and stay once. One row stays of a group of copies, with
or without ids, and one with an id comes before one without. Null texts count
as empty, and leave the personal-data stage as empty texts. Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.llm import exact_dedup, packing, pii, quality, simhash
from trove.llm.common import TEXT_KEYS, read_table, text_keys
from trove.session import drop_scratch, stored_result, write_scratch

#: Rows of a key table (up to 100 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 1 << 18
#: The pseudonym key of the sample pipeline; a deployment passes its own.
KEY = b"trove sample key"
SCORE = "__quality_score__"
#: Columns that name a document: its id and the keys of its text.
KEYS = ["__doc_id__", "__text_key__", "__text_key2__"]


def _kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a dedup operator keeps.

    ``rows`` has doc_id, the text's keys and kept of every row of ``docs``. A
    key is an id (or none) together with 128 bits of the text, so texts that
    share an id, or have none, are told apart. Rows of a key are one document:
    they stay once if any is kept, and texts are shuffled for that only where
    a kept key has several rows. Key tables are broadcast if their measured
    size allows it, otherwise the same joins shuffle."""
    own = dict(zip(KEYS, (docs["doc_id"].cast("long"), *text_keys(_text(docs)))))
    keys = write_scratch(rows.groupBy("doc_id", *TEXT_KEYS).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
                         .where("not kept or n > 1").select(*[F.col(c).alias(k) for c, k in zip(("doc_id", *TEXT_KEYS), KEYS)], "kept"), "dedup-keys")
    sizes = {r["kept"]: r["count"] for r in keys.groupBy("kept").count().collect()}          # two rows at most

    def some(kept: bool) -> DataFrame:
        found = keys.where(F.col("kept") == kept).drop("kept")
        return F.broadcast(found) if sizes.get(kept, 0) <= BROADCAST_ROWS else found

    def same(df: DataFrame, found: DataFrame):
        on = [own[k].eqNullSafe(found[k]) for k in KEYS]
        return on[0] & on[1] & on[2]
    dropped = some(False)
    kept = docs.join(dropped, same(docs, dropped), "left_anti")
    if not sizes.get(True):
        return kept
    again, single = some(True), some(True)
    once = docs.join(again, same(docs, again), "left_semi").withColumns(own).dropDuplicates(KEYS).drop(*KEYS)
    return kept.join(single, same(kept, single), "left_anti").unionByName(once)


def _text(docs: DataFrame):
    return F.coalesce(docs["text"], F.lit(""))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.3 or more)."""
    forest = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, forest, column=SCORE).where(F.col(SCORE) >= 0.3).drop(SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal up to white space."""
    return _kept(docs, exact_dedup.exact_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies."""
    return _kept(docs, simhash.near_duplicates(docs, words=3, max_bits=2))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(docs, KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens, every window at the sources' shares."""
    return packing.pack(docs, window=2048, end_id=1)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained classifier nor the tokenizer; the tests
#: hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored_result(stage, spark, docs, sf_dir, name=f"pipeline-{name}", always=True)
        if name != STAGES[0][0]:
            drop_scratch(before)                # the next stage's table does not read it any more
    return STAGES[-1][1](spark, docs, sf_dir)
