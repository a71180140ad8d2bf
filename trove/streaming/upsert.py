"""Continuous catalogue ingest: new JSON-lines files are upserted into a
keyed table as they arrive.

File-source ``readStream`` -> ``foreachBatch``: each micro-batch is parsed
with the batch readers (bad lines quarantined), duplicates inside the batch
resolved by last line, then appended to the table as one change: an epoch
writes its own rows, however large the table is. Buckets that have gathered
many changes are merged now and then; no other file is written again. The
commit carries the stream's id and epoch, so a retried epoch is applied once,
and another stream (a new checkpoint has a new id) that starts again at epoch
0 is applied too. Quarantined lines are written before the commit, into a
folder of their stream and epoch that a retry replaces. What an epoch stores
for itself, and its shuffle files, go when it ends. The stream's progress
lives in a checkpoint under the shared checkpoint folder.
"""

from __future__ import annotations

import json
import os
from typing import Callable, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed_table import KeyedTable
from ..session import checkpoint_dir, drop_scratch, shuffles_dropped, write_scratch
from ..sources import jsonl as J


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a stream's checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def latest_version(spark: SparkSession, path: str, columns: Optional[Sequence[str]] = None) -> Optional[DataFrame]:
    """The table of ``stream_upsert`` as of now, or its key and some columns; None before the first epoch."""
    table = KeyedTable(spark, path)
    return table.read(columns) if table.exists() else None


def catalogue_batch(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prepared items, quarantine) of one micro-batch of lines."""
    rec, bad = J.read_catalogue_jsonl(lines)
    return J.prepare_items(rec), bad


def stream_upsert(spark: SparkSession, source_dir: str, target_path: str, key: str = "item_id",
                  update_cols: Sequence[str] = ("title", "description", "release_date", "score", "source_url",
                                                "platforms", "genres", "developers", "publishers",
                                                "cover_url", "screenshot_urls"),
                  prepare: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = catalogue_batch,
                  quarantine_path: Optional[str] = None, checkpoint: Optional[str] = None,
                  available_now: bool = True, max_files_per_trigger: int = 1000, buckets: int = 64, keep_s: Optional[float] = None):
    """Start the stream; returns the StreamingQuery.

    With ``keep_s`` the table is vacuumed of older files when it has been
    compacted: nobody may still read or write files of the table that are older.

    ``target_path`` holds a ``KeyedTable``; the first epoch of any stream
    creates it with the columns of ``prepare`` and ``buckets`` buckets.
    Listing goes through the Hadoop FileSystem of the path, so it may live on
    HDFS or object storage. ``prepare`` returns one row a key.
    """
    from ..session import ship_package
    ship_package(spark)
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/stream-upsert-{os.path.basename(target_path.rstrip('/'))}"
    raw = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
           .load(source_dir)
           .select("value", F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_block")))

    def apply(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        stream = _stream_id(session, ckpt)
        table = KeyedTable(session, target_path)
        if table.exists() and table.state().epochs.get(stream, -1) >= epoch_id:
            return  # replayed epoch of this stream: already applied
        lines = batch.select("value", F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"),
                                               F.monotonically_increasing_id().alias("pos")).alias("line_no"))
        with shuffles_dropped(session):
            stored = write_scratch(lines, "stream-lines")
            try:
                upsert(session, table, *prepare(stored), stream, epoch_id)
            finally:
                drop_scratch(stored)

    def upsert(session: SparkSession, table: KeyedTable, prepared: DataFrame, bad: DataFrame, stream: str, epoch_id: int) -> None:
        if quarantine_path:
            bad.withColumn("line_no", F.to_json("line_no")).write.mode("overwrite") \
               .parquet(f"{quarantine_path.rstrip('/')}/stream={stream}/epoch={epoch_id}")
        if not table.exists():
            try:
                KeyedTable.create(session, target_path, prepared.limit(0), key, buckets)
            except FileExistsError:
                pass    # another stream was first
        first = not table.state().epochs
        cols = [c for c in prepared.columns if c != key and (first or c in update_cols)]
        table.append(prepared.select(key, *cols), cols, stream=stream, epoch=epoch_id)
        table.compact(keep_s=keep_s)

    w = raw.writeStream.foreachBatch(apply).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
