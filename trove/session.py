"""Session helpers: a tuned SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from measured sizes (a
# sort-merge join whose side proves small at run time becomes a broadcast
# join), coalesces tiny shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "trove", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster ``master`` stays unset so spark-submit decides; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator of the cluster and points to
    shared storage; we only read it. Where it is unset (local tests) a fresh
    folder is created once per session and recorded in the conf.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="trove-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


# Open scopes of scratch tables, innermost last: each a list of paths.
_SCOPES: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, for tables to be
    written inside it.

    The name is unique (uuid4); the folder is made through the Hadoop
    FileSystem, so any scheme works and no driver-local folder is touched. It
    goes when its scope ends (``scratch_scope``) or else with the application."""
    path = _new_path(spark, name)
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the Hadoop FileSystem."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def write_scratch(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: the lineage is cut, a lost executor costs nothing, and every later
    branch reads the stored rows instead of computing them again. The table
    goes when its scope ends or else with the application."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete the table of a frame that ``write_scratch`` returned."""
    drop_path(df.sparkSession, df.scratch)
    for scope in _SCOPES:
        if df.scratch in scope:
            scope.remove(df.scratch)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables and folders made inside are deleted at the end. What
    outlives the scope must not read them: store it in the outer scope with
    ``stored_result``."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            drop_path(spark, path)


def stored_result(fn: Callable[..., DataFrame], spark: SparkSession, *args, name: str = "result", always: bool = False) -> DataFrame:
    """``fn(spark, *args)`` without leftovers: if it made scratch tables, its
    result is stored and they are deleted; the stored result belongs to the
    caller's scope (or the application). A result that reads none is returned
    as it is, still lazy, unless it shall be stored ``always``; so is one that
    names what it ``reads``, whose tables then belong to the caller's scope."""
    with scratch_scope(spark) as paths:
        df = fn(spark, *args)
        if not paths and not always:
            return df
        reads = getattr(df, "reads", None)
        if reads and not always:
            paths[:] = [p for p in paths if p not in reads]
            if len(_SCOPES) > 1:
                _SCOPES[-2].extend(reads)
            return df
        outer = _SCOPES.pop()                   # the result's table belongs one scope further out
        try:
            return write_scratch(df, name)
        finally:
            _SCOPES.append(outer)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What runs inside leaves no shuffle files: they go as soon as their query
    has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint).

    The frame is persisted first so the checkpoint write reads the computed
    blocks instead of computing the frame a second time; the cache is
    released in any case, also when the checkpoint fails."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``trove`` importable in the Python workers (once per context).

    Operators that run Python on executors (Arrow batch kernels, pluggable
    models) pickle functions of this package by reference; the package is
    zipped once and added with ``addPyFile`` — what ``--py-files`` does for
    a submitted job — so workers import it whatever their working folder.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    import trove
    root = os.path.dirname(os.path.abspath(trove.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="trove-pkg-"), "trove.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.join("trove", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
