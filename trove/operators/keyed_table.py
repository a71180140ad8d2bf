"""A Parquet table that can be changed in place: rows are dealt into buckets
by a hash of their key, changes are written as small delta files, and only the
buckets that a change touches are ever written again.

Layout of a table's folder:

* ``data/<id>/bucket=<b>/``: Parquet files of a base or of one change;
* ``_log/<number>.json``: what each commit adds and takes away. The log is the
  table: a data folder that no entry names does not exist for readers, so a
  failed or repeated write leaves nothing visible.

``append`` writes the changed rows only, so its bytes follow the batch and not
the table. ``read`` merges: each key's latest change of every column over the
base row. ``compact`` merges the buckets with changes into a new base and
leaves the files of all others as they are. Changes below the bound of
``sizing`` are broadcast, so that the base is not shuffled; larger ones meet
the base of their buckets in a shuffle on the key, and none of their rows pass
through the driver.

Commits are numbered; two writers that take the same number collide on the
file name, and the later one takes the next. A commit that carries a stream's
epoch is applied once. Renames within the folder must fail on an existing
name, as on HDFS and local disks.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_scratch, write_scratch
from .sizing import measure, slice_count

#: Columns of a change: its own columns, which of them it sets, and whether it deletes the key.
SET, GONE, ORDER = "_set", "_gone", "_commit"
#: Every so many commits the entry holds the whole state, and readers start there.
SNAPSHOT = 32
#: Buckets with more changes than this, or all once this many commits are live, are due for ``compact``.
MAX_CHANGES, MAX_COMMITS = 8, 32
#: Bytes of the files that ``compact`` merges at once, about; one bucket at least.
MERGE_BYTES = 256 * 1024 * 1024


@dataclass
class State:
    """What the log says: base[bucket] and changes[bucket] (commit, folder) in order."""

    number: int = -1
    key: str = ""
    buckets: int = 0
    schema: str = ""
    base: dict[int, str] = field(default_factory=dict)
    changes: dict[int, list[tuple[int, str]]] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)

    def apply(self, number: int, entry: dict) -> None:
        if "state" in entry:
            s = entry["state"]
            self.key, self.buckets, self.schema, self.epochs = s["key"], s["buckets"], s["schema"], dict(s["epochs"])
            self.base = {int(b): f for b, f in s["base"].items()}
            self.changes = {int(b): [tuple(x) for x in xs] for b, xs in s["changes"].items()}
        elif entry["kind"] == "change":
            for b in entry["buckets"]:
                self.changes.setdefault(b, []).append((number, entry["folder"]))
        else:                                               # a new base for some buckets, up to a commit
            for b in entry["merged"]:
                self.base.pop(b, None)
                left = [x for x in self.changes.pop(b, []) if x[0] > entry["upto"]]
                if left:
                    self.changes[b] = left
            self.base |= {b: entry["folder"] for b in entry["buckets"]}
        if entry.get("stream"):
            self.epochs[entry["stream"]] = max(entry["epoch"], self.epochs.get(entry["stream"], -1))
        self.number = number

    def to_json(self) -> dict:
        return {"key": self.key, "buckets": self.buckets, "schema": self.schema, "epochs": self.epochs,
                "base": self.base, "changes": self.changes}


class KeyedTable:
    """The table of a folder; ``create`` makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ log

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _entry(self, name: str) -> dict:
        fs, p = self._hadoop(f"{self.path}/_log/{name}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def state(self) -> State:
        """The table as of now: the last entry with a whole state, and what followed."""
        names = [n for n in self._names("_log") if n.endswith(".json")]
        entries: list[tuple[int, dict]] = []
        for n in reversed(names):
            entries.append((int(n[:-5]), self._entry(n)))
            if "state" in entries[-1][1]:
                break
        state = State()
        for number, entry in reversed(entries):
            state.apply(number, entry)
        return state

    def exists(self) -> bool:
        return any(n.endswith(".json") for n in self._names("_log"))

    def _claim(self, number: int, entry: dict) -> bool:
        """Writes an entry under its number; False if another writer has it."""
        fs, tmp = self._hadoop(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(entry).encode("utf-8")))
        out.close()
        _, target = self._hadoop(f"{self.path}/_log/{number:020d}.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration()) \
            if tmp.toUri().getScheme() else self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(tmp, target, none)
            return True
        except Exception as e:
            fs.delete(tmp, False)
            if fs.exists(target):
                return False
            raise e

    def _commit(self, entry: dict, still_holds=lambda state: True) -> int | None:
        """Appends an entry after the newest one; None if it no longer applies."""
        while True:
            state = self.state()
            if not still_holds(state):
                return None
            number = state.number + 1
            full = dict(entry)
            if number % SNAPSHOT == 0 and number:
                state.apply(number, entry)
                full = {"state": state.to_json()}
            if self._claim(number, full):
                return number

    # ------------------------------------------------------------ writing

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int = 64) -> "KeyedTable":
        """A new table of ``rows`` (unique, not null keys), or an empty one of their schema."""
        table = cls(spark, path)
        state = State(key=key, buckets=buckets, schema=rows.schema.json())
        if not table._claim(0, {"state": state.to_json()}):
            raise FileExistsError(path)
        folder, touched = table._write(rows.repartition(buckets, table._bucket(key, buckets)), key, buckets)
        table._commit({"kind": "base", "folder": folder, "buckets": touched, "merged": [], "upto": 0})
        return table

    @staticmethod
    def _bucket(key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, key: str, buckets: int) -> tuple[str, list[int]]:
        """(folder, buckets that got rows)."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(key, buckets)).write.option("compression", "zstd") \
            .partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder, [int(n[len("bucket="):]) for n in self._names(folder) if n.startswith("bucket=")]

    def append(self, rows: DataFrame, set_cols: Sequence[str] = (), delete: bool = False, stream: str | None = None,
               epoch: int | None = None) -> int | None:
        """One change: keys of ``rows`` get their values of ``set_cols`` (new
        keys are inserted) or, with ``delete``, go. A key has one row in
        ``rows``. With ``stream`` and ``epoch`` it is applied once; None if it
        was already."""
        state = self.state()
        done = lambda s: stream is not None and s.epochs.get(stream, -1) >= epoch
        if done(state):
            return None
        schema = self._schema(state)
        cols = [F.col(c) if c in set_cols else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names if c != state.key]
        change = rows.select(state.key, *cols, F.array(*[F.lit(c) for c in set_cols]).cast("array<string>").alias(SET), F.lit(delete).alias(GONE))
        folder, touched = self._write(change.repartition(self._bucket(state.key, state.buckets)), state.key, state.buckets)
        return self._commit({"kind": "change", "folder": folder, "buckets": touched, "stream": stream, "epoch": epoch},
                            lambda s: not done(s))

    def delete(self, keys: DataFrame) -> int | None:
        """One change that removes the rows with these keys."""
        return self.append(keys.select(self.state().key).distinct(), delete=True)

    def due(self, state: State | None = None) -> list[int]:
        """Buckets that ``compact`` should merge."""
        state = state or self.state()
        commits = {n for xs in state.changes.values() for n, _ in xs}
        most = MAX_CHANGES if len(commits) <= MAX_COMMITS else 0
        return sorted(b for b, xs in state.changes.items() if len(xs) > most)

    def compact(self, buckets: Iterable[int] | None = None, keep_s: float | None = None) -> list[int]:
        """Merges the changes of ``buckets`` (default: those that are due) into
        new base files; every other bucket keeps its files. Buckets of many
        bytes are merged some at a time, each lot in a commit of its own, and
        with ``keep_s`` what a lot has merged is vacuumed before the next.
        Returns the buckets that were merged, without lots of which another
        writer has merged a bucket meanwhile."""
        state = self.state()
        wanted = sorted(set(self.due(state) if buckets is None else buckets) & set(state.changes))
        done: list[int] = []
        for lot in self._lots(state, wanted):
            done += self._compact(lot)
            if keep_s is not None:
                self.vacuum(keep_s)
        return done

    def _lots(self, state: State, buckets: list[int]) -> list[list[int]]:
        """Buckets in lots of about ``MERGE_BYTES``."""
        lots: list[list[int]] = []
        fill = MERGE_BYTES
        for b in buckets:
            size = 0
            for folder in {f for f in [state.base.get(b), *(f for _, f in state.changes.get(b, []))] if f}:
                fs, p = self._hadoop(f"{self.path}/{folder}/bucket={b}")
                size += fs.getContentSummary(p).getLength()
            if fill + size > MERGE_BYTES:
                lots.append([])
                fill = 0
            lots[-1].append(b)
            fill += size
        return lots

    def _compact(self, buckets: list[int]) -> list[int]:
        state = self.state()
        wanted = sorted(set(buckets) & set(state.changes))
        if not wanted:
            return []
        rows = self._merged(state, wanted)
        folder, touched = self._write(rows, state.key, state.buckets)
        if hasattr(rows, "resolved"):
            drop_scratch(rows.resolved)
        seen = {b: (state.base.get(b), state.changes[b][0]) for b in wanted}
        entry = {"kind": "base", "folder": folder, "buckets": touched, "merged": wanted, "upto": state.number}
        number = self._commit(entry, lambda s: all((s.base.get(b), (s.changes.get(b) or [None])[0]) == x for b, x in seen.items()))
        return wanted if number is not None else []

    def vacuum(self, older_than_s: float = 7 * 24 * 3600) -> list[str]:
        """Removes data folders that the table no longer names (merged changes,
        failed writes), also those of single buckets, that are older than any
        reader or writer may need."""
        state = self.state()
        live = {f"{f}/bucket={b}" for b, f in state.base.items()} | {f"{f}/bucket={b}" for b, xs in state.changes.items() for _, f in xs}
        folders = {x.rsplit("/", 1)[0] for x in live}
        fs, _ = self._hadoop(self.path)
        now, gone = self.spark._jvm.System.currentTimeMillis(), []

        def sweep(folder: str, keep: set[str], only: str = "") -> None:
            _, p = self._hadoop(f"{self.path}/{folder}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                name = f"{folder}/{s.getPath().getName()}"
                if name not in keep and s.getPath().getName().startswith(only) and now - s.getModificationTime() > older_than_s * 1000:
                    fs.delete(s.getPath(), True)
                    gone.append(name)
        sweep("data", folders)
        for folder in sorted(folders):
            sweep(folder, live, "bucket=")
        return gone

    # ------------------------------------------------------------ reading

    @staticmethod
    def _schema(state: State) -> T.StructType:
        return T.StructType.fromJson(json.loads(state.schema))

    def read(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows of the table as of now; with ``columns`` only the key and
        these are read, merged and stored on the way."""
        state = self.state()
        if columns is not None:
            wanted = {state.key, *columns}
            state = replace(state, schema=T.StructType([f for f in self._schema(state).fields if f.name in wanted]).json())
        return self._merged(state, range(state.buckets))

    def _files(self, schema: T.StructType, folders: list[tuple[str, int]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}/bucket={b}" for f, b in folders])

    def changes(self, state: State, buckets: Iterable[int]) -> DataFrame | None:
        """All live changes of some buckets with the number of their commit."""
        wanted, schema = set(buckets), self._schema(state)
        rows = T.StructType([*schema.fields, T.StructField(SET, T.ArrayType(T.StringType())), T.StructField(GONE, T.BooleanType())])
        by_commit: dict[int, list[tuple[str, int]]] = {}
        for b in wanted & set(state.changes):
            for number, folder in state.changes[b]:
                by_commit.setdefault(number, []).append((folder, b))
        out = None
        for number, folders in sorted(by_commit.items()):
            df = self._files(rows, folders).withColumn(ORDER, F.lit(number))
            out = df if out is None else out.unionByName(df)
        return out

    def _resolved(self, state: State, buckets: Iterable[int]) -> DataFrame | None:
        """One row a changed key: whether it was deleted on the way, whether it
        lives, and of each column the last value that was set after that."""
        rows = self.changes(state, buckets)
        if rows is None:
            return None
        cols = [c for c in self._schema(state).names if c != state.key]
        last = [F.max_by(F.struct(F.col(c).alias("v"), F.col(ORDER).alias("n")), F.when(F.array_contains(SET, c), F.col(ORDER))).alias(c) for c in cols]
        one = rows.groupBy(state.key).agg(F.max(F.when(F.col(GONE), F.col(ORDER))).alias("_dead"),
                                          F.max(F.when(~F.col(GONE), F.col(ORDER))).alias("_live"), *last)
        dead = F.coalesce(F.col("_dead"), F.lit(-1))
        return one.select(state.key, (dead >= 0).alias("_cut"), (F.coalesce(F.col("_live"), F.lit(-1)) > dead).alias("_alive"),
                          *[F.when(F.coalesce(F.col(c)["n"], F.lit(-1)) > dead, F.struct(F.col(c)["v"].alias("v"))).alias(f"_new_{c}") for c in cols])

    def _merged(self, state: State, buckets: Iterable[int]) -> DataFrame:
        """Base and changes of some buckets. Base rows of buckets without
        changes are read as they lie; the others join their changes, which are
        broadcast if they fit."""
        wanted, schema = sorted(buckets), self._schema(state)
        base_of = lambda some: self._files(schema, [(state.base[b], b) for b in some if b in state.base])
        changed = [b for b in wanted if b in state.changes]
        resolved = self._resolved(state, changed)
        out = base_of([b for b in wanted if b not in state.changes])
        if resolved is None:
            return out
        resolved = write_scratch(resolved, "keyed-changes")
        merge = self._merge_small if slice_count(measure(resolved)) == 1 else self._merge_large
        out = out.unionByName(merge(base_of(changed), resolved, state.key, schema))
        out.resolved = resolved                             # may be dropped once the rows are stored
        return out

    @staticmethod
    def _values(key: str, schema: T.StructType) -> list[Column]:
        """The columns of a base row (or none) beside its change (or none)."""
        over = lambda c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}")["v"]).when(~F.coalesce("_cut", F.lit(False)), F.col(c))
        return [F.col(c) if c == key else over(c).alias(c) for c in schema.names]

    @classmethod
    def _merge_small(cls, base: DataFrame, resolved: DataFrame, key: str, schema: T.StructType) -> DataFrame:
        kept = base.join(F.broadcast(resolved), key, "left").where(F.coalesce("_alive", F.lit(True))).select(*cls._values(key, schema))
        known = base.select(key).join(F.broadcast(resolved.select(key)), key, "left_semi")
        new = resolved.where("_alive").join(known, key, "left_anti").select(
            *[F.col(c) if c == key else F.col(f"_new_{c}")["v"].alias(c) for c in schema.names])
        return kept.unionByName(new)

    @classmethod
    def _merge_large(cls, base: DataFrame, resolved: DataFrame, key: str, schema: T.StructType) -> DataFrame:
        met = base.join(resolved, key, "full_outer")
        return met.where(F.coalesce("_alive", F.lit(True))).select(*cls._values(key, schema))


def cascade(parents: KeyedTable, children: KeyedTable, keys: DataFrame, foreign_key: str) -> None:
    """Deletes parents by key and the children that refer to them: two changes
    of keys only. The children's keys come from one scan of their two key
    columns against the (measured) set of parents."""
    parent_key, child_key = parents.state().key, children.state().key
    gone = write_scratch(keys.select(parent_key).where(F.col(parent_key).isNotNull()).distinct(), "cascade-keys")
    named = gone.withColumnRenamed(parent_key, foreign_key)
    named = F.broadcast(named) if measure(named).fits() else named
    orphans = children.read().select(child_key, foreign_key).join(named, foreign_key, "left_semi").select(child_key)
    children.delete(orphans)
    parents.delete(gone)
