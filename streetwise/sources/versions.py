"""Tables that change safely: Parquet files, and a log that says which of them count.

A version is a file ``log/<number>.json`` that is made only if it isn't there yet. It
names files added and removed, and positions of rows deleted. A writer works on the
version that it has read; if others committed meanwhile, it looks whether they changed
what its own change rests on, and then either takes the next number or does its work
again. Readers keep the version that they began with.

A change writes the rows that change and no others: deleted rows are noted by file and
position, and left out when read. Each file's bounds of key and layout columns are in
the log, so that a change reads only the files that may hold its keys, and a query only
those of its blocks.

Making a file only if it is absent is atomic on HDFS and local disks; an object store
needs a file system for Hadoop that renames like that.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables

log = logging.getLogger(__name__)
#: Commits from one that lists all files to the next.
LISTED_EVERY = 16
#: Small files, or notes of deleted rows, of which a table may consist before it is compacted; rows of a small file.
LOOSE, SMALL_ROWS = 16, 100_000
#: A file of which so large a share is deleted is written anew by compact().
WORN = 0.3
#: Keys that are compared with each file's bounds one by one, and positions that are sent to every task.
FEW_KEYS, FEW_POSITIONS = 10_000, 500_000
ATTEMPTS = 10


class Conflict(Exception):
    """Another writer has changed what a change rests on."""


@dataclass
class Snapshot:
    """``files``: by name what the log has of each: folder, rows, bounds by column, notes (folders that note deleted
    rows) and gone (how many)."""

    version: int = -1
    files: dict[str, dict] = field(default_factory=dict)

    def apply(self, commit: dict) -> None:
        if "all" in commit:
            self.files = {f["name"]: f for f in commit["all"]}
        else:
            for name in commit["removed"]:
                self.files.pop(name, None)
            for name, note in commit["deleted"].items():
                f = self.files[name]
                self.files[name] = f | {"notes": [*f["notes"], note["folder"]], "gone": f["gone"] + note["rows"]}
            self.files |= {f["name"]: f for f in commit["added"]}
        self.version = commit["version"]


@dataclass
class Change:
    """What a commit does, and what it rests on: ``low`` to ``high`` are the keys that it has looked for, ``whole`` that
    it has read everything."""

    operation: str
    added: list[dict] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    deleted: dict[str, dict] = field(default_factory=dict)
    low: str | None = None
    high: str | None = None
    whole: bool = False
    result: object = None

    def empty(self) -> bool:
        return not (self.added or self.removed or self.deleted)

    def conflicts(self, other: dict) -> bool:
        """Whether it might be otherwise, had ``other`` been there before it."""
        if self.whole and (other["added"] or other["removed"] or other["deleted"]):
            return True
        if {*self.removed, *self.deleted} & {*other["removed"], *other["deleted"]}:
            return True
        if other.get("moved") or self.low is None:
            return False
        return any(f["key"][0] is not None and f["key"][0] <= self.high and f["key"][1] >= self.low for f in other["added"])


class VersionedTable:
    """``layout`` are the columns by which rows lie: files have narrow bounds of the first of them."""

    def __init__(self, spark: SparkSession, path: str, schema: dict[str, str], key: str | None, layout: list[str]):
        self.spark, self.path, self.schema, self.key, self.layout = spark, path, schema, key, layout
        self.bounded = [c for c in dict.fromkeys([*layout, "state"]) if c in schema]

    # -- the log --------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, version: int) -> dict | None:
        fs, p = self._fs(f"{self.path}/log/{version:020d}.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/log")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:20]) for n in names if n.endswith(".json") and not n.startswith("."))

    def exists(self) -> bool:
        return bool(self._versions())

    def snapshot(self, version: int | None = None) -> Snapshot:
        found = [v for v in self._versions() if version is None or v <= version]
        if not found or version is not None and found[-1] != version:
            raise LookupError(f"{self.path} has no version {version}" if version is not None else f"no table at {self.path}")
        commits = []
        for v in reversed(found):
            commits.append(self._read(v))
            if "all" in commits[-1]:
                break
        out = Snapshot()
        for c in reversed(commits):
            out.apply(c)
        return out

    def _made(self, version: int, commit: dict) -> bool:
        """Makes the version's file; False if there is one."""
        jvm = self.spark._jvm
        fs, mine = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(mine, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(mine.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(mine, jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{version:020d}.json"), options)
        except Py4JJavaError as e:
            fs.delete(mine, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def commit(self, read: Snapshot, change: Change) -> int:
        """Commits a change made from ``read``; raises Conflict if another commit since then matters to it."""
        at = Snapshot(read.version, dict(read.files))
        while True:
            version = at.version + 1
            commit = {"version": version, "at": time.time(), "operation": change.operation, "added": change.added, "removed": change.removed, "deleted": change.deleted, "moved": change.operation == "compact"}
            after = Snapshot(at.version, dict(at.files))
            after.apply(commit)
            if version % LISTED_EVERY == 0:
                commit["all"] = list(after.files.values())
            if self._made(version, commit):
                return version
            other = self._read(version)
            if change.conflicts(other):
                raise Conflict(f"version {version} ({other['operation']})")
            at.apply(other)

    def _changed(self, make: Callable[[Snapshot], Change]):
        """Makes a change from the newest version and commits it, as often as others are in its way."""
        for _ in range(ATTEMPTS):
            read = self.snapshot() if self.exists() else Snapshot()
            change = make(read)
            if change.empty() and read.version >= 0:
                return change.result
            try:
                self.commit(read, change)
                return change.result
            except Conflict as e:
                log.info("%s: again after %s", self.path, e)
                for folder in {f["folder"] for f in change.added} | {n["folder"] for n in change.deleted.values()}:
                    fs, p = self._fs(f"{self.path}/{folder}")
                    fs.delete(p, True)
        raise Conflict(f"{self.path}: given up after {ATTEMPTS} attempts")

    # -- reading --------------------------------------------------------------

    def _files(self, files: list[dict], places: bool = False) -> DataFrame:
        """Rows of these files but the deleted ones; with ``places`` also _file and _at."""
        none = ", ".join(f"{c} {t}" for c, t in self.schema.items())
        if not files:
            return self.spark.createDataFrame([], none + (", _file string, _at long" if places else ""))
        at = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at")]
        load = lambda part: self.spark.read.schema(none).parquet(*[f"{self.path}/{f['folder']}/{f['name']}" for f in part])
        worn, parts = [f for f in files if f["notes"]], []
        if fresh := [f for f in files if not f["notes"]]:
            parts.append(load(fresh).select("*", *at) if places else load(fresh))
        if worn:
            gone = self.spark.read.schema("_file string, _at long").parquet(*{f"{self.path}/{n}" for f in worn for n in f["notes"]})
            gone = F.broadcast(gone) if sum(f["gone"] for f in worn) <= FEW_POSITIONS else gone
            left = load(worn).select("*", *at).join(gone, ["_file", "_at"], "left_anti")
            parts.append(left.select(*self.schema, *(["_file", "_at"] if places else [])))
        return reduce(DataFrame.unionByName, parts)

    def read(self, version: int | None = None, within: dict[str, list] | None = None) -> DataFrame:
        """The table as it is, or was. ``within`` has values of layout columns: only rows that
        have one of them, from files whose bounds may hold one."""
        files, rows = list(self.snapshot(version).files.values()), F.lit(True)
        for c, values in (within or {}).items():
            files = [f for f in files if c not in f["bounds"] or f["bounds"][c][0] is not None and any(f["bounds"][c][0] <= v <= f["bounds"][c][1] for v in values)]
            rows = rows & F.col(c).isin(values)
        out = self._files(files)
        return out.where(rows) if within else out

    def history(self) -> DataFrame:
        """version, at, operation, rows_added, rows_deleted, files_added, files_removed."""
        rows = []
        for v in self._versions():
            c = self._read(v)
            rows.append((v, c["at"], c["operation"], sum(f["rows"] for f in c["added"]), sum(n["rows"] for n in c["deleted"].values()), len(c["added"]), len(c["removed"])))
        out = self.spark.createDataFrame(rows, "version int, at double, operation string, rows_added long, rows_deleted long, files_added int, files_removed int")
        return out.withColumn("at", F.timestamp_seconds("at"))

    # -- writing --------------------------------------------------------------

    def _write(self, df: DataFrame) -> list[dict]:
        """Writes rows as files of narrow bounds; what the log has of them."""
        folder = f"data/{uuid.uuid4().hex}"
        if self.layout:
            df = df.repartitionByRange(*self.layout).sortWithinPartitions(*self.layout)
        df.select(*self.schema).write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(", ".join(f"{c} {t}" for c, t in self.schema.items())).parquet(f"{self.path}/{folder}")
        bounds = [f(c).alias(f"{n}_{c}") for c in self.bounded for n, f in (("low", F.min), ("high", F.max))]
        key = F.col(self.key) if self.key else F.lit(None).cast("string")
        each = written.select("*", F.col("_metadata.file_name").alias("_file")).groupBy("_file").agg(F.count("*").alias("rows"), F.min(key).alias("low_key"), F.max(key).alias("high_key"), *bounds)
        return [
            {"name": r["_file"], "folder": folder, "rows": r["rows"], "key": [r["low_key"], r["high_key"]], "bounds": {c: [r[f"low_{c}"], r[f"high_{c}"]] for c in self.bounded}, "notes": [], "gone": 0}
            for r in each.collect()  # a row for each file
        ]

    def _note(self, places: DataFrame) -> dict[str, dict]:
        """Notes _file and _at of rows that are deleted."""
        folder = f"gone/{uuid.uuid4().hex}"
        places.select("_file", "_at").write.parquet(f"{self.path}/{folder}")
        found = self.spark.read.schema("_file string, _at long").parquet(f"{self.path}/{folder}").groupBy("_file").agg(F.count("*").alias("n")).collect()  # a row for each file
        return {r["_file"]: {"folder": folder, "rows": r["n"]} for r in found}

    def _holding(self, read: Snapshot, keys: DataFrame) -> tuple[list[dict], str | None, str | None]:
        """Files whose bounds hold one of the keys, and the bounds of these."""
        of = keys.agg(F.count(self.key).alias("n"), F.min(self.key).alias("low"), F.max(self.key).alias("high")).first()
        if not of["n"]:
            return [], None, None
        files = [f for f in read.files.values() if f["key"][0] is not None and f["key"][0] <= of["high"] and f["key"][1] >= of["low"]]
        if files and of["n"] <= FEW_KEYS:
            bounds = self.spark.createDataFrame([(f["name"], *f["key"]) for f in files], "name string, low string, high string")
            k = F.broadcast(keys.select(F.col(self.key).alias("k")).distinct())  # FEW_KEYS at most
            held = {r["name"] for r in bounds.join(k, (F.col("k") >= F.col("low")) & (F.col("k") <= F.col("high")), "left_semi").collect()}
            files = [f for f in files if f["name"] in held]
        return files, of["low"], of["high"]

    def _without(self, read: Snapshot, change: Change) -> Change:
        """Files of which every row is deleted are removed instead."""
        for name, note in list(change.deleted.items()):
            if read.files[name]["gone"] + note["rows"] == read.files[name]["rows"]:
                del change.deleted[name]
                change.removed.append(name)
        return change

    def create(self) -> None:
        """An empty table, unless there is one."""
        if not self.exists():
            self._changed(lambda read: Change("create"))

    def replace(self, make: Callable[[DataFrame], DataFrame], operation: str = "replace") -> None:
        """The whole table anew, from the table as it is (empty, if there is none)."""

        def changed(read: Snapshot) -> Change:
            return Change(operation, self._write(tables.aligned(make(self._files(list(read.files.values()))), self.schema)), list(read.files), whole=True)

        self._changed(changed)

    def append(self, make: Callable[[DataFrame], DataFrame], operation: str = "append") -> int:
        """Adds rows that are made from the table as it is; returns how many. They rest on there being no other rows of their keys."""

        def changed(read: Snapshot) -> Change:
            added = self._write(tables.aligned(make(self._files(list(read.files.values()))), self.schema))
            keys = [k for f in added for k in f["key"] if k is not None]
            return Change(operation, added, low=min(keys, default=None), high=max(keys, default=None), whole=self.key is None, result=sum(f["rows"] for f in added))

        added = self._changed(changed)
        self._tidy()
        return added

    def upsert(self, make: Callable[[DataFrame], DataFrame], kept: set[str], operation: str = "upsert") -> tuple[int, int]:
        """Adds rows of new keys and changes all but the ``kept`` columns of others; counts of both. Reads the files that may hold a key, writes the rows."""

        def changed(read: Snapshot) -> Change:
            rows = tables.aligned(make(self._files(list(read.files.values()))), self.schema).persist()
            files, low, high = self._holding(read, rows)
            old = self._files(files, places=True).join(rows.select(self.key).distinct(), self.key, "left_semi").persist()
            n = old.count()
            added = self._write(tables.upsert(old.select(*self.schema), rows, self.key, kept))
            out = Change(operation, added, deleted=self._note(old) if n else {}, low=low, high=high, result=(sum(f["rows"] for f in added) - n, n))
            old.unpersist()
            rows.unpersist()
            return self._without(read, out)

        counts = self._changed(changed)
        self._tidy()
        return counts

    def delete(self, keys: DataFrame | None = None, condition: Column | None = None, operation: str = "delete") -> int:
        """Deletes rows of these keys, or for which the condition is true; returns how many."""

        def changed(read: Snapshot) -> Change:
            if keys is not None:
                files, low, high = self._holding(read, keys)
                gone, whole = self._files(files, places=True).join(keys.select(self.key).distinct(), self.key, "left_semi"), False
            else:
                files, low, high, whole = list(read.files.values()), None, None, True
                gone = self._files(files, places=True).where(F.coalesce(condition, F.lit(False)))
            deleted = self._note(gone) if files else {}
            return self._without(read, Change(operation, deleted=deleted, low=low, high=high, whole=whole, result=sum(n["rows"] for n in deleted.values())))

        n = self._changed(changed)
        self._tidy()
        return n

    def update(self, condition: Column, change: Callable[[DataFrame], DataFrame], operation: str = "update") -> int:
        """Changes the rows for which the condition is true; returns how many."""

        def changed(read: Snapshot) -> Change:
            old = self._files(list(read.files.values()), places=True).where(F.coalesce(condition, F.lit(False))).persist()
            deleted = self._note(old)
            out = Change(operation, self._write(change(old.select(*self.schema))) if deleted else [], deleted=deleted, whole=True, result=sum(n["rows"] for n in deleted.values()))
            old.unpersist()
            return self._without(read, out)

        n = self._changed(changed)
        self._tidy()
        return n

    # -- upkeep ---------------------------------------------------------------

    def _tidy(self) -> None:
        files = self.snapshot().files.values()
        notes = {n for f in files for n in f["notes"]}
        if len(notes) > LOOSE or len({f["folder"] for f in files if f["rows"] < SMALL_ROWS}) > LOOSE:
            try:
                self.compact()
            except Conflict:
                log.info("%s: compacted another time", self.path)

    def compact(self) -> int:
        """Puts small files together and writes worn ones anew; the table stays what it is. Returns how many files it took."""
        read = self.snapshot()
        taken = [f for f in read.files.values() if f["rows"] < SMALL_ROWS or f["gone"] >= WORN * f["rows"] or len(f["notes"]) > LOOSE]
        if len(taken) > 1 or any(f["notes"] for f in taken):
            self.commit(read, Change("compact", self._write(self._files(taken)), [f["name"] for f in taken]))
            return len(taken)
        return 0

    def vacuum(self, versions: int = 2, older_than_s: float = 86_400) -> int:
        """Deletes folders that the last ``versions`` don't name. Younger ones stay: another writer may still
        fill them. Returns how many; older versions can't be read any more."""
        there = self._versions()
        kept = there[-versions:]
        files = [f for v in kept for f in self.snapshot(v).files.values()]
        named = {f["folder"] for f in files} | {n for f in files for n in f["notes"]}
        first = max(v for v in there if v <= kept[0] and v % LISTED_EVERY == 0)
        for v in there:
            if v < first:
                fs, p = self._fs(f"{self.path}/log/{v:020d}.json")
                fs.delete(p, False)
        n = 0
        for kind in ("data", "gone"):
            fs, p = self._fs(f"{self.path}/{kind}")
            for status in fs.listStatus(p) if fs.exists(p) else []:
                folder = f"{kind}/{status.getPath().getName()}"
                if folder not in named and status.getModificationTime() / 1000 < time.time() - older_than_s:
                    fs.delete(status.getPath(), True)
                    n += 1
        return n


class MemoryTable:
    """The same changes on a table that is kept in memory, with one version and one writer."""

    def __init__(self, spark: SparkSession, schema: dict[str, str], key: str | None):
        self.spark, self.schema, self.key, self.held = spark, schema, key, None

    def exists(self) -> bool:
        return self.held is not None

    def read(self, version: int | None = None, within: dict[str, list] | None = None) -> DataFrame:
        if version is not None:
            raise LookupError("a table in memory has no versions")
        if self.held is None:
            return self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in self.schema.items()))
        return reduce(lambda df, x: df.where(F.col(x[0]).isin(x[1])), (within or {}).items(), self.held)

    def create(self) -> None:
        if self.held is None:
            self.replace(lambda t: t)

    def replace(self, make: Callable[[DataFrame], DataFrame], operation: str = "replace") -> None:
        new = tables.aligned(make(self.read()), self.schema).persist()
        new.count()
        self.close()
        self.held = new

    def close(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        self.held = None

    def _counted(self, make: Callable[[DataFrame], DataFrame]) -> int:
        before = self.read().count()
        self.replace(make)
        return self.held.count() - before

    def append(self, make: Callable[[DataFrame], DataFrame], operation: str = "append") -> int:
        return self._counted(lambda t: t.unionByName(tables.aligned(make(t), self.schema)))

    def upsert(self, make: Callable[[DataFrame], DataFrame], kept: set[str], operation: str = "upsert") -> tuple[int, int]:
        rows = tables.aligned(make(self.read()), self.schema).persist()
        held = self.read().join(rows.select(self.key).distinct(), self.key, "left_semi").count()
        added = self._counted(lambda t: tables.upsert(t, rows, self.key, kept))
        rows.unpersist()
        return added, held

    def delete(self, keys: DataFrame | None = None, condition: Column | None = None, operation: str = "delete") -> int:
        return -self._counted(lambda t: tables.delete_where(t, condition) if keys is None else tables.delete_keys(t, keys, self.key))

    def update(self, condition: Column, change: Callable[[DataFrame], DataFrame], operation: str = "update") -> int:
        met = F.coalesce(condition, F.lit(False))
        n = self.read().where(met).count()
        self.replace(lambda t: change(t.where(met)).unionByName(t.where(~met)))
        return n
