"""Versioned tables: append-only Parquet version logs, made visible by commit manifests.

A commit writes its rows first and then creates `_commits/<n>.json`, which must not exist yet. Whoever creates it has
committed as n; rows without a manifest are never seen. That a file is created by one writer only holds on local disks and HDFS,
not on every object store.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import versions as V

#: Seconds to wait for a manifest that another writer has claimed.
CLAIM_S = 10.0

OWN = ["_txn", "_commit_ts", "_is_deleted"]


#: Commits since the last compaction up to which their numbers are broadcast; beyond, they are joined by a shuffle.
BROADCAST_COMMITS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may fall back to a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def forget_at_exit(spark: SparkSession, root: str) -> None:
    """Has a folder deleted when the driver's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


class StoreError(Exception):
    """A statement that can't be done; its text is the message."""


class Conflict(StoreError):
    """Another transaction has committed a key that this one writes, after this one began."""


@dataclass
class Table:
    name: str
    schema: StructType
    #: Folder of rows -> (transaction, commit); compacted folders have neither and carry commits themselves.
    parts: dict[str, tuple[str | None, int | None]] = field(default_factory=dict)
    #: Snapshots before this can't be read any more.
    low_water: int = 0
    #: Whether each key has one row, a live one: then there are no versions to choose from.
    clean: bool = False

    @property
    def key(self) -> str:
        return self.schema.fieldNames()[0]


@dataclass
class Catalog:
    """All tables and indexes as of one commit."""

    ts: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, tuple[str, str]] = field(default_factory=dict)

    def apply(self, ts: int, manifest: dict) -> Catalog:
        out = Catalog(ts, {k: Table(t.name, t.schema, dict(t.parts), t.low_water, t.clean) for k, t in self.tables.items()}, dict(self.indexes))
        for op in manifest["ops"]:
            kind, name = op["op"], op.get("table")
            if kind == "create":
                out.tables[name] = Table(name, StructType.fromJson(op["schema"]))
            elif kind == "drop":
                out.tables.pop(name, None)
                out.indexes = {i: x for i, x in out.indexes.items() if x[0] != name}
            elif kind == "index":
                out.indexes[op["index"]] = (name, op["column"])
            elif kind == "unindex":
                out.indexes.pop(op["index"], None)
            elif kind == "rows" and name in out.tables:
                out.tables[name].parts[op["path"]] = (manifest["txn"], ts)
                out.tables[name].clean = False
            elif kind == "compact" and name in out.tables:
                t = out.tables[name]
                for p in op["replaces"]:
                    t.parts.pop(p, None)
                t.parts[op["path"]] = (None, None)
                t.low_water = max(t.low_water, op["low_water"])
                t.clean = op["clean"] and len(t.parts) == 1
        return out


class Store:
    """Tables under a folder that the driver and all executors share. A passing store goes when the driver ends."""

    def __init__(self, spark: SparkSession, root: str, passing: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        #: The newest catalog, those of open snapshots, and the manifests that all others can be made from.
        self._now, self._held, self._log = Catalog(), {}, []
        self.open_reads: dict[str, int] = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        if passing:
            forget_at_exit(spark, self.root)

    # ------------------------------------------------------------------------------------------- manifests
    def _manifest(self, ts: int):
        return self._path(f"{self.root}/_commits/{ts:020d}.json")

    def refresh(self) -> Catalog:
        """Reads manifests that have come since; each is read once."""
        while self._fs.exists(self._manifest(self._now.ts + 1)):
            ts = self._now.ts + 1
            stream = self._fs.open(self._manifest(ts))
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self._log.append(json.loads(text))
            self._now = self._now.apply(ts, self._log[-1])
        return self._now

    def catalog(self, ts: int) -> Catalog:
        """The catalog as of a commit. Those of open snapshots are kept, others are made again."""
        if ts == self._now.ts:
            found = self._now
        elif ts in self._held:
            found = self._held[ts]
        else:
            found = Catalog()
            for k, manifest in enumerate(self._log[:ts]):
                found = found.apply(k + 1, manifest)
        open_ = set(self.open_reads.values())
        self._held = {k: c for k, c in self._held.items() if k in open_} | ({ts: found} if ts in open_ else {})
        return found

    def _create(self, ts: int, manifest: dict) -> bool:
        """Whether this writer has made commit ts; False if another has."""
        from py4j.protocol import Py4JJavaError

        # Written aside and renamed: a manifest is never seen half-written, and rename doesn't replace.
        aside = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._fs.create(self._path(f"{self.root}/_commits/{ts:020d}.claim"), False).close()
        except Py4JJavaError:
            self._fs.delete(aside, False)
            self._wait(ts)
            return False
        return bool(self._fs.rename(aside, self._manifest(ts)))

    def _wait(self, ts: int) -> None:
        """Waits for the manifest of a commit that another writer has claimed."""
        until = time.monotonic() + CLAIM_S
        while not self._fs.exists(self._manifest(ts)):
            if time.monotonic() > until:
                raise StoreError(f"commit {ts} was claimed but never published; if its writer is gone, run repair()")
            time.sleep(0.02)

    def repair(self) -> None:
        """Publishes an empty commit in place of one whose writer died between claim and manifest."""
        ts = self.refresh().ts + 1
        if self._fs.exists(self._path(f"{self.root}/_commits/{ts:020d}.claim")):
            out = self._fs.create(self._manifest(ts), False)
            out.write(bytearray(json.dumps({"txn": uuid.uuid4().hex, "ops": []}).encode()))
            out.close()

    # ------------------------------------------------------------------------------------------------ reads
    def versions(self, table: Table) -> DataFrame:
        """All versions of a table: its columns and _commit_ts, _is_deleted."""
        schema = StructType(table.schema.fields[:]).add("_txn", "string").add("_commit_ts", "long").add("_is_deleted", "boolean")
        if not table.parts:
            return self.spark.createDataFrame([], schema).drop("_txn")
        log = self.spark.read.schema(schema).parquet(*table.parts)
        named = [(txn, ts) for txn, ts in table.parts.values() if txn]
        if not named:
            return log.drop("_txn")
        # One row per commit since the last compaction.
        commits = self.spark.createDataFrame(named, "_txn string, _at long")
        return log.join(F.broadcast(commits) if len(named) <= BROADCAST_COMMITS else commits, "_txn", "left").withColumn("_commit_ts", F.coalesce("_commit_ts", "_at")).drop("_txn", "_at")

    def snapshot(self, name: str, ts: int) -> DataFrame:
        """Live rows of a table as of commit ts."""
        table = self.catalog(ts).tables.get(name)
        if table is None:
            raise StoreError(f"no such table: {name}")
        if ts < self.refresh().tables.get(name, table).low_water:
            raise StoreError(f"snapshot {ts} of {name} has been vacuumed")
        log = self.versions(table)
        # A clean table is read as it is, so filters on any column reach its scan.
        live = log if table.clean else V.newest(log, [table.key], "_commit_ts").where("not _is_deleted")
        return live.select(*table.schema.fieldNames())

    def begin(self) -> Transaction:
        return Transaction(self, self.refresh().ts)

    # ---------------------------------------------------------------------------------------- maintenance
    def compact(self, name: str, low_water: int | None = None, sort_by: str | None = None) -> int:
        """Rewrites a table without versions that no snapshot from low_water on can see; returns how many went.

        low_water is at most the oldest open snapshot. Rows are sorted by the indexed column, if there is one, so that
        filters on it skip row groups.
        """
        now = self.refresh()
        table = now.tables.get(name)
        if table is None:
            raise StoreError(f"no such table: {name}")
        low = min([now.ts if low_water is None else low_water, now.ts, *self.open_reads.values()])
        if not table.parts:
            return 0
        log = self.versions(table)
        floor = V.newest(log.where(F.col("_commit_ts") <= low), [table.key], "_commit_ts")
        kept = log.where(F.col("_commit_ts") > low).unionByName(floor.where("not _is_deleted"))
        column = sort_by or next((c for t, c in now.indexes.values() if t == name), table.key)
        path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        kept.withColumn("_txn", F.lit(None).cast("string")).repartitionByRange(column).sortWithinPartitions(column).write.parquet(path)
        before, after = log.count(), self.spark.read.parquet(path).count()
        manifest = {"txn": uuid.uuid4().hex, "ops": [{"op": "compact", "table": name, "path": path, "replaces": list(table.parts), "low_water": low, "clean": low == now.ts}]}
        while not self._create(self.refresh().ts + 1, manifest):
            newer = self.refresh().tables.get(name)
            if newer is None or not set(table.parts) <= set(newer.parts):
                raise Conflict(f"{name} was compacted or dropped meanwhile")
        self.refresh()
        return before - after


    def purge(self, older_than_s: float = 3600) -> int:
        """Deletes folders of rows that neither the newest nor an open snapshot of this process refers to; returns how many.

        Younger ones stay: they may be of transactions that haven't committed yet.
        """
        now = self.refresh()
        used = {p.rsplit("/", 1)[1] for ts in {now.ts, *self.open_reads.values()} for t in self.catalog(ts).tables.values() for p in t.parts}
        gone, root = 0, self._path(f"{self.root}/tables")
        for table in self._fs.listStatus(root) if self._fs.exists(root) else []:
            for part in self._fs.listStatus(table.getPath()):
                if part.getPath().getName() not in used and time.time() - part.getModificationTime() / 1000 >= older_than_s:
                    self._fs.delete(part.getPath(), True)
                    gone += 1
        return gone


class Transaction:
    """A snapshot and the writes staged on top of it."""

    def __init__(self, store: Store, read_ts: int):
        self.store, self.read_ts, self.id = store, read_ts, uuid.uuid4().hex
        self.ops: list[dict] = []
        store.open_reads[self.id] = read_ts
        self._own = store.catalog(read_ts)

    def catalog(self) -> Catalog:
        """The snapshot's catalog with own changes."""
        return self._own.apply(self._own.ts, {"txn": self.id, "ops": [o for o in self.ops if o["op"] != "rows"]})

    def table(self, name: str) -> Table:
        found = self.catalog().tables.get(name)
        if found is None:
            raise StoreError(f"no such table: {name}")
        return found

    def scan(self, name: str) -> DataFrame:
        """Live rows of a table, own writes included."""
        table, columns = self.table(name), self.table(name).schema.fieldNames()
        dropped = max((i for i, o in enumerate(self.ops) if o["op"] in ("drop", "create") and o["table"] == name), default=-1)
        staged = [o["path"] for o in self.ops[dropped + 1 :] if o["op"] == "rows" and o["table"] == name]
        known = dropped < 0 and name in self._own.tables
        if not staged:
            return self.store.snapshot(name, self.read_ts) if known else self.store.spark.createDataFrame([], table.schema)
        schema = StructType(table.schema.fields[:]).add("_is_deleted", "boolean")
        reader, both = self.store.spark.read.schema(schema), None
        for k, path in enumerate(staged):
            part = reader.parquet(path).withColumn("_age", F.lit(k + 1))
            both = part if both is None else both.unionByName(part)
        if known:
            base = self.store.snapshot(name, self.read_ts).withColumn("_is_deleted", F.lit(False)).withColumn("_age", F.lit(0))
            both = both.unionByName(base)
        return V.newest(both, [table.key], "_age").where("not _is_deleted").select(*columns)

    def stage(self, name: str, rows: DataFrame) -> int:
        """Stages rows (all columns and _is_deleted), and returns how many. They are written now and seen by others at commit."""
        path = f"{self.store.root}/tables/{name}/{self.id}-{uuid.uuid4().hex}"
        full = rows.withColumn("_txn", F.lit(self.id)).withColumn("_commit_ts", F.lit(None).cast("long"))
        full.select(*self.table(name).schema.fieldNames(), *OWN).write.parquet(path)
        written = self.store.spark.read.parquet(path).count()
        if written:
            self.ops.append({"op": "rows", "table": name, "path": path})
        return written

    def change(self, **op: object) -> None:
        self.ops.append(op)

    def rollback(self) -> None:
        self.ops = []
        self.store.open_reads.pop(self.id, None)

    def _check(self, since: int, now: Catalog) -> None:
        """Raises Conflict if a commit after `since` wrote a key, table or index that this transaction writes."""
        for name in {o["table"] for o in self.ops if o["op"] == "rows"}:
            if name not in now.tables and name in self._own.tables:
                raise Conflict(f"table {name} was dropped by a later commit")
            if name not in now.tables:
                continue
            # A compacted folder that came since may hold such commits too: their numbers are in its rows.
            table = now.tables[name]
            old = self._own.tables[name].parts if name in self._own.tables else {}
            newer = {p: x for p, x in table.parts.items() if p not in old}
            if not newer:
                continue
            key = table.key
            log = self.store.versions(Table(name, table.schema, newer)).select(F.col(key).alias("key"), F.col("_commit_ts").alias("commit_ts"))
            own = self.store.spark.read.parquet(*[o["path"] for o in self.ops if o["op"] == "rows" and o["table"] == name]).select(F.col(key).alias("key"))
            if hit := V.conflicts(log, own, since).first():
                raise Conflict(f"write conflict on {name}: key {hit.key} was committed at {hit.commit_ts}, after {since}")
        for o in self.ops:
            name = o.get("table")
            if o["op"] == "create" and name in now.tables and name not in self._own.tables:
                raise Conflict(f"table {name} was created by a later commit")
            if o["op"] in ("drop", "index") and name in self._own.tables and name not in now.tables:
                raise Conflict(f"table {name} was dropped by a later commit")
            if o["op"] == "drop" and name in now.tables and set(now.tables[name].parts) != set(self._own.tables.get(name, Table(name, StructType())).parts):
                raise Conflict(f"table {name} was changed by a later commit")

    def commit(self) -> int:
        """Publishes the staged changes and returns the commit's number; the first committer of a key wins."""
        try:
            if not self.ops:
                return self.read_ts
            manifest, checked = {"txn": self.id, "ops": self.ops}, self.read_ts
            while True:
                now = self.store.refresh()
                if now.ts > checked:
                    self._check(self.read_ts, now)
                    checked = now.ts
                if self.store._create(now.ts + 1, manifest):
                    self.store.refresh()
                    return now.ts + 1
        finally:
            self.store.open_reads.pop(self.id, None)
