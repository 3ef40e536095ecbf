"""Versioned tables: folders of Parquet files behind a log of snapshots that are swapped in one at a time.

A table's folder has `rows/` and `gone/`, in which every write makes a folder of its own, and `log/`, in which snapshot n is
the file n.json: the folders that make up the table, and the names of the batches that are in it. A write first writes
its folder and then publishes the next snapshot by a rename that fails if that number is taken; then it reads the log
again and tries the next one. So a reader sees all of a write or nothing, a batch of a known name is not written twice, and what a
lost run has left behind is in no snapshot.

Deletion writes keys (tombstones), which hide the rows that were written before them; `compact` and `rewritten` write the
rows that are left, at once or folder by folder. Every row carries the number of the snapshot that it was written after, which tells what a tombstone hides.

Rows are written and read by Spark on any file system that it reaches; only snapshots, with an entry per write, pass
through the driver. A table of no snapshot has no rows and no schema to read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of every written row: the snapshot that was the latest when it was written.
AFTER = "__after"


@dataclass(frozen=True)
class Part:
    """A folder of one write: rows, or the keys of rows that are gone."""

    kind: str
    folder: str
    n: int


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    parts: tuple[Part, ...] = ()
    batches: tuple[str, ...] = ()
    note: dict = field(default_factory=dict)

    def folders(self, kind: str) -> list[str]:
        return [p.folder for p in self.parts if p.kind == kind]


class Taken(Exception):
    """Another writer has published this version."""


class _Files:
    """The few calls to the file system that a log needs, on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        root = self._path(path)
        self._fs = root.getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def text(self, file: str) -> str:
        stream = self._fs.open(self._path(file))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, file: str, text: str) -> None:
        """Writes the whole file or nothing; raises Taken where there is one."""
        hidden = self._path(f"{file}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        array = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        array[0] = none
        try:
            self._context.rename(hidden, self._path(file), array)
        except Exception as problem:
            self._fs.delete(hidden, False)
            if "FileAlreadyExistsException" in str(problem):
                raise Taken(file) from problem
            raise

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)


class VersionedTable:
    """A table at `path`, of which rows are told by the column `key` where they are deleted."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._files = _Files(spark, self.path)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._files.names(f"{self.path}/log") if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The snapshot of a version, by default the last; version 0 is the empty table."""
        known = self.versions()
        at = version if version is not None else max(known, default=0)
        if at == 0:
            return Snapshot()
        if at not in known:
            raise ValueError(f"no version {at}")
        got = json.loads(self._files.text(f"{self.path}/log/{at:010d}.json"))
        return Snapshot(got["version"], tuple(Part(**p) for p in got["parts"]), tuple(got["batches"]), got["note"])

    def log(self) -> DataFrame:
        """Rows (version, batch, rows, gone, note): what each version added and how many keys it hid."""
        rows, before = [], Snapshot()
        for v in self.versions():
            now = self.snapshot(v)
            new = [p for p in now.parts if p not in before.parts]
            batch = now.batches[-1] if len(now.batches) > len(before.batches) else None
            rows.append((v, batch, sum(p.n for p in new if p.kind == "rows"), sum(p.n for p in new if p.kind == "gone"), json.dumps(now.note)))
            before = now
        return self.spark.createDataFrame(rows, "version long, batch string, rows long, gone long, note string")

    def _publish(self, change, batch: str | None, note: dict | None) -> int:
        """Publishes change(last snapshot's parts) as the next version; nothing if the batch is in it already."""
        while True:
            last = self.snapshot()
            if batch is not None and batch in last.batches:
                return last.version
            batches = last.batches if batch is None else (*last.batches, batch)
            new = Snapshot(last.version + 1, tuple(change(last.parts)), batches, note or {})
            try:
                self._files.put_new(f"{self.path}/log/{new.version:010d}.json", json.dumps(asdict(new)))
                return new.version
            except Taken:
                continue

    def _write(self, rows: DataFrame, kind: str, after: int | None) -> Part:
        """Writes a folder; `after` is None for rows that have their number."""
        folder = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        (rows if after is None else rows.withColumn(AFTER, F.lit(after))).write.parquet(folder)
        return Part(kind, folder, self.spark.read.parquet(folder).count())

    def append(self, rows: DataFrame, batch: str | None = None, note: dict | None = None) -> int:
        """Adds rows as the next version, and returns it; a batch of a name that is there already changes nothing."""
        last = self.snapshot()
        if batch is not None and batch in last.batches:
            return last.version
        part = self._write(rows, "rows", last.version)
        return self._publish(lambda parts: (*parts, part), batch, note)

    def replace(self, rows: DataFrame, batch: str | None = None, note: dict | None = None) -> int:
        """Makes `rows`, which may be read from this table, the whole table."""
        part = self._write(rows, "rows", self.snapshot().version)
        return self._publish(lambda parts: (part,), batch, note)

    def delete(self, keys: DataFrame, batch: str | None = None, note: dict | None = None) -> int:
        """Hides the rows there are with these keys; rows of the key that are added later are seen."""
        last = self.snapshot()
        if batch is not None and batch in last.batches:
            return last.version
        part = self._write(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "gone", last.version + 1)
        return self._publish(lambda parts: (*parts, part), batch, note)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        at = self.snapshot(version)
        if not at.folders("rows"):
            raise ValueError("the table has no rows yet")
        return self._visible(self.spark.read.parquet(*at.folders("rows")), self._hidden(at.folders("gone"))).drop(AFTER)

    def changes(self, since: int, version: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows that a version has and the earlier version `since` has not, and the other way round; None for none.

        They are read from the folders of the writes in between alone. A ValueError where rows were rewritten in between.
        """
        before, now = self.snapshot(since), self.snapshot(version)
        new = [p for p in now.parts if p not in before.parts]
        if any(p not in now.parts for p in before.parts):
            raise ValueError("rows were rewritten between these versions")
        fresh, gone = [p.folder for p in new if p.kind == "rows"], [p.folder for p in new if p.kind == "gone"]
        added = removed = None
        hidden = self._hidden(now.folders("gone"))
        if fresh:
            added = self._visible(self.spark.read.parquet(*fresh), hidden).drop(AFTER)
        if gone and before.folders("rows"):
            old = self._visible(self.spark.read.parquet(*before.folders("rows")), self._hidden(before.folders("gone")))
            removed = self._visible(old, self._hidden(gone), "left_semi").drop(AFTER)
        return added, removed

    def _hidden(self, folders: list[str]) -> DataFrame | None:
        """Per key: rows written after an earlier snapshot than `__since` are gone."""
        if not folders:
            return None
        return self.spark.read.parquet(*folders).groupBy(F.col(self.key).alias("__gone")).agg(F.max(AFTER).alias("__since"))

    def _visible(self, rows: DataFrame, hidden: DataFrame | None, how: str = "left_anti") -> DataFrame:
        if hidden is None:
            return rows
        return rows.join(hidden, (F.col(self.key) == F.col("__gone")) & (F.col(AFTER) < F.col("__since")), how)

    def rewritten(self) -> Iterator[int]:
        """Rewrites the folders there are, one at a time, without the rows that are gone, and yields the version after each.

        At last the tombstones of the start go, which hide nothing any more. A run that ends early has lost nothing; a
        further one starts with the folders as they then are.
        """
        start = self.snapshot()
        gone = start.folders("gone")
        if not gone:
            return
        for old in [p for p in start.parts if p.kind == "rows"]:
            new = self._write(self._visible(self.spark.read.parquet(old.folder), self._hidden(gone)), "rows", None)
            yield self._publish(lambda parts: [new if p == old else p for p in parts], None, {"rewritten": old.folder})
        yield self._publish(lambda parts: [p for p in parts if p.folder not in gone], None, {"forgotten": len(gone)})

    def compact(self) -> int:
        """Rewrites the rows that are left into one folder; versions before it can still be read until `vacuum`."""
        last = self.snapshot()
        if not last.folders("rows"):
            return last.version
        part = self._write(self.read(last.version), "rows", last.version)
        # what others have added meanwhile stays
        return self._publish(lambda parts: (part, *[p for p in parts if p not in last.parts]), None, {"compacted": last.version})

    def unpublished(self, keep: int = 1) -> list[str]:
        """Folders that none of the last `keep` snapshots has: what lost runs and older versions have left."""
        named = {p.folder for v in self.versions()[-keep:] for p in self.snapshot(v).parts}
        there = [f"{self.path}/{kind}/{n}" for kind in ("rows", "gone") for n in self._files.names(f"{self.path}/{kind}")]
        return [f for f in there if f not in named]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes them; to be called while no write is under way. Versions but the last `keep` can no longer be read."""
        gone = self.unpublished(keep)
        for folder in gone:
            self._files.delete(folder)
        return gone
