"""Deletion in chunks with progress: each chunk is committed, and a run that was stopped goes on where it ended."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataloom.operators import merge
from dataloom.sources.versions import Taken, VersionedTable

#: Rows of a commit.
CHUNK_ROWS = 10_000


def planned(table: VersionedTable, keys: DataFrame, name: str, chunk_rows: int = CHUNK_ROWS) -> dict:
    """The plan of the deletion `name`: its keys, in order and in chunks of `chunk_rows`. Made once; a further call returns the first."""
    file = f"{table.path}/deletions/{name}.json"
    known = table._files.names(f"{table.path}/deletions")
    if f"{name}.json" not in known:
        folder = f"{table.path}/deletions/{uuid.uuid4().hex}"
        rows = keys.select(table.key).where(F.col(table.key).isNotNull()).distinct()
        placed = merge.numbered(rows, [table.key], "__place").withColumn("chunk", F.floor((F.col("__place") - 1) / chunk_rows).cast("int"))
        placed.drop("__place").write.partitionBy("chunk").parquet(folder)
        total = table.spark.read.schema(rows.schema).parquet(folder).count()
        try:
            table._files.put_new(file, json.dumps({"folder": folder, "total": total, "chunks": math.ceil(total / chunk_rows)}))
        except Taken:
            pass
    return json.loads(table._files.text(file))


def steps(table: VersionedTable, keys: DataFrame, name: str, chunk_rows: int = CHUNK_ROWS) -> Iterator[int]:
    """Deletes the rows of `keys` chunk by chunk and yields the version after each commit.

    Chunks that an earlier run has committed are in the log and are not done again. The rows are hidden by the
    commit and leave the disk when the table is rewritten (`VersionedTable.rewritten`).
    """
    plan = planned(table, keys, name, chunk_rows)
    done = set(table.snapshot().batches)
    for chunk in range(plan["chunks"]):
        batch = f"delete/{name}/{chunk}"
        if batch not in done:
            part = table.spark.read.parquet(plan["folder"]).where(F.col("chunk") == chunk)
            yield table.delete(part, batch, {"delete": name, "chunk": chunk, "chunks": plan["chunks"], "total": plan["total"]})


def progress(table: VersionedTable, name: str) -> DataFrame:
    """Rows (version, chunk, chunks, n, deleted, total, percent) of the commits of the deletion `name` so far."""
    rows, deleted = [], 0
    for v in table.versions():
        at = table.snapshot(v)
        if at.note.get("delete") == name:
            n = at.parts[-1].n
            deleted += n
            rows.append((v, at.note["chunk"], at.note["chunks"], n, deleted, at.note["total"], deleted * 100 // at.note["total"]))
    return table.spark.createDataFrame(rows, "version long, chunk int, chunks int, n long, deleted long, total long, percent int")
