"""One pass, two outputs: examples as a table and as JSON lines, published together or not at all.

A Python data source whose writers put a Parquet file and a file of lines per task, under names that only this
attempt has. The commit, which Spark calls once all tasks are done, writes a manifest of the attempts that count,
by a rename: readers see the files of the manifest and nothing else. A task that is killed and runs again leaves files
that no manifest names; a job that fails publishes nothing, and its files are removed. Both outputs have the
same rows, as each was written from one batch. Rows whose content is no JSON object have no line and are in neither. A job of
no lines is refused.

Lines are in order of the partitions and, within one, of its rows. Files are written through Arrow's file systems, so the
folder may be on a shared disk, HDFS or an object store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from dataloom.functions import codec
from dataloom.sources.io import jsonl_lines

LINE = "__line"
FORMAT = "examples_with_lines"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its partition, the stem of its two files, and their rows."""

    partition: int
    stem: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        partition = TaskContext.get().partitionId()
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        stem, n = f"part-{partition:06d}-{uuid.uuid4().hex}", 0
        table, lines = None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                at = batch.schema.get_field_index(LINE)
                rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], schema=batch.schema.remove(at))
                if table is None:
                    table = pq.ParquetWriter(f"{root}/{stem}.parquet", rest.schema, filesystem=system)
                    lines = system.open_output_stream(f"{root}/{stem}.jsonl")
                table.write_batch(rest)
                lines.write("".join(f"{line}\n" for line in batch.column(at).to_pylist()).encode())
                n += batch.num_rows
        finally:
            for out in (table, lines):
                if out is not None:
                    out.close()
        return Written(partition, stem, n)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m.partition, m.stem, m.rows) for m in messages if m is not None and m.rows)
        if not parts:
            raise ValueError("no examples to export")
        system, root = _opened(self.path)
        hidden = f"{root}/manifest-{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(hidden) as out:
            out.write(json.dumps({"rows": sum(n for *_, n in parts), "stems": [s for _, s, _ in parts]}).encode())
        system.move(hidden, f"{root}/manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        for m in messages:
            if m is not None and m.rows:
                for kind in ("parquet", "jsonl"):
                    if system.get_file_info(f"{root}/{m.stem}.{kind}").type == fs.FileType.File:
                        system.delete_file(f"{root}/{m.stem}.{kind}")


class ExamplesWithLines(DataSource):
    """`df.write.format("examples_with_lines")` for rows that have their line in the column `LINE`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def export(examples: DataFrame, path: str, reasoning_format: str | None = None, files: int | None = None) -> int:
    """Writes examples (seq, content_json, format, ...) and their lines, in order of seq, from one pass; returns their number.

    The lines' files in the order of the manifest, one after another, are in order of seq.
    """
    spark = examples.sparkSession
    spark.dataSource.register(ExamplesWithLines)
    told = examples.where(codec.is_object(F.col("content_json")))
    rows = jsonl_lines(told, reasoning_format, keep=True).where("line is not null").withColumnRenamed("line", LINE)
    ranged = rows.repartitionByRange(files, "seq") if files else rows.repartitionByRange("seq")
    ranged.sortWithinPartitions("seq").write.format(FORMAT).mode("append").option("path", path).save()
    return _manifest(path)["rows"]


def _manifest(path: str) -> dict:
    system, root = _opened(path)
    with system.open_input_stream(f"{root}/manifest.json") as file:
        return json.loads(file.read())


def published_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{s}.parquet" for s in _manifest(path)["stems"]])


def published_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, line), files numbered in the order of their rows."""
    stems = _manifest(path)["stems"]
    number = F.create_map(*[x for i, s in enumerate(stems) for x in (F.lit(s), F.lit(i))])
    stem = F.regexp_extract("_metadata.file_path", r"(part-\d+-[0-9a-f]+)\.jsonl$", 1)
    return spark.read.text([f"{path}/{s}.jsonl" for s in stems]).select(number[stem].alias("file"), F.col("value").alias("line"))
