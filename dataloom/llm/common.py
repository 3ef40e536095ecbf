"""Shared pieces of the corpus operators: batching, vectorised word hashes, checkpoints, components."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once.
CHUNK_BYTES = 1 << 18

#: Bytes of rows that a Python worker is given at once, where the session names no number (Spark's own is 64 MB, or 10,000 rows).
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if shared:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared)
        return shared
    if context.getCheckpointDir() is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{stem}-{os.urandom(8).hex()}")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About `rows` rows of df (all, if it has no more): those whose key hashes lowest."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.xxhash64(key) < -(1 << 63) + int((1 << 64) * (rows / n)))


def keyed(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with a column `key` that tells rows apart: the id where it does so, else a row number by id (null last) and text."""
    integral = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    ids = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    if integral and ids.where("n > 1 or id is null").limit(1).count() == 0:
        return docs.withColumn(key, F.col(id_col).cast("long"))
    return checkpointed(docs.orderBy(F.col(id_col).asc_nulls_last(), text_col).withColumn(key, F.monotonically_increasing_id()))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Hands freed memory back to the system: workers live on between tasks, and glibc keeps what they freed."""
    if _trim:
        _trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, after which the worker gives its memory back."""

    def then_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return then_give_back


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of about `BATCH_BYTES` (or one longer row), whatever the rows' lengths.

    Both sides of a task hold a batch, and the JVM more than one while it grows. Batches are cut when the plan is made, so the
    session keeps the setting; one that is set already stays as it is.
    """
    if BATCH_SETTING not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(giving_back(run), schema)


def chunks(rows: list[tuple], size_of, limit: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Runs of whole rows of about `limit` bytes; a longer row is a run of its own."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size_of(row)
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def text_slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of at most `limit` bytes of text; a longer row is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        tables = []
        for base in (_ODD, _INV):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            tables.append(np.cumprod(powers, dtype=np.uint64))
        if size > 2 * CHUNK_BYTES:
            return tables
        _powers[:] = tables
    return _powers


#: A-Z to lower case; white space (space, 9 to 13) to a space.
LOWER_BY_SPACE = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z to lower case; every other ASCII byte but digits and a-z to a space. Bytes from 128 on stay.
LOWER_BY_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def word_hashes(texts: list[bytes], mapping: bytes = LOWER_BY_SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """64-bit hashes of the words of all texts, vectorised over bytes.

    Returns the hashes, the first word index of every text (one more at the end), byte starts and ends of the
    words in the joined buffer, and that buffer. With `prefixes` the hashes have a row more for each number of bytes:
    those of the words' beginnings, 0 for words that are no longer than that.
    """
    buffer = (b" ".join(texts) + b" ").translate(mapping)
    data = np.frombuffer(buffer, np.uint8)
    edge = np.diff(np.concatenate(([0], (data != 32).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    if prefixes:
        rows = [hashes]
        for size in prefixes:
            cut = np.minimum(starts + size, ends)
            rows.append(np.where(cut < ends, mix(mix((total[cut] - total[starts]) * down[starts]) + _U(size)), _U(0)))
        hashes = np.stack(rows)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    first = np.searchsorted(starts, offsets[:-1])
    return hashes, np.append(first, len(starts)), starts, ends, buffer


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words i to i + size - 1, for each i of one array of word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _U(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)


#: Rows of one key that go to one task, at least; and of so many equal parts of all rows one.
PART_ROWS, PARTS_OF_ALL = 500, 10_000


def salted_join(many: DataFrame, one: DataFrame, key: str, by: Column) -> DataFrame:
    """Inner join of rows with the one row of their key, in which a key with many rows fills no task.

    The rows of a key that has a 10,000th of all rows or more (and `PART_ROWS`) are dealt to parts of about that size by the hash of
    `by`, and the row of that key is copied to each. There are at most 10,000 such keys, which are broadcast.
    """
    counts = checkpointed(many.groupBy(key).agg(F.count("*").alias("n")))
    least = max(PART_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // PARTS_OF_ALL)
    parts = F.broadcast(counts.where(F.col("n") > least).select(key, F.ceil(F.col("n") / least).cast("int").alias("parts")))
    dealt = many.join(parts, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0)).cast("int"))
    copies = one.join(parts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    return dealt.drop("parts").join(copies.drop("parts"), [key, "salt"]).drop("salt")


def min_label_components(edges: DataFrame, a: str, b: str, label: str = "component") -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, label), label the smallest node reachable.

    The smallest node of a component has no row of its own.

    Alternates large-star and small-star joins, which only ever link a node to a smaller one, until no link
    changes. Each round is checkpointed in the shared folder; nothing but two counters reaches the driver, and
    neighbourhoods are reduced to their minimum (map-side combined) instead of being listed.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = checkpointed(links)
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        lowest = lowest.select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(lowest, both.u == lowest.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(low, large.u == low.n).select(F.col("v"), F.col("u"), F.col("m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        links = checkpointed(small.where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias(label))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
