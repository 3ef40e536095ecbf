"""Merging datasets: guards, union, reproducible shuffle, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataloom.operators.report import category_or_unknown
from dataloom.session import checkpointed


class MergeError(ValueError):
    """A merge that may not start; `code` says which guard refused."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def check_sources(jobs: DataFrame, source_ids: list[str], examples: DataFrame, cap: int | None = None) -> None:
    """Guards in order: sources exist, all completed, one format, one reasoning format (none is one), rows, cap."""
    chosen = jobs.where(F.col("id").isin(source_ids))
    facts = chosen.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "completed").alias("unfinished"), F.count_distinct("format").alias("formats"),
        F.count_distinct(F.coalesce("reasoning_format", F.lit("none"))).alias("reasoning_formats"),
    ).first()
    if facts["n"] < len(set(source_ids)):
        raise MergeError("missing_source")
    if facts["unfinished"]:
        raise MergeError("not_completed")
    if facts["formats"] > 1:
        raise MergeError("format_mismatch")
    if facts["reasoning_formats"] > 1:
        raise MergeError("reasoning_mismatch")
    rows = examples.where(F.col("job_id").isin(source_ids)).count()
    if not rows:
        raise MergeError("empty")
    if cap is not None and rows > cap:
        raise MergeError("too_large")


def merged(examples: DataFrame, source_ids: list[str], job_id: str, shuffle_seed: int | None = None) -> DataFrame:
    """Rows of all sources under a new job: ids derived from job and source id, place in the merge as `seq`.

    Without a seed the order is that of time, then sequence, then id; with one it is a reproducible random order. The
    sequence is numbered by range partitions and their sizes, not in one task.
    """
    rows = examples.where(F.col("job_id").isin(list(dict.fromkeys(source_ids))))
    rows = rows.withColumn("source_job_id", F.col("job_id")).withColumn("source_id", F.col("id")).withColumn("job_id", F.lit(job_id))
    rows = rows.withColumn("id", F.sha2(F.concat_ws("/", F.lit(job_id), "source_job_id", "source_id"), 256))
    if "category" in rows.columns:
        rows = rows.withColumn("category", category_or_unknown(F.col("category")))
    order = [c for c in ("created_at", "seq") if c in rows.columns] + ["source_id"] if shuffle_seed is None else []
    if shuffle_seed is not None:
        rows, order = rows.withColumn("__place", F.md5(F.concat(F.lit(f"{shuffle_seed}:"), "id"))), ["__place", "id"]
    return numbered(rows, order, "seq").drop("__place")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place (from 1) in the total order."""
    spread = rows.drop(name) if name not in order else rows
    # written once: partition numbers must be the same when they are counted and when they are added up
    ranged = checkpointed(spread.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__local", F.monotonically_increasing_id()))
    part = F.shiftright("__local", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    out = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")  # one row per partition
    within = F.col("__local").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("__start") + within + 1).drop("__part", "__local", "__start")


def numbered_within(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Rows with their place (from 1) among those of equal `by`; a group of any length is spread over range partitions."""
    # written once, as in `numbered`
    ranged = checkpointed(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("__local", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__local", 33))
    sizes = ranged.groupBy("__part", F.col(by).alias("__by")).agg(F.min("__local").alias("__first"), F.count("*").alias("__n"))
    earlier = W.partitionBy("__by").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("__part").alias("__of"), "__by", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    out = ranged.join(starts, (F.col("__part") == F.col("__of")) & F.col(by).eqNullSafe(F.col("__by")))
    return out.withColumn(name, F.col("__start") + F.col("__local") - F.col("__first") + 1).drop("__part", "__local", "__of", "__by", "__first", "__start")


def merged_categories(configs: DataFrame) -> DataFrame:
    """One config per category name, that of the first position; equal proportions to four places, the last one
    taking the rest. `configs` has (position, name, ...)."""
    first = configs.withColumn("__n", F.row_number().over(W.partitionBy("name").orderBy("position"))).where("__n = 1").drop("__n")
    every = W.partitionBy()  # categories are at most 64
    n, place = F.count("*").over(every), F.row_number().over(W.orderBy("position"))
    share = F.round(1.0 / n, 4)
    return first.withColumn("proportion", F.when(place == n, F.round(1 - share * (n - 1), 4)).otherwise(share))


def merged_limits(configs: DataFrame) -> DataFrame:
    return configs.agg(F.max("max_tokens").alias("max_tokens"), F.max("conversation_turns").alias("conversation_turns"), F.bool_or("judge_enabled").alias("judge_enabled"))
