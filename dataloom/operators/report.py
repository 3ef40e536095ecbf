"""Quality reports over examples: token statistics, score summary and histogram, efficiency, run summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataloom.schemas import ENDED


def category_or_unknown(category: Column) -> Column:
    return F.when(F.coalesce(category, F.lit("")) == "", "Unknown").otherwise(category)


def token_stats(examples: DataFrame, by: str = "category", tokens: str = "completion_tokens") -> DataFrame:
    """Count, mean (one decimal), least and most tokens per category; blank categories are 'Unknown'."""
    t = F.col(tokens)
    return (
        examples.groupBy(category_or_unknown(F.col(by)).alias("category"))
        .agg(F.count("*").alias("n"), F.round(F.avg(t), 1).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"))
        .orderBy("category")
    )


def score_summary(examples: DataFrame, score: str = "judge_score") -> DataFrame:
    """One row: number, least, most, mean (one decimal) and whole median of the scores there are.

    The median is taken from the counts of each score (a bounded number of integers), not from sorted rows.
    """
    return summary_of(score_counts(examples, score))


def score_counts(examples: DataFrame, score: str = "judge_score") -> DataFrame:
    """Rows (s, c): how often each whole score is there."""
    s = F.col(score)
    return examples.where(s.isNotNull()).groupBy(s.cast("int").alias("s")).agg(F.count("*").alias("c"))


def summary_of(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("s").alias("min_score"), F.max("s").alias("max_score"),
        F.round(F.sum(F.col("s") * F.col("c")) / F.sum("c"), 1).alias("mean_score"),
        F.expr("cast(percentile(s, 0.5, c) as int)").alias("median_score"),
    )


def score_histogram(examples: DataFrame, score: str = "judge_score") -> DataFrame:
    """Non-empty buckets of width 1, 5 or 10 (range up to 10, up to 25, beyond), aligned to the width; the last label
    ends at the greatest score."""
    return histogram_of(score_counts(examples, score))


def histogram_of(counts: DataFrame) -> DataFrame:
    every = W.partitionBy()  # of at most as many rows as there are whole scores
    bounded = counts.withColumn("lo", F.min("s").over(every)).withColumn("hi", F.max("s").over(every))
    span = F.col("hi") - F.col("lo")
    placed = bounded.withColumn("width", F.when(span <= 10, 1).when(span <= 25, 5).otherwise(10))
    start = (F.floor(F.col("s") / F.col("width")) * F.col("width")).cast("int")
    buckets = placed.groupBy(start.alias("bucket_start"), "width", "hi").agg(F.sum("c").alias("n"))
    end = F.least(F.col("bucket_start") + F.col("width") - 1, F.col("hi"))
    label = F.when(F.col("width") == 1, F.col("bucket_start").cast("string")).otherwise(F.concat_ws("-", "bucket_start", end))
    return buckets.select("bucket_start", label.alias("label"), "n").orderBy("bucket_start")


def efficiency(counters: DataFrame) -> DataFrame:
    """Rows (category, completed, skipped) with the success rate in percent; 100 without attempts."""
    total = F.col("completed") + F.col("skipped")
    rate = F.when(total > 0, F.round(F.col("completed") * 100.0 / total, 1)).otherwise(100.0)
    return counters.select("category", "completed", "skipped", rate.alias("success_rate")).orderBy("category")


def mean_score(examples: DataFrame, score: str = "judge_score") -> DataFrame:
    """Mean score per job of the rows that have one, one decimal."""
    return examples.where(F.col(score).isNotNull()).groupBy("job_id").agg(F.round(F.avg(score), 1).alias("mean_score"))


def bars(buckets: DataFrame, n: str = "n") -> DataFrame:
    """Bar lengths relative to the largest bucket (at least 1), not under one percent."""
    top = F.greatest(F.max(n).over(W.partitionBy()), F.lit(1))
    return buckets.withColumn("bar", F.greatest(F.round(F.col(n) * 100.0 / top, 1), F.lit(1.0)))


def snapshot(examples: DataFrame, counters: DataFrame, judged: bool = True) -> DataFrame:
    """One JSON row of the whole report; the score parts are null unless judged and scored."""
    parts = {"tokens": token_stats(examples), "efficiency": efficiency(counters)}
    if judged:
        parts |= {"scores": score_summary(examples), "histogram": score_histogram(examples)}
    return snapshot_of(parts)


def snapshot_of(reports: dict[str, DataFrame]) -> DataFrame:
    """One JSON row of the reports (tokens, efficiency, scores, histogram) that there are."""

    def part(name: str, rows: DataFrame) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(*rows.columns)))
        return rows.agg(listed.alias("rows")).select(F.lit(name).alias("part"), F.to_json("rows").alias("json"))

    rows = reduce(DataFrame.unionByName, [part(name, rows.where("n > 0") if name == "scores" else rows) for name, rows in reports.items()])
    entries = F.transform(F.sort_array(F.collect_list(F.struct("part", "json"))), lambda p: F.concat(F.lit('"'), p["part"], F.lit('":'), p["json"]))
    return rows.agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("stats_json"))


def run_summary(jobs: DataFrame, examples: DataFrame) -> DataFrame:
    """Per job: number of examples (counted from the rows), and for an ended job its end and duration in seconds."""
    counts = examples.groupBy("job_id").agg(F.count("*").alias("n_examples"))
    ended = F.col("status").isin(*ENDED)
    seconds = F.greatest(F.lit(0), F.unix_timestamp("updated_at") - F.unix_timestamp("created_at"))
    return jobs.join(counts, jobs["id"] == counts["job_id"], "left").select(
        "id", "status", F.coalesce("n_examples", F.lit(0)).alias("n_examples"), F.when(ended, F.col("updated_at")).alias("ended_at"), F.when(ended, seconds).alias("duration_s"),
    )


def progress(counters: DataFrame, elapsed_s: float) -> DataFrame:
    """Per job of rows (job_id, target, completed): percent done and seconds left at the present pace."""
    sums = counters.groupBy("job_id").agg(F.sum("target").alias("target"), F.sum("completed").alias("completed"))
    done = F.when(F.col("target") > 0, F.least(F.lit(100), F.round(F.col("completed") * 100.0 / F.col("target")).cast("int"))).otherwise(0)
    left = F.when(F.col("completed") > 0, F.round(F.lit(elapsed_s) / F.col("completed") * F.greatest(F.col("target") - F.col("completed"), F.lit(0))).cast("long"))
    return sums.withColumn("percent", done).withColumn("eta_s", left)
