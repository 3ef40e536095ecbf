"""Accept and reject over an attempt log, and the counters that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Attempts of one category that are summed up in one task.
SPAN = 10_000


def judged(attempts: DataFrame, calls: DataFrame, threshold: int, max_calls: int = 3) -> DataFrame:
    """Attempts (id) with the outcome of their judge calls (id, call, score), of which the first `max_calls` count.

    Accepted at the first score of at least the threshold; the score kept is that one, else the last there is.
    """
    counted = calls.where(F.col("call") <= max_calls)
    hit = F.col("score") >= threshold
    outcome = counted.groupBy("id").agg(
        F.min_by("score", F.when(hit, F.col("call"))).alias("__hit"), F.max_by("score", F.when(F.col("score").isNotNull(), F.col("call"))).alias("__last"), F.bool_or(hit).alias("__any"),
    )
    joined = attempts.join(outcome, "id", "left")
    accepted = F.coalesce("__any", F.lit(False))
    return joined.withColumn("accepted", accepted).withColumn("score", F.when(accepted, F.col("__hit")).otherwise(F.col("__last"))).drop("__hit", "__last", "__any")


def seek_target(attempts: DataFrame, target: str = "target", budget: int = 5) -> DataFrame:
    """The attempts that a run makes per category: until `target` are accepted or budget times target are made.

    `attempts` has (category, attempt, accepted, target); what follows the last attempt made is left out.
    """
    # running sums in two levels, over spans of attempts and within one, so that a category of any length fills no task
    span = F.floor(F.col("attempt") / SPAN).cast("long")
    spans = attempts.groupBy(F.col("category").alias("__of"), span.alias("__at")).agg(F.count_if("accepted").alias("__a"), F.count("*").alias("__c"))
    earlier = W.partitionBy("__of").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select("__of", "__at", F.coalesce(F.sum("__a").over(earlier), F.lit(0)).alias("__a"), F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__c"))
    rows = attempts.withColumn("__span", span).join(starts, F.col("category").eqNullSafe(F.col("__of")) & (F.col("__span") == F.col("__at")))
    order = W.partitionBy("category", "__span").orderBy("attempt")
    so_far = F.coalesce(F.sum(F.col("accepted").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    made = rows.withColumn("__so_far", F.col("__a") + so_far).withColumn("__n", F.col("__c") + F.row_number().over(order))
    return made.where((F.col("__so_far") < F.col(target)) & (F.col("__n") <= budget * F.col(target))).select(*attempts.columns)


def counters(attempts: DataFrame) -> DataFrame:
    """Per category: evaluated, accepted, rejected, and skipped (rejected or without an outcome)."""
    accepted = F.col("accepted")
    return attempts.groupBy("category").agg(
        F.count_if(F.col("score").isNotNull()).alias("evaluated"), F.count_if(accepted).alias("accepted"),
        F.count_if(~accepted & F.col("score").isNotNull()).alias("rejected"), F.count_if(~accepted).alias("skipped"),
    )


def within_budget(examples: DataFrame, max_tokens: int, threshold: int) -> DataFrame:
    return examples.where((F.col("completion_tokens") <= max_tokens) & (F.col("judge_score") >= threshold))


def unfinished(wanted: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is left to do when a run resumes."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def resolved_providers(categories: DataFrame, jobs: DataFrame, default_id: str | None) -> DataFrame:
    """Provider of generation and of judging per category: its own, the job's, the default; the judge falls back to
    its own, the job's judge, the category's, the job's, the default."""
    j = jobs.select("job_id", F.col("provider_id").alias("__job"), F.col("judge_provider_id").alias("__judge"))
    default = F.lit(default_id).cast("string")
    out = categories.join(j, "job_id", "left")
    return out.select(
        "job_id", "category", F.coalesce("provider_id", "__job", default).alias("provider"),
        F.coalesce("judge_provider_id", "__judge", "provider_id", "__job", default).alias("judge_provider"),
    )
