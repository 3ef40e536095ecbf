"""Cost attribution: usage aggregates joined to price tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_by_category_model(examples: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "judge_prompt_tokens", "judge_completion_tokens")]
    return examples.groupBy("category", "model").agg(*sums)


def usage_by_model(calls: DataFrame) -> DataFrame:
    """Tokens of calls that made no example (topics, outlines, failed attempts), by model."""
    return calls.groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def cost_rollup(usage: DataFrame, model_prices: DataFrame, judge_prices: DataFrame, overhead: DataFrame | None = None) -> DataFrame:
    """One row: generation and judge cost; null where nothing was spent.

    Prices are per token: (model, prompt_price, completion_price) and (category, judge_prompt_price,
    judge_completion_price); a missing price is 0. Usage is aggregated before it is joined.
    """
    zero = F.lit(0.0)
    priced = usage.join(model_prices, "model", "left").join(judge_prices, "category", "left")
    generation = F.col("prompt_tokens") * F.coalesce("prompt_price", zero) + F.col("completion_tokens") * F.coalesce("completion_price", zero)
    judge = F.col("judge_prompt_tokens") * F.coalesce("judge_prompt_price", zero) + F.col("judge_completion_tokens") * F.coalesce("judge_completion_price", zero)
    rows = priced.select(generation.alias("g"), judge.alias("j"))
    if overhead is not None:
        extra = overhead.join(model_prices, "model", "left").select(generation.alias("g"), F.lit(0.0).alias("j"))
        rows = rows.unionAll(extra)
    total = rows.agg(F.sum("g").alias("g"), F.sum("j").alias("j"))
    return total.select(F.when(F.col("g") > 0, F.round("g", 6)).alias("actual_cost"), F.when(F.col("j") > 0, F.round("j", 6)).alias("judge_cost"))


def cost_with_fallback(jobs: DataFrame, judge_tokens: int = 400) -> DataFrame:
    """Rows with per-job sums: the exact cost where usage was recorded, else tokens and evaluations at list price."""
    has_usage = (F.col("prompt_tokens") + F.col("completion_tokens")) > 0
    exact = F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")
    cost = F.when(has_usage, exact).otherwise(F.col("tokens") * F.col("completion_price"))
    judge = F.when(has_usage, F.col("judge_cost")).otherwise(F.col("evaluated") * judge_tokens * F.col("judge_price"))
    return jobs.select("job_id", F.round(cost, 6).alias("cost"), F.round(judge, 6).alias("judge_cost"))


def estimate(categories: DataFrame, total: int, turns: int, max_tokens: int, judged: bool = True) -> DataFrame:
    """Expected cost of a run from rows (proportion, prompt_price, completion_price, judge prices): 400 prompt tokens and
    six tenths of max_tokens a turn; a judge call has 400 and 100."""
    n = F.col("proportion") * total
    generation = n * turns * (F.col("prompt_price") * 400 + F.col("completion_price") * (0.6 * max_tokens))
    judge = n * (F.col("judge_prompt_price") * 400 + F.col("judge_completion_price") * 100) if judged else F.lit(0.0)
    return categories.agg(F.round(F.sum(generation + judge), 6).alias("estimated_cost"))
