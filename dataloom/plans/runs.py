"""Whole runs: from categories to stored examples, what they cost, their figures, and their lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataloom.functions import codec
from dataloom.operators import cost, maintained, merge
from dataloom.plans import models, pipelines
from dataloom.plans.cancellation import Cancellation
from dataloom.plans.models import StubClient
from dataloom.schemas import Caps
from dataloom.session import checkpointed
from dataloom.sources import dual_sink
from dataloom.sources.versions import VersionedTable


@dataclass
class Run:
    """What a run keeps below its folder. Each part is published when it is whole; a run that is started again goes on from there."""

    spark: SparkSession
    folder: str

    @property
    def topics(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/topics", "category")

    @property
    def attempts(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/attempts")

    @property
    def examples(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/examples")

    @property
    def figures(self) -> maintained.MaintainedFigures:
        return maintained.MaintainedFigures(self.examples, f"{self.folder}/figures")

    @property
    def lines(self) -> str:
        return f"{self.folder}/export"

    def once(self, table: VersionedTable, batch: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """The table with the batch in it; its rows are made only if it is not there yet."""
        if batch not in table.snapshot().batches:
            table.append(rows(), batch)
        return table.read()


def generation(
    run: Run, job_id: str, categories: DataFrame, model_prices: DataFrame, judge_prices: DataFrame, fmt: str = "chatml", threshold: int = 80,
    factory: Callable = StubClient, budget: int = 5, cancel: Cancellation | None = None, caps: Caps = Caps(), **options,
) -> DataFrame:
    """Topics, outlines, examples, judging, storing, cost, figures and lines of the categories (category, description, model, target).

    Each category is asked once for topics for its whole budget. Returns one row: examples, attempts, actual_cost, judge_cost, stats_json, lines.
    Tokens of topics and outlines are overhead of the category's model.
    """
    if caps.job is not None:
        caps.check("job", categories.agg(F.sum("target")).first()[0] or 0)
    wanted = categories.withColumn("count", F.col("target") * budget)
    asked = run.once(run.topics, "topics", lambda: pipelines.topics(wanted, factory, usage=True).join(categories, "category"))
    topics = asked.select("category", "target", F.posexplode("topics").alias("i", "topic")).select("category", (F.col("i") + 1).alias("attempt"), "topic", "target")
    log = pipelines.generate(topics, fmt, threshold, factory, budget=budget, log=run.attempts, cancel=cancel, **options)
    models_of = categories.select("category", "model")

    def accepted() -> DataFrame:
        rows = log.where("accepted").join(models_of, "category")
        rows = merge.numbered(rows, ["category", "attempt"], "seq")
        return rows.select(
            F.sha2(F.concat_ws("/", F.lit(job_id), "id"), 256).alias("id"), F.lit(job_id).alias("job_id"), "seq", "content_json", F.lit(fmt).alias("format"), "category", "model",
            F.col("score").alias("judge_score"), "prompt_tokens", "completion_tokens", "judge_prompt_tokens", "judge_completion_tokens",
        )

    examples = run.once(run.examples, "accepted", accepted)
    told = asked.select("model", "prompt_tokens", "completion_tokens")
    outlined = log.join(models_of, "category").select("model", F.col("outline_prompt_tokens").alias("prompt_tokens"), F.col("outline_completion_tokens").alias("completion_tokens"))
    spent = cost.cost_rollup(cost.usage_by_category_model(examples), model_prices, judge_prices, cost.usage_by_model(told.union(outlined)))
    figures = run.figures
    figures.refresh()
    lines = dual_sink.export(examples, run.lines) if not examples.isEmpty() else 0
    # a row of totals
    cost_row, stats = spent.first(), maintained.snapshot(figures.read(), threshold).first()
    totals = (examples.count(), log.count(), cost_row["actual_cost"], cost_row["judge_cost"], stats["stats_json"], lines)
    return run.spark.createDataFrame([totals], "examples long, attempts long, actual_cost double, judge_cost double, stats_json string, lines long")


def reasoning(run: Run, source: DataFrame, job_id: str, factory: Callable = StubClient, threshold: int = 80, **options) -> DataFrame:
    """A copy of the well-formed examples of `source` with rationales: validated, enriched, stored, with figures and lines.

    Examples that have reasoning keep it; those whose rationales are no use stay without. Enrichment is one batch that is published when it is
    whole: a run that ended before starts it again, one that ended later does not ask again. Returns (id, seq, reasoning, line).
    """
    sound = source.where(codec.validation_reason(F.col("content_json"), F.col("format")) == "ok")
    done = sound.where(F.size(codec.stored_reasoning(F.col("reasoning"))) > 0)

    def enriched() -> DataFrame:
        rows = checkpointed(sound)
        found = checkpointed(pipelines.enrich(rows, done, factory, **options))
        new = found.select(F.col("id").alias("__id"), F.col("reasoning").alias("__new"))
        joined = rows.join(new, F.col("id") == F.col("__id"), "left")
        copied = joined.withColumn("reasoning", F.coalesce("__new", "reasoning")).withColumn("job_id", F.lit(job_id))
        return copied.select(*source.columns)

    examples = run.once(run.examples, "enriched", enriched)
    run.figures.refresh()
    path = run.lines
    if not examples.isEmpty():
        dual_sink.export(examples, path, "inline")
    return examples
