"""Per-job event log: sequence numbers, a bounded tail, cursors, and rendered messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataloom.operators.merge import numbered_within
from dataloom.schemas import TERMINAL

RING = 20

#: Kinds, their levels and the names of their meta; kind: (level, message with {names} of the event's meta).
TEMPLATES = {
    "generation_api_error": ("warn", "{category}: call failed (attempt {attempt})"),
    "generation_unexpected_error": ("warn", "{category}: something failed (attempt {attempt})"),
    "generation_empty_response": ("warn", "{category}: the model's answer is empty"),
    "generation_json_parse_error": ("warn", "{category}: the model's answer is no JSON"),
    "generation_invalid_structure": ("warn", "{category}: the example has a wrong form"),
    "generation_over_token_budget": ("warn", "{category}: {tokens} tokens of at most {max_tokens}"),
    "topic_generation_start": ("info", "{category}: asking for {count} topics"),
    "topics_exhausted_regenerating": ("info", "{category}: no topics left, asking for {needed} more"),
    "topics_generation_failed": ("error", "{category}: no new topics came, the category ends"),
    "generation_failed_retrying": ("warn", "{category}: {topic} left out ({attempt} of {max_attempts})"),
    "judge_no_score_retry": ("warn", "No score for {topic}, call {attempt} of {max_retries}"),
    "judge_failed_all_retries": ("error", "No call gave a score for {topic}"),
    "judge_rejected_below_threshold": ("warn", "{topic} rejected: {score} is under {threshold}"),
    "category_attempt_limit_reached": ("error", "{category}: all attempts made, {completed} of {target}"),
    "example_accepted": ("info", "{category}: accepted with {score}"),
    "example_accepted_no_judge": ("info", "{category}: accepted"),
    "job_completed": ("info", "Run finished with {completed} examples"),
    "job_resumed": ("info", "Run goes on from {completed} of {target}"),
    "merge_started": ("info", "Merge of {source_count} jobs, {total} examples"),
    "merge_copy_batch": ("info", "{done} of {total} examples copied"),
    "merge_export_start": ("info", "Lines are written"),
    "merge_stats_start": ("info", "Statistics are taken"),
    "merge_completed": ("info", "Merge finished with {total} examples"),
    "merge_failed": ("error", "Merge failed: {error}"),
    "merge_shuffle_skipped_large": ("warn", "Not shuffled: {total} is over {threshold}"),
    "merge_strip_extra_keys": ("warn", "{rows_affected} rows lost keys that do not belong to them"),
    "provider_unreachable": ("warn", "{provider} cannot be reached ({status_code})"),
    "provider_response_invalid": ("warn", "{provider} answers in a wrong form"),
    "reasoning_started": ("info", "Reasoning for {total} examples, as {format}"),
    "reasoning_copy_batch": ("info", "{done} of {total} examples copied for reasoning"),
    "reasoning_category_start": ("info", "{category}: reasoning for {count} examples"),
    "reasoning_api_error": ("warn", "{category}: reasoning call failed (attempt {attempt})"),
    "reasoning_invalid_prose": ("warn", "{category}: reasoning refused for {reason} (attempt {attempt})"),
    "reasoning_skipped": ("warn", "{category}: one example stays without reasoning"),
    "reasoning_export_start": ("info", "Lines with reasoning are written"),
    "reasoning_stats_start": ("info", "Statistics with reasoning are taken"),
    "reasoning_completed": ("info", "Reasoning finished for {total} examples, {skipped} left out"),
    "reasoning_failed": ("error", "Reasoning failed: {error}"),
    "reasoning_resumed": ("info", "Reasoning goes on, {copied} of {target} copied"),
}


def sequenced(log: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events with `seq` from 1 within their job."""
    return numbered_within(log, job, list(order), "seq").withColumn("seq", F.col("seq").cast("int"))


def tail(log: DataFrame, n: int = RING, job: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last n events of every job, with the sequence numbers of the whole log.

    The newest n are found by a limited rank, so that no task sorts a whole job; the numbers follow from the jobs' counts.
    """
    newest = W.partitionBy(job).orderBy(*[F.desc(c) for c in order])
    last = log.withColumn("__place", F.row_number().over(newest)).where(F.col("__place") <= n)
    counts = log.groupBy(F.col(job).alias("__job")).agg(F.count("*").alias("__n"))
    both = last.join(counts, F.col(job).eqNullSafe(F.col("__job")))
    return both.withColumn("seq", (F.col("__n") - F.col("__place") + 1).cast("int")).drop("__place", "__n", "__job")


def after(log: DataFrame, cursor: int) -> DataFrame:
    return log.where(F.col("seq") > cursor)


def latest(rows: DataFrame, n: int = 5, job: str = "job_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The newest n rows of every job."""
    newest = W.partitionBy(job).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def progress_feed(jobs: DataFrame, examples: DataFrame, log: DataFrame, newest: int = 5, n_events: int = RING) -> DataFrame:
    """What a job's page shows: (id, event, status, examples, events): done or progress, the newest examples' ids, the last events' kinds.

    jobs: (id, status); examples: (id, job_id, created_at); log: (job_id, event_id, ts, kind). Jobs without either have empty lists.
    """
    rows = latest(examples, newest).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("examples"))
    said = tail(log, n_events).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]).alias("events"))
    both = jobs.join(rows.withColumnRenamed("job_id", "id"), "id", "left").join(said.withColumnRenamed("job_id", "id"), "id", "left")
    ids = rows.schema["examples"].dataType.simpleString()
    return both.select(
        "id", F.when(F.col("status").isin(*TERMINAL), "done").otherwise("progress").alias("event"), "status",
        F.coalesce("examples", F.expr(f"cast(array() as {ids})")).alias("examples"), F.coalesce("events", F.expr("cast(array() as array<string>)")).alias("events"),
    )


def level_of(kind: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for name, (level, _) in TEMPLATES.items() for x in (name, level)])
    return F.coalesce(levels[kind], F.lit("warn"))


def message_of(kind: Column, meta: Column) -> Column:
    """The kind's template with the values of `meta` (map of strings).

    An unknown kind, and one whose template names what meta has not, is shown as the kind and all of meta.
    """
    entries = F.transform(F.map_entries(meta), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), F.coalesce(F.concat(F.lit("'"), e["value"], F.lit("'")), F.lit("None"))))
    plain = F.concat(kind, F.lit(" {"), F.coalesce(F.array_join(entries, ", "), F.lit("")), F.lit("}"))
    out = None
    for name, (_, template) in TEMPLATES.items():
        parts = [F.lit(x) if i % 2 == 0 else F.try_element_at(meta, F.lit(x)) for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
        filled = F.concat(*parts)  # null if a part is missing
        out = F.when(kind == name, filled) if out is None else out.when(kind == name, filled)
    return F.coalesce(out, plain)
