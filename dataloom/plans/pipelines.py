"""Composed runs: generation, merge, near-duplicate report, reasoning enrichment."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataloom.functions import codec
from dataloom.functions.text import brevity_hint, rationales, salvage_json, topic_list, without_thinking
from dataloom.operators import curate, dedup, merge
from dataloom.plans import models
from dataloom.plans.cancellation import Cancellation
from dataloom.plans.models import StubClient
from dataloom.schemas import Caps
from dataloom.session import checkpointed
from dataloom.sources.versions import VersionedTable


def generate(
    topics: DataFrame, fmt: str, threshold: int, factory: Callable = StubClient, attempts: int = 2, judge_calls: int = 3, budget: int = 5,
    max_tokens: int = 2048, thinking: int = 1, log: VersionedTable | None = None, cancel: Cancellation | None = None,
) -> DataFrame:
    """Attempt log of the rows (category, attempt, topic, target) that a run makes, with what the calls used.

    Each topic gets an outline and is asked for up to `attempts` times until an answer is valid and within `max_tokens`, then judged up to
    `judge_calls` times until it is accepted; a category ends with `target` accepted or `budget` times as many topics
    tried. `thinking` times `max_tokens` is what a call may use; where an answer starved (all of it went into
    thinking) the next try may use twice as much, else it is asked for in fewer words.

    Runs in rounds: each takes, in order, as many further topics of a category as it still lacks, so that no call is made
    that one topic after another would not make. Within a round only what failed is asked again. Answers are
    checkpointed: a lost executor asks nobody twice for what has been answered. With a `log` every round is a version of that table,
    published when it is whole; a run that finds rounds there goes on from them. `cancel` stops it between rounds, or
    in the middle of one, of which nothing is published.
    """
    # a limited rank: no task gets more of a category than its budget from each part of the table
    most = budget * (topics.agg(F.max("target")).first()[0] or 0)
    place = F.row_number().over(W.partitionBy("category").orderBy("attempt"))
    rows = topics.withColumn("id", F.concat_ws("/", "category", F.col("attempt").cast("string"))).withColumn("__n", place)
    rows = checkpointed(rows.where(F.col("__n") <= most).where(F.col("__n") <= budget * F.col("target")))
    options = dict(fmt=fmt, threshold=threshold, factory=factory, attempts=attempts, judge_calls=judge_calls, max_tokens=max_tokens, thinking=thinking, read=models.Readers(fmt))
    done = None if log is None or not log.versions() else log.read()
    with cancel.running() if cancel is not None else nullcontext():
        while True:
            if cancel is not None:
                cancel.check()
            made = rows.select("category").distinct().withColumns({"__made": F.lit(0), "__accepted": F.lit(0)})
            if done is not None:
                made = done.groupBy("category").agg(F.count("*").alias("__made"), F.count_if("accepted").alias("__accepted"))
                made = rows.select("category").distinct().join(made, "category", "left").na.fill(0, ["__made", "__accepted"])
            due = rows.join(made, "category").where((F.col("__n") > F.col("__made")) & (F.col("__n") <= F.col("__made") + F.col("target") - F.col("__accepted")))
            due = checkpointed(due.drop("__made", "__accepted", "__n"))
            if due.isEmpty():
                return _round(due, **options) if done is None else done
            fresh = _round(due, **options)
            if log is None:
                done = checkpointed(fresh if done is None else done.union(fresh))
            else:
                log.append(fresh, f"round {len(log.snapshot().batches) + 1}")
                done = log.read()


def _tokens() -> Column:
    return F.struct("prompt_tokens", "completion_tokens")


def _round(due: DataFrame, fmt: str, threshold: int, factory: Callable, attempts: int, judge_calls: int, max_tokens: int, thinking: int, read: models.Readers) -> DataFrame:
    """Outcome of one try of each topic. What a row has got so far stays beside its calls, so that nothing is joined."""
    ask = lambda purpose, prompt, n: (F.lit(purpose).alias("purpose"), prompt.alias("prompt"), F.lit(n).alias("attempt"))
    row = F.struct(*due.columns).alias("row")
    outlines = models.chat(due.select("id", row, *ask("outline", models.outline_prompt(F.col("category"), F.col("topic")), 1)), factory, keep=("row",))
    prompt = models.example_prompt(F.col("row.topic"), F.lit(fmt), F.lit(1), F.lit(max_tokens), read.points)
    open_ = outlines.select("id", "row", _tokens().alias("outline"), prompt.alias("said"), F.lit(max_tokens * thinking).alias("limit"))
    valid, failed = None, None
    good = (F.col("reason") == "ok") & (F.col("completion_tokens") <= max_tokens)
    for attempt in range(1, attempts + 1):
        asked = open_.select("*", *ask("example", F.col("said"), attempt), F.col("limit").alias("max_tokens"))
        parsed = models.parsed_examples(models.chat(asked, factory, keep=("row", "outline", "said", "limit")), fmt, read=read)
        hit = parsed.where(good).select("id", "row", "outline", _tokens().alias("used"), "content_json")  # over checkpointed answers
        valid, failed = hit if valid is None else valid.union(hit), parsed.where(~good).select("id", "row", "outline", _tokens().alias("used"), F.lit(None).cast("string").alias("content_json"))
        fewer = brevity_hint(int(max_tokens * 0.8)) if attempt == 1 else ""
        again = F.when(F.col("starved"), F.col("said")).otherwise(F.concat("said", F.lit(fewer))), F.when(F.col("starved"), F.col("limit") * 2).otherwise(F.col("limit"))
        open_ = parsed.where(~good).select("id", "row", "outline", again[0].alias("said"), again[1].alias("limit"))
    none = F.lit(None).cast("int")
    nothing = F.struct(F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
    # (id, row, outline, used, content_json, judged: tokens of its calls, score, accepted)
    log = failed.select("*", nothing.alias("judged"), none.alias("score"), F.lit(False).alias("accepted"))
    open_ = valid.select("*", nothing.alias("judged"), none.alias("score"))
    for call in range(1, judge_calls + 1):
        known = F.struct("row", "outline", "used", "content_json", "judged", "score").alias("known")
        asked = open_.select("id", known, *ask("judge", models.judge_prompt(F.col("content_json")), call))
        found = checkpointed(models.scores(models.chat(asked, factory, keep=("known",)), read))
        more = F.struct(*[(F.col(f"known.judged.{c}") + F.col(c)).alias(c) for c in ("prompt_tokens", "completion_tokens")])
        rest = found.select(
            "id", *[F.col(f"known.{c}").alias(c) for c in ("row", "outline", "used", "content_json")], more.alias("judged"), F.coalesce("score", "known.score").alias("score"),
            F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("accepted"),
        )
        log = log.union(rest.where("accepted") if call < judge_calls else rest)
        open_ = rest.where("not accepted").drop("accepted")
    usage = [F.col(f"{of}.{c}").alias(f"{name}{c}") for of, name in (("used", ""), ("judged", "judge_"), ("outline", "outline_")) for c in ("prompt_tokens", "completion_tokens")]
    return log.select("row.*", "content_json", "score", "accepted", *usage)


def topics(categories: DataFrame, factory: Callable = StubClient, usage: bool = False) -> DataFrame:
    """Topics (category, topics, and the call's tokens) of rows (category, description, count): what the model lists, cut or filled up to the count."""
    prompt = models.topic_prompt(F.col("category"), F.col("description"), F.col("count"))
    asked = categories.select(F.col("category").alias("id"), F.lit("topics").alias("purpose"), prompt.alias("prompt"), F.lit(1).alias("attempt"))
    answers = models.chat(asked, factory).select(F.col("id").alias("category"), F.from_json(salvage_json(without_thinking(F.col("content"))), "array<string>").alias("listed"), "prompt_tokens", "completion_tokens")
    listed = F.filter(F.coalesce("listed", F.expr("cast(array() as array<string>)")), lambda t: t.isNotNull() & (F.trim(t) != ""))
    tokens = ["prompt_tokens", "completion_tokens"] if usage else []
    return categories.join(answers, "category").select("category", topic_list(listed, F.col("count"), F.concat("category", F.lit(" topic"))).alias("topics"), *tokens)


def merge_jobs(jobs: DataFrame, examples: DataFrame, source_ids: list[str], job_id: str, shuffle_seed: int | None = None, caps: Caps = Caps()) -> DataFrame:
    merge.check_sources(jobs, source_ids, examples, caps.merge)
    return merge.merged(examples, source_ids, job_id, shuffle_seed)


def near_duplicates(examples: DataFrame, threshold: float, factory: Callable = StubClient, caps: Caps = Caps()) -> DataFrame:
    """Report of examples (id, content_json, format, judge_score) alike by the embedding of their text."""
    if caps.dedup is not None:
        caps.check("dedup", examples.count())
    texts = examples.withColumn("text", codec.embedding_text(codec.decode_turns(F.col("content_json"), F.col("format")), F.col("format")))
    vectors = models.embed(texts.select("id", "text"), factory=factory)
    return dedup.pair_report(dedup.similar_pairs(vectors, threshold), texts)


def enrich(examples: DataFrame, done: DataFrame, factory: Callable = StubClient) -> DataFrame:
    """Rationales (id, reasoning as a JSON array or null) of the examples that are not in `done` yet."""
    todo = curate.unfinished(examples, done)
    turns = codec.decode_turns(F.col("content_json"), F.col("format"))
    n = codec.assistant_turns(turns)
    asked = todo.select("id", F.lit("reasoning").alias("purpose"), models.reasoning_prompt(codec.labelled_text(turns), n).alias("prompt"), F.lit(1).alias("attempt"))
    answers = models.chat(asked, factory).join(todo.select("id", n.alias("n")), "id")
    return answers.select("id", F.to_json(rationales(F.col("content"), F.col("n"))).alias("reasoning"))
