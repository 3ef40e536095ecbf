"""Model calls as operators over request tables, with an injected client.

A client is any picklable object with `chat(requests) -> answers` and `embed(texts) -> vectors`, both over lists; it is
made once per task by a factory. The defaults are pure functions of their input, so that every pipeline runs
offline and a lost executor's work comes out the same again.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataloom.functions import codec
from dataloom.functions.text import net_completion_tokens, salvage_json, valid_score, without_thinking
from dataloom.session import checkpointed


class ModelClient(Protocol):
    def chat(self, requests: list[dict]) -> list[dict]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class StubClient:
    """Deterministic answers: a chatml example, a score, or numbered lines, by the request's `purpose`."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def chat(self, requests: list[dict]) -> list[dict]:
        out = []
        for r in requests:
            digest = hashlib.sha256(f"{r['purpose']}|{r['prompt']}|{r['attempt']}".encode()).digest()
            if r["purpose"] == "judge":
                content = json.dumps({"score": 50 + digest[0] % 51})
            elif r["purpose"] == "topics":
                content = json.dumps([f"{r['prompt'][:20]} topic {i}" for i in range(1, 1 + digest[0] % 8)])
            elif r["purpose"] == "outline":
                content = json.dumps([f"point {digest[i]}" for i in range(digest[0] % 6)])
            elif r["purpose"] == "reasoning":
                content = "=== TURN 1 ===\n" + " ".join(f"step{digest[i]}" for i in range(24))
            else:
                turns = [{"role": "user", "content": f"About {r['prompt']}?"}, {"role": "assistant", "content": f"Answer {digest[:4].hex()}."}]
                content = "Here:\n```json\n" + json.dumps({"messages": turns if digest[1] % 8 else turns[:1]}, ensure_ascii=False) + "\n```"
            out.append({"content": content, "prompt_tokens": len(r["prompt"]) // 4 + 1, "completion_tokens": len(content) // 4 + 1, "reasoning_tokens": 0, "error": None})
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [hashing_embedding(t, self.dim) for t in texts]


def hashing_embedding(text: str, dim: int = 32) -> list[float]:
    """Signed counts of hashed words, of unit length."""
    v = [0.0] * dim
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


#: Statuses of a failed call after which it is made again.
RETRIED = (429, 500, 502, 503, 504)


def _answer(client: ModelClient, request: dict, retries: int, wait_s: float) -> dict:
    """One call, made again while it fails with a status of `RETRIED`; what fails at last is an error."""
    for n in range(retries + 1):
        try:
            return client.chat([request])[0]
        except Exception as problem:  # the answer of a failed call is its error
            if n == retries or getattr(problem, "status", None) not in RETRIED:
                return {"content": None, "prompt_tokens": 0, "completion_tokens": 0, "reasoning_tokens": 0, "error": str(problem) or type(problem).__name__}
            time.sleep(wait_s * 2**n)
    raise AssertionError


def chat(
    requests: DataFrame, factory: Callable[[], ModelClient] = StubClient, parallel: int | None = None, batch: int = 50, retries: int = 3, wait_s: float = 1.0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Answers (id, attempt, content, prompt_tokens, completion_tokens, error, starved) of requests (id, purpose, prompt, attempt, and max_tokens
    where there is a limit).

    An answer is starved if it ran into its limit (`finish` is 'length') having thought (`thought`) and said nothing, and its client does not tell
    how many tokens the thinking took; what a client does not say of these is no starvation. The columns `keep` of the requests stay beside their
    answers.

    At most `parallel` calls are open at once, one per partition. Completion tokens are net of reasoning. Where a batch
    fails its requests are made one by one, again after a passing failure; a call that fails for good becomes a row with
    an error, no content and no usage, and takes no other with it. A null prompt is not sent and is an error.
    """
    limit = F.col("max_tokens").cast("int") if "max_tokens" in requests.columns else F.lit(None).cast("int")
    rows = requests.select(F.col("id").cast("string").alias("id"), "purpose", "prompt", F.col("attempt").cast("int").alias("attempt"), limit.alias("max_tokens"), *keep)
    kept = "".join(f", `{c}` {requests.schema[c].dataType.simpleString()}" for c in keep)
    if parallel:
        rows = rows.repartition(parallel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                few = part.slice(at, batch)
                answers = _answered(client, few.select(_ASKED).to_pylist(), retries, wait_s)
                yield pa.RecordBatch.from_arrays([*answers.columns, *[few.column(c) for c in keep]], [*_NAMES, *keep])

    return _told(rows.mapInArrow(run, _ANSWERS + kept))


_ASKED = ["id", "purpose", "prompt", "attempt", "max_tokens"]


_ANSWERS = "id string, attempt int, content string, prompt_tokens long, completion_tokens long, reasoning_tokens long, error string, finish string, thought boolean"
_NAMES = [c.split()[0] for c in _ANSWERS.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
_NOTHING = {"content": None, "prompt_tokens": 0, "completion_tokens": 0, "reasoning_tokens": 0, "error": "no prompt"}


def _answered(client: ModelClient, asked: list[dict], retries: int, wait_s: float) -> pa.RecordBatch:
    """The answers of one batch of requests, in their order."""
    sent = [r for r in asked if r["prompt"] is not None]
    try:
        answers = client.chat(sent) if sent else []
    except Exception:
        answers = [_answer(client, r, retries, wait_s) for r in sent]
    answers = iter(answers)
    rows = [{**(_NOTHING if r["prompt"] is None else next(answers)), "id": r["id"], "attempt": r["attempt"]} for r in asked]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES)], _NAMES)


def _told(answers: DataFrame) -> DataFrame:
    """Answers with net usage, and whether they starved."""
    silent = F.trim(F.coalesce(without_thinking(F.col("content")), F.lit(""))) == ""
    starved = silent & (F.col("finish") == "length") & F.col("thought") & (F.coalesce("reasoning_tokens", F.lit(0)) == 0)
    net = net_completion_tokens(F.col("completion_tokens"), F.col("reasoning_tokens"))
    return answers.withColumn("starved", F.coalesce(starved, F.lit(False))).withColumn("completion_tokens", net).drop("reasoning_tokens", "finish", "thought")


class Pace:
    """A token bucket: calls go out at `per_second` on the average, `burst` of them at once."""

    def __init__(self, per_second: float | None, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.per_second, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.held, self.at = float(burst), clock()

    def take(self) -> None:
        if not self.per_second:
            return
        now = self.clock()
        self.held, self.at = min(self.burst, self.held + (now - self.at) * self.per_second), now
        if self.held < 1:
            self.sleep((1 - self.held) / self.per_second)
            self.held, self.at = 1.0, self.clock()
        self.held -= 1


@dataclass(frozen=True)
class Limit:
    """What a provider bears: calls open at once, and calls a second."""

    open_calls: int = 1
    per_second: float | None = None


def chat_within_limits(requests: DataFrame, limits: dict[str, Limit], factory: Callable[[], ModelClient] = StubClient, retries: int = 3, wait_s: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """As `chat`, of requests with a column `provider`, of which no more calls are open at once than its limit says.

    Each provider has as many partitions as calls it bears (one, where nothing is said: all such providers share one), its requests are dealt to
    them by hash, and a partition makes one call after another, at its part of the provider's pace. Partitions
    are read as streams, so a provider of any number of requests fills no memory. A task that Spark runs twice at once, as in
    speculation, would make two calls: leave that off for such a job.
    """
    names = sorted(limits)
    starts = {n: 1 + sum(limits[m].open_calls for m in names[:i]) for i, n in enumerate(names)}  # partition 0 is for the others
    place = F.lit(0)
    for n in names:
        place = F.when(F.col("__provider") == n, F.lit(starts[n]) + F.pmod(F.xxhash64(F.col("id").cast("string"), "prompt"), F.lit(limits[n].open_calls)).cast("int")).otherwise(place)
    limit = F.col("max_tokens").cast("int") if "max_tokens" in requests.columns else F.lit(None).cast("int")
    rows = requests.select(F.col("id").cast("string").alias("id"), "purpose", "prompt", F.col("attempt").cast("int").alias("attempt"), limit.alias("max_tokens"), F.col("provider").alias("__provider"), *keep)
    kept = "".join(f", `{c}` {requests.schema[c].dataType.simpleString()}" for c in keep)
    dealt = rows.withColumn("__place", F.coalesce(place, F.lit(0))).repartitionById(1 + sum(x.open_calls for x in limits.values()), "__place").drop("__place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, paces = factory(), {n: Pace(x.per_second / x.open_calls if x.per_second else None) for n, x in limits.items()}
        for part in batches:
            for i, (request, provider) in enumerate(zip(part.select(_ASKED).to_pylist(), part.column("__provider").to_pylist())):
                if provider in paces and request["prompt"] is not None:
                    paces[provider].take()
                answers = _answered(client, [request | {"provider": provider}], retries, wait_s)
                yield pa.RecordBatch.from_arrays([*answers.columns, *[part.column(c).slice(i, 1) for c in keep]], [*_NAMES, *keep])

    return _told(dealt.mapInArrow(run, _ANSWERS + kept))


def _vectors(client: ModelClient, texts: list[str]) -> list[list[float] | None]:
    """One vector per text, in their order.

    Answers may be vectors, or {"index", "embedding"} in any order. Where a batch fails, or answers are missing, it is asked for in
    halves, down to single texts; a text that fails on its own has no vector.
    """
    try:
        answers = client.embed(texts)
        if answers and isinstance(answers[0], dict):
            by_index = {a["index"]: a["embedding"] for a in answers}
            answers = [by_index[i] for i in range(len(texts))]
        if len(answers) == len(texts):
            return answers
    except Exception:  # the halves tell which text it was
        pass
    if len(texts) == 1:
        return [None]
    half = len(texts) // 2
    return _vectors(client, texts[:half]) + _vectors(client, texts[half:])


def embed(rows: DataFrame, text: str = "text", factory: Callable[[], ModelClient] = StubClient, batch: int = 100) -> DataFrame:
    """Rows with `embedding`, null where a text could not be embedded; texts go out in batches."""
    at_text = rows.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                few = part.slice(at, batch)
                vectors = _vectors(client, [t or "" for t in few.column(at_text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array(vectors, pa.list_(pa.float32()))], [*few.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)


class Readers:
    """What is read from answers, as columns over them; built once for a run of many calls, as they are large."""

    def __init__(self, fmt: str, expected_turns: int | None = None):
        self.json = salvage_json(without_thinking(F.col("content")))
        turns = None if expected_turns is None else F.lit(expected_turns)
        verdict = F.coalesce(codec.validation_reason(F.col("content_json"), F.lit(fmt), turns), F.lit("not_dict"))
        self.reason = F.when(F.col("error").isNotNull(), "call_failed").otherwise(verdict)
        self.score = json_score(self.json)
        self.points = outline_points(self.json)


def parsed_examples(answers: DataFrame, fmt: str, expected_turns: int | None = None, read: Readers | None = None) -> DataFrame:
    """Answers with the JSON salvaged from them and its verdict."""
    read = read or Readers(fmt, expected_turns)
    # salvaged once, in a projection of its own: the verdict reads it many times
    return checkpointed(answers.withColumn("content_json", read.json)).withColumn("reason", read.reason)


def json_score(answer: Column) -> Column:
    """The score of a judge's JSON: a number (a boolean counts as 1 or 0) from 0 to 100; text and the like are null."""
    json = F.try_parse_json(answer)
    kind = F.schema_of_variant(F.try_variant_get(json, "$.score", "variant"))
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(json, "$.score", "double"))
    return valid_score(number.when(kind == "BOOLEAN", F.try_variant_get(json, "$.score", "boolean").cast("double")))


def scores(answers: DataFrame, read: Readers | None = None) -> DataFrame:
    """Answers of judge calls with their score; no number from 0 to 100 is null."""
    return answers.withColumn("score", json_score(salvage_json(without_thinking(F.col("content")))) if read is None else read.score)


def topic_prompt(category, description, count) -> Column:
    return F.format_string("List %d distinct topics for the category %s (%s) as a JSON array of strings.", count, category, description)


#: Points of an outline that count.
OUTLINE_POINTS = 4


def outline_prompt(category, topic) -> Column:
    return F.format_string("List up to four points, as a JSON array of strings, that an example of the category %s covers on: %s", category, topic)


def outline_points(json: Column) -> Column:
    """The first points that an outline's JSON lists; none if it is no list."""
    listed = F.from_json(json, "array<string>")
    return F.coalesce(F.slice(listed, 1, OUTLINE_POINTS), F.expr("cast(array() as array<string>)"))


def example_prompt(topic, fmt, turns, max_tokens, points: Column | None = None) -> Column:
    """Our wording; the length asked for is seven tenths of the limit."""
    cover = F.lit("") if points is None else F.when(F.size(points) > 0, F.concat(F.lit(" Cover: "), F.array_join(points, "; "), F.lit("."))).otherwise("")
    return F.format_string("Write one %s training example of %d exchanges on: %s.%s Use at most %d tokens. Answer with JSON only.", fmt, turns, topic, cover, F.floor(max_tokens * 0.7).cast("int"))


def judge_prompt(content) -> Column:
    return F.concat(F.lit("Score this training example from 0 to 100. Answer as {\"score\": n}.\n\n"), content)


def reasoning_prompt(text, turns) -> Column:
    return F.concat(F.format_string("For each of the %d assistant turns write the thinking that leads to it, under headers === TURN n ===.\n\n", turns), text)
