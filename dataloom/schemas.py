"""Formats, statuses and schemas of conversational fine-tuning datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TurnFormat:
    """A format whose content is one list of turns."""

    turns: str
    role: str
    text: str
    roles: tuple[str, str]


#: Key names and roles of the three content formats.
ALPACA_KEYS, ALPACA_REQUIRED = ("instruction", "input", "output"), ("instruction", "output")
TURN_FORMATS = {
    "sharegpt": TurnFormat("conversations", "from", "value", ("human", "gpt")),
    "chatml": TurnFormat("messages", "role", "content", ("user", "assistant")),
}
FORMATS = ("alpaca", *TURN_FORMATS)

#: Job states.
STATUSES = ("pending", "running", "cancelling", "completed", "failed", "cancelled", "interrupted")
ACTIVE = ("pending", "running", "cancelling")
RESUMABLE = ("interrupted", "cancelled", "failed")
TERMINAL = ("completed", "failed", "cancelled", "interrupted")
#: An interrupted job may go on, so its report has no end.
ENDED = ("completed", "failed", "cancelled")

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))

EXAMPLES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("job_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("content_json", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("tokens", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("judge_score", T.IntegerType()),
        T.StructField("prompt_tokens", T.IntegerType()),
        T.StructField("completion_tokens", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("judge_prompt_tokens", T.IntegerType()),
        T.StructField("judge_completion_tokens", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("reasoning_model_used", T.StringType()),
    ]
)
JOBS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("config_json", T.StringType()),
        T.StructField("progress_json", T.StringType()),
        T.StructField("reasoning_format", T.StringType()),
        T.StructField("parent_job_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("job_id", T.StringType(), False),
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class CategoryConfig:
    name: str
    description: str
    proportion: float
    model: str | None = None
    provider_id: str | None = None
    judge_model: str | None = None
    judge_provider_id: str | None = None

    def __post_init__(self):
        if not 1 <= len(self.name) <= 100 or not 10 <= len(self.description.strip()) <= 1000 or not 0 < self.proportion <= 1:
            raise ValueError(f"category {self.name!r}")


@dataclass(frozen=True)
class JobConfig:
    """A job's request; bounds and cross-field rules are checked when it is made."""

    categories: tuple[CategoryConfig, ...]
    total_examples: int
    format: str
    max_tokens: int = 2048
    temperature: float = 0.7
    judge_threshold: int = 80
    conversation_turns: int = 1
    judge_enabled: bool = True
    merged_from: tuple[str, ...] = ()

    def __post_init__(self):
        if not 1 <= len(self.categories) <= 64:
            raise ValueError("1 to 64 categories")
        if abs(sum(c.proportion for c in self.categories) - 1) > 0.01:
            raise ValueError("proportions sum to 1 within 0.01")
        bounds = (("total_examples", 10, 500_000), ("max_tokens", 512, 8192), ("temperature", 0, 1.5), ("judge_threshold", 0, 100), ("conversation_turns", 1, 5))
        for name, low, high in bounds:
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} is from {low} to {high}")
        if self.format not in FORMATS:
            raise ValueError(f"format {self.format!r}")
        if self.format == "alpaca" and self.conversation_turns != 1:
            object.__setattr__(self, "conversation_turns", 1)


@dataclass(frozen=True)
class Caps:
    """Sizes beyond which a request is refused; None is no cap, which is how the engine runs unless it is told otherwise."""

    job: int | None = None
    merge: int | None = None
    dedup: int | None = None

    def check(self, kind: str, n: int) -> None:
        cap = getattr(self, kind)
        if cap is not None and n > cap:
            raise ValueError(f"{kind}: {n} is over the cap of {cap}")


#: The caps of an interactive service.
SERVICE_CAPS = Caps(job=10_000, merge=500_000, dedup=100_000)
