"""Column functions over text: previews, cleaning of model output, token counts, reasoning prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s+|\s+$"
_FENCE = r"(?is)```(?:json)?\s*\n?(.*?)```"
_TURN_HEADER = r"(?im)^[ \t]*===[ \t]*turn[ \t]+(\d+)[ \t]*===[ \t]*$"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (SQL's trim takes spaces only)."""
    return F.regexp_replace(text, _EDGES, "")


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")


def preview(text: Column, length: int = 120) -> Column:
    """The first code points, and an ellipsis if there are more."""
    return F.concat(F.substring(text, 1, length), F.when(F.length(text) > length, F.lit("…")).otherwise(F.lit("")))


def without_thinking(text: Column) -> Column:
    """Model output without its think blocks, trimmed; an unterminated block stays."""
    return strip(F.regexp_replace(text, r"(?i)<think>[\s\S]*?</think>", ""))


def salvage_json(text: Column) -> Column:
    """The first of these that is JSON: the text, its first fenced block, its outermost braces, its outermost brackets."""
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    fenced = F.regexp_extract(text, _FENCE, 1)

    def parsed(part: Column) -> Column:
        return F.when(part != "", F.when(F.try_parse_json(part).isNotNull(), part))

    return F.coalesce(parsed(strip(text)), parsed(strip(fenced)), parsed(braces), parsed(brackets))


def net_completion_tokens(completion: Column, reasoning: Column) -> Column:
    """Completion tokens less reasoning tokens, not below zero; missing usage counts as none."""
    zero = F.lit(0)
    return F.greatest(F.coalesce(completion, zero) - F.coalesce(reasoning, zero), zero)


def token_estimate(text: Column) -> Column:
    """Tokens by a documented pre-token rule: runs of letters, of digits, and single other characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]")), F.lit(0)).cast("long")


def recounted_tokens(raw: Column, usage: Column, has_reasoning: Column) -> Column:
    """Tokens of what is left of an answer where thinking was in it or beside it; else the reported usage."""
    return F.when(raw.rlike(r"(?i)<think>"), token_estimate(without_thinking(raw))).when(has_reasoning & ~is_blank(raw), token_estimate(raw)).otherwise(usage)


def effective_limit(n: Column) -> Column:
    """Nine tenths of a token limit, rounded down."""
    return F.floor(n * 0.9).cast("long")


def fits_limit(tokens: Column, limit: Column) -> Column:
    return tokens <= effective_limit(limit)


def valid_score(score: Column) -> Column:
    """A judge's number from 0 to 100, as an integer; anything else is null."""
    return F.when(score.between(0, 100), F.floor(score).cast("int"))


def prose_problem(text: Column, tokens: Column | None = None) -> Column:
    """Why a rationale is unusable, null if it is fine."""
    n, body = token_estimate(text) if tokens is None else tokens, strip(text)
    return (
        F.when(text.isNull() | is_blank(text), "empty")
        .when(body.contains("```"), "code_fence")
        .when(body.startswith("{") | body.startswith("["), "structured")
        .when(n < 20, "too_short")
        .when(n > 400, "too_long")
    )


def turn_sections(text: Column) -> Column:
    """Array of (number, body) of the sections under turn headers; text before the first header is dropped."""
    numbers = F.regexp_extract_all(text, F.lit(_TURN_HEADER), F.lit(1))
    bodies = F.slice(F.split(text, _TURN_HEADER), 2, 1_000_000)
    return F.arrays_zip(
        F.transform(numbers, lambda x: F.expr("1") * x.cast("int")).alias("number"), F.transform(bodies, strip).alias("body")
    )


def rationales(text: Column, n: Column) -> Column:
    """The n rationales of a model's answer, or null: sections headed 1 to n in order, else exactly n paragraphs."""
    clean = without_thinking(text)
    sections = turn_sections(clean)
    numbers = F.transform(sections, lambda s: s["number"])
    headed = F.when((F.size(sections) == n) & (numbers == F.sequence(F.lit(1), n)), F.transform(sections, lambda s: s["body"]))
    paragraphs = F.filter(F.transform(F.split(clean, r"\n\s*\n"), strip), lambda p: p != "")
    found = F.when(F.size(sections) > 0, headed).otherwise(F.when(F.size(paragraphs) == n, paragraphs))
    return F.when(n > 0, F.when(F.forall(found, lambda p: prose_problem(p).isNull()), found))


def reasoning_budget(max_tokens: Column, turns: Column) -> Column:
    return F.greatest(max_tokens, F.floor(max_tokens * turns / 2).cast("long") + 256)


def code_segments(text: Column) -> Column:
    """Array of (kind, language, body): plain text and fenced code by turns."""
    return F.transform(
        F.split(text, "```"),
        lambda part, i: F.when(
            i % 2 == 1,
            F.struct(F.lit("code").alias("kind"), F.substring_index(part, "\n", 1).alias("language"), F.regexp_replace(part, r"^[^\n]*\n?", "").alias("body")),
        ).otherwise(F.struct(F.lit("text").alias("kind"), F.lit("").alias("language"), part.alias("body"))),
    )


def topic_list(topics: Column, count: Column, fallback: Column) -> Column:
    """Exactly `count` topics: cut, or filled up with numbered ones."""
    kept = F.slice(topics, F.lit(1), count)
    missing = F.greatest(count - F.size(topics), F.lit(0))
    more = F.transform(F.sequence(F.lit(1), F.greatest(missing, F.lit(1))), lambda i: F.concat(fallback, F.lit(" "), (i + F.size(topics)).cast("string")))
    return F.when(missing > 0, F.concat(kept, more)).otherwise(kept)


def brevity_hint(limit: int) -> str:
    """What is added to a prompt whose answer was no use, or too long."""
    return f"\n\nKeep the answer within {limit} tokens."


def with_brevity_hint(messages: Column, limit: int) -> Column:
    """The last user message asks for at most so many tokens; messages are structs of role and text."""
    hint = brevity_hint(limit)
    last = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i).otherwise(-1)))
    return F.transform(messages, lambda m, i: F.when(i == last, F.struct(m["role"].alias("role"), F.concat(m["text"], F.lit(hint)).alias("text"))).otherwise(m))


def model_prefix(model: Column, separator: str = "/") -> Column:
    """What stands before the first separator of a model's id: its vendor; the whole id where there is none."""
    return F.split_part(model, F.lit(separator), F.lit(1))
