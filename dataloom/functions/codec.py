"""Structural validation, pruning and serialisation of example content in its three formats.

Content is untrusted JSON text. It is parsed once to a variant; checks run in a fixed order and the first failure
is the verdict. Duplicate keys and NaN are no JSON here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataloom.functions.text import is_blank, strip
from dataloom.schemas import ALPACA_KEYS, ALPACA_REQUIRED, TURN_FORMATS, TurnFormat


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _text(value: Column) -> Column:
    return F.when(_is_text(value), value.cast("string"))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _keys(value: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))


def _alpaca_problem(value: Column, keys: Column) -> Column:
    instruction, given, output = (_field(value, k) for k in ALPACA_KEYS)
    has_input = F.array_contains(keys, "input")
    return (
        F.when(F.size(F.array_except(keys, _strings(ALPACA_KEYS))) > 0, "extra_top_keys")
        .when(F.size(F.array_except(_strings(ALPACA_REQUIRED), keys)) > 0, "missing_required")
        .when(~_is_text(instruction), "wrong_type")
        .when(is_blank(_text(instruction)), "empty_value")
        .when(~_is_text(output), "wrong_type")
        .when(is_blank(_text(output)), "empty_value")
        .when(has_input & ~_is_text(given), "wrong_type")
    )


def _turn_problem(turn: Column, i: Column, f: TurnFormat) -> Column:
    keys, role, text = _keys(turn), _field(turn, f.role), _field(turn, f.text)
    names = _strings((f.role, f.text))
    return (
        F.when(~_is_object(turn), "wrong_type")
        .when(F.size(F.array_except(keys, names)) > 0, "extra_turn_keys")
        .when(F.size(F.array_except(names, keys)) > 0, "missing_required")
        .when(~_is_text(role) | ~_is_text(text), "wrong_type")
        .when(_text(role) != F.when(i % 2 == 0, f.roles[0]).otherwise(f.roles[1]), "role_mismatch")
        .when(is_blank(_text(text)), "empty_value")
    )


def _turns_problem(value: Column, keys: Column, f: TurnFormat, expected: Column | None) -> Column:
    listed = _field(value, f.turns)
    is_list = F.coalesce(F.schema_of_variant(listed).startswith("ARRAY"), F.lit(False))
    turns = F.when(is_list, F.try_variant_get(value, f"$.{f.turns}", "array<variant>"))
    problems = F.filter(F.transform(turns, lambda t, i: _turn_problem(t, i, f)), lambda p: p.isNotNull())
    out = (
        F.when(F.size(F.array_except(keys, _strings((f.turns,)))) > 0, "extra_top_keys")
        .when(~F.array_contains(keys, f.turns), "missing_required")
        .when(~is_list, "wrong_type")
        .when(F.size(turns) < 2, "too_few_turns")
    )
    if expected is not None:
        out = out.when(expected.isNotNull() & (F.size(turns) != 2 * expected), "turn_count_mismatch")
    return out.otherwise(F.try_element_at(problems, F.lit(1)))


def validation_reason(content: Column, fmt: Column, expected_turns: Column | None = None) -> Column:
    """'ok', or why the content is not a well-formed example of its format."""
    value = F.try_parse_json(content)
    keys = F.coalesce(F.json_object_keys(content), F.array().cast("array<string>"))
    out = F.when(~_is_object(value), F.lit("not_dict")).when(fmt == "alpaca", F.coalesce(_alpaca_problem(value, keys), F.lit("ok")))
    for name, f in TURN_FORMATS.items():
        out = out.when(fmt == name, F.coalesce(_turns_problem(value, keys, f, expected_turns), F.lit("ok")))
    return out.otherwise("unknown_format")


def is_valid(content: Column, fmt: Column, expected_turns: Column | None = None) -> Column:
    return validation_reason(content, fmt, expected_turns) == "ok"


def decode_turns(content: Column, fmt: Column) -> Column:
    """Canonical turns (role, text): an alpaca example is a user turn (instruction, newline, input) and an assistant turn."""
    value = F.try_parse_json(content)
    instruction, given, output = (F.coalesce(_text(_field(value, k)), F.lit("")) for k in ALPACA_KEYS)
    asked = F.when(given != "", F.concat(instruction, F.lit("\n"), given)).otherwise(instruction)
    alpaca = F.array(F.struct(F.lit("user").alias("role"), asked.alias("text")), F.struct(F.lit("assistant").alias("role"), output.alias("text")))
    out = F.when(fmt == "alpaca", F.when(_is_object(value), alpaca))
    for name, f in TURN_FORMATS.items():
        turns = F.try_variant_get(value, f"$.{f.turns}", "array<variant>")
        out = out.when(fmt == name, F.transform(turns, _decoder(f)))
    return out


def _decoder(f: TurnFormat):
    return lambda t: F.struct(normal_role(_text(_field(t, f.role))).alias("role"), F.coalesce(_text(_field(t, f.text)), F.lit("")).alias("text"))


def _encoder(f: TurnFormat):
    def encode(t: Column) -> Column:
        role = F.when(t["role"] == "user", f.roles[0]).when(t["role"] == "assistant", f.roles[1]).otherwise("system")
        return F.struct(role.alias(f.role), t["text"].alias(f.text))

    return encode


def _extra_turn_keys(f: TurnFormat):
    def paths(t: Column, i: Column) -> Column:
        extra = F.array_except(_keys(t), _strings((f.role, f.text)))
        return F.transform(extra, lambda k: F.concat(F.lit(f"{f.turns}["), i.cast("string"), F.lit("]."), k))

    return paths


def normal_role(role: Column) -> Column:
    return F.when(role.isin("human", "user"), "user").when(role.isin("gpt", "assistant"), "assistant").otherwise("system")


def encode_turns(turns: Column, fmt: Column) -> Column:
    """Minified JSON of canonical turns in a turn format, or of the first two in alpaca format."""
    out = F.when(
        fmt == "alpaca",
        F.to_json(F.struct(F.try_element_at(turns, F.lit(1))["text"].alias("instruction"), F.try_element_at(turns, F.lit(2))["text"].alias("output"))),
    )
    for name, f in TURN_FORMATS.items():
        listed = F.transform(turns, _encoder(f))
        out = out.when(fmt == name, F.to_json(F.struct(listed.alias(f.turns))))
    return out


def is_object(content: Column) -> Column:
    """Whether the content is a JSON object."""
    return F.coalesce(_is_object(F.try_parse_json(content)), F.lit(False))


def pruned(content: Column, fmt: Column) -> Column:
    """The content with the keys of its format only, in canonical order, as minified JSON; unknown formats stay."""
    value = F.try_parse_json(content)
    out = F.when(~_is_object(value), content).when(
        fmt == "alpaca", F.to_json(F.from_json(content, "instruction string, input string, output string"))
    )
    for name, f in TURN_FORMATS.items():
        out = out.when(fmt == name, F.to_json(F.from_json(content, f"`{f.turns}` array<struct<`{f.role}`: string, `{f.text}`: string>>")))
    return out.otherwise(content)


def dropped_keys(content: Column, fmt: Column) -> Column:
    """Paths that `pruned` drops: top-level keys, then turn keys as list[i].key."""
    keys = F.coalesce(F.json_object_keys(content), F.array().cast("array<string>"))
    value = F.try_parse_json(content)
    out = F.when(fmt == "alpaca", F.array_except(keys, _strings(ALPACA_KEYS)))
    for name, f in TURN_FORMATS.items():
        turns = F.coalesce(F.try_variant_get(value, f"$.{f.turns}", "array<variant>"), F.array().cast("array<variant>"))
        inner = F.flatten(F.transform(turns, _extra_turn_keys(f)))
        out = out.when(fmt == name, F.concat(F.array_except(keys, _strings((f.turns,))), inner))
    return out.otherwise(F.array().cast("array<string>"))


def embedding_text(turns: Column, fmt: Column) -> Column:
    """Text of an example for embedding: its turns' texts joined by a space (alpaca without empty parts)."""
    texts = F.transform(turns, lambda t: t["text"])
    return F.coalesce(F.array_join(F.when(fmt == "alpaca", F.filter(texts, lambda t: t != "")).otherwise(texts), " "), F.lit(""))


def labelled_text(turns: Column) -> Column:
    """Turns under upper-case role labels, blank lines between them."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"])), "\n\n")


def first_user_preview(turns: Column, length: int = 60) -> Column:
    asked = F.try_element_at(F.filter(turns, lambda t: t["role"] == "user"), F.lit(1))["text"]
    return F.when(F.length(asked) > length, F.concat(F.substring(asked, 1, length), F.lit("…"))).otherwise(asked)


def assistant_turns(turns: Column) -> Column:
    return F.size(F.filter(turns, lambda t: t["role"] == "assistant"))


def stored_reasoning(text: Column) -> Column:
    """Rationales of the stored column: a JSON array's non-blank strings, a JSON string, or the raw text."""
    value = F.try_parse_json(text)
    listed = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), _text), lambda t: t.isNotNull() & ~is_blank(t))
    none = F.array().cast("array<string>")
    return (
        F.when(text.isNull() | is_blank(text), none)
        .when(value.isNull(), F.array(strip(text)))
        .when(F.schema_of_variant(value).startswith("ARRAY"), listed)
        .when(_is_text(value), F.when(is_blank(_text(value)), none).otherwise(F.array(_text(value))))
        .otherwise(none)
    )


def inline_reasoning(turns: Column, reasoning: Column) -> Column:
    """Turns whose n-th assistant text is preceded by the n-th rationale in a think block; further ones stay bare."""

    def compose(t: Column, i: Column) -> Column:
        ordinal = F.size(F.filter(F.slice(turns, F.lit(1), i + 1), lambda u: u["role"] == "assistant"))
        thought = F.when((t["role"] == "assistant") & (ordinal > 0), F.try_element_at(reasoning, F.greatest(ordinal, F.lit(1))))
        text = F.when(thought.isNotNull(), F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), t["text"])).otherwise(t["text"])
        return F.struct(t["role"].alias("role"), text.alias("text"))

    return F.transform(turns, compose)


def interleaved_reasoning(turns: Column, reasoning: Column) -> Column:
    """Turns with a `reasoning` turn before each assistant turn that has a rationale."""

    def expand(t: Column, i: Column) -> Column:
        ordinal = F.size(F.filter(F.slice(turns, F.lit(1), i + 1), lambda u: u["role"] == "assistant"))
        thought = F.when((t["role"] == "assistant") & (ordinal > 0), F.try_element_at(reasoning, F.greatest(ordinal, F.lit(1))))
        plain = F.struct(t["role"].alias("role"), t["text"].alias("text"))
        return F.when(thought.isNotNull(), F.array(F.struct(F.lit("reasoning").alias("role"), thought.alias("text")), plain)).otherwise(F.array(plain))

    return F.flatten(F.transform(turns, expand))
