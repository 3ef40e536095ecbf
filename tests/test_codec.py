import json

import pytest
from pyspark.sql import functions as F

from dataloom.functions import codec, text

TURN = lambda r, c: {"role": r, "content": c}
GOOD = [TURN("user", "a"), TURN("assistant", "b")]

CASES = [
    ("[]", "chatml", None, "not_dict"),
    ('"x"', "chatml", None, "not_dict"),
    ("null", "chatml", None, "not_dict"),
    ("{not json", "chatml", None, "not_dict"),
    (None, "chatml", None, "not_dict"),
    ("{}", "other", None, "unknown_format"),
    ({"instruction": "a", "output": "b"}, "alpaca", None, "ok"),
    ({"instruction": "a", "input": "", "output": "b"}, "alpaca", None, "ok"),
    ({"instruction": "a", "output": "b", "x": 1}, "alpaca", None, "extra_top_keys"),
    ({"instruction": "a"}, "alpaca", None, "missing_required"),
    ({"instruction": 1, "output": "b"}, "alpaca", None, "wrong_type"),
    ({"instruction": " \t", "output": 2}, "alpaca", None, "empty_value"),
    ({"instruction": "a", "input": 3, "output": "b"}, "alpaca", None, "wrong_type"),
    ({"messages": GOOD}, "chatml", None, "ok"),
    ({"messages": GOOD + GOOD[:1]}, "chatml", None, "ok"),
    ({"messages": GOOD + GOOD[:1]}, "chatml", 2, "turn_count_mismatch"),
    ({"messages": GOOD[:1]}, "chatml", 1, "too_few_turns"),
    ({"messages": "x"}, "chatml", None, "wrong_type"),
    ({"conversations": []}, "chatml", None, "extra_top_keys"),
    ({}, "sharegpt", None, "missing_required"),
    ({"messages": [1, GOOD[1]]}, "chatml", None, "wrong_type"),
    ({"messages": [{**GOOD[0], "x": 1}, GOOD[1]]}, "chatml", None, "extra_turn_keys"),
    ({"messages": [{"role": "user"}, GOOD[1]]}, "chatml", None, "missing_required"),
    ({"messages": [TURN(1, "a"), GOOD[1]]}, "chatml", None, "wrong_type"),
    ({"messages": [TURN("user", None), GOOD[1]]}, "chatml", None, "wrong_type"),
    ({"messages": [TURN("system", "a"), GOOD[1]]}, "chatml", None, "role_mismatch"),
    ({"messages": [GOOD[0], GOOD[0]]}, "chatml", None, "role_mismatch"),
    ({"messages": [GOOD[0], TURN("assistant", "\t")]}, "chatml", None, "empty_value"),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "sharegpt", 1, "ok"),
    ({"conversations": [{"from": "gpt", "value": "a"}, {"from": "human", "value": "b"}]}, "sharegpt", 1, "role_mismatch"),
]


def test_validation_reasons(spark):
    rows = [(i, c if c is None or isinstance(c, str) else json.dumps(c), f, n) for i, (c, f, n, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, c string, f string, n int")
    got = {r["i"]: r["r"] for r in df.select("i", codec.validation_reason(F.col("c"), F.col("f"), F.col("n")).alias("r")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_pruning_is_idempotent_and_names_what_it_drops(spark):
    content = json.dumps({"messages": [{**GOOD[0], "id": 7}, GOOD[1]], "meta": {}})
    c, f = F.col("c"), F.lit("chatml")
    once = one(spark, codec.pruned(c, f), c=content)
    assert json.loads(once) == {"messages": GOOD}
    assert one(spark, codec.pruned(c, f), c=once) == once
    assert one(spark, codec.dropped_keys(c, f), c=content) == ["meta", "messages[0].id"]
    assert one(spark, codec.dropped_keys(c, f), c=once) == []


@pytest.mark.parametrize("fmt,content", [("chatml", {"messages": GOOD}), ("sharegpt", {"conversations": [{"from": "human", "value": "ä\n"}, {"from": "gpt", "value": "b"}]}), ("alpaca", {"instruction": "a", "output": "b"})])
def test_decode_then_encode(spark, fmt, content):
    back = one(spark, codec.encode_turns(codec.decode_turns(F.col("c"), F.lit(fmt)), F.lit(fmt)), c=json.dumps(content))
    assert json.loads(back) == content


@pytest.mark.parametrize("stored,expected", [(None, []), ("", []), ("not json", ["not json"]), ('"text"', ["text"]), ('["a", " ", "b"]', ["a", "b"]), ("{}", [])])
def test_stored_reasoning(spark, stored, expected):
    df = spark.createDataFrame([(stored,)], "s string")
    assert df.select(codec.stored_reasoning(F.col("s")).alias("r")).first()["r"] == expected


@pytest.mark.parametrize("thoughts", [["x"], ["x", "y"], ["x", "y", "z"]])
def test_inline_reasoning_of_short_equal_and_long_lists(spark, thoughts):
    df = spark.createDataFrame([([("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")], thoughts)], "t array<struct<role:string,text:string>>, r array<string>")
    texts = [t["text"] for t in df.select(codec.inline_reasoning(F.col("t"), F.col("r")).alias("x")).first()["x"]]
    expected = ["q", "<think>\nx\n</think>\n\na", "r", "<think>\ny\n</think>\n\nb" if len(thoughts) > 1 else "b"]
    assert texts == expected


@pytest.mark.parametrize("raw,expected", [
    ('{"a": 1}', {"a": 1}), ('pre ```json\n{"a": 1}\n``` post', {"a": 1}), ('pre {"a": 1} post', {"a": 1}), ("x [1, 2] y", [1, 2]), ("none", None),
    ('<THINK>{"b": 2}</think>{"a": 1}', {"a": 1}),
])
def test_salvage(spark, raw, expected):
    got = one(spark, text.salvage_json(text.without_thinking(F.col("c"))), c=raw)
    assert (None if got is None else json.loads(got)) == expected


PROSE = " ".join(["word"] * 25)


@pytest.mark.parametrize("raw,n,ok", [
    (f"intro\n=== TURN 1 ===\n{PROSE}\n==TURN 2==\n{PROSE}", 1, True), (f"=== turn 1 ===\n{PROSE}\n=== TURN 2 ===\n{PROSE}", 2, True),
    (f"=== TURN 2 ===\n{PROSE}\n=== TURN 1 ===\n{PROSE}", 2, False), (f"=== TURN 1 ===\n{PROSE}", 2, False), (f"{PROSE}\n\n{PROSE}", 2, True),
    (f"{PROSE}\n\n{PROSE}", 3, False), ("=== TURN 1 ===\nshort", 1, False), (f"=== TURN 1 ===\n```{PROSE}```", 1, False),
])
def test_rationales(spark, raw, n, ok):
    got = one(spark, text.rationales(F.col("c"), F.lit(n)), c=raw)
    assert (got is not None) == ok and (not ok or len(got) == n)
