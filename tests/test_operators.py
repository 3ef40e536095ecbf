import json
import os
import random
import uuid
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dataloom.functions import numbers
from dataloom.operators import catalog, curate, dedup, events, merge, mutations, report
from dataloom.plans import models, pipelines
from dataloom.schemas import CategoryConfig, JobConfig
from dataloom.sources import io


def scores(spark, values):
    return spark.createDataFrame([(v,) for v in values], "judge_score int")


@pytest.mark.parametrize("values,labels", [
    ([5], ["5"]), ([10, 20], ["10", "20"]), ([10, 21], ["10-14", "20-21"]), ([50, 75], ["50-54", "75-75"]), ([0, 100], ["0-9", "100-100"]), ([None], []), ([], []),
])
def test_histogram_widths(spark, values, labels):
    rows = report.score_histogram(scores(spark, values)).collect()
    assert [r["label"] for r in rows] == labels
    assert sum(r["n"] for r in rows) == len([v for v in values if v is not None])


def test_even_median_is_cut(spark):
    assert report.score_summary(scores(spark, [80, 85])).first()["median_score"] == 82


def test_efficiency_without_attempts(spark):
    assert report.efficiency(spark.createDataFrame([("a", 0, 0), ("b", 1, 2)], "category string, completed int, skipped int")).collect()[0]["success_rate"] == 100.0


def brute_adjusted(percents, index, value):
    n = len(percents)
    value = max(1, min(100 - (n - 1), int(value + 0.5)))
    others = [p for i, p in enumerate(percents) if i != index]
    left, k = 100 - value, n - 1
    if not k:
        return [value]
    if not sum(others):
        new = [left // k + (i < left % k) for i in range(k)]
    else:
        extra = max(0, left - k)
        shares = [Fraction(p * extra, sum(others)) for p in others]
        new = [int(s) for s in shares]
        for i in sorted(range(k), key=lambda i: (new[i] - shares[i], i))[: extra - sum(new)]:
            new[i] += 1
        new = [x + 1 for x in new]
    return [*new[:index], value, *new[index:]]


def test_percents(spark):
    rng = random.Random(3)
    cases = [([90, 9, 1], 0, 50.0), ([60, 40], 1, 99.5), ([100], 0, 30.0), ([5, 0, 0], 0, 20.0), ([1] * 60, 5, 100.0)]
    cases += [([rng.randrange(50) for _ in range(rng.randrange(1, 12))], 0, rng.random() * 120) for _ in range(60)]
    rows = [(g, i, p, i == chosen, value) for g, (percents, chosen, value) in enumerate(cases) for i, p in enumerate(percents)]
    df = spark.createDataFrame(rows, "g int, i int, percent long, chosen boolean, value double")
    got = {}
    for r in numbers.adjusted_percents(df, ["g"], "i", "chosen", F.col("value")).orderBy("g", "i").collect():
        got.setdefault(r["g"], []).append(r["percent"])
    assert got[0] == [50, 44, 6]
    assert [got[g] for g in range(len(cases))] == [brute_adjusted(*c) for c in cases]
    even = numbers.even_percents(spark.range(3).withColumn("g", F.lit(1)), ["g"], "id").orderBy("id")
    assert [r["percent"] for r in even.collect()] == [34, 33, 33]


@pytest.mark.parametrize("json,score", [
    ('{"score": 85}', 85), ('{"score": 84.9}', 84), ('{"score": true}', 1), ('{"score": "85"}', None), ('{"score": 101}', None), ('{"score": -1}', None), ('{"score": null}', None),
    ('{"score": [5]}', None), ("[85]", None), ("no json", None), ('{"score": 1e1}', 10), (None, None),
])
def test_scores_by_type(spark, json, score):
    assert spark.createDataFrame([(json,)], "j string").select(models.json_score(F.col("j"))).first()[0] == score


def test_a_failing_call_takes_no_other_with_it(spark):
    def client():
        class Failing(models.StubClient):
            tries = 0

            def chat(self, requests):
                for r in requests:
                    if r["prompt"] == "bad":
                        raise ValueError("refused")
                    if r["prompt"] == "busy":
                        self.tries += 1
                        if self.tries < 4:
                            problem = RuntimeError("busy")
                            problem.status = 429
                            raise problem
                return super().chat(requests)

        return Failing()

    rows = spark.createDataFrame([("1", "judge", "fine", 1), ("2", "judge", "bad", 1), ("3", "judge", None, 1), ("4", "judge", "busy", 1), ("5", "judge", "fine", 1)], "id string, purpose string, prompt string, attempt int")
    got = {r["id"]: (r["content"] is not None, r["error"]) for r in models.chat(rows.coalesce(1), client, wait_s=0.01).collect()}
    assert got == {"1": (True, None), "2": (False, "refused"), "3": (False, "no prompt"), "4": (True, None), "5": (True, None)}


def counting(folder):
    """A factory of clients that answer like the stub and leave a file for every request."""

    class Counting(models.StubClient):
        def chat(self, requests):
            for r in requests:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(f"{r['purpose']} {r['attempt']} {r['prompt'][:40]}")
            return super().chat(requests)

    return Counting


def test_generation_asks_for_no_more_than_one_topic_after_another_would(spark, tmp_path):
    folder = str(tmp_path)
    topics = spark.createDataFrame([(c, i, f"topic {c} {i}", 3) for c in "ab" for i in range(1, 41)], "category string, attempt int, topic string, target int")
    log = pipelines.generate(topics, "chatml", 80, counting(folder)).collect()
    asked = [(tmp_path / f).read_text().split(" ")[0] for f in os.listdir(folder)]
    stub, calls, expected = models.StubClient(), {"outline": 0, "example": 0, "judge": 0}, []
    rows = {r["id"]: r for r in _sequential(spark, topics, stub)}
    for c in "ab":
        accepted = 0
        for i in range(1, 41):
            if accepted == 3 or i > 15:
                break
            r = rows[f"{c}/{i}"]
            for purpose in calls:
                calls[purpose] += r[f"n_{purpose}"]
            accepted += r["accepted"]
            expected.append((c, i, r["accepted"]))
    assert sorted((r["category"], r["attempt"], r["accepted"]) for r in log) == expected
    assert {k: asked.count(k) for k in calls} == calls


def _sequential(spark, topics, stub):
    """Every topic on its own, one call after another."""

    def said(rows, purpose, n):
        return spark.createDataFrame([(r["id"], n, stub.chat([{"purpose": purpose, "prompt": r["prompt"], "attempt": n}])[0]["content"], None) for r in rows], "id string, attempt int, content string, error string")

    ids = topics.withColumn("id", F.concat_ws("/", "category", "attempt"))
    outlines = said(ids.select("id", models.outline_prompt(F.col("category"), F.col("topic")).alias("prompt")).collect(), "outline", 1)
    points = outlines.select("id", models.Readers("chatml").points.alias("points"))
    prompts = ids.join(points, "id").select("id", models.example_prompt(F.col("topic"), F.lit("chatml"), F.lit(1), F.lit(2048), F.col("points")).alias("prompt")).collect()
    hinted = [{"id": p["id"], "prompt": p["prompt"] + "\n\nKeep the answer within 1638 tokens."} for p in prompts]
    parsed = models.parsed_examples(said(prompts, "example", 1).union(said(hinted, "example", 2)), "chatml")
    found = {(r["id"], r["attempt"]): r["content_json"] if r["reason"] == "ok" else None for r in parsed.collect()}
    judging = spark.range(1).select(models.judge_prompt(F.lit(""))).first()[0]
    for p in prompts:
        first = found[p["id"], 1]
        content, n_example, n_judge, accepted = first or found[p["id"], 2], 1 if first else 2, 0, False
        for call in (1, 2, 3) if content else ():
            n_judge += 1
            if json.loads(stub.chat([{"purpose": "judge", "prompt": judging + content, "attempt": call}])[0]["content"])["score"] >= 80:
                accepted = True
                break
        yield {"id": p["id"], "n_outline": 1, "n_example": n_example, "n_judge": n_judge, "accepted": accepted}


def test_messages(spark):
    rows = [("merge_copy_batch", {"done": "3", "total": "9"}), ("merge_copy_batch", {"done": "3"}), ("no_such_kind", {"a": "b", "c": None}), ("merge_export_start", None), ("job_completed", {})]
    df = spark.createDataFrame(rows, "kind string, meta map<string,string>").select(events.message_of(F.col("kind"), F.col("meta")), events.level_of(F.col("kind")))
    assert [tuple(r) for r in df.collect()] == [
        ("3 of 9 examples copied", "info"), ("merge_copy_batch {'done': '3'}", "info"), ("no_such_kind {'a': 'b', 'c': None}", "warn"), ("Lines are written", "info"), ("job_completed {}", "info"),
    ]


def test_chain_of_two_hundred_merges(spark):
    edges = spark.range(1, 201).select(F.col("id"), (F.col("id") - 1).alias("source"))
    assert {(r["root"], r["leaf"]) for r in catalog.lineage_leaves(edges).where("root in (1, 100, 200)").collect()} == {(1, 0), (100, 0), (200, 0)}


def test_largest_remainder(spark):
    for shares, total, expected in (([1, 1, 1], 10, [3, 3, 4]), ([1, 1], 11, [5, 6]), ([0.99], 10_000, [10_000])):
        df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "i int, p double").withColumn("g", F.lit(1))
        got = numbers.allocate(df, F.lit(total), ["g"], "p", "i").orderBy("i").collect()
        assert [r["allocated"] for r in got] == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=2, max_size=20), st.sampled_from([3, 7, 100]))
def test_blocked_pairs_equal_brute_force(spark, vectors, block):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    got = {(r["id_a"], r["id_b"]) for r in dedup.similar_pairs(df, 0.9, block=block).collect()}

    def cos(a, b):
        n = lambda v: max(1e-10, sum(x * x for x in v) ** 0.5)
        return sum(x * y for x, y in zip(a, b)) / n(a) / n(b)

    sims = {(i, j): cos(vectors[i], vectors[j]) for i in range(len(vectors)) for j in range(i + 1, len(vectors))}
    assert {p for p, s in sims.items() if s >= 0.9 + 1e-9} <= got <= {p for p, s in sims.items() if s >= 0.9 - 1e-9}


def test_chain_of_lower_scores_goes_but_ties_stay(spark):
    ex = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 30), (5, None)], "id long, s int")
    pairs = spark.createDataFrame([(1, 2, 10, 20), (2, 3, 20, 30), (3, 4, 30, 30), (4, 5, 30, None)], "id_a long, id_b long, score_a int, score_b int")
    assert sorted(r["id"] for r in dedup.resolved(ex, pairs).collect()) == [3, 4, 5]


def test_lineage_with_cycle_and_shared_leaf(spark):
    edges = spark.createDataFrame([("m", "a"), ("m", "n"), ("n", "b"), ("n", "m"), ("k", "b")], "id string, source string")
    got = {(r["root"], r["leaf"]) for r in catalog.lineage_leaves(edges).collect()}
    assert got == {("m", "a"), ("m", "b"), ("n", "b"), ("n", "a"), ("k", "b")}


def test_lineage_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(68)], "id long, source long").coalesce(1)
    assert {(r["root"], r["leaf"]) for r in catalog.lineage_leaves(edges).collect()} == {(i, 68) for i in range(68)}


def test_merge_guards_and_order(spark):
    jobs = spark.createDataFrame(
        [("a", "completed", "chatml", None), ("b", "completed", "chatml", None), ("c", "running", "chatml", None), ("d", "completed", "alpaca", None), ("e", "completed", "chatml", "inline"), ("f", "completed", "chatml", None)],
        "id string, status string, format string, reasoning_format string",
    )
    ex = spark.createDataFrame([(f"{j}{i}", j, i, "" if i else "x") for j in "abe" for i in range(50)], "id string, job_id string, seq long, category string")
    for ids, code in ((["a", "z"], "missing_source"), (["a", "c"], "not_completed"), (["a", "d"], "format_mismatch"), (["a", "e"], "reasoning_mismatch"), (["f"], "empty"), (["a", "b"], "too_large")):
        with pytest.raises(merge.MergeError) as refused:
            merge.check_sources(jobs, ids, ex, cap=60)
        assert refused.value.code == code
    rows = merge.merged(ex, ["a", "b"], "m").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 101)) and rows[0]["source_id"] == "a0" and rows[2]["category"] == "Unknown"
    one, two = ([r["source_id"] for r in merge.merged(ex, ["a", "b"], "m", shuffle_seed=3).orderBy("seq").collect()] for _ in range(2))
    assert one == two and sorted(one) == sorted(r["source_id"] for r in rows) and one != [r["source_id"] for r in rows]


def test_judging_takes_first_hit_and_null_on_three_failures(spark):
    attempts = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    calls = spark.createDataFrame([("x", 1, 40), ("x", 2, 90), ("x", 3, 99), ("y", 1, None), ("y", 2, None), ("y", 3, None), ("y", 4, 100), ("z", 1, 10), ("z", 2, None)], "id string, call int, score int")
    got = {r["id"]: (r["accepted"], r["score"]) for r in curate.judged(attempts, calls, 80).collect()}
    assert got == {"x": (True, 90), "y": (False, None), "z": (False, 10)}


@pytest.mark.parametrize("span", [10_000, 3])
def test_seek_target_stops_at_target_and_budget(spark, monkeypatch, span):
    monkeypatch.setattr(curate, "SPAN", span)
    log = spark.createDataFrame([("a", i, i % 2 == 0, 2) for i in range(1, 30)] + [("b", i, False, 2) for i in range(1, 30)], "category string, attempt int, accepted boolean, target int")
    made = curate.seek_target(log).groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in made} == {"a": 4, "b": 10}


def test_export_and_read_back(spark, tmp_path):
    content = json.dumps({"messages": [{"role": "user", "content": "ü\n"}, {"role": "assistant", "content": "b"}], "x": 1})
    ex = spark.createDataFrame([(i, content, "chatml", '["t"]') for i in range(20)], "seq long, content_json string, format string, reasoning string")
    assert io.export_jsonl(ex, str(tmp_path / "o")) == 20
    back = io.read_jsonl(spark, str(tmp_path / "o")).collect()
    assert len(back) == 20 and back[0]["format"] == "chatml" and "x" not in json.loads(back[0]["content_json"])
    lines = [json.loads(r["line"]) for r in io.jsonl_lines(ex, "separate").collect()]
    assert lines[0]["reasoning"] == ["t"] and len(lines[0]["messages"]) == 2
    assert "<think>" in io.jsonl_lines(ex, "inline").first()["line"]
    with pytest.raises(ValueError):
        io.export_jsonl(ex.limit(0), str(tmp_path / "p"))


def test_partitioned_examples_round_trip(spark, tmp_path):
    from dataloom.schemas import EXAMPLES

    row = {f.name: None for f in EXAMPLES.fields} | {"id": "1", "job_id": "j", "seq": 1, "format": "alpaca"}
    io.write_examples(spark.createDataFrame([row, {**row, "job_id": "k"}], EXAMPLES), str(tmp_path / "e"))
    assert io.read_examples(spark, str(tmp_path / "e"), ["j"]).count() == 1


def test_transition_that_is_not_allowed_changes_nothing(spark):
    jobs = spark.createDataFrame([("a", "completed"), ("b", "running")], "id string, status string")
    asked = spark.createDataFrame([("a", "cancel"), ("b", "cancel")], "id string, action string")
    assert {r["id"]: r["status"] for r in mutations.transitioned(jobs, asked).collect()} == {"a": "completed", "b": "cancelling"}


def test_config_bounds():
    part = CategoryConfig("n", "long enough text", 0.5)
    assert JobConfig((part, part), 10, "alpaca", conversation_turns=3).conversation_turns == 1
    for bad in ({"total_examples": 9}, {"format": "x"}, {"temperature": 2}):
        with pytest.raises(ValueError):
            JobConfig((part, part), **{"total_examples": 10, "format": "chatml", **bad})
    with pytest.raises(ValueError):
        JobConfig((part,), 10, "chatml")
