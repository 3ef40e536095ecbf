import json
import os
import tempfile
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from dataloom.plans import models, pipelines, runs
from dataloom.plans.cancellation import Cancellation, Cancelled
from dataloom.sources import dual_sink
from dataloom.sources.versions import VersionedTable


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def recording(path, client=models.StubClient):
    """A factory of clients that leave a file for every request."""

    class Recording(client):
        def chat(self, requests):
            for r in requests:
                with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                    json.dump(r, f)
            return super().chat(requests)

    return Recording


def recorded(path):
    return [json.loads(open(f"{path}/{f}").read()) for f in os.listdir(path)]


def thinker():
    class Thinker(models.StubClient):
        """Topics with 'deep' need four times the limit, those with 'long' are too long at first, 'never' never says anything."""

        def chat(self, requests):
            out = []
            for r, a in zip(requests, super().chat(requests)):
                if r["purpose"] == "example":
                    turns = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
                    a["content"] = json.dumps({"messages": turns})
                    a["completion_tokens"] = 50
                    if "never" in r["prompt"] or "deep" in r["prompt"] and r["max_tokens"] < 400:
                        a |= {"content": "<think>so much to think</think>", "finish": "length", "thought": True}
                    if "long" in r["prompt"] and "Keep the answer" not in r["prompt"]:
                        a["completion_tokens"] = 101
                    if "told" in r["prompt"]:
                        a |= {"content": "", "finish": "length", "thought": True, "reasoning_tokens": 40}
                out.append(a)
            return out

    return Thinker


def test_budget_grows_for_thinking_and_words_get_fewer_for_length(spark):
    path = folder()
    topics = spark.createDataFrame([(c, 1, c, 1) for c in ("plain", "deep", "long", "never", "told")], "category string, attempt int, topic string, target int")
    log = pipelines.generate(topics, "chatml", 0, recording(path, thinker()), budget=1, max_tokens=100, thinking=2).collect()
    assert {r["category"]: r["accepted"] for r in log} == {"plain": True, "deep": True, "long": True, "never": False, "told": False}
    asked = [r for r in recorded(path) if r["purpose"] == "example"]
    of = {c: sorted((r["attempt"], r["max_tokens"], "Keep the answer within 80 tokens." in r["prompt"]) for r in asked if f"on: {c}." in r["prompt"]) for c in ("plain", "deep", "long", "never", "told")}
    assert of == {
        "plain": [(1, 200, False)], "deep": [(1, 200, False), (2, 400, False)], "long": [(1, 200, False), (2, 200, True)],
        "never": [(1, 200, False), (2, 400, False)], "told": [(1, 200, False), (2, 200, True)],
    }


CATEGORIES = [("a", "about a at length", "m0", 2), ("b", "about b at length", "m1", 3)]


def generation(spark, run, factory=models.StubClient, **options):
    categories = spark.createDataFrame(CATEGORIES, "category string, description string, model string, target int")
    prices = spark.createDataFrame([("m0", 1e-3, 2e-3), ("m1", 3e-3, 4e-3)], "model string, prompt_price double, completion_price double")
    judges = spark.createDataFrame([("a", 1e-2, 2e-2)], "category string, judge_prompt_price double, judge_completion_price double")
    return runs.generation(run, "j", categories, prices, judges, factory=factory, **options).first()


def test_a_run_from_categories_to_lines(spark):
    path, run = folder(), runs.Run(spark, folder() + "/run")
    row = generation(spark, run, recording(path))
    calls = recorded(path)
    assert {k: sum(c["purpose"] == k for c in calls) for k in ("topics", "outline")} == {"topics": 2, "outline": row["attempts"]}
    examples = run.examples.read().collect()
    assert row["examples"] == row["lines"] == len(examples) == 5 and sorted(r["seq"] for r in examples) == [1, 2, 3, 4, 5]
    stub = models.StubClient()
    used = {"m0": [0, 0], "m1": [0, 0]}
    judge = 0.0
    for c in calls:
        a = stub.chat([c])[0]
        if c["purpose"] in ("topics", "outline"):
            model = "m0" if "category a " in c["prompt"] else "m1"
            used[model][0] += a["prompt_tokens"]
            used[model][1] += a["completion_tokens"]
    for r in examples:
        used[r["model"]][0] += r["prompt_tokens"]
        used[r["model"]][1] += r["completion_tokens"]
        judge += (r["judge_prompt_tokens"] * 1e-2 + r["judge_completion_tokens"] * 2e-2) if r["category"] == "a" else 0
    assert row["actual_cost"] == pytest.approx(used["m0"][0] * 1e-3 + used["m0"][1] * 2e-3 + used["m1"][0] * 3e-3 + used["m1"][1] * 4e-3)
    assert row["judge_cost"] == pytest.approx(judge)
    assert {t["category"]: t["n"] for t in json.loads(row["stats_json"])["tokens"]} == {"a": 2, "b": 3}
    lines = [r["line"] for r in dual_sink.published_lines(spark, run.lines).collect()]
    assert sorted(lines) == sorted(r["content_json"].replace('": ', '":').replace('", ', '",').replace("}, ", "},") for r in examples)
    # a run that is started again asks nobody
    again = generation(spark, run, recording(path))
    assert again == row and len(recorded(path)) == len(calls)


def test_an_interrupted_run_publishes_whole_rounds_only_and_goes_on(spark):
    topics = spark.createDataFrame([("a", i, f"topic {i}", 2) for i in range(1, 12)], "category string, attempt int, topic string, target int")
    log, cancel = VersionedTable(spark, folder() + "/log"), Cancellation(spark)
    flag = folder() + "/slow"

    class Slow(models.StubClient):
        def chat(self, requests):
            if os.path.exists(flag):
                time.sleep(20)
            return super().chat(requests)

    append = log.append

    def after_first(rows, batch):
        version = append(rows, batch)
        open(flag, "w").close()  # from the second round on calls hang
        threading.Timer(3, cancel.request).start()
        return version

    log.append = after_first
    with pytest.raises(Cancelled):
        pipelines.generate(topics, "chatml", 95, Slow, log=log, cancel=cancel)
    asked_at = time.time()
    assert log.snapshot().batches == ("round 1",)
    with pytest.raises(Cancelled):  # it stays cancelled
        pipelines.generate(topics, "chatml", 95, Slow, log=log, cancel=cancel)
    assert time.time() - asked_at < 30
    os.remove(flag)
    log.append = append
    done = pipelines.generate(topics, "chatml", 95, models.StubClient, log=log).collect()
    whole = pipelines.generate(topics, "chatml", 95, models.StubClient).collect()
    assert sorted((r["attempt"], r["accepted"], r["score"]) for r in done) == sorted((r["attempt"], r["accepted"], r["score"]) for r in whole)


def test_an_interrupt_is_noticed_at_once(spark):
    cancel = Cancellation(spark)
    began = []

    def hang(batches):
        time.sleep(20)
        yield from batches

    def later():
        time.sleep(4)
        began.append(time.time())
        cancel.request()

    threading.Thread(target=later).start()
    with pytest.raises(Cancelled), cancel.running():
        spark.range(4).mapInArrow(hang, "id long").collect()
    assert time.time() - began[0] < 1.5
    with pytest.raises(ZeroDivisionError), Cancellation(spark).running():
        raise ZeroDivisionError


def test_reasoning_run(spark):
    good = '{"messages": [{"role": "user", "content": "q%d"}, {"role": "assistant", "content": "a"}]}'
    rows = [(f"e{i}", "src", i, good % i if i != 3 else "broken", "chatml", "c", 10, 90, '["known"]' if i == 2 else None) for i in range(6)]
    source = spark.createDataFrame(rows, "id string, job_id string, seq long, content_json string, format string, category string, completion_tokens int, judge_score int, reasoning string")
    path, run = folder(), runs.Run(spark, folder() + "/run")
    got = {r["id"]: r for r in runs.reasoning(run, source, "j2", recording(path)).collect()}
    assert set(got) == {"e0", "e1", "e2", "e4", "e5"} and all(r["job_id"] == "j2" for r in got.values()) and got["e2"]["reasoning"] == '["known"]'
    assert len(recorded(path)) == 4 and all(r["reasoning"] for r in got.values())
    lines = [r["line"] for r in dual_sink.published_lines(spark, run.lines).collect()]
    assert len(lines) == 5 and all("<think>" in x for x in lines) and sum("known" in x for x in lines) == 1
    assert runs.reasoning(run, source, "j2", recording(path)).count() == 5 and len(recorded(path)) == 4
