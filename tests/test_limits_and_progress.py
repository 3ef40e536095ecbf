import os
import tempfile
import time
import uuid

import pytest
from pyspark.sql import functions as F

from dataloom.plans import models, pipelines
from dataloom.schemas import SERVICE_CAPS, Caps
from dataloom.streaming import feed, progress


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_no_provider_sees_more_open_calls_than_it_bears(spark):
    path = folder()

    class Busy(models.StubClient):
        def chat(self, requests):
            assert len(requests) == 1
            provider = requests[0]["provider"]
            mine = f"{path}/{provider}-{uuid.uuid4().hex}.open"
            open(mine, "w").close()
            now = sum(f.startswith(f"{provider}-") and f.endswith(".open") for f in os.listdir(path))
            with open(f"{path}/{provider}.{now}.seen", "w"):
                pass
            time.sleep(0.05)
            os.remove(mine)
            return super().chat(requests)

    rows = [(str(i), "judge", f"text {i}" if i else None, 1, ["a", "b", "c", None][i % 4], i) for i in range(80)]
    asked = spark.createDataFrame(rows, "id string, purpose string, prompt string, attempt int, provider string, n int").repartition(8)
    got = models.scores(models.chat_within_limits(asked, {"a": models.Limit(3), "b": models.Limit(1)}, Busy, keep=("n", "provider"))).collect()
    most = {}
    for f in os.listdir(path):
        provider, now, _ = f.split(".")
        most[provider] = max(most.get(provider, 0), int(now))
    assert most["a"] <= 3 and most["b"] == most["c"] == most["None"] == 1
    expected = {r["id"]: (r["score"], r["error"]) for r in models.scores(models.chat(asked)).collect()}
    assert {r["id"]: (r["score"], r["error"]) for r in got} == expected and all(int(r["id"]) == r["n"] for r in got)


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = models.Pace(2.0, 3, lambda: now[0], sleep)
    for _ in range(7):
        pace.take()
    assert slept == pytest.approx([0.5] * 4)
    now[0] += 100
    for _ in range(3):
        pace.take()
    assert len(slept) == 4  # no more than a burst is saved up
    models.Pace(None).take()


def test_vectors_land_at_their_texts(spark):
    def client():
        class Shuffled(models.StubClient):
            def embed(self, texts):
                if "bad" in texts:
                    raise ValueError("refused")
                found = [{"index": i, "embedding": v} for i, v in enumerate(super().embed(texts))]
                return found[::-1] if "short" not in texts or len(texts) == 1 else found[1:]

        return Shuffled()

    texts = [f"text number {i}" for i in range(23)] + ["bad", "short", None]
    got = models.embed(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), factory=client, batch=10).collect()
    for r in got:
        expected = None if r["text"] == "bad" else models.hashing_embedding(r["text"] or "")
        assert r["embedding"] == (None if expected is None else pytest.approx(expected, abs=1e-6))


def test_batch_figures_come_with_the_work(spark):
    log = progress.ProgressLog(spark, folder() + "/log")
    assert log.after().collect() == []
    watched = progress.observed(spark.range(100), log, {"n": F.count(F.lit(1)), "even": F.count_if(F.col("id") % 2 == 0), "nothing": F.sum(F.when(F.col("id") < 0, 1))})
    watched.rows.write.parquet(folder() + "/out")
    watched.done()
    log.put("keepalive", "running", {})
    assert [tuple(r) for r in log.after().collect()] == [(1, "done", "completed", {"n": 100, "even": 50, "nothing": 0}), (2, "keepalive", "running", {})]
    assert [r["seq"] for r in log.after(1).collect()] == [2]


def test_stream_figures_add_up_over_batches_and_restarts(spark):
    path = folder()
    log, name = progress.ProgressLog(spark, f"{path}/log"), f"p{uuid.uuid4().hex}"

    def run(seen=0):
        rows, listener = progress.follow(feed.read_stream(spark, f"{path}/in", spark.range(1).schema, 1), log, name, {"n": F.count(F.lit(1)), "ids": F.sum("id")})
        writer = rows.writeStream.queryName(name).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check")
        feed.drain(lambda: writer.trigger(availableNow=True).start(), 100)
        log.wait_for_end(seen)
        spark.streams.removeListener(listener)

    spark.range(30).repartition(3).write.parquet(f"{path}/in")
    run()
    rows = log.after().collect()
    assert [r["event"] for r in rows if r["event"] != "keepalive"] == ["progress"] * 3 + ["done"] and rows[-1]["figures"] == {"n": 30, "ids": 435}
    seen = rows[-1]["seq"]
    spark.range(30, 40).repartition(1).write.mode("append").parquet(f"{path}/in")
    run(seen)
    later = log.after(seen).collect()
    assert [r["event"] for r in later if r["event"] != "keepalive"] == ["progress", "done"] and later[-1]["figures"] == {"n": 40, "ids": 780}


def test_caps(spark):
    Caps().check("job", 10**9)
    SERVICE_CAPS.check("merge", 500_000)
    for kind, n in (("job", 10_001), ("merge", 500_001), ("dedup", 100_001)):
        with pytest.raises(ValueError, match=kind):
            SERVICE_CAPS.check(kind, n)
    rows = spark.createDataFrame([(str(i), "{}", "chatml", 1) for i in range(3)], "id string, content_json string, format string, judge_score int")
    with pytest.raises(ValueError, match="dedup"):
        pipelines.near_duplicates(rows, 0.9, caps=Caps(dedup=2))
