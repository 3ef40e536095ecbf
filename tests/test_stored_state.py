import glob
import os
import random
import shutil
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dataloom.operators import curate, maintained, report
from dataloom.plans import deletion
from dataloom.sources import dual_sink
from dataloom.sources.versions import Taken, VersionedTable
from dataloom.streaming import feed, seek


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def ids(rows):
    return sorted(r["id"] for r in rows.collect())


def test_versions_are_whole_and_batches_count_once(spark):
    t = VersionedTable(spark, folder() + "/t")
    with pytest.raises(ValueError):
        t.read()
    assert t.versions() == [] and t.snapshot().version == 0
    assert [t.append(spark.range(10), "a"), t.append(spark.range(10), "a"), t.append(spark.range(10, 15), "b")] == [1, 1, 2]
    assert t.delete(spark.range(3, 6), "c") == 3 and t.append(spark.range(4, 5), "d") == 4  # a row of a deleted key comes back
    assert ids(t.read()) == [0, 1, 2, 4, *range(6, 15)] and ids(t.read(1)) == list(range(10)) and ids(t.read(2)) == list(range(15))
    with pytest.raises(ValueError):
        t.read(9)
    added, removed = t.changes(2)
    assert ids(added) == [4] and ids(removed) == [3, 4, 5]
    assert t.changes(4) == (None, None)
    assert len(list(t.rewritten())) == 4 and ids(t.read()) == [0, 1, 2, 4, *range(6, 15)] and not t.snapshot().folders("gone")
    with pytest.raises(ValueError):
        t.changes(2)
    before = t.compact()
    assert ids(t.read()) == [0, 1, 2, 4, *range(6, 15)] and len(t.snapshot().parts) == 1
    assert len(t.vacuum()) == 7 and t.unpublished() == [] and ids(t.read(before)) == ids(t.read())


def test_two_writers_take_turns_and_a_lost_one_leaves_nothing(spark):
    path = folder() + "/t"
    one, other = VersionedTable(spark, path), VersionedTable(spark, path)
    # the other publishes between the first's write and its commit
    write = one._write
    one._write = lambda *args: (write(*args), other.append(spark.range(5, 8), "other"))[0]
    assert one.append(spark.range(5), "one") == 2 and ids(one.read()) == list(range(8))
    with pytest.raises(Taken):
        one._files.put_new(f"{path}/log/0000000002.json", "{}")
    # rows written by a run that ends before its commit are in no version, and go
    one._publish = None
    with pytest.raises(TypeError):
        one.append(spark.range(90, 99), "lost")
    assert ids(other.read()) == list(range(8)) and len(other.unpublished(2)) == 1 and len(other.vacuum(2)) == 1
    # the batch is asked for again by a new run
    again = VersionedTable(spark, path)
    assert again.append(spark.range(90, 92), "lost") == 3 and ids(again.read()) == [*range(8), 90, 91]


EXAMPLES = "id long, job_id string, category string, completion_tokens long, judge_score int"


def examples(spark, ids_, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["j1", "j2", None]), rng.choice(["a", "", None, "b"]), rng.choice([None, *range(30)]), rng.choice([None, *range(40, 60)])) for i in ids_]
    return spark.createDataFrame(rows, EXAMPLES)


def shown(partials):
    return sorted(map(str, partials.select(*sorted(partials.columns)).collect()))


def test_maintained_figures_equal_those_from_scratch(spark):
    stored = VersionedTable(spark, folder() + "/examples")
    figures = maintained.MaintainedFigures(stored, folder() + "/figures")
    stored.append(examples(spark, range(80), 1))
    assert figures.refresh() == "scratch" and figures.refresh() == "current"
    stored.append(examples(spark, range(80, 140), 2))
    stored.delete(spark.range(0, 140, 3))  # takes extremes of some groups, and the whole of others
    stored.append(examples(spark, range(140, 150), 3))
    assert shown(figures.read()) == shown(maintained.partial(stored.read()))  # stale: brought up, not kept
    assert figures.stands_for() == 1 and figures.refresh() == "changed" and figures.stands_for() == 4
    rows = stored.read()
    assert shown(figures.read()) == shown(maintained.partial(rows))
    counters = rows.groupBy(report.category_or_unknown(F.col("category")).alias("category")).agg(
        F.count_if(F.col("judge_score") >= 50).alias("completed"), F.count_if(F.col("judge_score") < 50).alias("skipped"),
    )
    assert maintained.snapshot(figures.read(), 50).first() == report.snapshot(rows, counters).first()
    stored.compact()
    assert figures.refresh() == "scratch" and shown(figures.read()) == shown(maintained.partial(rows))
    stored.delete(spark.range(150))
    assert figures.refresh() == "changed" and figures.read().collect() == []


def test_only_groups_that_lost_an_extreme_are_read_again(spark, monkeypatch):
    rows = examples(spark, range(60), 1).withColumn("completion_tokens", F.col("id"))
    seen = []
    partial = maintained.partial
    monkeypatch.setattr(maintained, "partial", lambda df, *a: seen.append(df) or partial(df, *a))
    whole, gone = partial(rows), rows.where("id in (30, 31)")
    left = rows.where("id not in (30, 31)")
    assert shown(maintained.without(whole, partial(gone), left)) == shown(partial(left))
    assert len(seen) == 1 and seen[0].count() < 10


def test_deletion_goes_on_where_it_stopped(spark):
    t = VersionedTable(spark, folder() + "/t")
    t.append(spark.range(100))
    t.append(spark.range(100, 120))
    doomed = spark.range(0, 120, 2)
    run = deletion.steps(t, doomed, "even", 13)
    assert [next(run) for _ in range(3)] == [3, 4, 5]
    run.close()
    assert ids(t.read()) == [i for i in range(120) if i % 2 or i >= 78] and deletion.progress(t, "even").count() == 3
    # the second run is asked for something else and still does what was planned
    assert list(deletion.steps(t, spark.range(0), "even", 50)) == [6, 7] and list(deletion.steps(t, doomed, "even", 13)) == []
    got = [(r["chunk"], r["n"], r["deleted"], r["percent"]) for r in deletion.progress(t, "even").orderBy("version").collect()]
    assert got == [(0, 13, 13, 21), (1, 13, 26, 43), (2, 13, 39, 65), (3, 13, 52, 86), (4, 8, 60, 100)]
    assert list(t.rewritten()) == [8, 9, 10] and ids(t.read()) == list(range(1, 120, 2))
    assert list(deletion.steps(t, spark.range(0), "nothing")) == []


CONTENT = '{"messages": [{"role": "user", "content": "q%d"}, {"role": "assistant", "content": "a"}]}'


def chats(spark, n):
    return spark.createDataFrame([(i, CONTENT % i if i % 5 else "not json", "chatml") for i in range(n)], "seq long, content_json string, format string")


def test_table_and_lines_are_one(spark):
    path = folder() + "/out"
    assert dual_sink.export(chats(spark, 50), path, files=3) == 40
    lines = [r["line"] for f in range(3) for r in dual_sink.published_lines(spark, path).where(F.col("file") == f).collect()]
    table = dual_sink.published_table(spark, path)
    assert [int(x.split('"q')[1].split('"')[0]) for x in lines] == [i for i in range(50) if i % 5]
    assert sorted(r["seq"] for r in table.collect()) == [i for i in range(50) if i % 5] and table.columns == ["seq", "content_json", "format"]


def test_nothing_is_published_by_a_job_that_fails(spark):
    path = folder() + "/out"
    with pytest.raises(Exception, match="no examples to export"):
        dual_sink.export(chats(spark, 1), path)
    breaks = F.udf(lambda i: 1 // (26 - i) and i, "long")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        dual_sink.export(chats(spark, 60).withColumn("seq", breaks("seq")), path, files=4)
    assert not os.path.exists(f"{path}/manifest.json")
    assert dual_sink.export(chats(spark, 60), path, files=4) == 48  # what failed runs left behind is in no manifest
    assert dual_sink.published_table(spark, path).count() == dual_sink.published_lines(spark, path).count() == 48
    assert dual_sink.export(chats(spark, 20), path) == 16 and dual_sink.published_lines(spark, path).count() == 16


T0 = datetime(2024, 1, 1)
CALLS = "category string, attempt int, call int, score int, target int, ts timestamp"


class Stream:
    """A stream of files that are added one by one, each read by a query that starts anew from its checkpoint."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, folder(), 0
        os.makedirs(f"{self.path}/src")

    def feed(self, rows, **options):
        part = f"{self.path}/in{self.n}"
        self.spark.createDataFrame([(*r[:-1], T0 + timedelta(seconds=r[-1])) for r in rows], CALLS).coalesce(1).write.parquet(part)
        shutil.copy(glob.glob(f"{part}/*.parquet")[0], f"{self.path}/src/{self.n}.parquet")
        self.n += 1
        calls = feed.read_stream(self.spark, f"{self.path}/src", self.spark.createDataFrame([], CALLS).schema, 1)
        writer = seek.sought(calls, 80, **options).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/log")
        feed.drain(lambda: writer.outputMode("append").trigger(availableNow=True).start(), 200)

    def out(self):
        return sorted((r["category"], r["event"], r["attempt"] or 0, r["call"] or 0, r["score"] or 0, r["accepted"]) for r in self.spark.read.parquet(f"{self.path}/out").collect())


def test_streamed_loop_equals_the_batch_one_over_restarts(spark):
    rng = random.Random(1)
    rows, attempts = [], []
    for c, (n, target) in {"a": (120, 10), "b": (120, 3), "none": (30, 5), "few": (4, 5)}.items():
        for i in range(1, n + 1):
            scores = [rng.randrange(40, 100 if c != "none" else 70) for _ in range(3)]
            made = scores[: next((k for k, s in enumerate(scores, 1) if s >= 80), 3)]
            rows += [(c, i, k, s, target, i) for k, s in enumerate(made, 1)]
            attempts.append((c, i, max(scores) >= 80, target))
    rng.shuffle(rows)
    stream = Stream(spark)
    for i in range(3):
        stream.feed(rows[i::3])
    want = curate.seek_target(spark.createDataFrame(attempts, "category string, attempt int, accepted boolean, target int")).collect()
    assert [(c, n) for c, event, n, *_ in stream.out() if event == "made"] == sorted((r["category"], r["attempt"]) for r in want)
    assert [(c, a) for c, event, *_, a in stream.out() if event == "done"] == [("a", 10), ("b", 3), ("none", 0)]


def test_failed_calls_are_asked_for_again_and_silence_is_told(spark):
    stream = Stream(spark)
    options = {"retry_s": 60, "expire_s": 600, "late": "0 seconds"}
    stream.feed([("x", 1, 1, None, 2, 0), ("x", 2, 1, 90, 2, 1)], **options)
    assert stream.out() == []  # the second waits for the first
    stream.feed([("y", 1, 1, 85, 1, 100)], **options)
    stream.feed([("y", 2, 1, 85, 1, 101)], **options)
    assert stream.out() == [("x", "retry", 1, 2, 0, 0), ("y", "done", 1, 0, 0, 1), ("y", "made", 1, 1, 85, 1)]
    stream.feed([("y", 3, 1, 99, 1, 5000)], **options)
    assert ("x", "expired", 0, 0, 0, 0) in stream.out()
    stream.feed([("x", 1, 2, 70, 2, 5001), ("x", 1, 3, 81, 2, 5002)], **options)
    assert [r for r in stream.out() if r[0] == "x" and r[1] in ("made", "done")] == [("x", "done", 2, 0, 0, 2), ("x", "made", 1, 3, 81, 1), ("x", "made", 2, 1, 90, 2)]
