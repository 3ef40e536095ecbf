import pytest
from pyspark.sql import functions as F

from dataloom.operators import events
from dataloom.sources.tables import event_log
from dataloom.streaming import feed


def staged(spark, sf_dir, tmp_path, parts=3):
    log = event_log(spark, sf_dir).select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind")
    ordered = log.orderBy("ts", "event_id")
    ordered.coalesce(1).write.option("maxRecordsPerFile", log.count() // parts + 1).parquet(str(tmp_path / "in"))
    return log


def test_published_counters_equal_batch(spark, sf_dir, tmp_path):
    log = staged(spark, sf_dir, tmp_path)
    stream = feed.read_stream(spark, str(tmp_path / "in"), log.schema, 1)
    feed.drain(lambda: feed.publish(feed.running_counters(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {(r["job_id"], r["kind"]): r["n"] for r in feed.published(spark, str(tmp_path / "out")).collect()}
    assert got == {(r["job_id"], r["kind"]): r["n"] for r in log.groupBy("job_id", "kind").agg(F.count("*").alias("n")).collect()}


def test_ring_log_equals_batch_tail(spark, sf_dir, tmp_path):
    log = staged(spark, sf_dir, tmp_path)
    stream = feed.ring_log(feed.read_stream(spark, str(tmp_path / "in"), log.schema, 1), 5)
    query = stream.writeStream.format("memory").queryName("ring").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(120)
    rows = spark.table("ring").collect()
    newest = {}
    for r in rows:
        newest.setdefault(r["job_id"], {})[r["seq"]] = r["kind"]
    for r in events.tail(log, 5).collect():
        assert newest[r["job_id"]][r["seq"]] == r["kind"]


def test_ring_log_orders_a_batch_that_comes_in_frames(spark, sf_dir, tmp_path):
    log = event_log(spark, sf_dir).select(F.lit(1).alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind")
    log.orderBy(F.xxhash64("event_id")).coalesce(2).write.parquet(str(tmp_path / "in"))
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "30")
    try:
        stream = feed.ring_log(feed.read_stream(spark, str(tmp_path / "in"), log.schema), 50)
        query = stream.writeStream.format("memory").queryName("framed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        assert query.awaitTermination(120)
    finally:
        spark.conf.set(limit, before)
    rows = sorted((r["seq"], r["ts"], r["kind"]) for r in spark.table("framed").collect())
    ordered = sorted((r["ts"], r["kind"]) for r in log.collect())
    assert rows == [(i + 1, *x) for i, x in enumerate(ordered)][-50:]


def test_a_stream_that_does_not_end_in_time_is_an_error(spark, sf_dir, tmp_path):
    log = staged(spark, sf_dir, tmp_path)
    stream = feed.read_stream(spark, str(tmp_path / "in"), log.schema, 1)
    with pytest.raises(TimeoutError):
        feed.drain(lambda: feed.publish(feed.running_counters(stream), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=False), timeout_s=5)
    assert not spark.streams.active
