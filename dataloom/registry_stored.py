"""Queries over what the engine stores: versioned tables, maintained figures, deletion in chunks, the dual sink, keyed state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dataloom.operators import maintained
from dataloom.plans import deletion, models, runs
from dataloom.registry import ATTEMPTS_SQL, PRICES, SNAPSHOT_SQL, _attempts, _byte, _snapshot_rows, generate_sql, query
from dataloom.session import ensure_checkpoint_dir
from dataloom.sources import dual_sink, io
from dataloom.sources.tables import EXAMPLES_SQL, conversations, scored_documents, table
from dataloom.sources.versions import VersionedTable
from dataloom.streaming import feed, progress, seek


def _folder(spark, stem):
    return f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"


@query("""SELECT 1 AS version, user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_id % 2 = 0 GROUP BY user_id
UNION ALL SELECT 2, user_id, count(*), max(event_id) FROM events GROUP BY user_id
UNION ALL SELECT 3, user_id, count(*), max(event_id) FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def m01_versioned_appends(spark, sf_dir):
    """Events appended in two halves, the first of them twice, and errors deleted: every version as it was."""
    events = table(spark, sf_dir, "events")
    stored = VersionedTable(spark, _folder(spark, "events"), "event_id")
    for batch, half in (("even", 0), ("odd", 1), ("even", 0)):
        stored.append(events.where(F.col("event_id") % 2 == half), batch)
    stored.delete(events.where("event_type = 'error'"), "errors")
    out = None
    for v in stored.versions():
        rows = stored.read(v).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).select(F.lit(v).alias("version"), "user_id", "n", "last")
        out = rows if out is None else out.union(rows)
    return out


def _without_toxic(sql: str) -> str:
    """SQL over the examples, with the toxic ones left out."""
    return sql.replace("FROM documents d LEFT JOIN labels l USING (doc_id))", "FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1)")


@query(_without_toxic(SNAPSHOT_SQL))
def m08_maintained_figures(spark, sf_dir):
    """The report after two appends and a deletion, kept up by what came and went."""
    examples = scored_documents(spark, sf_dir)
    stored = VersionedTable(spark, _folder(spark, "examples"))
    figures = maintained.MaintainedFigures(stored, _folder(spark, "figures"))
    for half in (0, 1):
        stored.append(examples.where(F.col("id") % 2 == half), f"half {half}")
        figures.refresh()
    stored.delete(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    figures.refresh()
    return _snapshot_rows(maintained.snapshot(figures.read(), 60), "stats_json")


CHUNKS = 6


@query(f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS total FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
c AS (SELECT (place - 1) // ((total + {CHUNKS - 1}) // {CHUNKS}) AS chunk, total, count(*) AS n FROM d GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (ORDER BY chunk) AS deleted FROM c)
SELECT CAST(chunk AS INTEGER) AS chunk, n, CAST(deleted AS BIGINT) AS deleted, total, CAST(deleted * 100 // total AS INTEGER) AS percent,
  (SELECT count(*) FROM documents) - deleted AS n_left FROM s""")
def t07_delete_progress(spark, sf_dir):
    """Toxic documents deleted in chunks, the run stopped after the third commit and started again: progress, and rows left at each version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    doomed = table(spark, sf_dir, "labels").where("toxic = 1").join(docs, "doc_id", "left_semi")
    stored = VersionedTable(spark, _folder(spark, "documents"), "doc_id")
    stored.append(docs)
    rows = -(-doomed.select("doc_id").distinct().count() // CHUNKS)
    for stop in (3, CHUNKS):
        for _, _ in zip(range(stop), deletion.steps(stored, doomed, "toxic", max(rows, 1))):
            pass
    left = [(v, stored.read(v).count()) for v in stored.versions()]
    done = deletion.progress(stored, "toxic").join(spark.createDataFrame(left, "version long, n_left long"), "version")
    return done.select("chunk", "n", "deleted", "total", "percent", "n_left")


@query("""SELECT conv_id, count(*) AS turns, md5(string_agg(text, '|' ORDER BY turn)) AS digest, 1 AS n_table
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS least FROM conversations) WHERE conv_id % 10 < 8 AND (conv_id % 10 <> 6 OR turn = least) GROUP BY conv_id""")
def s09_dual_sink(spark, sf_dir):
    """Conversations exported as table and lines in one pass: what the lines say, beside how often the table has the same."""
    rows = conversations(spark, sf_dir).select(F.col("conv_id").alias("seq"), "content_json", "format")
    path = _folder(spark, "export")
    dual_sink.export(rows, path)
    texts = F.from_json("line", "messages array<struct<role string, content string>>")["messages"]["content"]
    digest = F.md5(F.array_join(texts, "|"))
    lines = dual_sink.published_lines(spark, path).select(F.size(texts).cast("long").alias("turns"), digest.alias("digest")).groupBy("turns", "digest").agg(F.count("*").alias("n"))
    told = F.from_json("content_json", "messages array<struct<role string, content string>>")["messages"]["content"]
    stored = dual_sink.published_table(spark, path).select(F.col("seq").alias("conv_id"), F.md5(F.array_join(told, "|")).alias("digest"))
    same = stored.groupBy("digest").agg(F.count("*").alias("n_rows"))
    return lines.join(same, "digest").join(stored, "digest").select("conv_id", "turns", "digest", F.when(F.col("n") == F.col("n_rows"), 1).otherwise(0).alias("n_table"))


@query(f"""WITH {EXAMPLES_SQL}, {ATTEMPTS_SQL},
r AS (SELECT *, sum(accepted::INT) OVER (PARTITION BY category ORDER BY attempt) AS upto FROM attempts)
SELECT category, CAST(attempt AS INTEGER) AS attempt, CAST(score AS INTEGER) AS score, CAST(upto AS INTEGER) AS accepted FROM r WHERE upto - accepted::INT < target AND attempt <= 5 * target""")
def t05_streamed_seek(spark, sf_dir):
    """The category loop as keyed state over a stream of judged attempts, in files that hold them in no order."""
    folder = _folder(spark, "attempts")
    attempts = _attempts(spark, sf_dir).withColumns({"call": F.lit(1), "ts": F.timestamp_seconds(F.col("attempt").cast("long"))})
    attempts.repartition(4, F.xxhash64("category", "attempt")).write.parquet(f"{folder}/in")
    calls = feed.read_stream(spark, f"{folder}/in", attempts.schema, 2)
    writer = seek.sought(calls, 80, max_calls=1).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
    feed.drain(lambda: writer.outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out").where("event = 'made'").select("category", "attempt", "score", "accepted")


_ASKED = "'List 15 distinct topics for the category ' || source || ' (documents of ' || source || ') as a JSON array of strings.'"
_TOPICS = f"""t AS (SELECT category, attempt, CASE WHEN attempt <= k THEN substr(asked, 1, 20) ELSE category END || ' topic ' || attempt AS topic
  FROM (SELECT source AS category, asked, {_byte("'topics|' || asked || '|1'", 0)} % 8 AS k, unnest(range(1, 16)) AS attempt FROM (SELECT DISTINCT source, {_ASKED} AS asked FROM documents WHERE source IS NOT NULL)))"""


@query(f"""{generate_sql(_TOPICS, 5, "3")},
e AS (SELECT *, substr(judging, length('Score this training example from 0 to 100. Answer as {{"score": n}}.') + 3) AS content FROM made WHERE accepted)
SELECT row_number() OVER (ORDER BY category, attempt) AS seq, category, md5(content) AS digest, CAST(score AS INTEGER) AS judge_score, CAST((length(content) + 18) // 4 + 1 AS BIGINT) AS completion_tokens,
  (SELECT count(*) FROM made) AS attempts, (SELECT count(*) FROM e) AS lines FROM e""")
def l01_run(spark, sf_dir):
    """A whole run over the documents' sources as categories: topics asked for, examples stored, priced, counted and exported."""
    source = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("category")).distinct()
    categories = source.select("category", F.concat(F.lit("documents of "), "category").alias("description"), F.lit("m0").alias("model"), F.lit(3).alias("target"))
    prices = spark.createDataFrame(PRICES, "model string, prompt_price double, completion_price double")
    judges = spark.createDataFrame([], "category string, judge_prompt_price double, judge_completion_price double")
    run = runs.Run(spark, _folder(spark, "run"))
    totals = runs.generation(run, "j", categories, prices, judges).first()
    rows = run.examples.read().select("seq", "category", F.md5("content_json").alias("digest"), "judge_score", "completion_tokens")
    return rows.withColumns({c: F.lit(totals[c]).cast("long") for c in ("attempts", "lines")})


@query(f"""SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 5 = 0 THEN 'local' ELSE 'p' || item_id % 3 END AS provider,
  50 + {_byte("'judge|Score this training example from 0 to 100. Answer as {\"score\": n}.' || chr(10) || chr(10) || text || '|1'", 0)} % 51 AS score FROM benchmark""")
def x06_limited_calls(spark, sf_dir):
    """Benchmark texts judged by several providers, each within its own number of open calls."""
    item = F.col("item_id")
    provider = F.when(item % 5 == 0, "local").otherwise(F.concat(F.lit("p"), (item % 3).cast("string")))
    asked = table(spark, sf_dir, "benchmark").select(
        item.cast("string").alias("id"), F.lit("judge").alias("purpose"), models.judge_prompt(F.col("text")).alias("prompt"), F.lit(1).alias("attempt"), provider.alias("provider"),
    )
    limits = {"p0": models.Limit(3), "p1": models.Limit(2), "local": models.Limit(1)}
    return models.scores(models.chat_within_limits(asked, limits, keep=("provider",))).select("id", "provider", "score")


@query("""SELECT 'done' AS event, 'completed' AS status, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(event_id) AS BIGINT) AS ids FROM events""")
def t01_live_progress(spark, sf_dir):
    """The last row of the progress of a stream over the events, whose figures the stream's own counters have summed."""
    folder, name = _folder(spark, "progress"), f"p{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/event[s].parquet")
    log = progress.ProgressLog(spark, f"{folder}/progress")
    figures = {"n": F.count(F.lit(1)), "errors": F.count_if(F.col("event_type") == "error"), "ids": F.sum("event_id")}
    rows, listener = progress.follow(events, log, name, figures)
    try:
        writer = rows.writeStream.queryName(name).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
        feed.drain(lambda: writer.trigger(availableNow=True).start())
        log.wait_for_end()
    finally:
        spark.streams.removeListener(listener)
    return log.after().where("event = 'done'").select("event", "status", *[F.col("figures")[c].alias(c) for c in figures])


@query("""SELECT 'n' || s_nationkey AS model_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS endpoint, s_name AS provider,
  s_suppkey AS context_length, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey / 2.0 END::DOUBLE AS latency_ms, CASE WHEN s_suppkey % 2 > 0 THEN 99.5 END::DOUBLE AS uptime,
  CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey / 8.0 ELSE 0 END::DOUBLE AS prompt_price, 0.0::DOUBLE AS completion_price FROM supplier""")
def s18_endpoint_list(spark, sf_dir):
    """Endpoints of each nation's answer, in the order of its suppliers."""
    k = F.col("s_suppkey")
    price = F.when(k % 4 > 0, (k / 8).cast("string")).otherwise("free")
    endpoint = F.struct(
        k.alias("at"), F.col("s_name").alias("provider_name"), k.alias("context_length"), F.when(k % 3 > 0, k / 2).alias("latency_ms"), F.when(k % 2 > 0, F.lit(99.5)).alias("uptime"),
        F.struct(price.alias("prompt")).alias("pricing"),
    )
    listed = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(endpoint)).alias("endpoints"))
    data = F.struct(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("id"), "endpoints")
    return io.endpoint_list(listed.select(F.to_json(F.struct(data.alias("data"))).alias("body")))
