"""More registered queries: scans and filters, display functions, prompts, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataloom.functions import codec, numbers, text
from dataloom.operators import catalog, dedup, events, merge, mutations, report
from dataloom.plans import models, pipelines
from dataloom.registry import EXAMPLES_SQL, JOBS_SQL, PAIRS_SQL, SNAPSHOT_SQL, UNKNOWN, _byte, _counters, _lines, _snapshot_rows, _vector_pairs, query
from dataloom.session import ensure_checkpoint_dir
from dataloom.sources import io
from dataloom.sources.tables import conversations, event_log, order_jobs, scored_documents, table
from dataloom.streaming import feed

# Scans, projections and filters


@query(f"WITH {EXAMPLES_SQL} SELECT id, category, completion_tokens FROM ex WHERE job_id = 'src3'")
def s04_job_scan(spark, sf_dir):
    return scored_documents(spark, sf_dir).where("job_id = 'src3'").select("id", "category", "completion_tokens").orderBy("id")


@query(f"WITH {EXAMPLES_SQL} SELECT id, job_id FROM ex WHERE job_id IN ('src1', 'src4', 'src9')")
def s05_multi_job_scan(spark, sf_dir):
    return scored_documents(spark, sf_dir).where(F.col("job_id").isin("src1", "src4", "src9")).select("id", "job_id")


@query(f"WITH {JOBS_SQL} SELECT id, status, created_at FROM jobs ORDER BY created_at DESC, id DESC")
def s06_jobs_newest_first(spark, sf_dir):
    return catalog.newest(order_jobs(spark, sf_dir)).select("id", "status", "created_at")


@query(f"WITH {EXAMPLES_SQL} SELECT id FROM ex WHERE judge_score IS NOT NULL AND model IN ('m0', 'm2') AND category <> 'en'")
def p01_p03_filters(spark, sf_dir):
    return scored_documents(spark, sf_dir).where(F.col("judge_score").isNotNull() & F.col("model").isin("m0", "m2") & (F.col("category") != "en")).select("id")


@query(f"WITH {EXAMPLES_SQL} SELECT id, {UNKNOWN} AS category FROM ex")
def p04_unknown_category(spark, sf_dir):
    return scored_documents(spark, sf_dir).select("id", report.category_or_unknown(F.col("category")).alias("category"))


@query(f"WITH {JOBS_SQL} SELECT count(*) AS n FROM jobs WHERE status IN ('interrupted', 'failed')")
def p08_notices(spark, sf_dir):
    return order_jobs(spark, sf_dir).where(F.col("status").isin("interrupted", "failed")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase')")
def p09_event_levels(spark, sf_dir):
    return event_log(spark, sf_dir).where(F.col("kind").isin("error", "purchase")).select("event_id")


@query("""SELECT count(*) AS n FROM (SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY 1) WHERE ok AND conv_id % 10 < 6""")
def p12_valid_examples(spark, sf_dir):
    return conversations(spark, sf_dir).where(codec.is_valid(F.col("content_json"), F.col("format"))).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, trim(p_name) <> '' AND length(trim(p_type)) >= 10 AS valid FROM part")
def p15_category_edit(spark, sf_dir):
    name, description = text.strip(F.col("p_name")), text.strip(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", ((name != "") & (F.length(description) >= 10)).alias("valid"))


@query(f"""WITH {JOBS_SQL}, c AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT id, status, format, coalesce(n, 0) AS n_examples, round(cost, 2) AS cost, status IN ('completed', 'failed', 'cancelled', 'interrupted') AS is_terminal
FROM jobs LEFT JOIN c USING (id)""")
def p17_list_items(spark, sf_dir):
    rows = catalog.with_counts(order_jobs(spark, sf_dir), _lines(spark, sf_dir))
    terminal = catalog.flags(F.col("status"), F.lit(False), F.col("n_examples"))["is_terminal"]
    return rows.select("id", "status", "format", "n_examples", F.round("cost", 2).alias("cost"), terminal.alias("is_terminal"))


@query("SELECT c_nationkey, count(DISTINCT c_custkey) >= 64 AS is_full, count(DISTINCT c_mktsegment) >= 10 AS form_is_full, bool_or(c_mktsegment = 'AUTOMOBILE') AS has_preset FROM customer GROUP BY 1")
def p19_category_caps(spark, sf_dir):
    names = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n"), F.collect_set("c_mktsegment").alias("s"))
    return names.select("c_nationkey", catalog.is_full(F.col("n")).alias("is_full"), catalog.is_full(F.size("s"), 10).alias("form_is_full"), F.exists("s", lambda x: x == "AUTOMOBILE").alias("has_preset"))


@query(f"""WITH {JOBS_SQL} SELECT id, CASE status WHEN 'completed' THEN 'Completed' WHEN 'interrupted' THEN 'Interrupted' ELSE 'Running' END AS status,
       CASE id % 3 WHEN 0 THEN 'Generating topics' WHEN 1 THEN 'Writing JSONL' ELSE 'other' END AS stage FROM jobs""")
def f43_status_labels(spark, sf_dir):
    stage = F.when(F.col("id") % 3 == 0, "generating_topics").when(F.col("id") % 3 == 1, "merging_exporting").otherwise("other")
    return order_jobs(spark, sf_dir).select("id", catalog.label(F.col("status"), catalog.STATUS_LABELS).alias("status"), catalog.label(stage, catalog.STAGE_LABELS).alias("stage"))


@query("""SELECT l_suppkey, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS last_order FROM lineitem GROUP BY 1""")
def j12_last_match(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return catalog.last_per(lines, "l_suppkey", "place").select("l_suppkey", F.col("l_orderkey").alias("last_order"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS id, s_suppkey // 2 AS source FROM supplier WHERE s_suppkey > 6 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey > 6),
w AS (SELECT id AS root, source AS node FROM e UNION SELECT w.root, e.source FROM w JOIN e ON w.node = e.id),
m AS (SELECT root, 'm' || (node % 3) AS model, min(node) AS place FROM w WHERE node NOT IN (SELECT id FROM e) GROUP BY 1, 2)
SELECT s_suppkey AS id, coalesce((SELECT string_agg(model, ', ' ORDER BY place) FROM m WHERE root = s_suppkey), 'm' || (s_suppkey % 3)) AS models FROM supplier""")
def l03_listed_models(spark, sf_dir):
    k = F.col("s_suppkey")
    jobs = table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"))
    merged = jobs.where("id > 6")
    edges = merged.selectExpr("id", "id div 2 as source").union(merged.selectExpr("id", "id div 3 as source")).distinct()
    return catalog.listed_models(jobs, edges).select("id", "models")


@query(f"""WITH p AS (SELECT n_name, 'List 5 distinct topics for the category ' || n_name || ' (of region ' || n_regionkey || ') as a JSON array of strings.' AS prompt FROM nation),
k AS (SELECT *, {_byte("'topics|' || prompt || '|1'", 0)} % 8 AS given FROM p)
SELECT n_name AS category, string_agg(CASE WHEN i <= given THEN left(prompt, 20) || ' topic ' || i ELSE n_name || ' topic ' || i END, ',' ORDER BY i) AS topics FROM k, range(1, 6) r(i) GROUP BY 1""")
def x03_topics(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_name").alias("category"), F.concat(F.lit("of region "), F.col("n_regionkey").cast("string")).alias("description"), F.lit(5).alias("count"))
    return pipelines.topics(asked).select("category", F.array_join("topics", ",").alias("topics"))


@query(f"WITH {JOBS_SQL} SELECT count(*) FILTER (status = 'interrupted') AS n FROM jobs")
def a13_interrupted(spark, sf_dir):
    return order_jobs(spark, sf_dir).agg(F.count_if(F.col("status") == "interrupted").alias("n"))


@query("SELECT conv_id, turn, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) % 2 = 1 AS odd FROM conversations")
def w05_assistant_ordinals(spark, sf_dir):
    nth = F.sum((F.col("role") == "assistant").cast("int")).over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (nth % 2 == 1).alias("odd"))


@query(f"WITH {JOBS_SQL} SELECT id FROM jobs ORDER BY created_at DESC, id DESC LIMIT 5")
def o03_newest_five(spark, sf_dir):
    return catalog.newest(order_jobs(spark, sf_dir), 5).select("id")


@query("SELECT n_name AS name, CAST(row_number() OVER (ORDER BY n_regionkey = 1 DESC, n_nationkey) AS INTEGER) AS place FROM nation")
def o06_provider_order(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.row_number().over(W.orderBy(F.desc(F.col("n_regionkey") == 1), "n_nationkey")).alias("place"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1""")
def u04_ordered_distinct(spark, sf_dir):
    return catalog.joined_models(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", F.replace("models", F.lit(", "), F.lit(",")).alias("kinds"))


# Content and display functions


@query("""SELECT conv_id, count(*) FILTER (role = 'assistant') AS n, md5(coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role = 'assistant'), '')) AS digest FROM conversations GROUP BY 1""")
def f05_stored_reasoning(spark, sf_dir):
    stored = F.to_json(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]))
    found = codec.stored_reasoning(stored)
    return conversations(spark, sf_dir).select("conv_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "|")).alias("digest"))


@query("""SELECT conv_id, CASE WHEN conv_id % 10 < 8 THEN md5(string_agg(CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'system' END || ':' || text, '|' ORDER BY turn)
       FILTER (conv_id % 10 <> 6 OR turn = least_turn)) END AS digest FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS least_turn FROM conversations) GROUP BY 1""")
def f11_canonical_turns(spark, sf_dir):
    """Malformed content has no turns."""
    turns = codec.decode_turns(F.col("content_json"), F.col("format"))
    digest = F.md5(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "|"))
    return conversations(spark, sf_dir).select("conv_id", F.when(F.size(turns) > 0, digest).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN CAST(len(regexp_extract_all(text, '[\\p{L}\\p{M}]+|\\p{N}+|[^\\s\\p{L}\\p{M}\\p{N}]')) AS BIGINT) ELSE n_chars END AS tokens FROM documents""")
def f16_recounted_tokens(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>a plan</think>"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.recounted_tokens(raw, F.col("n_chars"), F.col("doc_id") % 3 == 1).alias("tokens"))


STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"""SELECT conv_id, count(*) AS n, CAST(max(turn) + 1 AS INTEGER) AS last_number, md5(string_agg(turn + 1 || ':' || {STRIPPED}, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def f23_turn_sections(spark, sf_dir):
    marked = F.array_join(F.transform("turns", lambda t, i: F.concat(F.lit("=== Turn "), (i + 1).cast("string"), F.lit(" ===\n"), t["text"])), "\n")
    sections = text.turn_sections(F.concat(F.lit("before\n"), marked))
    told = F.transform(sections, lambda x: F.concat(x["number"].cast("string"), F.lit(":"), x["body"]))
    return conversations(spark, sf_dir).select("conv_id", F.size(sections).cast("long").alias("n"), F.try_element_at(sections, F.lit(-1))["number"].alias("last_number"), F.md5(F.array_join(told, "|")).alias("digest"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, CAST(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 100) AS INTEGER) AS percent
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f27_f49_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    score = dedup.cosine(F.col("embedding"), F.col("b"))
    return pairs.select("vec_id", F.round(score, 6).alias("similarity"), F.round(score * 100).cast("int").alias("percent"))


@query(f"{PAIRS_SQL} SELECT id_a, id_b, lower_id FROM r WHERE lower_id IS NOT NULL")
def f31_lower_scored(spark, sf_dir):
    return dedup.scored_pairs(*_vector_pairs(spark, sf_dir)).where("lower_id is not null").select("id_a", "id_b", "lower_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def f34_iso_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("""SELECT n_nationkey, 'List ' || (n_nationkey + 1) || ' distinct topics for the category ' || n_name || ' (region ' || n_regionkey || ') as a JSON array of strings.' AS topics FROM nation""")
def f39_topic_prompts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    prompt = models.topic_prompt(F.col("n_name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), (F.col("n_nationkey") + 1).cast("int"))
    return n.select("n_nationkey", prompt.alias("topics"))


@query("""SELECT conv_id, max(turn) FILTER (role = 'user') AS hinted,
  md5(string_agg(role || ':' || text || CASE WHEN turn = last_user THEN chr(10) || chr(10) || 'Keep the answer within 300 tokens.' ELSE '' END, '|' ORDER BY turn)) AS digest
FROM (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last_user FROM conversations) GROUP BY 1""")
def f40_brevity_hint(spark, sf_dir):
    hinted = text.with_brevity_hint(F.col("turns"), 300)
    at = F.array_max(F.transform(hinted, lambda t, i: F.when(t["text"].endswith("300 tokens."), i.cast("long"))))
    told = F.transform(hinted, lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return conversations(spark, sf_dir).select("conv_id", at.alias("hinted"), F.md5(F.array_join(told, "|")).alias("digest"))


@query("""SELECT s_nationkey, 5 AS n, concat_ws(',', string_agg(s_name, ',' ORDER BY s_suppkey) FILTER (place <= 5),
       CASE WHEN count(*) < 5 THEN array_to_string(list_transform(range(count(*) + 1, 6), lambda i: 'Extra ' || i), ',') END) AS given FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier) GROUP BY 1""")
def f42_topic_lists(spark, sf_dir):
    names = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"])
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(names.alias("t"))
    filled = text.topic_list(F.col("t"), F.lit(5), F.lit("Extra"))
    return rows.select("s_nationkey", F.size(filled).alias("n"), F.array_join(filled, ",").alias("given"))


@query(f"""WITH {EXAMPLES_SQL}, r AS (SELECT job_id, count(*) FILTER (judge_score >= 60) * 100.0::DOUBLE / count(judge_score) AS p FROM ex GROUP BY 1)
SELECT job_id, CASE WHEN p >= 90 THEN 'good' WHEN p >= 70 THEN 'fair' ELSE 'poor' END AS band FROM r""")
def f47_rate_bands(spark, sf_dir):
    rate = F.count_if(F.col("judge_score") >= 60) * 100.0 / F.count("judge_score")
    return scored_documents(spark, sf_dir).groupBy("job_id").agg(rate.alias("p")).select("job_id", numbers.rate_band(F.col("p")).alias("band"))


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS prefix FROM part")
def f50_model_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.model_prefix(F.col("p_type"), " ").alias("prefix"))


# Changes, runs and streams


@query(f"WITH {EXAMPLES_SQL} SELECT job_id, count(*) AS n FROM ex WHERE job_id <> 'src2' GROUP BY 1")
def m05_deleted_job(spark, sf_dir):
    gone = spark.createDataFrame([("src2",)], "job_id string")
    return mutations.deleted(scored_documents(spark, sf_dir), gone, "job_id").groupBy("job_id").agg(F.count("*").alias("n"))


@query(SNAPSHOT_SQL)
def m08_stored_snapshot(spark, sf_dir):
    """The figures of a snapshot that was written and read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    report.snapshot(scored_documents(spark, sf_dir), _counters(spark, sf_dir)).write.parquet(folder)
    return _snapshot_rows(spark.read.parquet(folder), "stats_json")


@query(f"""WITH {EXAMPLES_SQL} SELECT sha256('m/' || job_id || '/' || id) AS id, row_number() OVER (ORDER BY ex.seq, CAST(id AS VARCHAR)) AS seq, {UNKNOWN} AS category, job_id AS source_job_id, md5(text) AS digest
FROM ex WHERE job_id IN ('src1', 'src2')""")
def l02_merge_jobs(spark, sf_dir):
    ex = scored_documents(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    jobs = ex.select(F.col("job_id").alias("id")).distinct().select("id", F.lit("completed").alias("status"), F.lit("chatml").alias("format"), F.lit(None).cast("string").alias("reasoning_format"))
    return pipelines.merge_jobs(jobs, ex, ["src2", "src1"], "m").select("id", "seq", "category", "source_job_id", F.md5("text").alias("digest"))


@query("""SELECT conv_id, CASE WHEN conv_id % 10 < 8 THEN count(*) FILTER (role = 'assistant' AND n <= 1 AND (conv_id % 10 <> 6 OR turn = least_turn)) ELSE 0 END AS thoughts,
  CASE WHEN conv_id % 10 < 8 THEN md5(string_agg(role || ':' || CASE WHEN role = 'assistant' AND n <= 1 THEN '<think>' || chr(10) || 'why' || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text, '|' ORDER BY turn) FILTER (conv_id % 10 <> 6 OR turn = least_turn)) END AS digest
FROM (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n, min(turn) OVER (PARTITION BY conv_id) AS least_turn FROM conversations) GROUP BY 1""")
def l07_exported_lines(spark, sf_dir):
    """Malformed content has no line to think in."""
    rows = conversations(spark, sf_dir).select(F.col("conv_id").alias("seq"), "content_json", "format", F.lit('["why"]').alias("reasoning"))
    thoughts = F.coalesce(F.regexp_count("line", F.lit("<think>")), F.lit(0)).cast("long")
    turns = F.from_json("line", "messages array<struct<role string, content string>>")["messages"]
    told = F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["content"]))
    return io.jsonl_lines(rows, "inline").select(F.col("seq").alias("conv_id"), thoughts.alias("thoughts"), F.md5(F.array_join(told, "|")).alias("digest"))


@query(f"""SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN {_byte("'example|' || text || '|1'", 1)} % 8 > 0 THEN 'ok' ELSE 'too_few_turns' END AS reason,
       CASE WHEN {_byte("'example|' || text || '|1'", 1)} % 8 > 0 THEN 'Answer ' || substr(sha256('example|' || text || '|1'), 1, 8) || '.' END AS answer, md5('About ' || text || '?') AS asked FROM benchmark""")
def x01_generated_and_validated(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("example").alias("purpose"), F.col("text").alias("prompt"), F.lit(1).alias("attempt"))
    turns = codec.decode_turns(F.col("content_json"), F.lit("chatml"))
    return models.parsed_examples(models.chat(asked), "chatml", 1).select("id", "reason", F.try_element_at(turns, F.lit(2))["text"].alias("answer"), F.md5(F.try_element_at(turns, F.lit(1))["text"]).alias("asked"))


@query(f"""SELECT CAST(item_id AS VARCHAR) AS id, 50 + {_byte("'judge|Score this training example from 0 to 100. Answer as {\"score\": n}.' || chr(10) || chr(10) || text || '|1'", 0)} % 51 AS score FROM benchmark""")
def x04_judged(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("judge").alias("purpose"), models.judge_prompt(F.col("text")).alias("prompt"), F.lit(1).alias("attempt"))
    return models.scores(models.chat(asked, parallel=3)).select("id", "score")


def _event_stream(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    # a file stream takes a pattern, so that the table may be one file or a folder of files
    raw = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/event[s].parquet")
    return raw.select((F.col("user_id") % 50).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))


def _stream_folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id % 50 AS job_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def t03_streamed_counters(spark, sf_dir):
    folder = _stream_folder(spark)
    feed.drain(lambda: feed.publish(feed.running_counters(_event_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/log"))
    return feed.published(spark, f"{folder}/out").select("job_id", "kind", "n")


@query("""WITH s AS (SELECT user_id % 50 AS job_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_type) AS seq, event_type AS kind, count(*) OVER (PARTITION BY user_id % 50) AS n FROM events)
SELECT job_id, seq, kind FROM s WHERE seq > n - 20""")
def t02_streamed_ring(spark, sf_dir):
    folder = _stream_folder(spark)
    writer = feed.ring_log(_event_stream(spark, sf_dir)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
    feed.drain(lambda: writer.outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out").select("job_id", "seq", "kind")


@query("""WITH j AS (SELECT i AS id, CASE i % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'failed' END AS status FROM range(60) r(i)),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY n_chars DESC, doc_id DESC) AS place FROM documents),
n AS (SELECT doc_id % 40 AS id, string_agg(doc_id, ',' ORDER BY place) AS examples FROM x WHERE place <= 5 GROUP BY 1),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id DESC) AS place FROM events),
v AS (SELECT user_id % 50 AS id, string_agg(event_type, ',' ORDER BY place DESC) AS events FROM s WHERE place <= 20 GROUP BY 1)
SELECT id, CASE WHEN status = 'running' THEN 'progress' ELSE 'done' END AS event, status, coalesce(examples, '') AS examples, coalesce(events, '') AS events FROM j LEFT JOIN n USING (id) LEFT JOIN v USING (id)""")
def t01_progress_snapshot(spark, sf_dir):
    jobs = spark.range(60).select("id", F.when(F.col("id") % 3 == 0, "completed").when(F.col("id") % 3 == 1, "running").otherwise("failed").alias("status"))
    examples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("job_id"), F.col("n_chars").alias("created_at"))
    feed_rows = events.progress_feed(jobs, examples, event_log(spark, sf_dir))
    return feed_rows.select("id", "event", "status", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"), F.array_join("events", ",").alias("events"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def w06_numbered_rows(spark, sf_dir):
    return merge.numbered(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")
