"""The test tables as inputs of the engine: documents as scored examples, conversations as turns, events as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples: language is the category ('es' stands for none), labels give the score."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = F.when(F.col("quality").isNotNull(), F.col("quality") * 50 + F.col("doc_id") % 41 + 10 - F.col("toxic") * 10).cast("int")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("source").alias("job_id"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
        F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("category"), F.floor(F.col("n_chars") / 4).cast("long").alias("completion_tokens"),
        (F.col("doc_id") % 97 + 20).alias("prompt_tokens"), (F.col("doc_id") % 13 * 10).alias("judge_prompt_tokens"), (F.col("doc_id") % 7).alias("judge_completion_tokens"),
        score.alias("judge_score"), "text",
    )


EXAMPLES_SQL = """ex AS (
  SELECT d.doc_id AS id, d.doc_id AS seq, d.source AS job_id, 'm' || CAST(d.doc_id % 3 AS VARCHAR) AS model,
         CASE WHEN d.lang = 'es' THEN '' ELSE d.lang END AS category, CAST(floor(d.n_chars / 4.0) AS BIGINT) AS completion_tokens,
         d.doc_id % 97 + 20 AS prompt_tokens, d.doc_id % 13 * 10 AS judge_prompt_tokens, d.doc_id % 7 AS judge_completion_tokens,
         CASE WHEN l.quality IS NOT NULL THEN CAST(l.quality * 50 + d.doc_id % 41 + 10 - l.toxic * 10 AS INTEGER) END AS judge_score, d.text
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: turns in order, and chatml content that conv_id bends to be malformed now and then."""
    t = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    rows = t.groupBy("conv_id").agg(turns.alias("turns"))
    messages = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    plain = F.to_json(F.struct(messages.alias("messages")))
    i = F.col("conv_id") % 10
    content = (
        F.when(i == 7, F.to_json(F.struct(messages.alias("messages"), F.lit(1).alias("note"))))
        .when(i == 8, F.to_json(F.struct(F.to_json(messages).alias("messages"))))
        .when(i == 9, F.lit("[]"))
        .when(i == 6, F.to_json(F.struct(F.slice(messages, 1, 1).alias("messages"))))
        .otherwise(plain)
    )
    return rows.select("conv_id", "turns", content.alias("content_json"), F.lit("chatml").alias("format"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logs of fifty jobs."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("job_id"), "event_id", "ts", F.col("event_type").alias("kind"), "value", "props")


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a job catalog."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "interrupted").otherwise("running")
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("format"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        F.col("o_totalprice").alias("cost"), F.col("o_custkey").alias("owner"),
    )


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'interrupted' ELSE 'running' END AS status,
         o_orderpriority AS format, o_orderdate AS created_at, o_orderdate AS updated_at, o_totalprice AS cost, o_custkey AS owner
  FROM orders)"""
