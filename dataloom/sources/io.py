"""Readers and writers: example tables, JSON lines, report files, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataloom.functions import codec
from dataloom.schemas import EXAMPLES


def read_examples(spark: SparkSession, path: str, job_ids: list[str] | None = None) -> DataFrame:
    """Examples written by `write_examples`; a list of jobs prunes partitions."""
    rows = spark.read.schema(EXAMPLES).parquet(path)
    return rows if job_ids is None else rows.where(F.col("job_id").isin(job_ids))


def write_examples(examples: DataFrame, path: str, mode: str = "append") -> None:
    """Partitions by job; a large job is rebalanced over several tasks and files, small ones share a task."""
    examples.hint("rebalance", "job_id").write.mode(mode).partitionBy("job_id").parquet(path)


def oldest_first(examples: DataFrame) -> DataFrame:
    return examples.orderBy("created_at", "seq")


def jsonl_lines(examples: DataFrame, reasoning_format: str | None = None, keep: bool = False) -> DataFrame:
    """One minified JSON line per example in its format, with reasoning inline in the turns, as a list beside them
    ('separate'), or left out. Rows (seq, line), or with `keep` all columns and the line."""
    columns = examples.columns if keep else ["seq"]
    fmt, content = F.col("format"), F.col("content_json")
    line = codec.pruned(content, fmt)
    if reasoning_format:
        turns, thoughts = codec.decode_turns(content, fmt), codec.stored_reasoning(F.col("reasoning"))
        if reasoning_format == "inline":
            line = F.when(F.size(thoughts) > 0, codec.encode_turns(codec.inline_reasoning(turns, thoughts), fmt)).otherwise(line)
        elif reasoning_format == "separate":
            with_list = F.concat(F.expr("substring(line, 1, length(line) - 1)"), F.lit(',"reasoning":'), F.to_json(thoughts), F.lit("}"))
            return examples.withColumn("line", line).withColumn("line", F.when(F.size(thoughts) > 0, with_list).otherwise(F.col("line"))).select(*columns, "line")
        else:
            raise ValueError(f"reasoning format {reasoning_format!r}")
    return examples.select(*columns, line.alias("line"))


def export_jsonl(examples: DataFrame, folder: str, reasoning_format: str | None = None, files: int | None = None) -> int:
    """Writes lines in order of seq over as many files as the data's ranges; returns their number, refuses none."""
    rows = jsonl_lines(examples, reasoning_format)
    n = rows.count()
    if not n:
        raise ValueError("no examples to export")
    ranged = rows.repartitionByRange(files, "seq") if files else rows.repartitionByRange("seq")
    ranged.sortWithinPartitions("seq").select("line").write.mode("overwrite").text(folder)
    return n


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines as (content_json, format), the format told by the keys there are."""
    keys = F.json_object_keys("value")
    fmt = F.when(F.array_contains(keys, "messages"), "chatml").when(F.array_contains(keys, "conversations"), "sharegpt").when(F.array_contains(keys, "instruction"), "alpaca")
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("content_json"), fmt.alias("format"))


def report_lines(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """Ordered lines (place, line) of a sectioned report: title, header, comma-joined rows, blank line; nothing is
    quoted. Sections are small aggregates."""
    spark = sections[0][1].sparkSession
    out = None
    for i, (title, rows) in enumerate(sections):
        head = spark.createDataFrame([(i, 0, title), (i, 1, ",".join(rows.columns))], "section int, place long, line string")
        cells: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
        body = rows.select(F.lit(i).alias("section"), F.monotonically_increasing_id().alias("place"), F.concat_ws(",", *cells).alias("line"))
        body = body.withColumn("place", F.col("place") + 2)
        end = spark.createDataFrame([(i, (1 << 62), "")], "section int, place long, line string")
        part = head.unionAll(body).unionAll(end)
        out = part if out is None else out.unionAll(part)
    return out.orderBy("section", "place").select("line")


def report_json(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.to_json(F.from_json("stats_json", F.schema_of_json(F.lit(snapshot.first()[0]))), {"pretty": "true"}).alias("json"))


def settings_row(settings: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Key-value settings as one row, missing keys from the defaults."""
    return settings.agg(*[F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit(v)).alias(k) for k, v in defaults.items()])


def model_catalog(raw: DataFrame, body: str = "body") -> DataFrame:
    """Rows (id, name, context_length, prompt_price, completion_price) of JSON catalog answers {"data": [...]}."""
    schema = "data array<struct<id:string, name:string, context_length:bigint, pricing:struct<prompt:string, completion:string>>>"
    m = F.explode(F.from_json(body, schema)["data"])
    price = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))
    return raw.select(m.alias("m")).select(
        F.col("m.id").alias("id"), F.coalesce("m.name", "m.id").alias("name"), F.col("m.context_length").alias("context_length"),
        price("m.pricing.prompt").alias("prompt_price"), price("m.pricing.completion").alias("completion_price"),
    )


def endpoint_list(raw: DataFrame, body: str = "body") -> DataFrame:
    """Rows (model_id, endpoint, provider, context_length, latency_ms, uptime, prompt_price, completion_price) of JSON answers
    {"data": {"id", "endpoints": [...]}}, one answer per model; endpoints numbered from 0 as listed. A malformed answer has none."""
    endpoint = "struct<provider_name:string, name:string, context_length:bigint, latency_ms:double, uptime:double, pricing:struct<prompt:string, completion:string>>"
    told = raw.select(F.from_json(body, f"data struct<id:string, endpoints:array<{endpoint}>>")["data"].alias("d"))
    rows = told.select(F.col("d.id").alias("model_id"), F.posexplode("d.endpoints").alias("endpoint", "e"))
    price = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))
    return rows.select(
        "model_id", "endpoint", F.coalesce("e.provider_name", "e.name").alias("provider"), F.col("e.context_length").alias("context_length"), F.col("e.latency_ms").alias("latency_ms"),
        F.col("e.uptime").alias("uptime"), price("e.pricing.prompt").alias("prompt_price"), price("e.pricing.completion").alias("completion_price"),
    )


def model_groups(catalog: DataFrame) -> DataFrame:
    """Models by label within the capitalised prefix of their id."""
    return catalog.select("id", F.coalesce("name", "id").alias("label"), F.initcap(F.split_part("id", F.lit("/"), F.lit(1))).alias("vendor")).orderBy("vendor", "label")
