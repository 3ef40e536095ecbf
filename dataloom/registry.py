"""All queries over the test tables, with the SQL that another engine runs for the same rows.

Keys are operator identifiers and a slug. Every query reads its whole tables; a limit is there only where it is
the feature (a page, the newest rows, a ring of events).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataloom.functions import codec, numbers, text
from dataloom.operators import catalog, cost, curate, dedup, events, merge, mutations, report
from dataloom.plans import models, pipelines
from dataloom.session import checkpointed
from dataloom.sources import io
from dataloom.sources.tables import EXAMPLES_SQL, JOBS_SQL, conversations, event_log, order_jobs, scored_documents, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    import dataloom.registry_more  # noqa: F401  registers itself
    import dataloom.registry_stored  # noqa: F401  registers itself

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import dataloom.registry_more  # noqa: F401  registers itself
    import dataloom.registry_stored  # noqa: F401  registers itself

    return dict(_SQL)


UNKNOWN = "CASE WHEN category = '' THEN 'Unknown' ELSE category END"

# Reports


@query(f"""WITH {EXAMPLES_SQL}
SELECT {UNKNOWN} AS category, count(*) AS n, round(avg(completion_tokens), 1) AS avg_tokens, min(completion_tokens) AS min_tokens,
       max(completion_tokens) AS max_tokens FROM ex GROUP BY 1""")
def a01_token_stats_by_category(spark, sf_dir):
    return report.token_stats(scored_documents(spark, sf_dir))


@query(f"""WITH {EXAMPLES_SQL}
SELECT count(*) AS n, min(judge_score) AS min_score, max(judge_score) AS max_score, round(avg(judge_score), 1) AS mean_score,
       CAST(trunc(median(judge_score)) AS INTEGER) AS median_score FROM ex WHERE judge_score IS NOT NULL""")
def a02_score_summary(spark, sf_dir):
    return report.score_summary(scored_documents(spark, sf_dir))


HISTOGRAM_SQL = f"""WITH {EXAMPLES_SQL},
scored AS (SELECT judge_score AS s FROM ex WHERE judge_score IS NOT NULL),
b AS (SELECT max(s) AS hi, CASE WHEN max(s) - min(s) <= 10 THEN 1 WHEN max(s) - min(s) <= 25 THEN 5 ELSE 10 END AS w FROM scored),
h AS (SELECT CAST(s // w * w AS INTEGER) AS bucket_start, w, hi, count(*) AS n FROM scored, b GROUP BY ALL)
SELECT bucket_start, CASE WHEN w = 1 THEN CAST(bucket_start AS VARCHAR) ELSE bucket_start || '-' || least(bucket_start + w - 1, hi) END AS label, n"""


@query(f"{HISTOGRAM_SQL} FROM h")
def a03_score_histogram(spark, sf_dir):
    return report.score_histogram(scored_documents(spark, sf_dir))


@query(f"{HISTOGRAM_SQL}, greatest(round(n * 100.0 / greatest(max(n) OVER (), 1), 1), 1.0)::DOUBLE AS bar FROM h")
def a22_histogram_bars(spark, sf_dir):
    return report.bars(report.score_histogram(scored_documents(spark, sf_dir)))


COUNTERS_SQL = f"""counters AS (
  SELECT {UNKNOWN} AS category, count(*) FILTER (judge_score >= 60) AS completed, count(*) FILTER (judge_score < 60) AS skipped FROM ex GROUP BY 1)"""


def _counters(spark, sf_dir):
    by = report.category_or_unknown(F.col("category")).alias("category")
    score = F.col("judge_score")
    return scored_documents(spark, sf_dir).groupBy(by).agg(F.count_if(score >= 60).alias("completed"), F.count_if(score < 60).alias("skipped"))


@query(f"""WITH {EXAMPLES_SQL}, {COUNTERS_SQL}
SELECT category, completed, skipped, (CASE WHEN completed + skipped > 0 THEN round(completed * 100.0::DOUBLE / (completed + skipped), 1) ELSE 100.0 END)::DOUBLE AS success_rate
FROM counters""")
def a04_efficiency(spark, sf_dir):
    return report.efficiency(_counters(spark, sf_dir))


SNAPSHOT_SQL = f"""SELECT 'tokens' AS part, category AS name, n, CAST(avg_tokens AS DOUBLE) AS value FROM ({_SQL["a01_token_stats_by_category"]})
UNION ALL SELECT 'efficiency', category, completed, success_rate FROM ({_SQL["a04_efficiency"]})
UNION ALL SELECT 'histogram', label, n, CAST(bucket_start AS DOUBLE) FROM ({_SQL["a03_score_histogram"]})
UNION ALL SELECT 'scores', 'median ' || median_score, n, mean_score FROM ({_SQL["a02_score_summary"]})"""
_PARTS = {
    "tokens": ("category string, n long, avg_tokens double", "category", "n", "avg_tokens"), "efficiency": ("category string, completed long, success_rate double", "category", "completed", "success_rate"),
    "histogram": ("label string, n long, bucket_start double", "label", "n", "bucket_start"), "scores": ("median_score string, n long, mean_score double", "concat('median ', median_score)", "n", "mean_score"),
}


def _snapshot_rows(snapshot, column):
    """The figures that a snapshot's JSON holds, as rows."""
    rows = None
    for part, (schema, name, n, value) in _PARTS.items():
        entries = snapshot.select(F.inline(F.from_json(F.get_json_object(column, f"$.{part}"), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))
        one = entries.selectExpr(f"'{part}' as part", f"{name} as name", f"{n} as n", f"{value} as value")
        rows = one if rows is None else rows.union(one)
    return rows


@query(SNAPSHOT_SQL)
def a05_snapshot(spark, sf_dir):
    return _snapshot_rows(report.snapshot(scored_documents(spark, sf_dir), _counters(spark, sf_dir)), "stats_json")


@query(f"""WITH {EXAMPLES_SQL}
SELECT category, model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(judge_prompt_tokens) AS BIGINT) AS judge_prompt_tokens, CAST(sum(judge_completion_tokens) AS BIGINT) AS judge_completion_tokens
FROM ex GROUP BY 1, 2""")
def a06_usage_sums(spark, sf_dir):
    return cost.usage_by_category_model(scored_documents(spark, sf_dir))


PRICES = [("m0", 1e-6, 2e-6), ("m1", 3e-6, 6e-6)]
JUDGE_PRICES = [("en", 5e-7, 1e-6), ("fr", 4e-7, 9e-7)]


def _prices(spark):
    return (
        spark.createDataFrame(PRICES, "model string, prompt_price double, completion_price double"),
        spark.createDataFrame(JUDGE_PRICES, "category string, judge_prompt_price double, judge_completion_price double"),
    )


PRICES_SQL = """prices(model, pp, cp) AS (VALUES ('m0', 1e-6::DOUBLE, 2e-6::DOUBLE), ('m1', 3e-6::DOUBLE, 6e-6::DOUBLE)),
judges(category, jp, jc) AS (VALUES ('en', 5e-7::DOUBLE, 1e-6::DOUBLE), ('fr', 4e-7::DOUBLE, 9e-7::DOUBLE))"""


@query(f"""WITH {EXAMPLES_SQL}, {PRICES_SQL},
u AS (SELECT category, model, sum(prompt_tokens) AS p, sum(completion_tokens) AS c, sum(judge_prompt_tokens) AS jpt, sum(judge_completion_tokens) AS jct FROM ex GROUP BY 1, 2)
SELECT round(sum(p * coalesce(pp, 0) + c * coalesce(cp, 0)), 6) AS actual_cost, round(sum(jpt * coalesce(jp, 0) + jct * coalesce(jc, 0)), 6) AS judge_cost
FROM u LEFT JOIN prices USING (model) LEFT JOIN judges USING (category)""")
def a07_cost_rollup(spark, sf_dir):
    return cost.cost_rollup(cost.usage_by_category_model(scored_documents(spark, sf_dir)), *_prices(spark))


@query(f"""WITH {EXAMPLES_SQL}, j AS (
  SELECT job_id, CASE WHEN job_id = 'src0' THEN 0 ELSE sum(prompt_tokens) END AS p, CASE WHEN job_id = 'src0' THEN 0 ELSE sum(completion_tokens) END AS c,
         sum(completion_tokens) AS tokens, count(judge_score) AS evaluated FROM ex GROUP BY 1)
SELECT job_id, round(CASE WHEN p + c > 0 THEN p * 1e-6::DOUBLE + c * 2e-6::DOUBLE ELSE tokens * 2e-6::DOUBLE END, 6) AS cost,
       round(CASE WHEN p + c > 0 THEN 0.5::DOUBLE ELSE evaluated * 400 * 1e-6::DOUBLE END, 6) AS judge_cost FROM j""")
def a08_cost_fallback(spark, sf_dir):
    ex = scored_documents(spark, sf_dir)
    recorded = F.col("job_id") != "src0"
    sums = ex.groupBy("job_id").agg(
        F.sum(F.when(recorded, F.col("prompt_tokens")).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(recorded, F.col("completion_tokens")).otherwise(0)).alias("completion_tokens"),
        F.sum("completion_tokens").alias("tokens"), F.count("judge_score").alias("evaluated"),
    )
    priced = sums.select("*", F.lit(1e-6).alias("prompt_price"), F.lit(2e-6).alias("completion_price"), F.lit(1e-6).alias("judge_price"), F.lit(0.5).alias("judge_cost"))
    return cost.cost_with_fallback(priced)


@query(f"""WITH {EXAMPLES_SQL}
SELECT job_id, round(avg(judge_score), 1) AS mean_score FROM ex WHERE judge_score IS NOT NULL GROUP BY 1""")
def a09_mean_score(spark, sf_dir):
    return report.mean_score(scored_documents(spark, sf_dir))


@query(f"WITH {EXAMPLES_SQL} SELECT category, count(*) AS n FROM ex GROUP BY 1")
def a10_count_by_category(spark, sf_dir):
    return scored_documents(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {EXAMPLES_SQL} SELECT count(*) AS n, count(judge_score) AS n_scored FROM ex")
def a11_counts(spark, sf_dir):
    return scored_documents(spark, sf_dir).agg(F.count("*").alias("n"), F.count("judge_score").alias("n_scored"))


@query(f"""WITH {JOBS_SQL}
SELECT count(*) AS n_jobs, count(*) FILTER (status IN ('interrupted', 'failed')) AS n_notices,
       CAST(coalesce(sum(n) FILTER (status = 'completed'), 0) AS BIGINT) AS completed, round(sum(CAST(cost AS DECIMAL(18,2)))::DOUBLE, 2) AS cost
FROM jobs LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) USING (id)""")
def a12_portfolio(spark, sf_dir):
    counted = catalog.with_counts(order_jobs(spark, sf_dir), _lines(spark, sf_dir))
    return catalog.portfolio(counted.withColumn("completed", F.col("n_examples")).withColumn("cost", F.col("cost").cast("decimal(18,2)"))).withColumn("cost", F.col("cost").cast("double"))


@query(f"""WITH {EXAMPLES_SQL}, f AS (SELECT job_id, model, min(seq) AS p FROM ex GROUP BY 1, 2)
SELECT job_id, string_agg(model, ', ' ORDER BY p, model) AS models FROM f GROUP BY 1""")
def a14_models_in_order(spark, sf_dir):
    return catalog.joined_models(scored_documents(spark, sf_dir), "job_id")


@query(f"""WITH {EXAMPLES_SQL}, c AS (SELECT {UNKNOWN} AS name, min(seq) AS position FROM ex GROUP BY 1)
SELECT name, position, CASE WHEN row_number() OVER (ORDER BY position) = count(*) OVER () THEN round(1 - round(1.0::DOUBLE / count(*) OVER (), 4) * (count(*) OVER () - 1), 4)
       ELSE round(1.0::DOUBLE / count(*) OVER (), 4) END AS proportion FROM c""")
def a15_merged_categories(spark, sf_dir):
    rows = scored_documents(spark, sf_dir).groupBy(report.category_or_unknown(F.col("category")).alias("name"), "job_id").agg(F.min("seq").alias("position"))
    return merge.merged_categories(rows.drop("job_id"))


@query(f"""WITH {EXAMPLES_SQL}
SELECT CAST(max(completion_tokens) AS BIGINT) AS max_tokens, max(prompt_tokens % 5 + 1) AS conversation_turns, bool_or(judge_score IS NOT NULL) AS judge_enabled FROM ex""")
def a16_merged_limits(spark, sf_dir):
    ex = scored_documents(spark, sf_dir)
    return merge.merged_limits(ex.select(F.col("completion_tokens").alias("max_tokens"), (F.col("prompt_tokens") % 5 + 1).alias("conversation_turns"), F.col("judge_score").isNotNull().alias("judge_enabled")))


@query(f"""WITH {JOBS_SQL}
SELECT count(DISTINCT format) AS n_formats, count(DISTINCT coalesce(CASE WHEN id % 3 = 0 THEN 'inline' END, 'none')) AS n_reasoning_formats FROM jobs""")
def a17_set_sizes(spark, sf_dir):
    return catalog.set_sizes(order_jobs(spark, sf_dir).withColumn("reasoning_format", F.when(F.col("id") % 3 == 0, "inline")))


ATTEMPTS_SQL = f"""attempts AS (
  SELECT {UNKNOWN} AS category, row_number() OVER (PARTITION BY {UNKNOWN} ORDER BY seq) AS attempt, judge_score AS score,
         coalesce(judge_score >= 80, false) AS accepted, 20 AS target FROM ex)"""


def _attempts(spark, sf_dir):
    by = report.category_or_unknown(F.col("category"))
    ex = scored_documents(spark, sf_dir).select(
        by.alias("category"), "seq", F.col("judge_score").alias("score"), F.coalesce(F.col("judge_score") >= 80, F.lit(False)).alias("accepted"), F.lit(20).alias("target"),
    )
    return merge.numbered_within(ex, "category", ["seq"], "attempt").drop("seq").withColumn("attempt", F.col("attempt").cast("int"))


@query(f"""WITH {EXAMPLES_SQL}, {ATTEMPTS_SQL}
SELECT category, count(score) AS evaluated, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted AND score IS NOT NULL) AS rejected,
       count(*) FILTER (NOT accepted) AS skipped FROM attempts GROUP BY 1""")
def a18_judge_counters(spark, sf_dir):
    score = F.col("judge_score")
    outcomes = scored_documents(spark, sf_dir).select(report.category_or_unknown(F.col("category")).alias("category"), score.alias("score"), F.coalesce(score >= 80, F.lit(False)).alias("accepted"))
    return curate.counters(outcomes)


@query(f"""WITH {EXAMPLES_SQL}
SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM ex WHERE judge_score IS NULL GROUP BY 1""")
def a19_overhead_by_model(spark, sf_dir):
    return cost.usage_by_model(scored_documents(spark, sf_dir).where("judge_score is null"))


@query(f"""WITH {EXAMPLES_SQL}, s AS (SELECT job_id, count(*) AS target, count(judge_score) AS completed FROM ex GROUP BY 1)
SELECT job_id, target, completed, CAST(least(100, round(completed * 100.0 / target)) AS INTEGER) AS percent,
       CASE WHEN completed > 0 THEN CAST(round(600.0::DOUBLE / completed * greatest(target - completed, 0)) AS BIGINT) END AS eta_s FROM s""")
def a20_progress(spark, sf_dir):
    ex = scored_documents(spark, sf_dir)
    counted = ex.groupBy("job_id", "category").agg(F.count("*").alias("target"), F.count("judge_score").alias("completed"))
    return report.progress(counted, 600.0)


@query(f"""WITH {EXAMPLES_SQL}, c AS (SELECT category, count(*)::DOUBLE / sum(count(*)) OVER () AS proportion FROM ex GROUP BY 1)
SELECT round(sum(proportion * 1000 * (2 * (1e-6::DOUBLE * 400 + 2e-6::DOUBLE * (0.6::DOUBLE * 2048)) + (5e-7::DOUBLE * 400 + 1e-6::DOUBLE * 100))), 6) AS estimated_cost FROM c""")
def a21_cost_estimate(spark, sf_dir):
    c = scored_documents(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    c = c.withColumn("proportion", F.col("n") / F.sum("n").over(W.partitionBy()))
    priced = c.select("proportion", F.lit(1e-6).alias("prompt_price"), F.lit(2e-6).alias("completion_price"), F.lit(5e-7).alias("judge_prompt_price"), F.lit(1e-6).alias("judge_completion_price"))
    return cost.estimate(priced, 1000, 2, 2048)


@query(f"""WITH {JOBS_SQL}, c AS (SELECT l_orderkey AS id, count(*) AS n, max(l_shipdate) AS t FROM lineitem GROUP BY 1)
SELECT id, status, coalesce(n, 0) AS n_examples, CASE WHEN status = 'completed' THEN coalesce(t, created_at) END AS ended_at,
       CASE WHEN status = 'completed' THEN greatest(0, CAST(epoch(coalesce(t, created_at)) - epoch(created_at) AS BIGINT)) END AS duration_s
FROM jobs LEFT JOIN c USING (id)""")
def a23_run_summary(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    last = lines.groupBy(F.col("job_id").alias("id")).agg(F.max("shipped").alias("shipped"))
    jobs = order_jobs(spark, sf_dir).join(last, "id", "left")
    return report.run_summary(jobs.withColumn("updated_at", F.coalesce("shipped", "created_at")), lines)


# Catalog


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("shipped"))


@query("SELECT o_orderkey AS id, count(l_orderkey) AS n_examples FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def j01_job_counts(spark, sf_dir):
    return catalog.with_counts(order_jobs(spark, sf_dir), _lines(spark, sf_dir)).select("id", "n_examples")


@query("""SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.42""")
def j02_similar_pairs(spark, sf_dir):
    pairs = dedup.similar_pairs(table(spark, sf_dir, "embeddings"), 0.42, "vec_id")
    return pairs.withColumn("similarity", F.round("similarity", 4))


PAIRS_SQL = """WITH s AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 > 0 THEN CAST(vec_id % 5 AS INTEGER) END AS score, 'vector ' || vec_id AS text FROM embeddings),
p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
      FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.42),
r AS (SELECT id_a, id_b, sim, a.text AS preview_a, b.text AS preview_b, a.score AS score_a, b.score AS score_b,
             CASE WHEN a.score < b.score THEN id_a WHEN b.score < a.score THEN id_b END AS lower_id
      FROM p JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b)"""


def _vector_pairs(spark, sf_dir):
    """Pairs of similar vectors, and the vectors as examples."""
    v = table(spark, sf_dir, "embeddings")
    side = v.select(F.col("vec_id").alias("id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), F.when(F.col("vec_id") % 7 > 0, (F.col("vec_id") % 5).cast("int")).alias("judge_score"))
    return dedup.similar_pairs(v, 0.42, "vec_id"), side


@query(f"{PAIRS_SQL} SELECT id_a, id_b, round(sim, 4) AS similarity_4, preview_a, preview_b, score_a, score_b, lower_id FROM r")
def j03_pair_report(spark, sf_dir):
    return dedup.pair_report(*_vector_pairs(spark, sf_dir)).drop("similarity")


@query(f"{PAIRS_SQL} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT lower_id FROM r WHERE lower_id IS NOT NULL)")
def m09_resolved_duplicates(spark, sf_dir):
    return dedup.resolved(table(spark, sf_dir, "embeddings"), dedup.scored_pairs(*_vector_pairs(spark, sf_dir)), "vec_id").select("vec_id")


@query(f"{PAIRS_SQL} SELECT id_a, id_b FROM r ORDER BY sim DESC, id_a, id_b")
def o04_pairs_by_score(spark, sf_dir):
    pairs = checkpointed(dedup.similar_pairs(table(spark, sf_dir, "embeddings"), 0.42, "vec_id"))  # sorting reads its rows twice
    return pairs.orderBy(F.desc("similarity"), "id_a", "id_b").select("id_a", "id_b")


@query(f"""WITH {EXAMPLES_SQL}, {PRICES_SQL}
SELECT id, round(prompt_tokens * coalesce(pp, 0) + completion_tokens * coalesce(cp, 0), 8) AS cost FROM ex LEFT JOIN prices USING (model)""")
def j04_priced_examples(spark, sf_dir):
    prices, _ = _prices(spark)
    joined = scored_documents(spark, sf_dir).join(F.broadcast(prices), "model", "left")  # a literal table
    return joined.select("id", F.round(F.col("prompt_tokens") * F.coalesce("prompt_price", F.lit(0.0)) + F.col("completion_tokens") * F.coalesce("completion_price", F.lit(0.0)), 8).alias("cost"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j05_orphans(spark, sf_dir):
    return catalog.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j06_missing_sources(spark, sf_dir):
    owners = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return catalog.missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), owners, "id")


@query("""WITH a AS (SELECT DISTINCT p_size AS k FROM part), b AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) + 10 AS k FROM lineitem)
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def j07_category_coverage(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("k"))
    return catalog.uncovered(sizes, table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") + 10).alias("k")), "k")


@query("""SELECT DISTINCT l_suppkey AS provider, l_partkey % 50 AS model FROM lineitem
EXCEPT SELECT s_suppkey, s_nationkey FROM supplier""")
def j08_unadvertised_models(spark, sf_dir):
    required = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("provider"), (F.col("l_partkey") % 50).alias("model"))
    return catalog.missing(required, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider"), F.col("s_nationkey").alias("model")), "provider", "model")


@query("""SELECT c_custkey, CAST(c_nationkey * 2 AS VARCHAR) AS provider_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS route,
       concat_ws(' / ', coalesce(n_name, CAST(c_nationkey * 2 AS VARCHAR)), CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS label
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey * 2""")
def j09_provider_names(spark, sf_dir):
    routes = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 2).cast("string").alias("provider_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("route"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return catalog.provider_names(routes, names)


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j10_live_sources(spark, sf_dir):
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(live, "o_custkey", "left_semi").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS id, doc_id // 3 AS source FROM documents WHERE doc_id > 2),
w AS (SELECT id AS root, source AS node FROM e UNION SELECT w.root, e.source FROM w JOIN e ON w.node = e.id)
SELECT root, node AS leaf FROM w WHERE node NOT IN (SELECT id FROM e)""")
def j11_lineage_leaves(spark, sf_dir):
    edges = table(spark, sf_dir, "documents").where("doc_id > 2")
    return catalog.lineage_leaves(edges.select(F.col("doc_id").alias("id"), F.expr("doc_id div 3").alias("source")))


@query("""SELECT l_suppkey, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_order FROM lineitem GROUP BY 1""")
def j12_first_match(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return catalog.first_per(lines, "l_suppkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("l_suppkey", F.col("l_orderkey").alias("first_order"))


@query("""SELECT n_name AS name, count(DISTINCT c_mktsegment) AS n_configs FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def j13_category_sources(spark, sf_dir):
    configs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return configs.groupBy(F.col("n_name").alias("name")).agg(F.count_distinct("c_mktsegment").alias("n_configs"))


# Filters, flags and order


@query(f"""WITH {JOBS_SQL}, c AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT id, n AS n_examples FROM jobs JOIN c USING (id) WHERE status IN ('interrupted', 'cancelled', 'failed') AND n > 0""")
def p06_resumable(spark, sf_dir):
    return catalog.resumable(order_jobs(spark, sf_dir), _lines(spark, sf_dir)).select("id", "n_examples")


@query(f"""WITH {JOBS_SQL} SELECT id, status FROM jobs WHERE status = 'completed' AND format = '1-URGENT'""")
def p07_filtered_jobs(spark, sf_dir):
    return order_jobs(spark, sf_dir).where("status = 'completed' and format = '1-URGENT'").select("id", "status")


@query(f"""WITH {JOBS_SQL}, ex AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_id, CASE WHEN l_linenumber % 2 = 0 THEN '[]' END AS reasoning FROM lineitem)
SELECT count(*) AS n, CAST(sum(ex.id) AS BIGINT) AS ids FROM ex JOIN jobs ON job_id = jobs.id WHERE NOT (status = 'running' AND reasoning IS NULL)""")
def p05_visible_examples(spark, sf_dir):
    ex = _lines(spark, sf_dir).select((F.col("job_id") * 10 + F.col("line")).alias("id"), "job_id", F.when(F.col("line") % 2 == 0, "[]").alias("reasoning"))
    jobs = order_jobs(spark, sf_dir).withColumn("reasoning_format", F.lit("inline"))
    return catalog.visible(ex, jobs).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH {EXAMPLES_SQL} SELECT id FROM ex WHERE completion_tokens <= 500 AND judge_score >= 80""")
def p10_p11_budget_and_threshold(spark, sf_dir):
    return curate.within_budget(scored_documents(spark, sf_dir), 500, 80).select("id")


@query(f"""WITH {JOBS_SQL}, c AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT jobs.*, coalesce(n, 0) AS n FROM jobs LEFT JOIN c USING (id))
SELECT id, status IN ('completed', 'failed', 'cancelled', 'interrupted') AS is_terminal, status IN ('interrupted', 'cancelled', 'failed') AND n > 0 AS is_resumable,
       status IN ('interrupted', 'failed') AS is_dismissible, status = 'completed' AND id % 2 = 0 AND n > 0 AS can_add_reasoning, status = 'completed' AND n > 1 AS can_dedup FROM j""")
def p16_job_flags(spark, sf_dir):
    rows = catalog.with_counts(order_jobs(spark, sf_dir), _lines(spark, sf_dir))
    return rows.select("id", *[c.alias(n) for n, c in catalog.flags(F.col("status"), F.col("id") % 2 == 1, F.col("n_examples")).items()])


@query("SELECT c_custkey, '...' || right(c_name, 4) AS preview FROM customer")
def p18_secret_preview(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.secret_preview(F.col("c_name")).alias("preview"))


@query(f"""WITH {JOBS_SQL} SELECT id, CASE WHEN status IN ('pending', 'running', 'cancelling') THEN 'interrupted' ELSE status END AS status FROM jobs""")
def s02_interrupted_ghosts(spark, sf_dir):
    return catalog.interrupted_ghosts(order_jobs(spark, sf_dir)).select("id", "status")


@query(f"WITH {JOBS_SQL} SELECT id, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def o02_page(spark, sf_dir):
    return catalog.newest(order_jobs(spark, sf_dir), 50, 100).select("id", "created_at")


@query(f"""WITH {JOBS_SQL}, k AS (SELECT created_at, id FROM jobs ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 99)
SELECT id, created_at FROM jobs WHERE (created_at, id) < (SELECT (created_at, id) FROM k) ORDER BY created_at DESC, id DESC LIMIT 50""")
def o02_keyset_page(spark, sf_dir):
    jobs = order_jobs(spark, sf_dir)
    last = catalog.newest(jobs, 100).tail(1)[0]
    return catalog.page_after(jobs, last["created_at"], last["id"], 50).select("id", "created_at")


@query(f"""WITH {JOBS_SQL} SELECT owner, id, place FROM (
  SELECT owner, id, CAST(row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, id DESC) AS INTEGER) AS place FROM jobs) WHERE place <= 5""")
def w03_latest_per_job(spark, sf_dir):
    return events.latest(order_jobs(spark, sf_dir), 5, "owner").select("owner", "id", "place")


@query("SELECT n_name AS name, n_nationkey AS id FROM nation ORDER BY n_regionkey = 1 DESC, n_nationkey LIMIT 1")
def o05_default_provider(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"), (F.col("n_regionkey") == 1).alias("is_default"), F.lit(0).alias("created_at"), F.lit(True).alias("enabled"))
    return catalog.default_provider(rows).select("name", "id")


@query("""SELECT s_suppkey || '/x' AS id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, s_suppkey || '/x') AS label, CAST(s_suppkey AS VARCHAR) AS vendor FROM supplier""")
def o07_model_groups(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return io.model_groups(s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit("/x")).alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name")))


# Merge


@query(f"""WITH {EXAMPLES_SQL}
SELECT sha256('merged/' || job_id || '/' || id) AS id, row_number() OVER (ORDER BY ex.seq, CAST(id AS VARCHAR)) AS seq, {UNKNOWN} AS category, job_id AS source_job_id
FROM ex WHERE job_id IN ('src1', 'src3', 'src5')""")
def u01_merge_union(spark, sf_dir):
    ex = scored_documents(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return merge.merged(ex, ["src3", "src1", "src5", "src1"], "merged").select("id", "seq", "category", "source_job_id")


@query(f"""WITH {EXAMPLES_SQL}, m AS (SELECT sha256('shuffled/' || job_id || '/' || id) AS id, {UNKNOWN} AS category FROM ex WHERE job_id IN ('src1', 'src3'))
SELECT id, row_number() OVER (ORDER BY md5('11:' || id), id) AS seq, category FROM m""")
def o08_shuffled_merge(spark, sf_dir):
    ex = scored_documents(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return merge.merged(ex, ["src1", "src3"], "shuffled", shuffle_seed=11).select("id", "seq", "category")


@query("""SELECT vendor, min(s_suppkey) AS s_suppkey FROM (SELECT s_nationkey AS vendor, s_suppkey FROM supplier) GROUP BY 1""")
def u03_first_endpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("vendor"), "s_suppkey")
    return catalog.first_per(rows, "vendor", F.col("s_suppkey"))


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def u02_all_models(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("SELECT DISTINCT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def u06_unique_sources(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("k")).distinct()


# Text and content

@query("""WITH v AS (
  SELECT conv_id, count(*) AS n, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS alternates
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY 1)
SELECT conv_id, CASE conv_id % 10 WHEN 7 THEN 'extra_top_keys' WHEN 8 THEN 'wrong_type' WHEN 9 THEN 'not_dict' WHEN 6 THEN 'too_few_turns'
       ELSE CASE WHEN alternates THEN 'ok' ELSE 'role_mismatch' END END AS reason,
       CASE conv_id % 10 WHEN 7 THEN 'extra_top_keys' WHEN 8 THEN 'wrong_type' WHEN 9 THEN 'not_dict' WHEN 6 THEN 'too_few_turns'
       ELSE CASE WHEN n <> 4 THEN 'turn_count_mismatch' WHEN alternates THEN 'ok' ELSE 'role_mismatch' END END AS reason_two_exchanges FROM v""")
def f01_validation_reasons(spark, sf_dir):
    c, fmt = F.col("content_json"), F.col("format")
    return conversations(spark, sf_dir).select("conv_id", codec.validation_reason(c, fmt).alias("reason"), codec.validation_reason(c, fmt, F.lit(2)).alias("reason_two_exchanges"))


@query("""SELECT conv_id, CASE WHEN conv_id % 10 = 7 THEN 'note' ELSE '' END AS dropped FROM conversations GROUP BY conv_id""")
def f02_dropped_keys(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", F.array_join(codec.dropped_keys(F.col("content_json"), F.col("format")), ",").alias("dropped"))


@query("""SELECT conv_id, CASE WHEN conv_id % 10 < 8 THEN count(*) FILTER (conv_id % 10 <> 6 OR turn = least_turn) END AS n_turns,
       CASE WHEN conv_id % 10 < 8 THEN md5(string_agg(role || ':' || text, '|' ORDER BY turn) FILTER (conv_id % 10 <> 6 OR turn = least_turn)) END AS digest
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS least_turn FROM conversations) GROUP BY 1""")
def f03_round_trip(spark, sf_dir):
    """Malformed content has no turns; what is cut to one turn has that, extra keys go."""
    rows = conversations(spark, sf_dir)
    back = codec.decode_turns(codec.pruned(F.col("content_json"), F.col("format")), F.col("format"))
    digest = F.md5(F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "|"))
    return rows.select("conv_id", F.when(F.size(back) > 0, F.size(back)).cast("long").alias("n_turns"), F.when(F.size(back) > 0, digest).alias("digest"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY 1")
def f04_assistant_turns(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", codec.assistant_turns(F.col("turns")).cast("long").alias("n"))


@query("""SELECT conv_id, md5(string_agg(CASE WHEN role = 'assistant' AND n <= 2 THEN '<think>' || chr(10) || 'because ' || n || chr(10) || '</think>' || chr(10) || chr(10) || text ELSE text END, '|' ORDER BY turn)) AS digest
FROM (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1""")
def f06_inline_reasoning(spark, sf_dir):
    turns = codec.inline_reasoning(F.col("turns"), F.array(F.lit("because 1"), F.lit("because 2")))
    return conversations(spark, sf_dir).select("conv_id", F.md5(F.array_join(F.transform(turns, lambda t: t["text"]), "|")).alias("digest"))


@query("SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def f07_embedding_text(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", F.md5(codec.embedding_text(F.col("turns"), F.col("format"))).alias("digest"))


@query("SELECT conv_id, md5(string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def f08_labelled_text(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", F.md5(codec.labelled_text(F.col("turns"))).alias("digest"))


@query("SELECT doc_id, substr(text, 1, 120) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END AS preview FROM documents")
def f09_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("""SELECT conv_id, CASE WHEN length(a) > 60 THEN substr(a, 1, 60) || '…' ELSE a END AS preview
FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS a FROM conversations GROUP BY 1)""")
def f10_first_user_preview(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", codec.first_user_preview(F.col("turns")).alias("preview"))


@query("SELECT DISTINCT role, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' ELSE 'system' END AS normal FROM conversations")
def f12_normal_roles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("role", codec.normal_role(F.col("role")).alias("normal")).distinct()


@query("""SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM documents""")
def f13_without_thinking(spark, sf_dir):
    thinking = F.concat(F.lit("<THINK>\nx\n</think> "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_thinking(thinking)).alias("digest"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f14_salvage_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id") % 4
    answer = (
        F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone.")))
        .when(i == 2, F.concat(F.lit("Answer: "), F.col("props"), F.lit(" as asked"))).otherwise(F.concat(F.lit("  "), F.col("props"), F.lit("\n")))
    )
    return e.select("event_id", F.get_json_object(text.salvage_json(answer), "$.k").cast("long").alias("k"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_partkey - l_suppkey * 20, 0) AS tokens FROM lineitem")
def f15_net_tokens(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.net_completion_tokens(F.col("l_partkey"), F.col("l_suppkey") * 20).alias("tokens"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{M}]+|\\p{N}+|[^\\s\\p{L}\\p{M}\\p{N}]')) AS BIGINT) AS tokens FROM documents""")
def f17_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, CAST(floor(n_chars * 0.9::DOUBLE) AS BIGINT) AS limit_tokens, floor(n_chars / 4.0) <= floor((doc_id % 2000) * 0.9::DOUBLE) AS fits FROM documents""")
def f18_effective_limit(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.effective_limit(F.col("n_chars")).alias("limit_tokens"), text.fits_limit(F.floor(F.col("n_chars") / 4), F.col("doc_id") % 2000).alias("fits"))


@query(f"""WITH {EXAMPLES_SQL}, c AS (SELECT job_id, category, count(*)::DOUBLE AS n FROM ex GROUP BY 1, 2),
s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY job_id) * 100, 9) AS share FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY round(share - floor(share), 9) DESC, category DESC) AS place, 100 - sum(floor(share)) OVER (PARTITION BY job_id) AS remain FROM s)
SELECT job_id, category, CAST(floor(share) + CASE WHEN place <= remain THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM r""")
def f19_largest_remainder(spark, sf_dir):
    c = scored_documents(spark, sf_dir).groupBy("job_id", "category").agg(F.count("*").cast("double").alias("n"))
    return numbers.allocate(c, F.lit(100), ["job_id"], "n", "category").select("job_id", "category", "allocated")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 1 WHEN 0 THEN CASE WHEN floor(o_totalprice / 4000) <= 100 THEN CAST(floor(o_totalprice / 4000) AS INTEGER) END
       WHEN 1 THEN CASE WHEN o_totalprice / 4000 <= 100 THEN CAST(floor(o_totalprice / 4000) AS INTEGER) END END AS score FROM orders""")
def f21_valid_score(spark, sf_dir):
    """Whole numbers, fractions, true and text."""
    price = F.col("o_totalprice") / 4000
    value = F.when(F.col("o_orderkey") % 4 == 0, F.floor(price).cast("string")).when(F.col("o_orderkey") % 4 == 1, price.cast("decimal(20,9)").cast("string"))
    value = value.when(F.col("o_orderkey") % 4 == 2, "true").otherwise('"85"')
    return table(spark, sf_dir, "orders").select("o_orderkey", models.json_score(F.concat(F.lit('{"score": '), value, F.lit("}"))).alias("score"))


PERCENTS_SQL = f"""WITH {EXAMPLES_SQL}, c AS (SELECT job_id, category, count(*) AS n FROM ex GROUP BY 1, 2),
e AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS k, row_number() OVER (PARTITION BY job_id ORDER BY category) - 1 AS i FROM c),
p AS (SELECT *, 100 // k + CASE WHEN i < 100 % k THEN 1 ELSE 0 END AS even, n % 60 AS now, i = 1 AS chosen, least(greatest(30 + len(job_id) % 40, 1), 100 - (k - CASE WHEN k > 1 THEN 1 ELSE 0 END)) AS value FROM e)"""


@query(PERCENTS_SQL + """,
s AS (SELECT *, 100 - value AS remain, greatest(100 - value - (k - 1), 0) AS extra, sum(CASE WHEN chosen THEN 0 ELSE now END) OVER (PARTITION BY job_id) AS present FROM p),
f AS (SELECT *, round(now::DOUBLE / present * extra, 9) AS share FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, chosen ORDER BY round(share - floor(share), 9) DESC, category) AS place,
             extra - sum(CASE WHEN chosen THEN 0 ELSE floor(share) END) OVER (PARTITION BY job_id) AS more FROM f)
SELECT job_id, category, CAST(even AS BIGINT) AS even,
       CAST(CASE WHEN k = 1 THEN even WHEN chosen THEN value ELSE 1 + floor(share) + CASE WHEN place <= more THEN 1 ELSE 0 END END AS BIGINT) AS adjusted FROM r""")
def f20_percents(spark, sf_dir):
    c = scored_documents(spark, sf_dir).groupBy("job_id", "category").agg(F.count("*").alias("n"))
    even = numbers.even_percents(c, ["job_id"], "category", "even")
    second = F.row_number().over(W.partitionBy("job_id").orderBy("category")) == 2
    rows = even.withColumn("chosen", second).withColumn("adjusted", F.col("n") % 60)
    single = F.count("*").over(W.partitionBy("job_id")) == 1
    out = numbers.adjusted_percents(rows.withColumn("single", single), ["job_id"], "category", "chosen", 30 + F.length("job_id") % 40, "adjusted")
    return out.select("job_id", "category", "even", F.when(F.col("single"), F.col("even")).otherwise(F.col("adjusted")).alias("adjusted"))


@query("""WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\\p{L}\\p{M}]+|\\p{N}+|[^\\s\\p{L}\\p{M}\\p{N}]')) AS n FROM documents)
SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN contains(text, '```') THEN 'code_fence' WHEN regexp_matches(text, '^\\s*[{\\[]') THEN 'structured'
       WHEN n < 20 THEN 'too_short' WHEN n > 400 THEN 'too_long' END AS problem FROM t""")
def f22_prose_problem(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.prose_problem(F.col("text")).alias("problem"))


RATIONALES_SQL = """SELECT conv_id, CASE WHEN min(ok) THEN count(*) ELSE 0 END AS n, CASE WHEN min(ok) THEN md5(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '|' ORDER BY turn)) END AS digest FROM (
  SELECT conv_id, turn, text, len(regexp_extract_all(text, '[\\p{L}\\p{M}]+|\\p{N}+|[^\\s\\p{L}\\p{M}\\p{N}]')) BETWEEN 20 AND 400 AND NOT contains(text, '```') AND NOT regexp_matches(text, '^\\s*[{\\[]') AS ok
  FROM conversations WHERE role = 'assistant') GROUP BY 1"""


@query(RATIONALES_SQL)
def f24_rationales(spark, sf_dir):
    spoken = F.filter("turns", lambda t: t["role"] == "assistant")
    answer = F.array_join(F.transform(spoken, lambda t, i: F.concat(F.lit("=== TURN "), (i + 1).cast("string"), F.lit(" ===\n"), t["text"])), "\n")
    rows = conversations(spark, sf_dir).where(F.size(spoken) > 0)
    found = text.rationales(F.concat(F.lit("<think>plan</think>Preamble\n"), answer), F.size(spoken))
    return rows.select("conv_id", F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n"), F.md5(F.array_join(found, "|")).alias("digest")).withColumn("n", F.greatest("n", F.lit(0)))


@query("SELECT doc_id, greatest(n_chars, CAST(floor(n_chars * (doc_id % 5 + 1) / 2.0) AS BIGINT) + 256) AS budget FROM documents")
def f25_reasoning_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.reasoning_budget(F.col("n_chars"), F.col("doc_id") % 5 + 1).alias("budget"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm FROM embeddings")
def f26_vector_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dedup.norm(F.col("embedding")), 9).alias("norm"))


@query(f"""WITH {EXAMPLES_SQL}
SELECT id, CASE WHEN judge_score IS NULL THEN 'none' WHEN judge_score >= 80 THEN 'high' WHEN judge_score >= 60 THEN 'middle' ELSE 'low' END AS report_band,
       CASE WHEN judge_score IS NULL THEN 'none' WHEN judge_score >= 80 THEN 'high' WHEN judge_score >= 50 THEN 'middle' ELSE 'low' END AS pair_band FROM ex""")
def f29_score_bands(spark, sf_dir):
    s = F.col("judge_score")
    return scored_documents(spark, sf_dir).select("id", numbers.score_band(s).alias("report_band"), numbers.score_band(s, 50).alias("pair_band"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_discount >= 0.95 THEN 'very_high' WHEN 1 - l_discount >= 0.9 THEN 'high' ELSE 'moderate' END AS band,
       CASE WHEN l_tax * 12 >= 0.95 THEN 'near_identical' WHEN l_tax * 12 >= 0.85 THEN 'very_similar' WHEN l_tax * 12 >= 0.7 THEN 'similar' ELSE 'loosely_related' END AS label FROM lineitem""")
def f30_similarity_bands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.similarity_band(1 - F.col("l_discount")).alias("band"), numbers.threshold_label(F.col("l_tax") * 12).alias("label"))


@query("""WITH s AS (SELECT doc_id, n_chars AS s FROM documents)
SELECT doc_id, CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's'
                    WHEN s >= 60 THEN s // 60 || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS duration,
       CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' h ago' ELSE s // 86400 || ' d ago' END AS age FROM s""")
def f32_durations(spark, sf_dir):
    s = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", numbers.duration_text(s).alias("duration"), numbers.relative_age(s).alias("age"))


@query("SELECT doc_id, CASE WHEN n_chars * 1.2345678e-6::DOUBLE < 0.001 THEN printf('$%.5f', n_chars * 1.2345678e-6::DOUBLE) ELSE printf('$%.4f', n_chars * 1.2345678e-6::DOUBLE) END AS cost FROM documents")
def f33_cost_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numbers.cost_text(F.col("n_chars") * 1.2345678e-6).alias("cost"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN json_extract_string(props, '$.k') || ' of 9 examples copied' WHEN 'error' THEN 'merge_failed {''reason'': ''none''}' ELSE event_type || ' {}' END AS message,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'info' ELSE 'warn' END AS level FROM events""")
def f35_event_messages(spark, sf_dir):
    """A known kind, one without a name of its template, and unknown ones."""
    e = event_log(spark, sf_dir)
    kind = F.when(F.col("kind") == "click", "merge_copy_batch").when(F.col("kind") == "error", "merge_failed").otherwise(F.col("kind"))
    meta = F.when(F.col("kind") == "click", F.create_map(F.lit("done"), F.get_json_object("props", "$.k"), F.lit("total"), F.lit("9")))
    meta = meta.when(F.col("kind") == "error", F.create_map(F.lit("reason"), F.lit("none"))).otherwise(F.create_map().cast("map<string,string>"))
    return e.select("event_id", events.message_of(kind, meta).alias("message"), events.level_of(kind).alias("level"))


@query("SELECT page_id, CAST(len(string_split(html, '<p>')) AS BIGINT) AS n_segments, CAST(len(string_split(html, '<p>')) // 2 AS BIGINT) AS n_code, md5(array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i % 2 = 1 THEN 'text::' || p[i] WHEN contains(p[i], chr(10)) THEN 'code:' || split_part(p[i], chr(10), 1) || ':' || substr(p[i], strpos(p[i], chr(10)) + 1) ELSE 'code:' || p[i] || ':' END), '|')) AS digest FROM (SELECT *, string_split(html, '<p>') AS p FROM pages)")
def f36_code_segments(spark, sf_dir):
    parts = text.code_segments(F.replace("html", F.lit("<p>"), F.lit("```")))
    told = F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["language"], p["body"]))
    return table(spark, sf_dir, "pages").select("page_id", F.size(parts).cast("long").alias("n_segments"), F.size(F.filter(parts, lambda p: p["kind"] == "code")).cast("long").alias("n_code"), F.md5(F.array_join(told, "|")).alias("digest"))


@query("""SELECT conv_id, CAST(count(*) + count(*) FILTER (role = 'assistant' AND n <= 2) AS BIGINT) AS n_turns,
  md5(string_agg(CASE WHEN role = 'assistant' AND n <= 2 THEN 'reasoning:' || chr(96 + n::INT) || '|' ELSE '' END || role || ':' || text, '|' ORDER BY turn)) AS digest
FROM (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1""")
def f46_interleaved_reasoning(spark, sf_dir):
    shown = codec.interleaved_reasoning(F.col("turns"), F.array(F.lit("a"), F.lit("b")))
    told = F.transform(shown, lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return conversations(spark, sf_dir).select("conv_id", F.size(shown).cast("long").alias("n_turns"), F.md5(F.array_join(told, "|")).alias("digest"))


@query("""SELECT s_suppkey, concat_ws(' · ', s_name, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey || ' ms' END, CASE WHEN s_suppkey % 2 > 0 THEN '99 %' END) AS label FROM supplier""")
def f48_endpoint_labels(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", numbers.endpoint_label(F.col("s_name"), F.when(k % 3 > 0, k), F.when(k % 2 > 0, 99)).alias("label"))


@query("""WITH m AS (SELECT l_orderkey, list(DISTINCT 'm' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0')) AS l FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(l)[1:3], ', ') || CASE WHEN len(l) > 3 THEN ' +' || (len(l) - 3) ELSE '' END AS models FROM m""")
def f45_shown_models(spark, sf_dir):
    name = F.concat(F.lit("m"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(name)).alias("m"))
    return rows.select("l_orderkey", numbers.shown_models(F.col("m")).alias("models"))


# Event log, curation and changes


@query("""WITH s AS (SELECT user_id % 50 AS job_id, event_id, CAST(row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS INTEGER) AS seq, count(*) OVER (PARTITION BY user_id % 50) AS n FROM events)
SELECT job_id, event_id, seq FROM s WHERE seq > n - 20""")
def w01_event_ring(spark, sf_dir):
    return events.tail(event_log(spark, sf_dir)).select("job_id", "event_id", "seq")


@query("""WITH s AS (SELECT user_id % 50 AS job_id, event_id, CAST(row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS INTEGER) AS seq FROM events)
SELECT job_id, event_id, seq FROM s WHERE seq > 150""")
def w02_events_after(spark, sf_dir):
    return events.after(events.sequenced(event_log(spark, sf_dir)), 150).select("job_id", "event_id", "seq")


@query(f"""WITH {EXAMPLES_SQL}, {ATTEMPTS_SQL},
r AS (SELECT *, coalesce(sum(accepted::INT) OVER (PARTITION BY category ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM attempts)
SELECT category, CAST(attempt AS INTEGER) AS attempt, accepted FROM r WHERE before < target AND attempt <= 5 * target""")
def w04_target_seek(spark, sf_dir):
    return curate.seek_target(_attempts(spark, sf_dir)).select("category", "attempt", "accepted")


@query("""SELECT user_id, CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS failed, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def m06_upserted(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("failed"))
    failed = e.groupBy("user_id").agg(F.max("failed").alias("failed"))
    rows = e.select("user_id", "event_id", "value")
    half = F.col("event_id") % 2 == 0
    return mutations.upserted(rows.where(half), rows.where(~half), "user_id", "event_id").join(failed, "user_id").select("user_id", "failed", "value")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def m04_deleted(spark, sf_dir):
    return mutations.deleted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def m03_updated_values(spark, sf_dir):
    values = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return mutations.with_values(table(spark, sf_dir, "documents").select("doc_id", "lang"), values, "doc_id", "lang")


@query(f"""WITH {JOBS_SQL} SELECT id, CASE WHEN id % 3 = 0 AND status = 'running' THEN 'cancelling' WHEN id % 3 = 1 AND status = 'interrupted' THEN 'cancelled'
       WHEN id % 3 = 2 AND status = 'interrupted' THEN 'running' ELSE status END AS status FROM jobs""")
def m10_transitions(spark, sf_dir):
    jobs = order_jobs(spark, sf_dir)
    action = F.when(F.col("id") % 3 == 0, "cancel").when(F.col("id") % 3 == 1, "dismiss").otherwise("resume")
    return mutations.transitioned(jobs, jobs.select("id", action.alias("action"))).select("id", "status")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def t05_unfinished(spark, sf_dir):
    return curate.unfinished(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("""SELECT c_custkey % 10 AS job_id, c_custkey AS category, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'c' END, CASE WHEN c_custkey % 10 > 4 THEN 'j' END, 'd') AS provider,
       coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'cj' END, CASE WHEN c_custkey % 10 = 7 THEN 'jj' END, CASE WHEN c_custkey % 2 = 0 THEN 'c' END, CASE WHEN c_custkey % 10 > 4 THEN 'j' END, 'd') AS judge_provider
FROM customer""")
def x07_resolved_providers(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select((k % 10).alias("job_id"), k.alias("category"), F.when(k % 2 == 0, "c").alias("provider_id"), F.when(k % 3 == 0, "cj").alias("judge_provider_id"))
    j = spark.range(10).select(F.col("id").alias("job_id"), F.when(F.col("id") > 4, "j").alias("provider_id"), F.when(F.col("id") == 7, "jj").alias("judge_provider_id"))
    return curate.resolved_providers(c, j, "d")


# Sources, sinks and model operators


@query("""SELECT event_type || ',' || count(*) || ',' || max(user_id) AS line FROM events GROUP BY event_type
UNION ALL SELECT 'Events' UNION ALL SELECT 'kind,n,top' UNION ALL SELECT ''""")
def s10_report_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("user_id").alias("top"))
    return io.report_lines([("Events", rows)])


@query(SNAPSHOT_SQL)
def s11_report_json(spark, sf_dir):
    """The figures of the report, read back from its indented JSON."""
    return _snapshot_rows(io.report_json(report.snapshot(scored_documents(spark, sf_dir), _counters(spark, sf_dir))), "json")


@query("""SELECT coalesce(max(CASE WHEN n_name = 'NATION_1' THEN CAST(n_regionkey AS VARCHAR) END), 'none') AS "NATION_1", coalesce(max(CASE WHEN n_name = 'threshold' THEN '' END), '80') AS threshold FROM nation""")
def s07_settings(spark, sf_dir):
    kv = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return io.settings_row(kv, {"NATION_1": "none", "threshold": "80"})


@query("""SELECT 's/' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 's/' || s_suppkey END AS name, s_suppkey * 10 AS context_length,
       CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_suppkey / 1000.0::DOUBLE END::DOUBLE AS prompt_price, 0.0::DOUBLE AS completion_price FROM supplier""")
def s17_model_catalog(spark, sf_dir):
    k = F.col("s_suppkey")
    price = F.when(k % 3 == 0, "free").otherwise((k / 1000).cast("string"))
    m = F.struct(
        F.concat(F.lit("s/"), k.cast("string")).alias("id"), F.when(k % 2 == 0, F.col("s_name")).alias("name"), (k * 10).alias("context_length"),
        F.struct(price.alias("prompt"), F.lit(None).cast("string").alias("completion")).alias("pricing"),
    )
    bodies = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey")).agg(F.to_json(F.struct(F.collect_list(m).alias("data"))).alias("body"))
    return io.model_catalog(bodies)


@query("SELECT 'a/' || n AS id FROM (VALUES ('small'), ('large')) t(n)")
def s19_embedding_models(spark, sf_dir):
    return spark.createDataFrame([("a/small",), ("a/large",)], "id string")


@query()
def x02_embed_texts(spark, sf_dir):
    return models.embed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.round(dedup.norm(F.col("embedding")), 5).alias("norm"))


def _topics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), "doc_id", F.col("text").alias("topic"))
    return merge.numbered_within(rows, "category", ["doc_id"], "attempt").select("category", F.col("attempt").cast("int").alias("attempt"), "topic", F.lit(10).alias("target"))


def _byte(text: str, i: int) -> str:
    return f"CAST('0x' || substr(sha256({text}), {2 * i + 1}, 2) AS INTEGER)"


def generate_sql(topics: str, budget: int, target: str) -> str:
    """What a run makes of the stub client's answers, from rows t (category, attempt, topic): the outline of each topic, which try is
    valid, what it says, and what three judge calls make of it."""
    outline = "'List up to four points, as a JSON array of strings, that an example of the category ' || category || ' covers on: ' || coalesce(topic, 'null')"
    said = lambda p, n: f"""'{{"messages": [{{"role": "user", "content": ' || CAST(to_json('About ' || {p} || '?') AS VARCHAR) || '}}, {{"role": "assistant", "content": "Answer ' || substr(sha256('example|' || {p} || '|{n}'), 1, 8) || '."}}]}}'"""
    good = lambda p, n: f"{_byte(f"'example|' || {p} || '|{n}'", 1)} % 8 > 0 AND (length(said_{n}) + 18) // 4 + 1 <= 2048"
    point = lambda i: f"'point ' || {_byte("'outline|' || outline || '|1'", i)}"
    return f"""WITH {topics},
n AS (SELECT *, {outline} AS outline FROM t WHERE attempt <= {budget} * {target}),
p AS (SELECT *, 'Write one chatml training example of 1 exchanges on: ' || coalesce(topic, 'null') || '.' || CASE {_byte("'outline|' || outline || '|1'", 0)} % 6 WHEN 0 THEN ''
    WHEN 1 THEN ' Cover: ' || {point(0)} || '.' WHEN 2 THEN ' Cover: ' || {point(0)} || '; ' || {point(1)} || '.' WHEN 3 THEN ' Cover: ' || {point(0)} || '; ' || {point(1)} || '; ' || {point(2)} || '.'
    ELSE ' Cover: ' || {point(0)} || '; ' || {point(1)} || '; ' || {point(2)} || '; ' || {point(3)} || '.' END || ' Use at most 1433 tokens. Answer with JSON only.' AS prompt FROM n),
q AS (SELECT *, prompt || chr(10) || chr(10) || 'Keep the answer within 1638 tokens.' AS again FROM p),
a AS (SELECT *, {said("prompt", 1)} AS said_1, {said("again", 2)} AS said_2 FROM q),
c AS (SELECT *, 'Score this training example from 0 to 100. Answer as {{"score": n}}.' || chr(10) || chr(10) || CASE WHEN {good("prompt", 1)} THEN said_1 WHEN {good("again", 2)} THEN said_2 END AS judging FROM a),
s AS (SELECT *, {", ".join(f"50 + {_byte(f"'judge|' || judging || '|{i}'", 0)} % 51 AS s{i}" for i in (1, 2, 3))} FROM c),
o AS (SELECT *, coalesce(greatest(s1, s2, s3) >= 80, false) AS accepted, CASE WHEN s1 >= 80 THEN s1 WHEN s2 >= 80 THEN s2 ELSE s3 END AS score FROM s),
r AS (SELECT *, coalesce(sum(accepted::INT) OVER (PARTITION BY category ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
made AS (SELECT * FROM r WHERE before < {target})"""


L01_SQL = (
    generate_sql("t AS (SELECT source AS category, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS attempt, text AS topic FROM documents)", 5, "10")
    + " SELECT category, CAST(attempt AS INTEGER) AS attempt, accepted, CAST(score AS INTEGER) AS score FROM made"
)


@query(L01_SQL)
def l01_generate(spark, sf_dir):
    return pipelines.generate(_topics(spark, sf_dir), "chatml", 80).select("category", "attempt", "accepted", "score")


@query()
def l04_near_duplicates(spark, sf_dir):
    rows = conversations(spark, sf_dir).withColumn("id", F.col("conv_id")).withColumn("judge_score", (F.col("conv_id") % 101).cast("int"))
    return pipelines.near_duplicates(rows, 0.85).select("id_a", "id_b", "similarity_4", "lower_id")


@query()
def l06_enrich(spark, sf_dir):
    rows = conversations(spark, sf_dir).withColumn("id", F.col("conv_id").cast("string"))
    return pipelines.enrich(rows, rows.where("conv_id % 2 = 0").select("id"))
