"""Job catalog: counts, filters, paging, lineage, lookups and derived flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataloom.schemas import ACTIVE, RESUMABLE, TERMINAL
from dataloom.session import checkpointed


def with_counts(jobs: DataFrame, examples: DataFrame) -> DataFrame:
    """Jobs with their number of examples, 0 included; examples are counted before the join."""
    counts = examples.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("n_examples"))
    return jobs.join(counts, "id", "left").withColumn("n_examples", F.coalesce("n_examples", F.lit(0)))


def resumable(jobs: DataFrame, examples: DataFrame) -> DataFrame:
    return with_counts(jobs.where(F.col("status").isin(*RESUMABLE)), examples).where("n_examples > 0").orderBy(F.desc("updated_at"), F.desc("id"))


def interrupted_ghosts(jobs: DataFrame) -> DataFrame:
    """After a restart no job is active: those that were are interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*ACTIVE), "interrupted").otherwise(F.col("status")))


def newest(jobs: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of rows, newest first; equal times by id, descending."""
    if limit is not None and not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 rows")
    rows = jobs.orderBy(F.desc("created_at"), F.desc("id")).offset(offset)
    return rows if limit is None else rows.limit(limit)


def page_after(jobs: DataFrame, created_at, last_id, limit: int) -> DataFrame:
    """The page after a row, by keyset: no rows are read only to be skipped."""
    later = (F.col("created_at") < F.lit(created_at)) | ((F.col("created_at") == F.lit(created_at)) & (F.col("id") < F.lit(last_id)))
    return newest(jobs.where(later), limit)


def flags(status: Column, has_parent: Column, n_examples: Column) -> dict[str, Column]:
    """Derived flags of a job."""
    return {
        "is_terminal": status.isin(*TERMINAL),
        "is_resumable": status.isin(*RESUMABLE) & (n_examples > 0),
        "is_dismissible": status.isin("interrupted", "failed"),
        "can_add_reasoning": (status == "completed") & ~has_parent & (n_examples > 0),
        "can_dedup": (status == "completed") & (n_examples > 1),
    }


def visible(examples: DataFrame, jobs: DataFrame) -> DataFrame:
    """Examples but those not yet enriched of a running reasoning job."""
    running = jobs.where((F.col("status") == "running") & F.col("reasoning_format").isNotNull()).select(F.col("id").alias("job_id"))
    hidden = examples.where(F.col("reasoning").isNull()).join(running, "job_id", "left_semi").select("id")
    return examples.join(hidden, "id", "left_anti")


def portfolio(jobs: DataFrame) -> DataFrame:
    """Completed examples over completed jobs, cost, and numbers of jobs."""
    return jobs.agg(
        F.count("*").alias("n_jobs"), F.count_if(F.col("status").isin("interrupted", "failed")).alias("n_notices"),
        F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("completed"))), F.lit(0)).alias("completed"), F.round(F.sum("cost"), 2).alias("cost"),
    )


def missing(wanted: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Distinct wanted keys that are not present: missing sources, orphan files, models not advertised."""
    return wanted.select(*keys).distinct().join(present, list(keys), "left_anti")


def uncovered(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionAll(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def first_per(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key: endpoints by provider, configs by category, settings by name."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def last_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: the source that a later entry of the same name replaces."""
    return first_per(rows, key, F.desc(order))


#: What states and stages of a job are called.
STATUS_LABELS = {
    "pending": "Pending", "running": "Running", "cancelling": "Cancelling…", "cancelled": "Cancelled", "completed": "Completed", "failed": "Failed",
    "interrupted": "Interrupted",
}
STAGE_LABELS = {
    "pending": "Awaiting start", "generating_topics": "Generating topics", "generating_examples": "Generating examples", "completed": "Completed",
    "cancelled": "Cancelled", "failed": "Generation error", "interrupted": "Interrupted", "merging_copying": "Copying examples",
    "merging_exporting": "Writing JSONL", "merging_computing_stats": "Computing statistics", "reasoning_copying": "Copying source examples",
    "reasoning_generating": "Generating reasoning", "reasoning_exporting": "Writing JSONL", "reasoning_computing_stats": "Computing statistics",
}


def label(name: Column, labels: dict[str, str]) -> Column:
    """What a state or stage is called; an unknown one by its own name."""
    return F.coalesce(F.create_map(*[F.lit(x) for entry in labels.items() for x in entry])[name], name)


def is_full(n_categories: Column, cap: int = 64) -> Column:
    """Whether no category can be added: 64 in a request, 10 in a form."""
    return n_categories >= cap


def listed_models(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Jobs (id, model, ...) with `models`: of a merged job the distinct models of its lineage's leaves, by leaf; else its own.

    edges: (id, source) of merged jobs. Sources that are gone count for nothing; if all are, the job's own model stays.
    """
    leaves = lineage_leaves(edges.join(jobs.select(F.col("id").alias("source")), "source", "left_semi").select("id", "source"))
    of_leaf = leaves.join(jobs.select(F.col("id").alias("leaf"), "model"), "leaf")
    found = joined_models(of_leaf, "root", "model", "leaf")
    return jobs.join(found, F.col("id") == F.col("root"), "left").withColumn("models", F.coalesce("models", "model")).drop("root")


def default_provider(providers: DataFrame) -> DataFrame:
    """The enabled provider marked default, else the first enabled one."""
    return providers.where("enabled").orderBy(F.desc("is_default"), "created_at", "id").limit(1)


def provider_names(routes: DataFrame, providers: DataFrame) -> DataFrame:
    """Display name of (provider_id, route): the provider's name or raw id, and the route if there is one."""
    names = providers.select(F.col("id").alias("provider_id"), "name")
    joined = routes.join(names, "provider_id", "left")
    return joined.withColumn("label", F.concat_ws(" / ", F.coalesce("name", "provider_id"), "route")).drop("name")


def joined_models(rows: DataFrame, key: str, model: str = "model", position: str = "seq") -> DataFrame:
    """Per key the distinct models in order of first appearance, as text."""
    first = rows.groupBy(key, model).agg(F.min(position).alias("p"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p", F.col(model).alias("m")))), lambda x: x["m"])
    return first.groupBy(key).agg(F.array_join(listed, ", ").alias("models"))


def set_sizes(jobs: DataFrame) -> DataFrame:
    """Numbers of distinct formats and of distinct reasoning formats, none being one of them."""
    return jobs.agg(F.count_distinct("format").alias("n_formats"), F.count_distinct(F.coalesce("reasoning_format", F.lit("none"))).alias("n_reasoning_formats"))


def lineage_leaves(edges: DataFrame) -> DataFrame:
    """Rows (root, leaf) of the closure of edges (id, source); sources that have sources are no leaves.

    Every node holds the ends it has reached; each round replaces the ends that have sources by what those have
    reached, so that the distance doubles and the whole closure is never held. After as many rounds as the number of nodes has
    binary digits only cycles are left, which lead nowhere. A source that is not among the ids of the edges is a leaf.
    """
    inner = checkpointed(edges.select(F.col("id").alias("at")).distinct())
    ends = checkpointed(edges.select(F.col("id").alias("root"), F.col("source").alias("at")).distinct())
    for _ in range(inner.count().bit_length() + 1):
        open_ = ends.join(inner, "at", "left_semi")
        if open_.isEmpty():
            break
        further = open_.join(ends.select(F.col("root").alias("at"), F.col("at").alias("next")), "at").select("root", F.col("next").alias("at"))
        ends = checkpointed(ends.join(inner, "at", "left_anti").select("root", "at").union(further).distinct())
    return ends.join(inner, "at", "left_anti").select("root", F.col("at").alias("leaf"))
