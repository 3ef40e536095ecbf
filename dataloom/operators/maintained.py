"""Report figures kept up to date: partial aggregates that add up, changed by what rows came and went.

The partial aggregate has a row per (job_id, category, score): number of rows, sum, least and most of their tokens. Scores are
whole numbers of a small range, so it is small beside the rows, and every figure of the report follows from it.
Partials of different rows are merged by adding; rows that went are subtracted, and only where a group's least or
most went with them are that group's extremes taken from the rows again.

`MaintainedFigures` keeps the partial aggregate as a versioned table whose snapshots name the version of the examples
they stand for. A stale one is brought up by the rows that were added and removed since; where there is none, or rows were
rewritten meanwhile, it is made from all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataloom.operators import report
from dataloom.sources.versions import VersionedTable

KEYS = ("job_id", "category", "score")


def partial(examples: DataFrame, tokens: str = "completion_tokens", score: str = "judge_score") -> DataFrame:
    """Rows (job_id, category, score, n, tokens_n, tokens_sum, tokens_min, tokens_max); null scores are a group."""
    t = F.col(tokens).cast("long")
    return examples.groupBy("job_id", report.category_or_unknown(F.col("category")).alias("category"), F.col(score).cast("int").alias("score")).agg(
        F.count("*").alias("n"), F.count(t).alias("tokens_n"), F.coalesce(F.sum(t), F.lit(0)).alias("tokens_sum"), F.min(t).alias("tokens_min"), F.max(t).alias("tokens_max"),
    )


def merged(*partials: DataFrame) -> DataFrame:
    """The partial aggregate of the rows of all of them."""
    return reduce(DataFrame.unionByName, partials).groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.sum("tokens_n").alias("tokens_n"), F.sum("tokens_sum").alias("tokens_sum"), F.min("tokens_min").alias("tokens_min"), F.max("tokens_max").alias("tokens_max"),
    )


def _same(a: DataFrame, b: DataFrame, names: dict[str, str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[name]) for k, name in names.items()])


def without(whole: DataFrame, removed: DataFrame, left: DataFrame) -> DataFrame:
    """The partial aggregate `whole` less `removed`, a partial of some of its rows; `left` are the rows that stay.

    Of `left` only the rows of groups that lost their least or most are aggregated.
    """
    names = {k: f"__{k}" for k in KEYS}
    gone = removed.select(*[F.col(c).alias(f"__{c}") for c in removed.columns])
    both = whole.join(gone, _same(whole, gone, names), "left")
    fewer = [(F.col(c) - F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in ("n", "tokens_n", "tokens_sum")]
    hit = F.coalesce((F.col("__tokens_min") <= F.col("tokens_min")) | (F.col("__tokens_max") >= F.col("tokens_max")), F.lit(False))
    rest = both.select(*KEYS, *fewer, "tokens_min", "tokens_max", hit.alias("__hit")).where("n > 0")
    open_ = rest.where("__hit").select(*[F.col(k).alias(name) for k, name in names.items()])
    category = report.category_or_unknown(F.col("category"))
    rows = left.withColumn("__of", category)
    again = rows.join(open_, rows["job_id"].eqNullSafe(open_["__job_id"]) & rows["__of"].eqNullSafe(open_["__category"]) & rows["judge_score"].cast("int").eqNullSafe(open_["__score"]), "left_semi")
    return rest.where("not __hit").drop("__hit").unionByName(partial(again.drop("__of")))


def token_stats(partials: DataFrame) -> DataFrame:
    """As `report.token_stats` of the rows."""
    return (
        partials.groupBy("category")
        .agg(F.sum("n").alias("n"), F.round(F.sum("tokens_sum") / F.sum("tokens_n"), 1).alias("avg_tokens"), F.min("tokens_min").alias("min_tokens"), F.max("tokens_max").alias("max_tokens"))
        .orderBy("category")
    )


def score_counts(partials: DataFrame) -> DataFrame:
    return partials.where("score is not null").groupBy(F.col("score").alias("s")).agg(F.sum("n").alias("c"))


def efficiency(partials: DataFrame, threshold: int) -> DataFrame:
    """As `report.efficiency`, of rows that reach the threshold and scored rows that do not."""
    n, hit = F.col("n"), F.col("score") >= threshold
    counters = partials.groupBy("category").agg(
        F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias("completed"), F.coalesce(F.sum(F.when(~hit, n)), F.lit(0)).alias("skipped"),
    )
    return report.efficiency(counters)


def snapshot(partials: DataFrame, threshold: int) -> DataFrame:
    """The whole report as one JSON row, as `report.snapshot` of the rows."""
    counts = score_counts(partials)
    return report.snapshot_of({
        "tokens": token_stats(partials), "efficiency": efficiency(partials, threshold), "scores": report.summary_of(counts), "histogram": report.histogram_of(counts),
    })


class MaintainedFigures:
    """The partial aggregate of a versioned table of examples, kept at `path`."""

    def __init__(self, examples: VersionedTable, path: str):
        self.examples, self.kept = examples, VersionedTable(examples.spark, path, "job_id")

    def stands_for(self) -> int | None:
        """The version of the examples that the kept aggregate is of; None if there is none."""
        return self.kept.snapshot().note.get("of")

    def refresh(self) -> str:
        """Brings the kept aggregate up to the examples' last version; says how: 'current', 'changed' or 'scratch'."""
        now, of = self.examples.snapshot().version, self.stands_for()
        if of == now:
            return "current"
        how, rows = self._brought_up(of, now)
        self.kept.replace(rows, note={"of": now})
        return how

    def _brought_up(self, of: int | None, now: int) -> tuple[str, DataFrame]:
        left = self.examples.read(now)
        try:
            if of is None:
                raise ValueError("nothing is kept")
            added, removed = self.examples.changes(of, now)
        except ValueError:
            return "scratch", partial(left)
        rows = self.kept.read()
        if added is not None:
            rows = merged(rows, partial(added))
        return "changed", rows if removed is None else without(rows, partial(removed), left)

    def read(self) -> DataFrame:
        """The aggregate of the examples as they are: the kept one if it stands for them, else brought up without being kept."""
        now, of = self.examples.snapshot().version, self.stands_for()
        return self.kept.read() if of == now else self._brought_up(of, now)[1]
