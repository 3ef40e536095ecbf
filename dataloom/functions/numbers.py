"""Allocation, bands and display formats as column functions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def allocate(rows: DataFrame, total: Column, group: list[str], proportion: str, order: str, out: str = "allocated") -> DataFrame:
    """Largest-remainder apportionment of `total` within each group; equal remainders go to the later row first.

    Proportions are normalised to sum to one within the group, so that the allocation always sums to the total.
    """
    of_group = W.partitionBy(*group)
    share = F.col(proportion) / F.sum(proportion).over(of_group) * total
    base = F.floor(F.round(share, 9)).cast("long")
    ranked = of_group.orderBy(F.round(share - base, 9).desc(), F.col(order).desc())
    left = total - F.sum("__base").over(of_group)
    marked = rows.withColumn("__base", base).withColumn("__rank", F.row_number().over(ranked))
    return marked.withColumn(out, (F.col("__base") + F.when(F.col("__rank") <= left, 1).otherwise(0)).cast("long")).drop("__base", "__rank")


def even_percents(rows: DataFrame, group: list[str], order: str, out: str = "percent") -> DataFrame:
    """100 in equal whole parts within each group; the first rows by `order` get what is left over. For a part that is added or removed."""
    of_group = W.partitionBy(*group)
    n, place = F.count("*").over(of_group), F.row_number().over(of_group.orderBy(order)) - 1
    return rows.withColumn(out, (F.floor(F.lit(100) / n) + F.when(place < F.lit(100) % n, 1).otherwise(0)).cast("long"))


def adjusted_percents(rows: DataFrame, group: list[str], order: str, chosen: str, value: Column, percent: str = "percent") -> DataFrame:
    """The row marked `chosen` of each group set to `value`, within 1 and what leaves 1 for each other row.

    The others get 1 each and share the rest by their present percents, the largest remainders (equal ones by `order`)
    rounded up; if they have none at present, all that is left is shared evenly.
    """
    of_group = W.partitionBy(*group)
    others = F.count_if(~F.col(chosen)).over(of_group)
    rows = rows.withColumn("__set", F.least(F.greatest(F.floor(value + 0.5), F.lit(1)), 100 - others).cast("long"))
    left = 100 - F.col("__set")
    present = F.sum(F.when(~F.col(chosen), F.col(percent)).otherwise(0)).over(of_group)
    extra = F.greatest(left - others, F.lit(0))
    share = F.when(present > 0, F.col(percent) / present * extra)
    place = F.row_number().over(W.partitionBy(*group, chosen).orderBy(order)) - 1
    rows = rows.withColumn("__others", others).withColumn("__share", F.when(~F.col(chosen), F.round(share, 9))).withColumn("__place", place)
    base = F.floor("__share")
    more = extra - F.sum(F.when(~F.col(chosen), base).otherwise(0)).over(of_group)
    rank = F.row_number().over(W.partitionBy(*group, chosen).orderBy(F.round(F.col("__share") - base, 9).desc(), order))
    by_share = 1 + base + F.when(rank <= more, 1).otherwise(0)
    evenly = F.floor(left / F.col("__others")) + F.when(F.col("__place") < left % F.col("__others"), 1).otherwise(0)
    new = F.when(F.col(chosen), F.col("__set")).when(F.col("__share").isNull(), evenly).otherwise(by_share)
    return rows.withColumn("__new", new.cast("long")).withColumn(percent, F.col("__new")).drop("__set", "__others", "__share", "__place", "__new")


def score_band(score: Column, low: int = 60) -> Column:
    """high from 80, middle from `low` (60 in reports, 50 beside duplicates), else low."""
    return F.when(score.isNull(), "none").when(score >= 80, "high").when(score >= low, "middle").otherwise("low")


def similarity_band(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, "very_high").when(similarity >= 0.9, "high").otherwise("moderate")


def threshold_label(threshold: Column) -> Column:
    return F.when(threshold >= 0.95, "near_identical").when(threshold >= 0.85, "very_similar").when(threshold >= 0.7, "similar").otherwise("loosely_related")


def rate_band(percent: Column) -> Column:
    return F.when(percent >= 90, "good").when(percent >= 70, "fair").otherwise("poor")


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, at most 100; 0 of nothing."""
    return F.when(whole > 0, F.least(F.lit(100), F.round(part * 100.0 / whole).cast("int"))).otherwise(0)


def duration_text(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s."""
    s, two = seconds.cast("long"), lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(s >= 3600, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(s % 60), F.lit("s")))
        .when(s >= 60, F.concat(m.cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def relative_age(seconds: Column) -> Column:
    s = seconds.cast("long")
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" d ago")))
    )


def cost_text(cost: Column) -> Column:
    """Five decimals under a thousandth, else four."""
    return F.when(cost < 0.001, F.format_string("$%.5f", cost)).otherwise(F.format_string("$%.4f", cost))


def secret_preview(secret: Column) -> Column:
    return F.concat(F.lit("..."), F.right(secret, F.lit(4)))


def endpoint_label(name: Column, latency_ms: Column, uptime: Column) -> Column:
    """name · latency · uptime, without the parts that are null."""
    return F.concat_ws(" · ", name, F.concat(latency_ms.cast("string"), F.lit(" ms")), F.concat(uptime.cast("string"), F.lit(" %")))


def shown_models(models: Column) -> Column:
    """The first three models and how many more there are."""
    more = F.greatest(F.size(models) - 3, F.lit(0))
    return F.concat(F.array_join(F.slice(models, 1, 3), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))
