"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source is to have a share of the total in proportion to its weight, but no more than `max_epochs` times its
own size; what a clamped source leaves is shared again by weight until nothing is above its cap. The end of that
process has a closed form: sorted by cap over weight, the clamped sources are a prefix, and the water level is what
remains over the weights that remain. Only one row per source is sorted for it.

A source's target is then met by whole repetitions of all its documents and one fractional repetition: a seeded
random order of its documents (MD5 of seed and id), of which the first are taken until the words wanted are nearest
to half a document. Running sums are taken in two levels, over buckets of the order and within a bucket, so that a
source of any size is spread over the cluster.

Null texts have size 0; a null source is a source of its own, last in order; null ids sort as the empty string.
Repeated rows are rows of their own (among equal ids and sizes it does not matter which is taken). Sources of
size 0 and empty tables have target 0 and no rows, respectively. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataloom.llm.common import checkpointed

#: Runs of anything but white space (space and 9 to 13).
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filling(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size); weights repeat in order of source, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_epochs
    rows = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    upward = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(upward), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(upward), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("clamped", F.col("ratio") <= F.col("level"))
    )
    # the level at the first source that is not clamped holds for all that follow
    rows = rows.withColumn("level", F.min(F.when(~F.col("clamped"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, row_col: str | None = None,
) -> DataFrame:
    """Per row: id, source, size, source_size, target (of its source), repetitions and taken (repetitions times size).

    row_col: a column that tells rows apart, which the result has too; it orders rows of equal id and size.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    row = F.lit(0) if row_col is None else F.col(row_col)
    sized = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("place"), row.alias("row")))
    sized = sized.withColumn("bucket", F.substring("place", 1, 3))
    targets = water_filling(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    wanted = buckets.join(targets, buckets.source.eqNullSafe(targets.source)).select(
        buckets.source, "bucket", "bucket_start", "bucket_size", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"),
    )
    wanted = wanted.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    within = W.partitionBy("source", "bucket").orderBy("place", "id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    sized = sized.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = sized.join(wanted.withColumnRenamed("source", "of").withColumnRenamed("bucket", "part"), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("part")))
    taken_once_more = (F.col("extra") > 0) & (F.col("bucket_start") + F.col("start") + F.col("size") / 2.0 <= F.col("extra"))
    rows = rows.withColumn("repetitions", (F.col("whole") + F.when(taken_once_more, 1).otherwise(0)).cast("long"))
    named = [] if row_col is None else [F.col("row").alias(row_col)]
    return rows.select(*named, F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "repetitions", (F.col("repetitions") * F.col("size")).cast("long").alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sums),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM capped),
final AS (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, round(CASE WHEN ratio <= level THEN cap ELSE (SELECT level FROM final) * weight END, 6) AS target FROM levels),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized)
SELECT p.doc_id, p.size, w.source_size, w.target,
       CAST(p.size * (w.whole + CASE WHEN p.start + p.size / 2.0::DOUBLE <= w.target - w.whole * w.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed p JOIN wanted w ON p.source IS NOT DISTINCT FROM w.source
"""
