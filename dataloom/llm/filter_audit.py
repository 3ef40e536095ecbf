"""Filter interaction audit: what each of five filters removes, at each step of each order, in each part.

Failure flags of all rows are counted once by (part, flags); one SQL CUBE over the five flags and the part of these few
rows then has a row for every subset of filters: the grouping set that keeps the subset's flags, with all of
them false, counts the subset's survivors. A step of an order is the pair of two subsets, before and after its
filter; the 80 such pairs per part are joined, and every order picks its five.

The filters (texts whole, null as empty; words are maximal runs of anything but space and 9 to 13, case-sensitive):
A under 200 words; B distinct words under half of the words; C more than 3 % of the code points in A-Z; D holds one of
#$%&*|; E the same text as a row of smaller id anywhere in the table.

Equal texts are told by SHA-256 and length. Their copies are counted by (text, id) first and by (text, part, flags,
labels) next, both combined map-side, so that a text with any number of copies is a few rows where it meets the
least id. Rows with equal id and text do not fail E by one another; rows without an id neither fail E nor make
others fail it. A document is good or toxic if any row of the labels says so; labels of unknown or null ids count
nothing. Null part and the empty string are one part. An empty table has no parts and no rows; texts of any length are read
whole in the JVM. Only the named columns are read, whatever else the tables have.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataloom.llm.common import checkpointed, text_or_empty

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, JUNK = 200, 50, 3, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows without an id go to so many keys of the join with the labels, which none of them meets.
NO_ID_SALTS = 4096

_SUMS = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The flags that a text alone decides, by filter."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n_words < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT_PERCENT * n_words,
        "C": 100 * capitals > MAX_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(JUNK),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, A..E, n, good, toxic): documents by part, failure flags and, as sums, labels."""
    text = text_or_empty(text_col)
    flags = text_flags(text)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.length(text).alias("chars"), *[c.alias(f) for f, c in flags.items()],
    )
    copies = ["digest", "chars", *flags]
    rows = rows.groupBy("id", "part", *copies).agg(F.count("*").alias("n"))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("is_good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("is_toxic"),
    )
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NO_ID_SALTS))).otherwise(0).cast("int"))
    rows = rows.join(said.withColumn("salt", F.lit(0)), ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("is_good", "is_toxic")})
    alike = rows.groupBy("part", "is_good", "is_toxic", *copies).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
    )
    alike = checkpointed(alike)
    least = alike.groupBy("digest", "chars").agg(F.min("first.id").alias("least"))
    known = alike.join(least, ["digest", "chars"])
    kept = F.col("no_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    return (
        known.withColumn("kept", kept)
        .select("part", *flags, "is_good", "is_toxic", F.explode(F.array(
            F.struct(F.lit(False).alias("E"), F.col("kept").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("kept")).alias("n")),
        )).alias("side"))
        .select("part", *flags, "side.E", "is_good", "is_toxic", F.col("side.n").alias("n"))
        .groupBy("part", *FILTERS)
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_good")).alias("good"), F.sum(F.col("n") * F.col("is_toxic")).alias("toxic"))
    )


def survivors(counts: DataFrame) -> DataFrame:
    """Rows (part, subset, n, good, toxic): what passes every filter of the subset; subsets spelt as in FILTERS, zeros included."""
    cube = counts.cube("part", *FILTERS).agg(F.grouping_id().alias("without"), *[F.sum(c).alias(c) for c in _SUMS])
    # grouping_id has a bit for each column that is summed over, the part's first
    subset = F.concat(*[F.when(F.shiftright("without", len(FILTERS) - 1 - i).bitwiseAND(1) == 0, F.lit(f)).otherwise("") for i, f in enumerate(FILTERS)])
    passes = ~F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in FILTERS])
    found = cube.where((F.shiftright("without", len(FILTERS)) == 0) & passes).select("part", subset.alias("subset"), *_SUMS)
    subsets = ["".join(f for i, f in enumerate(FILTERS) if k >> i & 1) for k in range(1 << len(FILTERS))]
    every = counts.select("part").distinct().select("part", F.explode(F.array(*map(F.lit, subsets))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _SUMS])


def _plan(spark) -> DataFrame:
    """Rows (filter_order, step, filter, before, after): the subsets on both sides of every step of every order."""
    rows = []
    for order in map("".join, permutations(FILTERS)):
        for i, f in enumerate(order):
            rows.append((order, i + 1, f, "".join(sorted(order[:i])), "".join(sorted(order[: i + 1]))))
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before string, after string")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per (part, filter_order, step): what the step's filter removes, and what it would have; see the module.

    kept: rows that pass this and all earlier filters; removed: rows that pass the earlier ones and fail this; redundant:
    rows that fail this and an earlier one; unique_fails: rows that fail this alone; good_lost, toxic_lost: of the
    removed, those with a label; shapley: the filter's removed rows, summed over all orders.
    """
    counts = checkpointed(flagged(docs, labels, id_col, text_col, part_col))
    subsets = checkpointed(survivors(counts))
    plan = _plan(docs.sparkSession)  # 600 rows
    pairs = F.broadcast(plan.groupBy("filter", "before", "after").agg(F.count("*").alias("orders")))
    before = subsets.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in _SUMS])
    after = subsets.select("part", F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_after") for c in _SUMS])
    removed = F.col("n_before") - F.col("n_after")
    steps = before.join(pairs, "before").join(after, ["part", "after"]).withColumn("removed", removed)
    alone = F.col("before") == ""
    last = F.length("after") == len(FILTERS)
    whole = steps.groupBy("part", "filter").agg(
        F.sum(F.when(alone, F.col("removed"))).alias("fails"), F.sum(F.when(last, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    by_pair = steps.join(whole, ["part", "filter"]).select(
        "part", "filter", "before", F.col("n_after").alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"), "shapley",
    )
    return by_pair.join(F.broadcast(plan.drop("after")), ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT coalesce(text, '') AS x, min(doc_id) AS least FROM documents GROUP BY 1),
flags AS (
  SELECT t.part, coalesce(s.good, 0) AS good, coalesce(s.toxic, 0) AS toxic,
    map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
         'C': 100 * (length(t.x) - length(regexp_replace(t.x, '[A-Z]', '', 'g'))) > 3 * length(t.x),
         'D': regexp_matches(t.x, '[#$%&*|]'), 'E': coalesce(t.doc_id > f.least, false)} AS fails
  FROM texts t JOIN firsts f ON t.x = f.x LEFT JOIN said s ON t.doc_id = s.doc_id),
classes AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
here AS (
  SELECT part, filter_order, step, n, good, toxic, filter_order[step] AS f, fails[filter_order[step]] AS fails_it,
    len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda l: l <> filter_order[step] AND fails[l])) > 0 AS fails_other
  FROM classes, steps),
rolled AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_it), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails_it), 0) AS redundant, coalesce(sum(n) FILTER (fails_it AND NOT fails_other), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails_it), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_it), 0) AS toxic_lost
  FROM here GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rolled
"""
