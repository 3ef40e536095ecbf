"""Changes of stored tables as new tables: upserts, deletions, updates by id, state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upserted(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows and changes, of each key the one greatest in `order`; changes win ties."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    last = W.partitionBy(key).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def deleted(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def with_values(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose `column` is replaced where `values` has the key."""
    new = values.select(F.col(key).alias("__key"), F.col(column).alias("__value"), F.lit(True).alias("__has"))
    joined = rows.join(new, rows[key] == F.col("__key"), "left")
    return joined.withColumn(column, F.when(F.col("__has"), F.col("__value")).otherwise(F.col(column))).select(*rows.columns)


#: State changes that a request may make, by the states they start from.
TRANSITIONS = {
    "cancel": (("pending", "running"), "cancelling"),
    "dismiss": (("interrupted", "failed"), "cancelled"),
    "resume": (("interrupted", "cancelled", "failed"), "running"),
    "finish": (("running",), "completed"),
    "fail": (("pending", "running", "cancelling"), "failed"),
}


def transitioned(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs after requests (id, action): a request that the state does not allow changes nothing. One per job."""
    allowed = None
    for action, (states, to) in TRANSITIONS.items():
        test = (F.col("action") == action) & F.col("status").isin(*states)
        allowed = F.when(test, to) if allowed is None else allowed.when(test, to)
    return jobs.join(requests.select("id", "action"), "id", "left").withColumn("status", F.coalesce(allowed, "status")).select(*jobs.columns)
