import numpy as np
import pyarrow as pa
import pytest
from helpers import rows_of, sql_rows
from pyspark.sql import functions as F

from dataloom import registry
from dataloom.operators import dedup


def clustered(n, per, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // per), dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres[rng.integers(len(centres), size=n)] + 0.08 * rng.normal(size=(n, dim))


def frame(spark, v, extra=()):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + list(extra), "id long, embedding array<double>").repartition(3)


def all_pairs(v, threshold):
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), dedup.FLOOR)
    return {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= threshold, 1)))}


@pytest.mark.parametrize("block, threshold", [(8, 0.9), (50, 0.9), (5000, 0.9), (50, 0.42), (8, -0.1)])
def test_pruned_pairs_equal_all_pairs(spark, block, threshold):
    rng = np.random.default_rng(1)
    copies = np.repeat(rng.normal(size=(1, 24)), 60, 0)  # a fifth of the rows are one vector
    v = np.concatenate([clustered(150, 15), copies, rng.normal(size=(60, 24)), np.zeros((2, 24)), np.full((1, 24), 1e-12)])
    df = frame(spark, v, [(900, None), (901, [float("nan")] * 24), (None, [1.0] * 24)])
    got = [(r["id_a"], r["id_b"]) for r in dedup.similar_pairs(df, threshold, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(v, threshold)


def test_pairs_of_awkward_tables(spark):
    v = clustered(40, 10)
    assert dedup.similar_pairs(frame(spark, v).limit(0), 0.9).collect() == []
    named = frame(spark, v).select(F.concat(F.lit("n"), "id").alias("name"), F.col("embedding").cast("array<float>").alias("vector"))
    got = {(r["id_a"], r["id_b"]) for r in dedup.similar_pairs(named.union(named), 0.9, "name", "vector", 8).collect()}
    assert got == {tuple(sorted((f"n{a}", f"n{b}"))) for a, b in all_pairs(v.astype(np.float32).astype(float), 0.9)}


def test_compared_pairs_grow_slower_than_the_square(spark):
    compared = {n: dedup.pair_plan(frame(spark, clustered(n, 25)), 0.9, block=64)[0].compared() for n in (500, 4000)}
    assert compared[500] < 0.1 * 500 * 499 / 2
    assert compared[4000] < 20 * compared[500]  # eight times the rows, 64 times their pairs
    assert len(all_pairs(clustered(4000, 25), 0.9)) > 10_000


def test_vectors_without_clusters_are_sent_once_to_each_block(spark):
    v = np.random.default_rng(2).normal(size=(3000, 24))
    plan, placed = dedup.pair_plan(frame(spark, v), 0.42, block=300)
    assert dedup._deal(placed, plan).count() <= 12 * len(v)
    got = [(r["id_a"], r["id_b"]) for r in dedup.similar_pairs(frame(spark, v), 0.42, block=300).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(v, 0.42)


def test_pairs_of_a_group_of_copies_come_in_bounded_batches():
    n = 1500
    found = list(dedup._compared(0.9, np.full(n, 3), pa.array(range(n)), np.ones((n, 8))))
    assert sum(x.num_rows for x in found) == n * (n - 1) // 2
    assert max(x.num_rows for x in found) <= 65_536


@pytest.mark.parametrize("block", [40, 5000])
def test_similarities_depend_on_the_two_vectors_alone(spark, block):
    v = np.tile(clustered(60, 15, seed=3).astype(np.float32), (5, 1))
    expected = {}
    for i, a in enumerate(v.astype(float)):
        for j in range(i + 1, len(v)):
            dot = left = right = 0.0
            for x, y in zip(a, v[j].astype(float)):
                dot, left, right = dot + x * y, left + x * x, right + y * y
            expected[i, j] = min(1.0, dot / np.sqrt(left * right))
    rows = frame(spark, v).withColumn("embedding", F.col("embedding").cast("array<float>"))
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in dedup.similar_pairs(rows, 0.9, block=block).collect()}
    assert got == {k: s for k, s in expected.items() if s >= 0.9}


@pytest.fixture(scope="module")
def copies_dir(spark, sf_dir, tmp_path_factory):
    """The vectors three times, with other ids: many pairs are equally similar."""
    folder = tmp_path_factory.mktemp("copies")
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = v.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).withColumn("vec_id", F.col("vec_id") + F.col("copy") * 500).drop("copy")
    shifted.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_by_score_are_in_the_order_of_sql_among_ties(spark, copies_dir):
    got = [tuple(r) for r in registry.queries()["o04_pairs_by_score"](spark, copies_dir).collect()]
    expected = sql_rows(registry.oracle_sql()["o04_pairs_by_score"], copies_dir)
    assert got == list(expected[["id_a", "id_b"]].itertuples(index=False, name=None))


def test_pair_report_is_in_the_order_of_similarity_then_ids(spark, copies_dir):
    got = registry.queries()["j03_pair_report"](spark, copies_dir).toPandas()
    assert rows_of(got) == rows_of(sql_rows(registry.oracle_sql()["j03_pair_report"], copies_dir))
    expected = sql_rows(registry.oracle_sql()["o04_pairs_by_score"], copies_dir)  # the same pairs in that order
    assert got[["id_a", "id_b"]].values.tolist() == expected[["id_a", "id_b"]].values.tolist()


@pytest.mark.parametrize("name", ["f31_lower_scored", "m09_resolved_duplicates"])
def test_what_has_no_order_sorts_no_pairs(spark, copies_dir, name):
    got = registry.queries()[name](spark, copies_dir)
    assert "rangepartitioning" not in plan_of(got)
    assert rows_of(got.toPandas()) == rows_of(sql_rows(registry.oracle_sql()[name], copies_dir))
