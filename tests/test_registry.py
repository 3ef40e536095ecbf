import json

import numpy as np
import pytest
from helpers import rows_of, sql_rows
from pyspark.sql import functions as F

from dataloom import registry
from dataloom.functions import codec
from dataloom.plans import models
from dataloom.sources.tables import conversations

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    got, expected = QUERIES[name](spark, sf_dir).toPandas(), sql_rows(SQL[name], sf_dir)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_only_queries_of_embeddings_and_reasoning_have_no_sql():
    assert set(QUERIES) - set(SQL) == {"x02_embed_texts", "l04_near_duplicates", "l06_enrich"}


def test_embeddings_equal_the_client(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["norm"] for r in QUERIES["x02_embed_texts"](spark, sf_dir).collect()}
    assert got == {i: round(float(np.linalg.norm(np.array(models.hashing_embedding(t or ""), np.float32))), 5) for i, t in texts.items()}


def test_near_duplicates_equal_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    well_formed = rows[(rows.conv_id % 10 < 8) & ((rows.conv_id % 10 != 6) | (rows.groupby("conv_id").cumcount() == 0))]
    texts = {i: "" for i in rows.conv_id.unique()} | {i: " ".join(g.text) for i, g in well_formed.groupby("conv_id")}
    ids = sorted(i for i in texts if texts[i])
    v = np.array([models.hashing_embedding(texts[i]) for i in ids], np.float32)
    sims = v @ v.T
    expected = {(int(ids[a]), int(ids[b])) for a in range(len(ids)) for b in range(a + 1, len(ids)) if sims[a, b] >= 0.85}
    got = {(r["id_a"], r["id_b"]) for r in QUERIES["l04_near_duplicates"](spark, sf_dir).collect()}
    assert {p for p in got if texts[p[0]]} == expected


def test_enrichment_equals_the_client(spark, sf_dir):
    rows = conversations(spark, sf_dir).where("conv_id % 2 = 1")
    turns = codec.decode_turns(F.col("content_json"), F.col("format"))
    n = codec.assistant_turns(turns)
    asked = rows.select(F.col("conv_id").cast("string").alias("id"), n.alias("n"), models.reasoning_prompt(codec.labelled_text(turns), n).alias("prompt")).collect()
    expected = {}
    for r in asked:
        answer = models.StubClient().chat([{"purpose": "reasoning", "prompt": r["prompt"], "attempt": 1}])[0]["content"] if r["prompt"] else ""
        expected[r["id"]] = json.dumps([answer.split("\n", 1)[1]]) if r["n"] == 1 and answer else None
    got = {r["id"]: r["reasoning"] for r in QUERIES["l06_enrich"](spark, sf_dir).collect()}
    assert set(got) == set(expected) and {i: v for i, v in got.items() if v} == {i: v for i, v in expected.items() if v}


def test_prompts_are_whole_texts(spark, sf_dir, monkeypatch):
    asked = []
    chat = registry.models.chat
    monkeypatch.setattr(registry.models, "chat", lambda rows, **options: asked.append(rows) or chat(rows, **options))
    QUERIES["x01_generated_and_validated"](spark, sf_dir)
    texts = {(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert {(r["id"], r["prompt"]) for r in asked[0].collect()} == texts


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
