import tracemalloc

import numpy as np
from edges import LONG, doc, documents
from pyspark.sql import functions as F

from dataloom.llm import language_id, quality, queries


def test_classifier_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_quality_classifier(spark, sf).withColumnRenamed("quality", "q").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    clean, toxic, poor = (rows.quality == 1) & (rows.toxic == 0), rows.toxic == 1, rows.quality == 0
    assert rows[clean].keep.mean() > 0.95
    assert rows[toxic].keep.mean() < 0.3
    assert rows[poor].keep.mean() < 0.1


def test_classifier_on_held_out_labels(spark):
    """Fitted on one half of the labels, measured on the other."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    scorers = quality.fit(docs, labels.where(~held))
    marked = docs.select("doc_id", "text").join(labels.where(held).withColumnRenamed("quality", "q"), "doc_id")
    rows = quality.classify(marked, scorers).toPandas()
    clean, toxic, poor = (rows.q == 1) & (rows.toxic == 0), rows.toxic == 1, rows.q == 0
    assert len(rows) > 1500
    assert rows[clean].keep.mean() >= 0.95
    assert rows[toxic].keep.mean() <= 0.12
    assert rows[poor].keep.mean() <= 0.05
    assert all(0 < hit <= 1 for s in scorers for both in s.accuracies.values() for hit in both)


def test_classifier_without_labels(spark):
    """The overlaps of the heuristic labellers alone tell bad shapes from good ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, quality.fit(docs, labels.limit(0))).join(labels.withColumnRenamed("quality", "q"), "doc_id").toPandas()
    assert rows[(rows.q == 1) & (rows.toxic == 0)].keep.mean() > 0.9
    assert rows[rows.q == 0].keep.mean() < 0.2


def test_results_have_names_of_their_own(spark):
    docs = documents(spark, [doc(1, "plain words"), doc(2, "other words")])
    out = quality.classify(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert out.columns == [*docs.columns, "quality_", "toxicity", "keep_"]
    assert all(r["quality"] is None and r["keep"] is None and 0 <= r["quality_"] <= 1 for r in out.collect())


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(8000) < 0.3
    hit = ((0.9, 0.95), (0.7, 0.9), (0.6, 0.99), (0.8, 0.8))
    votes = np.column_stack([np.where(truth, rng.random(8000) < a, rng.random(8000) >= b) for a, b in hit]).astype(np.int8)
    votes[rng.random(votes.shape) < 0.1] = -1
    p, rates = quality.expectation_maximisation(votes, (votes == 1).any(axis=1) * 0.6 + 0.2)
    for (a, b), (x, y) in zip(hit, rates):
        assert abs(x - a) < 0.05 and abs(1 - y - b) < 0.05
    assert ((p > 0.5) == truth).mean() > 0.93


def test_driver_fits_in_blocks():
    """As many rows and places as a fit may have, as bytes: a copy of them in wide numbers alone is 83 MB. Weights equal those of all rows at once."""
    rng = np.random.default_rng(5)
    x = (rng.random((20_000, 519), np.float32) < 0.05).astype(np.int8)
    target, counts = np.clip(x[:, 0] * 0.8 + rng.random(len(x)) * 0.2, 0, 1), rng.integers(1, 4, len(x)).astype(float)
    tracemalloc.start()
    quality.logistic(x, target, counts, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    few, w = np.column_stack([x[:3000], np.ones(3000)]).astype(float), quality.logistic(x[:3000], target[:3000], counts[:3000])
    p = 1 / (1 + np.exp(-few @ w))
    assert np.abs(few.T @ (counts[:3000] * (target[:3000] - p)) - np.append(np.full(519, 0.3), 1e-3) * w).max() < 1e-2  # the slope is 0 at the best weights


def test_classifier_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, None, None, "y"), (None, 0, 1, "z"), (5, 0, None, None)], "doc_id long, quality int, toxic int, text string")
    out = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 15
    for r in out:
        if not (r["text"] or "").strip():
            assert not r["keep_"] and r["quality_"] == 0
    fox = [(r["keep_"], r["quality_"]) for r in out if (r["text"] or "").startswith("The quick")]
    assert len(fox) == 3 and len(set(fox)) == 1  # labelled good once and bad twice: equal texts score alike
    agreed = spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["keep_"] for r in quality.classify(docs, quality.fit(docs, agreed)).collect() if r["doc_id"] == 1] == [True]
    many = documents(spark, [doc(i, "fine words of an article about the sea and the shore" if i % 2 else "$$$ *** ### &&& %%% !!!", None, None) for i in range(200)])
    marks = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    kept = quality.classify(many, quality.fit(many, marks)).where("keep_").collect()
    assert len(kept) == 100 and all(r["doc_id"] % 2 for r in kept)
    empty = documents(spark, [])
    assert quality.classify(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_codewords_are_apart():
    for n in (2, 4, 7, 20):
        code = language_id.codewords(n).astype(int)
        distances = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(distances) >= (1 if n == 2 else code.shape[1] // 4)
        assert all(0 < (c > 0).sum() < n for c in code.T)


def test_language_edges(spark):
    docs = documents(spark)
    codes = language_id.fit(docs)
    got = {(r["doc_id"], r["lang_pred"]): r for r in language_id.identify(docs, codes).collect()}
    assert (2, "und") in got and (3, "und") in got and (4, "und") in got and (9, "und") in got and (6, "und") not in got
    assert all(r["score"] == 0 for (_, lang), r in got.items() if lang == "und")
    nothing = language_id.fit(documents(spark, [doc(1, "text", None)]))
    assert nothing is None and language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    one = language_id.fit(documents(spark, [doc(1, LONG, "en")]))
    assert {r["lang_pred"] for r in language_id.identify(docs, one).collect()} == {"en", "und"}
    assert language_id.identify(documents(spark, []), codes).count() == 0


def test_repeated_ids_and_rows_stay_out_of_the_driver(spark, monkeypatch):
    """20,000 rows of one id: nothing but sums of wrong bits leaves the tasks, and they count as one sample."""
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 200)
    rows = spark.range(20_000).selectExpr("cast(8 as long) as doc_id", "concat('the words of number ', id % 50, if(id % 2 = 0, ' and the other', ' und der andere')) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    codes = language_id.fit(rows, key=F.col("doc_id"))
    got = language_id.identify(rows, codes).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in got} == {"en": 10_000, "de": 10_000}
