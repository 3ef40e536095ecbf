import subprocess
import sys

import corpus_pipeline
from edges import LONG, PASSAGE
from pyspark import AccumulatorParam

from dataloom.llm import decontamination, simhash
from dataloom.llm.common import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, docs, sf_dir):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out[name] = docs
    return out


def test_stages_on_the_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = staged(spark, docs, sf_dir)
    names = [n for n, _ in corpus_pipeline.STAGES]
    counts = [docs.count()] + [out[n].count() for n in names]
    assert all(a >= b for a, b in zip(counts, counts[1:])) and counts[-1] > 0.3 * counts[0]
    for n in names[:-1]:
        assert out[n].columns == docs.columns
    labels = {r["doc_id"]: r for r in table(spark, sf_dir, "labels").collect()}
    kept = {r["doc_id"] for r in out["quality_classifier"].collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1 and not r["toxic"]]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)
    singles = simhash.near_duplicate_classes(out["simhash_near_dedup"])
    assert singles.where("doc_id <> component_id").count() == 0
    assert decontamination.benchmark_hits(out["benchmark_decontamination"], table(spark, sf_dir, "benchmark")).where("size(items) > 0").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_repeated_passage_stays_once(spark):
    docs = spark.createDataFrame([(1, f"some words {PASSAGE} first", "en", "a", 1), (2, f"{PASSAGE} tail of it", "en", "a", 1), (3, PASSAGE, "en", "b", 1)], COLUMNS)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeated_passages(spark, docs, None).collect()}
    assert got == {1: (f"some words {PASSAGE} first", len(f"some words {PASSAGE} first")), 2: ("tail of it", 10)}


EXTRA = ("quality", "Keep", "toxicity", "size", "spans", "key", "target", "row_keep", "Taken")


def awkward(spark):
    good = lambda i: f"document {i} has some plain words of its own about the sea, the shore, number {i} and what {i * 7} ships bring to the harbour"
    rows = [
        (1, LONG, None, None), (1, LONG, None, None), (1, f"{PASSAGE} one", "en", "a"), (1, f"words before {PASSAGE} two", "en", "b"), (1, good(1), "en", "b"),
        (None, good(2), None, "s"), (2, None, "en", None), (3, "", "en", "s"), (4, good(4), "en", None), (4, good(4), "en", None), (None, None, None, None), (5, " \t\n", "en", "s"),
        (6, good(6), "en", "s"), (7, f"one more {PASSAGE} three", "en", "s"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[f"{c}{i}" for c in EXTRA]) for i, r in enumerate(rows)], COLUMNS + "".join(f", `{c}` string" for c in EXTRA))


def test_stages_keep_all_columns_and_tell_rows_apart(spark, sf_dir):
    docs = awkward(spark)
    before = {r["quality"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns
        for r in out.collect():
            was = before[r["quality"]]
            assert all(r[c] == was[c] for c in docs.columns if name != "substring_dedup" or c not in ("text", "n_chars"))


def test_near_duplicates_of_repeated_ids(spark, sf_dir):
    kept = sorted(int(r["quality"][7:]) for r in corpus_pipeline.drop_near_duplicates(spark, awkward(spark), sf_dir).collect())
    assert len(kept) == 9 and len({0, 1} & set(kept)) == 1 and len({8, 9} & set(kept)) == 1 and {2, 3, 4, 5, 12, 13} <= set(kept) and len({6, 7, 10, 11} & set(kept)) == 1


def test_passages_of_repeated_ids(spark, sf_dir):
    """One copy of the passage stays, in the first row by id and text; no unrelated row of that id loses a word."""
    docs = awkward(spark)
    before = {r["quality"]: r["text"] for r in docs.collect()}
    got = {int(r["quality"][7:]): r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, docs, sf_dir).collect()}
    assert got[2] == f"{PASSAGE} one" and got[3] == "words before two" and got[13] == "one more three"
    assert all(got[i] == before[f"quality{i}"] for i in (4, 5, 8, 9, 12)) and len({0, 1} & set(got)) == 1


def test_mix_of_repeated_ids(spark, sf_dir):
    got = {int(r["quality"][7:]): r for r in corpus_pipeline.mix_sources(spark, awkward(spark), sf_dir).collect()}
    by_source = {}
    for r in got.values():
        by_source.setdefault(r["source"], set()).add(r["target_"])
        assert r["taken_"] == r["repetitions"] * r["size_"] and r["repetitions"] <= 2
        assert r["size_"] == len((r["text"] or "").split())
    assert all(len(t) == 1 for t in by_source.values()) and len(by_source) == 4


def test_stages_with_awkward_rows(spark, sf_dir):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    rows = docs.collect()
    assert len(rows) == len({r["quality"] for r in rows}) and {"quality12"} <= {r["quality"] for r in rows}
    assert not {"quality6", "quality7", "quality10", "quality11"} & {r["quality"] for r in rows}
    assert sum(PASSAGE in r["text"] for r in rows) <= 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward(spark).limit(0), sf_dir).count() == 0


def test_workers_get_long_texts_in_small_batches(spark, sf_dir, monkeypatch):
    class Most(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    most, kind = spark.sparkContext.accumulator(0, Most()), type(spark.range(0))
    plain = kind.mapInArrow

    def spied(df, run, schema, *more):
        def seen(batches):
            def sized():
                for batch in batches:
                    most.add(sum(batch.slice(i, 1).nbytes for i in range(batch.num_rows)))
                    yield batch

            return run(sized())

        return plain(df, seen, schema, *more)

    monkeypatch.setattr(kind, "mapInArrow", spied)
    text = "concat_ws(' ', transform(sequence(1, 20000), i -> substr(md5(concat(id, ':', i)), 1, 3 + pmod(i, 4))))"
    docs = spark.range(0, 50, 1, 1).selectExpr("id as doc_id", f"{text} as text", "'en' as lang", "'a' as source", "cast(0 as bigint) as n_chars")
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, sf_dir).write.format("noop").mode("overwrite").save()
        assert most.value < 5 << 20, name
    assert most.value > 1 << 20


HOLDING = """
import re, numpy as np
from dataloom.llm.common import giving_back
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
last = []
def run(batches):
    parts = [np.ones(8000) for _ in range(3000)]
    last.append(np.ones(8000))  # stands behind the others, so that the heap's end can't move
    yield held()
    del parts
before = held()
most = list(giving_back(run)(iter([])))[0]
print(most - before, held() - before)
"""


def test_workers_give_memory_back_after_a_task():
    if sys.platform == "linux":
        most, after = map(float, subprocess.run([sys.executable, "-c", HOLDING], capture_output=True, text=True, check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0]).stdout.split())
        assert most > 150 and after < 20
