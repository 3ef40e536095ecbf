import hashlib
import random

import numpy as np
import pytest
from edges import doc, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dataloom.llm import queries, sketches, token_counts

pieces = st.lists(st.sampled_from(["the", " quick", "'s", "'ll", " 're", "\n", "  ", "\t", "É", "日本", "12", "٣", "!?", "<|endoftext|>", "<|end", "\xa0", "à", "😀", "zqxv", " "]), max_size=12).map("".join)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(pieces)
def test_every_prefix_has_the_librarys_count(library, text):
    counter = token_counts._counter(token_counts.vocabulary_path())
    steps = counter.steps(text)
    for n in range(len(text) + 1):
        assert token_counts.tokens_at_prefix(steps, n) == len(library.encode(text[:n], add_special_tokens=False).ids)


def test_counts_of_documents_and_truncation(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op1_token_counts(spark, sf_dir).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)
    row = token_counts.prefix_token_steps(docs.limit(1), "doc_id", "text").first()
    cut = token_counts.longest_prefix_within(row["steps"], 50)
    text = texts[row["doc_id"]]
    assert len(library.encode(text[:cut], add_special_tokens=False).ids) <= 50
    assert all(len(library.encode(text[:n], add_special_tokens=False).ids) > 50 for n in range(cut + 1, min(len(text), cut + 200) + 1))


def test_token_edges(spark):
    rows = token_counts.prefix_token_steps(documents(spark), "doc_id", "text").collect()
    assert len(rows) == 15
    assert all(len(r["steps"]) == 0 and r["n_tokens"] == 0 for r in rows if not r["n_bytes"])
    assert token_counts.prefix_token_steps(documents(spark, []), "doc_id", "text").count() == 0


def brute_shingles(text):
    words = text.encode().translate(sketches.word_hashes.__globals__["LOWER_BY_SPACE"]).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_sketch_estimates_and_merging():
    rng = random.Random(3)
    for n, shift in ((30, 5), (3000, 600), (20_000, 9000)):
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = a[shift:] + [f"v{i}" for i in range(shift)]
        x, y = sketches.sketches([" ".join(a).encode(), " ".join(b).encode()])
        sa, sb = brute_shingles(" ".join(a)), brute_shingles(" ".join(b))
        assert abs(sketches.resemblance(x, y) - len(sa & sb) / len(sa | sb)) < 0.12
        assert abs(sketches.containment(x, y) - len(sa & sb) / len(sa)) < 0.15
        assert abs(sketches.distinct_shingles(x) / len(sa) - 1) < 0.2
    words = sketches.word_hashes([" ".join(a).encode()])[0]
    assert (sketches.merge(sketches.sketch_of_words(words[:10_004]), sketches.sketch_of_words(words[10_000:])) == x).all()
    assert (sketches.from_string(sketches.to_string(x)) == x).all()


def brute_edited(rows):
    """rows in order: (id, text)"""
    out = []
    for i, (id_, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        out.append((id_, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    return out


def check_edited(got, rows):
    expected = brute_edited(rows)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted((str(e[0]), e[1], e[2]) for e in expected)
    by = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    for id_, _, digest, text, edited, following in expected:
        a, e, f = sketches.sketches([text.encode(), edited.encode(), following.encode()])
        r = by[id_, digest]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (sketches.to_string(a), sketches.to_string(e))
        assert r["near_edited"] == sketches.resemblance(a, e) and r["near_next"] == sketches.resemblance(a, f)
        sa, se = brute_shingles(text), brute_shingles(edited)
        assert abs(r["near_edited"] - (len(sa & se) / len(sa | se) if sa | se else 1.0)) < 0.2


def test_edited_pairs_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    check_edited(queries.op10_document_fingerprints(spark, sf_dir).collect(), rows)


def test_edited_pairs_edges(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    # nulls first, then ids; equal ids by text, null text before empty
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    check_edited(sketches.edited_pairs(documents(spark)).collect(), [(i, t or "") for i, t in order])
    check_edited(sketches.edited_pairs(documents(spark, [doc(7, "one text alone here")])).collect(), [(7, "one text alone here")])
    assert sketches.edited_pairs(documents(spark, [])).count() == 0
    prints = sketches.fingerprints(documents(spark)).where("doc_id in (1, 5)").groupBy("fingerprint").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in prints) == [1, 3]
    assert np.isclose(sketches.fingerprints(documents(spark)).where("doc_id = 3").first()["n_shingles"], 0)


def test_edited_pairs_need_whole_number_ids(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    with pytest.raises(TypeError):
        sketches.edited_pairs(docs)
