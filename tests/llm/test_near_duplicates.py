import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from edges import LONG, PASSAGE, doc, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from dataloom.llm import passages, queries, simhash
from dataloom.llm.common import LOWER_BY_SPACE, min_label_components, mix, shingle_hashes, word_hashes


def brute_print(text):
    words = (text or "").encode().translate(LOWER_BY_SPACE).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(id, fingerprint) -> component of each row, ids compared with None as greatest"""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        r = find(i)
        if id_ is not None:
            least[r] = min(least.get(r, id_), id_)
    return [least.get(find(i)) for i in range(len(rows))]


def test_masks_cover_every_difference_of_the_radius():
    masks = simhash.covering_masks()
    rng = random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        difference = sum(1 << i for i in rng.sample(range(64), rng.randrange(4)))
        assert any(not m & difference for m in masks)


def test_components_equal_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [(i, brute_print(t)) for i, t in texts.items()]
    expected = {i: (f"{p:016x}", c) for (i, p), c in zip(rows, brute_components(rows))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == expected


@pytest.mark.parametrize("block", [4, 4096])
def test_links_of_dense_buckets_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(60)} | {0, (1 << 64) - 1})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near_links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    names = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in min_label_components(simhash.near_links(df), "a", "b", "root").collect()}
    expected = brute_components(list(enumerate(prints)))
    for i, p in enumerate(prints):
        for j, q in enumerate(prints[:i]):
            assert (expected[i] == expected[j]) == (names.get(p, p) == names.get(q, q))


def test_simhash_edges(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    expected = sorted((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(rows, brute_components(rows)))
    got = simhash.near_duplicate_classes(docs)
    found = got.select("doc_id", simhash.hex_of(got["fp"]).alias("f"), "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in found) == expected
    assert simhash.near_duplicate_classes(documents(spark, [])).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()).count("5") == 1
    plain = documents(spark, [doc(1, "a b c d e f"), doc(2, "a b c d e f"), doc(3, None), doc(4, "")])
    assert sorted(r["doc_id"] for r in simhash.one_of_each(plain).collect()) == [1, 3]


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (49, 50, 51, 120, 400, 0, 30)]
    texts[4][100:160] = texts[3][10:70]
    texts.append(np.full(80, 5, np.uint64))  # ties: the leftmost hash is the least
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for j, (_, of, centre, left, right, _) in enumerate(passages.compact_windows(np.concatenate(texts), offsets, 3, 50)):
        expected = set()
        for d, t in enumerate(texts):
            h = mix(shingle_hashes(t, 5) ^ passages._SEEDS[j])

            def split(a, b, h=h, d=d):
                if b - a + 1 >= 46:
                    m = a + int(np.argmin(h[a : b + 1]))
                    expected.add((d, m, a, b))
                    split(a, m - 1)
                    split(m + 1, b)

            split(0, len(h) - 1)
        assert set(zip(of.tolist(), centre.tolist(), left.tolist(), right.tolist())) == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=1, max_size=40))
def test_nearest_smaller_equals_brute_force(rows):
    """Of texts that follow one another; each place looks within its own."""
    size, new = np.array([x for x, _ in rows], np.uint64), np.array([True, *(n for _, n in rows[1:])])
    text = np.cumsum(new)
    before = passages._nearest(size, -1, new, np.greater)
    after = passages._nearest(size, 1, np.append(new[1:], True), np.greater_equal)
    for i in range(len(size)):
        same = np.flatnonzero(text == text[i])
        assert before[i] == max((j for j in same if j < i and size[j] <= size[i]), default=-1)
        assert after[i] == min((j for j in same if j > i and size[j] < size[i]), default=-1)


def test_texts_without_a_wanted_signature_give_no_windows():
    """The firsts of frequent signatures are looked for without the windows of texts that hold none; none is lost."""
    line = " ".join(f"frequent{i}" for i in range(60))
    texts = [" ".join(f"w{d}x{i}" for i in range(80)) + (f" {line} end{d}" if d % 10 == 0 else "") for d in range(200)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(200)), "text": texts})
    whole = np.concatenate(list(passages._each_windows(iter([batch]), 5, 50)), axis=1)
    names, n = np.unique(whole[0] >> 16, return_counts=True)
    wanted = names[n >= 20]
    some = np.concatenate(list(passages._each_windows(iter([batch]), 5, 50, wanted)), axis=1)
    assert len(wanted) and set(some[1]) == set(range(0, 200, 10))
    assert np.array_equal(*(x[:, np.isin(x[0] >> 16, wanted)] for x in (whole, some)))


def words(text):
    return text.encode().translate(LOWER_BY_SPACE).split()


@pytest.mark.parametrize("hot", [0.001, 0, 1])
def test_every_exact_repeat_of_fifty_words_is_reported(spark, sf_dir, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT_SHARE", hot)
    texts = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()}
    found = queries.op3_substring_dedup(spark, sf_dir).collect()
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["first_word"], r["last_word"]))
        a = texts[r["doc_id"]][r["first_word"] : r["last_word"]]
        b = texts[r["source_id"]][r["source_first_word"] : r["source_last_word"]]
        sa, sb = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert r["source_id"] < r["doc_id"] and len(a) >= 50 and len(b) >= 50
        assert len(sa & sb) / len(sa | sb) >= 0.8 and abs(len(sa & sb) / len(sa | sb) - r["similarity"]) < 1e-9
    seen = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            first = seen.setdefault(tuple(w[i : i + 50]), d)
            if first != d:
                assert any(a <= i and i + 50 <= b for a, b in spans.get(d, [])), (d, first, i)


@pytest.mark.parametrize("hot,parts", [(0.001, 1), (0.001, 24), (0, 5), (1, 7)])
def test_passages_do_not_depend_on_the_layout(spark, monkeypatch, hot, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = sorted(map(tuple, passages.repeated_passages(docs).collect()))
    monkeypatch.setattr(passages, "HOT_SHARE", hot)
    assert len(expected) > 20
    assert sorted(map(tuple, passages.repeated_passages(docs.repartition(parts)).collect())) == expected


def test_near_passages_in_a_large_group_with_a_common_line(spark):
    """1,200 documents hold one line of 30 words; 200 pairs of them share 60 words with the line in them, but for one word."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    line, texts = fresh(30), []
    for _ in range(200):
        before = rng.randrange(31)
        shared = fresh(before) + line + fresh(30 - before)
        near = list(shared)
        near[rng.randrange(5, 55)] = "changed"
        texts += [fresh(rng.randrange(80)) + x + fresh(rng.randrange(80)) for x in (shared, near)]
    texts += [fresh(rng.randrange(80)) + line + fresh(rng.randrange(80)) for _ in range(800)]
    found = passages.repeated_passages(documents(spark, [doc(i, " ".join(t)) for i, t in enumerate(texts)])).collect()
    pairs = {(r["doc_id"], r["source_id"]) for r in found}
    assert all(a % 2 and b == a - 1 and a < 400 for a, b in pairs)
    assert len(pairs) >= 190


@pytest.mark.parametrize("fillers, line, left, right, edits", [(600, 44, 3, 3, 0), (600, 47, 2, 2, 0), (600, 36, 7, 7, 0), (600, 30, 13, 13, 1), (600, 47, 4, 4, 1), (600, 36, 30, 30, 2), (5000, 40, 8, 7, 1)])
def test_passages_around_a_frequent_line(spark, fillers, line, left, right, edits):
    """200 pairs share a frequent line and few words of their own beside it; the line alone is no passage."""
    rng, number = random.Random(1), iter(range(10**9))
    fresh = lambda n: [f"w{next(number)}" for _ in range(n)]
    pad = lambda: fresh(rng.randrange(10, 40))
    common = [f"line{i}" for i in range(line)]
    texts = []
    for _ in range(200):
        one = fresh(left) + common + fresh(right)
        other = list(one)
        for _ in range(edits):
            other[rng.randrange(len(other))] = "changed"
        texts += [pad() + x + pad() for x in (one, other)]
    texts += [pad() + common + pad() for _ in range(fillers)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    confirmed = set()
    for i in range(0, 400, 2):
        a, b = (shingle_hashes(word_hashes([" ".join(texts[j]).encode()])[0], 5).astype(np.uint32) for j in (i, i + 1))
        if passages.common_passages(a, b, 50, 0.8):
            confirmed.add(tuple(sorted((order[i], order[i + 1]))))
    assert len(confirmed) > 190
    found = passages.repeated_passages(documents(spark, [doc(order[i], " ".join(t)) for i, t in enumerate(texts)])).collect()
    pairs = {(r["source_id"], r["doc_id"]) for r in found}
    assert len(confirmed & pairs) >= (0.99 if not edits else 0.95) * len(confirmed)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_planted_near_passages(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(120)
    near = list(passage)
    for i in range(30, 120, 60):  # two words in 120: Jaccard of five-word shingles over 0.8
        near[i] = "changed"
    rows = [doc(1, " ".join(fresh(80) + passage + fresh(50))), doc(2, " ".join(fresh(30) + near + fresh(90))), doc(3, " ".join(fresh(300)))]
    found = passages.repeated_passages(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} == {(2, 1)}
    assert sum(r["last_word"] - r["first_word"] for r in found) >= 100


@pytest.mark.parametrize("n,changed", [(50, [1]), (50, [48]), (51, [0, 50]), (52, [1, 50]), (55, [2, 52]), (60, [1, 58])])
@pytest.mark.parametrize("before,after", [(0, 0), (70, 70), (0, 70), (70, 0)])
def test_edits_in_the_first_and_last_words_of_a_passage(n, changed, before, after):
    rng = np.random.default_rng(n)
    fresh = lambda k: rng.integers(0, 1 << 60, k).astype(np.uint64)
    passage = fresh(n)
    near = passage.copy()
    near[changed] = fresh(len(changed))
    a, b = (shingle_hashes(np.concatenate([fresh(before), p, fresh(after)]), 5) for p in (near, passage))
    found = passages.common_passages(a, b, 50, 0.8)
    assert len(found) == 1
    first, last, s_first, s_last, jaccard = found[0]
    assert last - first >= 46 and s_last - s_first >= 46 and before - 5 <= first and last <= before + n + 5
    mine, theirs = set(a[first:last].tolist()), set(b[s_first:s_last].tolist())
    assert jaccard == len(mine & theirs) / len(mine | theirs) >= 0.8


def test_pairs_that_agree_in_one_hash_are_verified(spark):
    """Near passages of 50 words (similarity 0.804) that share the least hash of one function only."""
    rng, texts = random.Random(4), []
    for _ in range(1500):
        passage = [f"w{rng.randrange(10**7)}" for _ in range(50)]
        texts += [" ".join(passage), " ".join(passage[:20] + ["changed"] + passage[21:])]
    hashed, offsets, *_ = passages.word_hashes([t.encode() for t in texts])
    least = np.stack([value for value, *_ in passages.compact_windows(hashed, offsets)])  # one window per text and function
    once = np.flatnonzero((least[:, ::2] == least[:, 1::2]).sum(axis=0) == 1)
    assert len(once) > 3
    rows = [doc(int(i), texts[i]) for k in once for i in (2 * k, 2 * k + 1)]
    found = passages.repeated_passages(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} == {(2 * k + 1, 2 * k) for k in once.tolist()}


def test_passage_edges(spark):
    docs = documents(spark, [doc(1, None), doc(2, ""), doc(3, f"a {PASSAGE} b"), doc(4, f"c d {PASSAGE} e"), doc(5, PASSAGE), doc(6, LONG), doc(7, LONG), doc(8, "x " * 200), doc(9, "y " + "x " * 300)])
    got = {(r["doc_id"], r["source_id"], r["first_word"], r["last_word"]) for r in passages.repeated_passages(docs).collect()}
    assert {(4, 3, 2, 62), (5, 3, 0, 60), (7, 6, 0, 40_000)} <= got
    assert any(a == 9 and b == 8 for a, b, *_ in got)
    cut = {r["doc_id"]: r["text"] for r in passages.cut_repeated(docs).collect()}
    assert cut[3] == f"a {PASSAGE} b" and cut[4] == "c d e" and cut[5] == "" and cut[1] is None and cut[7] == ""
    assert passages.repeated_passages(documents(spark, [])).count() == 0
    assert passages.repeated_passages(documents(spark)).where("doc_id = 8 and source_id = 7").count() == 1  # ids repeat here


@pytest.mark.parametrize("text,spans,expected", [
    ("a b c d", [(1, 3)], "a d"), ("  a b", [(0, 1)], "b"), ("a b\n", [(0, 2)], ""), ("a\n\nb c", [], "a\n\nb c"), ("a\n\nb c", [(2, 3)], "a\n\nb"), ("", [(0, 1)], ""),
])
def test_cutting_words(text, spans, expected):
    assert passages.without_words(text, spans) == expected
