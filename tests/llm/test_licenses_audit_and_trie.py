import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from edges import DOC_SCHEMA, doc, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dataloom.llm import filter_audit, license_scan, prefix_trie
from dataloom.llm.license_scan import BLOCK, STEP, Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def scanned(text, templates):
    """(words, {(template, block): containment}, {template: places}) by comparing everything with everything."""
    words = WORD.findall(lower(text or ""))
    matches, places = {}, defaultdict(list)
    for t, template in enumerate(templates):
        wanted = [w.decode() for w in template.words]
        for p in range(len(words)):
            if template.ordered and wanted and words[p : p + len(wanted)] == wanted:
                places[t].append(p)
        for b in range(0, -(-len(words) // STEP)):
            held = set(words[b * STEP : b * STEP + BLOCK]) & set(wanted)
            mine = [p for p in places[t] if b * STEP <= p < (b + 1) * STEP]
            if wanted and len(held) >= template.threshold * len(set(wanted)) - 1e-9 and (mine or not template.ordered):
                matches[t, b] = len(held) / len(set(wanted))
    return len(words), matches, {t: p for t, p in places.items() if p}


def as_scanned(row):
    places = defaultdict(list)
    for m in row["matches"]:
        places[m["template"]] += m["places"]
    return row["n_words"], {(m["template"], m["block"]): m["containment"] for m in row["matches"]}, {t: sorted(p) for t, p in places.items() if p}


TEMPLATES = [
    Template("x", "a b", 1.0, True), Template("y", "a b a", 1.0, True), Template("z", "a b c d e f", 0.5), Template("u", "f e d c b a zz", 0.7), Template("v", "Rare WORD of é", 0.75),
    Template("w", "", 0.5), Template("x", "c", 1.0, True), Template("z", "a a a b c g h i j k", 0.8),
]
words = st.lists(st.sampled_from(["a", "b", "c", "d", "e", "f", "A", "g", "h", "i", "j", "k", "zz", "rare", "word", "of", "é", "filler", "other", "-"]), max_size=300).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=4), st.dictionaries(st.sampled_from([b"a", b"b", b"f", b"rare"]), st.integers(0, 9)))
def test_matches_equal_a_comparison_with_every_template(texts, frequency):
    index = license_scan._Index(TEMPLATES, frequency)
    for text, (n, rows) in zip(texts, license_scan._matches(index, TEMPLATES, [t.encode() for t in texts])):
        row = {"n_words": n, "matches": [{"template": t, "block": b, "containment": same / len(set(TEMPLATES[t].words)), "places": p} for t, b, same, p in rows]}
        assert as_scanned(row) == scanned(text, TEMPLATES)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 10])
def test_scan_of_awkward_rows(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(license_scan, "SLICE_BYTES", slice_bytes)
    notice = "Released under the MIT License. " * 3
    straddling = "w " * (STEP - 1) + "a b c d e f " + "w " * (BLOCK - 3) + "a b"
    rows = [doc(1, straddling), doc(2, None), doc(3, ""), doc(1, straddling), doc(None, notice), doc(4, "a b " * 20_000)]
    docs = documents(spark).unionByName(documents(spark, rows)).repartition(3)
    templates = [*TEMPLATES, *license_scan.PHRASES, *license_scan.NOTICES]
    texts = sorted((r["text"] or "" for r in docs.collect()))
    got = license_scan.scan(docs.select("doc_id", F.col("text").alias("body"), "id", F.lit(1).alias("matches")), templates, text_col="body").collect()
    assert len(got) == len(texts)
    key = lambda x: (x[0], sorted(x[1].items()), sorted(x[2].items()))
    assert sorted((as_scanned(r) for r in got), key=key) == sorted((scanned(t, templates) for t in texts), key=key)
    assert license_scan.scan(documents(spark, []), templates).collect() == []
    assert [r["matches"] for r in license_scan.scan(documents(spark, [doc(1, "a b")]), []).collect()] == [[]]


def test_templates_longer_than_a_block_are_refused(spark):
    with pytest.raises(ValueError):
        license_scan.scan(documents(spark), [Template("long", "w " * (BLOCK - STEP + 1))])


def test_notices_are_labelled():
    texts = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "reserved", "A public version of the license under the rights": "",
    }
    templates = [*license_scan.PHRASES, *license_scan.NOTICES]
    index = license_scan._Index(templates)
    for text, (_, rows) in zip(texts, license_scan._matches(index, templates, [t.encode() for t in texts])):
        assert ",".join(sorted({templates[t].label for t, *_ in rows})) == texts[text]


def audited(rows, labels):
    """The audit by walking every order for every row."""
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    good, toxic = ({x for x, *said in labels if x is not None and said[k] == 1} for k in (0, 1))
    out = defaultdict(lambda: [0] * 6)
    fails_of = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and text in least and doc_id > least[text],
        }
        fails_of.append((lang or "", fails, doc_id in good, doc_id in toxic))
    for part in {p for p, *_ in fails_of}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                row = out[part, order, step]
                for p, fails, g, t in fails_of:
                    if p != part:
                        continue
                    gone = any(fails[x] for x in order[: step - 1])
                    row[0] += not gone and not fails[f]
                    row[1] += not gone and fails[f]
                    row[2] += gone and fails[f]
                    row[3] += fails[f] and sum(fails.values()) == 1
                    row[4] += not gone and fails[f] and g
                    row[5] += not gone and fails[f] and t
    return dict(out)


def test_audit_equals_a_walk_of_every_order(spark):
    rng = random.Random(5)
    texts = [None, "", " \t", "x" * 50, "A B c", " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i % 90}" for i in range(250)), " ".join(f"W{i}" for i in range(220)), "w# " * 210]
    rows = [doc(rng.choice([*range(25), None]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += [doc(100 + i, texts[5], "en") for i in range(40)]  # a large group of copies
    said = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 30, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1), (110, 1, 0), (111, 0, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)).withColumn("part", F.lit("x"))
    docs = documents(spark, rows).withColumn("part", F.lit("clash")).withColumn("digest", F.lit("clash"))
    got = filter_audit.audit(docs, labels).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] for r in got}
    expected = audited(rows, said)
    assert len(got) == len(found) == 3 * 600 and found == expected
    shapley = defaultdict(int)
    for (part, order, step), row in expected.items():
        shapley[part, order[step - 1]] += row[1]
    assert all(r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]] for r in got)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    none = filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count()
    assert none == 0


def trie(sequences):
    """Per node (smallest member, depth): what the operator reports, from {conv: [(role, text), ...]}."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[x] for x in children[path])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def rebuilt(rows):
    """{conv: turns} with the beginnings of the first of every five, from (conv, turn, role, text) without ties."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256")


def tried(spark, rows):
    table = spark.createDataFrame([(*r, 7, "clash") for r in rows], "conv_id long, turn long, role string, text string, key int, parent string").repartition(3)
    conv = F.col("conv")
    turns = prefix_trie.with_borrowed_beginnings(prefix_trie.turns(table), conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8)
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(turns).collect())


@pytest.mark.parametrize("nodes, fan_in, run", [(50_000, 64, 12), (5, 2, 1)])
def test_trie_equals_sets_of_beginnings(spark, monkeypatch, nodes, fan_in, run):
    for name, value in {"TABLE_NODES": nodes, "FAN_IN": fan_in, "END_RUN": run}.items():
        monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["é", "hello", "", None])) for c in range(60) for t in [None, *range(rng.randrange(6))][rng.randrange(2) :]]
    rows += [(c, t, "u", f"same {t}") for c in range(100, 180) for t in range(40)]  # a large group of deep copies
    rows += [(c, t, "u" if t % 2 else "a", f"own {t // 9 * (c % 3)}") for c in range(200, 240) for t in range(12)]
    rows += [(None, 1, "u", "no conversation"), (500, 3, None, None)]
    assert tried(spark, rows) == trie(rebuilt(rows))


def test_trie_of_empty_tables_repeats_and_ties(spark):
    assert tried(spark, []) == []
    assert [r[:4] for r in tried(spark, [(1, 0, "u", "x"), (1, 0, "u", "x")])][0] == (1, 0, None, 1)
    one, other = (tried(spark, [(5, 0, "u", t) for t in texts] + [(10, 0, "u", "y"), (10, 0, "u", "x")]) for texts in ("xy", "yx"))
    assert one == other  # turns of one number have one order, however they come
    turnless = [(7, 0, "u", "short")]
    h = zlib.crc32(b"7") % 9
    assert h > 0 and tried(spark, turnless) == trie({7: []})
