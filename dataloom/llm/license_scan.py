"""License scans: an exact set-similarity join of text blocks with templates, by containment.

A text is read as blocks of `BLOCK` words, one every `STEP`: any run of `BLOCK - STEP + 1` words lies whole in one. A
template of n distinct words meets a block that holds at least ceil(t * n) of them, t being its threshold. Words are
ordered by the number of blocks of the whole corpus that hold them, rarest first (ties by word); that is counted
for the words of templates, the only ones that a template's order can hold. Then

* prefix filter: a block that meets a template holds one of its n - ceil(t * n) + 1 rarest words. These alone are indexed,
  so the frequent words of a language propose nothing;
* length filter: the block has at least ceil(t * n) words that templates know;
* positional filter: behind the first agreeing word, at place p of the template and q of the block (both in that order),
  no more can agree than the shorter of the two rests.

What passes is counted exactly and then compared as bytes. A template with `ordered` is a phrase: its places are the
starts, in the whole text, of its words standing consecutively, and it matches only where there is one.

Result: one row per row of the texts, in a stream over batches, with the matches of its blocks; nothing is shuffled but the
count of template words. Templates go to the tasks in slices of at most `SLICE_BYTES`, each a pass of its own. Words are runs
of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. Null and empty texts have no words and no
matches; templates without words match nothing. Texts of any length are read whole; rows are not told apart, so
repeated rows and ids each have their result. Other columns of the texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataloom.llm.common import LOWER_BY_WORD, text_slices, word_hashes

BLOCK, STEP = 128, 64
#: Bytes of templates that are in a worker at once.
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Template:
    """What is looked for: a label, its words, the least share of its distinct words, and whether they stand in order."""

    label: str
    text: str
    threshold: float = 0.8
    ordered: bool = False

    @property
    def words(self) -> list[bytes]:
        return self.text.encode().translate(LOWER_BY_WORD).split()

    @property
    def needed(self) -> int:
        """Distinct words that a block must hold; 1e-9 keeps a product that should be whole from being rounded up."""
        return max(1, ceil(self.threshold * len(set(self.words)) - 1e-9))


#: Fixed values of the contract: phrases and their labels.
PHRASES = (
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
)

#: Sentences of public license notices, with the names by which the licenses are known.
NOTICES = (
    Template("agpl", "licensed under the GNU Affero General Public License, version 3", 1.0),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0", 0.9),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", 0.9),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", 0.9),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", 0.9),
    Template("mit", "released under the MIT License", 0.9),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("no-warranty", "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


class _Index:
    """Templates as arrays of word numbers, which are ranks once frequencies are known."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int] | None = None):
        vocabulary = sorted({w for t in templates for w in t.words}, key=lambda w: ((frequency or {}).get(w, 0), w))
        rank = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = vocabulary
        hashes, *_ = word_hashes([b" ".join(vocabulary)], LOWER_BY_WORD)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.needed = np.array([t.needed for t in templates], np.int64)
        sets = [sorted({rank[w] for w in t.words}) for t in templates]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))
        self.members = np.array([r for s in sets for r in s], np.int64)
        self.sequences = {i: np.array([rank[w] for w in t.words], np.int64) for i, t in enumerate(templates) if t.ordered and t.words}
        prefix = [(r, i, p) for i, s in enumerate(sets) for p, r in enumerate(s[: len(s) - templates[i].needed + 1])]
        at = np.array(sorted(prefix), np.int64).reshape(-1, 3)
        self.prefix_template, self.prefix_place = at[:, 1], at[:, 2]
        self.prefix_begins = np.searchsorted(at[:, 0], np.arange(len(vocabulary) + 1))

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.by_hash[at], -1)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths laid end to end: the list, and the place in it, of every element."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _block_words(ranks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, rank) of the template words of all blocks, sorted, each once; and the first block of each text.

    Block b of a text has its words [b * STEP, b * STEP + BLOCK); a text of any words has one at least.
    """
    n_blocks = -(-np.diff(offsets) // STEP)
    first_block = np.concatenate(([0], np.cumsum(n_blocks)))
    at = np.flatnonzero(ranks >= 0)
    text = np.searchsorted(offsets, at, side="right") - 1
    own = (at - offsets[text]) // STEP
    block = first_block[text] + own
    earlier = [block[own >= k] - k for k in range(1, BLOCK // STEP)]  # a word lies in the blocks that began before it, too
    all_ranks = [ranks[at][own >= k] for k in range(1, BLOCK // STEP)]
    codes = np.unique(np.concatenate([block, *earlier]) << 32 | np.concatenate([ranks[at], *all_ranks]))
    return codes >> 32, codes & 0xFFFFFFFF, first_block


def _candidates(index: _Index, blocks: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, template) pairs that pass the prefix, length and positional filters."""
    fan = index.prefix_begins[ranks + 1] - index.prefix_begins[ranks]
    of, k = _spread(fan)
    entry = index.prefix_begins[ranks[of]] + k
    template, p = index.prefix_template[entry], index.prefix_place[entry]
    ends = np.searchsorted(blocks, blocks, side="right")
    size = ends - np.searchsorted(blocks, blocks)
    rest = np.minimum(index.sizes[template] - p, (ends - np.arange(len(blocks)))[of])  # this word and what can follow it
    # rows are in the block's order: the first of a pair is its rarest agreeing word
    pair = blocks[of] * len(index.sizes) + template
    pair, first = np.unique(pair, return_index=True)
    needed = index.needed[template[first]]
    good = (size[of[first]] >= needed) & (rest[first] >= needed)
    return pair[good] // len(index.sizes), pair[good] % len(index.sizes)


def _overlaps(index: _Index, blocks: np.ndarray, ranks: np.ndarray, block: np.ndarray, template: np.ndarray) -> np.ndarray:
    """How many words of its template each candidate's block holds."""
    of, k = _spread(index.sizes[template])
    wanted = block[of] << 32 | index.members[index.begins[template[of]] + k]
    known = blocks << 32 | ranks
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    return np.bincount(of, known[at] == wanted, len(block)).astype(np.int64)


def _matches(index: _Index, templates: list[Template], texts: list[bytes]) -> Iterator[list[tuple]]:
    """Per text: its words' number, and its (template, block, overlap, places)."""
    words, offsets, starts, ends, buffer = word_hashes(texts, LOWER_BY_WORD)
    ranks = index.ranks(words) if index.vocabulary else np.full(len(words), -1)
    blocks, block_ranks, first_block = _block_words(ranks, offsets)
    found: list[list[tuple]] = [[] for _ in texts]
    if len(blocks):
        block, template = _candidates(index, blocks, block_ranks)
        overlap = _overlaps(index, blocks, block_ranks, block, template)
        good = np.flatnonzero(overlap >= index.needed[template])
        text = np.searchsorted(first_block, block, side="right") - 1
        for i in good.tolist():
            t, d, b = int(template[i]), int(text[i]), int(block[i] - first_block[text[i]])
            begin = int(offsets[d]) + b * STEP
            end = min(begin + BLOCK, int(offsets[d + 1]))
            held = {buffer[x:y] for x, y in zip(starts[begin:end].tolist(), ends[begin:end].tolist())}
            same, places = len(held.intersection(templates[t].words)), []
            if t in index.sequences:
                wanted = index.sequences[t]
                last = min(begin + STEP, end - len(wanted) + 1)  # what starts later is the next block's
                here = np.arange(begin, max(last, begin))
                for j, rank in enumerate(wanted):
                    here = here[ranks[here + j] == rank]
                places = (here - offsets[d]).tolist()
                if not places:
                    continue
            if same >= index.needed[t]:
                found[d].append((t, b, same, places))
    for n, rows in zip(np.diff(offsets).tolist(), found):
        yield n, rows


def _slices(templates: list[Template]) -> list[list[tuple[int, Template]]]:
    out, held = [[]], 0
    for i, t in enumerate(templates):
        if len(set(t.words)) > BLOCK - STEP or len(t.words) > BLOCK - STEP:
            raise ValueError(f"a template has at most {BLOCK - STEP} words")
        held += len(t.text)
        if held > SLICE_BYTES and out[-1]:
            out.append([])
            held = len(t.text)
        out[-1].append((i, t))
    return out


def word_frequencies(texts: DataFrame, templates: list[Template], text_col: str = "text") -> dict[bytes, int]:
    """In how many blocks of all texts each word of the templates is; as many rows as these have words come to the driver."""
    index = _Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                words, offsets, *_ = word_hashes([t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()], LOWER_BY_WORD)
                total += np.bincount(_block_words(index.ranks(words), offsets)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["word", "n"])

    if not index.vocabulary:
        return {}
    counted = texts.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {index.vocabulary[r["word"]]: r["n"] for r in counted.collect()}


_MATCH = pa.struct([("template", pa.int32()), ("label", pa.string()), ("ordered", pa.bool_()), ("block", pa.int64()), ("containment", pa.float64()), ("places", pa.list_(pa.int64()))])


def scan(texts: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_words, matches): all blocks that meet a template; see the module.

    matches: (template (its number), label, ordered, block, containment, places (of phrases, from the text's first word)).
    """
    slices = [(numbered, word_frequencies(texts, [t for _, t in numbered], text_col)) for numbered in _slices(list(templates))]

    def over(numbers: list[int], chosen: list[Template], frequency: dict[bytes, int]):
        index = _Index(chosen, frequency)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, 1):
                    n_words, flat, ends = [], [], [0]
                    for n, rows in _matches(index, chosen, [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]):
                        n_words.append(n)
                        flat += [(numbers[t], chosen[t].label, chosen[t].ordered, b, same / len(set(chosen[t].words)), places) for t, b, same, places in rows]
                        ends.append(len(flat))
                    columns = list(zip(*flat)) or [[]] * 6
                    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MATCH)], fields=list(_MATCH))
                    matches = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    # matches found by earlier passes stay before these
                    if part.num_columns == 3:
                        matches = _joined(part.column(2), matches)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), matches], ["id", "text", "n_words", "matches"])

        return run

    kind = texts.schema[id_col].dataType.simpleString()
    match = "array<struct<template:int,label:string,ordered:boolean,block:bigint,containment:double,places:array<bigint>>>"
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for numbered, frequency in slices:
        rows = rows.drop("n_words").mapInArrow(over([i for i, _ in numbered], [t for _, t in numbered], frequency), f"id {kind}, text string, n_words long, matches {match}")
    return rows.select(F.col("id").alias(id_col), "n_words", "matches")


def _joined(first: pa.ListArray, second: pa.ListArray) -> pa.Array:
    return pa.array([(a or []) + (b or []) for a, b in zip(first.to_pylist(), second.to_pylist())], pa.list_(_MATCH))


def labels_of(matches: Column) -> Column:
    """The distinct labels of matches, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def best_containment(matches: Column) -> Column:
    """The largest containment of the matches, 0 if there are none."""
    return F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0))


def phrase_matches(matches: Column) -> Column:
    return F.filter(matches, lambda m: m["ordered"])


def places_of(matches: Column) -> Column:
    """All places of phrases, one for each time that a phrase stands there."""
    return F.flatten(F.transform(phrase_matches(matches), lambda m: m["places"]))


def _values(templates: tuple[Template, ...]) -> str:
    return ", ".join(f"({i}, '{t.label}', ['{"', '".join(w.decode() for w in t.words)}'], {t.threshold})" for i, t in enumerate(templates))


ORACLE_SQL = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
phrases(id, label, words, threshold) AS (VALUES {_values(PHRASES)}),
notices(id, label, words, threshold) AS (VALUES {_values(NOTICES)}),
starts AS (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM texts),
places AS (
  SELECT s.doc_id, s.p, f.label FROM starts s JOIN phrases f ON f.words[1] = s.w[s.p + 1]
  WHERE s.w[s.p + 1 : s.p + len(f.words)] = f.words),
base AS (
  SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(w[b * {STEP} + 1 : b * {STEP} + {BLOCK}]) AS held FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {STEP - 1}) // {STEP})) AS b FROM texts)),
contained AS (
  SELECT b.doc_id, n.label, len(list_intersect(b.held, list_distinct(n.words))) / len(list_distinct(n.words)) AS c, n.threshold
  FROM blocks b, notices n),
near AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS score FROM contained WHERE c >= threshold - 1e-9 GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, b.first_word, b.last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(n.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN b.n_base > 0 THEN 1 ELSE coalesce(n.score, 0) END AS DOUBLE) AS score
FROM texts t LEFT JOIN base b USING (doc_id) LEFT JOIN near n USING (doc_id)
"""
