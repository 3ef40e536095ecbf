"""Benchmark decontamination: Wu-Manber search for many word windows at once.

The patterns are all windows of `window` words of every benchmark item (an item of fewer words, but not none, is
one window). Patterns of the same length share a shift table over blocks of two words: a block that no pattern
contains lets the scan jump a whole window less one word, a block that ends patterns leads to the bucket of its
patterns, sorted by their first two words, and a direct comparison confirms the occurrence.

Items are read in blocks of at most `block_bytes` of text. A worker holds the tables of one block, however large the
benchmark is: with more than one block every block is a pass of its own over the rows, in tasks of its own, which
gives rows for its hits alone; these few meet by row. A benchmark of one block needs no shuffle.

Null and wordless texts have no words and no hit; null items have none either. Equal item ids count once.
Repeated documents are separate rows, those of repeated or null ids too. Texts of any length are searched whole.
Columns other than those named are not read, and stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataloom.llm.common import LOWER_BY_WORD, in_batches, keyed, unused

_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, a-z and code points beyond ASCII."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(LOWER_BY_WORD).split()


class WuManber:
    """Shift and bucket tables for word windows, one pair of tables for each window length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        by_length: dict[int, dict[tuple, set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).add(item)
        self.tables = []
        for n, patterns in by_length.items():
            block = min(2, n)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, dict[tuple, list]] = {}
            for pattern, owners in patterns.items():
                for end in range(block, n + 1):
                    key = pattern[end - block : end]
                    shift[key] = min(shift.get(key, n), n - end)
                buckets.setdefault(pattern[n - block :], {}).setdefault(pattern[:block], []).append((list(pattern), owners))
            self.tables.append((n, block, shift, buckets))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [first, last) of word positions of all occurrences, and the items they are from."""
        spans, found = [], set()
        for n, block, shift, buckets in self.tables:
            jump, end, size, shift_of = n - block + 1, n, len(words), shift.get
            while end <= size:
                key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
                step = shift_of(key, jump)
                if step:
                    end += step
                    continue
                first = end - n
                for pattern, owners in buckets[key].get(tuple(words[first : first + block]), ()):
                    if words[first:end] == pattern:
                        spans.append((first, end))
                        found |= owners
                end += 1
        return spans, found


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


_tables: dict[str, WuManber] = {}


def _table_of(shared, window: int) -> WuManber:
    """The worker's tables of a broadcast block (name, items); names are unique, so tables are never mixed up."""
    name, items = shared.value
    if name not in _tables:
        _tables.clear()
        _tables[name] = WuManber(items, window)
    return _tables[name]


def _shared(docs: DataFrame, block: list[tuple[str, str]]):
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))  # of bounded size


def _item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(item_text)).where(F.col(item_text).isNotNull())
    block, held = [], 0
    for name, text in rows.toLocalIterator():
        block.append((name, text))
        held += len(text.encode())
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _scanned(rows: DataFrame, block: list[tuple[str, str]], window: int, all_rows: bool) -> DataFrame:
    """Rows (id, n_words, spans, items) of rows (id, text), searched for the items of a block; all or those with hits."""
    shared = _shared(rows, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _table_of(shared, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                taken, counts, spans, names = [], [], [], []
                for i, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    found, items = finder.search(words)
                    if found or all_rows:
                        taken.append(i)
                        counts.append(len(words))
                        spans.append([{"first": a, "last": b} for a, b in merged_spans(found)])
                        names.append(sorted(items))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(taken, pa.int64())), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    id_type = rows.schema["id"].dataType.simpleString()
    return in_batches(rows, run, f"id {id_type}, n_words long, spans array<struct<first:int,last:int>>, items array<string>")


def _hits_by_row(rows: DataFrame, blocks: Iterator[list[tuple[str, str]]], window: int) -> DataFrame:
    """Rows (id, spans, items) of the rows with hits in any block; one pass over the rows for each block."""
    out = None
    for block in blocks:
        found = _scanned(rows, block, window, all_rows=False).drop("n_words")
        out = found if out is None else out.union(found)
    both = out.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans in order; one that begins within or at the end of the last one is joined to it
    merged = """aggregate(array_sort(spans), cast(array() as array<struct<first:int,last:int>>), (done, s) ->
        case when size(done) > 0 and s.first <= element_at(done, -1).last
             then concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last))))
             else concat(done, array(s)) end)"""
    return both.select("id", F.expr(merged).alias("spans"), "items")


def benchmark_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20,
) -> DataFrame:
    """Per row of `docs`: the id, n_words, `spans` of hit word positions (merged, ordered), `items` (ids as strings, sorted)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = _item_blocks(items, item_id, item_text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scanned(rows, first, window, all_rows=True).withColumnRenamed("id", id_col)
    rows = keyed(rows, "row", "id", "text")
    by_row = rows.select(F.col("row").alias("id"), "text")
    hits = _hits_by_row(by_row, chain([first, second], blocks), window)
    counted = _scanned(by_row, [], window, all_rows=True).select(F.col("id").alias("row"), "n_words")
    out = rows.select("row", "id").join(counted, "row").join(hits.withColumnRenamed("id", "row"), "row", "left")
    none = F.expr("cast(array() as array<struct<first:int,last:int>>)"), F.expr("cast(array() as array<string>)")
    return out.select(F.col("id").alias(id_col), "n_words", *[F.coalesce(c, x).alias(c) for c, x in zip(("spans", "items"), none)])


def n_hit_words():
    return F.expr("aggregate(spans, 0L, (n, s) -> n + (s.last - s.first))")


def without_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10,
    block_bytes: int = 8 << 20, id_col: str = "doc_id",
) -> DataFrame:
    """The rows of `docs` that no item window occurs in, all columns; without a shuffle if the items are one block."""
    blocks = _item_blocks(items, item_id, item_text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        row, hit = unused(docs, "clean_row"), unused(docs, "hit_row")
        rows = keyed(docs, row, id_col, text_col)
        hits = _hits_by_row(rows.select(F.col(row).alias("id"), F.col(text_col).alias("text")), chain([first, second], blocks), window)
        return rows.join(hits.select(F.col("id").alias(hit)), F.col(row) == F.col(hit), "left_anti").select(*docs.columns)
    at_text, shared = docs.columns.index(text_col), _shared(docs, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _table_of(shared, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(at_text).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array([not finder.search(words_of(t))[0] for t in texts], pa.bool_()))

    return in_batches(docs, run, docs.schema)
