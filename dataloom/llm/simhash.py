"""SimHash near-duplicates: 64-bit fingerprints linked within three bits by covering locality-sensitive hashing.

Covering LSH assigns every bit position a non-zero vector of radius + 1 bits and makes one table for each
non-zero vector v: its mask keeps the positions whose vector has an odd overlap with v. Two fingerprints that
differ in at most `radius` positions span a space of at most that dimension, so some v is orthogonal to all of
their differences: in that table both have the same key. No pair within the radius is missed.

Equal fingerprints are one node. Within a table's bucket nodes are compared in blocks of bounded size, each pair
of blocks in a task of its own, and only a spanning forest of the links found there leaves the task; a bucket's
pairs are never listed. Components come from minimum-label joins.

Null and wordless texts have fingerprint zero and link like any other. Repeated rows, also those of one doc_id,
share a node. Null ids take part; a component of null ids alone has a null id. An empty table gives an empty
result, and only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataloom.llm.common import LOWER_BY_SPACE, checkpointed, in_batches, keyed, min_label_components, salted_join, unused

RADIUS = 3
BITS = 64
#: Fingerprints of one bucket that a task compares at once.
BLOCK = 4096

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit i is set where more than half of the shingle hashes (repeats included) have it set."""
    words = text.translate(LOWER_BY_SPACE).split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([h64(b" ".join(words), 42)], np.uint64)
    else:
        joined, at, ends = b" ".join(words), 0, []
        for w in words:
            at += len(w)
            ends.append(at)
            at += 1
        starts = [0, *[e + 1 for e in ends[:-shingle]]]
        hashes = np.fromiter([h64(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64, len(starts))
    n = len(hashes)
    cells = hashes.view(np.uint8).reshape(n, 8)
    out = 0
    if n < 512:
        ones = np.unpackbits(cells, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(cells[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    for i in np.flatnonzero(2 * ones > n):
        out |= 1 << int(i)
    return out


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits; position i has the vector i mod (2^(radius+1) - 1) + 1."""
    n = (1 << radius + 1) - 1
    vector = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fingerprint as a signed 64-bit integer)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints = np.array([fingerprint(t or b"", shingle) for t in part.column(1).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {id_type}, fp long").withColumnRenamed("id", id_col)


def _spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block, or (right given) of those between two blocks.

    Breadth first: a node is compared with the nodes not reached yet only, so a dense block costs little.
    """
    sides = [left] if right is None else [left, right]
    open_ = [np.arange(len(s)) for s in sides]
    out = []
    while len(open_[0]) and len(open_[-1]):
        queue = [(0, int(open_[0][0]))]
        open_[0] = open_[0][1:]
        while queue:
            side, x = queue.pop()
            other = 0 if right is None else 1 - side
            rest = open_[other]
            if not len(rest):
                continue
            near = np.bitwise_count(sides[other][rest] ^ sides[side][x]) <= radius
            if near.any():
                out += [(int(sides[side][x]), int(sides[other][y])) for y in rest[near]]
                queue += [(other, int(y)) for y in rest[near]]
                open_[other] = rest[~near]
    return out


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct values of column fp that join all pairs within the radius (a spanning set)."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)]))
    rows = prints.select("fp", tables.alias("k")).select("fp", "k.t", "k.key")
    # Buckets of one node link nothing; the others are cut into blocks by their size.
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(sizes, ["t", "key"]).select("fp", "t", "key", "blocks", F.expr("cast(pmod(xxhash64(fp, t), blocks) as int)").alias("own"))
    # every pair of blocks (i <= j) meets once; a node goes to the pairs its block is in
    spread = placed.select("fp", "t", "key", "own", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")).alias("p"))
    spread = spread.select("fp", "own", "t", "key", "p.i", "p.j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        group = None
        links: list[tuple[int, int]] = []

        def close():
            fp, own = (np.concatenate(x) for x in zip(*held))
            if len(fp) > 1:
                if group[2] == group[3]:
                    block = fp.view(np.uint64)
                    links.extend(_spanning_links(block, None, radius))
                else:
                    links.extend(_spanning_links(fp[own == group[2]].view(np.uint64), fp[own == group[3]].view(np.uint64), radius))
            held.clear()

        for batch in batches:
            cols = {n: batch.column(n).to_numpy() for n in ("fp", "own", "t", "key", "i", "j")}
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            for c in ("t", "key", "i", "j"):
                change[1:] |= cols[c][1:] != cols[c][:-1]
            cuts = [0, *np.flatnonzero(change), n]
            for a, b in zip(cuts, cuts[1:]):
                name = tuple(int(cols[c][a]) for c in ("t", "key", "i", "j"))
                if name != group and held:
                    close()
                group = name
                held.append((cols["fp"][a:b], cols["own"][a:b]))
            if len(links) > 10_000:
                yield _links(links)
                links.clear()
        if held:
            close()
        yield _links(links)

    keys = ["t", "key", "i", "j"]
    dealt = spread.repartition(*keys).sortWithinPartitions(*keys)
    return in_batches(dealt, compare, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """Per row: the id, its fingerprint `fp`, and component_id, the smallest id reachable over links.

    A fingerprint that a third of all rows have, or a component of as many fingerprints, fills no task: least ids are map-side combined,
    and rows meet the classes of their fingerprint or root in salted joins.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    components = min_label_components(near_links(nodes, radius), "a", "b", "root").withColumnRenamed("node", "fp")
    rooted = checkpointed(nodes.join(components, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = salted_join(rooted.select("fp", "root"), smallest, "root", F.col("fp")).select("fp", "component_id")
    return salted_join(prints, classes, "fp", F.col(id_col)).select(id_col, "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each component, that of its least id (null ids come last, rows of one id by their text)."""
    key, of = unused(docs, "stays_row"), unused(docs, "stays_least")
    rows = keyed(docs, key, id_col, text_col)
    classes = near_duplicate_classes(rows.select(F.col(key).alias("key"), F.col(text_col).alias("text")), "key", "text", shingle, radius)
    stay = classes.where("key = component_id").select(F.col("key").alias(of))
    return rows.join(stay, F.col(key) == F.col(of), "left_semi").select(*docs.columns)
