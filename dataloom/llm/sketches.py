"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 32-bit hashes of a text's five-word shingles (of fewer words, but not none,
the whole sequence is one shingle). The sketch of a union of shingle sets is the k smallest of both sketches, so
sketches of parts merge into that of the whole. From two sketches follow estimates of resemblance (overlap within
the k smallest of the union), of the number of distinct shingles (from the k-th smallest hash) and of containment.

As a string a sketch is base64 of its hashes, ascending, four little-endian bytes each; equal texts have equal
strings. Null and wordless texts have the empty sketch, which resembles another empty sketch by 1 and any other by
0. Only the id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataloom.llm.common import shingle_hashes, shuffle_width, text_slices, word_hashes

K = 256
SHINGLE = 5
_SPACE = 1 << 32


def sketch_of_words(words: np.ndarray, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    if not len(words):
        return np.empty(0, np.uint32)
    hashes = (shingle_hashes(words, min(shingle, len(words))) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 8 * k:
        # repeats may fill the smallest 4k; then all are sorted
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def sketches(texts: list[bytes], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    words, first, *_ = word_hashes(texts)
    return [sketch_of_words(words[a:b], k, shingle) for a, b in zip(first, first[1:])]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets (exact while both have at most k)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles (exact below k)."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / _SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    joint = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return float(min(1.0, joint / distinct_shingles(a, k)))


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u4").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row: id, fingerprint, n_shingles (estimated number of distinct shingles)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                found = sketches([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(to_string, found), pa.string()), pa.array([distinct_shingles(s, k) for s in found], pa.float64())],
                    ["id", "fingerprint", "n_shingles"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fingerprint string, n_shingles double").withColumnRenamed("id", id_col)


def _with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, own, id, text), dealt and sorted such that every own row is followed by its next one.

    Buckets are ranges of ids. A bucket also gets the first row of the next bucket that has any (the last bucket
    that of the first), marked own = false: that is all a task needs from elsewhere. Null ids come first.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"))
    n = 4 * shuffle_width(spark)
    cuts = sorted(set(ids.stat.approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)))
    cuts = np.array(cuts, np.float64).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(np.int64), side="right"), dtype="int32")

    firsts = ids.groupBy(bucket_of("k").alias("bucket")).agg(F.min("k").alias("k")).orderBy("bucket").collect()
    # bucket that the first row of each bucket closes: the one before it, round about
    closes = {int(r["k"]): int(firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)}
    keys = np.array(sorted(closes), np.int64)
    ends = np.array([closes[int(k)] for k in keys], np.int64)

    @F.pandas_udf("array<int>")
    def buckets_of(k: pd.Series) -> pd.Series:
        k = k.to_numpy(np.int64)
        own = np.searchsorted(cuts, k, side="right")
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        first = keys[at] == k
        return pd.Series([[o, e] if f else [o] for o, e, f in zip(own.tolist(), ends[at].tolist(), first.tolist())])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"))
    rows = rows.select("id", "text", "k", F.posexplode(buckets_of("k")).alias("copy", "bucket"))
    # in a table of one bucket the first row follows its own bucket's rows
    rows = rows.repartition(shuffle_width(spark), "bucket").sortWithinPartitions("bucket", "copy", "k", F.col("text").asc_nulls_first())
    return rows.select("bucket", (F.col("copy") == 0).alias("own"), "id", F.coalesce("text", F.lit("")).alias("text"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike text, edited text and next text are.

    The edited text has its last floor(n / 4) code points replaced by the first as many of the next row's text, by
    ascending id (then text); after the last comes the first. Integer ids; rows of equal ids follow each other.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    if id_type not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {id_type}; the order of rows needs whole numbers")

    def finish(pending: list[tuple], out: list[list]) -> None:
        """pending: (id, text, own); the last one is only looked at."""
        texts = [t for _, t, _ in pending]
        plain = sketches([t.encode() for t in texts], k)
        edits = []
        for (_, text, own), (_, following, _) in zip(pending, pending[1:]):
            cut = len(text) // 4
            edits.append((text[: len(text) - cut] + following[:cut]).encode() if own else b"")
        edited = sketches(edits, k) if edits else []
        for i, edit in enumerate(edits):
            id_, text, own = pending[i]
            if own:
                row = (id_, len(text), hashlib.sha256(edit).hexdigest(), to_string(plain[i]), to_string(edited[i]), resemblance(plain[i], edited[i], k), resemblance(plain[i], plain[i + 1], k))
                for column, value in zip(out, row):
                    column.append(value)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        pending: list[tuple] = []
        bucket, closed, held = None, False, 0
        for batch in batches:
            types[0] = batch.column(2).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in names]
                for b, own, id_, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if b != bucket:
                        finish(pending, out)
                        pending, bucket, closed, held = [], b, False, 0
                    if closed:
                        continue  # of tied first rows the least follows
                    closed = not own
                    pending.append((id_, text, own))
                    held += len(text)
                    if held >= 1 << 20 and len(pending) > 1:
                        finish(pending, out)
                        pending, held = pending[-1:], len(text)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
        out = [[] for _ in names]
        finish(pending, out)
        if out[1]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    schema = f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_following(docs, id_col, text_col).mapInArrow(run, schema)
