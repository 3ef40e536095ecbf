"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of bits; a binary classifier per bit weighs hashed n-grams by the log ratio of their
rates in the languages with the bit set and unset (every language counts alike, whatever its share). A text's bits
are the classifiers' summed weights, and decoding takes the codeword of least loss: the logistic loss of each bit,
weighted by how reliable that bit was on a bounded sample of training rows. Few languages get the exhaustive code (all
splits in two), many a random code whose least distance is the best of several tries.

Counts are taken over all training rows, map-side combined to one row per language and bucket. A null or letterless
text is `und` with score 0; so is every text if nothing can be learned. Rows of null language are never learned from.
`ambiguous` marks texts whose best two codewords have nearly the same loss. Only the id, text and language columns
are read, the language only for training. Texts of any length count whole, in runs of bounded bytes. Texts and rows never go to the
driver, only counts of at most `BUCKETS` per language and of wrong bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataloom.llm.common import LOWER_BY_WORD, chunks, hashed_sample

BUCKETS = 1 << 15
#: Training rows, about, by which the bits' reliability is estimated; chosen by hash.
SAMPLE_ROWS = 2000
#: n-grams of a text that count in full; of longer texts the mean is taken for as many.
EVIDENCE = 40
_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


def ngram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all bigrams-to-trigrams of the texts, the texts' first positions, and their numbers of n-grams.

    Position i has the trigram at i; what would cross into the next text has the bucket BUCKETS.
    """
    padded = [b" " + b" ".join(t.translate(LOWER_BY_WORD).split()) + b" " for t in texts]
    data = np.frombuffer(b"".join(padded) + b"  ", np.uint8).astype(np.uint32)
    h = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA6B)) ^ (data[2:] * np.uint32(0xC2B2AE35))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(sizes)
    h[ends - 1] = BUCKETS
    h[ends - 2] = BUCKETS
    return h, ends - sizes, np.maximum(sizes - 2, 0)


@dataclass
class Codes:
    languages: list[str]
    words: np.ndarray  # (languages, bits) of +1 and -1
    weights: np.ndarray  # (bits, BUCKETS + 1)
    reliability: np.ndarray  # (bits,)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, bits) log odds."""
        h, first, n = ngram_buckets(texts)
        sums = np.stack([np.add.reduceat(w[h], first) for w in self.weights], axis=1)
        return sums * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]

    def decode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the languages, scores, and whether the second best is about as good."""
        if len(self.languages) == 1:
            return np.zeros(len(texts), int), np.ones(len(texts)), np.zeros(len(texts), bool)
        odds = np.clip(self.bits(texts), -30, 30)
        losses = np.log1p(np.exp(-odds[:, None, :] * self.words[None])) @ self.reliability
        order = np.sort(losses, axis=1)
        likely = np.exp(order[:, :1] - losses)
        return losses.argmin(axis=1), 1 / likely.sum(axis=1), order[:, 1] - order[:, 0] < 0.1 * self.reliability.sum()


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """+1/-1 codewords: the exhaustive code up to seven languages, else the best of 64 random ones."""
    if n <= 7:
        columns = range(1, 1 << (n - 1))
        return np.array([[1 if i == n - 1 else -1 if c >> i & 1 else 1 for c in columns] for i in range(n)], np.int8)
    bits, random, best = 15 + 6 * n.bit_length(), np.random.default_rng(seed), None
    for _ in range(64):
        code = random.integers(0, 2, (n, bits)).astype(np.int8) * 2 - 1
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = (code.astype(np.int32) @ code.T.astype(np.int32) - 10**6 * np.eye(n, dtype=np.int32)).max()
        if best is None or near < best[0]:
            best = near, code
    return best[1]


def ngram_counts(rows: DataFrame) -> DataFrame:
    """Rows (lang, bucket, n) of rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            both = list(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()))
            for part in chunks(both, lambda r: len(r[1])):
                by: dict[str, list[bytes]] = {}
                for lang, text in part:
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    h, *_ = ngram_buckets(texts)
                    counts = np.bincount(h, minlength=BUCKETS + 1)[:BUCKETS]
                    totals[lang] = totals[lang] + counts if lang in totals else counts
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None) -> Codes | None:
    """Learns codes from all rows with a text and a language; hashes of `key` (or the text) pick the sample for reliability."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), (key if key is not None else F.col(text_col)).alias("key"))
    counts = ngram_counts(rows.select("lang", "text")).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    rates = np.zeros((len(languages), BUCKETS))
    rates[pd.Categorical(counts["lang"], languages).codes, counts["bucket"]] = counts["n"]
    rates = (rates + 0.5) / (rates.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    words = codewords(len(languages))
    weights = np.zeros((words.shape[1], BUCKETS + 1), np.float32)
    for b in range(words.shape[1]):
        weights[b, :BUCKETS] = np.log(rates[words[:, b] > 0].mean(axis=0)) - np.log(rates[words[:, b] < 0].mean(axis=0))
    codes = Codes(languages, words, weights, np.ones(words.shape[1]))
    if len(languages) > 1:
        wrong = (_wrong_bits(hashed_sample(rows, F.struct("key", "text"), SAMPLE_ROWS), codes) + 1).astype(float)
        wrong = wrong[:-1] / (wrong[-1] + 1)
        codes.reliability = np.maximum(np.log((1 - wrong) / wrong), 0.05)
        codes.reliability /= codes.reliability.mean()
    return codes


def _wrong_bits(rows: DataFrame, codes: Codes) -> np.ndarray:
    """How many texts of rows (lang, text) each bit is wrong for, and at the end the number of texts; only sums leave the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, None
        number = {lang: i for i, lang in enumerate(model.languages)}
        for batch in batches:
            for part in chunks(list(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())), lambda r: len(r[1])):
                truth = model.words[[number[lang] for lang, _ in part]]
                wrong = np.append((model.bits([t for _, t in part]) * truth <= 0).sum(axis=0), len(part))
                total = wrong if total is None else total + wrong
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["wrong"])

    at = rows.select("lang", "text").mapInArrow(run, "wrong array<long>").select(F.posexplode("wrong").alias("bit", "n"))
    found = at.groupBy("bit").agg(F.sum("n").alias("n")).orderBy("bit").toPandas()["n"].to_numpy(np.int64)
    return found if len(found) else np.zeros(codes.words.shape[1] + 1, np.int64)


def identify(docs: DataFrame, codes: Codes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1), ambiguous."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in chunks(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), lambda r: len(r[1] or "")):
                known = [i for i, (_, t) in enumerate(part) if model and has_letter(t)]
                names, scores, doubts = ["und"] * len(part), [0.0] * len(part), [False] * len(part)
                if known:
                    for i, lang, score, doubt in zip(known, *model.decode([part[i][1].encode() for i in known])):
                        names[i], scores[i], doubts[i] = model.languages[lang], float(score), bool(doubt)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], batch.column(0).type), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())],
                    ["id", "lang_pred", "score", "ambiguous"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: CRC-32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
