"""Quality classifier: a weak-label model whose posteriors train a hashed linear scorer, for quality and toxicity.

Each of the two targets has overlapping labellers that vote 1 (bad), 0 (good) or abstain. For quality: measures of a
text's shape, and the table of labels. For toxicity: a list of insults, word lists mined from disjoint thirds of the labels
(each abstains on the rows it was mined from), and the table of labels. Expectation-maximisation (two-coin model:
each labeller errs at its own rate on bad and on good rows) estimates the accuracies of all of them from their
overlaps, over labelled and unlabelled rows alike, starting from what the heuristic labellers vote, and gives every row a
posterior. The posteriors are the targets of a logistic regression over hashed features (presence of words, of
beginnings of words, and of shape votes), which scores every document; labels are not read then.

The model is fitted on about `SAMPLE_ROWS` labelled rows and as many of all rows, chosen by the hash of id and text, whatever
the size of the corpus; rows that are equal count as often as they occur, but go as one. Counts of words are taken by Spark;
vote patterns and rows of at most `WORD_FEATURES` bits go to the driver, never texts or whole vocabularies. Every
document is scored, over its whole text. Without labels the shapes and the list of insults vote alone. Null, empty
and wordless texts have quality 0 and are rejected. Repeated rows get equal scores; ids with several labels take the
worst. Only the id and text columns (and doc_id, quality, toxic of the labels) are read; columns of `docs` with the
names of results stay, and the results get other names (see classify).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataloom.llm.common import LOWER_BY_WORD, checkpointed, hashed_sample, in_batches, shingle_hashes, text_slices, unused, word_hashes

#: Labelled rows, about, that the model is fitted on at most, and rows of the whole table.
SAMPLE_ROWS = 10_000
#: Hashed features: 2^24 places, of which the scorer keeps those that tell most; words count whole and by so many first bytes.
HASH_BITS, WORD_FEATURES, PREFIXES = 24, 512, (4, 6, 8)
#: As how many votes the labels' hit rate, taken beforehand, counts.
TRUST, TRUSTED_HITS = 1000, 0.97
#: Rows that the driver, when it fits the scorers, holds as wide numbers at once.
FIT_ROWS = 1024
#: Parts of the labels that word lists are mined from, one each; the evidence (chi-square, log ratio) that a listed word needs.
PARTS, LEAST_CHI, LEAST_RATIO = 3, 25.0, 2.5

SHAPES = ("symbols", "capitals", "columns", "repeated_lines", "repeated_trigrams", "few_words", "repeated_words")
#: Labellers of quality: kinds of shape that hardly occur together, so that one that is absent says little.
KINDS = {"odd_form": ("symbols", "capitals", "columns"), "repetition": ("repeated_lines", "repeated_trigrams", "few_words", "repeated_words")}
INSULTS = b"idiot idiots moron morons stupid scum pathetic worthless disgusting loser losers clown trash garbage dumb fool liar jerk vermin filth".split()
_SYMBOLS = b"$*#&%!|~^=<>_{}[]\\@+/"
_UPPER, _LOWER, _SPACES = bytes(range(65, 91)), bytes(range(97, 123)), b" \t\n\r\x0b\x0c"


def _without(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def shape_votes(text: bytes, words: np.ndarray) -> list[int]:
    """1 bad, 0 good, -1 abstains; in order of SHAPES. `words` are hashes of the lower-cased words."""
    n = len(words)
    solid = max(1, len(text) - _without(text, _SPACES))
    upper, lower = _without(text, _UPPER), _without(text, _LOWER)
    votes = [int(_without(text, _SYMBOLS) >= 0.1 * solid)]
    votes.append(int(upper >= 0.4 * (upper + lower)) if upper + lower >= 20 else -1)
    votes.append(int(text.count(b"|") + text.count(b"\t") >= 0.1 * n) if n >= 5 else -1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    votes.append(int(sum(map(len, set(lines))) <= 0.7 * sum(map(len, lines))) if len(lines) >= 3 else -1)
    if n >= 12:
        trigrams = shingle_hashes(words, 3)
        votes.append(int(len(np.unique(trigrams)) <= 0.7 * len(trigrams)))
        votes.append(int(len(np.unique(words)) <= 0.15 * n))
        votes.append(int((words[1:] == words[:-1]).sum() >= 0.1 * n))
    else:
        votes += [-1, -1, -1]
    return votes


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, SHAPES) votes, the places of all words and of their beginnings, and the texts' first words.

    Places are (1 + PREFIXES, words) and 0 where a word has no such beginning.
    """
    hashes, offsets, *_ = word_hashes(texts, LOWER_BY_WORD, PREFIXES)
    votes = [shape_votes(t, hashes[0, a:b]) for t, a, b in zip(texts, offsets, offsets[1:])]
    return np.array(votes, np.int8).reshape(-1, len(SHAPES)), (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64), offsets


def expectation_maximisation(
    votes: np.ndarray, start: np.ndarray, counts: np.ndarray | None = None, trusted: tuple[int, float, float] | None = None, rounds: int = 60
) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of bad, and per labeller (rate of voting bad on bad, rate on good), from votes (rows, labellers), each `counts` times.

    trusted: a labeller, and as how many votes its hit rate, given beforehand, counts.
    """
    counts = np.ones(len(votes)) if counts is None else counts
    patterns, back = np.unique(votes, axis=0, return_inverse=True)
    back = back.ravel()
    n = np.bincount(back, counts)
    p = np.bincount(back, start * counts) / n
    yes, no = patterns == 1, patterns == 0
    rates = np.zeros((votes.shape[1], 2))
    for _ in range(rounds):
        prior = np.clip((p * n).sum() / n.sum(), 1e-3, 0.999)
        odds = np.full(len(n), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            for c, w in enumerate((p * n, (1 - p) * n)):
                before, hit = trusted[1:] if trusted and trusted[0] == j else (1.5, 2 / 3)
                rates[j, c] = (w[yes[:, j]].sum() + before * (1 - hit if c else hit)) / (w[yes[:, j]].sum() + w[no[:, j]].sum() + before)
            odds += yes[:, j] * np.log(rates[j, 0] / rates[j, 1]) + no[:, j] * np.log((1 - rates[j, 0]) / (1 - rates[j, 1]))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p[back], rates


def logistic(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 0.3, rounds: int = 15) -> np.ndarray:
    """Weights (the last one the intercept) by Newton's method; targets are probabilities of rows that count so often.

    Sums are taken over blocks of `FIT_ROWS` rows, so that x may be of bytes and no copy of it in wider numbers is held.
    """
    w, penalty = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        curve, slope = np.diag(penalty), -penalty * w
        for at in range(0, len(x), FIT_ROWS):
            block = np.column_stack([x[at : at + FIT_ROWS], np.ones(len(x[at : at + FIT_ROWS]))])
            n, p = counts[at : at + FIT_ROWS], 1 / (1 + np.exp(-np.clip(block @ w, -30, 30)))
            slope += block.T @ (n * (target[at : at + FIT_ROWS] - p))
            curve += (block * (n * (p * (1 - p) + 1e-6))[:, None]).T @ block
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Scorer:
    """Linear over hashed word presence (sorted places, weights) and shape votes, with an intercept."""

    places: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    shape_weights: np.ndarray = field(default_factory=lambda: np.zeros(len(SHAPES)))
    intercept: float = -10.0
    accuracies: dict = field(default_factory=dict)

    def table(self) -> np.ndarray:
        known = np.zeros(1 << HASH_BITS, bool)
        known[self.places] = True
        return known

    def score(self, votes: np.ndarray, places: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> np.ndarray:
        odds = (votes == 1) @ self.shape_weights + self.intercept
        kind, at = np.nonzero(known[places])
        if len(at):
            row = np.searchsorted(offsets, at, side="right") - 1
            pairs = np.unique(row << HASH_BITS | places[kind, at])
            hit = self.weights[np.searchsorted(self.places, pairs & ((1 << HASH_BITS) - 1))]
            odds = odds + np.bincount(pairs >> HASH_BITS, hit, minlength=len(votes))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """Rows (part, shape votes, distinct places, whether an insult occurs, quality, toxic) that the model is fitted on."""
    marked = labels.groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic")).where("of is not null")
    marked = F.broadcast(hashed_sample(marked, F.col("of"), sample_rows))  # about sample_rows narrow rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(marked, F.col("id") == F.col("of"), "left")
    n, of_label = rows.agg(F.count("*"), F.count("of")).first()
    place = F.xxhash64("id", "text") / float(1 << 63)  # from -1 to 1
    taken = (F.col("of").isNotNull() & (place < 2.0 * min(1.0, sample_rows / max(of_label, 1)) - 1)) | (place < 2.0 * min(1.0, sample_rows / max(n, 1)) - 1)
    insults = np.unique((word_hashes(INSULTS, LOWER_BY_WORD)[0] >> np.uint64(64 - HASH_BITS)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                votes, places, offsets = features([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                own = [np.unique(places[:, a:b]) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([v.tobytes() for v in votes], pa.binary()), pa.array([p[p > 0].astype("<i4").tobytes() for p in own], pa.binary()),
                     pa.array([int(np.isin(places[0, a:b], insults).any()) for a, b in zip(offsets, offsets[1:])], pa.int8()), part.column(2), part.column(3)],
                    ["part", "shape", "places", "insult", "quality", "toxic"],
                )

    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    narrow = rows.where(taken).select(part.alias("part"), "text", F.col("quality").cast("tinyint"), F.col("toxic").cast("tinyint"))
    found = in_batches(narrow, run, "part int, shape binary, places binary, insult tinyint, quality tinyint, toxic tinyint")
    return checkpointed(found.groupBy(*found.columns).agg(F.count("*").alias("n")))


def _counted(rows: DataFrame, groups: int, weigh) -> DataFrame:
    """Rows (place, group, bad, good): summed weights of the rows of each group that have the place.

    weigh: from a batch, (rows, groups) weights of bad and of good.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bad, good = weigh(batch)
            places = [np.frombuffer(p, "<i4") for p in batch.column(batch.schema.get_field_index("places")).to_pylist()]
            names, back = np.unique(np.concatenate(places), return_inverse=True)
            row = np.repeat(np.arange(len(places)), [len(p) for p in places])
            for g in range(groups):
                b, c = np.bincount(back, bad[row, g], len(names)), np.bincount(back, good[row, g], len(names))
                some = np.flatnonzero(b + c > 0)
                yield pa.RecordBatch.from_arrays([pa.array(names[some].astype(np.int32)), pa.array(np.full(len(some), g, np.int32)), pa.array(b[some]), pa.array(c[some])], ["place", "g", "bad", "good"])

    counted = in_batches(rows, run, "place int, g int, bad double, good double")
    return counted.groupBy("place", "g").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _telling(counts: DataFrame, totals: list[tuple[float, float]], limit: int, least: int = 3, chi: float = 10.0, ratio: float | None = None) -> list[np.ndarray]:
    """Per group the places that tell bad from good most, by chi-square, sorted; at most `limit` in each."""
    spec = F.create_map(*[x for g, (b, c) in enumerate(totals) for x in (F.lit(g), F.struct(F.lit(float(b) + 1e-9).alias("b"), F.lit(float(c) + 1e-9).alias("c")))])
    both, of = F.col("bad") + F.col("good"), spec[F.col("g")]
    expected = both * of["b"] / (of["b"] + of["c"])
    scored = counts.where(both >= least).withColumn("chi", (F.col("bad") - expected) ** 2 / expected)
    log_ratio = F.log((F.col("bad") + 0.5) / (of["b"] + 1)) - F.log((F.col("good") + 0.5) / (of["c"] + 1))
    scored = scored.where((F.col("chi") > chi) & (log_ratio > (ratio if ratio is not None else -1e9)))
    out = []
    for g in range(len(totals)):
        rows = scored.where(F.col("g") == g).orderBy(F.col("chi").desc(), "place").limit(limit).select("place").toPandas()
        out.append(np.sort(rows["place"].to_numpy(np.int64)))
    return out


def _patterns(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vote patterns (at most 3 to the number of labellers) and how many rows have each."""
    found = rows.groupBy(column).agg(F.sum("n").alias("n")).orderBy(column).toPandas()
    return np.array([np.frombuffer(p, np.int8) for p in found[column]]), found["n"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Scorer, Scorer]:
    """Scorers of low quality and of toxicity; `accuracies` has each labeller's estimated hit rates on bad and good."""
    sample = _sample(docs, labels, id_col, text_col, sample_rows)
    context = docs.sparkSession.sparkContext

    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def by_part(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        mine = (column(batch, "part")[:, None] == np.arange(PARTS)) * column(batch, "n")[:, None]
        toxic = column(batch, "toxic") > 0
        return mine * toxic[:, None], mine * ~toxic[:, None]

    known = sample.where("toxic is not null")
    sizes = {r["part"]: (float(r["b"]), float(r["c"])) for r in known.groupBy("part").agg(F.sum(F.expr("if(toxic > 0, n, 0)")).alias("b"), F.sum(F.expr("if(toxic > 0, 0, n)")).alias("c")).collect()}
    lists = _telling(_counted(known, PARTS, by_part), [sizes.get(g, (0.0, 0.0)) for g in range(PARTS)], WORD_FEATURES, chi=LEAST_CHI, ratio=LEAST_RATIO) if sizes else [np.empty(0, np.int64)] * PARTS

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.frombuffer(p, "<i4") for p in column(batch, "places")]
            part, toxic, quality = (column(batch, c) for c in ("part", "toxic", "quality"))
            harm = np.full((batch.num_rows, PARTS + 2), -1, np.int8)
            harm[:, 0] = column(batch, "insult")
            marked = ~np.isnan(toxic.astype(float))
            for g, words in enumerate(lists):
                if len(words):
                    harm[:, 1 + g] = [np.isin(p, words, assume_unique=True).any() for p in places]
                    harm[marked & (part == g), 1 + g] = -1
            harm[marked, -1] = toxic[marked] > 0
            human = np.where(np.isnan(quality.astype(float)), -1, quality == 0).astype(np.int8)
            shape = np.array([np.frombuffer(x, np.int8) for x in column(batch, "shape")]).reshape(-1, len(SHAPES))
            low = np.column_stack([*(shape[:, [SHAPES.index(x) for x in kind]].max(axis=1) for kind in KINDS.values()), human])
            own, n = (batch.column(batch.schema.get_field_index(c)) for c in ("places", "n"))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in low], pa.binary()), pa.array([h.tobytes() for h in harm], pa.binary()), batch.column(batch.schema.get_field_index("shape")), own, n], ["low", "harm", "shape", "places", "n"])

    voted = checkpointed(in_batches(sample, vote, "low binary, harm binary, shape binary, places binary, n long"))
    names = {"low": [*KINDS, "labels"], "harm": ["insults", *(f"words_{g}" for g in range(PARTS)), "labels"]}
    posterior, accuracies, totals = {}, {}, []
    for kind in ("low", "harm"):
        votes, n = _patterns(voted, kind)
        if not len(votes):
            return Scorer(shape_weights=np.full(len(SHAPES), 4.0), intercept=-2.0), Scorer()
        start = np.where((votes[:, :-1] == 1).any(axis=1), 0.9, 0.1)
        bad, rates = expectation_maximisation(votes, start, n, (votes.shape[1] - 1, TRUST, TRUSTED_HITS))
        posterior[kind] = {v.tobytes(): float(p) for v, p in zip(votes, bad)}
        accuracies[kind] = {x: (float(a), float(1 - b)) for x, (a, b) in zip(names[kind], rates)}
        totals.append(((bad * n).sum(), ((1 - bad) * n).sum()))
    shared = context.broadcast(posterior)

    def by_posterior(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bad = np.array([[shared.value[k][v] for v in column(batch, k)] for k in ("low", "harm")]).T
        n = column(batch, "n")[:, None]
        return bad * n, (1 - bad) * n

    chosen = _telling(_counted(voted, 2, by_posterior), totals, WORD_FEATURES)
    out = []
    for kind, words in zip(("low", "harm"), chosen):
        at = ("low", "harm").index(kind)

        def bits(batches: Iterator[pa.RecordBatch], words=words, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                has = [np.packbits(np.isin(words, np.frombuffer(p, "<i4"))).tobytes() for p in column(batch, "places")]
                yield pa.RecordBatch.from_arrays([pa.array(has, pa.binary()), batch.column(at), batch.column(2), batch.column(4)], ["has", "votes", "shape", "n"])

        rows = in_batches(voted, bits, "has binary, votes binary, shape binary, n long").groupBy("has", "votes", "shape").agg(F.sum("n").alias("n")).toPandas()
        x = np.zeros((len(rows), len(words) + len(SHAPES)), np.int8)
        if len(words):
            x[:, : len(words)] = np.unpackbits(np.array([np.frombuffer(h, np.uint8) for h in rows["has"]]), axis=1)[:, : len(words)]
        if kind == "low":
            x[:, len(words) :] = np.array([np.frombuffer(v, np.int8) for v in rows["shape"]]) == 1
        w = logistic(x, np.array([posterior[kind][bytes(v)] for v in rows["votes"]]), rows["n"].to_numpy(float))
        out.append(Scorer(words, w[: len(words)], w[len(words) : -1], float(w[-1]), accuracies[kind]))
    return out[0], out[1]


def classify(docs: DataFrame, scorers: tuple[Scorer, Scorer], text_col: str = "text", threshold: float = 0.5, names: tuple[str, str, str] = ("quality", "toxicity", "keep")) -> DataFrame:
    """`docs` with quality and toxicity (0 to 1) and keep: quality of at least, and toxicity under the threshold.

    A result whose name `docs` has already, in whatever case, gets underscores behind it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorers)
    added = [unused(docs, n) for n in names]
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, harm = shared.value
        known = low.table(), harm.table()
        for batch in batches:
            for part in text_slices(batch, text_at):
                texts = [t or b"" for t in part.column(text_at).cast(pa.binary()).to_pylist()]
                votes, places, offsets = features(texts)
                bad, toxic = low.score(votes, places, offsets, known[0]), harm.score(votes, places, offsets, known[1])
                bad[np.diff(offsets) == 0] = 1.0
                keep = (1 - bad >= threshold) & (toxic < threshold)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 - bad), pa.array(toxic), pa.array(keep)], [*part.schema.names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{n}` {t}" for n, t in zip(added, ("double", "double", "boolean")))])
    return in_batches(docs, run, schema)
