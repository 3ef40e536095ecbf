"""Substring dedup: near-duplicate passages by compact windows over token min-hashes.

Tokens are hashes of five-word shingles. Under one hash function a compact window (left, centre, right) says that the
centre has the least hash of every subsequence that contains it and lies within [left, right]: it stands for all of
them at once. The windows wide enough for a passage of `min_words` words are the nodes of the text's Cartesian tree
whose subtree is that wide; there are about two per passage length, found here from the centres of all
passage-length windows (vectorised sliding minima) and their nearest smaller neighbours.

Windows of different documents with the same least hash share a signature. Within a signature a window has four
classes: the shingle four places to the left of its centre, that to the right, and the least shingle, under another
hash function, of half a passage length on either side. It is joined to the first window (by document, then place)
of each of its classes. That first may be of a document that has only a frequent line with it; so there is a second round.
Where joined intervals of a document held no passage, runs of about half a passage are chosen by least hash; around those that
another document has chosen too, all exact runs of `min_words` words and of half as many are joined to the first document that
has the same run. Runs of `min_words` words are passages by themselves; the shorter ones lead to passages with few edits, of
which some run reaches beyond the frequent line. What is joined depends on the documents alone, not on how rows lie in
partitions.

Signatures are dealt by hash and read as a sorted stream that holds the firsts of the classes of one signature, so
neither a group nor its pairs are ever held. Signatures with more than `HOT_SHARE` of all windows (there are at most
1 / HOT_SHARE) would fill one task: they are found on a sample of documents, the firsts of their classes by a
map-side combined minimum over all documents; these firsts (at most 2560 for each of at most 1000 signatures) are
broadcast, and each window goes with its own firsts to a group of its own. The sample decides only which way is taken: the
joins are the same.

Intervals joined are merged per pair of documents and diagonal, and every pair of either round is verified: a passage is
reported where at least `min_words` words of both documents have shingle sets of Jaccard similarity `similarity` or
more.

Rows: (id, first_word, last_word, source_id, source_first_word, source_last_word, similarity), ends exclusive, the
source being the lesser row; every document of a group of copies points at the group's first. Words are runs of
anything but space and 9 to 13, lower-cased (A-Z). Null and short texts have no passages. Rows are told apart by their id where ids are
whole numbers, unique and not null; else by their number in the order of id (null last) and text, so that rows of one
id are documents of their own. Texts of any length are read whole. Only the id and text columns are read; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataloom.llm.common import CHUNK_BYTES, checkpointed, give_back, hashed_sample, in_batches, keyed, mix, salted_join, shared_folder, shingle_hashes, text_slices, unused, word_hashes

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
FUNCTIONS = 5
#: Share of all windows from which a signature does not go to one task, and documents, about, on which that is estimated.
HOT_SHARE, HOT_SAMPLE = 0.001, 2000
#: Windows that a task hands on at once.
BATCH = 200_000
#: Words around joined intervals that are compared too: these hold the passage, but for a shift by words put in or left out.
MARGIN = 16

#: Keys that are broadcast, at most, to keep the rows of all others from being moved (some 50 bytes each as a hash table).
BROADCAST_KEYS = 1_000_000

#: Of so many runs that follow one another one is chosen.
CHOICE = 10

#: Shingles from the centre to those that name the near classes.
NEAR = SHINGLE - 1

_POS = np.uint64((1 << 26) - 1)
_SEEDS = [mix(np.array([0x51ED270B * (j + 1)], np.uint64))[0] for j in range(32)]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1]) if have < width else out


def _nearest(size: np.ndarray, step: int, outermost: np.ndarray, passes) -> np.ndarray:
    """For each place the nearest one before or after (step) that is not passed, -1 if there is none up to the outermost.

    What a place passes, those that pass it pass too: each goes on from a place to where that one has come, in few rounds.
    """
    at = np.where(outermost, -1, np.arange(step, len(size) + step))
    going = (at >= 0).nonzero()[0]
    while len(going):
        there = at[going]
        passed = passes(size[there], size[going])
        going = going[passed]
        at[going] = at[there[passed]]
        going = going[at[going] >= 0]
    return at


def _extents(keys: np.ndarray, centres: np.ndarray, first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right ends of the compact windows of `centres` (in text order).

    first, last: the first and last passage-length window of which it is the centre; begin, end: the text's range.
    A window that starts later than it could is stopped by a smaller hash right before it; else the next smaller
    hash is itself a centre, the parent in the Cartesian tree, and is looked for among the centres.
    """
    size, new = keys[centres] >> np.uint64(1), begin[1:] != begin[:-1]
    before = _nearest(size, -1, np.append(True, new), np.greater)
    after = _nearest(size, 1, np.append(new, True), np.greater_equal)
    parent_left = np.where(before >= 0, centres[before] + 1, begin)
    parent_right = np.where(after >= 0, centres[after] - 1, end - 1)
    left = np.where(first == centres - width + 1, parent_left, first)
    right = np.where(last == centres, parent_right, last + width - 1)
    return left, right


def compact_windows(words: np.ndarray, offsets: np.ndarray, functions: int = FUNCTIONS, min_words: int = MIN_WORDS) -> Iterator[tuple[np.ndarray, ...]]:
    """Per hash function: (least hash, text, centre, left, right, classes) of all compact windows of all texts.

    Texts are words[offsets[d] : offsets[d + 1]]; centre, left and right are shingle positions within the text. Classes:
    what is four shingles to the left and to the right (8 bits each), and the leasts of either side (10 bits each).
    """
    width = min_words - SHINGLE + 1
    half = (width + 1) // 2
    sizes = np.maximum(np.diff(offsets) - min_words + 1, 0)
    if not sizes.sum():
        return
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts = offsets[text] + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    shingles = shingle_hashes(words, SHINGLE)
    position = np.arange(len(shingles), dtype=np.uint64)
    hashes, keys, sides, minima = [], [], [], []
    for j in range(functions):
        h = mix(shingles ^ _SEEDS[j])
        key = (h & ~_POS) | position
        side = _sliding_min(key, half)
        hashes.append(h)
        keys.append(key)
        sides.append(side)
        minima.append(np.minimum(side[: len(key) - width + 1], side[width - half :][: len(key) - width + 1]))
    for j in range(functions):
        centre_of = (minima[j][starts] & _POS).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(centre_of) != 0) | (np.diff(text) != 0))))
        centres, of = centre_of[cut], text[cut]
        last = starts[np.append(cut[1:], len(starts)) - 1]
        begin, end = offsets[of], offsets[of + 1] - SHINGLE + 1
        left, right = _extents(keys[j], centres, starts[cut], last, begin, end, width)
        near_left = np.where(centres - NEAR >= begin, shingles[np.maximum(centres - NEAR, 0)] >> np.uint64(56), 0)
        near_right = np.where(centres + NEAR < end, shingles[np.minimum(centres + NEAR, len(shingles) - 1)] >> np.uint64(56), 0)
        other = sides[(j + 1) % functions]
        far_left, far_right = (other[np.clip(x, begin, end - half)] >> np.uint64(54) for x in (centres - half + 1, centres))
        classes = np.stack([near_left, near_right, far_left, far_right]).astype(np.int64)
        yield hashes[j][centres].view(np.int64), of, centres - begin, left - begin, right - begin, classes


def _holding(words: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, functions: int) -> np.ndarray:
    """Which texts may have windows with the signatures `wanted`: those that have a shingle with that hash."""
    shingles, mark = shingle_hashes(words, SHINGLE), np.zeros(len(words), bool)
    begins = np.zeros(1 << 16, bool)
    begins[wanted >> 32 & 0xFFFF] = True
    for j in range(functions):
        signatures = mix(shingles ^ _SEEDS[j]).view(np.int64) >> 16
        at = begins[signatures >> 32 & 0xFFFF].nonzero()[0]
        mark[at[np.isin(signatures[at], wanted)]] = True
    total = np.concatenate(([0], mark.cumsum()))
    return total[offsets[1:]] > total[offsets[:-1]]


def _each_windows(batches: Iterator[pa.RecordBatch], functions: int, min_words: int, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """(3, n) arrays of value, key and place, from batches (key, text); with `wanted`, of the texts that have one of these signatures.

    value: signature (48 bits), near classes (8 each); place: centre (27), distances to left and right (8 each, at most
    255: a longer stretch has windows of its own within it), far classes (10 each).
    """
    held, n = [], 0
    for batch in batches:
        for part in text_slices(batch, 1):
            known = [(k, t) for k, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()) if t]
            if not known:
                continue
            words, offsets, *_ = word_hashes([t for _, t in known])
            keys = np.array([k for k, _ in known], np.int64)
            if wanted is not None:
                have, sizes = _holding(words, offsets, wanted, functions), np.diff(offsets)
                words, keys, offsets = words[np.repeat(have, sizes)], keys[have], np.concatenate(([0], np.cumsum(sizes[have])))
            for value, of, centre, left, right, (near_left, near_right, far_left, far_right) in compact_windows(words, offsets, functions, min_words):
                place = centre << 36 | np.minimum(centre - left, 255) << 28 | np.minimum(right - centre, 255) << 20 | far_left << 10 | far_right
                held.append(np.stack([value & ~0xFFFF | near_left << 8 | near_right, keys[of], place]))
                n += len(value)
            if n >= BATCH:
                yield np.concatenate(held, axis=1)
                held, n = [], 0
    if held:
        yield np.concatenate(held, axis=1)


def _classes(value: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The four classes of windows, as numbers below 2560 that do not meet."""
    return [value >> 8 & 0xFF, 256 + (value & 0xFF), 512 + (place >> 10 & 0x3FF), 1536 + (place & 0x3FF)]


def _hot_groups(rows: DataFrame, functions: int, min_words: int) -> np.ndarray:
    """Signatures with `HOT_SHARE` of the windows of a sample of documents, sorted; at most 1 / HOT_SHARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, *_ in _each_windows(batches, functions, min_words):
            names, n = np.unique(value >> 16, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], ["g", "n"])

    sample = hashed_sample(rows.select("key", "text"), F.col("key"), HOT_SAMPLE)
    counted = checkpointed(in_batches(sample, run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return np.sort(counted.where(F.col("n") >= max(2, HOT_SHARE * total)).select("g").toPandas()["g"].to_numpy(np.int64))


def _first_of(code: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where each code's first window, by key and place, is."""
    order = np.lexsort((place, key, code))
    return order[np.concatenate(([True], np.diff(code[order]) != 0))] if len(order) else order


def _hot_firsts(rows: DataFrame, hot: np.ndarray, functions: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, key, place) of the first window of every class of the hot signatures, sorted by code (signature and class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty((3, 0), np.int64)
        for value, key, place in _each_windows(batches, functions, min_words, hot):
            at = np.minimum(np.searchsorted(hot, value >> 16), len(hot) - 1)
            mine = np.flatnonzero(hot[at] == value >> 16)
            if not len(mine):
                continue
            codes = np.concatenate([at[mine] * 4096 + c for c in _classes(value[mine], place[mine])])
            all_ = np.concatenate([best, np.stack([codes, np.tile(key[mine], 4), np.tile(place[mine], 4)])], axis=1)
            best = all_[:, _first_of(*all_)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["code", "key", "place"])

    firsts = in_batches(rows.select("key", "text"), run, "code long, key long, place long").groupBy("code").agg(F.min(F.struct("key", "place")).alias("m"))
    found = firsts.select("code", "m.key", "m.place").toPandas().sort_values("code")
    return tuple(found[c].to_numpy(np.int64) for c in ("code", "key", "place"))


def _windows(rows: DataFrame, functions: int, min_words: int) -> DataFrame:
    """Rows (value, key, place) as they are dealt; see _each_windows.

    A window of a hot signature is dealt with the first of each of its classes, to a group of just these two.
    """
    hot = _hot_groups(rows, functions, min_words)
    shared = rows.sparkSession.sparkContext.broadcast((hot, _hot_firsts(rows, hot, functions, min_words) if len(hot) else None))  # bounded, see the module

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, firsts = shared.value
        for dealt in _each_windows(batches, functions, min_words):
            if len(hot):
                at = np.minimum(np.searchsorted(hot, dealt[0] >> 16), len(hot) - 1)
                is_hot = hot[at] == dealt[0] >> 16
                dealt = np.concatenate([dealt[:, ~is_hot], *_with_firsts(dealt[:, is_hot], at[is_hot], firsts)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in dealt], ["value", "key", "place"])

    return in_batches(rows.select("key", "text"), run, "value long, key long, place long")


def _with_firsts(windows: np.ndarray, at: np.ndarray, firsts: tuple[np.ndarray, ...]) -> Iterator[np.ndarray]:
    """Windows of hot signatures (number `at`), and the firsts of their classes, each two in a group of their own."""
    value, key, place = windows
    codes, keys, places = firsts
    known: list[np.ndarray] = []
    for c in _classes(value, place):
        first = np.searchsorted(codes, at * 4096 + c)
        new = keys[first] != key
        for earlier in known:
            new &= (keys[earlier] != keys[first]) | (places[earlier] != places[first])
        known.append(first)
        mine, theirs = np.flatnonzero(new), first[new]
        group = mix((mix((value[mine] ^ key[mine]).view(np.uint64)) ^ place[mine].view(np.uint64)) + mix(keys[theirs].view(np.uint64)) + places[theirs].view(np.uint64))
        # the two rows agree in this class; of the near ones, which the first's row does not tell, both get the window's
        group = group.view(np.int64) & ~0xFFFF | value[mine] & 0xFFFF
        yield np.stack([group, key[mine], place[mine]])
        yield np.stack([group, keys[theirs], places[theirs]])


def _joined_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins windows, sorted by (signature, key, place), to the first of each of their classes."""
    carry = np.empty((3, 0), np.int64)  # the firsts of the classes of the signature that the last batch ended in
    for batch in batches:
        fresh = np.stack([batch.column(i).to_numpy() for i in range(3)])
        if not fresh.shape[1]:
            continue
        if carry.shape[1] and carry[0, 0] >> 16 != fresh[0, 0] >> 16:
            carry = np.empty((3, 0), np.int64)
        rows, old = np.concatenate([carry, fresh], axis=1), carry.shape[1]
        group = rows[0] >> 16
        same = group[1:] == group[:-1]
        at = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        if not len(at):
            carry = rows[:, -1:]
            continue
        value, key, place = rows[:, at]
        number = np.cumsum(np.concatenate(([True], np.diff(group[at]) != 0))) - 1
        firsts = []
        for c in _classes(value, place):
            _, first, back = np.unique(number << 12 | c, return_index=True, return_inverse=True)
            firsts.append(first[back])
        member = np.flatnonzero(at >= old)
        a, b = [], []
        for i, first in enumerate(firsts):
            new = key[first[member]] != key[member]
            for earlier in firsts[:i]:
                new &= earlier[member] != first[member]
            a.append(member[new])
            b.append(first[member[new]])
        a, b = np.concatenate(a), np.concatenate(b)
        ca, cb = place[a] >> 36, place[b] >> 36
        low = np.minimum(place[a] >> 28 & 255, place[b] >> 28 & 255)
        high = np.minimum(place[a] >> 20 & 255, place[b] >> 20 & 255)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[a]), pa.array(key[b]), pa.array((ca - cb).astype(np.int32)), pa.array((ca - low).astype(np.int32)), pa.array((ca + high).astype(np.int32))],
            ["a", "b", "diagonal", "low", "high"],
        )
        if at[-1] == rows.shape[1] - 1:
            of_last = np.flatnonzero(number == number[-1])
            carry = rows[:, at[np.unique([first[of_last] for first in firsts])]]
        else:
            carry = rows[:, -1:]


def _dense(hit: np.ndarray, width: int, least: int) -> list[tuple[int, int, int, int]]:
    """Maximal unions of windows of `width` positions with at least `least` hits: (begin, end) trimmed to hits as far
    as `width` positions stay, and the union's own (begin, end)."""
    if len(hit) < width:
        return []
    total = np.zeros(len(hit) + 1, np.int64)
    hit.cumsum(out=total[1:])
    good = (total[width:] - total[:-width] >= least).nonzero()[0]
    if not len(good):
        return []
    cuts = (good[1:] - good[:-1] > width).nonzero()[0]
    out = []
    for x, y in zip([int(good[0]), *good[cuts + 1].tolist()], [*good[cuts].tolist(), int(good[-1])]):
        y += width
        part = hit[x:y]
        begin = min(x + int(part.argmax()), y - width)
        out.append((begin, max(y - int(part[::-1].argmax()), begin + width), x, y))
    return out


def common_passages(a: np.ndarray, b: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Near-duplicate passages of two shingle sequences: (first, last, first in b, last in b, Jaccard) in shingles.

    A passage that is dense but, as a whole, not similar enough is split by asking for more hits, down to exact runs.
    """
    width = min_words - SHINGLE + 1
    loosest = int(np.ceil(width * 2 * similarity / (1 + similarity)))  # as many hits leave that Jaccard similarity
    names, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, out = codes[: len(a)], codes[len(a) :], []

    def those(part: np.ndarray) -> np.ndarray:
        held = np.zeros(len(names), bool)
        held[part] = True
        return held

    hit = those(b)[a]
    todo = [(0, len(a), loosest)]
    while todo:
        begin, end, least = todo.pop()
        for x, y, *union in _dense(hit[begin:end], width, least):
            x, y = begin + x, begin + y
            mine, best = those(a[x:y]), None
            n = np.count_nonzero(mine)
            for u, v, *_ in _dense(mine[b], width, least):
                theirs = those(b[u:v])
                joint = np.count_nonzero(mine & theirs)
                jaccard = joint / (n + np.count_nonzero(theirs) - joint)
                if best is None or jaccard > best[4]:
                    best = (x, y, u, v, jaccard)
            if best and best[4] >= similarity:
                out.append(best)
            elif least < width:
                todo.append((begin + union[0], begin + union[1], least + 1))
    return sorted(out)


def _with_shingles(batches: Iterator[pa.RecordBatch], key_at: int, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows and the shingles of each row's text; rows of one key have one text, hashed once where they adjoin."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key_at).to_numpy()
        sizes = pc.binary_length(batch.column(text_at)).to_numpy().astype(np.int64)
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        ends, start = np.cumsum(np.where(new, sizes, 0)), 0
        while start < batch.num_rows:
            stop = max(start + 1, min(start + 512, int(np.searchsorted(ends, ends[start] - sizes[start] + CHUNK_BYTES, side="right"))))
            part, fresh = batch.slice(start, stop - start), new[start:stop].copy()
            fresh[0] = True
            texts = part.column(text_at).take(pa.array(np.flatnonzero(fresh))).cast(pa.binary()).to_pylist()
            words, offsets, *_ = word_hashes(texts)
            found = [shingle_hashes(words[x:y], SHINGLE).astype(np.uint32) for x, y in zip(offsets, offsets[1:])]
            yield part, [found[i] for i in np.cumsum(fresh) - 1]
            start = stop


def _regions(diagonals: list[int], lows: list[int], highs: list[int], margin: int) -> list[list[int]]:
    """Joined intervals of a pair, widened by the margin, as few regions (begin, end, source begin, source end)."""
    spans: list[list[int]] = []
    for low, high, diagonal in sorted(zip(lows, highs, diagonals)):
        s_low, s_high = max(0, low - diagonal - margin), high - diagonal + margin
        low, high = max(0, low - margin), high + margin
        if spans and low <= spans[-1][1] and s_low <= spans[-1][3] + margin and s_high >= spans[-1][2] - margin:
            last = spans[-1]
            spans[-1] = [last[0], max(last[1], high), min(last[2], s_low), max(last[3], s_high)]
        else:
            spans.append([low, high, s_low, s_high])
    return spans


def _may_share(mine: list[np.ndarray], theirs: list[np.ndarray], width: int, least: int) -> np.ndarray:
    """Which pairs of shingle sequences have `least` of some `width` adjacent shingles of the first in the second."""
    sizes = np.fromiter(map(len, mine), np.int64, len(mine))
    a = np.repeat(np.arange(len(mine), dtype=np.uint64) << np.uint64(32), sizes) | np.concatenate(mine)
    b = np.repeat(np.arange(len(theirs), dtype=np.uint64) << np.uint64(32), [len(x) for x in theirs]) | np.concatenate(theirs)
    b.sort()
    at = np.searchsorted(b, a)
    hit = np.zeros(len(a), bool) if not len(b) else b[np.minimum(at, len(b) - 1)] == a
    total, begin = np.concatenate(([0], np.cumsum(hit))), np.cumsum(sizes) - sizes
    good = np.zeros(len(mine), bool)
    if len(a) >= width:
        start = np.flatnonzero(total[width:] - total[:-width] >= least)
        of = np.searchsorted(begin, start, side="right") - 1
        good[of[start + width <= begin[of] + sizes[of]]] = True
    return good


_REGION = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("source_begin", pa.int32()), ("source", pa.binary())])


def _written(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: columnar files take a fraction of a checkpoint's room."""
    folder = shared_folder(rows.sparkSession, "passages")
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _only(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose `column` is in that of `wanted`; all rows, where its values are too many to be broadcast.

    What follows joins the rows by that column anyhow: this only saves moving rows that the join would drop.
    """
    keys = wanted.select(column).distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return rows
    return rows.join(F.broadcast(keys), column, "left_semi")


def _pairs(links: DataFrame) -> DataFrame:
    """Rows (a, b, regions) of joined intervals (a, b, diagonal, low, high)."""
    merged = links.repartition("a", "b").groupBy("a", "b", "diagonal").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return _written(merged.groupBy("a", "b").agg(F.collect_list(F.struct("diagonal", "low", "high")).alias("regions")))


def _run_hashes(shingles: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` shingles from each place, from those of runs of 1, 2, 4, ... shingles."""
    n = len(shingles) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    level, have, used, out = mix(shingles.astype(np.uint64) + np.uint64(size)), 1, 0, None
    while used < size:
        if size & have:
            part = level[used : used + n]
            out = part if out is None else out * np.uint64(0xD6E8FEB86659FD93) + part
            used += have
        if used < size:
            level = level[:-have] * np.uint64(0x9E3779B97F4A7C15) + level[have:]
            have *= 2
    return mix(out)


class _Unverified:
    """Where one document was joined and no passage was found, and a choice of the runs of shingles there.

    Of every `CHOICE` runs that follow one another the one with the least hash is chosen: documents that share a longer stretch
    choose a run in common.
    """

    def __init__(self, min_words: int):
        self.width, self.size = min_words - SHINGLE + 1, _short_run(min_words)
        self.key, self.shingles = None, None

    def take(self, key: int, shingles: np.ndarray) -> None:
        self.key, self.shingles = key, shingles
        self.joined = np.zeros(len(shingles) + 1, np.int32)  # of places: +1 where a region begins, -1 behind its end
        self.found: list[tuple[int, int]] = []

    def region(self, begin: int, end: int) -> None:
        self.joined[min(begin, len(self.shingles))] += 1
        self.joined[min(end, len(self.shingles))] -= 1

    def _open(self, size: int, inside: np.ndarray) -> np.ndarray:
        """Whether the run of `size` shingles from each place is in a region and in no passage found; inside: places in regions before each."""
        good = inside[size:] - inside[:-size] == size if len(inside) > size else np.zeros(0, bool)
        for first, last in self.found:
            good[first : max(first, last - size + 1)] = False
        return good

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of the chosen runs in regions that lie in no passage found."""
        inside = np.zeros(len(self.joined), np.int64)
        (self.joined.cumsum()[:-1] > 0).cumsum(out=inside[1:])
        open_ = self._open(self.size, inside)
        if self.found:  # and those within a run of a whole passage that reaches out of what was found
            reach, long = self.width - self.size, self._open(self.width, inside)
            if long.any():
                total = np.zeros(len(long) + 1, np.int64)
                long.cumsum(out=total[1:])
                q = np.arange(len(open_))
                open_ |= total[np.minimum(q + 1, len(long))] > total[np.clip(q - reach, 0, len(long))]
        at = open_.nonzero()[0]
        if not len(at):
            return np.empty(0, np.int64), at
        hashes = _run_hashes(self.shingles, self.size)[at]
        keys = (hashes & ~_POS) | np.arange(len(at), dtype=np.uint64)
        chosen = [np.empty(0, np.uint64)]
        for part in np.split(keys, np.flatnonzero(np.diff(at) > 1) + 1):
            chosen.append(_sliding_min(part, min(CHOICE, len(part))) if len(part) else part)
        chosen = np.unique(np.concatenate(chosen) & _POS).astype(np.int64)
        return hashes[chosen].view(np.int64), at[chosen]


def _short_run(min_words: int) -> int:
    """Shingles of about half a passage."""
    return (min_words - SHINGLE + 1) // 2 - SHINGLE // 2


def _passages(rows: DataFrame, pairs: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """The passages of pairs of rows (key, id, text), and, per row with places where none was found, their runs.

    Rows (key, id, first_word, last_word, source_id, ..., runs, places): either a passage or runs.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    width = min_words - SHINGLE + 1
    loosest = int(np.ceil(width * 2 * similarity / (1 + similarity)))

    def cut_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shingles in _with_shingles(batches, 1, 2):
            lists = part.column(3)
            flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy())
            diagonals, lows, highs = (flat.field(i).to_pylist() for i in range(3))
            out, counts, x = [], [0], 0
            for known, y in zip(shingles, ends.tolist()):
                spans = _regions(diagonals[x:y], lows[x:y], highs[x:y], MARGIN)
                out += [(a, b, u, known[u : v + 1].astype("<u4").tobytes()) for a, b, u, v in spans]
                counts.append(len(out))
                x = y
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _REGION)]
            regions = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_REGION)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), regions], ["a", "source_id", "regions"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "first_word", "last_word", "source_id", "source_first_word", "source_last_word", "similarity", "runs", "places"]
        lost = _Unverified(min_words)
        id_arrow, left = pa.int64(), []

        def keep() -> None:
            if lost.key is not None and len((found := lost.runs())[0]):
                left.append((lost.key, *found))

        def unverified() -> pa.RecordBatch:
            keys, runs, places = zip(*left)
            nothing = [pa.nulls(len(keys), t) for t in (id_arrow, pa.int32(), pa.int32(), id_arrow, pa.int32(), pa.int32(), pa.float64())]
            ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(t))) for x, t in ((runs, np.int64), (places, np.int32))]
            left.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *nothing, *lists], names)

        for part, shingles in _with_shingles(batches, 0, 2):
            id_arrow = part.column(1).type
            lists = part.column(4)
            flat, row = lists.flatten(), np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
            begins, ends, s_begins, sources = (flat.field(i).to_pylist() for i in range(4))
            mine = [shingles[r][x : y + 1] for r, x, y in zip(row.tolist(), begins, ends)]
            theirs = [np.frombuffer(s, "<u4") for s in sources]
            may = _may_share(mine, theirs, width, loosest)
            keys = part.column(0).to_pylist()
            out, of = [], []
            for i, r in enumerate(row.tolist()):
                if keys[r] != lost.key:
                    keep()
                    lost.take(keys[r], shingles[r])
                x, u = begins[i], s_begins[i]
                lost.region(x, x + len(mine[i]))
                if may[i]:
                    for first, last, s_first, s_last, jaccard in common_passages(mine[i], theirs[i], min_words, similarity):
                        of.append(r)
                        out.append((x + first, x + last + SHINGLE - 1, u + s_first, u + s_last + SHINGLE - 1, jaccard))
                        lost.found.append((x + first, x + last))
            at = pa.array(of, pa.int64())
            first, last, s_first, s_last = (pa.array([r[i] for r in out], pa.int32()) for i in range(4))
            none = [pa.nulls(len(of), pa.list_(t)) for t in (pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), first, last, part.column(3).take(at), s_first, s_last, pa.array([r[4] for r in out], pa.float64()), *none], names
            )
            if left:
                yield unverified()
        keep()
        if left:
            yield unverified()

    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    texts = _only(rows.select("key", "text", "id"), "key", ends)  # moved once for both joins
    sources = texts.select(F.col("key").alias("b"), "text", F.col("id").alias("source_id"))
    with_source = pairs.join(sources, "b").select("a", "b", "text", "regions", "source_id")
    cut = in_batches(with_source, cut_source, f"a long, source_id {id_type}, regions array<struct<begin:int,end:int,source_begin:int,source:binary>>")
    members = texts.select(F.col("key").alias("a"), "text", "id")
    both = cut.join(members, "a").select("a", "id", "text", "source_id", "regions")
    return in_batches(
        both, verify,
        f"key long, id {id_type}, first_word int, last_word int, source_id {id_type}, source_first_word int, source_last_word int, similarity double, runs array<long>, places array<int>",
    )


def _shared(runs: DataFrame) -> DataFrame:
    """Rows (run, key, place, ...) whose run another document has too, with the first such document and its place (b, at)."""
    firsts = runs.groupBy("run").agg(F.min(F.struct("key", "place")).alias("first"), F.max("key").alias("last_key")).where(F.col("first.key") < F.col("last_key"))
    firsts = checkpointed(firsts.select("run", F.col("first.key").alias("b"), F.col("first.place").alias("at")))
    return salted_join(_only(runs, "run", firsts), firsts, "run", F.col("key"))


def _runs_again(rows: DataFrame, unverified: DataFrame, min_words: int) -> DataFrame:
    """Joined intervals (a, b, diagonal, low, high) of the documents that share a chosen run: by all runs around it.

    unverified: rows (key, runs, places). Runs of a whole passage are exact passages; the shorter ones lead to those with edits.
    """
    width = min_words - SHINGLE + 1
    chosen = unverified.select("key", F.explode(F.arrays_zip("runs", "places")).alias("r")).select(F.col("r.runs").alias("run"), "key", F.col("r.places").alias("place"))
    places = checkpointed(_shared(chosen).groupBy("key").agg(F.collect_set("place").alias("places")))
    texts = _only(rows, "key", places).join(places, "key").select("key", "text", "places")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shingles in _with_shingles(batches, 0, 1):
            for key, known, near in zip(part.column(0).to_pylist(), shingles, part.column(2).to_pylist()):
                mark = np.zeros(len(known) + 1, np.int32)
                near = np.array(near)
                np.add.at(mark, np.maximum(near - width, 0), 1)
                np.add.at(mark, np.minimum(near + width, len(known)), -1)
                inside = np.cumsum(mark)[:-1] > 0
                for size in (width, _short_run(min_words)):
                    at = np.flatnonzero(inside[: max(len(known) - size + 1, 0)])
                    columns = [_run_hashes(known, size)[at].view(np.int64), np.full(len(at), key), at.astype(np.int32), np.full(len(at), size, np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["run", "key", "place", "length"])

    runs = _written(in_batches(texts, around, "run long, key long, place int, length int"))
    shared = _shared(runs).where("key <> b")
    wider = F.lit(width) - F.col("length")  # a passage that holds a run reaches so far on either side
    low, high = F.col("place") - wider, F.col("place") + F.col("length") - 1 + wider
    return shared.select(F.col("key").alias("a"), "b", (F.col("place") - F.col("at")).alias("diagonal"), F.greatest(low, F.lit(0)).alias("low"), high.alias("high"))


def _found(rows: DataFrame, min_words: int, similarity: float, functions: int) -> DataFrame:
    """The passages of rows (key, id, text): key, id, first_word, last_word, source_id, source_first_word, ..."""
    dealt = _windows(rows, functions, min_words)
    signature = F.shiftright("value", 16)
    dealt = dealt.repartition(signature).sortWithinPartitions(signature, "key", "place")
    links = in_batches(dealt, _joined_intervals, "a long, b long, diagonal int, low int, high int")
    once = _written(_passages(rows, _pairs(links), min_words, similarity))
    links = _runs_again(rows, once.where("runs is not null").select("key", "runs", "places"), min_words)
    again = _passages(rows, _pairs(links), min_words, similarity)
    # a pair of both rounds may have a passage twice
    return once.where("runs is null").union(again.where("runs is null")).drop("runs", "places").distinct()


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
    functions: int = FUNCTIONS,
) -> DataFrame:
    """All passages that near-duplicate a passage of a lesser row; see the module for the columns."""
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "key", "id", "text")
    return _found(rows, min_words, similarity, functions).drop("key").withColumnRenamed("id", id_col)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words [first, last) of each span, nor the white space before them."""
    words = list(_WORD.finditer(text))
    gone = np.zeros(len(words) + 1, np.int8)
    for first, last in spans:
        gone[first:last] = 1
    if not gone.any():
        return text
    out, at = [], 0
    for i, word in enumerate(words):
        if not gone[i]:
            out.append(text[at : word.end()])
        at = word.end()
    kept = "".join(out)
    return kept.lstrip() if gone[0] else kept


def cut_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
    functions: int = FUNCTIONS,
) -> DataFrame:
    """`docs` without their repeated passages (the first row that has one keeps it); all columns stay, in order.

    Rows are told apart as the module says, so that of rows of one id only those lose words that repeat others'.
    """
    key, gone, of = (unused(docs, x) for x in ("cut_row", "cut_spans", "cut_of"))
    rows = keyed(docs, key, id_col, text_col)
    passages = _found(rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), min_words, similarity, functions)
    spans = passages.groupBy(F.col("key").alias(of)).agg(F.collect_set(F.struct("first_word", "last_word")).alias(gone))

    @F.pandas_udf("string")
    def cut(texts, spans):
        try:
            return texts.combine(spans, lambda t, s: t if t is None or s is None or not len(s) else without_words(t, [(x["first_word"], x["last_word"]) for x in s]))
        finally:
            give_back()

    joined = rows.join(spans, F.col(key) == F.col(of), "left")
    new_text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(gone)))
    return joined.select(*[new_text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
