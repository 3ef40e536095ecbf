"""Embedding near-duplicates: all pairs above a cosine threshold, and their resolution.

The pairs are exact, and found by metric pruning where that pays. Angles between vectors obey the triangle inequality, so with `t` the
angle of the threshold:

* centres are vectors of a hashed sample that lie far apart; every vector is at home in the cell of its nearest one, and each cell has
  a radius, the largest angle of its vectors to its centre;
* a vector at home in cell i is a guest of a lesser cell j only where its angle to centre j is at most the radius of j plus t, and
  at most its angle to its own centre plus 2 t: further away nothing of cell j can be within t of it;
* a cell of more than one block is cut into rings by the angle to the centre, each at least t wide: only neighbouring rings
  can hold pairs. A ring of more than one block is dealt to blocks by hash.

Where that would send rows to more groups than pruning saves (vectors without clusters, low thresholds), there is one cell of one ring:
all rows are dealt to blocks by hash, and each row goes once to each of the other blocks. A block is as large as a task's memory
allows, so that few copies are sent.

Each unordered pair of blocks that can hold pairs is one group of bounded size, compared in tiles in a task; a cell of
at most a block goes to its group once. A tile's product is taken in single precision, with a margin of more than its error; what
passes is computed again in double precision, so that a pair's similarity depends on its two vectors alone. Only pairs at or above
the threshold leave a task, in batches of bounded size. On clustered vectors the compared
pairs grow with the clusters' sizes; where nothing can be pruned they are those of an all-pairs join in blocks. What
the driver gets and sends is bounded: at most `MAX_CENTRES` centres and radii, and the sizes of their rings.

Null vectors, and vectors with NaN, match nothing. All vectors have one dimension. Vectors shorter than `FLOOR` count as that
long. Rows of one id are no pair.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataloom.functions.text import preview
from dataloom.session import checkpointed

FLOOR = 1e-10
#: Centres, at most; centres for each block of all rows; vectors of the sample for each centre; rings of a cell, at most.
MAX_CENTRES, CENTRES_PER_BLOCK, SAMPLE_PER_CENTRE, MAX_RINGS = 1024, 4, 8, 32
#: Angle by which bounds are widened, so that rounding prunes nothing.
SLACK = 1e-5
#: Rows whose angles to all centres are in memory at once.
TILE = 512
#: Rows for which there are CENTRES_PER_BLOCK centres, at most; blocks that all rows make at least, where blocks of that size do;
#: rows of a block, at most; groups beyond those of unpruned blocks to which pruning may send a row, on average.
CELL_ROWS, MANY_BLOCKS, MAX_BLOCK, MORE_GROUPS = 2896, 12, 32768, 8
#: Rows and columns of a product; pairs computed, and bytes of vectors sent, at once.
ROWS, COLUMNS, PAIRS_AT_ONCE, BYTES_AT_ONCE = 512, 4096, 1 << 16, 4 << 20


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.greatest(F.sqrt(squares), F.lit(FLOOR))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def block_rows(dim: int, n: int = 0, budget_bytes: int = 64 << 20) -> int:
    """Vectors of a block such that two of them, as doubles, stay within the budget; fewer where n rows would make few blocks."""
    return max(128, min(MAX_BLOCK, max(CELL_ROWS, -(-n // MANY_BLOCKS)), budget_bytes // (16 * max(dim, 1))))


def _values(vectors: pa.Array, kind: str) -> np.ndarray:
    """The numbers of packed vectors, a row for each."""
    return np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), kind)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), FLOOR)
    return v


def _far_apart(v: np.ndarray, k: int) -> np.ndarray:
    """k of the vectors as units, each the farthest from those before it: every cluster has one before any has two."""
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), FLOOR)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(k, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


@dataclass(frozen=True)
class PairPlan:
    """Which blocks meet: cells with their radii, and the sizes of their rings (by cell, ring, and home or guest).

    kind: of the numbers of packed vectors.
    """

    threshold: float
    centres: np.ndarray
    radii: np.ndarray
    size: int
    sizes: np.ndarray | None = None
    kind: str = "f8"

    @property
    def angle(self) -> float:
        return math.acos(min(1.0, max(-1.0, self.threshold)))

    @property
    def ring_width(self) -> float:
        return max(self.angle + SLACK, math.pi / MAX_RINGS)

    def places(self, unit: np.ndarray, home: np.ndarray, to_home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, ring, guest) of every cell that a row is in."""
        angles = _angles(unit, self.centres)
        reach = np.minimum(self.radii + self.angle, to_home[:, None] + 2 * self.angle) + SLACK
        guest = (angles <= reach) & (np.arange(len(self.centres)) < home[:, None])
        row, cell = np.nonzero(guest)
        every = np.arange(len(unit))
        rows, cells = np.concatenate([every, row]), np.concatenate([home, cell])
        ring = (np.concatenate([to_home, angles[row, cell]]) / self.ring_width).astype(np.int64)
        return rows, cells, ring, np.repeat([0, 1], [len(every), len(row)])

    @property
    def whole(self) -> np.ndarray:
        """Cells that are one group."""
        return self.sizes.sum(axis=(1, 2)) <= self.size

    def splits(self) -> np.ndarray:
        """Blocks of each ring; none where neither it nor a neighbour, from which rounding may move a row, has rows."""
        blocks = np.maximum(1, -(-self.sizes // self.size))
        near = self.sizes.copy()
        if self.pruned:
            near[:, 1:] += self.sizes[:, :-1]
            near[:, :-1] += self.sizes[:, 1:]
        return np.where(near > 0, blocks, 0)

    @property
    def pruned(self) -> bool:
        return len(self.centres) > 1

    def sent(self) -> int:
        """Rows that groups get."""
        sizes, splits, whole = self.sizes.astype(object), self.splits().astype(object), self.whole
        meets = splits.copy()  # blocks of the own ring and its neighbours
        meets[:, 1:] += splits[:, :-1]
        meets[:, :-1] += splits[:, 1:]
        home, guest = (sizes[:, :, 0] * meets.sum(axis=2)).sum(axis=1), (sizes[:, :, 1] * meets[:, :, 0]).sum(axis=1)
        return int(sum(sizes[c].sum() if whole[c] else home[c] + guest[c] for c in range(len(sizes))))

    def compared(self) -> int:
        """Pairs of rows that are compared."""
        home, guest = self.sizes[:, :, 0].astype(object), self.sizes[:, :, 1].astype(object)
        total = 0
        for c, whole in enumerate(self.whole):
            h, g = home[c], guest[c]
            if whole:
                total += h.sum() * (h.sum() - 1) // 2 + h.sum() * g.sum()
                continue
            total += sum(x * (x - 1) // 2 + x * y for x, y in zip(h, g))
            total += sum(h[i] * h[i + 1] + h[i] * g[i + 1] + h[i + 1] * g[i] for i in range(len(h) - 1))
        return int(total)


_PLACED = "cell int, angle double, id {}, v binary"


def _placed(present: DataFrame, centres: np.ndarray, kind: str) -> DataFrame:
    """Rows (cell, angle, id, v): every vector, packed, with its nearest centre."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                part = batch.slice(start, TILE)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(part.num_rows, -1)
                home, nearest = np.zeros(len(v), np.int64), np.zeros(len(v))
                if len(centres) > 1:
                    angles = _angles(_unit(v), centres)
                    home = angles.argmin(axis=1)
                    nearest = angles[np.arange(len(home)), home]
                packed = pa.array([x.tobytes() for x in v], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(nearest), part.column(0), packed], ["cell", "angle", "id", "v"])

    return present.mapInArrow(run, _PLACED.format(present.schema["id"].dataType.simpleString()))


def _tiles(plan: PairPlan, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            part = batch.slice(start, TILE)
            if plan.pruned:
                yield part, plan.places(_unit(_values(part.column(3), plan.kind)), part.column(0).to_numpy().astype(np.int64), part.column(1).to_numpy())
            else:
                nothing = np.zeros(part.num_rows, np.int64)
                yield part, (np.arange(part.num_rows), nothing, nothing, nothing)


def _ring_sizes(placed: DataFrame, plan: PairPlan) -> np.ndarray:
    """Rows by cell, ring, and home or guest; at most MAX_CENTRES * (MAX_RINGS + 1) * 2 numbers."""
    shape = (len(plan.centres), MAX_RINGS + 1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(math.prod(shape), np.int64)
        for _, (_, cell, ring, guest) in _tiles(plan, batches):
            total += np.bincount(np.ravel_multi_index((cell, ring, guest), shape), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counted = placed.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    sizes = np.zeros(math.prod(shape), np.int64)
    sizes[counted["at"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return sizes.reshape(shape)


def _guests(threshold: float, centres: np.ndarray, sample: np.ndarray) -> float:
    """Cells that a row of the sample is a guest of, on average; the sample's radii are no larger than those of all rows."""
    unit = _unit(sample)
    angles = [_angles(unit[i : i + TILE], centres) for i in range(0, len(unit), TILE)]
    home, nearest = np.concatenate([a.argmin(axis=1) for a in angles]), np.concatenate([a.min(axis=1) for a in angles])
    radii = np.full(len(centres), -np.inf)
    np.maximum.at(radii, home, nearest)
    plan, n = PairPlan(threshold, centres, radii, 1), len(unit)
    return sum(len(plan.places(unit[i : i + TILE], home[i : i + TILE], nearest[i : i + TILE])[0]) for i in range(0, n, TILE)) / n - 1


def pair_plan(rows: DataFrame, threshold: float, id_col: str = "id", vector: str = "embedding", block: int | None = None) -> tuple[PairPlan, DataFrame]:
    """The plan of a join, and the vectors in their home cells."""
    kind = "f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "f8"  # floats stay floats
    numbers = F.col(vector) if kind == "f4" else F.col(vector).cast("array<double>")
    present = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), numbers.alias("v"))
    present = checkpointed(present.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # a vector under the floor has no angle; it can reach the threshold only where that is nearly nothing
    short = F.max(((length < FLOOR) & (length >= threshold * FLOOR)).cast("int"))
    n, dim, unmetric = present.agg(F.count("*"), F.max(F.size("v")), short).first()
    size = block or block_rows(dim or 1, n)
    sizes = np.zeros((1, MAX_RINGS + 1, 2), np.int64)
    sizes[0, 0, 0] = n
    # one centre of zero: all meet in one cell and ring
    plain = PairPlan(threshold, np.zeros((1, dim or 1)), np.zeros(1), size, sizes, kind)
    most = plain.sent() + MORE_GROUPS * n
    k = 1 if unmetric or threshold <= 0 or n <= size else min(MAX_CENTRES, math.ceil(CENTRES_PER_BLOCK * n / min(size, CELL_ROWS)))
    if k > 1:
        sample = np.stack(present.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CENTRE * k).select("v").toPandas()["v"].map(lambda x: np.asarray(x, float)).tolist())
        centres = _far_apart(sample, k)
        if len(centres) > 1 and _guests(threshold, centres, sample) * n <= most:
            placed = checkpointed(_placed(present, centres, kind))
            found = placed.groupBy("cell").agg(F.max("angle").alias("radius")).toPandas()
            radii = np.full(len(centres), -np.inf)
            radii[found["cell"].to_numpy(np.int64)] = found["radius"].to_numpy(float)
            plan = PairPlan(threshold, centres, radii, size, None, kind)
            plan = replace(plan, sizes=_ring_sizes(placed, plan))
            if plan.sent() <= most and plan.compared() < plain.compared():
                return plan, placed
    return plain, _placed(present, plain.centres, kind)


def _spread_of(text: str | None) -> int:
    """A number that is the same in every process."""
    return zlib.crc32(text.encode()) if text is not None else 0


def _deal(placed: DataFrame, plan: PairPlan) -> DataFrame:
    """Rows (cell, x, y, side, id, v): every row for each pair of blocks (x, y) of a cell that it is in; side has bit 1 for x, 2 for y."""
    id_type = placed.schema["id"].dataType.simpleString()
    shared = placed.sparkSession.sparkContext.broadcast(plan)  # bounded, see the module

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        whole, splits = plan.whole, plan.splits()
        at_once = max(1, BYTES_AT_ONCE // (plan.centres.shape[1] * int(plan.kind[1])))
        for part, (row, cell, ring, guest) in _tiles(plan, batches):
            ids = part.column(2)
            spread = np.fromiter(map(_spread_of, pc.cast(ids, pa.string()).to_pylist()), np.int64, len(ids))
            alone = whole[cell]
            out = [(row[alone], cell[alone], np.zeros(alone.sum(), np.int64), np.zeros(alone.sum(), np.int64), np.where(guest[alone] == 1, 2, 3))]
            row, cell, ring, guest = (x[~alone] for x in (row, cell, ring, guest))
            own_split = spread[row] % np.maximum(splits[cell, ring, guest], 1)
            own = (ring * 2 + guest) << 32 | own_split
            for step in (-1, 0, 1):
                for other in (0, 1):
                    meets = (ring + step >= 0) & (ring + step <= MAX_RINGS) & ((guest == 0) | (other == 0))
                    at = np.flatnonzero(meets)
                    n = splits[cell[at], ring[at] + step, other]
                    at, k = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    theirs = ((ring[at] + step) * 2 + other) << 32 | k
                    mine = own[at]
                    out.append((row[at], cell[at], np.minimum(mine, theirs), np.maximum(mine, theirs), np.where(mine == theirs, 3, np.where(mine < theirs, 1, 2))))
            places = [np.concatenate(c) for c in zip(*out)]
            for start in range(0, len(places[0]), at_once):
                row, cell, x, y, side = (c[start : start + at_once] for c in places)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(x), pa.array(y), pa.array(side.astype(np.int32)), ids.take(at), part.column(3).take(at)], ["cell", "x", "y", "side", "id", "v"]
                )

    return placed.mapInArrow(run, f"cell int, x long, y long, side int, id {id_type}, v binary")


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the columns of a and b, summed in the order of the dimensions as `cosine` and SQL do, whatever is beside them."""
    dot, left, right = (np.zeros(a.shape[1]) for _ in range(3))
    for x, y in zip(a, b):
        dot += x * y
        left += x * x
        right += y * y
    with np.errstate(over="ignore"):
        squares = left * right
    exact = (np.minimum(left, right) >= FLOOR * FLOOR) & np.isfinite(squares)
    floored = np.maximum(np.sqrt(left), FLOOR) * np.maximum(np.sqrt(right), FLOOR)
    return np.clip(dot / np.where(exact, np.sqrt(squares), floored), -1.0, 1.0)


def _compared(threshold: float, side: np.ndarray, ids: pa.Array, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of one group at or above the threshold."""
    order = np.argsort(-side, kind="stable")  # rows of both sides are first of either
    side, ids, v = side[order], ids.take(pa.array(order)), v[order]
    left, right, both = np.flatnonzero(side & 1), np.flatnonzero(side & 2), int((side == 3).sum())
    if not len(left) or not len(right):
        return
    unit = _unit(v).astype(np.float32)
    margin = (unit.shape[1] + 16) * 2.0**-22  # more than twice what rounding to single precision, products and sums may lose
    least = np.float32(threshold - margin)
    turned = np.ascontiguousarray(unit[right].T)
    for top in range(0, len(left), ROWS):
        rows = unit[left[top : top + ROWS]]
        for start in range(top if both == len(left) else 0, len(right), COLUMNS):
            block = rows @ turned[:, start : start + COLUMNS]
            near = np.flatnonzero(block.ravel() >= least)
            for i in range(0, len(near), PAIRS_AT_ONCE):
                x, y = np.divmod(near[i : i + PAIRS_AT_ONCE], block.shape[1])
                x, y = left[top + x], right[start + y]
                once = (side[x] != 3) | (side[y] != 3) | (x < y)  # rows of both sides meet twice
                x, y = x[once], y[once]
                score = _scores(v[x].T.astype(float, order="C"), v[y].T.astype(float, order="C"))
                x, y, score = (c[score >= threshold] for c in (x, y, score))
                a, b = ids.take(pa.array(x)), ids.take(pa.array(y))
                swap = pc.greater(a, b)
                pairs = pa.RecordBatch.from_arrays([pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(score)], ["id_a", "id_b", "similarity"])
                pairs = pairs.filter(pc.not_equal(a, b))
                if pairs.num_rows:
                    yield pairs


def similar_pairs(rows: DataFrame, threshold: float, id_col: str = "id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """Rows (id_a < id_b, similarity) of all pairs at or above the threshold; see the module.

    The pairs are computed whenever the rows are read; who reads them more than once, as sorting does, checkpoints them.
    """
    plan, placed = pair_plan(rows, threshold, id_col, vector, block)
    kind = plan.kind
    group = ["cell", "x", "y"]
    dealt = _deal(placed, plan).repartition(*group).sortWithinPartitions(*group)
    id_type = placed.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            side, ids = (np.concatenate([x.column(3).to_numpy() for x in held]), pa.concat_arrays([x.column(4) for x in held]))
            v = np.concatenate([_values(x.column(5), kind) for x in held])
            held.clear()
            return _compared(threshold, side, ids, v)

        for batch in batches:
            names = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(names, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if name is not None and tuple(names[a]) != name:
                    yield from pairs()
                name = tuple(names[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs()

    return dealt.mapInArrow(compare, f"id_a {id_type}, id_b {id_type}, similarity double")


def scored_pairs(pairs: DataFrame, examples: DataFrame, id_col: str = "id", text: str = "text", score: str = "judge_score") -> DataFrame:
    """Pairs with both rows' previews and scores and the lower-scored side (null on a tie or a missing score), in no order."""
    side = examples.select(F.col(id_col).alias("id"), preview(F.col(text)).alias("preview"), F.col(score).alias("score"))
    a = side.select(F.col("id").alias("id_a"), F.col("preview").alias("preview_a"), F.col("score").alias("score_a"))
    b = side.select(F.col("id").alias("id_b"), F.col("preview").alias("preview_b"), F.col("score").alias("score_b"))
    both = pairs.join(a, "id_a").join(b, "id_b")
    return both.withColumn("lower_id", lower_scored()).withColumn("similarity_4", F.round("similarity", 4))


def pair_report(pairs: DataFrame, examples: DataFrame, id_col: str = "id", text: str = "text", score: str = "judge_score") -> DataFrame:
    """Scored pairs, most similar first."""
    return scored_pairs(pairs, examples, id_col, text, score).orderBy(F.desc("similarity"), "id_a", "id_b")


def lower_scored() -> Column:
    return F.when(F.col("score_a") < F.col("score_b"), F.col("id_a")).when(F.col("score_b") < F.col("score_a"), F.col("id_b"))


def resolved(examples: DataFrame, pairs_with_scores: DataFrame, id_col: str = "id") -> DataFrame:
    """Examples without the strictly lower-scored member of any pair (of a chain a < b < c both a and b go)."""
    losers = pairs_with_scores.select(lower_scored().alias("__loser")).where("__loser is not null").distinct()
    return examples.join(losers, examples[id_col] == F.col("__loser"), "left_anti")
