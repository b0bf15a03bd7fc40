"""Gradient-boosted trees with a Tweedie loss (log link) over all series, several models in the same passes.

Rows are binned once into a written table of bytes. A fit packs each partition of it into a block of arrays, with every
model's score of every row, and persists the blocks; a tree adds its leaves' values to the scores of the blocks before it,
so a run's work is linear in its trees. Every SAVE_EVERY trees the blocks are checkpointed in the shared folder and the
checkpoint before is deleted, so a lost executor costs the last few trees' scores.

Trees grow leaf by leaf. One Spark job sums slopes, curvatures and rows by feature and bin over the rows of every new leaf.
The sums of a model come together in one partition, which finds each leaf's best split, and only that goes to the driver,
which chooses the leaves to split. Leaves that gain much less than the best open one wait, as splitting one by one would
have them wait. The last splits of a tree need no sums: what falls left and right is known from their parents' ones.

A tree learns from a share of the rows and of the features, both chosen by a hash of the tree's number: the same in any
partitioning, and in a retried task. Partitions' sums are added in the partitions' order.

Models differ in the last day they learn from, their features and the power of the variance (1: Poisson). All windows
of a backtest, and the final model, grow in the same jobs.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.session import attach, discard_checkpoint, materialize, set_checkpoints

#: Fixed values of the method.
ROUNDS, LEAVES, RATE, RIDGE, MIN_ROWS, ROW_SHARE, FEATURE_SHARE = 600, 63, 0.05, 1.0, 50, 0.8, 0.8
BINS, SAVE_EVERY = 32, 10
#: Rows of a block at most, on average: more rows make more partitions.
BLOCK_ROWS = 1 << 17
#: Partitions that add up sums: they are small, and a job costs more for each.
REDUCERS = 3
#: An open leaf waits while its gain is below this share of the best one's.
EAGER = 0.03
EPOCH = "1970-01-01"


@dataclass
class Tree:
    """Nodes in arrays: a leaf has feature -1; a row goes right if its bin is above cut."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        """The numbers of node's new children."""
        n = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, n, n + 1
        for x, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.depth, self.depth[node] + 1)):
            x += [new, new]
        return n, n + 1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; bins: (features, rows)."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(max(self.depth)):
            f = feature[node]
            node = np.where(f < 0, node, np.where(bins[f, rows] > cut[node], right[node], left[node]))
        return node

    def reach(self, bins: np.ndarray, rows: np.ndarray, wanted: Sequence[int]) -> list[np.ndarray]:
        """Which of the rows come to each wanted node, by following only the paths that lead there."""
        leads = set(wanted)
        for node in reversed(range(len(self.feature))):
            if self.feature[node] >= 0 and (self.left[node] in leads or self.right[node] in leads):
                leads.add(node)
        found, ways = dict.fromkeys(wanted, rows[:0]), [(0, rows)]
        while ways:
            node, at = ways.pop()
            if node in found:
                found[node] = at
            elif node in leads:
                right = bins[self.feature[node]][at] > self.cut[node]
                ways += [(self.left[node], at[~right]), (self.right[node], at[right])]
        return [found[node] for node in wanted]


@dataclass
class Model:
    """last: the last day learnt from, in days since 1970; allowed: places of its features."""

    name: str
    last: int
    allowed: list[int]
    power: float = 1.1
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    gains: dict[int, float] = field(default_factory=dict)
    #: Time that tasks spent on this model's sums.
    seconds: float = 0.0

    def score(self, bins: np.ndarray, start: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        """Logarithm of the expected demand: base, or start with the trees before first, and the trees from first on."""
        z = np.full(bins.shape[1], self.base) if start is None else start.copy()
        for tree in self.trees[first:]:
            z += np.array(tree.value)[tree.places(bins)]
        return z

    def slopes(self, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of the Tweedie deviance with a log link."""
        low, high = np.exp((1 - self.power) * z), np.exp((2 - self.power) * z)
        return high - y * low, (2 - self.power) * high - (1 - self.power) * y * low


def edges(rows: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Quantiles of each column: the inner bounds of its bins. One aggregation."""
    points = [k / BINS for k in range(1, BINS)]
    got = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), points, 2000).alias(c) for c in columns]).first()
    return [np.unique(np.array(got[c] or [0.0], float)) for c in columns]


def binned(rows: DataFrame, columns: list[str], bounds: list[np.ndarray], *kept: str) -> DataFrame:
    """kept columns and bins: a byte for every column. Rows with a null among the columns have null bins."""
    attach(rows.sparkSession)
    given = rows.select(*kept, *[F.col(c).cast("double").alias(f"x_{k}") for k, c in enumerate(columns)])

    def run(batches):
        for b in batches:
            x = [b.column(len(kept) + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))]
            out = np.column_stack([np.searchsorted(e, v, "right").astype(np.uint8) for e, v in zip(bounds, x, strict=True)])
            missing = np.isnan(np.column_stack(x)).any(axis=1)
            values = pa.array([None if m else r.tobytes() for m, r in zip(missing.tolist(), out, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), values], [*kept, "bins"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in kept)
    return given.mapInArrow(run, f"{fields}, bins binary")


def _raw(column: pa.Array, kind) -> np.ndarray:
    """The values of a binary column without nulls, one after another."""
    if not len(column):
        return np.zeros(0, kind)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind)


def matrix(column: pa.Array, n_features: int) -> np.ndarray:
    return np.ascontiguousarray(_raw(column, np.uint8).reshape(-1, n_features).T)


def sampled(key: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Which rows a tree learns from, by a hash of their key and its number."""
    x = key.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(share * 2.0**64), 2**64 - 1))


def chosen_features(allowed: list[int], tree: int, share: float) -> list[int]:
    """The features that a tree may ask about: a hash of their places and its number orders them, the first share is taken."""
    score = {f: int(np.random.default_rng([tree, f]).integers(1 << 62)) for f in allowed}
    return sorted(sorted(allowed, key=score.get)[: max(1, round(share * len(allowed)))])


@dataclass
class Block:
    """Rows of a partition; bins: (features, rows), z: (models, rows)."""

    y: np.ndarray
    day: np.ndarray
    key: np.ndarray
    bins: np.ndarray
    z: np.ndarray


def packed(rows: DataFrame, n_features: int) -> RDD:
    """A block for each partition of rows(y, day, key, bins, z)."""
    names = ["y", "day", "key", "bins", "z"]

    def run(batches):
        table = pa.Table.from_batches(held).combine_chunks() if (held := [b for b in batches if b.num_rows]) else None
        if table:
            y, day, key, bins, z = (table.column(c).chunk(0) for c in names)
            made = (y.to_numpy(), day.to_numpy(), key.to_numpy(), matrix(bins, n_features), _raw(z, np.float64).reshape(table.num_rows, -1).T)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], names)

    def block(r):
        y, key = np.frombuffer(r.y), np.frombuffer(r.key, np.int64)
        return Block(y, np.frombuffer(r.day, np.int32), key, np.frombuffer(r.bins, np.uint8).reshape(-1, len(y)), np.frombuffer(r.z).reshape(-1, len(y)))

    return rows.select(*names).mapInArrow(run, ", ".join(f"{c} binary" for c in names)).rdd.map(block)


def counted(blocks: RDD, models: list[Model], trees: list[Tree], wanted: list[list[int]], features: list[list[int]], number: int, row_share: float) -> RDD:
    """(model, (partition, sums, seconds)): a partition's sums (leaf, feature, bin, 3) of the wanted leaves of open trees,
    and the time they took. models go to every task: they should hold no trees."""

    def count(partition, held):
        total = {m: np.zeros((len(features[m]), len(w) * BINS, 3)) for m, w in enumerate(wanted) if w}
        spent = dict.fromkeys(total, 0.0)
        for b in held:
            take = sampled(b.key, number, row_share)
            for m in total:
                began = time.perf_counter()
                at = trees[m].reach(b.bins, np.flatnonzero(take & (b.day <= models[m].last)), wanted[m])
                own, slot = np.concatenate(at), np.repeat(np.arange(len(at)) * BINS, [len(x) for x in at])
                g, h = models[m].slopes(b.y[own], b.z[m][own])
                for k, f in enumerate(features[m]):
                    cell = slot + b.bins[f][own]
                    for c, weight in enumerate((g, h, None)):
                        total[m][k, :, c] += np.bincount(cell, weight, total[m].shape[1])
                spent[m] += time.perf_counter() - began
        for m, t in total.items():
            yield m, (partition, t.reshape(len(t), -1, BINS, 3).swapaxes(0, 1), spent[m])

    return blocks.mapPartitionsWithIndex(count)


def _added(parts: list[tuple[int, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Sums and seconds of all partitions, added in the partitions' order."""
    parts = sorted(parts, key=lambda p: p[0])
    return sum(p[1] for p in parts), sum(p[2] for p in parts)


def sums(rows: DataFrame, models: list[Model], trees: list[Tree], wanted: list[list[int]], features: list[list[int]], saved: int, n_features: int, number: int, row_share: float) -> list[np.ndarray]:
    """Per model (leaf, feature, bin, 3): slopes, curvatures and rows of the wanted leaves of its open tree, over a table
    whose scores hold the first ``saved`` trees. features: places a tree asks about."""
    blocks = packed(scored(rows, models, n_features, saved), n_features)
    got = counted(blocks, models, trees, wanted, features, number, row_share).groupByKey().mapValues(lambda parts: _added(list(parts))).collectAsMap()
    for m, (_, seconds) in got.items():
        models[m].seconds += seconds
    return [got[m][0] if m in got else np.zeros((len(w), len(f), BINS, 3)) for m, (w, f) in enumerate(zip(wanted, features, strict=True))]


def best_split(leaf: np.ndarray, min_rows: int = MIN_ROWS) -> tuple[float, int, int, bool]:
    """(gain, place of the feature, cut, whether the left child has fewer rows) of a leaf's sums (feature, bin, 3)."""
    left = leaf.cumsum(axis=1)[:, :-1]
    whole = leaf.sum(axis=1)[:, None]
    right = whole - left
    worth = lambda s: s[..., 0] ** 2 / (np.maximum(s[..., 1], 0.0) + RIDGE)
    gain = np.where((left[..., 2] >= min_rows) & (right[..., 2] >= min_rows), worth(left) + worth(right) - worth(whole), -1.0)
    f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, cut]), int(f), int(cut), bool(left[f, cut, 2] <= right[f, cut, 2])


@dataclass
class Split:
    """The best split of an open leaf; whole, left: (slopes, curvatures) of its rows and of those that fall left."""

    leaf: int
    gain: float
    feature: int
    cut: int
    whole: tuple[float, float]
    left: tuple[float, float]


def _split(leaf: int, own: np.ndarray, min_rows: int) -> Split:
    gain, f, cut, _ = best_split(own, min_rows)
    return Split(leaf, gain, f, cut, tuple(own[f].sum(axis=0)[:2].tolist()), tuple(own[f, : cut + 1].sum(axis=0)[:2].tolist()))


def _best(counts: RDD, wanted: list[list[int]], min_rows: int) -> RDD:
    """(model, best splits of the wanted leaves, seconds), from what the partitions counted."""

    def find(items):
        parts: dict[int, list] = {}
        for m, value in items:
            parts.setdefault(m, []).append(value)
        for m, own in parts.items():
            total, seconds = _added(own)
            yield m, [_split(leaf, s, min_rows) for leaf, s in zip(wanted[m], total, strict=True)], seconds

    return counts.partitionBy(min(len(wanted), REDUCERS)).mapPartitions(find)


def _grow(blocks: RDD, models: list[Model], number: int, options) -> list[Tree]:
    """One tree for every model; its gains and seconds are put to the model."""
    leaves, rate, min_rows, row_share, feature_share = options
    bare = [replace(m, trees=[], gains={}) for m in models]
    features = [chosen_features(m.allowed, number, feature_share) for m in models]
    trees: list[Tree] = [Tree() for _ in models]
    splits: list[dict[int, Split]] = [{} for _ in models]  # of open leaves
    values: list[dict[int, tuple[float, float]]] = [{} for _ in models]  # slopes and curvatures of leaves
    wanted: list[list[int]] = [[0] for _ in models]
    while any(wanted):
        got = _best(counted(blocks, bare, trees, wanted, features, number, row_share), wanted, min_rows).collect()
        wanted = [[] for _ in models]
        for m, found, seconds in got:
            models[m].seconds += seconds
            splits[m].update((s.leaf, s) for s in found)
            values[m].update((s.leaf, s.whole) for s in found)
            n = trees[m].feature.count(-1)
            best = sorted(splits[m].values(), key=lambda s: (s.gain, s.feature, s.cut, s.leaf), reverse=True)
            for s in [s for s in best[: leaves - n] if s.gain > 1e-9 and s.gain >= EAGER * best[0].gain]:
                place = features[m][s.feature]
                new = trees[m].split(s.leaf, place, s.cut)
                models[m].gains[place] = models[m].gains.get(place, 0.0) + s.gain
                del splits[m][s.leaf]
                values[m][new[0]], values[m][new[1]] = s.left, (s.whole[0] - s.left[0], s.whole[1] - s.left[1])
                wanted[m] += new
            if trees[m].feature.count(-1) >= leaves:
                wanted[m] = []  # nothing more to split
    for tree, known in zip(trees, values, strict=True):
        for node, f in enumerate(tree.feature):
            if f < 0 and node in known:
                tree.value[node] = -rate * known[node][0] / (max(known[node][1], 0.0) + RIDGE)
    return trees


def _with_trees(blocks: RDD, trees: list[Tree]) -> RDD:
    """blocks with a tree of every model added to its scores."""

    def add(b: Block) -> Block:
        z, every = b.z.copy(), np.arange(len(b.y))
        for own, tree in zip(z, trees, strict=True):
            ends = [node for node, f in enumerate(tree.feature) if f < 0]
            for node, at in zip(ends, tree.reach(b.bins, every, ends), strict=True):
                own[at] += tree.value[node]
        return replace(b, z=z)

    return blocks.map(add)


def scored(rows: DataFrame, models: list[Model], n_features: int, saved: int | None) -> DataFrame:
    """rows with z: every model's score after its trees so far; saved: how many trees z has, None where there is no z yet."""
    kept = ["y", "day", "key", "bins"]
    n_models = len(models)

    def run(batches):
        for b in batches:
            bins = matrix(b.column("bins"), n_features)
            old = None if saved is None else _raw(b.column("z"), np.float64).reshape(-1, n_models)
            z = np.column_stack([m.score(bins, None if old is None else old[:, k], saved or 0) for k, m in enumerate(models)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([r.tobytes() for r in z], pa.binary())], [*kept, "z"])

    return rows.mapInArrow(run, "y double, day int, key long, bins binary, z binary")


def fit(rows: DataFrame, models: list[Model], n_features: int, rounds: int = ROUNDS, leaves: int = LEAVES, rate: float = RATE, min_rows: int = MIN_ROWS, row_share: float = ROW_SHARE, feature_share: float = FEATURE_SHARE) -> list[Model]:
    """Grow every model on rows(y, day, key, bins), a written table; key spreads the rows over partitions and for sampling."""
    spark = rows.sparkSession
    attach(spark)
    set_checkpoints(spark)
    rows = rows.where("bins is not null and y is not null").select("y", "day", "key", "bins")
    known = [(F.sum(F.when(F.col("day") <= m.last, F.col("y"))), F.count(F.when(F.col("day") <= m.last, 1))) for m in models]
    *means, n = rows.agg(*[x for pair in known for x in pair], F.count("*")).first()
    for k, m in enumerate(models):
        m.base = float(np.log(max((means[2 * k] or 0.0) / max(means[2 * k + 1], 1), 1e-6)))
    spread = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS)), "key").sortWithinPartitions("key")
    blocks = packed(scored(spread, models, n_features, None), n_features).persist(StorageLevel.MEMORY_AND_DISK)
    before = saved = None  # the blocks of the tree before, and those that were checkpointed last
    for number in range(rounds):
        if number % SAVE_EVERY == 0:
            blocks.checkpoint()  # written by the tree's first job
        trees = _grow(blocks, models, number, (leaves, rate, min_rows, row_share, feature_share))
        if before is not None:
            before.unpersist()
        if number % SAVE_EVERY == 0:
            if saved is not None:
                discard_checkpoint(spark, saved)
            saved = blocks
        for m, tree in zip(models, trees, strict=True):
            m.trees.append(tree)
        if number + 1 < rounds:
            before, blocks = blocks, _with_trees(blocks, trees).persist(StorageLevel.MEMORY_AND_DISK)
    blocks.unpersist()
    if saved is not None:
        discard_checkpoint(spark, saved)
    return models


def predict(rows: DataFrame, models: list[Model], n_features: int) -> DataFrame:
    """rows(model, ..., bins) with yhat in place of bins, by the model of that name; null bins give a null yhat."""
    kept = [c for c in rows.columns if c != "bins"]
    by_name = {m.name: m for m in models}

    def run(batches):
        for b in batches:
            names, values = b.column("model").to_pylist(), b.column("bins").is_valid().to_pylist()
            out = np.full(b.num_rows, np.nan)
            for name in set(names):
                at = [i for i, (n, v) in enumerate(zip(names, values, strict=True)) if n == name and v]
                if at:
                    out[at] = np.exp(by_name[name].score(matrix(b.column("bins").take(pa.array(at)), n_features)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.float64(), from_pandas=True)], [*kept, "yhat"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInArrow(run, f"{fields}, yhat double")


def written_bins(rows: DataFrame, columns: list[str], bounds: list[np.ndarray]) -> DataFrame:
    """y, day, key and bins of rows, which have unique_id and ds."""
    keyed = rows.withColumns({"day": F.datediff("ds", F.lit(EPOCH).cast("date")), "key": F.xxhash64("unique_id", "ds")})
    return materialize(binned(keyed, columns, bounds, "y", "day", "key"), "bins")
