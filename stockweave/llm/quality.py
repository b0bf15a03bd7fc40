"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts over a text's whole bytes. Each is cut into bins at sample quantiles; cyclic boosting fits
one shallow tree of a feature at a time to the logistic loss and adds it to the feature's lookup table, then
does the same for the best pairs of features on coarser bins. A score is the logistic of the sum of table
entries, looked up for whole batches at once. The model is a few kilobytes, learnt on a bounded sample of
labelled rows; scoring is a map over all rows.

Defined results: null and empty texts get the score of their (all-zero) features; rows with a null label are not
learnt from; repeated rows are scored alike; an empty table gives no rows; without labels of both kinds the
score is the smoothed share of good ones; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.words import distinct, shingle_hashes, slices, sums, trimmed, word_hashes
from stockweave.session import attach

#: Most labelled rows the model is learnt from, the first by a hash of doc_id.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 6, 120, 0.15
FEATURES = (
    "log_bytes", "log_words", "word_length", "long_words", "letters", "upper", "digits", "other_bytes", "spaces", "newlines",
    "stops", "commas", "exclaims", "bars", "symbols", "symbol_words", "repeats", "distinct_words", "distinct_runs", "upper_words",
)


def _among(text: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(text.encode(), np.uint8)] = True
    return table


_LETTER, _UPPER, _DIGIT = _among("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("0123456789")
_SYMBOL, _STOP, _COMMA = _among("#$%&*@^~<>={}[]\\_+|"), _among(".?"), _among(",;:")
_HIGH = np.arange(256) >= 128


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for every text."""
    out = [np.zeros((0, len(FEATURES)))]
    for _, n, data, offsets in slices(column):
        words, at, starts = word_hashes(data, offsets)
        n_bytes, n_words = np.diff(offsets).astype(float), np.diff(at).astype(float)
        per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)
        count = lambda table: sums(table[data].astype(np.int64), offsets).astype(float)
        spaces = count(_among(" \t\r\n"))
        lengths = np.diff(np.concatenate([starts, [len(data)]])) - 1.0
        in_row = lambda values: sums(values.astype(np.int64), at).astype(float)
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[at[:-1][at[:-1] < len(words)]] = False
        last = np.clip(np.concatenate([starts[1:] - 2, [len(data) - 1]]), 0, max(len(data) - 1, 0)) if len(words) else starts
        marked = (_SYMBOL[data[last]] | (data[last] == 33)) if len(words) else np.zeros(0, bool)
        second = np.minimum(starts + 1, max(len(data) - 1, 0))
        shout = (_UPPER[data[starts]] & _UPPER[data[second]]) if len(words) else np.zeros(0, bool)
        runs, run_at = shingle_hashes(words, at, 5)
        n_runs = np.maximum(np.diff(run_at), 1)
        out.append(np.column_stack([
            np.log1p(n_bytes), np.log1p(n_words), (n_bytes - spaces) * per_word, in_row(lengths > 14) * per_word, count(_LETTER) * per_byte, count(_UPPER) * per_byte,
            count(_DIGIT) * per_byte, count(_HIGH) * per_byte, spaces * per_byte, count(_among("\n")) * per_word, count(_STOP) * per_word, count(_COMMA) * per_word,
            count(_among("!")) * per_word, count(_among("|")) * per_word, count(_SYMBOL) * per_byte, in_row(marked) * per_word, in_row(same) * per_word,
            np.diff(distinct(words, at)[1]) * per_word, np.diff(distinct(runs, run_at)[1]) / n_runs, in_row(shout) * per_word,
        ]))
    return np.concatenate(out)


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    base: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], "right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[f], x[:, f], "right"), np.searchsorted(self.pair_edges[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-z))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    found = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
    middle = np.unique(values)
    # half-way to the next lower value, so that a bin begins between two values seen
    return np.array([(e + middle[k - 1]) / 2 for e in found if (k := int(np.searchsorted(middle, e))) > 0])


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 5.0) -> np.ndarray:
    """Leaf values of a depth-limited regression tree over ordered bins with gradient and hessian sums."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            out = np.concatenate([_tree(g[:cut], h[:cut], depth - 1, ridge), _tree(g[cut:], h[cut:], depth - 1, ridge)])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[float, np.ndarray]:
    """The best cut of both axes: its gain and its table of four values."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best = (0.0, np.zeros_like(g))
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]) for m in (G, H)]
            values = [a / (b + ridge) for a, b in zip(*parts, strict=True)]
            gain = sum(a * v for a, v in zip(parts[0], values, strict=True))
            if gain > best[0]:
                table = np.empty_like(g)
                table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = values
                best = (gain, table)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return AdditiveModel([np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), float(np.log(p / (1 - p))))
    n_features = x.shape[1]
    edges = [_edges(x[:, f], BINS) for f in range(n_features)]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    base = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f in range(n_features):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(bins[f], y - p, len(tables[f])), np.bincount(bins[f], p * (1 - p), len(tables[f])), 2)
            tables[f] += step
            z += step[bins[f]]
    coarse_edges = [_edges(x[:, f], PAIR_BINS) for f in range(n_features)]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse_edges)]

    def sums_of(f, g, z):
        p, shape = 1 / (1 + np.exp(-z)), (len(coarse_edges[f]) + 1, len(coarse_edges[g]) + 1)
        cell = coarse[f] * shape[1] + coarse[g]
        return cell, [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p))]

    ranked = sorted(((_quadrants(*sums_of(f, g, z)[1])[0], f, g) for f in range(n_features) for g in range(f)), reverse=True)[:PAIRS]
    pairs = [(f, g) for gain, f, g in ranked if gain > 0]
    pair_tables = [np.zeros((len(coarse_edges[f]) + 1, len(coarse_edges[g]) + 1)) for f, g in pairs]
    for _ in range(ROUNDS // 4):
        for k, (f, g) in enumerate(pairs):
            cell, (grad, hess) = sums_of(f, g, z)
            step = RATE * _quadrants(grad, hess)[1]
            pair_tables[k] += step
            z += step.ravel()[cell]
    return AdditiveModel(edges, tables, base, pairs, coarse_edges, pair_tables)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the CRC of its id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most sample_rows labelled rows that are not held out; only their features reach the driver."""
    attach(docs.sparkSession)
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        for b in batches:
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # rows of one id teach once, by the least of their features, so that sample_rows bounds what reaches the driver
    once = rows.mapInArrow(trimmed(run), "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x"))
    got = sorted(once.toArrow().to_pylist(), key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(r["x"] for r in got), float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([float(r["quality"] == 1) for r in got]))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text)."""
    attach(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = model.score(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns."""
    attach(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column("text"))) >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
