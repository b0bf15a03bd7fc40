"""Periodic runs of words by suffix automata with small-to-large merging of end-position sets.

A run is a stretch of words with smallest period q and at least max(least, 2 q) words that no neighbouring word extends.
Words are compared by 64-bit hashes of their bytes.

1. A run of at least ``least`` words matches itself, q words on, in at least least / 2 words in a row. So each of its
   words lies in a gram of that many words that occurs twice in the text, and in the run. Words in no such gram cut a
   text into segments; grams are counted again inside every segment until no word falls out. No run is lost or cut.
2. Each segment gets its suffix automaton. From the longest state to the shortest, the set of a state's end positions is
   merged into its suffix link's, the smaller into the larger. Where an entering position meets a neighbour at distance
   d <= the state's length, the words of that length before both are equal, and end a square of period d. Neighbours of
   each run's last square meet in a state of least / 2 words or more, so shorter states need no sets.
3. A square is extended to both sides while words d apart are equal. Of equal stretches the smallest period is kept.

Work is linear in the words for 1, and n log n steps in the words of segments for 2. Texts are independent rows of a
map: a task holds a slice of texts or one longest text with its automaton.

Defined results: null and empty texts, and texts without words, have no runs and collapse to an empty text; rows are
independent, so repeated ids stay repeated rows and null ids pass through; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.words import SPACE, mixed, slices, trimmed, word_hashes
from stockweave.session import attach

#: Fewest words of a run.
LEAST = 12
_PLACES = np.random.default_rng(77).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Positions:
    """An ordered set of numbers: a long sorted list, and a short one of what came last."""

    __slots__ = ("late", "main")

    def __init__(self, first: int):
        self.main, self.late = [first], []

    def __len__(self):
        return len(self.main) + len(self.late)

    def __iter__(self):
        yield from self.main
        yield from self.late

    def neighbours(self, x: int) -> tuple[int, int]:
        """The largest member below x and the smallest above it; -1 for none."""
        below, above = -1, -1
        for part in (self.main, self.late):
            k = bisect_left(part, x)
            if k and part[k - 1] > below:
                below = part[k - 1]
            if k < len(part) and (above < 0 or part[k] < above):
                above = part[k]
        return below, above

    def add(self, x: int) -> None:
        insort(self.late, x)
        if len(self.late) > 64 and len(self.late) ** 2 > len(self.main):
            self.main += self.late
            self.main.sort()
            self.late = []


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link, end position or -1 for a clone) of each state of the suffix automaton; state 0 is the root."""
    length, link, end, step = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(word):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(at)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, end


def _matches(word: np.ndarray, at: int, d: int, way: int) -> int:
    """How many words in a row, from at on in direction way, equal the words d before them."""
    n, size = 0, 16
    while True:
        lo, hi = (at + n, min(len(word), at + n + size)) if way > 0 else (max(d, at - n - size + 1), at - n + 1)
        if lo >= hi:
            return n
        differ = np.flatnonzero(word[lo:hi] != word[lo - d : hi - d])
        if len(differ):
            return n + (int(differ[0]) if way > 0 else hi - lo - 1 - int(differ[-1]))
        n, size = n + hi - lo, 2 * size


def segment_runs(word: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one sequence."""
    shortest = least - least // 2
    length, link, end = automaton(word.tolist())
    sets: list[Positions | None] = [None if e < 0 else Positions(e) for e in end]
    known: dict[int, list[tuple[int, int]]] = {}  # by period: stretches extended, in order
    for v in np.argsort(np.array(length), kind="stable")[::-1].tolist():
        own, p = sets[v], link[v]
        sets[v] = None
        if own is None or p < 0 or length[p] < shortest:
            continue
        if sets[p] is None:
            sets[p] = own
            continue
        small, large = own, sets[p]
        if len(small) > len(large):
            small, large = large, small
        most = length[p]
        for e in small:
            below, above = large.neighbours(e)
            for lo, hi in ((below, e), (e, above)):
                d = hi - lo
                if lo < 0 or hi < 0 or d > most:
                    continue
                stretches = known.setdefault(d, [])
                k = bisect_left(stretches, (lo + 1,))  # stretches of one period overlap in less than the period
                if k and stretches[k - 1][1] > hi:
                    continue
                start = lo + 1 - _matches(word, hi, d, -1)
                insort(stretches, (start, hi + 1 + _matches(word, hi + 1, d, 1)))
        for e in small:
            large.add(e)
        sets[p] = large
    best: dict[tuple[int, int], int] = {}
    for d, stretches in known.items():
        for s, t in stretches:
            if t - s >= max(least, 2 * d):
                best[s, t] = min(d, best.get((s, t), d))
    return sorted((s, t - s, d) for (s, t), d in best.items())


def segments(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, first places in them of each segment): stretches whose words all lie in grams that a segment repeats.

    owner tells the texts of words apart, which are neighbours in order.
    """
    at = np.arange(len(words))
    part = np.asarray(owner)
    while True:
        n = len(at) - width + 1
        covered = np.zeros(len(at), bool)
        if n > 0:
            gram = np.zeros(n, np.uint64)
            for j in range(width):
                gram += words[at[j : j + n]] * _PLACES[j]
            whole = np.flatnonzero(part[:n] == part[width - 1 :])
            key = mixed(gram[whole] + part[whole].astype(np.uint64) * _PLACES[-1])
            order = np.argsort(key, kind="stable")
            same, order = key[order[1:]] == key[order[:-1]], whole[order]
            twice = np.union1d(order[1:][same], order[:-1][same])
            edge = np.zeros(len(at) + 1, np.int64)
            edge[twice] += 1
            np.subtract.at(edge, twice + width, 1)
            covered = np.cumsum(edge[:-1]) > 0
        kept = np.flatnonzero(covered)
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1] + 1) | (part[kept[1:]] != part[kept[:-1]])
        if len(kept) == len(at):
            return at, np.flatnonzero(new)
        at, part = at[kept], np.cumsum(new)


def text_runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(row, start, length, period) by row, start and period, for rows of word hashes; starts count words of the row."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at, firsts = segments(words, owner, least - least // 2)
    out = []
    for lo, hi in zip(firsts.tolist(), [*firsts.tolist(), len(at)][1:], strict=True):
        first = int(at[lo])
        row = int(owner[first])
        _, small = np.unique(words[at[lo:hi]], return_inverse=True)
        out += [(row, s + first - int(offsets[row]), n, q) for s, n, q in segment_runs(small, least)]
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of each row's words, joined by one space."""
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    sizes = ends - starts + ~last
    begins = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(begins - starts, sizes)
    out = data[np.minimum(at, max(0, len(data) - 1))]
    out[(begins + sizes - 1)[~last]] = 0x20
    return out, np.concatenate([[0], np.cumsum(np.bincount(rows, sizes, n_rows).astype(np.int64))])


def find_runs(docs: DataFrame, text: Column | str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> in order, collapsed (the words that no run repeats, joined
    by one space: a run's first period stays, unless another run drops it)."""
    attach(docs.sparkSession)
    runs_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            for row, n, data, offsets in slices(batch.column(1)):
                words, at, starts = word_hashes(data, offsets, lower=False)
                found = text_runs(words, at, least)
                drop = np.zeros(len(words) + 1, np.int64)
                runs: list[list] = [[] for _ in range(n)]
                for r, s, length, q in found:
                    runs[r].append({"start": s, "length": length, "period": q})
                    drop[at[r] + s + q] += 1
                    drop[at[r] + s + length] -= 1
                kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                ends = _word_ends(data, offsets, starts)
                text_bytes, text_at = _joined(data, starts[kept], ends[kept], np.repeat(np.arange(n), np.diff(at))[kept], n)
                texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(text_at.astype(np.int64).tobytes()), pa.py_buffer(text_bytes.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(at).astype(np.int64)), pa.array(runs, runs_type), texts.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text")).mapInArrow(trimmed(run), schema)


def _word_ends(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The end of each word: white space, or the end of its text."""
    stops = np.union1d(np.flatnonzero(SPACE[data]), offsets)
    return stops[np.searchsorted(stops, starts, "right")]
