"""Exact top-k inner products on a bit-sliced index.

Each component becomes an integer, floor(scale * x). Vectors are dealt to blocks; a block keeps, for every
dimension, the bits of (value - block minimum) as bitmaps over its rows, in vec_id order: the index, a written
table. For a query, each signed digit of a coefficient adds the dimension's slices, shifted, to the score's columns
(a negative digit adds the complement); carry-save adders on stacks of bitmaps leave one slice per score bit, however
many bits values and coefficients have. Rows are then taken from the most significant slice down: rows sure to be in,
rows still tied. Ties at the boundary are resolved by smaller vec_id, exactly, and the few rows taken get their exact
score. A block gives at most k rows a query; blocks are merged by a window per query.

Queries meet every block in groups of bounded size: that is the stated query set against all rows, in blocks.
A task reads a block's index and then its groups, in sorted order, so it holds one block and one batch. Rows are
dealt by their place in a written table, so no vec_id, however often repeated, makes a block larger than another.

Defined results: vectors that are null, hold null or non-finite components or have a null vec_id take no part; a
query meets the vectors of its own length only (of other lengths there is no inner product; two empty vectors score
0); components and scores stop at the bounds of a long, but ranks follow the exact sums; a row with the query's own
vec_id is no candidate; repeated candidate rows are ranked next to each other; of several vectors of one query id the
smallest, component by component, asks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.session import attach, materialize, shuffle_partitions

BLOCK_ROWS, QUERY_ROWS = 32_768, 512
#: Most components of a block, so that long vectors make smaller blocks.
BLOCK_VALUES = 4 << 20
#: A copy of a block serves this many queries at least.
SHARE_QUERIES = 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v array<long> of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _digits(q: int) -> list[tuple[int, int]]:
    """(shift, +1 or -1) whose sum of shifted digits is q: no two neighbours, so a third of the bits on average."""
    out, shift = [], 0
    while q:
        if q & 1:
            digit = 2 - (q & 3)
            out.append((shift, digit))
            q -= digit
        q >>= 1
        shift += 1
    return out


def slice_table(bits: np.ndarray) -> np.ndarray:
    """(dimension, bit, words) -> (bit, dimension or dimension + its complement, words)."""
    return np.ascontiguousarray(np.concatenate([bits, bits ^ _ALL]).transpose(1, 0, 2))


def score_slices(table: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bit slices (lowest first) of the sum over dimensions of digit * (value or its complement).

    Adding the returned constant gives the inner product with (value - minimum).
    """
    n_bits, dims, words = table.shape[0], table.shape[1] // 2, table.shape[2]
    by_shift: dict[int, list[int]] = {}
    constant = 0
    for d, q in enumerate(query.tolist()):
        for shift, digit in _digits(q):
            by_shift.setdefault(shift, []).append(d if digit > 0 else dims + d)
            if digit < 0:
                constant -= ((1 << n_bits) - 1) << shift
    top = max(by_shift) + n_bits if by_shift else 0
    slices, carried, w = [], [], 0
    while w < top or carried:
        stack = [table[w - s][rows] for s, rows in by_shift.items() if 0 <= w - s < n_bits] + carried
        column = np.concatenate(stack) if stack else np.zeros((1, words), np.uint64)
        carried = []
        while len(column) > 2:  # three slices become a sum and a carry
            third = len(column) // 3
            a, b, c = (column[k * third : (k + 1) * third] for k in range(3))
            differ = a ^ b
            carried.append((a & b) | (differ & c))
            column = np.concatenate([differ ^ c, column[3 * third :]])
        if len(column) == 2:
            carried.append((column[0] & column[1])[None])
            column = (column[0] ^ column[1])[None]
        slices.append(column[0])
        w += 1
    return slices, constant


def top_rows(slices: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest rows among the bitmap rows; ties at the boundary to the smaller position."""
    sure, tied = np.zeros_like(rows), rows.copy()
    for s in reversed(slices):
        high = tied & s
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            tied = high
        else:
            sure |= high
            tied &= ~s
            if n == k:
                tied[:] = 0
                break
    where = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    taken = where(sure)
    return np.concatenate([taken, where(tied)[: max(0, k - len(taken))]])


def build_index(rows: DataFrame) -> DataFrame:
    """w, block, n, bits, ids, slices, vectors (binary columns): one row per block of rows(w, block, vec_id, v)."""

    def pack(key, frame):
        ids = frame["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        values = np.array(frame["v"].tolist(), np.int64).reshape(len(ids), -1)[order]
        n_words, dims = -(-len(ids) // 64), values.shape[1]
        shifted = values.view(np.uint64) - values.min(axis=0).view(np.uint64)
        n_bits = max(1, int(shifted.max()).bit_length()) if dims else 1
        out = np.zeros((dims, n_bits, n_words * 8), np.uint8)
        for b in range(n_bits):
            packed = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little").T
            out[:, b, : packed.shape[1]] = packed
        return pd.DataFrame({"w": [key[0]], "block": [key[1]], "n": [len(ids)], "bits": [n_bits], "ids": [ids[order].tobytes()], "slices": [out.tobytes()], "vectors": [values.tobytes()]})

    return rows.groupBy("w", "block").applyInPandas(pack, "w int, block int, n int, bits int, ids binary, slices binary, vectors binary")


def copies(rows: DataFrame, name: str, times: str) -> DataFrame:
    """rows as often as their column times says, numbered in a new column; one batch is held at a time, however many copies."""

    def run(batches):
        for batch in batches:
            most = batch.column(times).to_numpy()
            for value in range(int(most.max()) if len(most) else 0):
                part = batch.filter(pa.array(most > value))
                yield part.append_column(name, pa.array(np.full(part.num_rows, value, np.int32)))

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", {name} int")


def _exact(values: np.ndarray, q: np.ndarray, largest: int) -> list[int]:
    """Inner products as whole numbers of any size."""
    if len(q) * largest * max(map(abs, q.tolist()), default=0) < 1 << 62:
        return (values @ q).tolist()
    return [sum(a * b for a, b in zip(v, q.tolist(), strict=True)) for v in values.tolist()]


def _probe(k: int):
    """Rows come by block and share, the block's index first, then its groups of queries: one block is held at a time."""

    def run(batches):
        ids = None
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for r in batch.to_pylist():
                if r["slices"] is not None:
                    n, w, ids = r["n"], r["w"], np.frombuffer(r["ids"], np.int64)
                    values = np.frombuffer(r["vectors"], np.int64).reshape(n, w)
                    largest = max(abs(int(values.min())), abs(int(values.max()))) if w else 0
                    words = -(-n // 64)
                    table = slice_table(np.frombuffer(r["slices"], np.uint64).reshape(w, r["bits"], words))
                    valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
                    own = (w, r["block"])
                    continue
                if ids is None or own != (r["w"], r["block"]):  # no row was dealt to this block
                    continue
                query_ids = np.frombuffer(r["query_ids"], np.int64)
                for q_id, q in zip(query_ids.tolist(), np.frombuffer(r["queries"], np.int64).reshape(len(query_ids), w), strict=True):
                    slices, _ = score_slices(table, q)
                    rows, lo, hi = valid, *np.searchsorted(ids, [q_id, q_id + 1])
                    if lo < hi:  # the query's own rows
                        mask = np.zeros(words * 64, bool)
                        mask[lo:hi] = True
                        rows = valid & ~np.packbits(mask, bitorder="little").view(np.uint64)
                    best = top_rows(slices, rows, k)
                    scores = _exact(values[best], q, largest)
                    out[0].extend([q_id] * len(best))
                    out[1].extend(ids[best].tolist())
                    out[2].extend(min(max(s, -1 << 63), (1 << 63) - 1) for s in scores)
                    out[3].extend((s + (1 << 191)).to_bytes(24, "big") for s in scores)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["query_id", "vec_id", "score", "exact"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that is_query holds for, its k best other rows."""
    spark = vectors.sparkSession
    attach(spark)
    partitions = shuffle_partitions(spark)
    rows = quantised(vectors, scale).withColumns({"is_query": is_query, "w": F.size("v"), "place": F.monotonically_increasing_id()})
    rows = materialize(rows, "quantised")
    asking = materialize(rows.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("w", F.size("v")), "queries")
    sizes = rows.groupBy("w").agg(F.count("*").alias("n")).join(asking.groupBy("w").agg(F.count("*").alias("asks")), "w")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(BLOCK_VALUES / F.greatest("w", F.lit(1)))))).cast("int"))
    # few blocks are read by several tasks, each with its share of the queries
    wanted = F.when(F.col("blocks") < partitions, F.ceil(2 * partitions / F.col("blocks"))).otherwise(1)
    sizes = sizes.withColumn("shares", F.greatest(F.lit(1), F.least(wanted, F.floor(F.col("asks") / SHARE_QUERIES))).cast("int"))
    sizes = materialize(sizes.withColumn("groups", F.greatest(F.col("shares"), F.ceil(F.col("asks") / query_rows)).cast("int")), "lengths")  # a row per length of vectors
    dealt = rows.join(sizes, "w").select("w", F.pmod("place", "blocks").cast("int").alias("block"), "vec_id", "v")
    index = materialize(build_index(dealt).join(sizes.select("w", "shares"), "w"), "bit-sliced-index")

    def gather(key, frame):
        queries = np.array(frame["v"].tolist(), np.int64)
        return pd.DataFrame({"w": [key[0]], "group": [key[1]], "query_ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "queries": [queries.tobytes()]})

    grouped = asking.join(sizes, "w").withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), "groups").cast("int"))
    groups = grouped.groupBy("w", "group").applyInPandas(gather, "w int, group int, query_ids binary, queries binary").join(sizes, "w")
    groups = copies(groups.select("w", "query_ids", "queries", F.pmod("group", "shares").cast("int").alias("share"), "blocks"), "block", "blocks").drop("blocks")
    met = copies(index, "share", "shares").drop("shares").unionByName(groups, allowMissingColumns=True).repartition("w", "block", "share")
    order = met.sortWithinPartitions("w", "block", "share", F.col("slices").isNull())
    found = order.select("w", "block", "n", "bits", "ids", "slices", "vectors", "query_ids", "queries").mapInArrow(_probe(k), "query_id long, vec_id long, score long, exact binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
