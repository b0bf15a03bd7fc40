"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

1. Rows of one vector become one node with a count (an aggregation by a 128-bit hash of the components).
2. In each table a node's key is the signs of its products with ``bits`` random hyperplanes. Two vectors at angle a
   share a table's key with probability (1 - a / pi)^bits. ``plan_tables`` takes bits so that vectors without direction
   fill a bucket with BUCKET_ROWS on average, and as many tables as make a pair at the threshold share none with
   probability MISS at most; pairs above it are missed more rarely. So recall is the same at every size.
3. Nodes are range-sorted by key, and runs of one key become blocks of bounded rows: a key with very many nodes lies
   in many blocks and partitions. Blocks are a written table.
4. Every block meets itself and the other blocks of its key, found by two keyed reads. All cosines of two blocks come
   from matrix products in double precision; a pair counts in the first table that it shares only. A block pair gives
   a row a node with links: how many, and the least node that the block pair joins it to. No pair is written.
5. Counts are summed a node, and connected components taken of the joined nodes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id,
link with nothing; vectors of different lengths do not link. Repeated rows are vectors of their own: each counts as the
other's link. A null vec_id has a null component and is not kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.graph import connected_components, hot_keys, spread_join
from stockweave.session import attach, materialize, shuffle_partitions

#: Mean rows of a bucket, and the chance that a pair at the threshold shares no table.
BUCKET_ROWS, MISS = 512, 1e-4
#: Most rows and components of a block; rows of a tile, whose cosines are held at once.
BLOCK_ROWS, BLOCK_VALUES, TILE = 2048, 1 << 20, 512
_BLOCK = "w int, t int, sig long, first long, n int, nodes binary, counts binary, sigs binary, vectors binary"


def plan_tables(n: int, cosine: float, bucket_rows: int = BUCKET_ROWS, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits) for n vectors."""
    bits = max(2, math.ceil(math.log2(max(2, n / bucket_rows))))
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(agree, 1 - 1e-9)))), bits


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values /= np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def signatures(nodes: DataFrame, tables: int, bits: int, seed: int = 5) -> DataFrame:
    """node, n_, w, sigs array<long>, vector binary of nodes(node, n_, embedding)."""
    attach(nodes.sparkSession)
    kind = "<f4" if dict(nodes.dtypes)["embedding"] == "array<float>" else "<f8"
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            lengths = np.diff(column.offsets.to_numpy())
            for w in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == w))
                values = part.column(2).flatten().to_numpy().reshape(-1, w)
                if w not in planes:
                    planes[w] = np.random.default_rng([seed, w]).standard_normal((w, tables * bits))
                signs = (_unit(values) @ planes[w] > 0).reshape(len(values), tables, bits)
                sigs = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * tables), pa.array(sigs.ravel()))
                raw = pa.array([x.tobytes() for x in values.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(values), w, np.int32)), lists, raw], ["node", "n_", "w", "sigs", "vector"])

    return nodes.select("node", "n_", "embedding").mapInArrow(run, "node long, n_ long, w int, sigs array<long>, vector binary")


def _blocks(rows: int, values: int):
    """Runs of one key, cut into blocks; rows come sorted by key and node."""

    def block(key, parts):
        t = pa.concat_tables(parts).combine_chunks()
        out = [*key, t.column("node")[0].as_py(), t.num_rows]
        raw = [t.column(k).to_numpy().tobytes() for k in ("node", "n_")]
        sigs = t.column("sigs").combine_chunks()
        raw += [sigs.flatten().to_numpy().tobytes(), b"".join(t.column("vector").to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out + raw, kinds, strict=True)], names)

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def run(batches):
        held, held_rows, own = [], 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.column_stack([table.column(k).to_numpy().astype(np.int64) for k in ("w", "t", "sig")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                key = tuple(keys[lo].tolist())
                if held and key != own:
                    yield block(own, held)
                    held, held_rows = [], 0
                own, most = key, max(1, min(rows, values // max(1, key[0])))
                while lo < hi:
                    take = min(hi - lo, most - held_rows)
                    held.append(table.slice(lo, take))
                    held_rows, lo = held_rows + take, lo + take
                    if held_rows == most:
                        yield block(own, held)
                        held, held_rows = [], 0
        if held:
            yield block(own, held)

    return run


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (positions, each at most its own) after joining the classes of i and j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def links_between(a: dict, b: dict | None, t: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) for the nodes that block a, alone or with block b, links in table t.

    A block has nodes, counts, sigs (rows, tables) and unit vectors. Tiles whose rows all share an earlier table's
    key are skipped: that table has counted their pairs.
    """
    sides = (a, a if b is None else b)
    order = [np.lexsort(s["sigs"][:, :t].T[::-1]) if t else np.arange(len(s["nodes"])) for s in sides]
    nodes, counts, sigs, unit = ([s[k][o] for s, o in zip(sides, order, strict=True)] for k in ("nodes", "counts", "sigs", "unit"))
    every = nodes[0] if b is None else np.concatenate(nodes)
    ranks = np.argsort(np.argsort(every))  # so that the least label is the least node
    place = (ranks[: len(nodes[0])], ranks if b is None else ranks[len(nodes[0]) :])
    links, label = np.zeros(len(every), np.int64), np.arange(len(every))
    ranges = [[(k, sigs[s][k : k + TILE, :t].min(axis=0), sigs[s][k : k + TILE, :t].max(axis=0)) for k in range(0, len(nodes[s]), TILE)] for s in (0, 1)]
    for p, lo, hi in ranges[0]:
        for q, low, high in ranges[1]:
            if (b is None and q < p) or ((lo == hi) & (low == high) & (lo == low)).any():
                continue
            near = unit[0][p : p + TILE] @ unit[1][q : q + TILE].T >= cosine
            if b is None and p == q:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = i + p, j + q
            if t and len(i):
                new = ~(sigs[0][i, :t] == sigs[1][j, :t]).any(axis=1)
                i, j = i[new], j[new]
            if len(i):
                links += np.bincount(place[0][i], counts[1][j], len(links)).astype(np.int64)
                links += np.bincount(place[1][j], counts[0][i], len(links)).astype(np.int64)
                label = _join(label, place[0][i], place[1][j])
    linked = np.flatnonzero(links)
    ordered = np.sort(every)
    return ordered[linked], links[linked], ordered[label[linked]]


def _linked(cosine: float, kind: str):
    def side(row, x):
        n = row[f"n{x}"]
        sigs = np.frombuffer(row[f"sigs{x}"], np.int64).reshape(n, -1)
        return {"nodes": np.frombuffer(row[f"nodes{x}"], np.int64), "counts": np.frombuffer(row[f"counts{x}"], np.int64), "sigs": sigs, "unit": _unit(np.frombuffer(row[f"vectors{x}"], kind).reshape(n, row["w"]))}

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                found = links_between(side(row, ""), side(row, "_") if "n_" in row else None, row["t"], cosine)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "links", "root"])

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, bucket_rows: int = BUCKET_ROWS, miss: float = MISS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    attach(spark)
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(x, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", usable.alias("usable"))
    rows = materialize(rows.select("vec_id", "usable", F.when(F.col("usable"), F.col("embedding")).alias("embedding"), F.xxhash64(F.lit(3), "embedding").alias("k1"), F.xxhash64(F.lit(8), "embedding").alias("k2")), "vectors")
    nodes = rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n_"), F.first("embedding").alias("embedding"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    tables, bits = plan_tables(nodes.count(), cosine, bucket_rows, miss)
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    signed = materialize(signatures(nodes, tables, bits), "signatures")
    keyed = signed.select("w", F.posexplode("sigs").alias("t", "sig"), "node", "n_", "sigs", "vector")
    sort = ["w", "t", "sig", "node"]
    dealt = keyed.repartitionByRange(shuffle_partitions(spark), *sort).sortWithinPartitions(*sort)
    blocks = materialize(dealt.mapInArrow(_blocks(block_rows, BLOCK_VALUES), _BLOCK), "blocks")
    # blocks of one key meet each other: pairs of their names first, then each block by its name
    key = ["w", "t", "sig"]
    names = blocks.select(*key, "first")
    met = names.join(names.withColumnRenamed("first", "first_"), key).where("first < first_")
    other = blocks.select(*key, *[F.col(c).alias(f"{c}_") for c in blocks.columns if c not in key])
    crossed = met.join(blocks, [*key, "first"]).join(other, [*key, "first_"])
    schema = "node long, links long, root long"
    alone = blocks.where("n > 1").repartition(2 * shuffle_partitions(spark), *key, "first").mapInArrow(_linked(cosine, kind), schema)
    found = materialize(alone.unionByName(crossed.mapInArrow(_linked(cosine, kind), schema)), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")))
    # a component's id is the least vec_id of its nodes
    placed = materialize(nodes.select("node", "rep").join(components, "node"), "placed")
    least = materialize(placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_")), "components")
    joined = spread_join(placed.select("node", "component"), least.drop("n_"), "component", hot_keys(least, "component")).select("node", "component_id")
    named = nodes.select("k1", "k2", "rep", "node", "n_").join(joined, "node", "left").join(counts, "node", "left")
    named = named.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n_") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    mine = spread_join(rows.where("usable").select("vec_id", "k1", "k2"), named, ["k1", "k2"], hot_keys(nodes, ["k1", "k2"])).select("vec_id", "n_links", "component_id")
    rest = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionByName(rest).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)))
