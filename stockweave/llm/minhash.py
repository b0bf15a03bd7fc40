"""Near-duplicate detection by MinHash with tensored banding.

Two collections of ``side`` tuples of ``rows`` minimum hashes each are computed for a document; a table key
joins a tuple of the first with one of the second. 2 * side * rows hashes thus serve side * side tables of
2 * rows rows: a pair of similarity s shares a key with probability (1 - (1 - s^rows)^side)^2, which at 0.75
with the defaults is 0.9997 and more above it.

1. Sketch every whole text (a map). Texts with equal shingle sets become one node, whatever their doc_ids.
2. Drop tuples that no second node has; the rest make table keys (a shuffle of 8-byte keys).
3. Link every member of a bucket to its most popular member, confirmed on full shingle sets; take components.
4. In buckets where several components are left, compare members of different components block by block
   (blocks of bounded members and shingles). Candidates stay lists on a member's row and are tested inside the
   task that holds the block pair's whole sets; take components of all links, and the least doc_id of each.

Counts of tuples and keys are aggregations, and a tuple, key, hub or component that very many rows have is dealt to
several places (``spread_join``), so no task takes a whole popular bucket. Pairs inside a component need no test. All
others that share a key get one, but for pairs whose 96 minimum hashes agree in less than ``LEAST_AGREEMENT``: with
the pairs that share no key (3 in 10,000 at similarity 0.75, fewer above it) they are the only links that can be missed.

Defined results: null and empty texts have no shingles and link with nothing; rows of one doc_id are one node
of the graph (with different texts, the components of all of them are joined); a null doc_id has a null component
and is not kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.graph import connected_components, hot_keys, rows_in, spread_join
from stockweave.llm.words import distinct, mixed, shingle_hashes, slices, sums, trimmed, word_hashes
from stockweave.session import attach, discard, materialize

SIDE, ROWS = 16, 3
#: Members and shingles of a block, so that two blocks fit a task's memory; a bucket's rows are copied once a block.
BLOCK, BLOCK_SHINGLES = 4096, 1_000_000
#: A pair whose minimum hashes agree less often than this is not tested on full sets: at similarity 0.75 and
#: 96 hashes, 4.5 standard deviations below the mean (a few pairs in a million).
LEAST_AGREEMENT = 0.55


def _tuples(column: pa.Array, side: int, rows: int):
    """For each slice of texts: set size, two set keys, tuples (side * 2 columns), one byte of each minimum hash."""
    rng = np.random.default_rng(11)
    n_hashes = 2 * side * rows
    xors = rng.integers(0, 1 << 64, n_hashes, dtype=np.uint64)
    odds = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    table = rng.integers(0, 1 << 63, (2 * side, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for _, n, data, offsets in slices(column):
        words, word_offsets, _ = word_hashes(data, offsets)
        values, at = distinct(*shingle_hashes(words, word_offsets))
        sizes = np.diff(at)
        mins = np.empty((n, n_hashes), np.uint64)
        for k in range(n_hashes):
            h = (values ^ xors[k]) * odds[k]
            h ^= h >> np.uint64(32)
            mins[:, k] = sums(h, at, np.minimum)
        keys = mixed((mins.reshape(n, 2 * side, rows) * table).sum(axis=2, dtype=np.uint64) + table[:, 0])
        yield sizes, sums(mixed(values), at), sums(mixed(values ^ xors[0]), at), keys, mixed(mins).astype(np.uint8)


def sketches(docs: DataFrame, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (keys of the set), tuples array<long>, agreement binary (a byte per minimum hash)."""
    attach(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at = 0
            for sizes, k1, k2, keys, low in _tuples(batch.column(1), side, rows):
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (2 * side)), pa.array(keys.view(np.int64).ravel())),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "tuples", "agreement"],
                )
                at += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, n_shingles long, k1 long, k2 long, tuples array<long>, agreement binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, k1, n_shingles, shingles array<long> (64-bit hashes of the distinct shingles)."""
    attach(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for row, n, data, offsets in slices(batch.column(1)):
                words, word_offsets, _ = word_hashes(data, offsets)
                values, at = distinct(*shingle_hashes(words, word_offsets))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(sums(mixed(values), at).view(np.int64)), pa.array(np.diff(at).astype(np.int64)), lists], ["doc_id", "k1", "n_shingles", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, k1 long, n_shingles long, shingles array<long>")


def _keys(reps: DataFrame, side: int) -> DataFrame:
    """A written table (key, node, x, y, hub, bucket, bucket_shingles) for keys that two nodes or more share; x and y are the places of the
    key's tuples in the two collections, bucket counts the members, bucket_shingles their shingles, and hub is the member
    whose tuples most others have."""
    one = reps.select("node", "n_shingles", F.posexplode("tuples").alias("place", "value"))
    shared = materialize(one.groupBy("value").agg(F.count("*").alias("n_")).where("n_ > 1"), "shared-tuples")
    at = F.struct("place", "value")
    met = spread_join(one, shared, "value", hot_keys(shared, "value"))
    sides = met.groupBy("node", "n_shingles").agg(F.sum("n_").alias("popularity"), F.collect_list(F.when(F.col("place") < side, at)).alias("a"), F.collect_list(F.when(F.col("place") >= side, at)).alias("b"))
    pairs = sides.select("node", "n_shingles", "popularity", F.explode("a").alias("p"), "b").select("node", "n_shingles", "popularity", "p", F.explode("b").alias("q"))
    keyed = pairs.select(F.xxhash64("p.value", "q.value").alias("key"), "node", "n_shingles", "popularity", F.col("p.place").cast("short").alias("x"), (F.col("q.place") - side).cast("short").alias("y"))
    keyed = materialize(keyed, "keyed")
    discard(shared)
    buckets = keyed.groupBy("key").agg(F.count("*").alias("bucket"), F.sum("n_shingles").alias("bucket_shingles"), F.max_by("node", F.struct("popularity", -F.col("node"))).alias("hub")).where("bucket > 1")
    buckets = materialize(buckets, "buckets")
    keys = materialize(spread_join(keyed.select("key", "node", "x", "y"), buckets, "key", hot_keys(buckets.withColumnRenamed("bucket", "n_"), "key")), "keys")
    discard(keyed)
    discard(buckets)
    return keys


def _agreements(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot_u: DataFrame | None, hot_v: DataFrame | None) -> DataFrame:
    """The (u, v) whose full sets have 100 * common >= percent * union."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    sized = spread_join(spread_join(pairs, left, "u", hot_u), right, "v", hot_v).where((F.size("su") * 100 >= F.size("sv") * percent) & (F.size("sv") * 100 >= F.size("su") * percent))
    common = F.size(F.array_intersect("su", "sv"))
    return sized.where(100 * common >= percent * (F.size("su") + F.size("sv") - common)).select("u", "v")


def _whole_groups(batches, by: tuple[str, ...], least_rows: int):
    """Tables of whole groups of least_rows rows or more in all (the last may be smaller); rows come sorted by the group."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < least_rows:
            continue
        table = pa.concat_tables(held)
        # the last group may go on in the next batch
        other = np.zeros(table.num_rows, bool)
        for k in by:
            values = table.column(k).to_numpy()
            other |= values != values[-1]
        ended = np.flatnonzero(other)
        cut = int(ended[-1]) + 1 if len(ended) else 0
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held and (table := pa.concat_tables(held)).num_rows:
        yield table


def _binary(table: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(table.num_rows, -1)


_GROUP = ("key", "bi", "bj")


def _across(side: int, least: int):
    """Pairs of one bucket's members in different components, as a row for each member with its later partners.

    A pair is taken in the first bucket that it shares only, and where its hashes agree often enough. Members
    without a pair are left out, so there is at most one row per member and block pair, whatever the pairs.
    """

    def pairs(frame: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        key, bi, bj, own, comp = (frame[k] for k in ("key", "bi", "bj", "own", "comp"))
        lag = 1
        while lag < len(key):
            same = (key[lag:] == key[:-lag]) & (bi[lag:] == bi[:-lag]) & (bj[lag:] == bj[:-lag])
            if not same.any():
                break
            i = np.flatnonzero(same & (comp[lag:] != comp[:-lag]) & ((own[lag:] != own[:-lag]) | (bi[lag:] == bj[lag:])))
            j = i + lag
            for values, place in ((frame["a"], frame["x"]), (frame["b"], frame["y"])):
                if len(i):
                    keep = (values[i] == values[j]).argmax(axis=1) == place[i]
                    i, j = i[keep], j[keep]
            if len(i):
                keep = (frame["low"][i] == frame["low"][j]).sum(axis=1) >= least
                firsts.append(i[keep])
                seconds.append(j[keep])
            lag += 1
        return np.concatenate(firsts), np.concatenate(seconds)

    def run(batches):
        for table in _whole_groups(batches, _GROUP, 20_000):
            tuples = np.array(table.column("tuples").combine_chunks().flatten(), np.int64).reshape(table.num_rows, 2 * side)
            frame = {k: table.column(k).to_numpy() for k in ("key", "bi", "bj", "own", "comp", "x", "y")}
            i, j = pairs(frame | {"a": tuples[:, :side], "b": tuples[:, side:], "low": _binary(table, "agreement")})
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            rows = np.union1d(i, j)
            nodes = table.column("node").to_numpy()
            offsets = np.append(np.searchsorted(i, rows), len(i)).astype(np.int32)
            partners = pa.ListArray.from_arrays(pa.array(offsets), pa.array(nodes[j]))
            kept = table.select([*_GROUP, "node", "comp"]).take(pa.array(rows))
            yield from kept.append_column("partners", partners).combine_chunks().to_batches()

    return run


def _linked(percent: int):
    """Links between the components of a group's members, tested on their whole sets of 64-bit shingle hashes.

    A pair whose components a link of this group has already joined needs no test.
    """

    def links(nodes, comps, sets, partners):
        nodes, first = np.unique(nodes, return_index=True)
        sets = [sets[k] for k in first.tolist()]
        lengths = np.array([len(x) for x in sets])
        starts = np.cumsum(lengths) - lengths
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        present = np.zeros(len(ids), bool)
        _, label = np.unique(comps[first], return_inverse=True)
        for own, own_partners in partners:
            u = int(np.searchsorted(nodes, own))
            v = np.searchsorted(nodes, own_partners)
            v = v[(label[v] != label[u]) & (100 * np.minimum(lengths[v], lengths[u]) >= percent * np.maximum(lengths[v], lengths[u]))]
            if not len(v):
                continue
            mine = ids[starts[u] : starts[u] + lengths[u]]
            present[mine] = True
            ends = np.cumsum(lengths[v])
            at = np.arange(ends[-1]) + np.repeat(starts[v] - ends + lengths[v], lengths[v])
            common = np.add.reduceat(present[ids[at]].astype(np.int64), ends - lengths[v])
            present[mine] = False
            for w in v[100 * common >= percent * (lengths[u] + lengths[v] - common)].tolist():
                if label[w] != label[u]:
                    label[label == label[w]] = label[u]
                    yield nodes[u], nodes[w]

    def run(batches):
        for table in _whole_groups(batches, _GROUP, 2_000):
            keys = np.column_stack([table.column(k).to_numpy().astype(np.int64) for k in _GROUP])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out: list[tuple] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(lo, hi - lo)
                nodes, comps = (part.column(k).to_numpy() for k in ("node", "comp"))
                sets = [x.values.to_numpy() for x in part.column("shingles")]
                later = [(d, np.array(p, np.int64)) for d, p in zip(nodes.tolist(), part.column("partners").to_pylist(), strict=True) if p]
                out += links(nodes, comps, sets, later)
            u, v = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 75, side: int = SIDE, rows: int = ROWS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    A written table is deleted as soon as no later step reads it; what the result reads stays. Tuples and hashes, the
    bulk of a sketch, are kept for nodes only, and from the keys on for nodes that share one only.
    """
    sketch = materialize(sketches(docs, side, rows), "sketches")
    found = sketch.where("n_shingles > 0 and doc_id is not null")
    # one node per distinct set: its least doc_id, and what every text of it has in common
    whole_set = ["n_shingles", "k1", "k2"]
    nodes = found.groupBy(*whole_set).agg(F.min("doc_id").alias("rep"), F.first("tuples").alias("tuples"), F.first("agreement").alias("agreement"), F.count("*").alias("n_"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    slim = lambda df, name: (materialize(df.drop("tuples", "agreement"), name), discard(df))[0]
    sketch = slim(sketch, "rows")
    found = sketch.where("n_shingles > 0 and doc_id is not null")
    keys = _keys(nodes.select("node", "n_shingles", "tuples"), side)
    near = nodes.join(keys.select("node").distinct(), "node", "left_semi")
    near = materialize(near, "near")
    nodes = slim(nodes, "slim-nodes")
    # the texts of the representatives that share a key; a doc_id with several texts may stand for several sets
    texts = rows_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), near.select(F.col("rep").alias("doc_id")).distinct())
    named = near.select(F.col("rep").alias("doc_id"), "k1", "n_shingles", "node")
    sets = materialize(shingle_sets(texts).join(named, ["doc_id", "k1", "n_shingles"]).select("node", "shingles").dropDuplicates(["node"]), "sets")
    # rows of one doc_id with different texts: their nodes meet through the id
    classed = found.select("doc_id", *whole_set)
    several = classed.groupBy("doc_id").agg(F.min(F.struct(*whole_set)).alias("lo"), F.max(F.struct(*whole_set)).alias("hi")).where("lo <> hi").select("doc_id", F.col("lo.*"))
    mates = classed.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    node_of = nodes.select(*whole_set, "node")
    firsts = several.join(node_of, whole_set).select("doc_id", F.col("node").alias("u"))
    own = mates.join(node_of, whole_set).select("doc_id", F.col("node").alias("v")).join(firsts, "doc_id").select("u", "v").where("u <> v").distinct()

    stars = keys.where("node <> hub").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    stars = materialize(stars, "stars")
    hot_u, hot_v = (hot_keys(stars.groupBy(c).agg(F.count("*").alias("n_")), c) for c in ("u", "v"))
    low = near.select("node", "agreement")
    least = int(np.ceil(LEAST_AGREEMENT * 2 * side * rows))
    both = spread_join(spread_join(stars, low.toDF("u", "au"), "u", hot_u), low.toDF("v", "av"), "v", hot_v)
    likely = both.where(F.pandas_udf(_agreements, "int")("au", "av") >= least).select("u", "v")
    links = materialize(_confirmed(likely, sets, percent, hot_u, hot_v), "links-star")
    components = connected_components(links)

    labelled = keys.drop("hub").join(components, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    labelled = materialize(labelled, "labelled")
    discard(keys)
    sizes = labelled.groupBy("key").agg(F.count("*").alias("n_"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_keys = materialize(sizes.where("lo < hi").select("key", "n_"), "open-keys")
    open_ = spread_join(labelled, open_keys, "key", hot_keys(open_keys, "key"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("bucket") / block), F.ceil(F.col("bucket_shingles") / block_shingles)).cast("int")
    dealt = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node", "comp", "x", "y")
    full = spread.join(near.select("node", "tuples", "agreement"), "node")
    grouped = lambda df: df.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    across = materialize(grouped(full).mapInArrow(trimmed(_across(side, least)), "key long, bi int, bj int, node long, comp long, partners array<long>"), "pairs-rest")
    for spent in (labelled, near, open_keys):
        discard(spent)
    more = grouped(across.join(sets, "node")).mapInArrow(trimmed(_linked(percent)), "u long, v long")
    more = materialize(more.distinct(), "links-rest")
    discard(across)
    discard(sets)
    # a component's id is the least doc_id of its nodes
    components = connected_components(links.union(more).union(own))
    placed = materialize(nodes.select("node", "rep").join(components, "node"), "placed")
    least_id = materialize(placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_")), "components")
    joined = spread_join(placed.select("node", "component"), least_id, "component", hot_keys(least_id, "component")).select("node", "component_id")
    named = nodes.select(*whole_set, "rep", "node").join(joined, "node", "left").select(*whole_set, F.coalesce("component_id", "rep").alias("component_id"))
    mine = spread_join(found.select("doc_id", *whole_set), named, whole_set, hot_keys(nodes, whole_set)).select("doc_id", "n_shingles", "component_id")
    rest = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return mine.unionByName(rest).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))
