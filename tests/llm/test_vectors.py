"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from stockweave.llm import vectors


def brute(rows, cosine=0.95):
    """vec_id -> sorted (n_links, component) of its rows, from all pairs."""
    usable = [(k, np.array(v, float) / np.abs(v).max()) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    for a, x in usable:
        for b, y in usable:
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                parent[top(b)] = top(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, links[k], least[top(k)] if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def check(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as node", "2 as component", "3 as sigs")
    got = vectors.near_duplicate_vectors(df, **options).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def clusters(n, dims, seed):
    """Centres with members at cosines from about 0.9 to 1."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        centre = rng.standard_normal(dims)
        for j in range(int(rng.integers(1, 9))):
            out.append((k * 10 + j, (centre + rng.uniform(0, 0.35) * rng.standard_normal(dims)).tolist()))
    return out


def test_clusters_of_many_bits(spark):
    """Small buckets and blocks, so that keys have many bits and several blocks meet."""
    rows = clusters(120, 16, 2)
    check(spark, rows, "double", bucket_rows=8, block_rows=3)


def test_hot_group_and_copies(spark):
    """A third of all rows are near copies, another fifth exact ones; rounding to float keeps all pairs on their side."""
    rng = np.random.default_rng(9)
    centre, other = rng.standard_normal(24), rng.standard_normal(24)
    near = [(k, (centre + 0.1 * rng.standard_normal(24)).tolist()) for k in range(200)]
    copies = [(1000 + k, other.tolist()) for k in range(120)]
    rest = [(3000 + k, rng.standard_normal(24).tolist()) for k in range(280)]
    rows = [(i, np.float32(v).astype(float).tolist()) for i, v in near + copies + rest]
    check(spark, rows, bucket_rows=64, block_rows=40)


def test_edges(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, float("nan")]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (11, [1e-30, 2e-30]), (12, [5.0]), (0, [7.0])]
    check(spark, rows, "double")
    check(spark, [], "float")
    check(spark, [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1e200, -2e200])], "double")


def test_tables_miss_rarely():
    for n in (1, 500, 50_000, 10**9, 10**12):
        tables, bits = vectors.plan_tables(n, 0.95)
        agree = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - agree) ** tables <= vectors.MISS and bits <= 40


@pytest.mark.parametrize("t", [0, 2])
def test_links_between(t):
    """Tiles against a direct count, with earlier tables left out."""
    rng = np.random.default_rng(t)
    n = 700
    unit = vectors._unit(rng.standard_normal((5, 8))[rng.integers(0, 5, n)] + 0.1 * rng.standard_normal((n, 8)))
    block = {"nodes": rng.permutation(10 * n)[:n], "counts": rng.integers(1, 4, n), "sigs": np.repeat(rng.integers(0, 3, (n // 100, 4)), 100, axis=0), "unit": unit}
    halves = [{k: v[s] for k, v in block.items()} for s in (slice(0, 300), slice(300, n))]
    near = (unit @ unit.T >= 0.95) & ~(block["sigs"][:, None, :t] == block["sigs"][None, :, :t]).any(axis=2)
    np.fill_diagonal(near, False)
    for parts, pairs in (((block, None), near), ((halves[0], halves[1]), np.where((np.arange(n) < 300)[:, None] != (np.arange(n) < 300)[None], near, False))):
        node, links, root = vectors.links_between(*parts, t, 0.95)
        want = {int(block["nodes"][k]): int((pairs[k] * block["counts"]).sum()) for k in range(n) if pairs[k].any()}
        assert dict(zip(node.tolist(), links.tolist(), strict=True)) == want
        assert all(r <= k and r in want for k, r in zip(node.tolist(), root.tolist(), strict=True))
