"""Vectors of any size, length and width take part in the search, and the ranks are exact."""

import numpy as np
from pyspark.sql import functions as F

from stockweave.llm import topk


def brute(data, k, scale=64):
    """data: (vec_id, list of float)."""
    whole = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in data]
    asking = {}
    for i, v in whole:
        if i % 20 == 0:
            asking[i] = min(asking.get(i, v), v)
    out = []
    for i, q in asking.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i and len(v) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(spark, data, k, **options):
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return sorted(map(tuple, topk.top_k(rows, F.col("vec_id") % 20 == 0, k=k, **options).collect()))


def test_large_components(spark):
    data = [(0, [20000.0, 1.0]), (1, [20000.0, 1.0]), (2, [-3e6, 2.0]), (3, [0.5, 0.25]), (20, [1e9, -1e9])]
    assert got(spark, data, 3) == brute(data, 3)


def test_scores_beyond_a_long_rank_exactly(spark):
    data = [(0, [1e15, 1e15]), (1, [1e15, 2e15]), (2, [1e15, 3e15]), (3, [-1e15, -1e15]), (4, [1e15, 2.5e15])]
    want = [(q, r, v, min(max(s, -1 << 63), (1 << 63) - 1)) for q, r, v, s in brute(data, 4)]
    assert got(spark, data, 4) == want and [x[2] for x in want] == [2, 4, 1, 3]


def test_wide_vectors(spark):
    rng = np.random.default_rng(1)
    data = [(k, (rng.normal(size=768) * 16000).tolist()) for k in range(60)]
    assert got(spark, data, 5) == brute(data, 5)


def test_several_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    data = [(k % 31, rng.integers(-2, 3, 1 + k % 3).astype(float).tolist()) for k in range(200)] + [(0, []), (5, []), (40, []), (0, [1.0])]
    assert got(spark, data, 6, block_rows=16, query_rows=2) == brute(data, 6)


def test_a_repeated_id_is_spread_over_blocks(spark):
    data = [(7, [1.0, float(k % 5)]) for k in range(300)] + [(0, [1.0, 1.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    dealt = topk.quantised(rows, 64).withColumns({"w": F.size("v"), "block": F.pmod(F.monotonically_increasing_id(), F.lit(4)).cast("int")})
    assert max(r["n"] for r in topk.build_index(dealt).select("n").collect()) < 100
    assert got(spark, data, 4, block_rows=64) == brute(data, 4)
