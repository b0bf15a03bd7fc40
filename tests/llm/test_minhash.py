"""Links of ids with several texts, exact tests inside a task, hot keys, and recall on related but unlike texts."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from test_queries import components, shingles

from stockweave.llm import graph, minhash


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def found(spark, rows, **options):
    made = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return {r["doc_id"]: r["component_id"] for r in made.collect()}


def test_every_text_of_an_id_is_compared(spark):
    rng = np.random.default_rng(1)
    a, b = words(rng, 60), words(rng, 60)
    near = lambda t: " ".join([*t, "x"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(words(rng, 60)))]
    assert found(spark, rows) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert found(spark, [(7, " ".join(a)), (7, " ".join(b)), (9, near(b)), (8, near(a))]) == {7: 7, 8: 7, 9: 7}


def test_linked_merges_exact_links_only():
    """Sets 1 and 2 agree in the low 32 bits of their hashes only; 1 and 3 are really alike."""
    base = np.arange(1, 101, dtype=np.int64)
    sets = [base, base + (1 << 40), np.append(base[:95], [900, 901])]
    table = pa.table({"key": [5] * 3, "bi": [0] * 3, "bj": [0] * 3, "node": [1, 2, 3], "comp": [1, 2, 3], "partners": [[2, 3], [3], []], "shingles": [s.tolist() for s in sets]})
    schema = pa.schema([("key", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("node", pa.int64()), ("comp", pa.int64()), ("partners", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])
    out = [tuple(r.values()) for b in minhash._linked(75)(table.cast(schema).to_batches()) for r in b.to_pylist()]
    assert out == [(1, 3)]


def test_related_texts_in_one_bucket(spark):
    """Many texts that share a long passage, most of them less than 75 % alike, in blocks of a few members."""
    rng = np.random.default_rng(3)
    passage, rows = words(rng, 60), []
    for k in range(120):
        own = words(rng, int(rng.integers(6, 40)))
        rows.append((2 * k, " ".join(passage + own)))
        if k % 3 == 0:
            rows.append((2 * k + 1, " ".join(passage + own + ["end"])))
    want = components({i: shingles(t) for i, t in rows})
    assert found(spark, rows) == want
    assert found(spark, rows, block=16) == want


def test_hot_keys_are_dealt_to_several_places(spark, monkeypatch):
    monkeypatch.setattr(graph, "PLACE_ROWS", 10)
    rows = spark.range(500).select((F.col("id") % 3 * F.when(F.col("id") % 2 == 0, 1).otherwise(0)).alias("k"), "id")
    side = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("ten"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n_"))
    hot = graph.hot_keys(counts, "k", 10)
    assert {r["k_"]: r["places_"] for r in hot.collect()} == {r["k"]: -(-r["n_"] // 10) for r in counts.collect()}
    got = graph.spread_join(rows, side, "k", hot).toPandas().sort_values("id").reset_index(drop=True)
    want = rows.join(side, "k").toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["k", "id", "ten"]], want[["k", "id", "ten"]])
    assert graph.hot_keys(counts, "k") is None


def test_results_with_hot_keys(spark, monkeypatch):
    real = graph.hot_keys
    monkeypatch.setattr(minhash, "hot_keys", lambda c, k, n=8: real(c, k, n))
    rng = np.random.default_rng(4)
    passage, rows = words(rng, 50), []
    for k in range(60):
        rows.append((k, " ".join(passage + words(rng, 12 if k % 2 else 30))))
    rows += [(100 + k, rows[3][1]) for k in range(40)]
    assert found(spark, rows) == components({i: shingles(t) for i, t in rows})


def test_spent_tables_are_deleted(spark):
    """While the result waits to be read, only the tables it reads and small ones are left."""
    from pathlib import Path

    from stockweave.session import work_dir

    folder = Path(work_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    rng = np.random.default_rng(6)
    base = words(rng, 60)
    rows = [(k, " ".join([*base[: 60 - k], "y"])) for k in range(6)] + [(9, " ".join(words(rng, 50)))]
    made = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}
    assert not left & {"sketches", "nodes", "shared-tuples", "keyed", "buckets", "keys", "near", "labelled", "open-keys", "pairs-rest", "sets"}
    assert made.count() == len(rows)
