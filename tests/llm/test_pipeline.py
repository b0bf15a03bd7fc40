"""The pipeline's stages, one after another, against plain versions on the smallest tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import WORD, components, shingles, token_ids

import corpus_pipeline
from stockweave.llm import mixing, quality
from stockweave.session import materialize

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    (_, good), (_, single), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = materialize(good(spark, docs, DIR), "a")
    scores = quality.score(docs, quality.train(docs, labels)).toPandas()
    assert kept.columns == docs.columns
    a = kept.toPandas()
    assert sorted(a.doc_id) == sorted(scores[scores.score >= 0.3].doc_id) and 0 < len(a) < len(scores)

    once = materialize(single(spark, kept, DIR), "b")
    b = once.toPandas()
    want = components({i: shingles(t) for i, t in zip(a.doc_id, a.text, strict=True)})
    assert once.columns == docs.columns and sorted(b.doc_id) == sorted(i for i, c in want.items() if i == c)

    mixed = materialize(mix(spark, once, DIR), "c")
    c = mixed.toPandas()
    plan = mixing.mix(once).toPandas().set_index("doc_id")
    words = c.assign(n=[len(WORD.findall(t or "")) for t in c.text]).groupby("doc_id").n.sum()
    assert mixed.columns == docs.columns and words.to_dict() == {i: n for i, n in plan.taken.items() if n}
    own = b.set_index("doc_id").text
    assert all(own[i].startswith(t) and len(t) == n for i, t, n in zip(c.doc_id, c.text, c.n_chars, strict=True))
    targets = plan.assign(source=b.set_index("doc_id").source).groupby("source", dropna=False).agg(t=("target", "first"), n=("taken", "sum"))
    assert (targets.n == np.floor(targets.t + 1e-9)).all()

    pieces = pack(spark, mixed, DIR).toPandas()
    ids = token_ids(pd.DataFrame({"doc_id": range(len(c)), "text": c.text}))
    assert pieces.length.sum() == sum(map(len, ids.values()))
    sizes = pieces.groupby("sequence_id").length.sum()
    assert ((sizes & (sizes - 1)) == 0).all() and sizes.max() <= 4096


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, DIR).select(F.countDistinct("doc_id"), F.sum("length")).first()
    assert got[0] > 50 and got[1] > 1000


LONG = " ".join(f"w{k}" for k in range(200_000))
ROWS = [(1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", None, 11), (5, "g h i j k l", "en", "t", 11), (5, "g h i j k l", "en", "t", 11), (5, "another text under this id", "en", "t", 26), (3, None, None, "s", None), (4, "", "en", "s", 0), (None, "x y", "en", "t", 3), (None, "x y", "en", "t", 3), (6, LONG, "en", "t", len(LONG)), (7, LONG, "en", "s", len(LONG))]
NAMES = "size taken component_id row_ maybe_ at_ places_ count digest_ order_key range source_size"


@pytest.mark.parametrize("n", [0, len(ROWS)])
def test_stages_on_odd_rows(spark, n):
    """Nulls, ties, repeated rows, a very long text, an empty table, and columns whose names the stages use themselves."""
    docs = spark.createDataFrame(ROWS[:n], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in NAMES.split()})
    (_, good), (_, single), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = good(spark, docs, DIR)
    assert kept.columns == docs.columns and kept.count() <= n
    once = materialize(single(spark, docs, DIR), "once")
    assert once.columns == docs.columns
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in once.collect())
    assert left == sorted([(0, "x y"), (0, "x y"), (1, ROWS[0][1]), (3, ""), (4, ""), (5, ROWS[2][1]), (5, ROWS[4][1]), (6, LONG)])[: n and None]
    mixed = materialize(mix(spark, once, DIR), "mixed")
    assert mixed.columns == docs.columns and mixed.where("text is null or n_chars <> char_length(text)").count() == 0
    pieces = pack(spark, mixed, DIR)
    assert pieces.where("start = 0").count() == mixed.count()


def test_lookup_tables_of_the_quality_model():
    """Scoring by bins is the plain sum of table entries, and a boosting step is the best cut found by trying all."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y)
    for row, s in zip(x[:60], model.score(x[:60]), strict=True):
        z = model.base + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        for (f, g), t in zip(model.pairs, model.pair_tables, strict=True):
            z += t[sum(row[f] >= e for e in model.pair_edges[f]), sum(row[g] >= e for e in model.pair_edges[g])]
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-12
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    g, h = rng.normal(size=12), rng.uniform(0.5, 1, 12)
    worth = lambda a, b: a.sum() ** 2 / (b.sum() + 5.0)
    cut = max(range(1, 12), key=lambda k: worth(g[:k], h[:k]) + worth(g[k:], h[k:]))
    want = np.concatenate([np.full(cut, g[:cut].sum() / (h[:cut].sum() + 5)), np.full(12 - cut, g[cut:].sum() / (h[cut:].sum() + 5))])
    assert np.allclose(quality._tree(g, h, 1), want)
