"""Ranked search against scores of all documents."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from stockweave.llm import queries, ranked

DIR = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, tokens = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for (i, c), size in zip(counts, sizes, strict=True):
            if i is None or not size:
                continue
            m = 100 - 50 + (50 * size * n) // tokens
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_query(spark):
    docs, items = (pd.read_parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(list(zip(docs.doc_id.tolist(), docs.text, strict=True)), list(zip(items.item_id.tolist(), items.text, strict=True)))
    assert found(queries.op13_ranked_search(spark, DIR)) == want


def test_many_shards_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD_DOCS", 7)
    rng = np.random.default_rng(0)
    word = [f"w{int(x)}" for x in range(60)]
    docs = [(int(i), " ".join(rng.choice(word, int(rng.integers(0, 40)), p=np.arange(60, 0, -1) / 1830))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in range(1000, 1150)]  # many equal scores
    items = [(int(i), " ".join(rng.choice(word, int(rng.integers(0, 9))))) for i in range(40)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranked, "slices", lambda column, f=ranked.slices: (x for k in range(len(column)) for x in [(k, *y[1:]) for y in f(column.slice(k, 1))]))
    assert found(ranked.search(*frames, k=5, group_terms=6)) == brute(docs, items, 5)


@pytest.mark.parametrize("n", [0, 9])
def test_edges(spark, n):
    docs = [(1, "A-b c"), (1, "A-b c"), (2, None), (3, ""), (None, "a b zz"), (4, "É é_É"), (5, "x" * 300_000 + " a" * 20_000), (6, "!?"), (7, "c\x00c 7")][:n]
    items = [(1, "a"), (1, "B b"), (2, None), (3, ""), (None, "a"), (4, "é zz"), (5, "É 7 nothing")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as terms", "3 as score")
    for some in (items, []):
        i = spark.createDataFrame(some, "item_id long, text string").selectExpr("*", "1 as term", "2 as doc_id")
        assert found(ranked.search(d, i)) == brute(docs, some)


def test_bands_stop_early_and_exactly():
    rng = np.random.default_rng(6)
    for trial in range(200):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 20))
        total, lists = np.zeros(n, np.int64), []
        for _ in range(int(rng.integers(1, 7))):
            docs = rng.permutation(n)[: int(rng.integers(1, n + 1))]
            impacts = np.sort((10 ** rng.uniform(0, 5, len(docs))).astype(np.int64) // (1 if trial % 2 else 1000))[::-1]
            total[docs] += impacts
            lists.append((impacts, docs))
        ids = rng.permutation(n)
        want = sorted((-int(s), int(i)) for s, i in zip(total, ids, strict=True) if s > 0)[:k]
        rows, score = ranked.best_documents(lists, n, ids, k)
        assert [(-int(s), int(ids[r])) for r, s in zip(rows, score, strict=True)] == want


def test_full_filter_changes_nothing(spark):
    docs = spark.createDataFrame([(k, f"a b{k % 3} c{k % 7}") for k in range(50)], "doc_id long, text string")
    asked = ranked.query_terms(spark.createDataFrame([(1, "b1 c2")], "item_id long, text string"))
    few, every = (ranked.document_frequencies(ranked.build_index(docs, f)) for f in (ranked.term_filter(asked), np.full(4096, 255, np.uint8)))
    assert found(few.join(asked, "term").select("term", "df")) == found(every.join(asked, "term").select("term", "df"))
    assert every.count() == 11 and few.count() <= 11
