"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockweave.llm import queries, runs

DIR = "/root/testdata/sf0.001"


def brute(words, least=12):
    """(start, length, period) from the definition: maximal stretches of every period, smallest period of equal ones."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, t - s, q) for (s, t), q in best.items())


def brute_collapsed(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(4, 13))
def test_runs_of_small_alphabets(word, least):
    hashes = np.array(word, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = [r[1:] for r in runs.text_runs(hashes, np.array([0, len(word)]), least)]
    assert sorted(got) == brute(word, least)


def test_segment_alone_and_nested_periods():
    rng = random.Random(4)
    for _ in range(60):
        part = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        word = [rng.randrange(3) for _ in range(9)] + (part * rng.randrange(2, 7)) * 2 + [rng.randrange(3) for _ in range(9)] + part * 4
        assert runs.segment_runs(np.array(word)) == brute(word)


def test_automaton_lengths_and_ends():
    word = [1, 2, 1, 1, 2, 1, 3]
    length, link, end = runs.automaton(word)
    assert len(length) <= 2 * len(word) and sorted(e for e in end if e >= 0) == list(range(len(word)))
    assert all(length[link[v]] < length[v] for v in range(1, len(length)))


def test_positions_stay_ordered():
    rng = random.Random(1)
    made, own = runs.Positions(500), {500}
    for x in rng.sample(range(2000), 900):
        below, above = max((y for y in own if y < x), default=-1), min((y for y in own if y > x), default=-1)
        if x not in own:
            assert made.neighbours(x) == (below, above)
            made.add(x)
            own.add(x)
    assert sorted(made) == sorted(own) and len(made) == len(own)


def test_query(spark):
    docs = pd.read_parquet(f"{DIR}/documents.parquet").set_index("doc_id")
    got = queries.op11_runs(spark, DIR).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, text in docs.text.items():
        words, h = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")], zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        found = brute(words)
        row = got.loc[i]
        said = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))
        assert row.n_runs == len(found) and row.runs_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, found).encode()).hexdigest()
        if found:
            s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert row[["start", "length", "period", "exponent_milli"]].isna().all()


@pytest.mark.parametrize("n", [0, 8])
def test_edges(spark, n):
    line = "one two three four"
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, " ".join([line] * 3)), (4, "x\x00y " * 6), (4, "x\x00y " * 6), (5, "É é " * 8), (6, ("w%d " * 200 % tuple(range(200))) * 30)]
    docs = spark.createDataFrame(rows[:n], "doc_id long, text string").selectExpr("*", "1 as runs", "2 as words", "'x' as collapsed")
    got = {(r["doc_id"], r["n_words"]): (r["runs"], r["collapsed"]) for r in runs.find_runs(docs).collect()}
    assert len(got) == (7 if n else 0)
    if n:
        assert got[1, 0] == got[2, 0] == got[3, 0] == ([], "")
        assert [tuple(r) for r in got[None, 12][0]] == [(0, 12, 4)] and got[None, 12][1] == line
        assert [tuple(r) for r in got[4, 6][0]] == [] and got[4, 6][1] == " ".join(["x\x00y"] * 6)
        assert [tuple(r) for r in got[5, 16][0]] == [(0, 16, 2)] and got[5, 16][1] == "É é"
        assert [tuple(r) for r in got[6, 6000][0]] == [(0, 6000, 200)] and len(got[6, 6000][1].split()) == 200


def test_long_and_periodic():
    """One text of very many equal words, one of long repeated parts between others."""
    assert runs.segment_runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    rng = np.random.default_rng(3)
    part = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    word = np.concatenate([rng.integers(0, 1 << 62, 500).astype(np.uint64), part, part, part[:700], rng.integers(0, 1 << 62, 900).astype(np.uint64), part])
    assert runs.text_runs(word, np.array([0, len(word)])) == [(0, 500, 6700, 3000)]
