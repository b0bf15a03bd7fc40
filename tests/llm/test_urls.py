"""The template tree against a plain version, on urls of several depths, with and without labels."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from stockweave.llm import queries, urls


def plain_tree(rows):
    """rows: (host, segments, blocked or None) -> {(host, segments): (template, purity)}."""
    share = lambda part, above: (sum(b for *_, b in part if b is not None) + urls.SMOOTH * above) / (sum(b is not None for *_, b in part) + urls.SMOOTH)
    known = [b for *_, b in rows if b is not None]
    start = (sum(known) + 1) / (len(known) + 2)
    first, out = {}, {}
    for s in {r[1][0] for r in rows if r[1]}:
        first[s] = share([r for r in rows if r[1] and r[1][0] == s], start)

    def grow(host, part, depth, template, purity):
        below = defaultdict(list)
        for r in part:
            if len(r[1]) == depth:
                out[host, r[1]] = (template or "/", purity)
            else:
                below[r[1][depth]].append(r)
        n = sum(map(len, below.values()))
        kept = {s: rs for s, rs in below.items() if len(rs) >= urls.LEAST_COUNT and len(rs) >= urls.LEAST_SHARE * n}
        counts = {s: (sum(r[2] for r in rs if r[2] is not None), sum(r[2] is not None for r in rs)) for s, rs in kept.items()}
        bands, last = [], None
        for s in sorted((s for s in kept if counts[s][1]), key=lambda s: (counts[s][0] / counts[s][1], s)):
            b, k = counts[s]
            if last:
                p = (last[0] + b + 1) / (last[1] + k + 2)
                gap = b / k - last[0] / last[1]
            if not last or gap * gap > urls.Z**2 * p * (1 - p) * (1 / last[1] + 1 / k):
                bands.append([])
            bands[-1].append(s)
            last = (b, k)
        branches = bands + [[s] for s in kept if not counts[s][1]]
        label = {s: "|".join(sorted(band)) for band in branches for s in band}
        groups = defaultdict(list)
        for s, rs in below.items():
            groups[label.get(s, "*")] += rs
        for name, rs in groups.items():
            above = (purity + first[name]) / 2 if depth == 0 and name in label.values() and name in below and "|" not in name else purity
            grow(host, rs, depth + 1, f"{template}/{name}", share(rs, above))

    for host in {r[0] for r in rows}:
        part = [r for r in rows if r[0] == host]
        grow(host, part, 0, "", share(part, start))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for _ in range(1500):
        host = rng.choice(["a", "b", "c"])
        kind = rng.choice(["news", "shop", "help", "blog", "tag"])
        deep = rng.choice([0, 1, 2, 4])
        path = ((kind, rng.choice(["x", "y", "z"]), "{number}", rng.choice(["p", "q", f"only{rng.random()}"]))[:deep])
        blocked = None if host == "c" or kind == "tag" else int(rng.random() < {"news": 0.1, "shop": 0.9, "help": 0.12, "blog": 0.5}[kind])
        out.append((host, path, blocked))
    spine = tuple("abcdefghijklmnopqrst")  # eight urls down to level 18, where they part
    out += [("b", spine[:18] + (f"end{k}",) * (k % 3), k % 2) for k in range(8)]
    # few urls, deep: alone, or three of unequal length through one node
    out += [("a", tuple(f"lone{k}" for k in range(150)), None), ("c", ("rare",) * 90, 1), ("c", ("rare",) * 60, 0), ("c", ("rare",) * 60 + ("x",), None)]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_tree(spark, rows, hot, monkeypatch):
    if hot:
        real = urls.hot_keys
        monkeypatch.setattr(urls, "hot_keys", lambda c, k: real(c, k, 20))
    df = spark.createDataFrame(rows, "host string, segments array<string>, blocked int")
    got = {(r["host"], tuple(r["segments"])): (r["template"], r["purity"]) for r in urls.template_tree(df).collect()}
    want = plain_tree(rows)
    assert set(got) == set(want)
    for k, (template, purity) in want.items():
        assert got[k] == (template, pytest.approx(purity, abs=1e-12)), k
    templates = {t for t, _ in got.values()}
    assert any(t.startswith("/help|news") for t in templates) and any(t.startswith("/tag/") for t in templates) and len(templates) > 20


def test_segments(spark):
    cases = {"/en/825.html/": ["en", "{mixed}"], "//a//7": ["a", "{number}"], "/feedface/cafe-babe": ["feedface", "cafe-babe"], "/deadbeef01/5f-a|b*": ["{hex}", "{mixed}"], "": [], "/": []}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r["p"]: r["s"] for r in df.select("p", urls.segments(F.col("p")).alias("s")).collect()} == cases
    long = "/" + "/".join("s" * (k % 3 + 1) for k in range(40))
    got = spark.createDataFrame([(long,)], "p string").select(urls.segments(F.col("p")).alias("s")).first()["s"]
    assert got == long.split("/")[1:]


def test_deep_paths(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.example.net/{'es' if k % 2 else 'en'}/" + "/".join("abcdefghij"[: k % 11])) for k in range(200)], "page_id long, url string")
    got = urls.judge(pages)
    assert got.count() == 200 and got.where("template like '/%/%/%/%'").count() > 0


def test_deep_paths_equal_the_sql(spark):
    """The query against its SQL, built for as many levels as the paths have: some shared by many urls, some by few."""
    rng = random.Random(6)
    paths = ["/".join(rng.choice(["a", "b"]) if d % 3 else rng.choice(["en", "es"]) for d in range(rng.choice([1, 4, 9, 22]))) for _ in range(300)]
    paths += ["/".join("longer"[: k % 6 + 1] for k in range(20))] * 40 + ["/".join(["es", *"xyz"] * 5)] * 9
    hosts = ["www.example.com", "example.com", "h.net", "h.example.org", "m.net"]
    pages = spark.createDataFrame([(k, f"http://{hosts[k % 5]}/{p}") for k, p in enumerate(paths)], "page_id long, url string")
    got = urls.judge(pages).select("page_id", "host", "path", "rule", "verdict").toPandas()
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(queries._url_sql(levels=22)).df()
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want[got.columns].itertuples(index=False, name=None)))
    assert set(got.verdict) == {"allow", "block"}
