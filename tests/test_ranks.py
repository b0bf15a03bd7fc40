"""Places, running sums and quantiles against numpy, with ties, nulls, one large group and empty tables."""

import numpy as np
import pytest

from stockweave.operators.ranks import in_order, quantiles

SCHEMA = "g string, v double, u string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    big = [("big", float(rng.integers(0, 40)), f"{k:04d}") for k in range(900)]  # many ties
    small = [(rng.choice(["a", "b", None]), None if k % 9 == 0 else float(rng.normal()), f"s{k}") for k in range(60)]
    return big + small + [("none", None, "n1"), ("one", 3.5, "o1")]


def test_places_and_running_sums(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(in_order(df, [("v", "desc"), "u"], "v").collect(), key=lambda r: r["place_"])
    want = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1e9), r[2]))
    assert [r["place_"] for r in got] == list(range(1, len(rows) + 1)) and [r["u"] for r in got] == [w[2] for w in want]
    sums = np.cumsum([0.0] + [w[1] or 0.0 for w in want])
    assert [r["before_"] for r in got] == pytest.approx(sums[:-1]) and {r["count_"] for r in got} == {len(rows)}
    assert all(r["total_"] == pytest.approx(sums[-1]) for r in got)


def test_groups(spark, rows):
    got = in_order(spark.createDataFrame(rows, SCHEMA), ["v", "u"], "v", ["g"]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["place_"])
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        assert [r["u"] for r in own] == [w[2] for w in want] and {r["count_"] for r in own} == {len(want)}
        assert [r["place_"] for r in own] == list(range(1, len(want) + 1))
        assert [r["before_"] for r in own] == pytest.approx(np.cumsum([0.0] + [w[1] or 0.0 for w in want])[:-1])


def test_quantiles(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = {"lo": 0.0, "p10": 0.1, "mid": 0.5, "hi": 1.0}
    for by in ([], ["g"]):
        got = {tuple(r[c] for c in by): r for r in quantiles(df, "v", wanted, by).collect()}
        groups = {}
        for g, v, _ in rows:
            if v is not None:
                groups.setdefault((g,) if by else (), []).append(v)
        assert set(got) == set(groups)
        for key, values in groups.items():
            assert [got[key][n] for n in wanted] == pytest.approx(np.quantile(values, list(wanted.values())).tolist())


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert in_order(empty, ["v"], "v").count() == in_order(empty, ["v"], "v", ["g"]).count() == quantiles(empty, "v", {"m": 0.5}, ["g"]).count() == 0


def test_a_hot_value_lies_in_several_partitions(spark):
    df = spark.range(4000).selectExpr("'x' as g", "1.0D as v", "cast(id as string) as u")
    placed = in_order(df, ["v"], "v", ["g"])
    assert placed.selectExpr("count(distinct place_)", "max(place_)", "max(before_)").first()[:] == (4000, 4000, 3999.0)
    written = next(f for f in placed.inputFiles()).rsplit("/", 1)[0]
    sizes = spark.read.parquet(written).groupBy("part_").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 2500
