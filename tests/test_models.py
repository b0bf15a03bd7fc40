"""Boosted trees against plain sums, no look-ahead, one fit a window, and better than last week's values."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockweave.operators import backtest, boosting, metrics, models
from stockweave.params import HORIZON
from stockweave.session import materialize


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(7)
    start, rows = dt.date(2023, 1, 1), []
    for u in range(4):
        level = (1, 3, 6, 9)[u]
        for k in range(420):
            price = 2.0 if (k // 14 + u) % 3 else 1.5
            mean = level * (1.6 if (k + u) % 7 in (0, 1) else 0.8) * (2 / price) ** 2
            event = ("Fest", "Local") if k % 90 == 40 else (None, None)
            rows.append((f"s{u}", start + dt.timedelta(k), float(rng.poisson(mean)), f"s{u}", f"D{u % 2}", price, int(k % 30 < 10), *event))
    df = spark.createDataFrame(rows, "unique_id string, ds date, y double, item_id string, dept_id string, sell_price double, snap int, event_name_1 string, event_type_1 string")
    return materialize(df, "panel")


@pytest.fixture(scope="module")
def made(panel):
    cv, _, importance = models.global_model(panel, n_windows=2, rounds=6, leaves=16, rate=0.3)
    return materialize(cv, "cv"), importance


def _rows(spark, n=900, n_features=3, seed=1):
    rng = np.random.default_rng(seed)
    bins, y, day = rng.integers(0, 6, (n, n_features), dtype=np.uint8), rng.poisson(2, n).astype(float), rng.integers(0, 10, n)
    key = rng.integers(-(1 << 62), 1 << 62, n)
    df = spark.createDataFrame([(float(a), int(d), int(k), bytearray(b.tobytes())) for a, d, k, b in zip(y, day, key, bins, strict=True)], "y double, day int, key long, bins binary").repartition(3)
    return df, bins, y, day, key


def test_sums_of_leaves(spark):
    """Sampled rows of the wanted leaves, by feature and bin, against a loop over rows."""
    df, bins, y, day, key = _rows(spark)
    found = [boosting.Model("a", 6, [0, 1, 2], 1.1, 0.3), boosting.Model("b", 9, [2], 1.0, -0.1)]
    table = materialize(boosting.scored(df, found, 3, None), "scored")
    trees = [boosting.Tree(), boosting.Tree()]
    left, right = trees[0].split(0, 0, 2)
    trees[0].split(right, 1, 1)
    wanted, features = [[left, 3], [0]], [[0, 2], [2]]
    got = boosting.sums(table, found, trees, wanted, features, 0, 3, 4, 0.8)
    taken = boosting.sampled(key, 4, 0.8)
    assert 0.75 < taken.mean() < 0.85 and (boosting.sampled(key, 5, 0.8) != taken).any()
    place = trees[0].places(np.ascontiguousarray(bins.T))
    for m, model in enumerate(found):
        for k, leaf in enumerate(wanted[m]):
            for j, f in enumerate(features[m]):
                for b in range(6):
                    own = [i for i in np.flatnonzero(taken) if day[i] <= model.last and bins[i, f] == b and (m == 1 or place[i] == leaf)]
                    z, p = model.base, model.power
                    slope = sum(-y[i] * np.exp((1 - p) * z) + np.exp((2 - p) * z) for i in own)
                    curve = sum((p - 1) * y[i] * np.exp((1 - p) * z) + (2 - p) * np.exp((2 - p) * z) for i in own)
                    assert got[m][k, j, b] == pytest.approx([slope, curve, len(own)])
    assert all(model.seconds > 0 for model in found)


def test_a_sibling_is_the_parent_less_the_child(spark):
    df, bins, *_ = _rows(spark, 1200, 4, 3)
    model = boosting.Model("a", 9, [0, 1, 2, 3])
    table = materialize(boosting.scored(df, [model], 4, None), "scored")
    tree = boosting.Tree()
    parent = boosting.sums(table, [model], [tree], [[0]], [[0, 1, 2, 3]], 0, 4, 0, 0.8)[0][0]
    left, right = tree.split(0, 2, 3)
    direct = boosting.sums(table, [model], [tree], [[left, right]], [[0, 1, 2, 3]], 0, 4, 0, 0.8)[0]
    assert parent - direct[0] == pytest.approx(direct[1])


def test_the_best_split():
    rng = np.random.default_rng(5)
    leaf = np.stack([rng.normal(0, 5, (3, boosting.BINS)), rng.uniform(0.1, 3, (3, boosting.BINS)), rng.integers(0, 40, (3, boosting.BINS))], axis=2)
    gain, f, cut, left_is_less = boosting.best_split(leaf, 50)
    worth = lambda s: s[0] ** 2 / (s[1] + boosting.RIDGE)
    tried = {}
    for g in range(3):
        for c in range(boosting.BINS - 1):
            a, b = leaf[g, : c + 1].sum(axis=0), leaf[g, c + 1 :].sum(axis=0)
            if min(a[2], b[2]) >= 50:
                tried[g, c] = worth(a) + worth(b) - worth(a + b)
    assert gain == pytest.approx(max(tried.values())) == pytest.approx(tried[f, cut])
    assert left_is_less == (leaf[f, : cut + 1, 2].sum() <= leaf[f, cut + 1 :, 2].sum())
    assert boosting.best_split(leaf, 10**6)[0] == -1.0


def test_saved_scores_change_nothing(spark, monkeypatch):
    """Scores carried in a table, from tree to tree, give the trees that rescoring all of them gives."""
    df, bins, *_ = _rows(spark, 1500, 3, 8)
    rows = materialize(df, "rows")
    columns = np.ascontiguousarray(bins.T)
    made = []
    for every in (2, 100):
        monkeypatch.setattr(boosting, "SAVE_EVERY", every)
        made.append(boosting.fit(rows, [boosting.Model("a", 9, [0, 1, 2]), boosting.Model("b", 5, [0, 1])], 3, rounds=6, leaves=7, rate=0.2))
    for a, b in zip(*made, strict=True):
        assert a.score(columns) == pytest.approx(b.score(columns))
        assert all(t.feature == u.feature and t.feature.count(-1) <= 7 for t, u in zip(a.trees, b.trees, strict=True))


def test_rounds_lower_the_deviance(spark):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 8, (600, 2), dtype=np.uint8)
    y = rng.poisson(np.where(bins[:, 0] > 4, 9.0, 2.0) * (1 + bins[:, 1] / 8)).astype(float)
    rows = materialize(spark.createDataFrame([(float(a), 0, k * 7919, bytearray(b.tobytes())) for k, (a, b) in enumerate(zip(y, bins, strict=True))], "y double, day int, key long, bins binary"), "rows")
    model = boosting.fit(rows, [boosting.Model("a", 0, [0, 1])], 2, rounds=12, leaves=12, rate=0.3, min_rows=5, feature_share=1.0)[0]
    columns = boosting.matrix(pa.array([b.tobytes() for b in bins], pa.binary()), 2)
    mean = np.exp(model.score(columns))
    assert mean[bins[:, 0] > 4].mean() == pytest.approx(y[bins[:, 0] > 4].mean(), rel=0.05)
    assert ((y - mean) ** 2).mean() < 0.6 * y.var() and sum(model.gains.values()) > 0 and max(model.gains, key=model.gains.get) == 0


def test_backtest_of_the_boosted_model(panel, made):
    cv, importance = made
    assert cv.count() == 4 * 2 * HORIZON and cv.where("yhat is null or yhat < 0").count() == 0
    shares = {r["feature"]: r["gain_share"] for r in importance.collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and set(shares) == set(models.feature_columns()) and "item_id" not in shares
    dept = panel.groupBy("unique_id").agg(F.first("dept_id").alias("dept_id"))
    both = cv.unionByName(backtest.simple_forecasts(panel, 2)).join(dept, "unique_id")
    scores = metrics.evaluate(panel, both, backtest.cutoffs(panel, 2))[0].where("level = 'WRMSSE'").collect()
    value = {(r["cutoff"], r["model"]): r["value"] for r in scores}
    for cutoff in {c for c, _ in value}:
        assert value[cutoff, models.BOOSTED] < value[cutoff, backtest.SEASONAL]


def test_no_look_ahead_and_one_fit_a_window(panel, made):
    """Demand changed after the older cutoff leaves that window's forecasts alone and changes the newer one's."""
    cutoffs = sorted(c for _, c in models._cutoffs(panel, 2))
    changed = panel.withColumn("y", F.when(F.col("ds") > F.lit(cutoffs[0]), F.col("y") * 3 + 5).otherwise(F.col("y")))
    other = models.global_model(materialize(changed, "changed"), n_windows=2, rounds=6, leaves=16, rate=0.3)[0]
    key = lambda df: {(r["cutoff"], r["unique_id"], r["ds"]): r["yhat"] for r in df.collect()}
    a, b = key(made[0]), key(other)
    assert all(a[k] == pytest.approx(b[k]) for k in a if k[0] == cutoffs[0])
    assert any(a[k] != pytest.approx(b[k]) for k in a if k[0] == cutoffs[1])


def test_variants():
    assert "item_id" in models.feature_columns(*models.VARIANTS["con item_id"][:2])
    assert not set(models.PRICE) & set(models.feature_columns(*models.VARIANTS["sin precio"][:2]))
    assert not set(models.CALENDAR) & set(models.feature_columns(*models.VARIANTS["sin calendario"][:2]))
