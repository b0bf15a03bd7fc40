"""Batch fits against naive filters, and on series whose models are known."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Observation

from stockweave.functions import fitters
from stockweave.operators import models
from stockweave.params import HORIZON


def naive_ets(y, family, start, weights, season=7):
    """Errors of one model, day by day, from the textbook equations."""
    error, trend, seasonal = family
    level, slope, add, mul = start
    slope = 0.0 if trend == "N" else slope
    cycle = list(mul if seasonal == "M" else add if seasonal == "A" else [0.0] * season)
    alpha, beta, gamma, phi = weights
    out, logs = [], 0.0
    for t, v in enumerate(y):
        s, base = cycle[t % season], level + phi * slope
        f = base * s if seasonal == "M" else base + s
        e = v - f
        out.append(e / f if error == "M" else e)
        logs += np.log(f) if error == "M" else 0.0
        by_level = e / s if seasonal == "M" else e
        level, slope = base + alpha * by_level, phi * slope + beta * by_level
        cycle[t % season] = s + gamma * (e / base if seasonal == "M" else e)
    return np.array(out) * np.exp(logs / len(y))


@pytest.mark.parametrize("family", fitters.FAMILIES)
def test_smoothing_errors(family):
    rng = np.random.default_rng(3)
    long, short = rng.uniform(5, 15, 80), rng.uniform(5, 15, 47)
    y, lengths = fitters.aligned([long, short])
    first = y.shape[1] - lengths
    starts = [fitters.ets_start(row, a) for row, a in zip(y, first.tolist(), strict=True)]
    kind = np.array([["AM".index(family[0]), ("N", "A", "Ad").index(family[1]), "NAM".index(family[2])]] * 2)
    x = np.array([[-1.0, -2.0, -1.5, 0.3], [0.5, -1.0, 0.2, -0.4]])
    got, _ = fitters.ets_filter(y, first, np.arange(2), kind, tuple(np.array([s[k] for s in starts]) for k in range(4)), x)
    weights = np.column_stack(fitters.ets_weights(x, kind[:, 1], kind[:, 2]))
    assert got[0] == pytest.approx(naive_ets(long, family, starts[0], weights[0]))
    turned = lambda s: np.roll(s, -int(first[1]))  # noqa: E731  days of the row to days of the series
    assert got[1, first[1] :] == pytest.approx(naive_ets(short, family, (starts[1][0], starts[1][1], turned(starts[1][2]), turned(starts[1][3])), weights[1]))
    assert (got[1, : first[1]] == 0).all()


def test_smoothing_recovers_weights_and_seasons():
    rng = np.random.default_rng(1)
    season, histories = np.array([4.0, -3, 2, 0, -1, -4, 2]), []
    for _ in range(12):
        level, y = 60.0, []
        for t in range(700):
            e = rng.normal(0, 1.5)
            y.append(level + season[t % 7] + e)
            level += 0.3 * e
        histories.append(np.array(y))
    fore, chosen = fitters.ets_forecasts(histories)
    assert all(c[2] in "AM" for c in chosen)
    assert np.median([c[3][0] for c in chosen]) == pytest.approx(0.3, abs=0.06)
    flat = np.array([f - season[(700 + np.arange(HORIZON)) % 7] for f in fore])
    assert np.median(np.abs(flat - flat.mean(axis=1, keepdims=True))) < 0.6
    plain = [rng.normal(50, 3, 400) for _ in range(8)]
    assert sum(c[1] == "N" for c in fitters.ets_forecasts(plain)[1]) >= 6


def test_a_trend_is_followed_and_demand_is_not_negative():
    t = np.arange(300)
    fore, chosen = fitters.ets_forecasts([100 + 0.5 * t, 160 - 0.5 * t + np.sin(t)])
    assert chosen[0][1] != "N" and fore[0] == pytest.approx(100 + 0.5 * (300 + np.arange(HORIZON)), rel=0.02)
    assert (fore[1] >= 0).all() and fore[1, -1] < 12


def test_unfittable_series_are_told():
    fine = np.random.default_rng(0).poisson(5, 90).astype(float)
    for fit in (fitters.ets_forecasts, fitters.sarima_forecasts):
        fore, chosen = fit([fine, fine[:10], np.append(fine, np.nan), np.zeros(100), fine[:0]])
        assert [c is None for c in chosen] == [False, True, True, False, True]
        assert np.isnan(fore[[1, 2, 4]]).all() and fore[3] == pytest.approx(0.0, abs=1e-6)


def _covariances(ar, ma, n):
    """Autocovariances of an ARMA process by a long moving average."""
    psi = np.zeros(3000)
    psi[0] = 1.0
    for k in range(1, len(psi)):
        psi[k] = (ma[k - 1] if k <= len(ma) else 0.0) + sum(ar[j] * psi[k - 1 - j] for j in range(min(len(ar), k)))
    return np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])


def test_likelihood_is_that_of_the_normal_distribution():
    rng = np.random.default_rng(8)
    x = np.zeros((3, sum(fitters.MOST) + 1))
    x[0, 0], x[0, 5], x[0, -1] = 0.6, -0.4, 1.5  # AR(1), MA(1), mean
    x[1, [0, 1]], x[1, 10] = (0.5, -0.3), 0.4  # AR(2), seasonal AR
    x[2, [5, 6]], x[2, 12] = (0.3, 0.2), -0.5  # MA(2), seasonal MA
    parts = [rng.normal(1, 2, n) for n in (60, 45, 60)]
    w, lengths = fitters.aligned(parts)
    squares, logs = fitters.likelihood(w, w.shape[1] - lengths, np.arange(3), x)
    ar, ma, c = fitters.polynomials(x)
    for k, part in enumerate(parts):
        n = len(part)
        gamma = _covariances(ar[k], ma[k], n)
        cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
        e = part - c[k]
        assert squares[k] == pytest.approx(e @ np.linalg.solve(cov, e), rel=1e-6)
        assert logs[k] == pytest.approx(np.linalg.slogdet(cov)[1], rel=1e-5, abs=1e-5)


def test_arma_errors_against_a_loop():
    rng = np.random.default_rng(2)
    x = np.arctanh(rng.uniform(-0.5, 0.5, (2, sum(fitters.MOST) + 1)))
    parts = [rng.normal(0, 1, n) for n in (120, 50)]
    w, lengths = fitters.aligned(parts)
    got = fitters.arma_errors(w, w.shape[1] - lengths, np.arange(2), x)
    ar, ma, c = fitters.polynomials(x)
    for k, part in enumerate(parts):
        v, e = part - c[k], []
        for t in range(len(v)):
            e.append(v[t] - sum(ar[k, j] * v[t - 1 - j] for j in range(19) if t > j) - sum(ma[k, j] * e[t - 1 - j] for j in range(19) if t > j))
        assert got[k, -len(part) :] == pytest.approx(e)


def test_orders_and_coefficients_of_simulated_series():
    rng = np.random.default_rng(4)
    one, two = [], []
    for _ in range(8):
        e = rng.normal(0, 1, 760)
        y = np.zeros(760)
        for t in range(7, 760):
            y[t] = 0.7 * y[t - 1] + e[t]
        one.append(30 + y[30:])
        z = e.copy()
        z[1:] += 0.6 * e[:-1]
        two.append(30 + z[30:])
    w, lengths = fitters.aligned(one + two)
    orders, x, _ = fitters.arma_search(w, lengths, np.ones(16, bool))
    ar, ma, c = fitters.polynomials(x)
    assert sum(o == (1, 0, 0, 0, 1) for o in orders[:8]) >= 4 and sum(o == (0, 1, 0, 0, 1) for o in orders[8:]) >= 4
    pure = [k for k in range(8) if orders[k] == (1, 0, 0, 0, 1)]
    assert ar[pure, 0] == pytest.approx(0.7, abs=0.09) and c == pytest.approx(30, abs=1.0)
    pure = [8 + k for k in range(8) if orders[8 + k] == (0, 1, 0, 0, 1)]
    assert ma[pure, 0] == pytest.approx(0.6, abs=0.09)


def test_differences():
    rng = np.random.default_rng(6)
    e = rng.normal(0, 1, 500)
    assert fitters.differences(20 + e) == (0, 0)
    assert fitters.differences(np.cumsum(e)) == (1, 0)
    assert fitters.differences(20 + e + 5 * np.sin(np.arange(500) * 2 * np.pi / 7))[1] == 1
    walk, _ = fitters.sarima_forecasts([100 + np.cumsum(e)])
    assert walk[0, 0] == pytest.approx(100 + e.sum(), abs=3)


def test_backtest_in_packs_counts_failed_fits(spark):
    rng = np.random.default_rng(5)
    start = dt.date(2023, 1, 1)
    rows = [(f"s{u}", start + dt.timedelta(k), float(rng.poisson(4 + u))) for u in range(5) for k in range(200)]
    rows += [("young", start + dt.timedelta(k), 3.0) for k in range(135, 200)]
    panel = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    for kind in models.FITTERS:
        counts = Observation(f"fits-{kind}")
        got = models.series_backtest(panel, kind, n_windows=2, counts=counts).collect()
        assert len(got) == 6 * 2 * HORIZON and {(r["unique_id"], r["window"]) for r in got if r["failed"]} == {("young", 1)}
        assert all(r["yhat"] == 3.0 for r in got if r["unique_id"] == "young")
        assert counts.get == {"fits": 12, "failed": 1}
        assert all(1 < r["yhat"] < 16 for r in got)
