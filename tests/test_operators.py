"""Closed-form values, invariants and look-ahead checks of the panel operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.functions import expr
from stockweave.functions.fitters import ets_forecasts, sarima_forecasts
from stockweave.operators import backtest, classify, features, intervals, policy, simulate
from stockweave.sources import panel as panels
from stockweave.sources import synthetic


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert expr.z_score(0.95) == pytest.approx(1.6449, abs=1e-4)
    with pytest.raises(ValueError):
        expr.z_score(1.0)
    assert value(spark, policy.safety_stock(F.lit(2.0), F.lit(9), F.lit(expr.z_score(0.95)))) == pytest.approx(9.869, abs=1e-3)
    with pytest.raises(Exception, match="not negative"):
        value(spark, policy.safety_stock(F.lit(2.0), F.lit(-1), F.lit(1.0)))
    assert value(spark, expr.eoq(F.lit(1000.0), F.lit(10.0), F.lit(2.0))) == 100
    assert [value(spark, expr.order_quantity(F.lit(p), F.lit(10.0), F.lit(20.0))) for p in (5.0, 10.0, 11.0)] == [25, 20, 0]


def test_conformal_levels(spark):
    e = F.array(*[F.lit(float(k)) for k in range(1, 20)])
    got = value(spark, expr.quantile_at(e, expr.conformal_level(F.size(e), 0.9)))
    assert got == pytest.approx(np.quantile(np.arange(1, 20), 18 / 19))
    short = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert [value(spark, expr.quantile_at(short, expr.conformal_level(F.size(short), q))) for q in (0.025, 0.975)] == [1, 3]


def test_interval_coverage(spark):
    rng = np.random.default_rng(3)
    rows = [(u, "m", float(50 + s * rng.normal()), 50.0) for u, s in (("a", 1), ("b", 5)) for _ in range(400)]
    cv = spark.createDataFrame(rows, "unique_id string, model string, y double, yhat double")
    met = intervals.add_intervals(cv, intervals.margins(cv)).where("level = 80").agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double"))).first()[0]
    assert met == pytest.approx(0.8, abs=0.02)


def test_abc_boundary(spark):
    rows = spark.createDataFrame([("a", 50.0), ("b", 35.0), ("c", 12.0), ("d", 3.0)], "unique_id string, revenue double")
    assert {r["unique_id"]: r["abc"] for r in classify.with_abc(rows).collect()} == {"a": "A", "b": "A", "c": "B", "d": "C"}
    assert {r["abc"] for r in classify.with_abc(rows.withColumn("revenue", F.lit(0.0))).collect()} == {"A"}


def daily(spark, series, days, y):
    start = dt.date(2024, 1, 1)
    rows = [(u, start + dt.timedelta(k), float(y(u, k)), u, "D", 2.0, "Fest" if k == 20 else None, "Local" if k == 20 else None) for u in series for k in range(days)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double, item_id string, dept_id string, sell_price double, event_name_1 string, event_type_1 string")


def test_dead_series(spark):
    p = daily(spark, ["dead", "steady"], 500, lambda u, k: 10 if u == "steady" else 0)
    got = {r["unique_id"]: r for r in classify.classify(p).collect()}
    assert got["dead"]["adi"] == float("inf") and got["dead"]["cv2"] == 0 and got["dead"]["segment"][1] == "Z" and got["dead"]["pattern"] == "intermitente"
    assert got["steady"]["segment"] == "AX" and got["steady"]["pattern"] == "suave"


def test_sparse_classes_equal_the_panels(spark):
    """Sales alone, in several lines a day, give the classes of the dense panel; rows that do not count change nothing."""
    rng = np.random.default_rng(5)
    names, end = [f"s{k}" for k in range(12)], dt.date(2024, 1, 1) + dt.timedelta(499)
    born = {u: 45 * k for k, u in enumerate(names)} | {"s10": 0, "s11": 498}  # some start inside the last 365 days
    sold = {(u, k): int(rng.integers(1, 40)) * int(rng.random() < (1 + i) / 13) for i, u in enumerate(names) for k in range(500)}
    sold |= {(u, born[u]): 5 for u in names} | {("s0", k): 0 for k in range(1, 500)} | {("s10", k): 20 for k in range(500)}  # s0 has stopped, s10 is steady
    p = daily(spark, names, 500, lambda u, k: sold[u, k]).where(" or ".join(f"(unique_id = '{u}' and ds >= date_add(date'2024-01-01', {k}))" for u, k in born.items()))
    lines = p.where("y > 0").select("unique_id", "ds", F.explode(F.array(F.lit(1.0), F.col("y") - 1)).alias("y")).where("y > 0").withColumn("revenue", F.col("y") * 2.0)
    odd = spark.createDataFrame([(None, end, 5.0, 1.0), ("s1", None, 5.0, 1.0), ("s1", end, None, 1.0), ("s1", end + dt.timedelta(1), 5.0, 1.0)], lines.schema)
    got, want = ({r["unique_id"]: r.asDict() for r in t.collect()} for t in (classify.classify_sparse(lines.unionByName(odd), end), classify.classify(p)))
    assert set(got) == set(want) == set(names) and {r["xyz"] for r in want.values()} == {"X", "Y", "Z"}
    for u, row in want.items():
        for c, v in row.items():
            if c == "price":
                assert got[u][c] == (v if row["units"] else None)
            else:
                assert got[u][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (u, c)
    assert classify.classify_sparse(lines.limit(0), end).count() == 0


def test_features_do_not_look_ahead(spark):
    p = daily(spark, ["a"], 90, lambda u, k: k % 5)
    changed = p.withColumn("y", F.when(F.col("ds") >= "2024-03-01", 99.0).otherwise(F.col("y")))
    a, b = ({r["ds"]: r for r in features.lag_features(x).collect()} for x in (p, changed))
    first = dt.date(2024, 3, 1)
    for d, row in a.items():
        same = all(row[c] == b[d][c] for c in features.AUTOREGRESSIVE)
        assert same if d < first + dt.timedelta(7) else True
    assert a[first + dt.timedelta(7)]["lag_7"] != b[first + dt.timedelta(7)]["lag_7"]
    days = {r["ds"].toordinal() - dt.date(2024, 1, 1).toordinal(): r["days_to_event"] for r in features.calendar_features(p).collect()}
    assert (days[20], days[17], days[0], days[21]) == (0, 3, 7, 7)


def by_hand(demand, rop, lot, lead):
    """One series, day by day, as the policy is stated: a list of (arrival day, quantity) orders."""
    stock, orders, short = rop[0] + lot[0], [], False
    out = dict.fromkeys(simulate.TOTALS, 0.0)
    for day, wanted in enumerate(demand):
        arrived = sum(q for when, q in orders if when == day)
        stock += arrived
        if arrived:
            out["cycles"] += 1
            out["stockout_cycles"] += short
            short = False
        sold = min(stock, wanted)
        stock -= sold
        short |= wanted > sold
        position = stock + sum(q for when, q in orders if when > day)
        if position <= rop[day + 1]:
            q = float(np.ceil(rop[day + 1] + lot[day + 1] - position))
            orders.append((day + lead, q))
            out["n_orders"] += q > 0
        for k, v in (("sales", sold), ("lost", wanted - sold), ("stock_sum", stock), ("lost_days", wanted > sold)):
            out[k] += v
    return out


def test_simulation(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{k}", lead, rng.poisson(3, 60).astype(float).tolist(), rng.integers(2, 30, 61).astype(float).tolist(), rng.integers(1, 24, 61).astype(float).tolist(), [0.0] * 61) for k in range(6) for lead in (1, 3, 7, 14)]
    rows += [("still", 5, [0.0] * 60, [5.0] * 61, [3.0] * 61, [0.0] * 61), ("short", 3, [10.0] * 60, [0.0] * 61, [1.0] * 61, [0.0] * 61)]
    schema = "unique_id string, lead_time int, demand array<double>, rop array<double>, lot array<double>, ss array<double>"
    got = {(r["unique_id"], r["lead_time"]): r for r in simulate.simulate(spark.createDataFrame(rows, schema)).collect()}
    for u, lead, demand, rop, lot, _ in rows:
        want = by_hand(demand, rop, lot, lead)
        assert {k: got[u, lead][k] for k in simulate.TOTALS} == want
        assert want["sales"] + want["lost"] == sum(demand)
    assert got["still", 5]["stock_sum"] == 8 * 60 and got["short", 3]["cycles"] == got["short", 3]["stockout_cycles"] > 0
    with pytest.raises(Exception, match="one day at least"):
        simulate.simulate(spark.createDataFrame([("x", 0, *rows[0][2:])], schema)).collect()


def test_inventory_at_fill(spark):
    rows = [("p", "sqrt", 7, "Total", f, v) for f, v in ((0.8, 100.0), (0.9, 200.0), (0.98, 400.0))]
    curve = spark.createDataFrame(rows, "policy string, ss_method string, lead_time int, group string, fill_rate double, avg_inv_value double")
    got = {r["target_fill_rate"]: r["avg_inv_value"] for r in simulate.inventory_at_fill(curve, (0.94, 0.995, 0.9)).collect()}
    assert got[0.94] == pytest.approx(300) and got[0.995] is None and got[0.9] == 200


def test_raw_layout(spark, tmp_path):
    folder = f"{tmp_path}/raw"
    synthetic.generate(spark, folder, 8, 420)
    sales, calendar, prices = panels.read_raw(spark, folder, 420)
    assert calendar.count() == 448 and calendar.where("event_name_1 is not null").count() > 0 and calendar.agg(F.min("date")).first()[0] == synthetic.START
    panel = panels.build_long(sales, calendar, prices, "CA_1", "FOODS").cache()
    counts = {r["unique_id"]: r["count"] for r in panel.groupBy("unique_id").count().collect()}
    assert len(counts) == 6 and set(counts.values()) == {420}  # the two late ones are too short
    days = calendar.select(F.col("date").alias("ds"), "wm_yr_wk", "event_name_1", "event_type_1")
    ahead = panels.build_future(panel, days, prices.select(F.concat_ws("_", "item_id", "store_id").alias("unique_id"), "wm_yr_wk", "sell_price"))
    assert ahead.count() == 6 * 28 and ahead.where("sell_price is null").count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        synthetic.generate(spark, folder, 8, 420)
    assert panel.agg(F.min("y"), F.max("y")).first()[0] >= 0 and panel.where("sell_price <= 0").count() == 0
    # known and last prices ahead, every kind of series kept without the filter
    known = prices.select(F.concat_ws("_", "item_id", "store_id").alias("unique_id"), "wm_yr_wk", "sell_price").where("wm_yr_wk < 11162")
    last = panels.build_future(panel, days, known).where("wm_yr_wk >= 11162").select("unique_id", "sell_price").distinct()
    assert last.count() == 6
    late = panels.build_long(sales, calendar, prices, "CA_1", "FOODS", 1).groupBy("unique_id").count().collect()
    assert sorted(r["count"] for r in late)[:2] == [182, 210]


def test_poisson_draws(spark):
    for mean in (0.3, 3.0, 20.0):
        got = spark.range(4000).select(synthetic.poisson(F.lit(mean), 1, F.col("id")).alias("y")).agg(F.avg("y"), F.variance("y"), F.min("y")).first()
        assert got[0] == pytest.approx(mean, rel=0.1) and got[1] == pytest.approx(mean, rel=0.15) and got[2] >= 0


def ets_forecast(y):
    return ets_forecasts([y])[0][0]


def sarima_forecast(y):
    return sarima_forecasts([y])[0][0]


def test_fitters():
    week = np.tile([1.0, 2, 3, 4, 5, 6, 7], 30)
    assert np.abs(ets_forecast(week) - week[:28]).max() < 0.5 and np.abs(sarima_forecast(week) - week[:28]).max() < 0.5
    days = np.arange(400.0)
    for f in (ets_forecast, sarima_forecast):  # a trend, and a season that grows with it
        assert np.abs(f(5 + 0.1 * days) - (5 + 0.1 * (400 + np.arange(28)))).max() < 2.0
        assert np.isnan(f(np.zeros(3))).all() and (f(np.zeros(100)) == 0).all() and len(f(np.array([]))) == 28
        noise = f(np.random.default_rng(1).poisson(4, 300).astype(float))
        assert np.abs(noise - 4).max() < 2.5 and (noise >= 0).all()
    rng = np.random.default_rng(2)
    y = [10.0, 10.0]
    for _ in range(600):
        y.append(2 + 0.8 * y[-1] + rng.normal())
    assert abs(sarima_forecast(np.array(y))[-1] - 10) < 2.5


def test_fallback_and_forms_of_a_backtest(spark):
    rows = [("a", dt.date(2024, 1, k), dt.date(2024, 1, 1), m, 1.0, v) for k in (2, 3) for m, v in (("m1", None if k == 2 else 5.0), ("m2", 7.0))]
    cv = spark.createDataFrame(rows, "unique_id string, ds date, cutoff date, model string, y double, yhat double")
    mended = backtest.with_fallback(cv.where("model = 'm1'"), cv.where("model = 'm2'"))
    assert sorted(r["yhat"] for r in mended.collect()) == [5.0, 7.0]
    back = backtest.to_long(backtest.to_wide(cv, ["m1", "m2"]), ["m1", "m2"])
    assert sorted(map(str, back.select(*cv.columns).collect())) == sorted(map(str, cv.collect()))


def test_complete_models(spark):
    rows = [("a", 1, "x", 1.0), ("b", 1, "x", None), ("a", 1, "y", 1.0), ("b", 1, "y", 2.0)]
    cv = spark.createDataFrame(rows, "unique_id string, cutoff int, model string, yhat double")
    assert {r["model"] for r in backtest.complete_models(cv).collect()} == {"y"}
