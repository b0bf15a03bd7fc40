"""Safety stock, reorder points and lots from what a policy knows at each decision.

A series' backtest is 168 values, so it travels as arrays on one row per series, policy and lead time; scenarios
(method, service level, costs) are a small table crossed with these rows. The rows then go straight to the
simulator without another shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions.expr import let, lot_size, quantile_at, rolling_sums, sample_std, total, upper_level, whole_up, z_score
from stockweave.params import CLASSIC_WINDOW, EXTEND_CYCLE, HORIZON, N_EVAL, Costs
from stockweave.session import attach

CLASSIC = "Clásica (media móvil)"


def _leads(lead_times: Iterable[int]) -> list[int]:
    chosen = list(lead_times)
    if min(chosen) < 1:
        raise ValueError("a lead time is one day at least")
    return chosen


BASIS = "unique_id string, policy string, lead_time int, windows array<struct<mu: array<double>, daily: double, sigma: double, sigma_lead: double, errors: array<double>>>"


def _std(values: np.ndarray) -> np.ndarray:
    return values.std(axis=1, ddof=1) if values.shape[1] > 1 else np.full(len(values), np.nan)


def _packed(ids: pa.Array, names: pa.Array, lead: int, parts: list[tuple]) -> pa.RecordBatch:
    """parts: (mu, daily, sigma, errors) of each window, a row per series; interleaved to an array of structs a row."""
    n, k = len(ids), len(parts)

    def lists(arrays):
        """Lists of each row's values, window by window; lengths may differ between windows."""
        sizes = np.tile([a.shape[1] for a in arrays], n)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(arrays, axis=1).ravel()))

    flat = lambda arrays: pa.array(np.column_stack(arrays).ravel(), from_pandas=True)
    errors = [np.sort(p[3], axis=1) for p in parts]
    structs = pa.StructArray.from_arrays([lists([p[0] for p in parts]), flat([p[1] for p in parts]), flat([p[2] for p in parts]), flat([_std(e) for e in errors]), lists(errors)], ["mu", "daily", "sigma", "sigma_lead", "errors"])
    windows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), structs)
    return pa.RecordBatch.from_arrays([ids, names, pa.array(np.full(n, lead, np.int32)), windows], ["unique_id", "policy", "lead_time", "windows"])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(rows, -1)


def forecast_basis(cv: DataFrame, lead_times: Iterable[int], n_eval: int = N_EVAL, horizon: int = HORIZON) -> DataFrame:
    """unique_id, policy, lead_time, windows: one struct per evaluation window, oldest first.

    mu: demand expected in the lead time at offsets 0..horizon; daily: mean forecast; sigma, sigma_lead, errors: from
    the residuals of all earlier windows. The forecast is continued by repeating its last two weeks. One grouping
    gathers a series' windows (a few hundred values); the rest is a map over Arrow batches.
    """
    attach(cv.sparkSession)
    leads = _leads(lead_times)
    rows = cv.groupBy("unique_id", F.col("model").alias("policy")).agg(F.sort_array(F.collect_list(F.struct("ds", "y", "yhat"))).alias("r"))
    rows = rows.select("unique_id", "policy", F.col("r.y").alias("y"), F.col("r.yhat").alias("f"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y, f = (_matrix(b.column(c), b.num_rows) for c in ("y", "f"))
            e, n_windows = y - f, y.shape[1] // horizon
            for lead in leads:
                parts = []
                for g in range(n_windows - n_eval, n_windows):
                    own, past = f[:, g * horizon : (g + 1) * horizon], e[:, : g * horizon]
                    longer = np.concatenate([own, *[own[:, -EXTEND_CYCLE:]] * -(-lead // EXTEND_CYCLE)], axis=1)
                    mu = sliding_window_view(longer, lead, axis=1).sum(axis=2)[:, : horizon + 1]
                    sums = sliding_window_view(past.reshape(len(past), g, horizon), lead, axis=2).sum(axis=3)
                    parts.append((mu, own.mean(axis=1), _std(past), sums.reshape(len(past), -1)))
                yield _packed(b.column("unique_id"), b.column("policy"), lead, parts)

    return rows.mapInArrow(run, BASIS)


def classic_basis(panel: DataFrame, lead_times: Iterable[int], n_eval: int = N_EVAL, horizon: int = HORIZON, days: int = CLASSIC_WINDOW) -> DataFrame:
    """The same from the mean and the deviation of the days before each window."""
    attach(panel.sparkSession)
    leads = _leads(lead_times)
    end = F.broadcast(panel.agg(F.max("ds").alias("end_day")))  # one row
    recent = panel.crossJoin(end).where(f"ds > date_sub(end_day, {n_eval * horizon + days})")
    rows = recent.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("r")).select("unique_id", F.col("r.y").alias("h"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            h = _matrix(b.column("h"), b.num_rows)
            names = pa.array([CLASSIC] * b.num_rows)
            for lead in leads:
                parts = []
                for k in range(n_eval):
                    past = h[:, k * horizon : k * horizon + days]
                    mean = past.mean(axis=1)
                    sums = sliding_window_view(past, lead, axis=1).sum(axis=2) - (mean * lead)[:, None]
                    parts.append((np.repeat((mean * lead)[:, None], horizon + 1, axis=1), mean, _std(past), sums))
                yield _packed(b.column("unique_id"), names, lead, parts)

    return rows.mapInArrow(run, BASIS)


def scenarios(spark: SparkSession, methods: Iterable[str], levels: Iterable[float], clip: bool = True, costs: Iterable[Costs] = (Costs(),)) -> DataFrame:
    """A row per method, service level and cost pair: ss_method, service_level, z, clip, order_cost, holding_rate."""
    methods = list(methods)
    if unknown := set(methods) - {"sqrt", "acumulado", "empirico"}:
        raise ValueError(f"unknown method {sorted(unknown)}")
    rows = [(m, p, z_score(p), clip, c.order_cost, c.holding_rate_annual) for m in methods for p in levels for c in costs]
    return spark.createDataFrame(rows, "ss_method string, service_level double, z double, clip boolean, order_cost double, holding_rate double")


def safety_stock(sigma: Column, lead_time: Column, z: Column) -> Column:
    """z * sigma * sqrt(lead time), 0 at least; a negative lead time fails."""
    sound = F.when(lead_time < 0, F.raise_error(F.lit("a lead time is not negative")).cast("double")).otherwise(F.sqrt(lead_time))
    return F.greatest(z * sigma * sound, F.lit(0.0))


def window_stock(w: Column) -> Column:
    """Safety stock of a window by the row's method; the empirical quantile is never raised to 0."""
    floor = F.when(F.col("clip"), 0.0).otherwise(F.lit(float("-inf")))
    normal = F.when(F.col("ss_method") == "sqrt", F.col("z") * w["sigma"] * F.sqrt("lead_time")).otherwise(F.col("z") * w["sigma_lead"])
    empirical = quantile_at(w["errors"], upper_level(F.size(w["errors"]), F.col("service_level")))
    return F.when(F.col("ss_method") == "empirico", empirical).otherwise(F.greatest(normal, floor))


def decisions(basis: DataFrame, scenario: DataFrame, horizon: int = HORIZON, n_eval: int = N_EVAL) -> DataFrame:
    """unique_id, policy, lead_time, scenario columns, ss, rop, lot: arrays over the days and, in front, the first decision.

    basis carries price. The last window also owns its end.
    """
    lot = lambda w: lot_size(w["daily"], F.col("price"), order_cost=F.col("order_cost"), holding_rate=F.col("holding_rate"))
    rows = basis.crossJoin(F.broadcast(scenario))
    # once per window: its stock, lot, and the reorder points of all of its days
    plan = F.transform("windows", lambda w: let(window_stock(w), lambda s: F.struct(s.alias("ss"), lot(w).alias("lot"), F.transform(w["mu"], lambda m: whole_up(F.greatest(m + s, F.lit(0.0)))).alias("rop"))))
    rows = rows.withColumn("plan", plan)
    days = lambda k: F.when(k == n_eval - 1, horizon + 1).otherwise(horizon)
    spread = lambda f: F.flatten(F.transform("plan", f))
    return rows.select(
        "unique_id", "policy", "lead_time", "ss_method", "service_level", "order_cost", "holding_rate", "price",
        spread(lambda w, k: F.array_repeat(w["ss"], days(k))).alias("ss"),
        spread(lambda w, k: F.slice(w["rop"], F.lit(1), days(k))).alias("rop"),
        spread(lambda w, k: F.array_repeat(w["lot"], days(k))).alias("lot"),
    )


def evaluation_demand(panel: DataFrame, n_eval: int = N_EVAL, horizon: int = HORIZON) -> DataFrame:
    """unique_id, demand (array over the evaluation days), price (their mean)."""
    end = F.broadcast(panel.agg(F.max("ds").alias("end_day")))
    days = panel.crossJoin(end).where(f"ds > date_sub(end_day, {n_eval * horizon})")
    return days.groupBy("unique_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ds", "y"))), lambda x: x["y"]).alias("demand"), F.avg("sell_price").alias("price"))


def recommend(forecast: DataFrame, cv: DataFrame, scenario: DataFrame, lead_time: int) -> DataFrame:
    """Today's policy per series from the forecast of the days ahead (unique_id, ds, yhat, price: the first day's).

    Dispersion comes from all windows of the backtest cv (one model). Safety stock is rounded up before it enters the reorder point.
    """
    days = forecast.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("ds", "yhat"))).alias("d"), F.min_by("price", "ds").alias("price"))
    ahead = days.select("unique_id", "price", F.transform("d", lambda x: x["yhat"]).alias("f"))
    past = cv.groupBy("unique_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ds", "y", "yhat"))), lambda x: x["y"] - x["yhat"]).alias("e"))
    lead = F.lit(lead_time)
    n = (F.size("e") / HORIZON).cast("int")
    errors = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda w: rolling_sums(F.slice("e", w * HORIZON + 1, F.lit(HORIZON)), lead)))
    rows = ahead.join(past, "unique_id").withColumn("lead_time", lead).withColumn("w", F.struct(sample_std(F.col("e")).alias("sigma"), sample_std(errors).alias("sigma_lead"), F.sort_array(errors).alias("errors")))
    rows = rows.crossJoin(F.broadcast(scenario)).withColumns({"forecast_28d": total(F.col("f")), "forecast_daily": total(F.col("f")) / F.size("f"), "demand_lead_time": total(F.slice("f", 1, lead_time)), "safety_stock": whole_up(window_stock(F.col("w")))})
    rows = rows.withColumns({"rop": whole_up(F.greatest(F.col("demand_lead_time") + F.col("safety_stock"), F.lit(0.0))), "lot": lot_size(F.col("forecast_daily"), F.col("price"), order_cost=F.col("order_cost"), holding_rate=F.col("holding_rate"))})
    return rows.select("unique_id", "forecast_28d", "forecast_daily", "demand_lead_time", F.col("w.sigma").alias("sigma_error"), F.col("w.sigma_lead").alias("sigma_lead"), "price", "safety_stock", "rop", "lot", (F.col("rop") + F.col("lot")).alias("order_up_to"), "lead_time", "service_level", "ss_method")
