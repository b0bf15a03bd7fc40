"""The query catalogue over order lines as a demand panel: name -> query, and name -> the SQL of the same result.

Doubles are rounded at the very end (MONEY to 2 digits, all else to 6), so that sums in another order agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockweave import params
from stockweave.operators import backtest, classify, eda, features, intervals, metrics, models, policy, simulate
from stockweave.operators.ranks import quantiles
from stockweave.plans import outputs, report
from stockweave.plans.oracles import MONEY, ORACLES  # noqa: F401
from stockweave.session import materialize, shuffle_partitions, side_by_side, work_dir
from stockweave.sources import panel as panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(c: str, digits: int) -> Column:
    """Half away from zero, in binary arithmetic as SQL engines round doubles: a tie falls the same way in both."""
    return F.round(F.col(c) * 10.0**digits) / 10.0**digits


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c, 2 if c in MONEY else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(f(panels.demand_panel(spark, sf_dir)))

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    QUERIES[f.__name__] = run
    return f


def shared(f):
    """A query that reads the panel several times: it is written once and read back."""
    return query(wraps(f)(lambda p: f(materialize(p, "panel"))))


# ---- panel and exploration


@query
def sales_long(p):
    return p


@query
def panel_overview(p):
    return eda.overview(p)


@query
def weekly_demand(p):
    return eda.weekly_demand(p)


@query
def closed_days(p):
    return eda.closed_days(p)


@query
def quiet_days(p):
    """Days below half of the median day."""
    return eda.closed_days(p, 0.5)


@query
def dow_index(p):
    return eda.weekday_index(p)


@query
def snap_lift(p):
    return eda.snap_lift(p)


@query
def event_profile(p):
    return eda.event_profile(p)


@query
def price_response(p):
    return eda.price_response(p)


def _wide(p: DataFrame) -> DataFrame:
    """A month per row, a day of the month per column."""
    days = p.select("unique_id", F.trunc("ds", "month").alias("month"), F.dayofmonth("ds").alias("day"), F.col("y").cast("int").alias("y"))
    wide = days.groupBy("unique_id", "month").pivot("day", list(range(1, 32))).agg(F.first("y"))
    return wide.withColumnsRenamed({str(k): f"d_{k}" for k in range(1, 32)})


@query
def wide_unpivot(p):
    long = panels.wide_to_long(_wide(p), ["unique_id", "month"])
    return long.groupBy("d").agg(F.count("*").alias("n"), F.sum("y").alias("units"))


@query
def unpivot_price_join(p):
    prices = p.select("unique_id", F.trunc("ds", "month").alias("month"), "sell_price").groupBy("unique_id", "month").agg(F.min("sell_price").alias("sell_price"))
    priced = panels.wide_to_long(_wide(p), ["unique_id", "month"]).join(prices, ["unique_id", "month"], "left").where("sell_price is not null")
    return priced.groupBy("unique_id").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("sell_price")).alias("revenue"))


@query
def future_exog(p):
    last = p.agg(F.max("ds").alias("last"))  # one row
    ahead = last.select(F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", 60))).alias("ds")).withColumns(panels.calendar_columns(F.col("ds")))
    known = p.groupBy("unique_id", "wm_yr_wk").agg(F.max("sell_price").alias("sell_price"))
    return panels.build_future(p, ahead, known)


@shared
def min_history_filter(p):
    """Series with as many days as the longest one."""
    longest = p.groupBy("unique_id").count().agg(F.max("count")).first()[0] or 0
    return panels.with_min_history(p, longest).groupBy("unique_id").agg(F.count("*").alias("n"))


@shared
def raw_round_trip(p):
    """The panel written as raw CSV files in the wide layout, read back, checked and made long again, by series."""
    folder = f"{work_dir(p.sparkSession)}/raw-{uuid.uuid4().hex}"
    n_days = panels.write_raw(p, folder, "CA_1", "FOODS")
    sales, calendar, prices, rejected = panels.read_raw_checked(p.sparkSession, folder, n_days)
    back = panels.build_long(sales, calendar, prices, "CA_1", "FOODS", 1)
    series = back.groupBy(F.col("item_id").alias("unique_id"), "dept_id").agg(F.count("*").alias("n_days"), F.sum("y").alias("units"), F.sum(F.col("y") * F.col("sell_price")).alias("revenue"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.count("event_name_1").alias("event_days"), F.sum("snap").cast("long").alias("snap_days"))
    return series.crossJoin(F.broadcast(rejected.agg(F.count("*").alias("rejected_lines"))))  # one row


# ---- classes


@query
def sku_classes(p):
    return classify.classify(p)


@query
def abc_summary(p):
    return classify.classify(p).groupBy("abc").agg(F.count("*").alias("n_skus"), F.sum("revenue_share").alias("revenue_share"))


@query
def xyz_matrix_cube(p):
    return classify.class_matrix(classify.classify(p))


def by_part(f):
    """A query over the classes of parts, from the order lines without a panel."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        classes = classify.classify_sparse(panels.part_sales(spark, sf_dir), panels.panel_end(spark, sf_dir))
        money = {c: F.col(c) / 10_000 for c in ("revenue", "price")}
        return tidy(f(classes.withColumns(money)))

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    QUERIES[f.__name__] = run
    return f


@by_part
def part_classes(c):
    """Every part's measures and classes: intermittent series, as many as there are parts."""
    return c


@by_part
def part_class_matrix(c):
    return classify.class_matrix(c)


@by_part
def part_patterns(c):
    return c.groupBy("pattern", "abc").agg(F.count("*").alias("n_skus"), F.sum("units").alias("units"), F.avg("zero_share").alias("zero_share"))


@query
def demand_pattern_counts(p):
    return classify.classify(p).groupBy("pattern").agg(F.count("*").alias("n_skus"), F.sum("units").alias("units"))


@query
def pareto_curve(p):
    return classify.pareto(classify.classify(p))


@query
def revenue_matrix(p):
    return eda.revenue_matrix(classify.classify(p))


# ---- features


@query
def calendar_features(p):
    return features.calendar_features(p).select("unique_id", "ds", "is_event", "event_name", "event_type", "days_to_event")


@query
def price_features(p):
    return features.price_features(p).select("unique_id", "ds", "price_rel_item", "price_rel_dept", "price_change_7")


@query
def lag_features(p):
    return features.lag_features(p).select("unique_id", "ds", *[f"lag_{k}" for k in params.LAGS])


@query
def rolling_features(p):
    return features.lag_features(p).select("unique_id", "ds", *[n for n, *_ in params.ROLLING])


@query
def date_features(p):
    return features.date_parts(p.select("ds").distinct())


# ---- backtest and metrics


def _cv(p: DataFrame) -> DataFrame:
    return backtest.simple_forecasts(p).join(p.groupBy("unique_id").agg(F.first("dept_id").alias("dept_id")), "unique_id")


def _classes(p: DataFrame) -> DataFrame:
    """Classes as of the evaluation's start, with dept_id."""
    return classify.classify(p, before_evaluation=True).join(p.groupBy("unique_id").agg(F.first("dept_id").alias("dept_id")), "unique_id")


@query
def cv_cutoffs(p):
    return backtest.cutoffs(p)


@query
def cv_long_union(p):
    return backtest.simple_forecasts(p).select("unique_id", "ds", "cutoff", "model", "y", "yhat")


@query
def fc_naive(p):
    return backtest.simple_forecasts(p).where(F.col("model") == backtest.NAIVE).select("unique_id", "ds", "yhat")


@query
def fc_seasonal_naive(p):
    return backtest.simple_forecasts(p).where(F.col("model") == backtest.SEASONAL).select("unique_id", "ds", "yhat")


@query
def fc_window_average(p):
    return backtest.simple_forecasts(p).where(F.col("model") == backtest.AVERAGE).select("unique_id", "ds", "yhat")


@query
def cv_full_outer(p):
    """A model of all windows beside one of the newest four: days that only one side has stay, with nulls."""
    cv = backtest.simple_forecasts(p)
    side = lambda name, rows: rows.where(F.col("model") == name).select(*backtest.KEYS, F.col("y").alias(f"y_{name}"), F.col("yhat").alias(name))
    one, two = side(backtest.SEASONAL, cv.where("window > 0")), side(backtest.AVERAGE, cv.where("window < 4"))
    both = one.join(two, backtest.KEYS, "full_outer")
    return both.select(*backtest.KEYS, F.coalesce(f"y_{backtest.SEASONAL}", f"y_{backtest.AVERAGE}").alias("y"), backtest.SEASONAL, backtest.AVERAGE)


@query
def cv_wide_to_long(p):
    """Models as columns, and back to rows: nulls of a model stay rows."""
    names = [backtest.NAIVE, backtest.SEASONAL, backtest.AVERAGE]
    return backtest.to_long(backtest.to_wide(backtest.simple_forecasts(p), names), names)


@query
def point_metrics(p):
    return metrics.point_metrics(backtest.simple_forecasts(p), "cutoff", "model")


@query
def naive_scale(p):
    return metrics.scales(p, backtest.cutoffs(p))


@shared
def rmsse_by_level(p):
    return metrics.rmsse_by_level(p, _cv(p), backtest.cutoffs(p))


@shared
def wrmsse(p):
    return metrics.evaluate(p, _cv(p), backtest.cutoffs(p))[0]


@shared
def wrmsse_report(p):
    """Cutoffs by model, with the mean over cutoffs in the row of a null cutoff."""
    rows = metrics.evaluate(p, _cv(p), backtest.cutoffs(p))[0].where("level = 'WRMSSE'")
    with_mean = rows.select("model", "value", F.explode(F.array(F.col("cutoff"), F.lit(None).cast("date"))).alias("cutoff"))
    return with_mean.groupBy("cutoff").pivot("model", [backtest.NAIVE, backtest.SEASONAL, backtest.AVERAGE]).agg(F.avg("value"))


@shared
def model_wins(p):
    return metrics.wins_everywhere(metrics.evaluate(p, _cv(p), backtest.cutoffs(p))[0])


@shared
def sku_metrics(p):
    return metrics.evaluate(p, _cv(p), backtest.cutoffs(p))[1]


def _segments(p):
    return metrics.segment_table(metrics.evaluate(p, _cv(p), backtest.cutoffs(p))[1], _classes(p))


@shared
def segment_table(p):
    return _segments(p)


@shared
def best_model_by_segment(p):
    return metrics.best_model(_segments(p))


@query
def horizon_error(p):
    return metrics.horizon_error(backtest.simple_forecasts(p))


@query
def weekly_horizon_error(p):
    """Mean wape of the steps of each week ahead."""
    return metrics.horizon_error(backtest.simple_forecasts(p)).groupBy(F.floor((F.col("step") - 1) / 7 + 1).cast("int").alias("week"), "model").agg(F.avg("wape").alias("wape"))


def _versus_best(segments: DataFrame, model: str) -> DataFrame:
    """A model's wape against the best of the others in each group."""
    other = F.col("model") != model
    rows = segments.where("split = 'eval'").groupBy("grouping", "group").agg(
        F.max("n_skus").alias("n_skus"), F.max(F.when(~other, F.col("wape"))).alias("wape_model"), F.min_by("model", F.when(other, F.struct("wape", "model"))).alias("best_other"), F.min(F.when(other, F.col("wape"))).alias("wape_other")
    )
    return rows.withColumn("difference", F.col("wape_model") / F.nullif(F.col("wape_other"), F.lit(0.0)) - 1.0)


@shared
def versus_best(p):
    return _versus_best(_segments(p), backtest.AVERAGE)


@query
def recent_days(p):
    """The last days of the evaluation of every series."""
    newest = Window.partitionBy("unique_id").orderBy(F.desc("ds"))
    return p.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= params.N_EVAL * params.HORIZON).select("unique_id", "ds", "y", "sell_price")


@query
def dept_day_totals(p):
    """Demand and forecasts of the evaluation by department and day, and in total."""
    return report.real_and_forecast(_cv(p))


@query
def model_inputs(p):
    """History and the days ahead in one frame of features, and how far they go."""
    history, ahead = features.model_frames(p, outputs.with_future(p))
    marked = history.select("unique_id", "ds", "is_event", "days_to_event", "price_rel_item", "price_rel_dept", "price_change_7", F.lit("history").alias("part")).unionByName(ahead.select("unique_id", "ds", "is_event", "days_to_event", "price_rel_item", "price_rel_dept", "price_change_7", F.lit("future").alias("part")))
    return marked.where(F.col("ds") > F.date_sub(F.lit(p.agg(F.max("ds")).first()[0]), 28))


# ---- intervals


@query
def conformal_margins(p):
    return intervals.margins(backtest.simple_forecasts(p))


@query
def forecast_intervals(p):
    cv = backtest.simple_forecasts(p)
    newest = cv.where("window = 0").select("unique_id", "ds", "model", "yhat")
    return intervals.add_intervals(newest, intervals.margins(cv.where("window > 0")))


@shared
def interval_coverage(p):
    cv = backtest.simple_forecasts(p)
    calib, held = cv.where(backtest.split_of(F.col("window")) == "calib"), cv.where(backtest.split_of(F.col("window")) == "eval")
    return intervals.coverage(intervals.add_intervals(held, intervals.margins(calib)), _classes(p))


# ---- inventory


def _basis(p: DataFrame, lead_times) -> DataFrame:
    cv = backtest.simple_forecasts(p).where(F.col("model") != backtest.NAIVE)
    return policy.forecast_basis(cv, lead_times).unionByName(policy.classic_basis(p, lead_times))


def _flat(basis: DataFrame) -> DataFrame:
    w = basis.select("unique_id", "policy", "lead_time", F.posexplode("windows").alias("w", "x"))
    return w.select("unique_id", "policy", "lead_time", "w", F.get("x.mu", F.lit(0)).alias("mu_first"), F.get("x.mu", F.lit(28)).alias("mu_last"), "x.daily", "x.sigma", "x.sigma_lead", F.size("x.errors").cast("long").alias("n_errors"))


@query
def classic_basis(p):
    return _flat(policy.classic_basis(p, params.LEAD_TIMES))


@query
def forecast_basis(p):
    return _flat(policy.forecast_basis(backtest.simple_forecasts(p).where(F.col("model") != backtest.NAIVE), params.LEAD_TIMES))


def _decided(p, lead_times, scenario) -> DataFrame:
    sold = policy.evaluation_demand(p)
    return policy.decisions(_basis(p, lead_times).join(sold.select("unique_id", "price"), "unique_id"), scenario).join(sold.select("unique_id", "demand"), "unique_id")


def _default(p):
    return policy.scenarios(p.sparkSession, [params.DEFAULT_METHOD], [params.DEFAULT_LEVEL])


@shared
def safety_stock_methods(p):
    rows = policy.decisions(_basis(p, [params.DEFAULT_LEAD]).join(policy.evaluation_demand(p), "unique_id"), policy.scenarios(p.sparkSession, params.SS_METHODS, params.SERVICE_LEVELS))
    return rows.select("unique_id", "policy", "ss_method", "service_level", F.get("ss", F.lit(0)).alias("ss_first"), F.element_at("ss", -1).alias("ss_last"))


@shared
def rop_eoq_lot(p):
    rows = _decided(p, params.LEAD_TIMES, _default(p)).select("unique_id", "policy", "lead_time", F.posexplode(F.arrays_zip("rop", "lot")).alias("d", "x"))
    return rows.select("unique_id", "policy", "lead_time", "d", "x.rop", "x.lot")


def _grid(p, lead_times, scenario) -> DataFrame:
    return simulate.by_sku(simulate.simulate(_decided(p, lead_times, scenario)))


@shared
def sim_single(p):
    return _grid(p, [params.DEFAULT_LEAD], _default(p)).drop("order_cost", "holding_rate", "lost_days", "days")


@shared
def sim_kpis_by_class(p):
    return simulate.kpis(_grid(p, [params.DEFAULT_LEAD], _default(p)), _classes(p)).drop("order_cost", "holding_rate")


def _full_grid(p):
    """Policies x lead times x methods x service levels."""
    return simulate.kpis(_grid(p, params.LEAD_TIMES, policy.scenarios(p.sparkSession, params.SS_METHODS, params.SERVICE_LEVELS)), _classes(p)).drop("order_cost", "holding_rate")


@shared
def scenario_grid(p):
    return _full_grid(p)


@shared
def scenario_report(p):
    """Inventory value of the Total group: lead time by policy, at the default level and method."""
    rows = _full_grid(p).where((F.col("group") == "Total") & (F.col("service_level") == params.DEFAULT_LEVEL))
    return rows.groupBy("lead_time", "ss_method").pivot("policy", [policy.CLASSIC, backtest.SEASONAL, backtest.AVERAGE]).agg(F.first("avg_inv_value")).withColumnRenamed(policy.CLASSIC, "Clasica")


def _frontier(p, lead_times=params.LEAD_TIMES):
    """Unclipped stock over the frontier's levels."""
    return simulate.kpis(_grid(p, lead_times, policy.scenarios(p.sparkSession, ["sqrt"], params.FRONTIER_LEVELS, clip=False)), _classes(p)).drop("order_cost", "holding_rate")


@shared
def frontier(p):
    return _frontier(p).select("policy", "ss_method", "lead_time", "service_level", "group", "fill_rate", "avg_inv_value")


@shared
def inventory_at_fill(p):
    return simulate.inventory_at_fill(_frontier(p), params.FILL_TARGETS)


@shared
def cost_sensitivity(p):
    return _cost_sensitivity(p)


def _cost_sensitivity(p) -> DataFrame:
    """Inventory of the classic and the average policy at 95 % fill, over order costs and holding rates."""
    costs = [params.Costs(order_cost=k, holding_rate_annual=h) for k in params.ORDER_COSTS for h in params.HOLDING_RATES]
    curve = simulate.kpis(_grid(p, [params.DEFAULT_LEAD], policy.scenarios(p.sparkSession, ["sqrt"], params.FRONTIER_LEVELS, False, costs)), _classes(p)).where("group = 'Total'")
    need = simulate.inventory_at_fill(curve, (params.DEFAULT_LEVEL,), ("policy", "order_cost", "holding_rate"))
    value = lambda name: F.max(F.when(F.col("policy") == name, F.col("avg_inv_value")))
    return need.groupBy("order_cost", "holding_rate").agg(value(policy.CLASSIC).alias("inv_classic"), value(backtest.AVERAGE).alias("inv_average")).withColumn("reduction", F.col("inv_average") / F.nullif(F.col("inv_classic"), F.lit(0.0)) - 1.0)


@shared
def cost_pivot(p):
    """What the average policy saves against the classic one: holding rates by order costs."""
    rows = _cost_sensitivity(p).groupBy("holding_rate").pivot("order_cost", list(params.ORDER_COSTS)).agg(F.first("reduction"))
    return rows.withColumnsRenamed({str(c): f"order_{c:g}".replace(".", "_") for c in params.ORDER_COSTS})


@query
def recommendation(p):
    """From the mean of the last 28 days as forecast of the next 28."""
    cv = backtest.simple_forecasts(p).where(F.col("model") == backtest.AVERAGE)
    return policy.recommend(_ahead(p), cv, _default(p), params.DEFAULT_LEAD)


@shared
def missing_target(p):
    """Per policy and pattern: share of products below their target fill rate, by the default scenario."""
    rows = materialize(_grid(p, [params.DEFAULT_LEAD], _default(p)).join(_classes(p).select("unique_id", "pattern"), "unique_id").where("fill_rate is not null"), "filled")
    shares = rows.groupBy("policy", "pattern").agg(F.count("*").alias("n_skus"), F.avg((F.col("fill_rate") < F.col("service_level")).cast("double")).alias("missing_share"), F.avg("demand").alias("mean_demand"))
    return shares.join(quantiles(rows, "fill_rate", {"median_fill": 0.5}, ["policy", "pattern"]), ["policy", "pattern"])


@shared
def missing_by_class(p):
    rows = materialize(_grid(p, [params.DEFAULT_LEAD], _default(p)).join(_classes(p).select("unique_id", "abc"), "unique_id").where("fill_rate is not null"), "filled")
    shares = rows.groupBy("policy", "abc").agg(F.count("*").alias("n_skus"), F.avg((F.col("fill_rate") >= F.col("service_level")).cast("double")).alias("meeting_share"))
    return shares.join(quantiles(rows, "fill_rate", {"fill_p10": 0.1}, ["policy", "abc"]), ["policy", "abc"])


def _savings(need: DataFrame, names: list[str], model: str) -> DataFrame:
    """Inventory by target and lead time, a column a policy, and what the model's policy saves against the classic one."""
    rows = need.where("group = 'Total' and ss_method = 'sqrt'").groupBy("target_fill_rate", "lead_time").pivot("policy", [policy.CLASSIC, *names]).agg(F.first("avg_inv_value")).withColumnRenamed(policy.CLASSIC, "Clasica")
    return rows.withColumn("saving", F.col(model) / F.nullif(F.col("Clasica"), F.lit(0.0)) - 1.0)


@shared
def savings_by_target(p):
    return _savings(simulate.inventory_at_fill(_frontier(p), params.FILL_TARGETS), [backtest.SEASONAL, backtest.AVERAGE], backtest.AVERAGE)


@shared
def service_curve(p):
    """Fill rate and inventory of one policy's curve, in order."""
    rows = _frontier(p, [params.DEFAULT_LEAD]).where((F.col("policy") == backtest.AVERAGE) & (F.col("group") == "Total") & (F.col("ss_method") == "sqrt"))
    return rows.select("service_level", "fill_rate", "cycle_service", "avg_inv_value").orderBy("avg_inv_value")


@shared
def method_comparison(p):
    """Per policy and method: cycle service reached at the default level, and inventory for that fill rate."""
    levels = policy.scenarios(p.sparkSession, params.SS_METHODS, params.FRONTIER_LEVELS, clip=False)
    curve = materialize(simulate.kpis(_grid(p, [params.DEFAULT_LEAD], levels), _classes(p)).where("group = 'Total'"), "curve")
    need = simulate.inventory_at_fill(curve, (params.DEFAULT_LEVEL,)).select("policy", "ss_method", "avg_inv_value")
    return curve.where(F.col("service_level") == params.DEFAULT_LEVEL).select("policy", "ss_method", "cycle_service").join(need, ["policy", "ss_method"], "left")


@shared
def nominal_service(p):
    """Cycle service reached at each nominal level, a column a method."""
    rows = simulate.kpis(_grid(p, [params.DEFAULT_LEAD], policy.scenarios(p.sparkSession, params.SS_METHODS, params.SERVICE_LEVELS)), _classes(p))
    return rows.where((F.col("group") == "Total") & (F.col("policy") == backtest.AVERAGE)).groupBy("service_level").pivot("ss_method", list(params.SS_METHODS)).agg(F.first("cycle_service"))


def _ahead(p) -> DataFrame:
    """The mean of the last 28 days as forecast of the next 28, at the last price."""
    last = F.broadcast(p.agg(F.max("ds").alias("end_day")))
    base = p.crossJoin(last).where("ds > date_sub(end_day, 28)").groupBy("unique_id", "end_day").agg(F.avg("y").alias("yhat"), F.max_by("sell_price", "ds").alias("price"))
    return base.select("unique_id", F.explode(F.sequence(F.date_add("end_day", 1), F.date_add("end_day", 28))).alias("ds"), "yhat", "price")


@shared
def planner_table(p):
    """The ten series with the greatest forecast, with classes and policy."""
    cv = backtest.simple_forecasts(p).where(F.col("model") == backtest.AVERAGE)
    rows = outputs.recommendation(p, _ahead(p), cv, _default(p), params.DEFAULT_LEAD)
    return rows.orderBy(F.desc("forecast_28d"), "unique_id").limit(10).select("unique_id", "item_id", "dept_id", "abc", "xyz", "segment", "pattern", "forecast_28d", "demand_lead_time", "safety_stock", "rop", "lot", "order_up_to")


@shared
def stock_value_by_segment(p):
    """The value of safety stock by scenario, segment and department."""
    cv = backtest.simple_forecasts(p).where(F.col("model") == backtest.AVERAGE)
    return report.stock_value(p, _classes(p), report.recommendations(p.sparkSession, _ahead(p), cv))


@query
def top_products(p):
    """The ten series with the greatest revenue, and when they were last sold."""
    sold = p.groupBy("unique_id").agg(F.date_format(F.max(F.when(F.col("y") > 0, F.col("ds"))), "yyyy-MM-dd").alias("last_sale"), F.date_format(F.min("ds"), "yyyy-MM").alias("first_month"))
    return classify.classify(p).select("unique_id", "revenue", "segment").join(sold, "unique_id").orderBy(F.desc("revenue"), "unique_id").limit(10)


@query
def report_columns(p):
    """One row per department: series in order with their rounded revenue, as arrays."""
    rows = classify.classify(p).join(p.groupBy("unique_id").agg(F.first("dept_id").alias("dept_id")), "unique_id")
    packed = rows.groupBy("dept_id").agg(F.sort_array(F.collect_list(F.struct("unique_id", rounded("revenue", 2).alias("revenue")))).alias("r"))
    return packed.select("dept_id", F.to_json(F.struct(F.col("r.unique_id").alias("id"), F.col("r.revenue").cast("array<long>").alias("revenue"))).alias("document"))


# ---- fitted models: no SQL states these


def boosted(f):
    """A query on the panel and the stored tables of the boosted model, which is fitted once an application and source."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = lambda: materialize(panels.demand_panel(spark, sf_dir), "panel")
        p = outputs.stored(spark, sf_dir, "panel", lambda: {"panel": panel()})

        def table(name: str) -> DataFrame:
            make = (lambda: {"ablation": models.ablation(p, **params.CATALOGUE_TREES)}) if name == "ablation" else (lambda: outputs.boosted(p, **params.CATALOGUE_TREES))
            return outputs.stored(spark, sf_dir, name, make)

        return tidy(f(p, table))

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    QUERIES[f.__name__] = run
    return f


@boosted
def global_tweedie_cv(p, table):
    return table("cv_global")


@boosted
def forecast_future(p, table):
    """The next 28 days with intervals, from the model on all days."""
    return table("forecast_future")


@boosted
def feature_importance(p, table):
    return table("feature_importance")


def _all_models(p, table) -> DataFrame:
    return outputs.with_dept(backtest.simple_forecasts(p).unionByName(table("cv_global")), p)


@boosted
def global_wrmsse(p, table):
    """The boosted model beside the simple ones."""
    return metrics.evaluate(p, materialize(_all_models(p, table), "all-models"), backtest.cutoffs(p))[0]


@boosted
def global_versus_best(p, table):
    by_sku = metrics.evaluate(p, materialize(_all_models(p, table), "all-models"), backtest.cutoffs(p))[1]
    return _versus_best(metrics.segment_table(by_sku, _classes(p)), models.BOOSTED)


@boosted
def global_recommendation(p, table):
    """Today's policy from the boosted forecast of the next 28 days, with classes."""
    return outputs.recommendation(p, table("forecast_future"), table("cv_global"), _default(p), params.DEFAULT_LEAD)


def _global_basis(p, cv, lead_times) -> tuple[DataFrame, DataFrame]:
    """(what the three policies know, with prices; a series' demand) of the evaluation days. cv holds all models."""
    cv = cv.where(F.col("model").isin(backtest.SEASONAL, models.BOOSTED)).drop("dept_id")
    sold = policy.evaluation_demand(p)
    basis = policy.forecast_basis(cv, lead_times).unionByName(policy.classic_basis(p, lead_times)).join(sold.select("unique_id", "price"), "unique_id")
    return basis, sold.select("unique_id", "demand")


def _global_grid(basis, sold, scenario) -> DataFrame:
    return simulate.by_sku(simulate.simulate(policy.decisions(basis, scenario).join(sold, "unique_id")))


def _global_scenarios(basis, sold, classes) -> DataFrame:
    return simulate.kpis(_global_grid(basis, sold, policy.scenarios(basis.sparkSession, params.SS_METHODS, params.SERVICE_LEVELS)), classes)


def _global_frontier(basis, sold, classes) -> DataFrame:
    levels = policy.scenarios(basis.sparkSession, ["sqrt"], params.FRONTIER_LEVELS, clip=False)
    return simulate.kpis(_global_grid(basis, sold, levels), classes)


@boosted
def global_scenario_grid(p, table):
    """The three policies: classic, same weekday, boosted."""
    return _global_scenarios(*_global_basis(p, _all_models(p, table), params.LEAD_TIMES), _classes(p)).drop("order_cost", "holding_rate")


@boosted
def global_savings(p, table):
    need = simulate.inventory_at_fill(_global_frontier(*_global_basis(p, _all_models(p, table), params.LEAD_TIMES), _classes(p)), params.FILL_TARGETS)
    return _savings(need, [backtest.SEASONAL, models.BOOSTED], models.BOOSTED)


def _global_costs(basis, sold, classes) -> DataFrame:
    costs = [params.Costs(order_cost=k, holding_rate_annual=h) for k in params.ORDER_COSTS for h in params.HOLDING_RATES]
    levels = policy.scenarios(basis.sparkSession, ["sqrt"], params.FRONTIER_LEVELS, False, costs)
    curve = simulate.kpis(_global_grid(basis, sold, levels), classes).where("group = 'Total'")
    need = simulate.inventory_at_fill(curve, (params.DEFAULT_LEVEL,), ("policy", "order_cost", "holding_rate"))
    value = lambda name: F.max(F.when(F.col("policy") == name, F.col("avg_inv_value")))
    return need.groupBy("order_cost", "holding_rate").agg(value(policy.CLASSIC).alias("inv_classic"), value(models.BOOSTED).alias("inv_boosted")).withColumn("reduction", F.col("inv_boosted") / F.nullif(F.col("inv_classic"), F.lit(0.0)) - 1.0)


@boosted
def global_cost_sensitivity(p, table):
    return _global_costs(*_global_basis(p, _all_models(p, table), [params.DEFAULT_LEAD]), _classes(p))


def _report(p, table) -> dict[str, DataFrame]:
    """Every dataset of the report. It is dated by the panel's last day, so that runs agree.

    Both fits, the classes and the demand come from the panel alone and are made at once; then what several datasets read
    (all models, what the policies know) is written, and the grids are simulated from it at once.
    """
    written = lambda make, name: lambda: materialize(make(), name)
    _, ablation, classes = side_by_side(p.sparkSession, [lambda: table("cv_global"), lambda: table("ablation"), written(lambda: _classes(p), "classes")])
    cv = materialize(_all_models(p, table), "all-models")
    basis, sold = _global_basis(p, cv, params.LEAD_TIMES)
    spread = basis.repartition(shuffle_partitions(p.sparkSession), "unique_id")  # few rows, much work
    basis, sold = side_by_side(p.sparkSession, [written(lambda: spread, "basis"), written(lambda: sold, "sold")])
    usual = basis.where(F.col("lead_time") == params.DEFAULT_LEAD)
    scenario, frontier, costs = side_by_side(p.sparkSession, [
        lambda: _global_scenarios(basis, sold, classes), written(lambda: _global_frontier(basis, sold, classes), "frontier"), lambda: _global_costs(usual, sold, classes),
    ])
    fill = _global_grid(usual.where(F.col("policy") == models.BOOSTED), sold, _default(p))
    last = p.agg(F.max("ds")).first()[0]
    about = report.About("all", "all", (backtest.NAIVE, backtest.SEASONAL, backtest.AVERAGE), f"{last}T00:00:00+00:00", report.commit_of())
    return report.extract(p, classes, cv, models.BOOSTED, table("forecast_future"), table("feature_importance"), ablation, scenario, frontier, fill, costs, backtest.cutoffs(p), about)


@boosted
def report_datasets(p, table):
    """Every dataset of the report as JSON rows: written, read back by the stated schemas, and checked."""
    folder = f"{work_dir(p.sparkSession)}/report-{uuid.uuid4().hex}"
    report.write(_report(p, table), folder)
    sets = report.read(p.sparkSession, folder)
    report.validate(sets)
    out = None
    for name, df in sets.items():
        rows = df.select(F.lit(name).alias("dataset"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def ets_cv(p):
    return models.series_backtest(p, "ets")


@query
def sar_cv(p):
    return models.series_backtest(p, "sar")


@boosted
def ablation(p, table):
    """Variants of the boosted model on the calibration windows. The time they took is left out: it differs from run to run."""
    return table("ablation").drop("seconds")
