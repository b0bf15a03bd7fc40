"""Named output tables, from the raw files to the report, and a store of them that later queries of an application read."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave import params
from stockweave.operators import backtest, classify, intervals, metrics, models, policy, simulate
from stockweave.session import exists, materialize, work_dir
from stockweave.sources import panel as panels


@dataclass(frozen=True)
class Settings:
    """What a run works on; from the environment where it is set there (STOCKWEAVE_STORE and so on)."""

    store: str = "CA_1"
    category: str = "FOODS"
    skip_sarima: bool = False

    @classmethod
    def from_environment(cls, env=os.environ) -> "Settings":
        return cls(env.get("STOCKWEAVE_STORE", cls.store), env.get("STOCKWEAVE_CATEGORY", cls.category), env.get("STOCKWEAVE_SKIP_SARIMA", "0") == "1")


def source_state(spark: SparkSession, source: str) -> list[list]:
    """Name, size and time of change of every file in a source folder: what a stored table depends on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], dict[str, DataFrame]]) -> DataFrame:
    """The table name of a source; make writes it, with all that comes from the same work, the first time it is asked for.

    Tables lie in a folder named by the source files' state, so changed files make new tables. Each has a manifest, written
    after all tables of the same work: a table without one, or one deleted by ``session.release``, is made again.
    """
    state = json.dumps(source_state(spark, source))
    folder = f"{work_dir(spark)}/outputs-{hashlib.sha256(f'{source}{state}'.encode()).hexdigest()[:16]}"
    if not exists(spark, f"{folder}/manifests/{name}"):
        made = make()
        for n, df in made.items():
            df.write.mode("overwrite").parquet(f"{folder}/{n}")
        for n in made:
            spark.createDataFrame([(n, source, state)], "table string, source string, files string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifests/{n}")
    return spark.read.parquet(f"{folder}/{name}")


def with_future(panel: DataFrame) -> DataFrame:
    """The next HORIZON days of every series, at known or last prices."""
    last = panel.agg(F.max("ds").alias("last"))  # one row
    days = last.select(F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", params.HORIZON))).alias("ds")).withColumns(panels.calendar_columns(F.col("ds")))
    known = panel.groupBy("unique_id", "wm_yr_wk").agg(F.max("sell_price").alias("sell_price"))
    return panels.build_future(panel, days, known)


def boosted(panel: DataFrame, future: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """cv_global, forecast_future (with intervals), feature_importance."""
    future = materialize(with_future(panel), "future") if future is None else future
    cv, ahead, importance = models.global_model(panel, future, **options)
    cv = materialize(cv, "cv-global")  # its residuals give the margins
    margins = intervals.margins(cv)
    rows = intervals.add_intervals(ahead.withColumn("model", F.lit(models.BOOSTED)), margins)
    wide = rows.groupBy("unique_id", "ds", "model", "yhat").pivot("level", list(params.INTERVAL_LEVELS)).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    price = future.select("unique_id", "ds", F.col("sell_price").alias("price"))
    return {"cv_global": cv, "forecast_future": wide.join(price, ["unique_id", "ds"], "left"), "feature_importance": importance}


def with_dept(cv: DataFrame, panel: DataFrame) -> DataFrame:
    return cv.join(panel.groupBy("unique_id").agg(F.first("dept_id").alias("dept_id")), "unique_id")


def recommendation(panel: DataFrame, forecast: DataFrame, cv: DataFrame, scenario: DataFrame, lead_time: int) -> DataFrame:
    """Today's policy per series with its names and classes."""
    named = panel.groupBy("unique_id").agg(F.first("item_id").alias("item_id"), F.first("dept_id").alias("dept_id"))
    classes = classify.classify(panel, before_evaluation=True).select("unique_id", "abc", "xyz", "segment", "pattern")
    return named.join(classes, "unique_id").join(policy.recommend(forecast.select("unique_id", "ds", "yhat", "price"), cv, scenario, lead_time), "unique_id")


def run(spark: SparkSession, raw: str, out: str, n_days: int, settings: Settings = Settings(), min_history: int = params.MIN_HISTORY, **options) -> dict[str, DataFrame]:
    """From the three raw files to named tables in the folder out; each step reads what the ones before it wrote."""

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        tables[name] = spark.read.parquet(f"{out}/{name}")
        return tables[name]

    tables: dict[str, DataFrame] = {}
    sales, calendar, prices, rejected = panels.read_raw_checked(spark, raw, n_days)
    put("rejected_lines", rejected)
    p = put("sales_long", panels.build_long(sales, calendar, prices, settings.store, settings.category, min_history))
    days = calendar.select(F.col("date").alias("ds"), "wm_yr_wk", "event_name_1", "event_type_1", F.col(f"snap_{settings.store.split('_')[0]}").alias("snap"))
    own = prices.where(F.col("store_id") == settings.store).select(F.concat_ws("_", "item_id", "store_id").alias("unique_id"), "wm_yr_wk", "sell_price")
    future = put("future_exog", panels.build_future(p, days, own))
    dept = p.groupBy("unique_id").agg(F.first("dept_id").alias("dept_id"))
    classes = put("abc_xyz", classify.classify(p, before_evaluation=True).join(dept, "unique_id"))
    baselines = put("cv_baselines", backtest.simple_forecasts(p))
    for kind in ("ets",) if settings.skip_sarima else ("ets", "sar"):
        fitted = backtest.with_fallback(models.series_backtest(p, kind), baselines.where(F.col("model") == backtest.SEASONAL))
        baselines = baselines.unionByName(put(f"cv_{kind}", fitted).drop("failed"))
    for name, df in boosted(p, future, **options).items():
        put(name, df)
    cv = with_dept(baselines.unionByName(tables["cv_global"]), p)
    scores, by_sku = metrics.evaluate(p, cv, backtest.cutoffs(p))
    put("metrics_wrmsse", scores)
    put("metrics_sku", by_sku)
    put("metrics_segment", metrics.segment_table(tables["metrics_sku"], classes))
    held = tables["cv_global"].where(backtest.split_of(F.col("window")) == "eval")
    margins = intervals.margins(tables["cv_global"].where(backtest.split_of(F.col("window")) == "calib"))
    put("metrics_coverage", intervals.coverage(intervals.add_intervals(held, margins), classes))
    sold = put("evaluation_demand", policy.evaluation_demand(p))
    basis = policy.forecast_basis(cv.where(F.col("model").isin(backtest.SEASONAL, models.BOOSTED)), params.LEAD_TIMES).unionByName(policy.classic_basis(p, params.LEAD_TIMES))
    basis = put("policy_basis", basis).join(sold.select("unique_id", "price"), "unique_id")

    def grid(scenario):
        return simulate.by_sku(simulate.simulate(policy.decisions(basis, scenario).join(sold.select("unique_id", "demand"), "unique_id")))

    chosen = policy.scenarios(spark, [params.DEFAULT_METHOD], [params.DEFAULT_LEVEL])
    put("sim_by_sku", grid(chosen))
    put("sim_scenarios", simulate.kpis(grid(policy.scenarios(spark, params.SS_METHODS, params.SERVICE_LEVELS)), classes))
    put("sim_frontier", simulate.kpis(grid(policy.scenarios(spark, ["sqrt"], params.FRONTIER_LEVELS, clip=False)), classes))
    put("policy_table", recommendation(p, tables["forecast_future"], tables["cv_global"], chosen, params.DEFAULT_LEAD))
    return tables
