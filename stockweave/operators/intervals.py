"""Conformal prediction intervals from backtest residuals, with finite-sample levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.expr import conformal_level, not_negative, quantile_at
from stockweave.params import INTERVAL_LEVELS


def margins(cv: DataFrame, levels: tuple[int, ...] = INTERVAL_LEVELS) -> DataFrame:
    """unique_id, model, level, lo, hi: residual quantiles, all steps pooled (windows x horizon values a series)."""
    sorted_ = cv.groupBy("unique_id", "model").agg(F.sort_array(F.collect_list(F.col("y") - F.col("yhat"))).alias("e"))
    n = F.size("e")
    rows = [F.struct(F.lit(lv).alias("level"), *[quantile_at(F.col("e"), conformal_level(n, q)).alias(name) for name, q in (("lo", (1 - lv / 100) / 2), ("hi", 1 - (1 - lv / 100) / 2))]) for lv in levels]
    return sorted_.select("unique_id", "model", F.explode(F.array(*rows)).alias("r")).select("unique_id", "model", "r.*")


def add_intervals(forecast: DataFrame, margin: DataFrame) -> DataFrame:
    """forecast(unique_id, model, yhat, ...) with level, lo and hi, both ends at 0 or more."""
    joined = forecast.join(margin.withColumnsRenamed({"lo": "lo_margin", "hi": "hi_margin"}), ["unique_id", "model"])
    return joined.withColumns({"lo": not_negative(F.col("yhat") + F.col("lo_margin")), "hi": not_negative(F.col("yhat") + F.col("hi_margin"))}).drop("lo_margin", "hi_margin")


def coverage(with_bounds: DataFrame, classes: DataFrame) -> DataFrame:
    """Share of days inside the bounds (ends count) in total and by abc, xyz and pattern."""
    rows = with_bounds.join(classes.select("unique_id", "abc", "xyz", "pattern"), "unique_id", "left")
    groups = F.array(F.struct(F.lit("total").alias("grouping"), F.lit("total").alias("group")), *[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("group")) for g in ("abc", "xyz", "pattern")])
    return rows.select("*", F.explode(groups).alias("g")).groupBy("model", "g.grouping", "g.group", "level").agg(
        (F.first("level") / 100).alias("nominal"), F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("mean_width"), F.count("*").alias("n_obs")
    )
