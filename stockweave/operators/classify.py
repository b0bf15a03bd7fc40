"""Product classes: revenue (ABC), variability (XYZ) and demand pattern."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.expr import abc_class, demand_pattern, ratio, xyz_class
from stockweave.operators.ranks import in_order
from stockweave.params import CLASSIFY_DAYS, HORIZON, N_EVAL


def last_day(panel: DataFrame, minus: int = 0) -> DataFrame:
    """One row: the panel's last day, some days earlier."""
    return panel.agg(F.date_sub(F.max("ds"), minus).alias("end_day"))


def with_abc(series: DataFrame, measure: str = "revenue") -> DataFrame:
    """Adds abc and revenue_share, by distributed running sums over the series; equal revenues go by unique_id."""
    total = F.col("total_")
    share = F.when(total > 0, F.col("before_") / total).otherwise(0.0)
    placed = in_order(series, [(measure, "desc"), "unique_id"], measure)
    return placed.select(*series.columns, abc_class(share).alias("abc"), ratio(F.col(measure), total).alias("revenue_share"))


def _measures(sums: DataFrame, weeks: float) -> DataFrame:
    """Measures of a series from its sums over the last days: n days, zeros of them without sales, nz with; w_sum and w_sq over whole weeks."""
    w_mean, w_var = F.col("w_sum") / weeks, (F.col("w_sq") - F.col("w_sum") * F.col("w_sum") / weeks) / (weeks - 1)
    nz_sum = F.nullif(F.col("nz_sum"), F.lit(0.0))  # whole quantities give cv2 with one rounding
    return sums.select(
        "unique_id", "revenue", "units", (F.col("units") / F.col("n")).alias("mean_daily"), "price", (F.col("zeros") / F.col("n")).alias("zero_share"),
        F.when(w_mean > 0, F.sqrt(F.greatest(w_var, F.lit(0.0))) / w_mean).alias("cv_weekly"),
        F.when(F.col("nz") > 0, F.col("n") / F.nullif(F.col("nz"), F.lit(0))).otherwise(F.lit(float("inf"))).alias("adi"),
        F.when(nz_sum > 0, F.greatest((F.col("nz") * F.col("nz_sq") - nz_sum * nz_sum) / (nz_sum * nz_sum), F.lit(0.0))).otherwise(0.0).alias("cv2"),
    )


def _classed(table: DataFrame) -> DataFrame:
    classed = with_abc(table).withColumn("xyz", xyz_class(F.col("cv_weekly")))
    return classed.withColumns({"segment": F.concat("abc", "xyz"), "pattern": demand_pattern(F.col("adi"), F.col("cv2"))})


def classify(panel: DataFrame, days: int = CLASSIFY_DAYS, before_evaluation: bool = False) -> DataFrame:
    """One row per series with sales in the last days: measures, abc, xyz, segment, pattern.

    Weeks count backwards from the end; those without sales count as 0 and the broken last one is left out. Both
    groupings are by series, so the panel is shuffled once, already summed by week.
    """
    end = last_day(panel, N_EVAL * HORIZON if before_evaluation else 0)
    win = panel.select("unique_id", "ds", "y", "sell_price").crossJoin(F.broadcast(end)).where(f"ds > date_sub(end_day, {days}) and ds <= end_day")
    weekly = win.groupBy("unique_id", F.floor(F.datediff("end_day", "ds") / 7).cast("int").alias("week")).agg(
        F.sum(F.col("y") * F.col("sell_price")).alias("revenue"), F.sum("y").alias("units"), F.count("*").alias("n"), F.sum((F.col("y") == 0).cast("long")).alias("zeros"),
        F.max(F.struct("ds", "sell_price")).alias("last"), F.sum((F.col("y") > 0).cast("long")).alias("nz"), F.sum(F.when(F.col("y") > 0, F.col("y"))).alias("nz_sum"), F.sum(F.when(F.col("y") > 0, F.col("y") * F.col("y"))).alias("nz_sq"),
    )
    whole = F.col("week") < days // 7
    weeks = float(days // 7)
    sums = weekly.groupBy("unique_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("units").alias("units"), F.sum("n").alias("n"), F.sum("zeros").alias("zeros"), F.max("last")["sell_price"].alias("price"), F.sum("nz").alias("nz"), F.sum("nz_sum").alias("nz_sum"), F.sum("nz_sq").alias("nz_sq"),
        F.coalesce(F.sum(F.when(whole, F.col("units"))), F.lit(0.0)).alias("w_sum"), F.coalesce(F.sum(F.when(whole, F.col("units") * F.col("units"))), F.lit(0.0)).alias("w_sq"),
    )
    return _classed(_measures(sums, weeks))


def classify_sparse(sales: DataFrame, end: date, days: int = CLASSIFY_DAYS) -> DataFrame:
    """The classes of ``classify`` from sales(unique_id, ds, y, revenue) alone, for series too many or too sparse for a panel.

    Days without sales are counted, from a series' first sale on, and never written: work grows with the sales. They are
    summed by day, then by week, then by series, each step before its shuffle too, so a series with a third of all rows
    is spread by its days. price is the revenue of a unit sold in the last days, null without one. Sales after end and rows
    without a series, a day or a quantity are left out; a null revenue counts as 0.
    """
    daily = sales.where("unique_id is not null and y is not null").where(F.col("ds") <= F.lit(end)).groupBy("unique_id", "ds").agg(F.sum("y").alias("y"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
    age = F.datediff(F.lit(end), "ds")
    sold, y = F.col("y") > 0, F.col("y")
    weekly = daily.groupBy("unique_id", F.when(age < days, F.floor(age / 7)).cast("int").alias("week")).agg(
        F.max(age).alias("age"), F.sum("revenue").alias("revenue"), F.sum("y").alias("units"), F.count_if(sold).alias("nz"), F.sum(F.when(sold, y)).alias("nz_sum"), F.sum(F.when(sold, y * y)).alias("nz_sq"),
    )
    recent, whole = F.col("week").isNotNull(), F.col("week") < days // 7
    over = lambda c, where, zero=0.0: F.coalesce(F.sum(F.when(where, c)), F.lit(zero))
    units = F.col("units")
    sums = weekly.groupBy("unique_id").agg(
        over(F.col("revenue"), recent).alias("revenue"), over(units, recent).alias("units"), F.least(F.max("age") + 1, F.lit(days)).cast("long").alias("n"), over(F.col("nz"), recent, 0).alias("nz"),
        F.sum(F.when(recent, F.col("nz_sum"))).alias("nz_sum"), F.sum(F.when(recent, F.col("nz_sq"))).alias("nz_sq"), over(units, whole).alias("w_sum"), over(units * units, whole).alias("w_sq"),
    )
    sums = sums.withColumns({"zeros": F.col("n") - F.col("nz"), "price": ratio(F.col("revenue"), F.col("units"))})
    return _classed(_measures(sums, float(days // 7)))


def class_matrix(classes: DataFrame) -> DataFrame:
    """Counts of abc x xyz with margins (null is the margin)."""
    return classes.cube("abc", "xyz").agg(F.count("*").alias("n_skus"))


def pareto(classes: DataFrame) -> DataFrame:
    """Cumulative share of revenue and of products, in order of revenue, by distributed running sums."""
    placed = in_order(classes.select("unique_id", "revenue"), [("revenue", "desc"), "unique_id"], "revenue")
    return placed.select("unique_id", ratio(F.col("before_") + F.coalesce("revenue", F.lit(0.0)), F.col("total_")).alias("revenue_share"), (F.col("place_") / F.col("count_")).alias("sku_share"))
