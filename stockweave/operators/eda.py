"""Exploratory queries over a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.expr import ratio
from stockweave.operators.ranks import quantiles
from stockweave.session import materialize


def overview(panel: DataFrame) -> DataFrame:
    series = panel.groupBy("unique_id").agg(F.count("*").alias("n"), F.sum("y").alias("units"), F.sum((F.col("y") == 0).cast("long")).alias("zeros"), F.min("ds").alias("lo"), F.max("ds").alias("hi"), F.first("dept_id").alias("dept_id"))
    series = materialize(series, "series")
    return series.agg(F.count("*").alias("n_series"), F.sum("n").alias("n_rows"), F.countDistinct("dept_id").alias("n_depts"), F.min("lo").alias("first_day"), F.max("hi").alias("last_day"), F.sum("units").alias("units"), (F.sum("zeros") / F.sum("n")).alias("zero_share")).crossJoin(quantiles(series, "n", {"median_days": 0.5, "p10_days": 0.1}))  # a row each


def daily_total(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ds").agg(F.sum("y").alias("y"), F.max("event_name_1").alias("event_name_1"), F.max("event_type_1").alias("event_type_1"), F.max("snap").alias("snap"))


def weekly_demand(panel: DataFrame) -> DataFrame:
    """Units per calendar week ending on Sunday, without the first and the last week. Windows run over weeks."""
    weeks = daily_total(panel).groupBy(F.next_day(F.date_sub("ds", 1), "SU").alias("week_end")).agg(F.sum("y").alias("units"))
    ends = weeks.agg(F.min("week_end").alias("lo"), F.max("week_end").alias("hi"))
    return weeks.crossJoin(F.broadcast(ends)).where("week_end > lo and week_end < hi").select("week_end", "units")


def closed_days(panel: DataFrame, share: float = 0.05) -> DataFrame:
    """Days below a share of the median day."""
    days = daily_total(panel)
    middle = days.agg(F.median("y").alias("middle"))
    return days.crossJoin(F.broadcast(middle)).where(F.col("y") < share * F.col("middle")).select("ds", "y")


def weekday_index(panel: DataFrame) -> DataFrame:
    days = daily_total(panel).groupBy(F.weekday("ds").alias("weekday")).agg(F.avg("y").alias("mean_y"))
    return days.select("weekday", "mean_y", (F.col("mean_y") / F.avg("mean_y").over(Window.partitionBy())).alias("index"))


def snap_lift(panel: DataFrame) -> DataFrame:
    """Mean day with over mean day without the benefit flag, per weekday."""
    days = daily_total(panel).groupBy(F.weekday("ds").alias("weekday")).agg(F.avg(F.when(F.col("snap") == 1, F.col("y"))).alias("with_snap"), F.avg(F.when(F.col("snap") == 0, F.col("y"))).alias("without_snap"))
    return days.withColumn("lift", ratio(F.col("with_snap"), F.col("without_snap")) - 1.0)


def event_profile(panel: DataFrame, before: int = 7, after: int = 3) -> DataFrame:
    """Median index of the days around events, against the same weekday four weeks each way. The window runs over days."""
    days = daily_total(panel)
    by_day = Window.orderBy("ds")
    near = [f(F.col("y"), 7 * k).over(by_day) for k in range(1, 5) for f in (F.lag, F.lead)]
    known = F.array_compact(F.array(*near))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    index = days.select(F.col("ds").alias("at"), ratio(F.col("y"), mean).alias("index"))
    events = days.where("event_name_1 is not null").select("event_type_1", "ds", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("at", F.date_add("ds", F.col("offset")))
    return events.join(index, "at").groupBy(F.col("event_type_1").alias("event_type"), "offset").agg(F.median("index").alias("median_index"))


#: (lower edge, upper edge, label); right-closed.
BUCKETS = ((0.0, 0.85, "< -15%"), (0.85, 0.95, "-15 a -5%"), (0.95, 0.99, "-5 a -1%"), (0.99, 1.01, "sin cambio"), (1.01, 1.05, "+1 a +5%"), (1.05, float("inf"), "> +5%"))


def price_response(panel: DataFrame, rows: int = 91, least: int = 28) -> DataFrame:
    """Units against the units of the 91 days before, by the price's ratio to its own mean of those days."""
    past = Window.partitionBy("unique_id").orderBy("ds").rowsBetween(-rows, -1)
    mean = lambda c: F.when(F.count(c).over(past) >= least, F.avg(c).over(past))
    ref = panel.withColumns({"price_ref": mean("sell_price"), "y_ref": mean("y")}).where("price_ref is not null and y_ref is not null")
    rel = F.col("sell_price") / F.col("price_ref")
    bucket = F.coalesce(*[F.when((rel > lo) & (rel <= hi), label) for lo, hi, label in BUCKETS])
    out = ref.groupBy(bucket.alias("bucket")).agg(F.sum("y").alias("y"), F.sum("y_ref").alias("y_ref"), F.count("*").alias("obs"))
    return out.withColumns({"index": ratio(F.col("y"), F.col("y_ref")), "share": F.col("obs") / F.sum("obs").over(Window.partitionBy())})


def revenue_matrix(classes: DataFrame) -> DataFrame:
    """Revenue by abc (rows) and xyz (columns)."""
    return classes.groupBy("abc").pivot("xyz", ["X", "Y", "Z"]).agg(F.sum("revenue")).na.fill(0.0, ["X", "Y", "Z"])
