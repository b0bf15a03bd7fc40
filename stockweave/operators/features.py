"""Calendar, price and lag features without look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stockweave.params import EVENT_CAP, LAGS, PRICE_ROWS, ROLLING, SEASON

AUTOREGRESSIVE = [*(f"lag_{k}" for k in LAGS), *(name for name, *_ in ROLLING)]
EXOGENOUS = ["is_event", "event_name", "event_type", "days_to_event", "price_rel_item", "price_rel_dept", "price_change_7"]
DATE_PARTS = ["dayofweek", "day", "month"]


def by_series() -> WindowSpec:
    return Window.partitionBy("unique_id").orderBy("ds")


def calendar_features(panel: DataFrame) -> DataFrame:
    """is_event, event_name, event_type, days_to_event: 0 on the day itself, capped, the cap where none follows.

    Computed once per distinct day (the window runs over days only) and joined back.
    """
    days = panel.groupBy("ds").agg(F.max("event_name_1").alias("event_name"), F.max("event_type_1").alias("event_type"))
    ahead = Window.orderBy("ds").rowsBetween(0, Window.unboundedFollowing)
    following = F.min(F.when(F.col("event_name").isNotNull(), F.col("ds"))).over(ahead)
    known = days.select(
        "ds", F.col("event_name").isNotNull().cast("int").alias("is_event"), F.coalesce("event_name", F.lit("none")).alias("event_name"), F.coalesce("event_type", F.lit("none")).alias("event_type"),
        F.least(F.coalesce(F.datediff(following, "ds"), F.lit(EVENT_CAP)), F.lit(EVENT_CAP)).alias("days_to_event"),
    )
    return panel.join(F.broadcast(known), "ds")  # a row per day


def price_features(panel: DataFrame) -> DataFrame:
    """Price against the trailing mean of the item, against the department's day, and against a week ago."""
    trailing = F.avg("sell_price").over(by_series().rowsBetween(-(PRICE_ROWS - 1), 0))
    week_ago = F.lag("sell_price", SEASON).over(by_series())
    own = panel.withColumns({"price_rel_item": F.col("sell_price") / trailing, "price_change_7": F.coalesce(F.col("sell_price") / week_ago - 1.0, F.lit(0.0))})
    dept = panel.groupBy("dept_id", "ds").agg(F.avg("sell_price").alias("dept_price"))
    # without the hint, the side whose shuffle ends first may be broadcast, be it the panel
    return own.join(dept.hint("shuffle_hash"), ["dept_id", "ds"]).withColumn("price_rel_dept", F.col("sell_price") / F.col("dept_price")).drop("dept_price")


def exogenous_features(panel: DataFrame) -> DataFrame:
    return panel.transform(price_features).transform(calendar_features)


def lag_features(panel: DataFrame) -> DataFrame:
    """Lags and rolling statistics that look back a week or more; null until their rows are complete."""
    by = by_series()
    new = {f"lag_{k}": F.lag("y", k).over(by) for k in LAGS}
    for name, lag, rows, stat in ROLLING:
        frame = by.rowsBetween(-(lag + rows - 1), -lag)
        new[name] = F.when(F.count("y").over(frame) == rows, getattr(F, stat)("y").over(frame))
    return panel.withColumns(new)


def date_parts(panel: DataFrame) -> DataFrame:
    """dayofweek counts from 0 on Monday."""
    return panel.withColumns({"dayofweek": F.weekday("ds"), "day": F.dayofmonth("ds"), "month": F.month("ds")})


def both_frames(panel: DataFrame, future: DataFrame) -> DataFrame:
    """Exogenous features of history and future in one frame; y is null in the future."""
    return exogenous_features(panel.unionByName(future.withColumn("y", F.lit(None).cast("double")), allowMissingColumns=True))


def model_frames(panel: DataFrame, future: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(history, future) with exogenous features computed over both together."""
    if future is None:
        return exogenous_features(panel), None
    both = both_frames(panel, future)
    last = F.broadcast(panel.agg(F.max("ds").alias("last_ds")))
    both = both.crossJoin(last)
    return both.where("ds <= last_ds").drop("last_ds"), both.where("ds > last_ds").drop("last_ds", "y", "item_id", "dept_id")
