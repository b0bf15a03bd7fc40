"""Demand panels: from the raw wide layout (sales, calendar, prices) and from order lines.

A panel has one row per series and day: unique_id, ds, y, item_id, dept_id, wm_yr_wk, snap, event_name_1,
event_type_1, sell_price. Every series is dense from its first day on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockweave.params import EVENTS, HORIZON, MIN_HISTORY, WEEK_ZERO
from stockweave.session import materialize

DAY_COLUMN = re.compile(r"^d_\d+$")
CALENDAR = "date date, wm_yr_wk int, weekday string, wday int, month int, year int, d string, event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, snap_CA int, snap_TX int, snap_WI int"
PRICES = "store_id string, item_id string, wm_yr_wk int, sell_price double"
SALES_IDS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")


REJECTED = "_corrupt_record"


def read_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejected lines: file, line) of a CSV folder with a header, by a stated schema: no second read infers one.

    A line with a value of the wrong type, or too few or too many values, is rejected and kept whole.
    """
    rows = spark.read.schema(f"{schema}, {REJECTED} string").csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED)
    rows = materialize(rows.withColumn("file_", F.input_file_name()), "raw")
    sound = rows.where(F.col(REJECTED).isNull()).drop(REJECTED, "file_")
    return sound, rows.where(F.col(REJECTED).isNotNull()).select(F.regexp_extract("file_", "[^/]+/[^/]+$", 0).alias("file"), F.col(REJECTED).alias("line"))


def read_raw_checked(spark: SparkSession, folder: str, n_days: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sales, calendar, prices, rejected lines of all three files)."""
    days = ", ".join(f"d_{k} int" for k in range(1, n_days + 1))
    schemas = {"sales_train_evaluation.csv": ", ".join(f"{c} string" for c in SALES_IDS) + ", " + days, "calendar.csv": CALENDAR, "sell_prices.csv": PRICES}
    found = [read_checked(spark, f"{folder}/{name}", schema) for name, schema in schemas.items()]
    rejected = found[0][1].unionByName(found[1][1]).unionByName(found[2][1])
    return found[0][0], found[1][0], found[2][0], rejected


def read_raw(spark: SparkSession, folder: str, n_days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sales, calendar, prices) from the three CSV files, without rejected lines."""
    return read_raw_checked(spark, folder, n_days)[:3]


def write_raw(panel: DataFrame, folder: str, store: str, category: str) -> int:
    """The panel as three CSV files in the wide layout, and how many day columns there are. The calendar spans its days."""
    lo, n_days = panel.agg(F.min("ds"), F.datediff(F.max("ds"), F.min("ds")) + 1).first()
    at = F.datediff("ds", F.lit(lo))
    days = panel.groupBy("ds", "wm_yr_wk").agg(F.max("event_name_1").alias("event_name_1"), F.max("event_type_1").alias("event_type_1"), F.max("snap").alias("snap"))
    null = F.lit(None).cast("string")
    own = {"date": F.col("ds"), "weekday": F.date_format("ds", "EEEE"), "wday": F.dayofweek("ds"), "month": F.month("ds"), "year": F.year("ds"), "d": F.concat(F.lit("d_"), at + 1), "event_name_2": null, "event_type_2": null}
    calendar = days.select(*[(F.col("snap") if c.startswith("snap_") else own.get(c, F.col(c))).alias(c) for c in (x.split()[0] for x in CALENDAR.split(", "))])
    ordered = F.array_sort(F.collect_list(F.struct(at.alias("k"), F.col("y").cast("int").alias("y"))))
    series = panel.groupBy("unique_id", "dept_id").agg(ordered.alias("p"))  # dense from its first day on
    values = F.concat(F.array_repeat(F.lit(None).cast("int"), F.get("p", F.lit(0))["k"]), F.transform("p", lambda x: x["y"]))
    ids = {"id": F.concat_ws("_", "unique_id", F.lit(store), F.lit("evaluation")), "item_id": F.col("unique_id"), "dept_id": F.col("dept_id"), "cat_id": F.lit(category), "store_id": F.lit(store), "state_id": F.lit(store.split("_")[0])}
    # written: else each of the columns would work the whole array out again
    arrays = materialize(series.select(*[ids[c].alias(c) for c in SALES_IDS], values.alias("v")), "wide")
    wide = arrays.selectExpr(*SALES_IDS, *[f"get(v, {k}) AS d_{k + 1}" for k in range(n_days)])
    prices = panel.select(F.lit(store).alias("store_id"), F.col("unique_id").alias("item_id"), "wm_yr_wk", "sell_price").distinct()
    for name, df in (("sales_train_evaluation.csv", wide), ("calendar.csv", calendar), ("sell_prices.csv", prices)):
        df.write.csv(f"{folder}/{name}", header=True)
    return n_days


def wide_to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """The d_<n> columns as rows (keys, d, y); empty cells give no row. One array a row, exploded: with thousands of columns
    that plans much faster than UNPIVOT, which holds a projection for each."""
    days = [c for c in wide.columns if DAY_COLUMN.match(c)]
    long = wide.select(*keys, F.posexplode(F.expr(f"array({', '.join(days)})")).alias("k_", "y")).where("y is not null")
    return long.select(*keys, F.get(F.split(F.lit(",".join(days)), ","), F.col("k_")).alias("d"), "y")


def with_min_history(panel: DataFrame, rows: int = MIN_HISTORY) -> DataFrame:
    """Series with at least that many rows. Counts are aggregated first; the panel is not sorted for them."""
    long_enough = panel.groupBy("unique_id").count().where(F.col("count") >= rows).select("unique_id")
    return panel.join(long_enough, "unique_id", "left_semi")


def build_long(sales: DataFrame, calendar: DataFrame, prices: DataFrame, store: str, category: str, min_history: int = MIN_HISTORY) -> DataFrame:
    """The panel of one store and category. Days without a price are before the listing and are left out."""
    state = store.split("_")[0]
    chosen = sales.where((F.col("store_id") == store) & (F.col("cat_id") == category))
    long = wide_to_long(chosen, ["item_id", "dept_id", "cat_id", "store_id"])
    days = calendar.select("d", F.col("date").alias("ds"), "wm_yr_wk", "event_name_1", "event_type_1", "event_name_2", F.col(f"snap_{state}").alias("snap"))
    priced = long.join(F.broadcast(days), "d").join(prices.where(F.col("store_id") == store), ["item_id", "store_id", "wm_yr_wk"], "left").where("sell_price is not null")
    panel = priced.select(F.concat_ws("_", "item_id", "store_id").alias("unique_id"), "ds", "wm_yr_wk", "event_name_1", "event_type_1", "event_name_2", "snap", F.col("y").cast("double").alias("y"), "item_id", "dept_id", "cat_id", "store_id", "sell_price")
    return with_min_history(panel, min_history)


def build_future(panel: DataFrame, days: DataFrame, prices: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Every series on the next days of a calendar (ds, wm_yr_wk, ...), at known prices (unique_id, wm_yr_wk,
    sell_price) or the last price seen. The day range is a scalar subquery of one row."""
    last = panel.groupBy().agg(F.max("ds").alias("last"))
    ahead = days.crossJoin(F.broadcast(last)).where(f"ds > last and ds <= date_add(last, {horizon})").drop("last")
    series = panel.groupBy("unique_id", "item_id", "dept_id").agg(F.max_by("sell_price", F.when(F.col("sell_price").isNotNull(), F.col("ds"))).alias("last_price"))
    rows = series.crossJoin(F.broadcast(ahead)).join(prices, ["unique_id", "wm_yr_wk"], "left")
    return rows.withColumn("sell_price", F.coalesce("sell_price", "last_price")).drop("last_price")


def week_of(ds: Column) -> Column:
    return F.floor(F.datediff(ds, F.lit(WEEK_ZERO)) / 7).cast("int")


def calendar_columns(ds: Column) -> dict[str, Column]:
    """wm_yr_wk, snap, event_name_1 and event_type_1 of the catalogue's calendar."""
    name = kind = F.lit(None).cast("string")
    for month, day, event, event_type in EVENTS:
        on = (F.month(ds) == month) & (F.dayofmonth(ds) == day)
        name, kind = F.when(on, event).otherwise(name), F.when(on, event_type).otherwise(kind)
    return {"wm_yr_wk": week_of(ds), "snap": (F.dayofmonth(ds) <= 10).cast("int"), "event_name_1": name, "event_type_1": kind}


def panel_end(spark: SparkSession, sf_dir: str):
    """The date of the last order: the days after it have shipments of older orders only, so demand is incomplete there."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max(F.col("o_orderdate").cast("date"))).first()[0]


def part_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and revenue (in ten-thousandths, whole numbers) of every line up to the last order's date, with the part as the
    series: the finest key there is, growing with the data."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity", "l_discount", F.col("l_shipdate").cast("date").alias("ds")).where(F.col("ds") <= F.lit(panel_end(spark, sf_dir)))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice").hint("shuffle_hash")
    unit = F.floor(F.col("p_retailprice") * (1 - F.col("l_discount")) * 10_000 + 0.5)
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").cast("string").alias("unique_id"), "ds", F.col("l_quantity").alias("y"), (F.col("l_quantity") * unit).alias("revenue"))


def demand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of order lines: daily quantities from a series' first day to the last order's, weekly prices.

    lineitem is scanned once, shuffled by part (a broadcast of ``part`` would grow with it; a part hardly ships twice a day,
    so sums by part would not make the lines fewer) and then in partial sums of a series' days; a second shuffle of these sums brings a series' days together, where windows fill the gaps and carry prices. Prices are whole 64ths, so that sums of
    quantity times price are exact in any order.
    """
    end = F.lit(panel_end(spark, sf_dir))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity", "l_discount", F.col("l_shipdate").cast("date").alias("ds")).where(F.col("ds") <= end)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("item_id"), F.col("p_type").alias("dept_id"), "p_retailprice").hint("shuffle_hash")
    paid = F.floor(F.col("p_retailprice") * (1 - F.col("l_discount")) * 10_000 + 0.5)  # whole ten-thousandths
    daily = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("item_id", "dept_id", "ds").agg(F.sum("l_quantity").alias("y"), F.sum(paid).alias("paid"), F.count("*").alias("lines"))
    series = Window.partitionBy("item_id", "dept_id")
    next_day = F.lead("ds", 1).over(series.orderBy("ds"))
    gaps = daily.withColumn("until", F.coalesce(F.date_sub(next_day, 1), end)).select("item_id", "dept_id", "y", "paid", "lines", F.posexplode(F.sequence("ds", "until")).alias("gap", "ds"))
    own = lambda c, other: F.when(F.col("gap") == 0, F.col(c)).otherwise(other)
    dense = gaps.select("item_id", "dept_id", "ds", own("y", F.lit(0.0)).alias("y"), own("paid", F.lit(None)).alias("paid"), own("lines", F.lit(None)).alias("lines")).withColumns(calendar_columns(F.col("ds")))
    week = Window.partitionBy("item_id", "dept_id", "wm_yr_wk")
    weekly = dense.withColumns({"w_paid": F.sum("paid").over(week), "w_lines": F.sum("lines").over(week)})
    priced = weekly.withColumn("week_price", F.expr("w_paid * 64 div (w_lines * 10000)") / 64)
    carried = F.last("week_price", ignorenulls=True).over(series.orderBy("ds").rowsBetween(Window.unboundedPreceding, 0))
    return priced.select(F.concat_ws("_", "item_id", "dept_id").alias("unique_id"), "ds", "y", "item_id", "dept_id", "wm_yr_wk", "snap", "event_name_1", "event_type_1", carried.alias("sell_price"))
