"""Point metrics and scale-free hierarchical errors. Windows and models are keys, so nothing loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions.expr import ratio
from stockweave.operators.backtest import complete_models, split_of
from stockweave.params import HORIZON
from stockweave.session import materialize

GROUPINGS = ("abc", "xyz", "segment", "pattern", "dept_id")


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(y - f))


def rmse(y: Column, f: Column) -> Column:
    return F.sqrt(F.avg((y - f) ** 2))


def wape(y: Column, f: Column) -> Column:
    return ratio(F.sum(F.abs(y - f)), F.sum(F.abs(y)))


def bias(y: Column, f: Column) -> Column:
    return F.when(F.sum(y) > 0, F.sum(f - y) / F.nullif(F.sum(y), F.lit(0.0)))


def point_metrics(cv: DataFrame, *keys: str) -> DataFrame:
    y, f = F.col("y"), F.col("yhat")
    return cv.groupBy(*keys).agg(mae(y, f).alias("mae"), rmse(y, f).alias("rmse"), wape(y, f).alias("wape"), bias(y, f).alias("bias"))


def _levels() -> Column:
    pairs = (("total", F.lit("total")), ("dept", F.col("dept_id")), ("sku", F.col("unique_id")))
    return F.explode(F.array(*[F.struct(F.lit(n).alias("level"), k.alias("key")) for n, k in pairs])).alias("l")


def by_level(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Sums per level (total, dept, sku), its key and further keys; partial sums come before the shuffle."""
    return rows.select("*", _levels()).groupBy("l.level", "l.key", *keys).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def scales(panel: DataFrame, cut: DataFrame) -> DataFrame:
    """level, key, cutoff -> scale (mean squared daily change from the first sale on) and weight (revenue of the last 28 days).

    Running sums give every cutoff's value in one pass over the days of a level.
    """
    daily = by_level(panel, ["ds"], y=F.col("y"), revenue=F.col("y") * F.col("sell_price"))
    key = Window.partitionBy("level", "key")
    by_day = key.orderBy("ds")
    upto, month = by_day.rowsBetween(Window.unboundedPreceding, 0), by_day.rowsBetween(-(HORIZON - 1), 0)
    first = F.min(F.when(F.col("y") != 0, F.col("ds"))).over(key)
    change = daily.withColumns({"change": F.when(F.col("ds") > first, F.col("y") - F.lag("y").over(by_day))})
    run = change.withColumns({"squares": F.sum(F.col("change") ** 2).over(upto), "n": F.count("change").over(upto), "weight": F.sum("revenue").over(month)})
    at = run.join(F.broadcast(cut.select(F.col("cutoff").alias("ds"))), "ds")  # a row per window
    scale = F.nullif(F.col("squares") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    return at.select("level", "key", F.col("ds").alias("cutoff"), scale.alias("scale"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def rmsse_by_level(panel: DataFrame, cv: DataFrame, cut: DataFrame) -> DataFrame:
    """level, key, cutoff, model, rmsse, weight. cv carries dept_id."""
    daily = by_level(cv, ["cutoff", "model", "ds"], y=F.col("y"), yhat=F.col("yhat"))
    mse = daily.groupBy("level", "key", "cutoff", "model").agg(F.avg((F.col("y") - F.col("yhat")) ** 2).alias("mse"))
    return mse.join(scales(panel, cut), ["level", "key", "cutoff"], "left").select("level", "key", "cutoff", "model", F.sqrt(F.col("mse") / F.col("scale")).alias("rmsse"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def wrmsse(rmsse: DataFrame) -> DataFrame:
    """level, cutoff, model, value: weighted per level over series that every model is defined for; the row WRMSSE is the mean of the levels."""
    whole = Window.partitionBy("level", "key", "cutoff")
    sound = rmsse.withColumn("undefined", F.sum(F.col("rmsse").isNull().cast("int")).over(whole)).where("undefined = 0")
    levels = sound.groupBy("level", "cutoff", "model").agg(ratio(F.sum(F.col("weight") * F.col("rmsse")), F.sum("weight")).alias("value"))
    return levels.unionByName(levels.groupBy("cutoff", "model").agg(F.avg("value").alias("value")).select(F.lit("WRMSSE").alias("level"), "cutoff", "model", "value"))


def sku_metrics(cv: DataFrame, rmsse: DataFrame) -> DataFrame:
    """Per series, window and model: demand, abs_err, err, mae, rmsse, split."""
    y, f = F.col("y"), F.col("yhat")
    rows = cv.groupBy("unique_id", "cutoff", "model").agg(F.max("window").alias("window"), F.sum(y).alias("demand"), F.sum(F.abs(y - f)).alias("abs_err"), F.sum(f - y).alias("err"), mae(y, f).alias("mae"))
    own = rmsse.where("level = 'sku'").select(F.col("key").alias("unique_id"), "cutoff", "model", "rmsse")
    return rows.join(own, ["unique_id", "cutoff", "model"], "left").withColumn("split", split_of(F.col("window"))).drop("window")


def segment_table(by_sku: DataFrame, classes: DataFrame) -> DataFrame:
    """Total and five groupings in one pass: ratios of sums for wape and bias, plain means for mae and rmsse.

    classes carries dept_id.
    """
    rows = by_sku.join(classes.select("unique_id", *GROUPINGS), "unique_id", "left")
    groups = F.array(F.struct(F.lit("total").alias("grouping"), F.lit("total").alias("group")), *[F.struct(F.lit(g.removesuffix("_id")).alias("grouping"), F.col(g).alias("group")) for g in GROUPINGS])
    return rows.select("*", F.explode(groups).alias("g")).groupBy("split", "g.grouping", "g.group", "model").agg(
        F.countDistinct("unique_id").alias("n_skus"), F.sum("demand").alias("demand"), F.avg("mae").alias("mae"),
        ratio(F.sum("abs_err"), F.sum("demand")).alias("wape"), ratio(F.sum("err"), F.sum("demand")).alias("bias"), F.avg("rmsse").alias("rmsse"),
    )


def best_model(segments: DataFrame, split: str = "eval") -> DataFrame:
    """The model with the least wape of every group; equal ones by name."""
    rows = segments.where(F.col("split") == split)
    return rows.groupBy("grouping", "group").agg(F.min_by("model", F.struct("wape", "model")).alias("model"), F.min("wape").alias("wape"))


def horizon_error(cv: DataFrame) -> DataFrame:
    """wape by step and model, on evaluation windows."""
    return cv.where(split_of(F.col("window")) == "eval").groupBy("step", "model").agg(wape(F.col("y"), F.col("yhat")).alias("wape"))


def wins_everywhere(scores: DataFrame) -> DataFrame:
    """Per model: is its WRMSSE the least in every evaluation window?"""
    best = Window.partitionBy("cutoff")
    return scores.where("level = 'WRMSSE'").withColumn("least", F.min("value").over(best)).groupBy("model").agg(F.avg("value").alias("mean_value"), F.bool_and(F.col("value") <= F.col("least")).alias("wins_all"))


def evaluate(panel: DataFrame, cv: DataFrame, cut: DataFrame, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """(wrmsse table, sku table) of a backtest in long form that carries dept_id. written: errors and sku table are written
    once, for callers that read both tables or one of them several times."""
    sound = complete_models(cv)
    errors = rmsse_by_level(panel, sound, cut)
    if written:
        errors = materialize(errors, "errors")
        return wrmsse(errors), materialize(sku_metrics(sound, errors), "by-sku")
    return wrmsse(errors), sku_metrics(sound, errors)
