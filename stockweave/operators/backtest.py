"""Rolling-origin backtests in long form: unique_id, ds, cutoff, step, window, model, y, yhat.

Windows of HORIZON days do not overlap and end at the panel's last day; window 0 is the newest. The cutoff of a
day follows from its distance to that last day, so no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.functions.expr import not_negative
from stockweave.operators.classify import last_day
from stockweave.params import HORIZON, N_EVAL, N_WINDOWS, SEASON

NAIVE, SEASONAL, AVERAGE = "Naive", "SeasonalNaive", "MediaMovil28"
KEYS = ["unique_id", "ds", "cutoff"]


def windows(panel: DataFrame, n_windows: int = N_WINDOWS, horizon: int = HORIZON) -> DataFrame:
    """The days of the backtest with their window, cutoff and step."""
    end = F.broadcast(last_day(panel))
    rows = panel.crossJoin(end).where(f"ds > date_sub(end_day, {n_windows * horizon})")
    rows = rows.withColumn("window", F.floor(F.datediff("end_day", "ds") / horizon).cast("int"))
    return rows.withColumn("cutoff", F.date_sub("end_day", (F.col("window") + 1) * horizon)).withColumn("step", F.datediff("ds", "cutoff")).drop("end_day")


def cutoffs(panel: DataFrame, n_windows: int = N_WINDOWS, horizon: int = HORIZON, n_eval: int = N_EVAL) -> DataFrame:
    """One row per window: window, cutoff, first and last test day, split."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("window")
    out = last_day(panel).select("end_day", k).withColumn("cutoff", F.date_sub("end_day", (F.col("window") + 1) * horizon))
    return out.select("window", "cutoff", F.date_add("cutoff", 1).alias("first_day"), F.date_add("cutoff", horizon).alias("last_day"), split_of(F.col("window"), n_eval).alias("split"))


def split_of(window, n_eval: int = N_EVAL):
    return F.when(window < n_eval, "eval").otherwise("calib")


def simple_forecasts(panel: DataFrame, n_windows: int = N_WINDOWS, horizon: int = HORIZON) -> DataFrame:
    """Last value, same weekday of the last week, and mean of the last 28 days, for every window.

    What a window needs from the past is the 28 days before its cutoff: one grouping by series and cutoff, one
    join on the same keys.
    """
    test = windows(panel, n_windows, horizon).select("unique_id", "ds", "cutoff", "step", "window", "y")
    past = windows(panel, n_windows + 1, horizon).where("window > 0").withColumn("cutoff", F.date_add("cutoff", horizon))
    base = past.groupBy("unique_id", "cutoff").agg(
        F.max_by("y", "ds").alias(NAIVE), F.avg("y").alias(AVERAGE), F.array_sort(F.collect_list(F.when(F.col("step") > horizon - SEASON, F.struct("ds", "y")))).alias("week")
    )
    joined = test.join(base, ["unique_id", "cutoff"])
    seasonal = F.get("week", F.pmod(F.col("step") - 1, F.lit(SEASON)))["y"]
    values = F.array(*[F.struct(F.lit(n).alias("model"), not_negative(v).alias("yhat")) for n, v in ((NAIVE, F.col(NAIVE)), (SEASONAL, seasonal), (AVERAGE, F.col(AVERAGE)))])
    return joined.select("unique_id", "ds", "cutoff", "step", "window", "y", F.explode(values).alias("m")).select("unique_id", "ds", "cutoff", "step", "window", "m.model", "y", "m.yhat")


def with_fallback(cv: DataFrame, fallback: DataFrame) -> DataFrame:
    """A model's missing values replaced by the fallback model's."""
    other = fallback.select(*KEYS, F.col("yhat").alias("fallback"))
    return cv.join(other, KEYS, "left").withColumn("yhat", F.coalesce("yhat", "fallback")).drop("fallback")


def to_wide(cv: DataFrame, models: list[str]) -> DataFrame:
    """One column per model, null where a model has no value: the full outer join of the models."""
    return cv.groupBy(*KEYS).pivot("model", models).agg(F.first("yhat")).join(cv.groupBy(*KEYS).agg(F.max("y").alias("y")), KEYS)


def to_long(wide: DataFrame, models: list[str]) -> DataFrame:
    return wide.unpivot([*KEYS, "y"], models, "model", "yhat")


def complete_models(cv: DataFrame) -> DataFrame:
    """Keeps a model in a window only if none of its values is missing there."""
    sound = cv.groupBy("cutoff", "model").agg((F.count("yhat") == F.count("*")).alias("sound")).where("sound").select("cutoff", "model")
    return cv.join(F.broadcast(sound), ["cutoff", "model"], "left_semi")  # a row per window and model
