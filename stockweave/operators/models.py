"""Fitted forecasters.

GlobalBoosted is one model over all series: boosted trees with a Tweedie loss, fitted anew for every window (see
``boosting``). Every autoregressive feature looks back a week or more, so predicting four blocks of seven days equals
predicting day by day. ETS and SARIMA are per-series models (grouped maps), each chosen by corrected AIC.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stockweave.functions.fitters import ets_forecasts, sarima_forecasts
from stockweave.operators import backtest, boosting, features, metrics
from stockweave.operators.classify import last_day
from stockweave.params import HORIZON, N_CALIB, N_EVAL, N_WINDOWS, SEASON, STATS_DAYS
from stockweave.session import attach, discard, materialize, shuffle_partitions

BOOSTED = "GlobalBoosted"
LAGGED = list(features.AUTOREGRESSIVE)
PRICE = ["sell_price", "price_rel_item", "price_rel_dept", "price_change_7"]
CALENDAR = ["snap", "is_event", "event_name", "event_type", "days_to_event"]
DATES = list(features.DATE_PARTS)
#: Categories, as places in the order of their mean demand up to the earliest cutoff.
CATEGORIES = ("dept_id", "event_name", "event_type", "item_id")
#: What a category belongs to: a series, or a day.
CODED_BY = {"unique_id": ("dept_id", "item_id"), "ds": ("event_name", "event_type")}
COLUMNS = [*LAGGED, *PRICE, *CALENDAR, *DATES, "dept_id", "item_id"]
#: name -> (features left out, features added, variance power)
VARIANTS = {"base": ((), (), 1.1), "con item_id": ((), ("item_id",), 1.1), "sin precio": (PRICE, (), 1.1), "sin calendario": (CALENDAR, (), 1.1), "objetivo Poisson": ((), (), 1.0)}


def feature_columns(leave_out=(), add=()) -> list[str]:
    """A model's columns: all but item_id, which is added where a variant asks for it."""
    return [c for c in COLUMNS if c not in leave_out and (c != "item_id" or c in add)]


def design(panel: DataFrame, future: DataFrame | None = None) -> DataFrame:
    """Exogenous and date features of the panel, and of the days ahead if given (y is null there), written once.

    The features are written before the categories are counted, so that they are worked out once. All categories' places
    are one small table, a row per category and value; those of a series and those of a day are joined back as one table
    each.
    """
    rows = features.exogenous_features(panel) if future is None else features.both_frames(panel, future)
    rows = materialize(features.date_parts(rows), "features")
    end = F.broadcast(last_day(panel, N_WINDOWS * HORIZON))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("category_"), F.col(c).alias("value_")) for c in CATEGORIES])).alias("c")
    early = F.avg(F.when(F.col("ds") <= F.col("end_day"), F.col("y")))
    means = rows.crossJoin(end).select("ds", "end_day", "y", values).groupBy("c.category_", "c.value_").agg(F.coalesce(early, F.lit(0.0)).alias("mean_"))
    means = materialize(means, "categories")
    coded = rows
    for key, names in CODED_BY.items():
        places = F.explode(F.array(*[F.struct(F.lit(c).alias("category_"), F.col(c).alias("value_")) for c in names])).alias("c")
        own = rows.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names]).select(key, places).select(key, "c.*")
        codes = own.join(means, ["category_", "value_"]).groupBy(key).agg(*[F.max(F.when(F.col("category_") == c, F.col("mean_"))).alias(f"{c}_code") for c in names])
        coded = coded.join(codes, key, "left")
    kept = [(F.coalesce(f"{c}_code", F.lit(0.0)) if c in CATEGORIES else F.col(c)).cast("double").alias(c) for c in COLUMNS if c not in LAGGED]
    done = materialize(coded.select("unique_id", "ds", "y", *kept), "design")
    discard(rows)
    return done


def _day(d: dt.date) -> int:
    return (d - dt.date(1970, 1, 1)).days


def fit_models(base: DataFrame, wanted: list[tuple[str, dt.date, list[str], float]], **options) -> tuple[list, list]:
    """(models, bounds) for (name, last day, columns, power) of each wanted model, grown in the same jobs.

    Lags of a row look at earlier rows only, so they hold for every model that learns from the row.
    """
    rows = materialize(features.lag_features(base), "lags")
    first = min(w[1] for w in wanted)
    bounds = boosting.edges(rows.where(F.col("ds") <= F.lit(first)), COLUMNS)
    bins = boosting.written_bins(rows.where("y is not null"), COLUMNS, bounds)
    models = [boosting.Model(name, _day(last), [COLUMNS.index(c) for c in columns], power) for name, last, columns, power in wanted]
    return boosting.fit(bins, models, len(COLUMNS), **options), bounds


def forecasts(base: DataFrame, models: list, bounds: list) -> DataFrame:
    """unique_id, ds, model, yhat: the horizon after each model's last day, in blocks of a week; all models at once.

    A block's rows come back with what was predicted as their demand, for the lags of later blocks: no join brings it back.
    """
    spark = base.sparkSession
    ends = spark.createDataFrame([(m.name, dt.date(1970, 1, 1) + dt.timedelta(m.last)) for m in models], "model string, cutoff date")  # a row per model
    near = base.join(F.broadcast(ends), (F.col("ds") > F.date_sub("cutoff", 60)) & (F.col("ds") <= F.date_add("cutoff", HORIZON)))
    # a series of a model is a series of its own while lags are worked out
    known = near.withColumns({"y": F.when(F.col("ds") <= F.col("cutoff"), F.col("y")), "own_id": F.col("unique_id"), "unique_id": F.concat_ws("|", "model", "unique_id"), "step": F.datediff("ds", "cutoff")})
    known = materialize(known, "horizon")
    done = None
    for block in range(HORIZON // SEASON):
        lagged = features.lag_features(known).where(F.col("step").between(block * SEASON + 1, (block + 1) * SEASON))
        got = boosting.predict(boosting.binned(lagged, COLUMNS, bounds, "model", "unique_id", "own_id", "ds", "step"), models, len(COLUMNS))
        got = materialize(got, f"block-{block}")
        done = got if done is None else done.unionByName(got)
        rest = known.where(~F.col("step").between(block * SEASON + 1, (block + 1) * SEASON))
        known = rest.unionByName(got.withColumnRenamed("yhat", "y"), allowMissingColumns=True)
    return done.select(F.col("own_id").alias("unique_id"), "ds", "model", "yhat")


def _cutoffs(panel: DataFrame, n_windows: int = N_WINDOWS) -> list:
    return [(r["window"], r["cutoff"]) for r in backtest.cutoffs(panel, n_windows).orderBy("window").collect()]  # a row per window


def global_model(panel: DataFrame, future: DataFrame | None = None, n_windows: int = N_WINDOWS, **options) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(backtest, forecast of the days ahead or None, importance) of the boosted model; a model a window, one on all days.

    backtest: unique_id, ds, cutoff, step, window, model, y, yhat. forecast: unique_id, ds, yhat. importance: feature,
    gain, gain_share of the model on all days.
    """
    base = design(panel, future)
    windows = _cutoffs(panel, n_windows)
    last = last_day(panel).first()[0]
    names = {str(c): (k, c) for k, c in windows}
    models, bounds = fit_models(base, [*((n, c, feature_columns(), 1.1) for n, (_, c) in names.items()), ("final", last, feature_columns(), 1.1)], **options)
    ahead = forecasts(base, models if future is not None else models[:-1], bounds)
    test = backtest.windows(panel, n_windows).select("unique_id", "ds", "cutoff", "step", "window", "y")
    cv = test.join(ahead.where("model <> 'final'").withColumn("cutoff", F.col("model").cast("date")).drop("model"), ["unique_id", "ds", "cutoff"])
    cv = cv.select("unique_id", "ds", "cutoff", "step", "window", F.lit(BOOSTED).alias("model"), "y", "yhat")
    gains = {COLUMNS[f]: g for f, g in models[-1].gains.items()}
    total = sum(gains.values()) or 1.0
    rows = [(c, gains.get(c, 0.0), gains.get(c, 0.0) / total) for c in feature_columns()]
    importance = panel.sparkSession.createDataFrame(rows, "feature string, gain double, gain_share double")
    return cv, ahead.where("model = 'final'").drop("model") if future is not None else None, importance


def ablation(panel: DataFrame, **options) -> DataFrame:
    """variant, wrmsse, wape, bias, seconds, wrmsse_vs_base: means over the N_CALIB calibration windows of the panel cut at
    the evaluation's start. All variants grow in the same jobs; seconds is the time that tasks spent on a variant's models."""
    end = last_day(panel, N_EVAL * HORIZON).first()[0]
    early = panel.where(F.col("ds") <= F.lit(end))
    dept = early.groupBy("unique_id").agg(F.first("dept_id").alias("dept_id"))
    windows = _cutoffs(early, N_CALIB)
    wanted = [(f"{name}|{c}", c, feature_columns(out, add), power) for name, (out, add, power) in VARIANTS.items() for _, c in windows]
    base = design(early)
    models, bounds = fit_models(base, wanted, **options)
    got = forecasts(base, models, bounds)
    name = F.split("model", r"\|")
    held = early.where(F.col("ds") > F.lit(min(c for _, c in windows))).select("unique_id", "ds", "y")  # the windows' days
    cv = got.select("unique_id", "ds", name[0].alias("model"), name[1].cast("date").alias("cutoff"), "yhat").join(held, ["unique_id", "ds"]).join(dept, "unique_id")
    cv = materialize(cv, "ablation")
    score = metrics.wrmsse(metrics.rmsse_by_level(early, cv, backtest.cutoffs(early, N_CALIB))).where("level = 'WRMSSE'").groupBy("model").agg(F.avg("value").alias("wrmsse"))
    rows = {r["model"]: r for r in score.join(metrics.point_metrics(cv, "model"), "model").collect()}  # a row per variant
    first = rows["base"]["wrmsse"]
    seconds = {n: sum(m.seconds for m in models if m.name.split("|")[0] == n) for n in VARIANTS}
    out = [(n, rows[n]["wrmsse"], rows[n]["wape"], rows[n]["bias"], seconds[n], rows[n]["wrmsse"] / first - 1 if first else None) for n in VARIANTS]
    return panel.sparkSession.createDataFrame(out, "variant string, wrmsse double, wape double, bias double, seconds double, wrmsse_vs_base double")


# ---- per-series models

FITTERS = {"ets": ("ETS", ets_forecasts), "sar": ("SARIMA", sarima_forecasts)}
#: Series that a task fits together.
PACK = 64


def series_backtest(panel: DataFrame, kind: str, n_windows: int = N_WINDOWS, days: int = STATS_DAYS, counts: Observation | None = None) -> DataFrame:
    """A per-series model over all windows, on at most ``days`` days of history before each cutoff.

    A series' days are gathered once for all windows; a task fits packs of series and windows together. What cannot be
    fitted falls back to the same weekday of the last week; fits and failed ones are counted by ``counts``, and failed
    ones are marked in the column failed.
    """
    attach(panel.sparkSession)
    name, forecasts_of = FITTERS[kind]
    test = backtest.windows(panel, n_windows).select("unique_id", "ds", "cutoff", "step", "window", "y")
    end = last_day(panel)
    own = panel.select("unique_id", F.datediff("ds", F.lit("1970-01-01").cast("date")).alias("day"), F.col("y").cast("double").alias("y")).crossJoin(F.broadcast(end))
    last = F.datediff("end_day", F.lit("1970-01-01").cast("date"))
    recent = own.withColumn("last", last).where(F.col("day") > F.col("last") - n_windows * HORIZON - days)
    gathered = recent.groupBy("unique_id", "last").agg(F.array_sort(F.collect_list(F.struct("day", "y"))).alias("p"))
    packs = gathered.select("unique_id", "last", F.transform("p", lambda x: x["day"]).alias("days"), F.transform("p", lambda x: x["y"]).alias("values"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, PACK):
                ids, ends, ds, ys = (c.to_pylist() for c in batch.slice(lo, PACK).columns)
                keys, histories = [], []
                for u, z, d, y in zip(ids, ends, ds, ys, strict=True):
                    d, y = np.array(d), np.array(y, float)
                    for w in range(n_windows):
                        cut = z - (w + 1) * HORIZON
                        mine = y[(d <= cut) & (d > cut - days)]
                        if len(mine):
                            keys.append((u, w))
                            histories.append(mine)
                fore, chosen = forecasts_of(histories)
                failed = [c is None for c in chosen]
                for k in np.flatnonzero(failed):
                    fore[k] = np.resize(histories[k][-SEASON:], HORIZON)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(fore.tolist(), pa.list_(pa.float64())), pa.array(failed, pa.bool_())], ["unique_id", "window", "path", "failed"])

    got = packs.repartition(2 * shuffle_partitions(panel.sparkSession), "unique_id").mapInArrow(run, "unique_id string, window int, path array<double>, failed boolean")
    if counts is not None:
        got = got.observe(counts, F.count("*").alias("fits"), F.count_if("failed").alias("failed"))
    ahead = got.select("unique_id", "window", "failed", F.posexplode("path").alias("at", "yhat")).withColumn("step", F.col("at") + 1).drop("at")
    return test.join(ahead, ["unique_id", "window", "step"]).select("unique_id", "ds", "cutoff", "step", "window", F.lit(name).alias("model"), "y", "yhat", "failed")
