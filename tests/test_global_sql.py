"""What follows the boosted model, against SQL that reads the model's stored forecasts in place of one simple model's."""

import os

import duckdb
import pandas as pd
import pytest

from stockweave import params
from stockweave.operators import models
from stockweave.plans import outputs
from stockweave.plans.catalogue import ORACLES, QUERIES
from stockweave.plans.oracles import CTES

DIR = "/root/testdata/sf0.001"
BOOSTED = "SELECT t.*, 'GlobalBoosted' AS model, g.yhat FROM test t JOIN cv_global g ON g.unique_id = t.unique_id AND g.ds = t.ds AND g.cutoff = t.cutoff"


@pytest.fixture(scope="module")
def con(spark, tmp_path_factory):
    """DuckDB with the tables and cv_global, as the queries store it; the model is small, which SQL does not see."""
    before = dict(params.CATALOGUE_TREES)
    params.CATALOGUE_TREES.update(rounds=2, leaves=6, rate=0.3)
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    QUERIES["global_tweedie_cv"](spark, DIR)
    folder = f"{tmp_path_factory.mktemp('stored')}/cv"
    outputs.stored(spark, DIR, "cv_global", dict).write.parquet(folder)
    c.execute(f"CREATE VIEW cv_global AS SELECT * FROM '{folder}/*.parquet'")
    yield c
    params.CATALOGUE_TREES.clear()
    params.CATALOGUE_TREES.update(before)


def stated(name, only_seasonal, **renamed):
    """The SQL of a query on simple models with the boosted one beside them, or beside the seasonal one only."""
    own = f"SELECT * FROM ({CTES['cv']}) WHERE model = 'SeasonalNaive'" if only_seasonal else CTES["cv"]
    before, _, after = ORACLES[name].partition(CTES["cv"])
    assert after
    for a, b in renamed.items():
        after = after.replace(a, b)
    return f"{before}{own} UNION ALL {BOOSTED}{after}"


@pytest.mark.parametrize(
    ("name", "like", "only_seasonal", "renamed"),
    [
        ("global_wrmsse", "wrmsse", False, {}),
        ("global_versus_best", "versus_best", False, {"MediaMovil28": models.BOOSTED}),
        ("global_scenario_grid", "scenario_grid", True, {}),
        ("global_cost_sensitivity", "cost_sensitivity", True, {"MediaMovil28": models.BOOSTED, "inv_average": "inv_boosted"}),
    ],
)
def test_query(spark, con, name, like, only_seasonal, renamed):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(stated(like, only_seasonal, **renamed)).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    keys = sorted(want.columns, key=lambda c: (pd.api.types.is_float_dtype(want[c]), c))
    for f in (got, want):
        for c in keys:
            if f[c].dtype.kind == "M" or f[c].map(lambda v: hasattr(v, "year")).any():
                f[c] = pd.to_datetime(f[c])
    got, want = (f[keys].sort_values(keys, na_position="first").reset_index(drop=True) for f in (got, want))
    for c in keys:
        if want[c].dtype.kind in "fiu":
            pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_names=False, atol=2e-2, rtol=1e-6)
        else:
            assert got[c].fillna("").tolist() == want[c].fillna("").tolist()


def test_intervals_of_the_forecast(spark, con):
    """Margins are quantiles of the stored residuals at their finite-sample levels."""
    got = QUERIES["forecast_future"](spark, DIR).toPandas()
    errors = con.execute("SELECT unique_id, list(y - yhat ORDER BY y - yhat) AS e FROM cv_global GROUP BY 1").df().set_index("unique_id").e
    assert len(got) == 28 * len(errors)
    for u, rows in got.groupby("unique_id"):
        e = pd.Series(errors[u])
        n = len(e)
        for level in params.INTERVAL_LEVELS:
            tail = (1 - level / 100) / 2
            import math

            hi = min(1.0, math.ceil(round((n + 1) * (1 - tail), 9)) / n)
            lo = max(0.0, 1 - math.ceil(round((n + 1) * (1 - tail), 9)) / n)
            assert (rows[f"{level}_hi"] - (rows.yhat + e.quantile(hi)).clip(lower=0)).abs().max() < 1e-4
            assert (rows[f"{level}_lo"] - (rows.yhat + e.quantile(lo)).clip(lower=0)).abs().max() < 1e-4
