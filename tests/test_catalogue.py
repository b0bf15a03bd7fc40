"""Every catalogue query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from stockweave.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {n for n in QUERIES if n.startswith("global_")} | {"ets_cv", "sar_cv", "feature_importance", "forecast_future", "report_datasets", "ablation"}
#: The slow ones and those that share all of their plan with another are left to the correctness run.
CHECKED = [n for n in ORACLES if n not in {"cost_sensitivity", "cost_pivot", "scenario_report", "wrmsse_report", "model_wins", "best_model_by_segment", "fc_naive", "fc_seasonal_naive", "fc_window_average", "sales_long", "calendar_features", "savings_by_target", "method_comparison", "service_curve", "nominal_service", "frontier", "scenario_grid", "missing_by_class", "planner_table", "rmsse_by_level", "segment_table"}]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def test_all_have_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    keys = sorted(want.columns, key=lambda c: (pd.api.types.is_float_dtype(want[c]), c))
    for f in (got, want):
        for c in keys:
            if f[c].dtype.kind == "M" or f[c].map(lambda v: hasattr(v, "year")).any():
                f[c] = pd.to_datetime(f[c])
    got, want = (f[keys].sort_values(keys, na_position="first").reset_index(drop=True) for f in (got, want))
    assert len(got) == len(want)
    for c in keys:
        if want[c].dtype.kind in "fiu":
            pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_names=False, atol=2e-6, rtol=1e-9)
        else:
            assert got[c].fillna("").tolist() == want[c].fillna("").tolist()
