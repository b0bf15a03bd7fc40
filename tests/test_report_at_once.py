"""What the report and the grids read several times is worked out once, and the report's two fits run at once."""

import threading
from collections import Counter

import pytest

from stockweave import params, session
from stockweave.operators import classify, models, policy
from stockweave.plans import outputs, report
from stockweave.plans.catalogue import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def small(monkeypatch):
    for k, v in {"rounds": 1, "leaves": 4, "rate": 0.3}.items():
        monkeypatch.setitem(params.CATALOGUE_TREES, k, v)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scenarios_are_simulated_once(spark, small):
    """The figures of a grid are read, not simulated for the scenarios' names and again for their values."""
    assert "MapInArrow" not in _plan(QUERIES["scenario_grid"](spark, DIR))


def test_all_models_are_worked_out_once(spark, small):
    """Neither evaluation's plan holds the simple forecasts, which the check for gaps would work out a second time."""
    for name in ("global_wrmsse", "global_versus_best"):
        assert "max_by(y" not in _plan(QUERIES[name](spark, DIR))


def test_report_shares_its_steps(spark, small, monkeypatch):
    session.release(spark)
    calls, both = Counter(), threading.Barrier(2)

    def counted(module, name, wait=False):
        f = getattr(module, name)

        def run(*args, **options):
            calls[name] += 1
            if wait:
                both.wait(120)  # breaks if the other fit begins only after this one has ended
            return f(*args, **options)

        monkeypatch.setattr(module, name, run)

    counted(outputs, "boosted", wait=True)
    counted(models, "ablation", wait=True)
    for module, name in ((policy, "forecast_basis"), (policy, "classic_basis"), (policy, "evaluation_demand"), (classify, "classify")):
        counted(module, name)
    got = QUERIES["report_datasets"](spark, DIR)
    assert {r["dataset"] for r in got.select("dataset").distinct().collect()} == set(report.DATASETS)
    assert all(n == 1 for n in calls.values()) and len(calls) == 6


def test_side_by_side_keeps_order_and_errors(spark):
    assert session.side_by_side(spark, [lambda k=k: spark.range(k).count() for k in range(6)]) == list(range(6))
    with pytest.raises(ZeroDivisionError):
        session.side_by_side(spark, [lambda: 1, lambda: 1 // 0])
