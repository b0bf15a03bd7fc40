"""What the driver gathers for broadcasts stays small: no table of the input is broadcast, and features are worked out once."""

import datetime as dt

import numpy as np
import pytest

from stockweave.operators import boosting, models
from stockweave.plans import outputs
from stockweave.session import materialize
from stockweave.sources import panel as panels

DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [panels.demand_panel, panels.part_sales])
def test_parts_are_not_broadcast(spark, rows):
    plan = _plan(rows(spark, DIR))
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_the_boosted_model_broadcasts_little(spark, monkeypatch):
    """Over all tables that design and forecasts write: a broadcast by day and one by category of the design, none of the
    forecasts but their last days (no hash join)."""
    p = materialize(panels.demand_panel(spark, DIR), "panel")
    future = materialize(outputs.with_future(p), "future")
    plans: list[str] = []
    keep = lambda df, name: (plans.append(_plan(df)), materialize(df, name))[1]
    monkeypatch.setattr(models, "materialize", keep)
    base = models.design(p, future)
    assert sum(x.count("BroadcastHashJoin") for x in plans) <= 4
    plans.clear()
    last = (dt.date(2001, 1, 1) - dt.date(1970, 1, 1)).days
    model = boosting.Model("a", last, list(range(len(models.COLUMNS))), base=1.0)
    bounds = [np.array([1.0])] * len(models.COLUMNS)
    got = models.forecasts(base, [model], bounds)
    assert len(plans) == 5 and not any("BroadcastHashJoin" in x for x in plans)
    n = base.select("unique_id").distinct().count()
    assert got.count() == 28 * n
