"""The catalogue's boosted model grows all its trees, and trees grown by blocks of rows are those of plain sums."""

import numpy as np
import pytest

from stockweave import session
from stockweave.operators import boosting
from stockweave.plans.catalogue import QUERIES
from stockweave.session import materialize

DIR = "/root/testdata/sf0.001"


class Stopped(Exception):
    pass


@pytest.mark.parametrize("name", ["forecast_future", "ablation"])
def test_the_catalogue_grows_all_trees(spark, monkeypatch, name):
    session.release(spark)

    def fit(rows, found, n_features, rounds=boosting.ROUNDS, leaves=boosting.LEAVES, rate=boosting.RATE, min_rows=boosting.MIN_ROWS, row_share=boosting.ROW_SHARE, feature_share=boosting.FEATURE_SHARE):
        raise Stopped(rounds, leaves, rate, min_rows, row_share, feature_share)

    monkeypatch.setattr(boosting, "fit", fit)
    with pytest.raises(Stopped) as seen:
        QUERIES[name](spark, DIR)
    assert seen.value.args == (600, 63, 0.05, 50, 0.8, 0.8)


def _grown(spark, **options):
    rng = np.random.default_rng(4)
    bins, y, day = rng.integers(0, 9, (1400, 3), dtype=np.uint8), rng.poisson(2, 1400).astype(float), rng.integers(0, 10, 1400)
    y += bins[:, 0] * (bins[:, 1] > 4)
    key = rng.integers(-(1 << 62), 1 << 62, 1400)
    data = [(float(a), int(d), int(k), bytearray(b.tobytes())) for a, d, k, b in zip(y, day, key, bins, strict=True)]
    rows = materialize(spark.createDataFrame(data, "y double, day int, key long, bins binary"), "rows")
    found = [boosting.Model("a", 9, [0, 1, 2]), boosting.Model("b", 4, [1, 2])]
    return boosting.fit(rows, found, 3, **options), np.ascontiguousarray(bins.T), y, day, key


def test_leaves_have_the_values_of_their_rows(spark):
    """Those of the last splits too, which no job sums."""
    models, bins, y, day, key = _grown(spark, rounds=1, leaves=6, rate=0.2)
    for model in models:
        own = boosting.sampled(key, 0, boosting.ROW_SHARE) & (day <= model.last)
        g, h = model.slopes(y, np.full(len(y), model.base))
        tree = model.trees[0]
        assert tree.feature.count(-1) == 6
        place = tree.places(bins)
        for leaf in [k for k, f in enumerate(tree.feature) if f < 0]:
            at = own & (place == leaf)
            assert at.sum() >= boosting.MIN_ROWS
            assert tree.value[leaf] == pytest.approx(-0.2 * g[at].sum() / (h[at].sum() + boosting.RIDGE))


def test_reach_agrees_with_places(spark):
    models, bins, *_ = _grown(spark, rounds=2, leaves=7)
    rows = np.arange(3, bins.shape[1], 2)
    for tree in [t for m in models for t in m.trees]:
        ends = [k for k, f in enumerate(tree.feature) if f < 0]
        place = tree.places(bins)
        for leaf, at in zip(ends[1:], tree.reach(bins, rows, ends[1:]), strict=True):
            assert sorted(at) == [i for i in rows if place[i] == leaf]


def test_no_rows_to_learn_from(spark):
    rows = materialize(spark.createDataFrame([], "y double, day int, key long, bins binary"), "rows")
    model = boosting.fit(rows, [boosting.Model("a", 9, [0])], 1, rounds=2)[0]
    assert [t.feature for t in model.trees] == [[-1], [-1]] and [t.value for t in model.trees] == [[0.0], [0.0]]
