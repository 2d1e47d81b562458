"""Boosted trees: splits against a search over all cuts, whole models on one core and on many, and what they learn."""

import numpy as np
import pytest

from driftloom.learning import boost
from driftloom.learning.boost import BoostParams, Boosted, fit_arrays, fit_boosted


def table(n=300, seed=0, holes=0.15):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)) * 3) / 3
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) | (rng.random(n) < 0.1)).astype(float)
    x[rng.random((n, 4)) < holes] = np.nan
    x[y == 1, 2] = np.where(rng.random(int(y.sum())) < 0.3, np.nan, x[y == 1, 2])  # that it is missing tells something
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(int(t), *(None if np.isnan(v) else float(v) for v in row)) for t, row in zip(y, x)], "y int, " + ", ".join(f"x{k} double" for k in range(x.shape[1])))


def search(x, g, h, p):
    """The best cut of all features and values, missing values on either side."""
    best = None
    for f in range(x.shape[1]):
        known = np.unique(x[~np.isnan(x[:, f]), f])
        for v in known:  # the last parts known values from missing ones
            for missing_left in (True, False):
                left = np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= v)
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                if hl >= p.least_child and hr >= p.least_child:
                    gain = (gl**2 / (hl + p.l2) + gr**2 / (hr + p.l2) - (gl + gr) ** 2 / (hl + hr + p.l2)) / 2 - p.gamma
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-10):
                        best = (gain, f, v, missing_left)
    return best


@pytest.mark.parametrize("p", [BoostParams(trees=3, depth=3), BoostParams(trees=2, depth=2, l2=0.1, gamma=0.5, least_child=4.0)])
def test_splits_equal_a_search_over_all_cuts(p):
    x, y = table()
    model = fit_arrays(x, y, np.ones(len(y)), p)
    margin = np.full(len(y), model.base)
    bins = model.binned(x)
    for tree in model.trees:
        g, h = boost.slopes(margin, y, np.ones(len(y)))
        for node in range(2**p.depth - 1):
            partial = boost.Tree(tree.feature.copy(), tree.bin, tree.left, tree.value, tree.gain)
            partial.feature[node] = -1
            rows = partial.nodes(bins, model.missing, p.depth) == node
            if not rows.any() or (node and tree.feature[(node - 1) // 2] < 0):
                continue
            want = search(x[rows], g[rows], h[rows], p)
            if want is None:
                assert tree.feature[node] == -1
                assert tree.value[node] == pytest.approx(-p.rate * g[rows].sum() / (h[rows].sum() + p.l2))
                continue
            f = tree.feature[node]
            cut = np.append(model.edges[f], np.inf)[min(tree.bin[node], len(model.edges[f]))]
            assert tree.gain[node] == pytest.approx(want[0], rel=1e-9)
            left = np.where(np.isnan(x[rows, f]), tree.left[node], x[rows, f] <= cut)
            same = np.where(np.isnan(x[rows, want[1]]), want[3], x[rows, want[1]] <= want[2])
            assert f == want[1] and ((left == same).all() or (left != same).all())  # the two sides may change places
        margin += model.added(bins, [tree])


@pytest.mark.parametrize("more", [{}, {"columns": 0.5}, {"trees": 11, "depth": 2}])
def test_a_model_of_many_tasks_equals_one_in_memory(spark, more):
    x, y = table(seed=3)
    p = BoostParams(**{"trees": 4, "depth": 3, **more})
    a, b = fit_arrays(x, y, np.ones(len(y)), p), fit_boosted(frame(spark, x, y).repartition(5), [f"x{k}" for k in range(4)], p)
    assert a.base == pytest.approx(b.base) and all((s == t).all() for s, t in zip(a.edges, b.edges))
    for s, t in zip(a.trees, b.trees):
        assert (s.feature == t.feature).all() and (s.bin == t.bin).all() and (s.left == t.left).all() and s.value == pytest.approx(t.value)
    got = sorted(r["prob"] for r in b.score(frame(spark, x, y)).collect())
    assert got == pytest.approx(sorted(a.predict(x)))


def test_it_learns_what_no_line_can(spark):
    x, y = table(2000, 5)
    rows = np.arange(2000) < 1500
    for model in (fit_arrays(x[rows], y[rows], np.ones(1500)), fit_boosted(frame(spark, x[rows], y[rows]), [f"x{k}" for k in range(4)], BoostParams(trees=10, rate=0.3, subsample=0.7))):
        q = model.predict(x[~rows])
        above = (q[y[~rows] == 1][:, None] > q[y[~rows] == 0]).mean()
        assert above > 0.8
    loss = [-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean() for q in (fit_arrays(x, y, np.ones(2000), BoostParams(trees=k)).predict(x) for k in (1, 10, 40))]
    assert loss[0] > loss[1] > loss[2]


def test_models_come_back_from_text_and_stand_odd_tables(spark):
    x, y = table(50)
    a = fit_arrays(x, y, np.ones(50), BoostParams(trees=3))
    assert Boosted.from_json(a.to_json()).predict(x) == pytest.approx(a.predict(x))
    one = fit_boosted(frame(spark, x[:5], np.ones(5)), ["x0"], BoostParams(trees=2))
    assert one.predict(x[:5, :1]).min() > 0.99
    none = fit_boosted(frame(spark, x[:0], y[:0]), ["x0"], BoostParams(trees=2))
    assert none.trees == [] and none.predict(x[:3, :1]).tolist() == [0.5] * 3
    empty = fit_arrays(np.full((20, 2), np.nan), np.arange(20) % 2.0, np.ones(20), BoostParams(trees=2))
    assert empty.predict(np.array([[np.nan, 1.0]])).tolist() == [0.5]


def test_weights_count_as_repeated_rows():
    x, y = table(120, 8)
    w = np.random.default_rng(1).integers(1, 4, 120).astype(float)
    a, k = fit_arrays(x, y, w, BoostParams(trees=3)), np.repeat(np.arange(120), w.astype(int))
    b = fit_arrays(x[k], y[k], np.ones(len(k)), BoostParams(trees=3))
    assert a.predict(x) == pytest.approx(b.predict(x))
