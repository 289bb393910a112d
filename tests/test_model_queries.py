"""What the model queries wait for, and the sums of a level."""

from types import SimpleNamespace

import numpy as np
import pytest

from alertloom.operators import boosting, models
from alertloom.plans.catalog import ENTRIES, modelling
from alertloom.spec import ModelParams


@pytest.mark.parametrize("name", ["select_k_best", "make_classifier"])
def test_matrix_queries_fit_no_targets(spark, sf_dir, monkeypatch, name):
    def fit(*_, **__):
        raise AssertionError("targets are fitted")

    def small(kind):
        return lambda classes: models.classifier_for(ModelParams(kind=models._REGISTRY[kind.lower()], rounds=2, depth=2), classes)

    monkeypatch.setattr(modelling, "_FITTED", {})
    monkeypatch.setattr(models, "fit_targets", fit)
    monkeypatch.setattr(models, "make_classifier", small)
    rows = [tuple(r) for r in ENTRIES[name].run(spark, sf_dir).collect()]
    expected = [(50, 50, True)] if name == "select_k_best" else [(n, True) for n in models.available_classifiers()]
    assert sorted(rows) == sorted(expected)


def test_slices_and_outputs_are_summed_alike(monkeypatch):
    """Sums of several outputs, slice by slice, are those of one output at a time."""
    rng = np.random.default_rng(3)
    n, size, nodes = 40, 9, 2
    cell, row = np.sort(rng.choice([0, 1, 4, 5, 8], 300)).astype(np.int32), rng.integers(0, n, 300).astype(np.int32)
    outputs = [(rng.integers(0, nodes, n), rng.normal(size=n), rng.random(n)) for _ in range(3)]
    want = np.zeros((3, 2, nodes, size))
    for own, (node, *derivatives) in zip(want, outputs):
        for x, d in zip(own, derivatives):
            np.add.at(x, (node[row], cell), d[row])
    for slice_ in (1, 7, 100, 1 << 15):
        monkeypatch.setattr(boosting, "SLICE", slice_)
        found = np.zeros_like(want)
        boosting._add_cell_sums(found, cell, row, outputs, nodes)
        assert np.allclose(found, want, atol=1e-12)


def test_sums_of_features_that_are_not_drawn_stay():
    """Cells of features that no tree of the round may split are not sent."""
    layout = boosting.Layout(np.array([0.0, 0.0, 0.0, 0.0]), np.arange(5))
    layout.parts = np.array([0, layout.size])
    params = ModelParams(column_share=0.5, subsample=1.0, seed=1)
    fixed = boosting._Matrix({0: layout}, [boosting.Booster(0, 0, 3)], {0: [(0, 0)]}, params, "t")
    task = boosting._Task(SimpleNamespace(value=fixed), [], grown=[[np.full(1, -1)] * 3])
    cell = (layout.first[:-1] + 1).astype(np.int32)
    record = {
        "group": 0, "rows": 4, "block": 0, "cell": cell, "row": np.arange(4, dtype=np.int32),
        "label": np.array([[0], [1], [2], [0]]), "weight": np.ones((4, 1)), "margin": np.zeros((4, 3)),
    }
    sent = {key[1]: at.tolist() for key, (at, _, _) in boosting._sums([record], task)}
    drawn = {out: task.drawn(0, out) for out in range(3)}
    assert not all(d.all() for d in drawn.values())
    assert sent == {out: cell[d].tolist() for out, d in drawn.items()}
