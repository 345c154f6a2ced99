"""The joint search over settings against fits of one setting at a time."""

import numpy as np
import pytest

from corpusloom.operators import classify, denoise, estimators
from corpusloom.operators.classify import TOLERANCE, Search, cross_validated
from corpusloom.operators.moments import dense_rows

STRENGTHS = (1e-3, 1.0, 10.0)


def data(spark, classes, n=240, d=8):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, d)) * np.geomspace(0.01, 2, d) + 0.3  # features of very different sizes converge slowly without a curvature
    y = (x[:, -1] + rng.normal(size=n) > 0.3).astype(int) + (rng.random(n) < 0.3) * (classes - 2)
    df = spark.createDataFrame([(k, int(y[k]), [float(v) for v in x[k]]) for k in range(n)], "doc_id long, label int, v array<double>")
    return dense_rows(df, "v").drop("v").cache(), x, y, rng


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("whole", [True, False])
def test_settings_are_fitted_together_as_each_alone(spark, monkeypatch, classes, whole):
    rows, x, y, rng = data(spark, classes)
    monkeypatch.setattr(classify, "WHOLE_CURVATURE", 1000 if whole else 0)
    B = rng.normal(size=(8, 6)) / 3
    pushes = [(rng.normal(size=8) / 5, rng.normal(size=6) / 5) for _ in range(3)]
    scans, over = [], Search._over
    monkeypatch.setattr(Search, "_over", lambda self, *a: scans.append(a[1]) or over(self, *a))
    hidden = denoise.Hidden(spark, B, 8, pushes=pushes)
    search = Search(rows, hidden)
    for k, (v, c) in enumerate(pushes):
        W = (B + np.outer(v, c)).T
        got = cross_validated(search.setting(k), 6, 3, STRENGTHS)
        want = cross_validated(denoise.project(rows, W, 8), 6, 3, STRENGTHS)
        assert got[1:] == want[1:] and got[0].classes == want[0].classes
        H = np.c_[np.tanh(x @ W.T), np.ones(len(x))]
        heads = [1] if classes == 2 else range(3)
        for w, head in zip(got[0].weights, heads):
            at = lambda w: got[1] * H.T @ (1 / (1 + np.exp(-H @ w)) - (y == head)) + w  # noqa: E731, B023
            assert np.linalg.norm(at(w)) <= 1.001 * TOLERANCE * np.linalg.norm(at(0 * w))
        predicted = {r["doc_id"]: r["predicted"] for r in got[0].predict(rows, hidden, k).collect()}
        assert predicted == {r["doc_id"]: r["predicted"] for r in got[0].predict(denoise.project(rows, W, 8)).collect()}
    assert len(scans) < (25 if whole else 60)  # of all settings, models and rounds; alone, a setting took a scan a round


def test_settings_beyond_what_the_driver_holds_come_in_groups(spark, monkeypatch):
    rows, _, _, rng = data(spark, 2)
    pushes = [(rng.normal(size=8) / 5, rng.normal(size=6) / 5) for _ in range(3)]
    hidden = denoise.Hidden(spark, rng.normal(size=(8, 6)) / 3, 8, pushes=pushes)
    one = Search(rows, hidden)
    want = [cross_validated(one.setting(k), 6, 3, STRENGTHS)[1:] for k in range(3)]
    monkeypatch.setattr(classify, "MOST_HELD", 1)
    two = Search(rows, hidden)
    assert [cross_validated(two.setting(k), 6, 3, STRENGTHS)[1:] for k in range(3)] == want


def test_all_settings_of_a_domain_search_start_from_one_base(spark):
    rows, x, y, _ = data(spark, 2)
    c = estimators.Corpus(rows.where("doc_id < 160"), rows.where("doc_id >= 160"), 8)
    a = estimators.DomainAdapter(c, 0.3, (1.0, 50.0), (0.01, 0.1), cv=2, strengths=(0.1, 1.0)).fit()
    S, total = x.T @ x, x.sum(0)
    xd = x[160:].sum(0) - x[:160].sum(0)
    assert np.allclose(a.W, denoise.domain_mapping(S, total, xd, 0.3, a.alpha, a.eta)) and len(a.tried) == 4
    solver = denoise.DomainSolver(S, total, xd, 0.3)
    for alpha in (1.0, 50.0):
        v, w = solver.push(alpha, 0.1)
        assert np.allclose((solver.G + np.outer(v, w)).T, solver.mapping(alpha, 0.1))


def test_all_cores_share_the_rows_of_a_search(spark, monkeypatch):
    rows, _, _, rng = data(spark, 2)
    shares, over = [], Search._over
    monkeypatch.setattr(Search, "_over", lambda self, ready, *a: shares.append([len(x) for x in ready.rdd.glom().collect()]) or over(self, ready, *a))
    hidden = denoise.Hidden(spark, rng.normal(size=(8, 6)) / 3, 8)
    cross_validated(Search(rows.coalesce(1), hidden).setting(0), 6, 3, STRENGTHS)
    cores = spark.sparkContext.defaultParallelism
    for each in shares:
        assert sum(each) == 240 and len(each) == cores and max(each) < 1.5 * 240 / cores


def test_hidden_features_take_no_more_room_than_asked(spark):
    z = np.random.default_rng(3).normal(size=(50, 7)) * 300
    want = np.tanh(z)
    assert np.allclose(denoise.quick_tanh(z), want, atol=3e-16, rtol=0)
    assert denoise.quick_tanh(z, z) is z and np.allclose(z, want, atol=3e-16, rtol=0)
