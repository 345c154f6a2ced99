"""Mappings of very many features, solved in the memory of one matrix, against the plain formulas."""

import numpy as np
import pytest

from corpusloom.operators import classify, denoise, estimators, moments
from corpusloom.operators.moments import second_moments, unpacked

RNG = np.random.default_rng(19)


def sparse(spark, n=90, d=30):
    x = RNG.normal(size=(n, d)) * (RNG.random((n, d)) < 0.3) * (np.arange(d) != 4)
    rows = [(k, k % 2, k // 60, [int(j) for j in RNG.permutation(np.flatnonzero(v))], None) for k, v in enumerate(x)]
    rows = [(k, y, s, js, [float(x[k, j]) for j in js]) for k, y, s, js, _ in rows]
    return spark.createDataFrame(rows, "doc_id long, label int, side int, js array<bigint>, xs array<double>").cache(), x


@pytest.mark.parametrize("bias", [False, True])
def test_pairs_of_sparse_rows_are_the_second_moments(spark, bias):
    rows, x = sparse(spark)
    full = np.c_[x, np.ones(len(x))] if bias else x
    half, by = second_moments(rows, 30, "side", bias)
    assert np.allclose(unpacked(half, 30 + bias), full.T @ full)
    assert all(by[k][0] == n and np.allclose(by[k][1], full[x0 : x0 + n].sum(0)) for k, n, x0 in ((0, 60, 0), (1, 30, 60)))


def test_one_matrix_is_enough():
    x = RNG.normal(size=(400, 300)) * (np.arange(300) != 4)
    S, total, xd = x.T @ x, x.sum(0), x[:200].sum(0) - x[200:].sum(0)
    A = S + np.eye(300)
    want = np.linalg.inv(A)
    assert denoise.inverse(A, 64) is A and np.allclose(A, want)
    for mode in ("target", "source", "orthogonal", "plain"):
        plain, wide = denoise.DomainSolver(S, total, xd, 0.9, mode=mode), denoise.WideDomainSolver(S.copy(), total, xd, 0.9, (0.1, 50.0), mode)
        for alpha in (0.1, 50.0):
            assert np.allclose(plain.mapping(alpha, 1.0), wide.mapping(alpha, 1.0), atol=1e-7)
    B = np.c_[x, np.ones(400)]
    got = denoise.through(*denoise.solved_base(B.T @ B, 0.9, 1e-2, True), 0.9, True)
    assert np.allclose(got, denoise.mapping(B.T @ B, 0.9, 1e-2).T)


def test_wide_estimators_score_as_narrow_ones(spark, monkeypatch):
    rows, _ = sparse(spark)
    c = estimators.Corpus(rows.where("side = 0"), rows.where("side = 1"), 30)
    make = (lambda: estimators.MdaAdapter(c, 0.5, cv=2, strengths=(0.1, 1.0)), lambda: estimators.DomainAdapter(c, 0.5, (1.0,), (0.1,), cv=2, strengths=(0.1, 1.0)))
    want = [(a.cv_score, a.score(c.target)) for a in (m().fit() for m in make)]
    monkeypatch.setattr(denoise, "WIDE", 10)
    assert [(a.cv_score, a.score(c.target)) for a in (m().fit() for m in make)] == want


@pytest.mark.parametrize("bias", [False, True])
@pytest.mark.parametrize("classes", [2, 3])
def test_a_task_fits_all_models_of_a_setting_without_a_scan(spark, monkeypatch, classes, bias):
    rows, x = sparse(spark, 200, 70)
    y = np.arange(200) % classes
    rows = rows.selectExpr("doc_id", f"cast(doc_id % {classes} as int) label", "js", "xs")
    monkeypatch.setattr(denoise, "WIDE", 10)
    B, strengths = RNG.normal(size=(70 + bias, 66)) / 4, (1e-3, 1.0, 10.0)
    pushes = None if bias else [(RNG.normal(size=70) / 5, RNG.normal(size=66) / 5) for _ in range(3)]
    hidden = denoise.Hidden(spark, B, 70, bias=bias, pushes=pushes)
    scans, over = [], classify.Search._over
    monkeypatch.setattr(classify.Search, "_over", lambda self, *a: scans.append(1) or over(self, *a))
    one = classify.Search(rows, hidden)
    got = [one.fitted(k, 3, strengths) for k in range(hidden.settings)]
    assert not scans
    monkeypatch.setattr(classify, "MOST_HIDDEN", 0)
    two = classify.Search(rows, hidden)
    assert [g[1:] for g in got] == [two.fitted(k, 3, strengths)[1:] for k in range(hidden.settings)] and scans
    full = np.c_[x, np.ones(200)] if bias else x
    for k, (model, strength, _) in enumerate(got):
        H = np.c_[np.tanh(full @ (B if bias else B + np.outer(*pushes[k]))), np.ones(200)]
        for w, head in zip(model.weights, [1] if classes == 2 else range(3)):
            at = lambda w: strength * H.T @ (1 / (1 + np.exp(-H @ w)) - (y == head)) + w  # noqa: E731, B023
            assert np.linalg.norm(at(w)) <= 1.1 * classify.TOLERANCE * np.linalg.norm(at(0 * w))


def test_rows_without_features_have_hidden_ones(spark):
    B, size, js, xs = RNG.normal(size=(9, 130)), np.array([0, 2, 0, 1]), np.array([3, 7, 8], np.int32), np.array([0.5, 2.0, 1.0])
    x = np.zeros((4, 9))
    x[1, [3, 7]], x[3, 8] = (0.5, 2.0), 1.0
    v, c = RNG.normal(size=9), RNG.normal(size=130)
    for layer, f in (("tanh", np.tanh), ("identity", lambda h: h)):
        H = denoise.Hidden(spark, B, 9, layer, pushes=[(v, c)]).at_once(size, js, xs, columns=1)
        flat = H.transpose(1, 0, 2).reshape(4, -1)
        assert np.allclose(flat[:, :131], np.c_[f(x @ (B + np.outer(v, c))), np.ones(4)], atol=1e-5) and not flat[:, 131:].any()


def test_few_entries_send_no_halves_of_matrices(spark, monkeypatch):
    rows, x = sparse(spark)
    monkeypatch.setattr(moments, "WIDE", 10)
    many = second_moments(rows, 30, "side")
    monkeypatch.setattr(moments, "MOST_ENTRIES", 1)
    by_scan = second_moments(rows, 30, "side")
    assert np.allclose(many[0], by_scan[0]) and all(many[1][k][0] == by_scan[1][k][0] and np.allclose(many[1][k][1], by_scan[1][k][1]) for k in (0, 1))
    monkeypatch.undo()
    monkeypatch.setattr(moments, "WIDE", 10)
    monkeypatch.setattr(moments, "summed", None)
    assert np.allclose(unpacked(second_moments(rows, 30, "side")[0], 30), x.T @ x)
