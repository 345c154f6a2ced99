"""Solvers against corrupted samples, Kronecker products and each other."""

import numpy as np
import pytest

from corpusloom.operators import baselines, denoise
from corpusloom.operators.moments import Moments, dense_rows, feature_rows, mean_gap, moments
from corpusloom.operators.regularized import METHODS, Params, class_discrepancy, discrepancy, parts, solve, sylvester

RNG = np.random.default_rng(7)


def grouped(labels_known=True, sources=(0, 1), d=4, empty_class=False):
    groups, data = [], []
    for dom in sources:
        for c in range(3):
            if not (empty_class and dom == sources[-1] and c == 2):
                groups.append((dom, "source", c))
    groups += [(9, "labelled", c) for c in range(3)] if labels_known else []
    groups.append((9, "unlabelled", -1))
    for k, _ in enumerate(groups):
        data.append(RNG.normal(size=(6 + k, d)) + 0.3 * k)
    return Moments(groups, np.array([len(x) for x in data], float), np.stack([x.sum(0) for x in data]), np.stack([x.T @ x for x in data])), data


def test_marginal_moments_are_expectations():
    x = RNG.normal(size=(30, 3))
    P, Q = denoise.expectations(x.T @ x, 0.4, bias=False)
    p, q, n = np.zeros((3, 3)), np.zeros((3, 3)), 20_000
    for _ in range(n):
        z = x * (RNG.random(x.shape) > 0.4)
        p += x.T @ z
        q += z.T @ z
    assert np.abs(p / n - P).max() < 0.5 and np.abs(q / n - Q).max() < 0.5


def test_mapping_minimises_the_expected_loss():
    x = RNG.normal(size=(40, 4))
    x[:, 3] = 1
    S = x.T @ x
    W, (P, Q) = denoise.mapping(S, 0.3, 0.1), denoise.expectations(S, 0.3, True)
    reg = denoise.ridge(4, 0.1, True)
    loss = lambda w: np.trace(w @ (Q + reg) @ w.T) - 2 * np.trace(P @ w.T)
    assert all(loss(W) <= loss(W + 1e-3 * RNG.normal(size=W.shape)) for _ in range(20))


def test_feature_that_never_occurs_has_no_weight():
    x = RNG.normal(size=(20, 3))
    x[:, 1] = 0
    W = denoise.mapping(x.T @ x, 0.5, 0.0, bias=False)
    assert np.isfinite(W).all() and not W[:, 1].any() and not W[1].any()


def test_domain_mapping_without_weight_is_plain():
    x = RNG.normal(size=(20, 3))
    S, total = x.T @ x, x.sum(0)
    for mode in ("target", "source", "orthogonal", "plain"):
        assert np.allclose(denoise.domain_mapping(S, total, total / 2, 0.3, 1.0, 0.0, 0.01, mode), denoise.mapping(S, 0.3, 0.01, bias=False))
    with pytest.raises(ValueError):
        denoise.domain_mapping(S, total, total, 0.3, 1.0, 0.1, mode="other")


def test_target_mode_is_the_td_method_with_half_the_weight():
    m, _ = grouped(sources=(0,))
    total, S = m.total()[1:]
    xd = m.of(lambda g: g[1] != "source")[1] - m.of(lambda g: g[1] == "source")[1]
    W = denoise.domain_mapping(S, total, xd, 0.1, 1.0, 0.5, 0.0)
    assert np.allclose(solve("TD", m, Params(td_eta=0.25))[0], W.T, atol=1e-6)


def test_sylvester_against_kronecker():
    a, b, l = (RNG.normal(size=(4, 4)) for _ in range(3))
    Q, R, M, L, C = a @ a.T + np.eye(4), b @ b.T + np.eye(4), l @ l.T, np.outer(a[0], a[0]), RNG.normal(size=(4, 4))
    A, B = np.linalg.solve(Q, M), L @ np.linalg.inv(R)
    want = np.linalg.solve(np.kron(np.eye(4), A) + np.kron(B.T, np.eye(4)), C.reshape(-1, order="F")).reshape(4, 4, order="F")
    assert np.allclose(sylvester(Q, M, L, R, C), want)


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("known", [True, False])
def test_methods(method, known):
    m, _ = grouped(known)
    p = Params(rounds=30, tolerance=1e-9)
    W, ZC, x = solve(method, m, p, iterate=True)
    assert np.isfinite(W).all()
    assert all(b <= a + 1e-7 * abs(a) for a, b in zip(x.losses, x.losses[1:]))
    if ZC is None:
        return
    keep, one = 0.9, np.eye(4)  # at the end W solves its equation for the last classifier nearly
    ZD = np.linalg.solve(x.Sa + one, x.XYD)
    domain, gap = "D" in method, class_discrepancy(m) if "CM" in method else discrepancy(m)
    Qm = denoise.marginal(gap, np.full(4, keep)) + 1e-10 * one if "M" in method else 0 * one
    R = one + ZD @ ZD.T if domain else one
    left = (x.Qa if domain else x.Qa + 1e-3 * one + Qm) @ W @ R + x.Q @ W @ ZC @ ZC.T
    right = x.Pa + keep * x.XY @ ZC.T + (keep * x.Pd @ ZD.T if domain else 0)
    assert np.abs(left - right).max() < 1e-2 * np.abs(right).max()


def test_identities_of_methods():
    m, _ = grouped()
    plain = solve("MDA", m)[0]
    assert np.allclose(solve("TM", m, Params(tm_lambda=0.0))[0], plain)
    x = parts(m, Params())
    W = solve("TCW", m, Params(tc_gamma=0.0))[0]
    assert np.allclose((x.Qa + 1e-3 * np.eye(4)) @ W, x.Pa, atol=1e-6)
    with pytest.raises(ValueError):
        solve("SDM", m)


def test_discrepancies_against_the_n_by_n_matrix():
    m, data = grouped(sources=(0,))
    source = np.concatenate([x for g, x in zip(m.groups, data) if g[1] == "source"])
    target = np.concatenate([x for g, x in zip(m.groups, data) if g[1] != "source"])
    v = np.r_[np.full(len(source), 1 / len(source)), np.full(len(target), -1 / len(target))]
    X = np.concatenate([source, target])
    assert np.allclose(discrepancy(m), X.T @ np.outer(v, v) @ X)
    assert np.isfinite(class_discrepancy(grouped(empty_class=True)[0])).all()
    assert not mean_gap(m, lambda g: False, lambda g: True).any()


def test_moments_of_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, domain string")
    x = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 1, 3.0)], "doc_id long, j long, x double")
    m = moments(feature_rows(docs, x), 2, ["domain"], bias=True)
    assert m.groups == [("a",), ("b",), (None,)] and m.n.tolist() == [2, 1, 1]
    assert m.S[0].tolist() == [[4, 2, 2], [2, 10, 4], [2, 4, 2]] and m.S[1].tolist() == [[0, 0, 0], [0, 0, 0], [0, 0, 1]]
    empty = moments(feature_rows(docs.limit(0), x.limit(0)), 2, [])
    assert empty.n.tolist() == [0] and not empty.S.any()
    with pytest.raises(ValueError):
        moments(docs, 10_000, [])


def test_projection_stack_and_latent(spark):
    data = RNG.normal(size=(12, 3))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(data)] + [(99, None)], "doc_id long, v array<double>")
    rows = dense_rows(df, "v").select("doc_id", "js", "xs")
    W = RNG.normal(size=(2, 4))
    got = {r["doc_id"]: r["xs"] for r in denoise.project(rows, W, 3, "tanh", bias=True).collect()}
    full = np.concatenate([np.r_[data, np.zeros((1, 3))], np.ones((13, 1))], axis=1)
    assert np.allclose([got[k] for k in [*range(12), 99]], np.tanh(full @ W.T))
    outs, maps = denoise.stack(rows, 3, layers=2, noise=0.5)
    first = np.tanh(full @ maps[0].T)
    got = {r["doc_id"]: r["xs"] for r in outs[1].collect()}
    assert np.allclose([got[k] for k in [*range(12), 99]], np.tanh(np.c_[first, np.ones(13)] @ maps[1].T))
    V, s = baselines.latent(rows, 3, 3)
    assert np.allclose(s, np.linalg.svd(data, compute_uv=False))
    assert denoise.filtered(np.array([[1.0, 3, 2]]), "top", 2).tolist() == [[0, 3, 2]]
    with pytest.raises(ValueError):
        denoise.project(rows, W, 3, "softmax")


TERMS = {"td_eta": ("TD", "TDr", "TDM", "TDCM", "TDCW", "TDFW", "TDWC"), "tm_lambda": ("TM", "TCM", "TDM", "TDCM", "TMCW", "TMFW", "TCMCW", "TCMFW", "TMWC", "TCMWC"), "tc_gamma": [m for m in METHODS if "W" in m], "noise": METHODS}


@pytest.mark.parametrize("name", sorted(TERMS))
def test_weights_show_every_term_to_the_places_queries_print(spark, name):
    """The queries print W to six places; each term of a method changes what they print."""
    from corpusloom import queries_dense

    m = queries_dense.vector_moments(spark, "/root/testdata/sf0.001")
    for method in TERMS[name]:
        one, two = (np.round(solve(method, m, p, iterate=True)[0], 6) for p in (Params(), Params(**{name: getattr(Params(), name) * 0.9})))
        assert (one != two).mean() > 0.5, method
