"""Denoising with domain, discrepancy and class regularizers (row convention: projection X W, no bias).

All methods work on moments by group (domain, role, class): role is source, labelled (target rows with a label)
or unlabelled; class is -1 for unlabelled rows. Losses that compare means use outer products of mean differences instead of n x n matrices.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from corpusloom.operators.denoise import marginal
from corpusloom.operators.moments import Moments, mean_gap

TINY = 1e-10
METHODS = ("MDA", "TD", "TDr", "TM", "TCM", "TDM", "TDCM", "TCW", "TFW", "TDCW", "TDFW", "TMCW", "TMFW", "TCMCW", "TCMFW", "TWC", "TDWC", "TMWC", "TCMWC")


@dataclass(frozen=True)
class Params:
    noise: float = 0.1
    mda_reg: float = 1e-3
    td_eta: float = 1.0
    td_reg: float = 1.0
    tm_lambda: float = 1.0
    tc_gamma: float = 1.0
    tc_reg: float = 1.0
    rounds: int = 5
    tolerance: float = 1e-5


@dataclass
class Parts:
    """Matrices that the methods are made of."""

    Sa: np.ndarray
    Pa: np.ndarray
    Qa: np.ndarray
    Q: np.ndarray
    S: np.ndarray
    XY: np.ndarray
    XYD: np.ndarray
    Pd: np.ndarray
    per_source: list[tuple[np.ndarray, np.ndarray]]
    losses: list[float] = field(default_factory=list)
    gap: np.ndarray | None = None
    #: The class classifier for which the last W was solved, and the class moments beside it.
    used: tuple[np.ndarray, np.ndarray] | None = None


def classes(m: Moments) -> list:
    """The classes of labelled rows, in order."""
    return sorted({g[2] for g in m.groups if g[1] != "unlabelled"})


def sources(m: Moments) -> list:
    return sorted({g[0] for g in m.groups if g[1] == "source"})


def cross(m: Moments, keep, listed: list) -> np.ndarray:  # noqa: ANN001
    """X'Y of the labelled rows kept, Y being +1 for a row's own class and -1 for the others."""
    whole = m.of(lambda g: keep(g) and g[1] != "unlabelled")[1]
    return np.stack([2 * m.of(lambda g, c=c: keep(g) and g[1] != "unlabelled" and g[2] == c)[1] - whole for c in listed], axis=1)


def parts(m: Moments, p: Params) -> Parts:
    q = np.full(m.s.shape[1], 1 - p.noise)
    total, Sa = m.total()[1:]
    S = m.of(lambda g: g[1] != "unlabelled")[2]
    tiny = TINY * np.eye(len(q))
    listed, named = classes(m), sources(m)
    by = [m.of(lambda g, d=d: g[1] == "source" and g[0] == d) for d in named]
    target = m.of(lambda g: g[1] != "source")
    own = [*by, target]
    XYD = np.stack([2 * s - total for _, s, _ in own], axis=1)
    Pd = np.stack([*[-total for _ in by], total], axis=1)
    per = [(x[2], cross(m, lambda g, d=d: g[1] == "source" and g[0] == d, listed)) for x, d in zip(by, named)]
    return Parts(Sa, Sa * q[None, :], marginal(Sa, q) + tiny, marginal(S, q) + tiny, S, cross(m, lambda g: True, listed), XYD, Pd, per)


def discrepancy(m: Moments) -> np.ndarray:
    """Sum of mean gaps over all pairs of sources and all pairs of a source and the target."""
    named = sources(m)
    out = sum((mean_gap(m, lambda g, d=d: g[1] == "source" and g[0] == d, lambda g: g[1] != "source") for d in named), np.zeros(m.S.shape[1:]))
    for k, one in enumerate(named):
        for two in named[k + 1 :]:
            out = out + mean_gap(m, lambda g, d=one: g[1] == "source" and g[0] == d, lambda g, d=two: g[1] == "source" and g[0] == d)
    return out


def class_discrepancy(m: Moments) -> np.ndarray:
    """Mean gaps by class: of pairs of sources, and of each source with the labelled target rows of the class, or with all
    target rows where none is labelled. A class without rows on a side adds nothing."""
    named, out = sources(m), np.zeros(m.S.shape[1:])
    with_labels = any(g[1] == "labelled" for g in m.groups)
    for c in classes(m):
        of = [lambda g, d=d, c=c: g[1] == "source" and g[0] == d and g[2] == c for d in named]
        other = (lambda g, c=c: g[1] == "labelled" and g[2] == c) if with_labels else (lambda g: g[1] != "source")
        for k, one in enumerate(of):
            out = out + mean_gap(m, one, other)
            for two in of[k + 1 :]:
                out = out + mean_gap(m, one, two)
    return out


def sylvester(Q: np.ndarray, M: np.ndarray, L: np.ndarray, R: np.ndarray, C: np.ndarray) -> np.ndarray:
    """W with Q^-1 M W + W L R^-1 = C, for symmetric Q, R > 0 and M, L >= 0: both factors become symmetric in the
    bases of the Cholesky factors of Q and R, where the equation is diagonal."""
    q, r = np.linalg.cholesky(Q), np.linalg.cholesky(R)
    a, U = np.linalg.eigh(np.linalg.solve(q, np.linalg.solve(q, M).T))
    b, V = np.linalg.eigh(np.linalg.solve(r, np.linalg.solve(r, L).T))
    inner = (U.T @ (q.T @ C @ r) @ V) / (a[:, None] + b[None, :])
    return np.linalg.solve(q.T, U @ inner @ V.T) @ np.linalg.inv(r)


def solve(method: str, m: Moments, p: Params = Params(), iterate: bool = False, own_labels: bool = False) -> tuple[np.ndarray, np.ndarray | None, Parts]:
    """(W, class classifier or None, parts) of a method.

    Several sources have a classifier each, side by side, or with ``iterate`` one over all labelled rows, which alternates
    with W until the loss settles. ``own_labels`` pairs each source's classifier with its own class moments instead of the pooled ones.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; one of {METHODS}")
    x, one = parts(m, p), np.eye(m.s.shape[1])
    keep = 1 - p.noise
    q = np.full(len(one), keep)
    ZD = np.linalg.solve(x.Sa + p.td_reg * one, x.XYD)
    R = one + p.td_eta * ZD @ ZD.T
    pushed = p.td_eta * keep * x.Pd @ ZD.T
    Qm = np.zeros_like(one)
    if "M" in method and method != "MDA":
        Qm = x.gap = marginal(class_discrepancy(m) if "CM" in method else discrepancy(m), q) + TINY * one
    reg = x.Qa + p.mda_reg * one
    if method == "MDA":
        return np.linalg.solve(reg, x.Pa), None, x
    if method == "TD":
        return np.linalg.solve(x.Qa, np.linalg.solve(R, (x.Pa + pushed).T).T), None, x
    if method in ("TM", "TCM"):
        return np.linalg.solve(reg + p.tm_lambda * Qm, x.Pa), None, x
    if method in ("TDr", "TDM", "TDCM"):
        C = np.linalg.solve(x.Qa, x.Pa + pushed)
        return sylvester(x.Qa, p.mda_reg * one + p.tm_lambda * Qm, R, one, C), None, x

    domain = method.startswith("TD")
    M = x.Qa if domain else reg + p.tm_lambda * Qm
    right = R if domain else one
    base = x.Pa + pushed if domain else x.Pa

    def step(ZC: np.ndarray, XY: np.ndarray) -> np.ndarray:
        x.used = ZC, XY
        C = np.linalg.solve(x.Q, base + p.tc_gamma * keep * XY @ ZC.T)
        return sylvester(x.Q, M, p.tc_gamma * ZC @ ZC.T, right, np.linalg.solve(right, C.T).T)

    def classifier(W: np.ndarray) -> np.ndarray:
        return np.linalg.solve(p.tc_gamma * W.T @ x.Q @ W + p.tc_reg * one, p.tc_gamma * keep * W.T @ x.XY)

    def loss(W: np.ndarray, ZC: np.ndarray) -> float:
        out = np.sum(W * (x.Qa @ W)) - 2 * np.sum(x.Pa.T * W) + p.tc_reg * np.sum(ZC * ZC)
        out += p.tc_gamma * np.sum((W @ ZC) * (x.Q @ W @ ZC)) - 2 * p.tc_gamma * keep * np.sum(x.XY * (W @ ZC))
        if domain:
            return float(out + p.td_eta * np.sum((W @ ZD) * (x.Qa @ W @ ZD)) - 2 * p.td_eta * keep * np.sum(x.Pd * (W @ ZD)))
        return float(out + p.mda_reg * np.sum(W * W) + p.tm_lambda * np.sum(W * (Qm @ W)))

    from_map = method.endswith("WC")
    ridge_like = method.endswith("CW")
    if not iterate and not from_map:
        zs = [np.linalg.solve((S if ridge_like else marginal(S, q) + TINY * one) + p.tc_reg * one, xy) for S, xy in x.per_source]
        xys = [xy if own_labels else x.XY for _, xy in x.per_source]
        ZC = np.concatenate(zs, axis=1)
        return step(ZC, np.concatenate(xys, axis=1)), ZC, x
    ZC = classifier(np.linalg.solve(reg, x.Pa)) if from_map else np.linalg.solve((x.S if ridge_like else x.Q) + p.tc_reg * one, x.XY)
    for _ in range(p.rounds):
        W = step(ZC, x.XY)
        ZC = classifier(W)
        x.losses.append(loss(W, ZC))
        if len(x.losses) > 1 and abs(x.losses[-2] - x.losses[-1]) < p.tolerance * abs(x.losses[-1]):
            break
    return W, ZC, x
