"""Marginalized denoising autoencoders in closed form.

Features are kept with probability q (1 for a bias). With S = X'X, the expected moments of corrupted data are
Q = q q' S off the diagonal and q S on it, and P = S q. The mapping is W = P (Q + reg)^-1, hidden features are
f(x W'). Statistics come from one scan of the data; only d x d matrices are on the driver.
"""

from __future__ import annotations

import atexit
import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.activations import ARRAYS, CODES
from corpusloom.operators.moments import WIDE, block, moments, pack, slices, unpacked
from corpusloom.plans.partial import Batches
from corpusloom.plans.session import cut, ensure_checkpoint_dir


def marginal(S: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Expected second moments of corrupted features."""
    out = S * np.outer(q, q)
    np.fill_diagonal(out, q * np.diag(S))
    return out


def expectations(S: np.ndarray, noise: float, bias: bool) -> tuple[np.ndarray, np.ndarray]:
    """(P, Q); with a bias, it is the last feature of S, never corrupted and not reconstructed."""
    q = np.full(len(S), 1.0 - noise)
    if bias:
        q[-1] = 1.0
    P = S * q[None, :]
    return (P[:-1] if bias else P), marginal(S, q)


def ridge(n: int, reg: float, bias: bool) -> np.ndarray:
    """The diagonal regularizer, none on a bias."""
    out = np.full(n, reg)
    if bias:
        out[-1] = 0.0
    return np.diag(out)


def mapping(S: np.ndarray, noise: float, reg: float = 1e-2, bias: bool = True, outputs: np.ndarray | None = None) -> np.ndarray:
    """W of a denoising autoencoder, for all outputs or the listed ones. A feature of zeros only (with reg = 0) has zero weights."""
    P, Q = expectations(S, noise, bias)
    if outputs is not None:
        P = P[outputs]
    return solve_regular(Q + ridge(len(Q), reg, bias), P.T).T


def solve_regular(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """A^-1 B where features that never occur (zero rows and columns of A) are left out and get zeros."""
    on = np.abs(A).sum(axis=1) > 0
    if on.all():
        return np.linalg.solve(A, B)
    out = np.zeros((len(A), B.shape[1]))
    out[on] = np.linalg.solve(A[np.ix_(on, on)], B[on])
    return out


def domain_classifier(S: np.ndarray, xd: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge weights C that tell the domains apart: (S + alpha)^-1 X'D."""
    return np.linalg.solve(S + alpha * np.eye(len(S)), xd)


class DomainSolver:
    """Domain-regularized autoencoders, without bias, for many settings of the same moments.

    ``total`` are the sums of all features, ``xd`` those with the domain's sign. Modes: ``target`` pushes reconstructions to
    the target side, ``source`` to the source side, ``orthogonal`` across the classifier, ``plain`` keeps each row's own domain. A setting only
    adds terms of rank one: Q is solved once for P and the pushed side, a domain classifier once for each alpha.
    """

    def __init__(self, S: np.ndarray, total: np.ndarray, xd: np.ndarray, noise: float, reg: float = 0.0, mode: str = "target") -> None:
        sides = {"target": total, "orthogonal": np.zeros_like(total), "source": -total, "plain": xd}
        if mode not in sides:
            raise ValueError(f"no mode {mode!r}")
        self.S, self.xd, self.keep = S, xd, 1 - noise
        self.sign = -1.0 if mode in ("target", "orthogonal") else 1.0
        P, Q = expectations(S, noise, bias=False)
        Q[np.diag_indices(len(Q))] += reg
        both = solve_regular(Q, np.c_[P, sides[mode]])
        self.G, self.u = both[:, :-1], both[:, -1]
        self.c: dict[float, np.ndarray] = {}

    def mapping(self, alpha: float, eta: float) -> np.ndarray:
        """W = ((Q + reg)^-1 (P - eta keep side c') (I - eta c c')^-1)'"""
        if alpha not in self.c:
            self.c[alpha] = domain_classifier(self.S, self.xd, alpha)
        c, eta = self.c[alpha], self.sign * eta
        out = self.G - np.outer(self.u, eta * self.keep * c)
        out += np.outer(out @ c, eta / (1 - eta * (c @ c)) * c)
        return out.T

    def push(self, alpha: float, eta: float) -> tuple[np.ndarray, np.ndarray]:
        """(v, c) with W' = G + v c': all settings share G."""
        if alpha not in self.c:
            self.c[alpha] = self.classifier(alpha)
        c, eta = self.c[alpha], self.sign * eta
        moved = -eta * self.keep * self.u
        return moved + eta / (1 - eta * (c @ c)) * (self.through(c) + moved * (c @ c)), c

    def classifier(self, alpha: float) -> np.ndarray:
        return domain_classifier(self.S, self.xd, alpha)

    def through(self, c: np.ndarray) -> np.ndarray:
        return self.G @ c


def domain_mapping(S: np.ndarray, total: np.ndarray, xd: np.ndarray, noise: float, alpha: float, eta: float, reg: float = 0.0, mode: str = "target") -> np.ndarray:
    """W of one domain-regularized autoencoder."""
    return DomainSolver(S, total, xd, noise, reg, mode).mapping(alpha, eta)


def inverse(A: np.ndarray, size: int = 256) -> np.ndarray:
    """``A``, symmetric and positive definite, replaced by its inverse: blocks are swept one by one, without a second matrix."""
    n = len(A)
    for low in range(0, n, size):
        at = slice(low, min(low + size, n))
        pivot, side = np.linalg.inv(A[at, at]), A[at].copy()
        side[:, at] = 0
        moved = pivot @ side
        for k in range(0, n, size):
            A[k : k + size] -= side[:, k : k + size].T @ moved
        A[at], A[:, at] = moved, moved.T
        A[at, at] = -pivot
    A *= -1
    return A


def shifted(S: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """(S + alpha)^-1 b by conjugate gradients scaled by the diagonal, without a second matrix."""
    scale = 1 / (np.diag(S) + alpha)
    x, r = np.zeros_like(b), b.copy()
    p = z = scale * r
    rz, least = float(r @ z), 1e-12 * float(np.sqrt(b @ b))
    for _ in range(10 * len(b) + 10):
        if float(np.sqrt(r @ r)) <= least:
            return x
        q = S @ p + alpha * p
        step = rz / float(p @ q)
        x, r = x + step * p, r - step * q
        z = scale * r
        before, rz = rz, float(r @ z)
        p = z + rz / before * p
    raise ArithmeticError("the domain classifier did not converge")


def solved_base(S: np.ndarray, noise: float, reg: float, bias: bool) -> tuple[np.ndarray, np.ndarray]:
    """``S`` replaced by (Q + reg)^-1, and D with W' = (1 - (Q + reg)^-1 D) / q: as Q is P q but for its diagonal, the inverse is enough."""
    q = np.full(len(S), 1.0 - noise)
    if bias:
        q[-1] = 1.0
    own = np.diag(S).copy()
    D = q * own * (1 - q) + np.diag(ridge(len(S), reg, bias))
    S *= q[:, None]
    S *= q[None, :]
    S[np.diag_indices(len(S))] = diagonal = q * own + np.diag(ridge(len(S), reg, bias))
    none = diagonal == 0  # features that never occur get no weights
    S[none, none], D[none] = 1.0, 1.0
    return inverse(S), D


def through(A: np.ndarray, D: np.ndarray, noise: float, bias: bool) -> np.ndarray:
    """W' of ``solved_base``, in its place."""
    A *= -D[None, :]
    A[np.diag_indices(len(A))] += 1
    A /= 1 - noise
    return A[:, :-1] if bias else A  # the bias is not reconstructed


class WideDomainSolver(DomainSolver):
    """The same in the memory of one matrix, ``S``, which becomes its inverse Q: domain classifiers for all ``alphas`` are solved first."""

    def __init__(self, S: np.ndarray, total: np.ndarray, xd: np.ndarray, noise: float, alphas: tuple, mode: str = "target") -> None:
        self.keep, side = 1 - noise, {"target": total, "orthogonal": 0 * total, "source": -total, "plain": xd}[mode]
        self.sign = -1.0 if mode in ("target", "orthogonal") else 1.0
        self.c = {a: shifted(S, xd, a) for a in alphas}
        self.A, self.D = solved_base(S, noise, 0.0, False)
        self.u = self.A @ side

    @property
    def G(self) -> np.ndarray:
        return through(self.A.copy(), self.D, 1 - self.keep, False)

    def through(self, c: np.ndarray) -> np.ndarray:
        return (c - self.A @ (self.D * c)) / self.keep


def quick_tanh(z: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """tanh to 2e-16, in a third of the time; ``out`` may be ``z``."""
    out = np.multiply(z, 2, out=out)
    with np.errstate(over="ignore"):
        np.exp(out, out=out)
    out += 1
    np.divide(-2, out, out)
    out += 1
    return out


#: Features of a block whose products are small enough for BLAS to take them as they lie.
LANES = 64


class SharedMatrix:
    """W' of ``solved_base`` as a file in the shared folder, the upper half of the inverse; a Python process reads it once."""

    #: The last one that this process made.
    last: tuple[str, np.ndarray] | None = None

    def __init__(self, spark: SparkSession, A: np.ndarray, D: np.ndarray, noise: float, bias: bool, listed: np.ndarray | None = None) -> None:
        ensure_checkpoint_dir(spark)
        self.path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpusloom_{uuid.uuid4().hex}.npy"
        self.how = D, noise, bias, listed
        self.shape = len(A), len(A) - bias if listed is None else len(listed)
        half = np.empty(len(A) * (len(A) + 1) // 2)
        pack(A, half)
        if self.local():
            np.save(self.local(), half)
            atexit.register(lambda path: os.path.exists(path) and os.remove(path), self.local())
        else:
            files, path = pa.fs.FileSystem.from_uri(self.path)
            with files.open_output_stream(path) as out:
                np.save(out, half)

    def local(self) -> str:
        return self.path.removeprefix("file:") if self.path.startswith(("file:", "/")) else ""

    @property
    def value(self) -> np.ndarray:
        if SharedMatrix.last is None or SharedMatrix.last[0] != self.path:
            SharedMatrix.last = None
            D, noise, bias, listed = self.how
            if self.local():
                half = np.load(self.local(), mmap_mode="r")
            else:
                files, path = pa.fs.FileSystem.from_uri(self.path)
                with files.open_input_stream(path) as f:
                    half = np.load(io.BytesIO(f.read()))
            B = through(unpacked(half, len(D)), D, noise, bias)
            SharedMatrix.last = self.path, B if listed is None else B[:, listed]
        return SharedMatrix.last[1]


class Hidden:
    """Hidden features f(x B + (x v) c') of one or many settings (v, c), or f(x B) without any; B, of d features and perhaps a bias, is sent
    once. Features of a setting have a last column of ones."""

    def __init__(self, spark: SparkSession, base: np.ndarray | SharedMatrix, d: int, layer: str | int = "tanh", bias: bool = False, pushes: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.layer = CODES.get(layer, layer)
        if self.layer not in ARRAYS:
            raise ValueError(f"no activation {layer!r}")
        self.d, self.bias, self.width = d, bias, base.shape[1]
        self.settings = len(pushes) if pushes else 1
        self.sparse = d > WIDE
        self.sent = base if isinstance(base, SharedMatrix) else spark.sparkContext.broadcast(np.ascontiguousarray(base))
        self.pushed = spark.sparkContext.broadcast(pushes)

    def each(self, batch: pa.RecordBatch, settings: list[int]) -> Iterator[np.ndarray]:
        f, x, pushes, B = (lambda h: quick_tanh(h, h)) if self.layer == "tanh" else ARRAYS[self.layer], block(batch, self.d, self.bias), self.pushed.value, self.sent.value
        if self.sparse and np.count_nonzero(x) < x.size // 20:
            z = np.empty((len(x), self.width))
            for k, row in enumerate(x):
                on = np.flatnonzero(row)
                z[k] = row[on] @ B[on]
        else:
            z = x @ B
        h, out = np.empty_like(z), np.ones((len(x), self.width + 1))
        for k in settings:
            if pushes is None:
                h[:] = z
            else:
                np.multiply.outer(x @ pushes[k][0], pushes[k][1], out=h)
                h += z
            out[:, :-1] = f(h)
            yield out


    def at_once(self, size: np.ndarray, js: np.ndarray, xs: np.ndarray, setting: int = 0, columns: int = 16) -> np.ndarray:
        """(blocks, rows, LANES): hidden features of all sparse rows (their sizes, ids and values), a one, and zeros up to whole blocks, in single
        precision. They are made some blocks at a time, so that what rows gather stays near."""
        B, pushes, start = self.sent.value, self.pushed.value, np.cumsum(size) - size
        blocks, x, some = -(-(self.width + 1) // LANES), xs.astype(np.float32), np.flatnonzero(size)
        out = np.zeros((blocks, len(size), LANES), np.float32)
        f = (lambda h: np.tanh(h, out=h)) if self.layer == "tanh" else ARRAYS[self.layer]
        v, c = pushes[setting] if pushes is not None else (np.zeros(len(B)), np.zeros(self.width))
        s = np.bincount(np.repeat(np.arange(len(size)), size), xs * v[js], len(size)).astype(np.float32)
        for low in range(0, blocks, columns):
            at = slice(low * LANES, min((low + columns) * LANES, self.width))
            part = np.zeros((len(B), len(out[low : low + columns]) * LANES), np.float32)
            part[:, : at.stop - at.start] = B[:, at]
            many = part.shape[1] // LANES
            for k, a, b in zip(some, start[some], start[some] + size[some]):
                out[low : low + many, k] = (x[a:b] @ part[js[a:b]]).reshape(many, LANES)
            for k in range(low, low + many):
                own = np.zeros(LANES, np.float32)
                own[: max(0, min(LANES, self.width - k * LANES))] = c[k * LANES : (k + 1) * LANES]
                h = out[k]
                if self.bias:
                    h += part[-1, (k - low) * LANES : (k - low + 1) * LANES]
                if pushes is not None:
                    h += np.multiply.outer(s, own)
                h[:] = f(h)
        last, at = divmod(self.width, LANES)
        out[last, :, at], out[last, :, at + 1 :] = 1, 0
        return out


def filtered(W: np.ndarray, keep: str | None, k: int = 50) -> np.ndarray:
    """W as it is, with only the k largest of each row (``top``), or only one sign (``positive``, ``negative``)."""
    if keep is None:
        return W
    if keep == "top":
        out, at = np.zeros_like(W), np.argsort(-W, axis=1, kind="stable")[:, :k]
        np.put_along_axis(out, at, np.take_along_axis(W, at, axis=1), axis=1)
        return out
    if keep in ("positive", "negative"):
        return np.maximum(W, 0) if keep == "positive" else np.minimum(W, 0)
    raise ValueError(f"no filter {keep!r}")


def project(rows: DataFrame, W: np.ndarray | Hidden, d: int, layer: str | int = "tanh", bias: bool = False, setting: int = 0) -> DataFrame:
    """Feature rows with js and xs replaced by the hidden features f(x W'), or by those of a setting; no shuffle, W is sent once to each executor."""
    name = CODES.get(layer, layer)
    if name not in ARRAYS:
        raise ValueError(f"no activation {layer!r}")
    many = isinstance(W, Hidden)
    sent = None if many else rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(W.T))
    others = [c for c in rows.columns if c not in ("js", "xs")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in others) + ", js array<bigint>, xs array<double>"

    W = W if many else None  # else tasks would carry it

    def map_(batches: Batches) -> Batches:
        f = ARRAYS[name]
        for whole in batches:
            for batch in slices(whole, d):
                h = next(W.each(batch, [setting]))[:, :-1] if many else f(block(batch, d, bias) @ sent.value)
                offsets = pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1])
                js = pa.ListArray.from_arrays(pa.array(np.zeros(len(h) + 1, np.int32)), pa.array([], pa.int64()))
                xs = pa.ListArray.from_arrays(offsets, pa.array(h.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), js, xs], names=[*others, "js", "xs"])

    return rows.select(*others, "js", "xs").mapInArrow(map_, schema)


def stack(rows: DataFrame, d: int, layers: int = 5, noise: float = 0.9, reg: float = 1e-5, layer: str | int = "tanh", outputs: np.ndarray | None = None) -> tuple[list[DataFrame], list[np.ndarray]]:
    """Outputs and mappings of stacked autoencoders; each layer's rows are written before the next reads them twice. The first layer
    reconstructs all features or the listed ``outputs``, later ones all that they get."""
    outs, maps = [], []
    for k in range(layers):
        W = mapping(moments(rows, d, [], bias=True).total()[2], noise, reg, outputs=None if k else outputs)
        rows = cut(project(rows, W, d, layer, bias=True))
        d = len(W)
        outs.append(rows)
        maps.append(W)
    return outs, maps


def hidden_long(rows: DataFrame) -> DataFrame:
    """(doc_id, i, h) of feature rows."""
    return rows.select("doc_id", F.posexplode("xs").alias("i", "h")).withColumn("i", F.col("i").cast("bigint"))
