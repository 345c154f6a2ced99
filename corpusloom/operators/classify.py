"""Logistic regression with cross-validated strength, all fits of a grid together.

The objective is C times the log loss plus half the squared weights, the intercept included. All models (strengths, folds and
classes) advance in step by L-BFGS, which needs only their gradients; several classes are fitted one against the rest. There are plans
for the same minimisation, and all end at the same relative gradient or fail:

* up to ``most_local`` numbers of labelled features (rows times features, counted), rows go to every executor and tasks share the models;
* beyond that, rows stay where they are, and one scan sums the gradients of all models;
* hidden features of one or many settings (``Search``) are computed in each scan from the rows, for all settings at once, and never
  written. The first scan takes their second moments, from which L-BFGS starts with the curvature that all models share: a few scans are enough;
* of very many features, up to ``MOST_HIDDEN`` numbers of a setting, the sparse rows go to every executor, and a task makes the hidden features of
  one setting once, in single precision, and fits all its models from them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from corpusloom.operators.denoise import Hidden
from corpusloom.operators.moments import block, pack, slices, unpacked
from corpusloom.plans.blas import single_thread
from corpusloom.plans.partial import Batches, summed
from corpusloom.plans.session import cut, freed, kept

#: The strengths that are tried.
STRENGTHS = (1e-4, 1e-3, 0.1, 1.0, 10.0)
#: Steps of L-BFGS that are remembered, the gradient at its end as a share of that at its start, rounds after which it fails.
MEMORY, TOLERANCE, ROUNDS = 10, 1e-4, 1000
#: Numbers (rows times features) that are sent to every executor: 96 MB.
MOST_LOCAL = 12_000_000
#: Features up to which the curvature is a whole matrix; of more, its diagonal and as many directions, found in so many scans.
WHOLE_CURVATURE, DIRECTIONS, PASSES = 1000, 100, 2
#: Numbers (rows times hidden features) of one setting that a task holds in single precision: 500 MB. Rows of which it works at a time.
MOST_HIDDEN, AT_ONCE = 125_000_000, 512
#: Error of a loss in single precision as a share of it, and directions that are found where rounds are cheap.
SINGLE, FEW = 1e-7, 10
#: Numbers (models times features) that the steps of one search hold on the driver, each 2 x MEMORY times.
MOST_HELD = 600_000


@dataclass
class Classifier:
    """Weights (classes or 1, features + intercept) of a fitted model."""

    weights: np.ndarray
    classes: list
    d: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every class for rows of features with a last column of ones."""
        return probabilities(x @ self.weights.T)

    def predict(self, rows: DataFrame, hidden: Hidden | None = None, setting: int = 0) -> DataFrame:
        """``rows`` without features, with ``predicted`` and ``probability`` (of each class), from their features or the hidden ones of a setting."""
        sent = rows.sparkSession.sparkContext.broadcast(self)
        others = [f for f in rows.schema if f.name not in ("js", "xs")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", predicted int, probability array<double>"

        def score(batches: Batches) -> Batches:
            model = sent.value
            named = np.array(model.classes, np.int32)
            for whole in batches:
                for batch in slices(whole, model.d):
                    p = model.scores(block(batch, model.d, True) if hidden is None else next(hidden.each(batch, [setting])))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
                    cols = [batch.column(f.name) for f in others]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(named[p.argmax(axis=1)]), lists], names=[*(f.name for f in others), "predicted", "probability"])

        return rows.mapInArrow(score, schema)


def probabilities(z: np.ndarray) -> np.ndarray:
    """Of every class, from the values of one (two classes) or all models."""
    p = 1 / (1 + np.exp(-z))
    if z.shape[1] == 1:
        return np.concatenate([1 - p, p], axis=1)
    return p / p.sum(axis=1, keepdims=True)


def folds(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``fold``, by a hash of the document id."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(k)).cast("int"))


@dataclass
class Problems:
    """Binary fits: of each its strength, the fold it leaves out (or -1) and the class it sets against the others."""

    strength: np.ndarray
    left: np.ndarray
    head: np.ndarray

    def some(self, at: list[int]) -> Problems:
        return Problems(self.strength[at], self.left[at], self.head[at])

    def gradients(self, x: np.ndarray, label: np.ndarray, fold: np.ndarray, W: np.ndarray) -> np.ndarray:
        """(problems, features + 1): gradients of the log loss and, last, the loss itself, added up over rows."""
        error, loss = self.errors(x @ W.T, label, fold)
        return np.c_[error.T @ x, loss]

    def errors(self, z: np.ndarray, label: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, problems): what is too much of each probability, and the log loss of each problem."""
        on = fold[:, None] != self.left[None, :]
        y = label[:, None] == self.head[None, :]
        error = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) * on
        return error, ((np.logaddexp(0, z) - y * z) * on).sum(axis=0)


class Descent:
    """L-BFGS of one problem: ``trial`` is the point whose value and gradient it wants to be told next. ``curved`` applies the inverse
    of a curvature to start from, which ``scaled`` fits to the last step; values may err by ``slack``, as a share of them."""

    def __init__(self, m: int, curved: Callable[[np.ndarray], np.ndarray] | None = None, scaled: bool = False, slack: float = 0.0) -> None:
        self.trial, self.w, self.done, self.curved, self.scaled, self.slack = np.zeros(m), None, False, curved, scaled, slack
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.w is None:
            self.least = TOLERANCE * float(np.sqrt(g @ g))
        else:
            slope = float(self.g @ self.p)
            if not f <= self.f + 1e-4 * self.step * slope + self.slack * abs(self.f):  # too far: to the least of the parabola, or a tenth
                if self.step < 1e-12:
                    raise ArithmeticError("the classifier's line search found no descent")
                bend = f - self.f - self.step * slope
                self.step *= min(max(-slope * self.step / (2 * bend), 0.1), 0.5) if np.isfinite(bend) and bend > 0 else 0.1
                self.trial = self.w + self.step * self.p
                return
            s, y = self.trial - self.w, g - self.g
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                self.pairs = [*self.pairs[1 - MEMORY :], (s, y, 1 / float(s @ y))]
        self.w, self.f, self.g = self.trial, f, g
        norm = float(np.sqrt(g @ g))
        if norm <= self.least:
            self.done = True
            return
        q, back = g.copy(), []
        for s, y, r in reversed(self.pairs):
            back.append(r * float(s @ q))
            q -= back[-1] * y
        if self.curved:
            q = self.curved(q)
            if self.scaled and self.pairs:
                _, y, r = self.pairs[-1]
                q /= r * float(y @ self.curved(y))
        elif self.pairs:
            s, y, r = self.pairs[-1]
            q *= 1 / (r * float(y @ y))
        for (s, y, r), c in zip(self.pairs, reversed(back)):
            q += (c - r * float(y @ q)) * s
        self.p, self.step = -q, 1.0 if self.pairs or self.curved else 1 / norm
        self.trial = self.w + self.step * self.p


def minimise(problems: Problems, m: int, evaluate: Callable[[Problems, np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights (problems, m); ``evaluate`` gives ``gradients`` over all rows of the problems that still run."""
    return advance(problems, [Descent(m) for _ in problems.left], lambda at, W: evaluate(problems.some(at), W))


def advance(problems: Problems, each: list[Descent], evaluate: Callable[[list[int], np.ndarray], np.ndarray]) -> np.ndarray:
    for _ in range(ROUNDS):
        at = [k for k, x in enumerate(each) if not x.done]
        if not at:
            return np.stack([x.w for x in each])
        W = np.stack([each[k].trial for k in at])
        for k, w, out in zip(at, W, evaluate(at, W)):
            c = float(problems.strength[k])
            each[k].tell(c * out[-1] + 0.5 * float(w @ w), c * out[:-1] + w)
    raise ArithmeticError(f"the classifier did not converge in {ROUNDS} rounds")


def right(models: list[Classifier], left: np.ndarray, x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(models, 2): rows of the fold that each model leaves out which it gets right, and all of them."""
    out = np.zeros((len(models), 2))
    for i, (model, k) in enumerate(zip(models, left)):
        on = fold == k
        if on.any():
            out[i] = (np.array(model.classes)[model.scores(x[on]).argmax(axis=1)] == label[on]).sum(), on.sum()
    return out


def _matrix(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return block(batch, d, True), batch.column("label").to_numpy(), batch.column("fold").to_numpy()


def _of(models: list[tuple[float, int]], heads: list) -> Problems:
    every = [(s, left, h) for s, left in models for h in heads]
    return Problems(np.array([e[0] for e in every]), np.array([e[1] for e in every]), np.array([e[2] for e in every]))


def _heads(listed: list) -> list:
    """The classes that are set against the others: one of two."""
    if len(listed) < 2:
        raise ValueError("a classifier needs rows of at least two classes")
    return listed[1:] if len(listed) == 2 else listed


def _by_scans(ready: DataFrame, d: int, models: list[tuple[float, int]]) -> tuple[list, np.ndarray, np.ndarray]:
    ready = cut(ready.drop("doc_id"))
    listed = sorted(r[0] for r in ready.select("label").distinct().collect())
    heads = _heads(listed)

    def over(width: tuple[int, int], add: Callable[..., np.ndarray]) -> np.ndarray:
        def partial(batches: Batches) -> np.ndarray:
            out = np.zeros(width)
            for whole in batches:
                for batch in slices(whole, d):
                    out += add(*_matrix(batch, d))
            return out.reshape(-1)

        return summed(ready, partial, width[0] * width[1]).reshape(width)

    W = minimise(_of(models, heads), d + 1, lambda some, W: over((len(W), d + 2), lambda x, label, fold: some.gradients(x, label, fold, W)))
    W = W.reshape(len(models), len(heads), d + 1)
    fitted, left = [Classifier(w, listed, d) for w in W], np.array([f for _, f in models])
    return listed, W, over((len(models), 2), lambda x, label, fold: right(fitted, left, x, label, fold))


def _by_models(ready: DataFrame, d: int, models: list[tuple[float, int]]) -> tuple[list, np.ndarray, np.ndarray]:
    def dense(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, d):
                x, label, fold = _matrix(batch, d)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(label), pa.array(fold)], names=["doc_id", "x", "label", "fold"])

    spark = ready.sparkSession
    got = ready.mapInArrow(dense, f"doc_id {ready.schema['doc_id'].dataType.simpleString()}, x binary, label int, fold int").toArrow()
    order = pa.compute.sort_indices(got.column("doc_id"))  # whatever the order of arrival, the same sums
    x = np.frombuffer(b"".join(v.as_py() for v in got.column("x")), float).reshape(-1, d + 1)[order]
    label, fold = (got.column(c).to_numpy()[order] for c in ("label", "fold"))
    listed = np.unique(label).tolist()
    heads, sent = _heads(listed), spark.sparkContext.broadcast((x, label, fold))

    def fit(batches: Batches) -> Batches:
        single_thread()
        x, label, fold = sent.value
        own = [k for batch in batches for k in batch.column(0).to_pylist()]
        if not own:
            return
        mine = [models[k] for k in own]
        W = minimise(_of(mine, heads), d + 1, lambda some, W: some.gradients(x, label, fold, W)).reshape(len(mine), len(heads), d + 1)
        hits = right([Classifier(w, listed, d) for w in W], np.array([f for _, f in mine]), x, label, fold)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([w.tobytes() for w in W], pa.binary()), pa.array(hits[:, 0]), pa.array(hits[:, 1])], names=["k", "w", "hit", "n"])

    tasks = min(len(models), spark.sparkContext.defaultParallelism)
    out = spark.range(0, len(models), 1, tasks).mapInArrow(fit, "k long, w binary, hit double, n double").toArrow().sort_by("k")
    sent.destroy()  # nothing lazy reads it, and a search sends one for each setting
    W = np.frombuffer(b"".join(v.as_py() for v in out.column("w")), float).reshape(len(models), len(heads), d + 1)
    return listed, W, np.stack([out.column("hit").to_numpy(), out.column("n").to_numpy()], axis=1)


def _whole_curvature(A: np.ndarray, c: float) -> Callable[[np.ndarray], np.ndarray]:
    inverse = np.linalg.inv(c * A + np.eye(len(A)))
    return lambda q: inverse @ q


def _partial_curvature(D: np.ndarray, scale: np.ndarray, U: np.ndarray, lam: np.ndarray, c: float) -> Callable[[np.ndarray], np.ndarray]:
    """Inverse of 1 + c D beside what directions U (of scaled features) have above it."""
    root = np.sqrt(1 + c * D)
    a, b = 1 / (scale * root), np.sqrt(c * np.maximum(lam - 1, 0))
    inner = np.linalg.inv(np.eye(len(b)) + b[:, None] * ((U * a[:, None] ** 2).T @ U) * b[None, :])

    def apply(q: np.ndarray) -> np.ndarray:  # U is shared by all models of a setting
        r = q / root
        return (r - a * (U @ (b * (inner @ (b * (U.T @ (a * r))))))) / root

    return apply


def _spectrum(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading directions of a matrix and their values, from its product ``y`` with orthonormal columns ``q``."""
    C = q.T @ y
    w, E = np.linalg.eigh((C + C.T) / 2)
    U, lam, _ = np.linalg.svd(y @ E / np.sqrt(np.maximum(w, 1e-12 * w.max())), full_matrices=False)
    return U, lam * lam


def fitted_at_once(H: np.ndarray, m: int, label: np.ndarray, fold: np.ndarray, listed: list, models: list[tuple[float, int]]) -> tuple[list[Classifier], np.ndarray]:
    """All models of ``Hidden.at_once``, and (models, 2): rows of the fold left out that each gets right, and all. Products are of small blocks,
    which BLAS takes as they lie."""
    blocks, n, w = H.shape
    parts, heads = [slice(low, low + AT_ONCE) for low in range(0, n, AT_ONCE)], _heads(listed)
    own = _of(models, heads)

    def forward(part: slice, V: np.ndarray) -> np.ndarray:
        return sum(H[b, part] @ V[b] for b in range(blocks)).astype(float)

    def back(part: slice, E: np.ndarray, out: np.ndarray) -> None:
        E = E.astype(H.dtype)
        for b in range(blocks):
            out[b] += H[b, part].T @ E

    def cut_up(V: np.ndarray) -> np.ndarray:
        """Columns of features in the blocks of H."""
        return np.pad(V, ((0, blocks * w - m), (0, 0))).reshape(blocks, w, -1).astype(H.dtype)

    total, squares = (v.reshape(-1)[:m] for v in (H.sum(axis=1, dtype=float), np.stack([np.einsum("ij,ij->j", h, h) for h in H]).astype(float)))
    D = np.maximum(squares - total * total / n, 0)
    scale = 1 / np.sqrt(0.4 + D)
    O = np.c_[total / n / scale, np.random.default_rng(1).normal(size=(m, min(FEW, m) - 1))]
    for _ in range(PASSES):
        Q = np.linalg.qr(O)[0]
        V, out = cut_up(scale[:, None] * Q), np.zeros((blocks, w, O.shape[1]))
        for part in parts:
            back(part, forward(part, V), out)
        O = scale[:, None] * out.reshape(blocks * w, -1)[:m]
    low, made, each = (D, scale, *_spectrum(Q, O)), {}, []
    for s, left in zip(own.strength, own.left):
        if (s, left) not in made:
            made[s, left] = _partial_curvature(*low, float(s) * (fold != left).sum() / n / 4)
        each.append(Descent(m, made[s, left], scaled=True, slack=SINGLE))

    def evaluate(at: list[int], W: np.ndarray) -> np.ndarray:
        some, V, out, losses = own.some(at), cut_up(W.T), np.zeros((blocks, w, len(W))), np.zeros(len(W))
        for part in parts:
            error, loss = some.errors(forward(part, V), label[part], fold[part])
            back(part, error, out)
            losses += loss
        return np.c_[out.reshape(blocks * w, -1)[:m].T, losses]

    W = advance(own, each, evaluate)
    V, named, hits = cut_up(W.T), np.array(listed), np.zeros((len(models), 2))
    for part in parts:
        z = forward(part, V).reshape(-1, len(models), len(heads))
        for i, (_, left) in enumerate(models):
            on = fold[part] == left
            if on.any():
                hits[i] += (named[probabilities(z[on, i]).argmax(axis=1)] == label[part][on]).sum(), on.sum()
    return [Classifier(w, listed, m - 1) for w in W.reshape(len(models), len(heads), m)], hits


class Search:
    """Classifiers over the hidden features of all settings of ``hidden``, fitted together; ``setting(i)`` stands for the rows of one.

    Rows stay where they are. A scan adds up what all models ask for, over as many settings as the driver holds steps of."""

    def __init__(self, rows: DataFrame, hidden: Hidden) -> None:
        self.rows, self.hidden, self.found = rows, hidden, {}

    def setting(self, i: int) -> Setting:
        return Setting(self, i)

    def fitted(self, i: int, k: int, strengths: tuple) -> tuple[Classifier, float, float]:
        if (k, strengths) not in self.found:
            known, models = folds(self.rows.where("label > -1"), k), [(s, f) for s in strengths for f in (*range(k), -1)]
            if self.hidden.sparse and self._few(known):
                self.found[k, strengths] = self._each_at_once(known, models, strengths)
                return self.found[k, strengths][i]
            ready = kept(self.shared(known).select(F.col("label").cast("int").alias("label"), "fold", "js", "xs"))
            listed = sorted(r[0] for r in ready.select("label").distinct().collect())
            many = max(1, MOST_HELD // (len(models) * len(_heads(listed)) * (self.hidden.width + 1)))
            out = []
            for low in range(0, self.hidden.settings, many):
                out += self._group(ready, listed, models, strengths, k, list(range(low, min(low + many, self.hidden.settings))))
            self.found[k, strengths] = out
        return self.found[k, strengths][i]

    def _few(self, known: DataFrame) -> bool:
        """Whether rows are sparse, and few enough for a task to hold the hidden features of a setting."""
        n, entries, named = known.agg(F.count("*"), F.sum(F.size("xs")), F.sum(F.size("js"))).first()
        return 0 < n * (self.hidden.width + 1) <= MOST_HIDDEN and named == entries <= MOST_LOCAL

    def _each_at_once(self, known: DataFrame, models: list[tuple[float, int]], strengths: tuple) -> list[tuple[Classifier, float, float]]:
        """Fits of all settings, a task for each; tasks share the sparse rows."""
        got = known.select("doc_id", F.col("label").cast("int").alias("label"), "fold", "js", "xs").toArrow()
        got = got.take(pa.compute.sort_indices(got.column("doc_id"))).combine_chunks()  # whatever the order of arrival, the same sums
        label, fold, size = (x.to_numpy() for x in (got.column("label"), got.column("fold"), pa.compute.list_value_length(got.column("xs"))))
        js, xs = (pa.compute.list_flatten(got.column(c)).to_numpy() for c in ("js", "xs"))
        listed, hidden, spark = np.unique(label).tolist(), self.hidden, known.sparkSession
        heads, sent = _heads(listed), spark.sparkContext.broadcast((label, fold, size, js.astype(np.int32), xs))

        def fit(batches: Batches) -> Batches:
            single_thread()
            label, fold, size, js, xs = sent.value
            for i in [i for batch in batches for i in batch.column(0).to_pylist()]:
                fits, hits = fitted_at_once(hidden.at_once(size, js, xs, i), hidden.width + 1, label, fold, listed, models)
                model, strength, score = _best(models, strengths, hits, lambda at, fits=fits: fits[at])
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([model.weights.tobytes()], pa.binary()), pa.array([strength]), pa.array([score])], names=["i", "w", "strength", "score"])

        out = spark.range(0, hidden.settings, 1, hidden.settings).mapInArrow(fit, "i long, w binary, strength double, score double").toArrow().sort_by("i").to_pylist()
        sent.destroy()
        m = hidden.width + 1
        return [(Classifier(np.frombuffer(r["w"], float).reshape(len(heads), m), listed, m - 1), r["strength"], r["score"]) for r in out]

    @staticmethod
    def shared(rows: DataFrame) -> DataFrame:
        """``rows`` in equal shares of all cores: every scan takes as long as its largest share."""
        return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "doc_id")

    def _over(self, ready: DataFrame, asked: list[int], width: int, add: Callable[..., np.ndarray]) -> np.ndarray:
        """(settings asked, width): sums over all rows of what ``add`` makes of a setting's place, features, labels and folds."""
        hidden = self.hidden

        def partial(batches: Batches) -> np.ndarray:
            single_thread()
            out = np.zeros((len(asked), width))
            for whole in batches:
                for batch in slices(whole, hidden.width):
                    label, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                    for at, x in enumerate(hidden.each(batch, asked)):
                        out[at] += add(at, x, label, fold).reshape(-1)
            return out.reshape(-1)

        return summed(ready, partial, len(asked) * width, tasks=ready.sparkSession.sparkContext.defaultParallelism).reshape(len(asked), width)

    def _group(self, ready: DataFrame, listed: list, models: list[tuple[float, int]], strengths: tuple, k: int, asked: list[int]) -> list[tuple[Classifier, float, float]]:
        m, heads = self.hidden.width + 1, _heads(listed)
        own = _of(models, heads)
        size, whole = len(own.left), m <= WHOLE_CURVATURE
        cells = [(f, c) for f in range(k) for c in listed]

        def first(at: int, x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> np.ndarray:
            on = np.stack([(fold == f) & (label == c) for f, c in cells]).astype(float)
            if not whole:
                return np.r_[(on @ x).reshape(-1), (x * x).sum(axis=0)]
            out = np.empty(len(cells) * m + m * (m + 1) // 2)
            out[: len(cells) * m] = (on @ x).reshape(-1)
            pack(x.T @ x, out[len(cells) * m :])
            return out

        sums = self._over(ready, asked, len(cells) * m + (m * (m + 1) // 2 if whole else m), first)
        by = sums[:, : len(cells) * m].reshape(len(asked), len(cells), m)
        rest = [unpacked(v, m) if whole else v for v in sums[:, len(cells) * m :]]
        total = by.sum(axis=1)
        n = total[0, -1]
        low = [] if whole else self._directions(ready, asked, total, rest)
        each, starts = [], []
        for at in range(len(asked)):
            made: dict[tuple[float, int], Callable] = {}
            for s, left, head in zip(own.strength, own.left, own.head):
                on = [i for i, (f, _) in enumerate(cells) if f != left]
                count = by[at, on, -1].sum()
                key = float(s), int(left)
                if key not in made:
                    c = float(s) * count / n / 4
                    made[key] = _whole_curvature(rest[at], c) if whole else _partial_curvature(*low[at], c)
                each.append(Descent(m, made[key]))
                g = 0.5 * by[at, on].sum(axis=0) - by[at, [i for i in on if cells[i][1] == head]].sum(axis=0)
                starts.append((s * count * np.log(2), s * g))
        for x, (f, g) in zip(each, starts):  # at weights of zero, the sums say it
            x.tell(f, g)

        rounds = 0

        def evaluate(at: list[int], W: np.ndarray) -> np.ndarray:
            nonlocal rounds
            rounds += 1
            if not whole and rounds % 4 == 0:
                freed(ready.sparkSession)
            parts = {i: [p for p, q in enumerate(at) if q // size == i] for i in range(len(asked))}
            live = [i for i in parts if parts[i]]
            some, weights = [own.some([at[p] % size for p in parts[i]]) for i in live], [W[parts[i]] for i in live]
            most = max(len(w) for w in weights)

            def add(place: int, x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> np.ndarray:
                out = np.zeros((most, m + 1))
                out[: len(weights[place])] = some[place].gradients(x, label, fold, weights[place])
                return out

            got, out = self._over(ready, [asked[i] for i in live], most * (m + 1), add).reshape(len(live), most, m + 1), np.empty((len(at), m + 1))
            for place, i in enumerate(live):
                out[parts[i]] = got[place, : len(parts[i])]
            return out

        every = Problems(*[np.tile(v, len(asked)) for v in (own.strength, own.left, own.head)])
        W = advance(every, each, evaluate).reshape(len(asked), len(models), len(heads), m)
        left = np.array([f for _, f in models])
        fits = [[Classifier(w, listed, m - 1) for w in of] for of in W]
        hits = self._over(ready, asked, 2 * len(models), lambda at, x, label, fold: right(fits[at], left, x, label, fold)).reshape(len(asked), len(models), 2)
        return [_best(models, strengths, hits[at], lambda i, of=of: of[i]) for at, of in enumerate(fits)]

    def _directions(self, ready: DataFrame, asked: list[int], total: np.ndarray, squares: list[np.ndarray]) -> list[tuple]:
        """Of each setting the diagonal of its curvature without the mean, a scale of features, and the leading directions of scaled features
        with their second moments, by subspace iteration from the mean and random vectors."""
        m = total.shape[1]
        p = min(DIRECTIONS, m)
        D = [np.maximum(q - s * s / s[-1], 0) for q, s in zip(squares, total)]
        scale = [1 / np.sqrt(0.4 + x) for x in D]
        start = np.random.default_rng(1).normal(size=(m, p))
        O = [np.c_[s / s[-1] / z, start[:, 1:]] for s, z in zip(total, scale)]
        for _ in range(PASSES):
            Q = [np.linalg.qr(o)[0] for o in O]
            sent = [z[:, None] * q for z, q in zip(scale, Q)]
            got = self._over(ready, asked, m * p, lambda at, x, label, fold: x.T @ (x @ sent[at])).reshape(len(asked), m, p)
            O = [z[:, None] * y for z, y in zip(scale, got)]
        out = []
        for d, z, q, y in zip(D, scale, Q, O):
            out.append((d, z, *_spectrum(q, y)))
        return out


@dataclass
class Setting:
    """The rows of one setting of a search."""

    search: Search
    i: int


def _best(models: list[tuple[float, int]], strengths: tuple, hits: np.ndarray, made: Callable[[int], Classifier]) -> tuple[Classifier, float, float]:
    means = []
    for s in strengths:
        own = [hits[i, 0] / hits[i, 1] for i, (t, f) in enumerate(models) if t == s and f >= 0 and hits[i, 1]]
        means.append(float(np.mean(own)) if own else 0.0)
    best = int(np.argmax(means))
    return made(models.index((strengths[best], -1))), strengths[best], means[best]


def cross_validated(
    rows: DataFrame | Setting, d: int, k: int = 5, strengths: tuple = STRENGTHS, n: int | None = None, most_local: int = MOST_LOCAL
) -> tuple[Classifier, float, float]:
    """(classifier fitted on all labelled rows with the best strength, that strength, its mean accuracy over the folds).

    Of equal strengths the smaller one is taken. Rows whose label is null or -1 are left out; ``n`` may say how many are left, which
    saves counting them. A fold without rows is left out of the mean.
    """
    if isinstance(rows, Setting):
        return rows.search.fitted(rows.i, k, strengths)
    known = rows.where("label > -1")
    n = known.count() if n is None else n
    ready = folds(known, k).select("doc_id", F.col("label").cast("int").alias("label"), "fold", "js", "xs")
    models = [(s, f) for s in strengths for f in (*range(k), -1)]
    listed, W, hits = (_by_models if n * (d + 1) <= most_local else _by_scans)(ready, d, models)
    return _best(models, strengths, hits, lambda i: Classifier(W[i], listed, d))
