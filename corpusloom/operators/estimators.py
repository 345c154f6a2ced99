"""Estimators and experiments of domain adaptation over feature rows (doc_id, domain, label, js, xs)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import metrics
from corpusloom.operators import baselines, denoise
from corpusloom.operators.classify import STRENGTHS, Classifier, Search, cross_validated
from corpusloom.operators.moments import ids, moments, second_moments, unpacked
from corpusloom.plans.session import cut
from corpusloom.plans.tasks import ALPHAS, ETAS


@dataclass
class Corpus:
    """A source with labels and a target; all rows have features 0 .. d - 1. Labels of the target are used for scores only, unless
    ``semi_supervised`` takes the labelled target rows into training."""

    source: DataFrame
    target: DataFrame
    d: int
    semi_supervised: bool = False
    counted: int | None = None

    def all(self) -> DataFrame:
        return self.source.unionByName(self.target)

    def training(self) -> DataFrame:
        """The rows that classifiers learn from."""
        return (self.all() if self.semi_supervised else self.source).where("label > -1")

    def n_training(self) -> int:
        if self.counted is None:
            self.counted = self.training().count()
        return self.counted

    def has_target_labels(self) -> bool:
        return not self.target.where("label > -1").isEmpty()


class Adapter:
    """fit, transform, predict, score. The base fits a classifier on the source as it is (no transfer)."""

    def __init__(self, corpus: Corpus, cv: int = 5, strengths: tuple = STRENGTHS) -> None:
        self.corpus, self.cv, self.strengths = corpus, cv, strengths
        self.classifier: Classifier | None = None

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows

    def width(self) -> int:
        return self.corpus.d

    def fit(self) -> Adapter:
        labelled = self.corpus.training()  # before they are transformed
        self.classifier, self.strength, self.cv_score = cross_validated(self.transform(labelled), self.width(), self.cv, self.strengths, self.corpus.n_training())
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.classifier is None:
            raise ValueError("fit the estimator first")
        return self.classifier.predict(self.transform(rows))

    def score(self, rows: DataFrame) -> float:
        """Accuracy over the labelled rows; nan without any."""
        value = metrics.accuracy(self.predict(rows.where("label > -1"))).first()[0]
        return float("nan") if value is None else value


class MdaAdapter(Adapter):
    """Denoising autoencoder of source and target together, classifier on hidden features; only the ``outputs``
    most frequent features are reconstructed."""

    def __init__(self, corpus: Corpus, noise: float = 0.9, reg: float = 1e-2, layer: str = "tanh", outputs: int | None = 5000, keep: str | None = None, **more) -> None:  # noqa: ANN003
        super().__init__(corpus, **more)
        self.noise, self.reg, self.layer, self.outputs, self.keep = noise, reg, layer, outputs, keep

    def fit(self) -> Adapter:
        rows = self.corpus.all()
        listed = most_frequent(rows, self.outputs) if self.outputs and self.outputs < self.corpus.d else None
        d, spark = self.corpus.d, rows.sparkSession
        if d > denoise.WIDE and self.keep is None and self.noise < 1:
            A, D = denoise.solved_base(unpacked(second_moments(rows, d, bias=True)[0], d + 1), self.noise, self.reg, True)
            base = denoise.SharedMatrix(spark, A, D, self.noise, True, listed)
            del A
        else:
            base = denoise.filtered(denoise.mapping(moments(rows, d, [], bias=True).total()[2], self.noise, self.reg, outputs=listed), self.keep).T
        self.hidden = denoise.Hidden(spark, base, d, self.layer, bias=True)
        search = Search(self.corpus.training(), self.hidden)
        self.classifier, self.strength, self.cv_score = cross_validated(search.setting(0), self.width(), self.cv, self.strengths, None)
        return self

    def width(self) -> int:
        return self.hidden.width

    def transform(self, rows: DataFrame) -> DataFrame:
        return denoise.project(rows, self.hidden, self.corpus.d, self.layer, bias=True)

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.classifier.predict(rows, self.hidden) if self.classifier else super().predict(rows)


class DomainAdapter(Adapter):
    """Domain-regularized autoencoder; strength alpha of the domain classifier and weight eta by cross-validation on the source.

    Moments are scanned once; every setting is solved from them.
    """

    def __init__(self, corpus: Corpus, noise: float = 0.9, alphas: tuple = ALPHAS, etas: tuple = ETAS, mode: str = "target", layer: str = "tanh", **more) -> None:  # noqa: ANN003
        super().__init__(corpus, **more)
        self.noise, self.alphas, self.etas, self.mode, self.layer = noise, alphas, etas, mode, layer

    def fit(self) -> Adapter:
        sides = self.corpus.source.withColumn("side", F.lit(-1)).unionByName(self.corpus.target.withColumn("side", F.lit(1)))
        half, by = second_moments(sides, self.corpus.d, "side")
        none = np.zeros(self.corpus.d)
        (_, source), (_, target) = (by.get(k, (0, none)) for k in (-1, 1))
        S, total, xd = unpacked(half, self.corpus.d), source + target, target - source
        del half
        if self.corpus.d > denoise.WIDE and self.noise < 1:
            solver = denoise.WideDomainSolver(S, total, xd, self.noise, self.alphas, self.mode)
        else:
            solver = denoise.DomainSolver(S, total, xd, self.noise, mode=self.mode)
        del S
        settings, best = [(a, e) for a in self.alphas for e in self.etas], None
        spark, wide = self.corpus.source.sparkSession, isinstance(solver, denoise.WideDomainSolver)
        base = denoise.SharedMatrix(spark, solver.A, solver.D, self.noise, False) if wide else solver.G
        self.hidden = denoise.Hidden(spark, base, self.corpus.d, self.layer, pushes=[solver.push(*s) for s in settings])
        if wide:
            solver = None  # its matrix is in a file by now
        search, self.tried = Search(self.corpus.training(), self.hidden), []
        for k, (alpha, eta) in enumerate(settings):
            classifier, strength, score = cross_validated(search.setting(k), self.width(), self.cv, self.strengths, None)
            self.tried.append((score, alpha, eta))
            if best is None or self.tried[-1] > best[0]:
                best = self.tried[-1], k, classifier, strength
        (self.cv_score, self.alpha, self.eta), self.setting, self.classifier, self.strength = best
        self.W = solver.mapping(self.alpha, self.eta) if solver else None
        return self

    def width(self) -> int:
        return self.hidden.width

    def transform(self, rows: DataFrame) -> DataFrame:
        return denoise.project(rows, self.hidden, self.corpus.d, self.layer, setting=self.setting)

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.classifier.predict(rows, self.hidden, self.setting) if self.classifier else super().predict(rows)


class LatentAdapter(Adapter):
    """Latent semantic features of source and target, of unit length, or as ``appended`` beside the original features at half weight."""

    def __init__(self, corpus: Corpus, rank: int = 100, appended: bool = False, **more) -> None:  # noqa: ANN003
        super().__init__(corpus, **more)
        self.rank, self.appended = rank, appended

    def fit(self) -> Adapter:
        self.V, self.s = baselines.latent(self.corpus.all(), self.corpus.d, self.rank)
        return super().fit()

    def width(self) -> int:
        return len(self.s) + self.corpus.d * self.appended

    def transform(self, rows: DataFrame) -> DataFrame:
        z = baselines.unit(baselines.latent_features(rows, self.V, self.s, self.corpus.d))
        return baselines.beside(rows, z, self.corpus.d, 0.5) if self.appended else z


class AlignedAdapter(Adapter):
    """Spectral feature alignment: projections of domain-specific words beside the original features at half weight."""

    def __init__(self, corpus: Corpus, independent: int = 500, k: int = 100, **more) -> None:  # noqa: ANN003
        super().__init__(corpus, **more)
        self.independent, self.k = independent, k

    def fit(self) -> Adapter:
        g = informative_order(self.corpus)
        self.specific = np.sort(g[self.independent :])
        self.directions = baselines.alignment(moments(self.corpus.all(), self.corpus.d, []), np.sort(g[: self.independent]), self.specific, self.k)
        return super().fit()

    def width(self) -> int:
        return self.corpus.d + self.directions.shape[1]

    def transform(self, rows: DataFrame) -> DataFrame:
        return baselines.beside(rows, baselines.aligned_features(rows, self.directions, self.specific, self.corpus.d), self.corpus.d, 0.5)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(j, df): rows with a non-zero value of each feature."""
    e = rows.select(F.explode(F.arrays_zip(ids().alias("js"), "xs")).alias("e")).where("e.xs <> 0")
    return e.groupBy(F.col("e.js").alias("j")).agg(F.count("*").alias("df"))


def most_frequent(rows: DataFrame, k: int) -> np.ndarray:
    """Ids of the k features in the most rows."""
    return np.sort([r[0] for r in document_frequencies(rows).orderBy(F.desc("df"), "j").limit(k).collect()])


def informative_order(corpus: Corpus) -> np.ndarray:
    """Feature ids from the most independent of the domain to the most specific; at most as many as a dense matrix may have."""
    s, t = (document_frequencies(x).withColumnRenamed("df", c) for x, c in ((corpus.source, "df_s"), (corpus.target, "df_t")))
    both = s.join(t, "j", "full").select("j", F.coalesce("df_s", F.lit(0)).alias("df_s"), F.coalesce("df_t", F.lit(0)).alias("df_t"))
    g = baselines.domain_information(both, corpus.source.count(), corpus.target.count())
    return np.array([r[0] for r in g.orderBy("g", "j").select("j").collect()], np.int64)


@dataclass
class Transduction:
    """Scores of a transductive run: accuracies and, for two classes, areas under the ROC curve."""

    base_accuracy: float
    accuracy: float
    base_auc: float | None = None
    auc: float | None = None
    self_accuracy: float | None = None


def transduce(scored: DataFrame, d: int, n_classes: int, noise: float = 0.9, reg: float = 0.05, layer: str = "tanh") -> DataFrame:
    """Target rows (js, xs, label, probability) with ``score`` and ``predicted`` as denoised from the target alone.

    Class probabilities become features beside the others (one for two classes), the autoencoder reconstructs just those.
    """
    many = 1 if n_classes == 2 else n_classes
    shown = F.slice("probability", 2, 1) if many == 1 else F.col("probability")
    added = F.array(*[F.lit(d + k).cast("bigint") for k in range(many)])
    rows = cut(scored.withColumn("js", F.concat(ids(), added)).withColumn("xs", F.concat("xs", shown)))
    S = moments(rows, d + many, [], bias=True).total()[2]
    W = denoise.mapping(S, noise, reg, outputs=np.arange(d, d + many))
    h = denoise.project(rows, W, d + many, layer, bias=True)
    predicted = (F.col("xs")[0] > 0.5).cast("int") if many == 1 else F.array_position("xs", F.array_max("xs")).cast("int") - 1
    return h.select("doc_id", "label", "probability", F.col("xs").alias("scores"), predicted.alias("predicted"))


def _rates(df: DataFrame, n_classes: int) -> Transduction:
    known = df.where("label > -1")
    base = F.array_position("probability", F.array_max("probability")).cast("int") - 1
    acc = known.agg(F.avg((base == F.col("label")).cast("double")), F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()
    if n_classes > 2:
        return Transduction(*acc)
    aucs = [metrics.roc_auc(known.select("label", s.alias("score"))).first()[0] for s in (F.col("probability")[1], F.col("scores")[0])]
    return Transduction(*acc, *aucs)


def transductive(corpus: Corpus, noise: float = 0.9, cv: int = 5, strengths: tuple = STRENGTHS, self_learning: bool = False, target_features: tuple[DataFrame, int] | None = None) -> Transduction:
    """Source classifier, its probabilities on the target, denoised there. ``target_features`` (rows by doc_id, width) replace the
    features beside which they are denoised. Both the score without transfer and that of self-learning are kept."""
    base = Adapter(corpus, cv, strengths).fit()
    n_classes = len(base.classifier.classes)
    marked = cut(base.predict(corpus.target).select("doc_id", "predicted", "probability"))
    rows, d = target_features or (corpus.target, corpus.d)
    scored = cut(rows.join(marked, "doc_id"))
    out = _rates(transduce(scored.drop("predicted"), d, n_classes, noise), n_classes)
    if self_learning:
        taught = corpus.target.join(marked.select("doc_id", "predicted"), "doc_id").withColumn("label", F.col("predicted")).drop("predicted")
        if marked.agg(F.count_distinct("predicted")).first()[0] < 2:
            out.self_accuracy = out.base_accuracy  # taught a single class, a model says that class, as the first one did
            return out
        model = cross_validated(taught, corpus.d, cv, strengths)[0]
        out.self_accuracy = metrics.accuracy(model.predict(corpus.target.where("label > -1"))).first()[0]
    return out


def transductive_scores(rows: DataFrame, d: int, n_classes: int, noise: float = 0.9, hard: bool = False) -> Transduction:
    """The same from given class scores (``probability``), or from their one-hot decisions, which two classes do not allow."""
    if hard:
        if n_classes == 2:
            raise ValueError("decisions instead of scores need more than two classes")
        best = F.array_position("probability", F.array_max("probability"))
        rows = rows.withColumn("probability", F.transform("probability", lambda x, k: (k + 1 == best).cast("double")))
    return _rates(transduce(rows, d, n_classes, noise), n_classes)


def semi_supervised(rows: DataFrame, d: int, n_train: int = 100, noise: float = 0.9, strength: float = 1.0) -> Transduction:
    """A classifier from ``n_train`` labelled rows, chosen by a hash of their id, denoised over the rest."""
    known = rows.where("label > -1")
    train_ids = known.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(n_train).select("doc_id")
    train_ids = cut(train_ids)
    model = cross_validated(known.join(F.broadcast(train_ids), "doc_id", "left_semi"), d, 2, (strength,))[0]
    rest = cut(known.join(F.broadcast(train_ids), "doc_id", "left_anti"))
    scored = rest.join(model.predict(rest).select("doc_id", "probability"), "doc_id")
    return _rates(transduce(scored, d, 2, noise, layer="identity"), 2)
