"""Baselines of domain adaptation: latent semantic features, domain mutual information, spectral feature alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.denoise import project
from corpusloom.operators.moments import Moments, ids, moments

TINY = 1e-8


def smooth_log(x: Column) -> Column:
    return F.log(x + TINY)


def latent(rows: DataFrame, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(V d x k, singular values k) of the rows' matrix, from its Gram matrix; directions without any variance are left out.

    Signs are fixed so that the largest entry of each direction is positive.
    """
    values, V = np.linalg.eigh(moments(rows, d, []).total()[2])
    order = np.argsort(-values)[:k]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-300)]
    V = V[:, order]
    sign = np.sign(V[np.abs(V).argmax(axis=0), np.arange(V.shape[1])])
    return V * sign, np.sqrt(values[order])


def latent_features(rows: DataFrame, V: np.ndarray, s: np.ndarray, d: int) -> DataFrame:
    """U sqrt(S) of any rows, X V S^-1/2: the same for the rows of the fit and for new ones."""
    return project(rows, (V / np.sqrt(s)[None, :]).T, d, "identity")


def unit(rows: DataFrame) -> DataFrame:
    """Feature rows of unit length; rows of zeros stay."""
    norm = F.sqrt(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("_norm", norm).withColumn("xs", F.when(F.col("_norm") > 0, F.transform("xs", lambda x: x / F.col("_norm"))).otherwise(F.col("xs"))).drop("_norm")


def beside(rows: DataFrame, more: DataFrame, offset: int, gamma: float = 1.0, key: str = "doc_id") -> DataFrame:
    """``rows`` with the features of ``more`` renumbered from ``offset`` and scaled by gamma."""
    added = more.select(key, F.transform(ids(), lambda j: j + offset).alias("_j"), F.transform("xs", lambda x: x * gamma).alias("_x"))
    both = rows.join(added, key)
    return both.withColumn("js", F.concat(ids(), "_j")).withColumn("xs", F.concat("xs", "_x")).drop("_j", "_x")


def domain_information(presence: DataFrame, n_source: int, n_target: int) -> DataFrame:
    """(j, g) of document frequencies (j, df_s, df_t): mutual information of a word's presence and the domain, of the
    terms of presence only. Frequencies are raised by one half, logarithms smoothed."""
    n = float(n_source + n_target)
    s, t = F.col("df_s") + 0.5, F.col("df_t") + 0.5
    word = smooth_log((s + t) / n)
    gain = [x / n * (smooth_log(x / n) - word - smooth_log(F.lit(k / n))) for x, k in ((s, n_source), (t, n_target))]
    return presence.select("j", (gain[0] + gain[1]).alias("g"))


def alignment(m: Moments, independent: np.ndarray, specific: np.ndarray, k: int) -> np.ndarray:
    """Directions (specific words x k) of spectral feature alignment, from the co-occurrences of words of unit length.

    The graph of words is bipartite, so its leading eigenvectors come from the singular vectors of the normalised block of specific by
    independent words; each singular pair stands for two eigenvectors of opposite sign, of which one is kept.
    """
    S = m.total()[2]
    norm = np.sqrt(np.maximum(np.diag(S), 1e-300))
    A = np.maximum((S / np.outer(norm, norm))[np.ix_(specific, independent)], 0)
    rows, cols = np.maximum(A.sum(axis=1), 1e-12), np.maximum(A.sum(axis=0), 1e-12)
    U, _, _ = np.linalg.svd(A / np.sqrt(rows)[:, None] / np.sqrt(cols)[None, :], full_matrices=False)
    U = U[:, :k]
    sign = np.sign(U[np.abs(U).argmax(axis=0), np.arange(U.shape[1])])
    return U * sign


def aligned_features(rows: DataFrame, directions: np.ndarray, specific: np.ndarray, d: int) -> DataFrame:
    """Projections of rows on the directions of specific words."""
    W = np.zeros((directions.shape[1], d))
    W[:, specific] = directions.T
    return project(rows, W, d, "identity")
