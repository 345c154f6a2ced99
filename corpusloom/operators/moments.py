"""First and second moments of feature rows by group: what every closed-form solver needs.

Feature rows are documents with sparse arrays ``js`` (feature ids) and ``xs`` (values); with ``js`` empty, ``xs`` are the values of
features 0, 1, ... One scan gives, for each group
(such as domain and class), the number of documents, the sums of features and the second-moment (Gram)
matrix. Each Arrow batch becomes a dense block whose product with itself is added up in its task; tasks send one
vector of fixed size, so there is no shuffle of feature pairs and no group is ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.plans.blas import single_thread
from corpusloom.plans.partial import Batches, summed
from corpusloom.plans.session import freed

#: More features than this need another representation than a dense matrix on the driver.
WIDEST = 5000
#: More features than this are solved in the memory of one matrix, which goes to a file.
WIDE = 1000
BLOCK = 2048
#: Entries of sparse rows up to which the driver adds up their pairs of very many features itself: 192 MB.
MOST_ENTRIES = 12_000_000
#: Groups (values of the keys, such as domain and class) that moments are taken of.
MOST_GROUPS = 1000


def feature_rows(docs: DataFrame, x: DataFrame) -> DataFrame:
    """``docs`` with js and xs of features (doc_id, j, x); documents without features have empty arrays."""
    per = x.groupBy("doc_id").agg(F.collect_list("j").alias("js"), F.collect_list(F.col("x").cast("double")).alias("xs"))
    out = docs.join(per, "doc_id", "left")
    return out.withColumn("js", F.coalesce("js", F.array().cast("array<bigint>"))).withColumn("xs", F.coalesce("xs", F.array().cast("array<double>")))


def dense_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows of an array column as feature rows; a null array is a row of zeros."""
    xs = F.coalesce(F.col(column).cast("array<double>"), F.array().cast("array<double>"))
    return df.withColumn("js", F.array().cast("array<bigint>")).withColumn("xs", xs)


def ids() -> Column:
    """The ids of a row's features, whether ``js`` names them or not."""
    dense = (F.size("js") == 0) & (F.size("xs") > 0)
    return F.when(dense, F.sequence(F.lit(0).cast("bigint"), (F.size("xs") - 1).cast("bigint"))).otherwise(F.col("js"))


def block(batch: pa.RecordBatch, d: int, bias: bool = False) -> np.ndarray:
    """The features of a batch as a dense matrix, with a last column of ones for a bias."""
    js, xs = batch.column("js"), batch.column("xs")
    out = np.zeros((batch.num_rows, d + bias))
    size, named = (c.value_lengths().to_numpy(zero_copy_only=False) for c in (xs, js))
    row = np.repeat(np.arange(batch.num_rows), size)
    value = xs.flatten().to_numpy()
    at = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
    at[np.repeat(named > 0, size)] = js.flatten().to_numpy()
    out[row, at] = value
    if bias:
        out[:, d] = 1.0
    return out


def slices(batch: pa.RecordBatch, d: int) -> Batches:
    """Parts of a batch whose dense blocks stay small."""
    single_thread()
    most = max(1, min(BLOCK, (1 << 22) // (d + 1)))
    for low in range(0, batch.num_rows, most):
        yield batch.slice(low, most)


def pack(S: np.ndarray, out: np.ndarray) -> None:
    """The upper half of a symmetric matrix, row by row."""
    at = 0
    for i in range(len(S)):
        out[at : at + len(S) - i] = S[i, i:]
        at += len(S) - i


def unpacked(half: np.ndarray, m: int) -> np.ndarray:
    out, at = np.empty((m, m)), 0
    for i in range(m):
        out[i, i:] = out[i:, i] = half[at : at + m - i]
        at += m - i
    return out


@dataclass
class Moments:
    """Counts n (groups), sums s (groups x d) and second moments S (groups x d x d) of groups (tuples of key values)."""

    groups: list[tuple]
    n: np.ndarray
    s: np.ndarray
    S: np.ndarray

    def of(self, keep) -> tuple[float, np.ndarray, np.ndarray]:  # noqa: ANN001
        """(n, s, S) of all groups for which ``keep(group)`` holds."""
        at = [k for k, g in enumerate(self.groups) if keep(g)]
        if len(at) == 1:
            return self.n[at[0]], self.s[at[0]], self.S[at[0]]
        return self.n[at].sum(), self.s[at].sum(axis=0), self.S[at].sum(axis=0)

    def total(self) -> tuple[float, np.ndarray, np.ndarray]:
        return self.of(lambda g: True)


def moments(rows: DataFrame, d: int, keys: list[str], bias: bool = False) -> Moments:
    """Moments of feature rows by the values of the ``keys`` columns, which have few distinct values."""
    if d > WIDEST:
        raise ValueError(f"{d} features; the solvers hold matrices of at most {WIDEST} features")
    single_thread()
    groups = [()]
    if keys:
        found = rows.select(*keys).distinct().limit(MOST_GROUPS + 1).collect()
        if len(found) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups of {keys}")
        groups = sorted((tuple(r) for r in found), key=lambda g: tuple((x is None, x) for x in g))
    number, m = {g: k for k, g in enumerate(groups)}, d + bias
    half = m * (m + 1) // 2
    one = half + m + 1

    def partial(batches: Batches) -> np.ndarray:
        S, s, n = np.zeros((len(groups), m, m)), np.zeros((len(groups), m)), np.zeros(len(groups))
        for whole in batches:
            for batch in slices(whole, d):
                x = block(batch, d, bias)
                own = np.array([number[g] for g in zip(*[batch.column(k).to_pylist() for k in keys])] if keys else [0] * len(x), np.int64)
                for k in np.unique(own):
                    part = x[own == k]
                    S[k] += part.T @ part
                    s[k] += part.sum(axis=0)
                    n[k] += len(part)
        out = np.empty((len(groups), one))
        for k in range(len(groups)):
            pack(S[k], out[k, :half])
            out[k, half:-1], out[k, -1] = s[k], n[k]
        return out.reshape(-1)

    all_ = summed(rows.select(*keys, "js", "xs"), partial, len(groups) * one).reshape(len(groups), one)
    return Moments(groups, all_[:, -1], all_[:, half:-1], np.stack([unpacked(all_[k, :half], m) for k in range(len(groups))]))


def _add_pairs(batch: pa.RecordBatch, m: int, bias: bool, S: np.ndarray) -> None:
    """Products of the features of each sparse row, added to the upper half ``S`` of the second moments."""
    js, xs = batch.column("js"), batch.column("xs")
    size = xs.value_lengths().to_numpy(zero_copy_only=False)
    J, X = js.flatten().to_numpy(), xs.flatten().to_numpy()
    start = np.cumsum(size) - size
    base = np.arange(m) * (2 * m - np.arange(m) - 1) // 2
    for k in np.unique(size):
        at = start[size == k][:, None] + np.arange(k)
        j, x = J[at], X[at]
        if bias:
            j, x = np.c_[j, np.full(len(j), m - 1)], np.c_[x, np.ones(len(x))]
        order = np.argsort(j, axis=1)
        j, x = np.take_along_axis(j, order, axis=1), np.take_along_axis(x, order, axis=1)
        a, b = np.triu_indices(j.shape[1])
        for low in range(0, len(j), step := max(1, (1 << 20) // max(1, len(a)))):
            part, y = j[low : low + step], x[low : low + step]
            np.add.at(S, (base[part[:, a]] + part[:, b]).reshape(-1), (y[:, a] * y[:, b]).reshape(-1))


def _few_entries(rows: DataFrame) -> bool:
    entries, named = rows.agg(F.sum(F.size("xs")), F.sum(F.size("js"))).first()
    return named == entries and (entries or 0) <= MOST_ENTRIES


def second_moments(rows: DataFrame, d: int, key: str | None = None, bias: bool = False) -> tuple[np.ndarray, dict]:
    """(upper half of the second moments of all rows, {value of ``key``: (number of rows, sums)}): what one mapping of very many features needs,
    in half the memory of one matrix. Sparse rows add the pairs that they have."""
    if d > WIDEST:
        raise ValueError(f"{d} features; the solvers hold matrices of at most {WIDEST} features")
    single_thread()
    if d > WIDE:
        freed(rows.sparkSession)  # what features were made of
    values = sorted(r[0] for r in rows.select(key).distinct().collect()) if key else [None]
    m = d + bias
    columns = [*([key] if key else []), "js", "xs"]
    half = m * (m + 1) // 2

    def partial(batches: Batches) -> np.ndarray:
        single_thread()
        out = np.zeros(half + len(values) * (m + 1))
        sums = out[half:].reshape(len(values), m + 1)
        for whole in batches:
            if not whole.num_rows:
                continue
            named = whole.column("js").value_lengths().to_numpy(zero_copy_only=False)
            sparse = (named == whole.column("xs").value_lengths().to_numpy(zero_copy_only=False)).all()
            of = np.searchsorted(values, whole.column(key).to_numpy()) if key else np.zeros(len(named), np.int64)
            if sparse:
                _add_pairs(whole, m, bias, out[:half])
                np.add.at(sums, (np.repeat(of, named), whole.column("js").flatten().to_numpy()), whole.column("xs").flatten().to_numpy())
                count = np.bincount(of, minlength=len(values))
                sums[:, -1] += count
                if bias:
                    sums[:, -2] += count
                continue
            low = 0
            for batch in slices(whole, d):
                x = block(batch, d, bias)
                own, at = np.empty(half), of[low : low + len(x)]
                pack(x.T @ x, own)
                out[:half] += own
                for k in range(len(values)):
                    sums[k, :-1] += x[at == k].sum(axis=0)
                    sums[k, -1] += (at == k).sum()
                low += len(x)
        return out

    if d > WIDE and _few_entries(rows):  # entries are fewer than the pairs of features, of which each task would send half a matrix
        all_ = partial(iter(rows.select(*columns).toArrow().to_batches()))
        sums = all_[half:].reshape(len(values), m + 1)
        return all_[:half], {v: (x[-1], x[:-1].copy()) for v, x in zip(values, sums)}
    all_ = summed(rows.select(*columns), partial, half + len(values) * (m + 1), tasks=rows.sparkSession.sparkContext.defaultParallelism)
    if d > WIDE:
        freed(rows.sparkSession)  # half a matrix a task
    sums = all_[half:].reshape(len(values), m + 1)
    return all_[:half], {v: (x[-1], x[:-1].copy()) for v, x in zip(values, sums)}


def mean_gap(m: Moments, one, two) -> np.ndarray:  # noqa: ANN001
    """Outer product of the difference of two groups' means, zero where either is empty."""
    (na, sa, _), (nb, sb, _) = m.of(one), m.of(two)
    if not na or not nb:
        return np.zeros((len(sa), len(sa)))
    v = sa / na - sb / nb
    return np.outer(v, v)
