"""Term weights of counts (doc_id, j, tf) with document frequencies.

n documents (the empty ones included), r = df / n, dl the length of a document, t = tf ln(1 + c avgdl / dl). Weights are
column expressions; the length of a document is a window sum over rows already partitioned by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.plans.partial import Batches

EPS, ETA = 1e-8, 1.2
#: Codes of the weightings: name and whether rows are scaled to unit length.
CODES = {0: ("tf", False), 1: ("binary", True), 2: ("tfidf", True), 3: ("loglogistic", False), 4: ("spl", False), 5: ("qlog", False), 6: ("dfr_idf", False), 7: ("qlog", True), 8: ("tf", True)}


def idf(df: Column, n: int) -> Column:
    """Smoothed inverse document frequency, ln((1 + n) / (1 + df)) + 1."""
    return F.log((1.0 + n) / (1 + df)) + 1


def raw_weight(name: str, n: int, avgdl: float, c: float = 1.0) -> Column:
    """The weight of a row (tf, df, dl) before any scaling."""
    x, df, dl = (F.col(k).cast("double") for k in ("tf", "df", "dl"))
    r, t = df / n, x * F.log(1 + c * avgdl / dl)
    if name == "tf":
        return x
    if name == "binary":
        return F.lit(1.0)
    if name == "tfidf":
        return x * idf(df, n)
    if name == "loglogistic":
        return F.log((r + t) / r)
    if name == "spl":
        return -F.log((EPS + F.pow(r, t / (1 + t)) - r) / (1 + EPS - r))
    if name == "qlog":
        return -(F.pow(r / (r + t), F.lit(1 - ETA)) - 1) / (1 - ETA)
    if name == "dfr_idf":
        return x * F.log(1 + c * avgdl / (dl + 0.5)) * (F.log(F.lit(float(n))) - F.log(0.5 + df))
    raise ValueError(f"no weighting {name!r}")


def unit_rows(weights: DataFrame, column: str = "w") -> DataFrame:
    """Rows of each document scaled to unit Euclidean length; a document of zeros stays."""
    norm = F.sqrt(F.sum(F.col(column) * F.col(column)).over(Window.partitionBy("doc_id")))
    return weights.withColumn(column, F.when(norm > 0, F.col(column) / norm).otherwise(F.col(column)))


def weigh(counts: DataFrame, frequencies: DataFrame, code: int, n: int, avgdl: float, c: float = 1.0) -> DataFrame:
    """(doc_id, j, w) of counts (doc_id, j, tf) and (j, df), the latter of a vocabulary's size."""
    if code not in CODES:
        raise ValueError(f"no weighting with code {code}")
    name, scaled = CODES[code]
    rows = counts.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id"))).join(F.broadcast(frequencies), "j")
    out = rows.select("doc_id", "j", raw_weight(name, n, avgdl, c).alias("w"))
    return unit_rows(out) if scaled else out


def tfidf_rows(bags: DataFrame, vocabulary: DataFrame, n: int) -> DataFrame:
    """Feature rows of bags (tokens, tfs) with the weights of code 2, by a vocabulary (token, df, wid) of bounded size: each record is
    looked up, added up by term and scaled where it stands, without a shuffle or join."""
    voc = vocabulary.select("token", "df", "wid").toArrow()
    words, df, wid = voc.column("token").combine_chunks(), voc.column("df").to_numpy().astype(float), voc.column("wid").to_numpy()
    weight, many = np.log((1.0 + n) / (1 + df)) + 1, max(1, len(words))
    others = [f for f in bags.schema if f.name not in ("tokens", "tfs")]

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            tokens = batch.column("tokens")
            at = pc.index_in(tokens.flatten(), value_set=words.cast(tokens.type.value_type))
            on = at.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy(zero_copy_only=False))[on]
            key, same = np.unique(row * many + at.drop_null().to_numpy(), return_inverse=True)
            row, j = key // many, key % many
            x = np.bincount(same, batch.column("tfs").flatten().to_numpy()[on], len(key)) * weight[j]
            x /= np.sqrt(np.bincount(row, x * x, batch.num_rows))[row]
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (wid[j], x)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), *lists], names=[*(f.name for f in others), "js", "xs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", js array<bigint>, xs array<double>"
    return bags.mapInArrow(rows, schema)
