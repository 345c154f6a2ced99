"""Filters, labels, unions and feature tables in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def pm1(label: Column) -> Column:
    """Labels 0 and 1 as -1 and +1."""
    return 2 * label - 1


def least_label(docs: DataFrame) -> int | None:
    """The smallest label of labelled documents, null without any."""
    return labelled(docs).agg(F.min("label")).first()[0]


def relabelled(docs: DataFrame) -> DataFrame:
    """(doc_id, y): labels 0 and 1 of labelled documents as -1 and +1; fails where the smallest label is not 0."""
    least = least_label(docs)
    if least not in (None, 0):
        raise ValueError(f"labels must begin at 0, not at {least}")
    return labelled(docs).select("doc_id", pm1(F.col("label")).alias("y"))


def one_vs_all(df: DataFrame, classes: DataFrame, label: str = "label", key: str = "doc_id") -> DataFrame:
    """(key, cls, y): +1 for a row's own class, -1 for every other of the few ``classes`` (cls)."""
    listed = [r[0] for r in classes.orderBy("cls").collect()]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.when(F.col(label) == c, 1).otherwise(-1).alias("y")) for c in listed]))
    return df.select(key, rows.alias("r")).select(key, "r.cls", "r.y")


def labelled(docs: DataFrame) -> DataFrame:
    """Documents with a label: neither null nor the mark -1."""
    return docs.where("label > -1")


def has_labels(docs: DataFrame) -> bool:
    return not labelled(docs).isEmpty()


def stacked(*parts: DataFrame) -> DataFrame:
    """Rows of several corpora, matched by column names."""
    return reduce(DataFrame.unionByName, parts)


def with_bias(x: DataFrame, docs: DataFrame, d: int) -> DataFrame:
    """Feature rows (doc_id, j, x) with a feature ``d`` that is 1 for every document."""
    return x.select("doc_id", "j", "x").unionByName(docs.select("doc_id", F.lit(d).cast("bigint").alias("j"), F.lit(1.0).alias("x")))


def append(x: DataFrame, more: DataFrame, offset: int, gamma: float) -> DataFrame:
    """Features of ``more``, scaled by gamma and renumbered from ``offset``, beside those of ``x``."""
    return x.select("doc_id", "j", "x").unionByName(more.select("doc_id", (F.col("j") + offset).alias("j"), (F.col("x") * gamma).alias("x")))


def top_per_row(w: DataFrame, k: int) -> DataFrame:
    """(i, j, v): the k largest values of each row i, zeros elsewhere."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("v"), "j"))
    return w.select("i", "j", F.when(rank <= k, F.col("v")).otherwise(F.lit(0) * F.col("v")).alias("v"))


def one_sign(w: DataFrame, positive: bool) -> DataFrame:
    """(i, j, v) with the values of the other sign set to zero."""
    zero = F.lit(0) * F.col("v")
    return w.select("i", "j", (F.greatest("v", zero) if positive else F.least("v", zero)).alias("v"))


def argmax_class(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cls) of the highest score of each row; of equal ones the lowest class."""
    return scores.groupBy(key).agg(F.max_by("cls", F.struct("score", -F.col("cls"))).alias("cls"))
