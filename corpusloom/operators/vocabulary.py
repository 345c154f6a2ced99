"""Vocabularies: pruning, encoding, feature selection.

A vocabulary has at most ``max_words`` rows, a parameter; that is the proven bound under which it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: This library's default stop words, frequent English function words; the list of another library is passed as ``stop``.
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only "
    "or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very "
    "was we were what when where which while who whom why will with you your"
).split()


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(token, df, tf): documents and total frequency of each token."""
    return counts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def by_frequency(counts: DataFrame, n_docs: int, max_words: int, min_df: int = 2, max_share: float = 0.5) -> DataFrame:
    """(token, df, wid): tokens in ``min_df`` documents or more and at most a share of all, the most frequent first.

    The top is taken by a distributed sort with limit; ids are then given to those few rows only.
    """
    kept = document_frequencies(counts).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs))
    top = kept.select("token", "df").orderBy(F.desc("df"), "token").limit(max_words)
    return numbered(top, [F.desc("df"), F.col("token")])


def by_total(counts: DataFrame, max_words: int = 10_000, min_df: int = 3, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(token, tf, wid): tokens that are no stop words in ``min_df`` documents or more, of the highest total frequency."""
    kept = document_frequencies(counts).where((F.col("df") >= min_df) & ~F.col("token").isin(stop))
    return numbered(kept.select("token", "tf").orderBy(F.desc("tf"), "token").limit(max_words), [F.desc("tf"), F.col("token")])


def numbered(top: DataFrame, order: list) -> DataFrame:
    """``top``, which is of bounded size, with ids 0, 1, ... in an order."""
    return top.withColumn("wid", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))


def encode(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``counts`` with ``wid`` instead of the token; tokens out of the vocabulary are dropped. No shuffle."""
    return counts.join(F.broadcast(vocabulary.select("token", "wid")), "token").drop("token")


def frequent_binary(counts: DataFrame, over: int = 10) -> DataFrame:
    """(token, doc_id, x): tokens in more than ``over`` documents, x = 1."""
    often = document_frequencies(counts).where(F.col("df") > over)
    return counts.join(often.select("token"), "token", "left_semi").select("token", "doc_id", F.lit(1.0).alias("x"))
