"""Review corpora: records, documents and term counts in long form.

Wide document-by-term matrices become rows (doc_id, token, tf); documents without a term keep their row in the
*spine* of documents, so counts and means over documents include them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.terms import counts_in_bag, term
from corpusloom.operators.quarantine import split_review_lines

#: File sets by size of a task, and the files behind them.
FILES = {"small": "labelled.review", "all": "all.review", "test": "unlabeled.review"}
PARTS = {
    "labelled.review": ("positive.review", "negative.review"),
    "unlabeled.review": ("unlabeled.review",),
    "all.review": ("positive.review", "negative.review", "unlabeled.review"),
}


def dataset_path(prefix: str, domain: str, size: str) -> str:
    """PREFIX/DOMAIN/FILE of a task's size (small, all or test)."""
    if size not in FILES:
        raise ValueError(f"size must be one of {sorted(FILES)}, not {size!r}")
    return f"{prefix}/{domain}/{FILES[size]}"


def of_size(df: DataFrame, size: str) -> DataFrame:
    """The rows of a table with ``file_name`` that a size stands for: concatenated files are a filter, no copy."""
    return df.where(F.col("file_name").isin(*PARTS[FILES[size]]))


def read_files(spark: SparkSession, prefix: str, domain: str, size: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of the raw files of a domain and size, PREFIX/DOMAIN/FILE: each line once as it stands, with
    domain, file_name and a line_id that is unique in this reading. Records also have features and label."""
    lines = spark.read.text(dataset_path(prefix, domain, size)).select(
        F.monotonically_increasing_id().alias("line_id"), F.lit(domain).alias("domain"), F.lit(FILES[size]).alias("file_name"), F.col("value").alias("line_text")
    )
    return split_review_lines(lines)


def read_domains(spark: SparkSession, prefix: str, domains: tuple[str, ...], size: str) -> DataFrame:
    """Records of several domains' raw files in the form of ``records``; a document's id is made of its domain and line."""
    parts = [read_files(spark, prefix, d, size)[0] for d in domains]
    split = F.lit({"small": "labelled", "test": "unlabeled", "all": None}[size]).cast("string")
    rows = reduce(DataFrame.unionByName, [p.withColumn("doc_id", F.xxhash64(F.lit(d), "line_id")) for p, d in zip(parts, domains)])
    return rows.select("doc_id", "domain", split.alias("split"), "label", "features")


def records(reviews: DataFrame) -> DataFrame:
    """Each record once, as in its earliest delivery: (doc_id, domain, split, label, features). Without ``loaded_at`` deliveries are equal.
    Where the table has no ``features``, records have none: the spine needs no more."""
    kept = [c for c in ("domain", "split", "label", "features") if c in reviews.columns]
    if "loaded_at" not in reviews.columns:
        return reviews.dropDuplicates(["review_id"]).select(F.col("review_id").alias("doc_id"), *kept)
    late = F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))
    order = F.struct(late, "domain", "split", "label")
    apart = [F.col("features.ts").alias("_ts"), F.col("features.tfreq").alias("_tf")] if "features" in kept else []  # two arrays travel lighter than structs
    plain = [c for c in kept if c != "features"]
    one = reviews.groupBy(F.col("review_id").alias("doc_id")).agg(F.min_by(F.struct(*plain, *apart), order).alias("r"))
    whole = [F.arrays_zip(F.col("r._ts").alias("ts"), F.col("r._tf").alias("tfreq")).alias("features")] if apart else []
    return one.select("doc_id", *[f"r.{c}" for c in plain], *whole)


def spine(recs: DataFrame) -> DataFrame:
    """(doc_id, domain, split, label) of all documents, those without terms too."""
    return recs.select("doc_id", "domain", "split", "label")


def term_counts(recs: DataFrame) -> DataFrame:
    """(doc_id, domain, split, token, tf): entries of one term are added up. Grouping needs no second shuffle, as
    records are partitioned by their id already."""
    e = recs.select("doc_id", "domain", "split", F.explode("features").alias("e"))
    e = e.where(counts_in_bag(F.col("e.ts"), F.col("e.tfreq")))
    keys = ["doc_id", "domain", "split", term(F.col("e.ts")).alias("token")]
    return e.groupBy(*keys).agg(F.sum("e.tfreq").alias("tf"))


def bags(recs: DataFrame) -> DataFrame:
    """(doc_id, domain, split, label, tokens, tfs): the entries of each record that count, as they stand; those of one term are not added up."""
    e = F.transform("features", lambda e: F.struct(term(e["ts"]).alias("token"), e["tfreq"].alias("tf")))
    e = F.filter(e, lambda e: F.coalesce((e["token"] != "") & (e["tf"] >= 1), F.lit(False)))
    parts = [F.coalesce(F.col(f"bag.{c}"), F.array().cast(f"array<{kind}>")).alias(name) for c, kind, name in (("token", "string", "tokens"), ("tf", "bigint", "tfs"))]
    return recs.withColumn("bag", e).select("doc_id", "domain", "split", "label", *parts)


def parsed_counts(lines: DataFrame) -> DataFrame:
    """(line_id, domain, label, token, tf) of the loadable lines of a file of raw reviews; lines delivered again count once."""
    recs, _ = split_review_lines(lines.dropDuplicates(["line_id", "line_text"]))
    e = recs.select("line_id", "domain", "label", F.explode("features").alias("e"))
    return e.groupBy("line_id", "domain", "label", F.col("e.ts").alias("token")).agg(F.sum(F.col("e.tfreq").cast("bigint")).alias("tf"))
