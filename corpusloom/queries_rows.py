"""Queries of problem 1 over review_lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.quarantine import split_review_lines
from corpusloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each unloadable line once, with the first reason that holds."""
    _, rejects = split_review_lines(table(spark, folder, "review_lines").select("line_id", "line_text"))
    return rejects.select("line_id", "reason").distinct()


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each loadable line once, as a record in long form; a record without entries has one row without a term."""
    lines = table(spark, folder, "review_lines").select("line_id", "domain", "file_name", "line_text")
    records, _ = split_review_lines(lines.dropDuplicates(["line_id", "line_text"]))
    split = F.when(F.col("file_name") == "unlabeled.review", "unlabeled").otherwise("labelled")
    return records.select("line_id", "domain", split.alias("split"), "label", F.posexplode_outer("features").alias("pos", "e")).select(
        "line_id", "domain", "split", "label", F.col("pos").cast("bigint").alias("pos"), F.col("e.ts").alias("ts"), F.col("e.tfreq").alias("tfreq")
    )


_PARSED = r"""
WITH d AS (SELECT DISTINCT line_id, domain, file_name, line_text FROM review_lines),
a AS (SELECT *, rtrim(line_text, chr(32) || chr(9) || chr(13) || chr(10)) AS o FROM d),
b AS (SELECT *, rtrim(CASE WHEN length(o) > 1 AND o[1] = '"' AND o[length(o)] = '"' THEN substr(o, 2, length(o) - 2) ELSE o END,
                      chr(32) || chr(9) || chr(13) || chr(10)) AS body FROM a),
c AS (SELECT *, string_split(body, ' ') AS f FROM b),
e AS (SELECT *, f[len(f)] AS lab, f[1:len(f) - 1] AS rest FROM c),
r AS (SELECT *, CASE
    WHEN line_text IS NULL OR trim(line_text, chr(32) || chr(9) || chr(13) || chr(10)) = '' THEN 'empty'
    WHEN contains(body, '"') THEN 'quote'
    WHEN lab NOT IN ('#label#:positive', '#label#:negative') OR len(list_filter(rest, lambda x: starts_with(x, '#label#'))) > 0 THEN 'label'
    WHEN len(list_filter(rest, lambda x: NOT regexp_full_match(x, '(?s)[^:]+:[^:]*'))) > 0 THEN 'entry'
    WHEN len(list_filter(rest, lambda x: NOT coalesce(CASE WHEN regexp_full_match(split_part(x, ':', 2), '0*[0-9]{1,10}')
             THEN CAST(right(split_part(x, ':', 2), 10) AS BIGINT) BETWEEN 1 AND 2147483647 END, false))) > 0 THEN 'tfreq'
    END AS reason FROM e)
"""

QUERIES = {"p1_found": p1_found, "p1_records": p1_records}
SQL = {
    "p1_found": _PARSED + "SELECT DISTINCT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_records": _PARSED
    + """, u AS (SELECT line_id, domain, CASE WHEN file_name = 'unlabeled.review' THEN 'unlabeled' ELSE 'labelled' END AS split,
        CAST(lab = '#label#:positive' AS INTEGER) AS label, CASE WHEN len(rest) = 0 THEN [NULL] ELSE rest END AS l FROM r WHERE reason IS NULL),
    v AS (SELECT line_id, domain, split, label, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM u)
    SELECT line_id, domain, split, label, CASE WHEN x IS NOT NULL THEN pos END AS pos, split_part(x, ':', 1) AS ts,
        CAST(split_part(x, ':', 2) AS INTEGER) AS tfreq FROM v""",
}
