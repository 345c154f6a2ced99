"""Queries of the problems tagged llm, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import automata, heavy, icws, packing, splitting, termcounts, winnow
from corpusloom.sources.tables import table


def p2_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its total frequency, its records and the mark of those too rare or too common."""
    n_all = table(spark, folder, "reviews").agg(F.count_distinct("review_id")).first()[0]
    return termcounts.marked(termcounts.term_frequencies(table(spark, folder, "review_terms")), n_all)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The terms that are too rare or too common for the vocabulary."""
    return p2_vocabulary(spark, folder).where("mark IS NOT NULL").select("ts", "mark")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a labelled and an unlabeled record whose sets of terms have a Jaccard similarity of at least 0.8."""
    return automata.record_overlaps(*automata.overlaps(table(spark, folder, "reviews")))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records with terms and with an overlap, of each split and domain."""
    return automata.overlap_counts(*automata.overlaps(table(spark, folder, "reviews")))


def p3_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many of its terms the overlapping training records of each evaluation record hold together."""
    return automata.coverage(*automata.overlaps(table(spark, folder, "reviews"), cover=True))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The terms that at least 1/500 of all rows hold, with their rows."""
    return heavy.heavy_hitters(table(spark, folder, "review_terms"), "ts", 1 / 500).select("ts", "n_rows")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The terms that at least 1/500 of all rows hold."""
    return p4_counts(spark, folder).select("ts")


def p4_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Of each such term its rows, and whether the sketch's estimate is off by less than half of the threshold."""
    h = heavy.heavy_hitters(table(spark, folder, "review_terms"), "ts", 1 / 500)
    return h.select("ts", "n_rows", (F.abs(F.col("estimate") - F.col("n_rows")) < F.col("n_all") / 1000).alias("is_close"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records whose bags have a weighted Jaccard similarity of at least 0.7."""
    return icws.record_pairs(*icws.near_duplicates(table(spark, folder, "reviews"), threshold=0.7))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with terms: its class of equal bags, named by its least record, and the other classes of a similarity of at least 0.7."""
    return icws.record_classes(*icws.near_duplicates(table(spark, folder, "reviews"), threshold=0.7))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of 4,096 tokens of every commit."""
    return packing.pack(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 20 consecutive words of an evaluation item."""
    return winnow.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of at most 2,048 tokens of every commit that has more."""
    return splitting.split_documents(table(spark, folder, "documents"))


_BAG = r"""
WITH entry AS (SELECT DISTINCT review_id, split, pos, x.ts AS ts, x.tfreq AS tfreq FROM (
    SELECT review_id, split, unnest(features) AS x, generate_subscripts(features, 1) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY loaded_at) AS n FROM reviews) WHERE n = 1)),
bag AS (SELECT review_id, split, lower(trim(ts, chr(32) || chr(9))) AS t, sum(tfreq) AS f FROM entry
    WHERE trim(ts, chr(32) || chr(9)) <> '' AND tfreq >= 1 GROUP BY ALL),
whole AS (SELECT review_id, split, sum(f) AS w, count(*) AS n FROM bag GROUP BY ALL)
"""

_OVERLAP = (
    _BAG
    + """, shared AS (SELECT a.review_id AS a, b.review_id AS b, count(*) AS o FROM bag a JOIN bag b ON a.t = b.t AND a.split = 'unlabeled' AND b.split = 'labelled' GROUP BY ALL),
    pair AS (SELECT a, b FROM shared JOIN whole x ON x.review_id = a JOIN whole y ON y.review_id = b WHERE o / (x.n + y.n - o) >= 0.8)"""
)

_VOCABULARY = """
WITH valid AS (SELECT DISTINCT review_id, pos, lower(trim(ts, chr(32) || chr(9))) AS ts, tfreq FROM review_terms
    WHERE review_id IS NOT NULL AND tfreq >= 1 AND trim(ts, chr(32) || chr(9)) <> ''),
token AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, pos ORDER BY ts, tfreq) AS k FROM valid) WHERE k = 1 OR pos IS NULL),
n AS (SELECT count(DISTINCT review_id) AS n FROM reviews),
term AS (SELECT ts, CAST(sum(tfreq) AS BIGINT) AS n_total, count(DISTINCT review_id) AS n_records FROM token GROUP BY ts),
v AS (SELECT term.*, CASE WHEN n_records < 2 THEN 'rare' WHEN n_records > 0.5 * n THEN 'common' END AS mark FROM term, n)
"""
_HEAVY = """
WITH t AS (SELECT lower(trim(ts, chr(32) || chr(9))) AS ts, count(*) AS n_rows FROM review_terms WHERE trim(ts, chr(32) || chr(9)) <> '' GROUP BY 1)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_vocabulary": p2_vocabulary,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p3_coverage": p3_coverage,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p4_estimates": p4_estimates,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_containers": p6_containers,
    "p7_found": p7_found,
    "p8_pieces": p8_pieces,
}
SQL = {
    "p2_found": _VOCABULARY + "SELECT ts, mark FROM v WHERE mark IS NOT NULL",
    "p2_vocabulary": _VOCABULARY + "SELECT * FROM v",
    "p4_found": _HEAVY + "SELECT ts FROM t WHERE n_rows >= (SELECT count(*) FROM review_terms) / 500",
    "p4_counts": _HEAVY + "SELECT ts, n_rows FROM t WHERE n_rows >= (SELECT count(*) FROM review_terms) / 500",
    "p4_estimates": _HEAVY + "SELECT ts, n_rows, true AS is_close FROM t WHERE n_rows >= (SELECT count(*) FROM review_terms) / 500",
    "p7_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items),
a AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 19), lambda k: array_to_string(w[k:k + 19], ' '))) AS g FROM d WHERE len(w) >= 20),
b AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 19), lambda k: array_to_string(w[k:k + 19], ' '))) AS g FROM i WHERE len(w) >= 20)
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)""",
    "p3_found": _OVERLAP + " SELECT least(a, b) AS review_id_a, greatest(a, b) AS review_id_b FROM pair",
    "p3_counts": _OVERLAP
    + """, one AS (SELECT DISTINCT review_id, split, domain FROM reviews WHERE review_id IN (SELECT review_id FROM whole))
    SELECT split, domain, count(*) AS n_records, count(*) FILTER (review_id IN (SELECT a FROM pair UNION SELECT b FROM pair)) AS n_overlapping FROM one GROUP BY ALL""",
    "p3_coverage": _OVERLAP
    + """, held AS (SELECT a AS review_id, count(DISTINCT x.t) AS n_covered FROM pair JOIN bag x ON x.review_id = a JOIN bag y ON y.review_id = b AND x.t = y.t GROUP BY a),
    one AS (SELECT DISTINCT review_id, domain FROM reviews)
    SELECT review_id, domain, whole.n AS n_terms, n_covered FROM held JOIN whole USING (review_id) JOIN one USING (review_id)""",
    "p5_classes": _BAG
    + """, cls AS (SELECT review_id, list(t || chr(9) || f ORDER BY t) AS c FROM bag GROUP BY review_id),
    rep AS (SELECT c, min(review_id) AS class_id, count(*) AS n_copies FROM cls GROUP BY c),
    one AS (SELECT bag.* FROM bag JOIN rep ON review_id = class_id),
    low AS (SELECT a.review_id AS a, b.review_id AS b, sum(least(a.f, b.f)) AS l FROM one a JOIN one b ON a.t = b.t AND a.review_id < b.review_id GROUP BY ALL),
    link AS (SELECT a, b FROM low JOIN whole x ON x.review_id = a JOIN whole y ON y.review_id = b WHERE l / (x.w + y.w - l) >= 0.7),
    deg AS (SELECT i, count(*) AS n FROM (SELECT a AS i FROM link UNION ALL SELECT b FROM link) GROUP BY i)
    SELECT review_id, class_id, n_copies, coalesce(n, 0) AS n_links FROM cls JOIN rep USING (c) LEFT JOIN deg ON i = class_id""",
    "p5_found": _BAG
    + """, low AS (SELECT a.review_id AS a, b.review_id AS b, sum(least(a.f, b.f)) AS l FROM bag a JOIN bag b ON a.t = b.t AND a.review_id < b.review_id GROUP BY ALL)
    SELECT a AS review_id_a, b AS review_id_b FROM low JOIN whole x ON x.review_id = a JOIN whole y ON y.review_id = b WHERE l / (x.w + y.w - l) >= 0.7""",
}
