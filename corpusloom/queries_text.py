"""Queries over review and newsgroup-like texts: parsing, vocabularies, weights, labels, reports; with their SQL."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import metrics
from corpusloom.functions.activations import activation
from corpusloom.operators import features, vocabulary, weighting
from corpusloom.plans import tasks
from corpusloom.plans.session import cut, kept
from corpusloom.sources import newsgroups, reviews
from corpusloom.sources.tables import table

#: Words of the vocabulary of these queries, and of their whole runs: the default of tasks.
WORDS, WHOLE = 200, 5000
SOURCE, TARGET = "books", "dvd"


class Corpus:
    """Records, counts and the vocabulary of a folder's reviews."""

    def __init__(self, spark: SparkSession, folder: str, words: int = WORDS) -> None:
        self.spark = spark
        delivered = table(spark, folder, "reviews")
        self.docs = reviews.spine(reviews.records(delivered.drop("features")))
        self.counts = reviews.term_counts(reviews.records(delivered))
        self.words, self.kept, self.delivered = words, None, delivered

    def once(self) -> DataFrame:
        """The counts, written once for the scans that vocabulary, lengths and weights need."""
        if self.kept is None:
            self.kept = kept(self.counts, "doc_id", placed=True)
        return self.kept

    def n(self) -> int:
        return self.docs.select("doc_id").distinct().count()

    def vocabulary(self) -> DataFrame:
        return cut(vocabulary.by_frequency(self.once(), self.n(), self.words))  # of bounded size

    def coded(self, voc: DataFrame | None = None) -> DataFrame:
        """(doc_id, domain, split, j, tf)"""
        return vocabulary.encode(self.once(), self.vocabulary() if voc is None else voc).withColumnRenamed("wid", "j")

    def weighted(self, code: int) -> DataFrame:
        """(doc_id, j, w)"""
        n, voc = self.n(), self.vocabulary()
        coded = self.coded(voc)
        avgdl = (coded.agg(F.sum("tf")).first()[0] or 0) / max(n, 1)
        return weighting.weigh(coded.select("doc_id", "j", "tf"), voc.select(F.col("wid").alias("j"), "df"), code, n, avgdl)

    def rows(self, *domains: str) -> DataFrame:
        """TF-IDF feature rows of the documents of some domains, by the vocabulary of all: records are written once, and neither counts nor weights."""
        bags = kept(reviews.bags(reviews.records(self.delivered)), small=True)
        n = bags.count()
        once = bags.select(F.explode(F.array_distinct("tokens")).alias("token"), F.lit(1).alias("tf"))
        voc = cut(vocabulary.by_frequency(once, n, self.words))
        return weighting.tfidf_rows(bags.where(F.col("domain").isin(*domains)), voc, n)


def num(x: str, places: int = 6):  # noqa: ANN201
    """A rounded double without negative zero."""
    return F.round(F.col(x), places) + F.lit(0.0)


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return Corpus(spark, folder).counts.select("doc_id", "token", "tf")


def review_line_parse(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.parsed_counts(table(spark, folder, "review_lines")).select("line_id", "token", "tf", "label")


def vocab_df(spark: SparkSession, folder: str) -> DataFrame:
    return Corpus(spark, folder, 5000).vocabulary()


def vocab_tf_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.by_total(newsgroups.tokens(table(spark, folder, "documents")))


def news_clean(spark: SparkSession, folder: str) -> DataFrame:
    kept = newsgroups.clean(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, folder, "documents").select("doc_id", F.length(kept).cast("bigint").alias("n_kept"))


def oov_encode(spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:
    c = Corpus(spark, folder)
    source = c.counts.where(F.col("domain") == SOURCE)
    voc = vocabulary.by_frequency(source, c.docs.where(F.col("domain") == SOURCE).count(), words)
    return vocabulary.encode(c.counts.where(F.col("domain") == TARGET), voc).select("doc_id", "wid", "tf")


def df_filter_binary(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.frequent_binary(Corpus(spark, folder).once())


def doc_length_stats(spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:
    c = Corpus(spark, folder, words)
    sums = c.coded().groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    all_docs = c.docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
    avgdl = all_docs.agg(F.avg("dl")).first()[0]
    return all_docs.select("doc_id", "dl", (F.round(F.lit(avgdl), 6) + 0.0).alias("avgdl"))


def col_sums(spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:
    return Corpus(spark, folder, words).coded().groupBy("j").agg(F.sum("tf").alias("s"), F.count("*").alias("df"))


def class_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return Corpus(spark, folder).docs.groupBy("domain", "label").agg(F.count("*").alias("n"))


def weights(code: int, spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:
    return Corpus(spark, folder, words).weighted(code).select("doc_id", "j", num("w").alias("w"))


def tfidf_fit_apply(spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:
    """Frequencies of source and adaptation target (labelled split), applied to the held-out target."""
    c = Corpus(spark, folder, words)
    voc = c.vocabulary()
    coded = c.coded(voc)
    fit = F.col("domain").isin(SOURCE, TARGET) & (F.col("split") == "labelled")
    df = coded.where(fit).groupBy("j").agg(F.count("*").alias("df"))
    df = voc.select(F.col("wid").alias("j")).join(df, "j", "left").select("j", F.coalesce("df", F.lit(0)).alias("df"))
    held = coded.where((F.col("domain") == TARGET) & (F.col("split") == "unlabeled"))
    return weighting.weigh(held.select("doc_id", "j", "tf"), df, 2, c.docs.where(fit).count(), 0.0).select("doc_id", "j", num("w").alias("w"))


def domain_union_bias(spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:
    c = Corpus(spark, folder, words)
    x = c.coded()
    parts = [features.with_bias(x.where(F.col("domain") == d).withColumn("x", F.col("tf").cast("double")), c.docs.where(F.col("domain") == d), words).withColumn("domain", F.lit(d)) for d in (SOURCE, TARGET)]
    return features.stacked(*parts).select("domain", "doc_id", "j", "x")


def labels_pm1(spark: SparkSession, folder: str) -> DataFrame:
    return features.relabelled(Corpus(spark, folder).docs)


def labels_ova(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return features.one_vs_all(e, e.select(F.col("label").alias("cls")).distinct(), key="vec_id")


def labelled_instances(spark: SparkSession, folder: str) -> DataFrame:
    docs = Corpus(spark, folder).docs
    parts = [features.labelled(docs.where(F.col("domain") == d)) for d in (SOURCE, TARGET)]
    return features.stacked(*parts).select("domain", "doc_id", "label")


def append_features(spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:
    """Weighted terms, and beside them at half weight the lengths of documents and their distinct terms."""
    c = Corpus(spark, folder, words)
    x = c.weighted(2).select("doc_id", "j", F.col("w").alias("x"))
    g = c.coded().groupBy("doc_id").agg(F.sum("tf").alias("a"), F.count("*").alias("b"))
    more = g.select("doc_id", F.posexplode(F.array(F.col("a").cast("double"), F.col("b").cast("double"))).alias("j", "x")).withColumn("j", F.col("j").cast("bigint"))
    return features.append(x, more, words, 0.5).select("doc_id", "j", num("x").alias("x"))


def column_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the 50 most frequent words only, by a semi join on their ids."""
    c = Corpus(spark, folder)
    top = c.vocabulary().where("wid < 50").select(F.col("wid").alias("j"))
    return c.coded().join(F.broadcast(top), "j", "left_semi").select("doc_id", "j", "tf")


def task_registry_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.review_tasks(spark)


def task_registry_news(spark: SparkSession, folder: str) -> DataFrame:
    return newsgroups.task_table(spark)


def news_categories(spark: SparkSession, folder: str) -> DataFrame:
    return newsgroups.category_table(spark)


def hyper_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The factor eta / (1 - eta |C|^2) of the rank-one inverse, for |C|^2 = 1 / (1 + alpha)."""
    factor = F.col("eta") / (1 - F.col("eta") / (1 + F.col("alpha")))
    return tasks.grid(spark).select("alpha", "eta", (F.round(factor, 6) + 0.0).alias("factor"))


def best_param(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.best_parameters(table(spark, folder, "grid_scores"))


def grid_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean score of each setting over the tasks; a setting given twice for a task counts once."""
    s = table(spark, folder, "grid_scores").where("score IS NOT NULL").distinct()
    return s.groupBy("alpha", "eta").agg((F.round(F.avg("score"), 6) + 0.0).alias("mean_score"), F.count("*").alias("n"))


def score_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.result_rows(table(spark, folder, "grid_scores"), table(spark, folder, "tasks"))


def activations(spark: SparkSession, folder: str) -> DataFrame:
    """Activations of embedding components."""
    e = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v")).withColumn("x", F.col("v").cast("double"))
    out = [(F.round(activation(a, F.col("x")), 6) + 0.0).alias(a) for a in ("tanh", "sigmoid", "relu")]
    return e.select("vec_id", F.col("j").cast("bigint").alias("j"), *out)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score made of their text: the share of entries with a doubled frequency."""
    c = Corpus(spark, folder)
    s = c.counts.groupBy("doc_id").agg((F.sum(F.when(F.col("tf") > 1, 1).otherwise(0)) / F.count("*")).alias("score"))
    docs = features.labelled(c.docs).select("doc_id", "label").join(s, "doc_id")
    return docs.withColumn("predicted", (F.col("score") > 0.3).cast("int"))


def argmax_class(spark: SparkSession, folder: str) -> DataFrame:
    """The class of each embedding by its components taken as scores."""
    e = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("cls", "score"))
    return features.argmax_class(e, "vec_id").select("vec_id", F.col("cls").cast("bigint").alias("cls"))


def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.accuracy(_scored(spark, folder)).select(num("accuracy").alias("accuracy"))


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.class_report(_scored(spark, folder)).select("cls", *[num(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, folder)).select(num("auc").alias("auc"))


TW_NAMES = ("tw_tf", "tw_binary_l2", "tw_tfidf", "tw_loglogistic", "tw_spl", "tw_qlog", "tw_dfr_idf", "tw_qlog_l2", "tw_tf_l2")
QUERIES = {
    f.__name__: f
    for f in (
        token_counts, review_line_parse, vocab_df, vocab_tf_stopwords, news_clean, oov_encode, df_filter_binary, doc_length_stats, col_sums, class_histogram,
        tfidf_fit_apply, domain_union_bias, labels_pm1, labels_ova, labelled_instances, append_features, column_subset, task_registry_reviews, task_registry_news,
        news_categories, hyper_grid, best_param, grid_means, score_rows, activations, argmax_class, accuracy, class_report, roc_auc,
    )
} | {name: partial(weights, code) for code, name in enumerate(TW_NAMES)}
#: The same over the whole vocabulary.
LONG = ("oov_encode", "doc_length_stats", "col_sums", "tfidf_fit_apply", "domain_union_bias", "append_features", *TW_NAMES)
QUERIES |= {f"{name}_{WHOLE}": partial(QUERIES[name], words=WHOLE) for name in LONG}

BASE = """
WITH rec AS (SELECT review_id AS doc_id, domain, split, label, features FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY loaded_at) AS k FROM reviews) WHERE k = 1),
docs AS (SELECT doc_id, domain, split, label FROM rec),
counts AS (SELECT doc_id, domain, split, lower(trim(x.ts, chr(32) || chr(9))) AS token, CAST(sum(x.tfreq) AS BIGINT) AS tf
    FROM (SELECT doc_id, domain, split, unnest(features) AS x FROM rec) WHERE trim(x.ts, chr(32) || chr(9)) <> '' AND x.tfreq >= 1 GROUP BY ALL),
n AS (SELECT count(*) AS n FROM docs),
full_voc AS (SELECT token, df, row_number() OVER (ORDER BY df DESC, token) - 1 AS wid FROM (SELECT token, count(*) AS df FROM counts GROUP BY token), n
    WHERE df >= 2 AND df <= 0.5 * n),
voc AS (SELECT * FROM full_voc WHERE wid < 200),
x AS (SELECT doc_id, domain, split, wid AS j, tf, df FROM counts JOIN voc USING (token))
"""
RAW = {
    "tf": "CAST(tf AS DOUBLE)",
    "binary": "CAST(1 AS DOUBLE)",
    "tfidf": "tf * (ln((1 + n) / (1 + df)) + 1)",
    "loglogistic": "ln((r + t) / r)",
    "spl": "-ln((1e-8 + pow(r, t / (1 + t)) - r) / (1 + 1e-8 - r))",
    "qlog": "-(pow(r / (r + t), 1 - 1.2) - 1) / (1 - 1.2)",
    "dfr_idf": "tf * ln(1 + avgdl / (dl + 0.5)) * (ln(n) - ln(0.5 + df))",
}
LENGTHS = """, len_ AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM x GROUP BY doc_id),
y AS (SELECT x.*, dl, n, avgdl, df / n AS r, tf * ln(1 + avgdl / dl) AS t FROM x JOIN len_ USING (doc_id), n, (SELECT sum(dl) / (SELECT n FROM n) AS avgdl FROM len_))
"""


def weight_sql(code: int) -> str:
    name, scaled = weighting.CODES[code]
    value = "w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))" if scaled else "w"
    return BASE + LENGTHS + f", z AS (SELECT doc_id, j, {RAW[name]} AS w FROM y) SELECT doc_id, j, round({value}, 6) + 0.0 AS w FROM z"


SCORED = """, s AS (SELECT doc_id, sum(CASE WHEN tf > 1 THEN 1 ELSE 0 END) / count(*) AS score FROM counts GROUP BY doc_id),
p AS (SELECT doc_id, label, score, CAST(score > 0.3 AS INTEGER) AS predicted FROM docs JOIN s USING (doc_id) WHERE label > -1)
"""
_LINES = r"""
WITH d AS (SELECT DISTINCT line_id, line_text FROM review_lines),
a AS (SELECT line_id, rtrim(line_text, chr(32) || chr(9) || chr(13) || chr(10)) AS o FROM d),
b AS (SELECT line_id, rtrim(CASE WHEN length(o) > 1 AND o[1] = '"' AND o[length(o)] = '"' THEN substr(o, 2, length(o) - 2) ELSE o END, chr(32) || chr(9) || chr(13) || chr(10)) AS body FROM a),
c AS (SELECT line_id, string_split(body, ' ') AS f FROM b),
g AS (SELECT line_id, f[len(f)] AS lab, f[1:len(f) - 1] AS rest FROM c
    WHERE f[len(f)] IN ('#label#:positive', '#label#:negative') AND len(list_filter(f[1:len(f) - 1], lambda x: starts_with(x, '#label#') OR contains(x, '"')
        OR NOT regexp_full_match(x, '(?s)[^:]+:0*[1-9][0-9]{0,9}') OR coalesce(TRY_CAST(split_part(x, ':', 2) AS HUGEINT) > 2147483647, false))) = 0),
h AS (SELECT line_id, lab, unnest(rest) AS x FROM g)
SELECT line_id, split_part(x, ':', 1) AS token, CAST(sum(CAST(split_part(x, ':', 2) AS BIGINT)) AS BIGINT) AS tf, CAST(lab = '#label#:positive' AS INTEGER) AS label
FROM h GROUP BY line_id, token, lab
"""
_STOP = ", ".join(f"'{w}'" for w in vocabulary.STOP_WORDS)


_NEWS = """SELECT * FROM (VALUES
(0, 'comp', 'sci', 'all'), (1, 'sci', 'comp', 'all'), (2, 'rec', 'talk', 'all'), (3, 'talk', 'rec', 'all'), (4, 'rec', 'sci', 'all'), (5, 'sci', 'rec', 'all'),
(6, 'sci', 'talk', 'all'), (7, 'talk', 'sci', 'all'), (8, 'comp', 'rec', 'all'), (9, 'rec', 'comp', 'all'), (10, 'comp', 'talk', 'all'), (11, 'talk', 'comp', 'all')) v(task_id, source, target, size)"""
_CATEGORIES = """
WITH v AS (SELECT * FROM (VALUES
('comp_vs_sci', 'source', 1, 'comp.graphics comp.os.ms-windows.misc'), ('comp_vs_sci', 'source', 0, 'sci.crypt sci.electronics'),
('comp_vs_sci', 'target', 1, 'comp.sys.ibm.pc.hardware comp.sys.mac.hardware comp.windows.x'), ('comp_vs_sci', 'target', 0, 'sci.med sci.space'),
('rec_vs_talk', 'source', 1, 'rec.autos rec.motorcycles'), ('rec_vs_talk', 'source', 0, 'talk.politics.guns talk.politics.misc'),
('rec_vs_talk', 'target', 1, 'rec.sport.baseball rec.sport.hockey'), ('rec_vs_talk', 'target', 0, 'talk.politics.mideast talk.religion.misc'),
('rec_vs_sci', 'source', 1, 'sci.space sci.med'), ('rec_vs_sci', 'source', 0, 'rec.autos rec.sport.baseball'),
('rec_vs_sci', 'target', 1, 'sci.crypt sci.electronics'), ('rec_vs_sci', 'target', 0, 'rec.sport.hockey rec.motorcycles'),
('sci_vs_talk', 'source', 1, 'sci.electronics sci.med'), ('sci_vs_talk', 'source', 0, 'talk.politics.misc talk.religion.misc'),
('sci_vs_talk', 'target', 1, 'sci.crypt sci.space'), ('sci_vs_talk', 'target', 0, 'talk.politics.guns talk.politics.mideast'),
('comp_vs_rec', 'source', 1, 'comp.graphics comp.sys.ibm.pc.hardware comp.sys.mac.hardware'), ('comp_vs_rec', 'source', 0, 'rec.sport.hockey rec.motorcycles'),
('comp_vs_rec', 'target', 1, 'comp.os.ms-windows.misc comp.windows.x'), ('comp_vs_rec', 'target', 0, 'rec.autos rec.sport.baseball'),
('comp_vs_talk', 'source', 1, 'comp.graphics comp.windows.x comp.sys.mac.hardware'), ('comp_vs_talk', 'source', 0, 'talk.politics.mideast talk.politics.misc'),
('comp_vs_talk', 'target', 1, 'comp.os.ms-windows.misc comp.sys.ibm.pc.hardware'), ('comp_vs_talk', 'target', 0, 'talk.politics.guns talk.politics.misc')) v(pair, side, cls, cats))
SELECT pair, side, cls, unnest(string_split(cats, ' ')) AS category FROM v"""
SQL = {name: weight_sql(code) for code, name in enumerate(TW_NAMES)} | {
    "token_counts": BASE + "SELECT doc_id, token, tf FROM counts",
    "review_line_parse": _LINES,
    "vocab_df": BASE + "SELECT token, df, wid FROM full_voc WHERE wid < 5000",
    "vocab_tf_stopwords": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS token FROM documents),
c AS (SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t WHERE length(token) >= 2 GROUP BY token)
SELECT token, tf, row_number() OVER (ORDER BY tf DESC, token) - 1 AS wid FROM c WHERE df >= 3 AND token NOT IN ({_STOP}) ORDER BY tf DESC, token LIMIT 10000""",
    "news_clean": r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, string_split(CASE WHEN contains(t, chr(10) || chr(10)) THEN substr(t, strpos(t, chr(10) || chr(10)) + 2) ELSE t END, chr(10)) AS l FROM a),
c AS (SELECT doc_id, string_split(trim(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, 'writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>')), chr(10)),
    chr(32) || chr(9) || chr(13) || chr(10)), chr(10)) AS l FROM b),
d AS (SELECT doc_id, l, coalesce(list_position(list_reverse(list_transform(l, lambda x: regexp_full_match(x, '[ \t\r-]*'))), true), 0) AS k FROM c)
SELECT doc_id, length(array_to_string(CASE WHEN k > 0 AND len(l) > k THEN l[1:len(l) - k] ELSE l END, chr(10))) AS n_kept FROM d""",
    "oov_encode": BASE
    + """, v AS (SELECT token, row_number() OVER (ORDER BY df DESC, token) - 1 AS wid FROM (SELECT token, count(*) AS df FROM counts WHERE domain = 'books' GROUP BY token)
        WHERE df >= 2 AND df <= 0.5 * (SELECT count(*) FROM docs WHERE domain = 'books'))
    SELECT doc_id, wid, tf FROM counts JOIN v USING (token) WHERE wid < 200 AND domain = 'dvd'""",
    "df_filter_binary": BASE + "SELECT token, doc_id, CAST(1 AS DOUBLE) AS x FROM counts WHERE token IN (SELECT token FROM counts GROUP BY token HAVING count(*) > 10)",
    "doc_length_stats": BASE
    + """, l AS (SELECT doc_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS dl FROM docs LEFT JOIN x USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, dl, round(avg(dl) OVER (), 6) + 0.0 AS avgdl FROM l""",
    "col_sums": BASE + "SELECT j, CAST(sum(tf) AS BIGINT) AS s, count(*) AS df FROM x GROUP BY j",
    "class_histogram": BASE + "SELECT domain, label, count(*) AS n FROM docs GROUP BY ALL",
    "tfidf_fit_apply": BASE
    + """, f AS (SELECT j, count(*) AS df FROM x WHERE domain IN ('books', 'dvd') AND split = 'labelled' GROUP BY j),
    m AS (SELECT count(*) AS m FROM docs WHERE domain IN ('books', 'dvd') AND split = 'labelled'),
    w AS (SELECT doc_id, x.j, tf * (ln((1 + m) / (1 + coalesce(f.df, 0))) + 1) AS w FROM x LEFT JOIN f USING (j), m WHERE domain = 'dvd' AND split = 'unlabeled')
    SELECT doc_id, j, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) + 0.0 AS w FROM w""",
    "domain_union_bias": BASE
    + """SELECT domain, doc_id, j, CAST(tf AS DOUBLE) AS x FROM x WHERE domain IN ('books', 'dvd')
    UNION ALL SELECT domain, doc_id, CAST(200 AS BIGINT), CAST(1 AS DOUBLE) FROM docs WHERE domain IN ('books', 'dvd')""",
    "labels_pm1": BASE + "SELECT doc_id, 2 * label - 1 AS y FROM docs WHERE label > -1",
    "labels_ova": "SELECT vec_id, cls, CASE WHEN label = cls THEN 1 ELSE -1 END AS y FROM embeddings, (SELECT DISTINCT label AS cls FROM embeddings)",
    "labelled_instances": BASE + "SELECT domain, doc_id, label FROM docs WHERE label > -1 AND domain IN ('books', 'dvd')",
    "append_features": BASE
    + LENGTHS
    + """, z AS (SELECT doc_id, j, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM y), g AS (SELECT doc_id, sum(tf) AS a, count(*) AS b FROM x GROUP BY doc_id)
    SELECT doc_id, j, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) + 0.0 AS x FROM z
    UNION ALL SELECT doc_id, CAST(200 AS BIGINT), a * CAST(0.5 AS DOUBLE) FROM g UNION ALL SELECT doc_id, CAST(201 AS BIGINT), b * CAST(0.5 AS DOUBLE) FROM g""",
    "column_subset": BASE + "SELECT doc_id, j, tf FROM x WHERE j < 50",
    "task_registry_reviews": """
WITH d AS (SELECT * FROM (VALUES (0, 'dvd'), (1, 'books'), (2, 'kitchen'), (3, 'electronics')) v(k, name)), z AS (SELECT * FROM (VALUES ('all'), ('small')) v(size))
SELECT CAST(row_number() OVER (ORDER BY size, s.k, t.k) - 1 AS INTEGER) AS task_id, s.name AS source, t.name AS target, size FROM d s, d t, z WHERE s.k <> t.k""",
    "task_registry_news": _NEWS,
    "news_categories": _CATEGORIES,
    "hyper_grid": f"""
SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(eta AS DOUBLE) AS eta, round(eta / (1 - eta / (1 + alpha)), 6) + 0.0 AS factor
FROM (SELECT CAST(unnest({list(tasks.ALPHAS)}) AS DOUBLE) AS alpha), (SELECT CAST(unnest({list(tasks.ETAS)}) AS DOUBLE) AS eta)""",
    "best_param": """
SELECT task_id, alpha, eta, score FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, alpha DESC, eta DESC) AS k FROM grid_scores WHERE score IS NOT NULL) WHERE k = 1""",
    "grid_means": "SELECT alpha, eta, round(avg(score), 6) + 0.0 AS mean_score, count(*) AS n FROM (SELECT DISTINCT * FROM grid_scores WHERE score IS NOT NULL) GROUP BY ALL",
    "score_rows": r"""
SELECT task_id, source_domain || '$\rightarrow$' || target_domain || ' & ' || printf('%.2f', avg(score)) || ' & ' || printf('%.2f', max(score)) || ' \\' AS row
FROM grid_scores JOIN tasks USING (task_id) WHERE score IS NOT NULL GROUP BY task_id, source_domain, target_domain""",
    "activations": """
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT vec_id, j, round(tanh(x), 6) + 0.0 AS tanh, round(1 / (1 + exp(-x)), 6) + 0.0 AS sigmoid, round(greatest(x, 0), 6) + 0.0 AS relu FROM e""",
    "argmax_class": """
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS cls, unnest(embedding) AS score FROM embeddings)
SELECT vec_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS k FROM e) WHERE k = 1""",
    "accuracy": BASE + SCORED + "SELECT round(avg(CAST(label = predicted AS DOUBLE)), 6) + 0.0 AS accuracy FROM p",
    "class_report": BASE
    + SCORED
    + """, c AS (SELECT unnest([0, 1]) AS cls), g AS (SELECT cls, count(*) FILTER (label = cls) AS support, count(*) FILTER (predicted = cls) AS said, count(*) FILTER (label = cls AND predicted = cls) AS tp
        FROM c, p GROUP BY cls), h AS (SELECT cls, CASE WHEN said > 0 THEN tp / said ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM g)
    SELECT cls, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall,
        round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) + 0.0 AS f1, support FROM h""",
    "roc_auc": BASE
    + SCORED
    + """, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM p)
    SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) + 0.0 AS auc FROM r""",
}


def whole(sql: str) -> str:
    """The SQL of 200 words for the whole vocabulary: every number that stands for their count, or half of it, raised."""
    return re.sub(r"\b20([01])\b", rf"{WHOLE // 10}\1", sql).replace("<= 100 ", f"<= {WHOLE // 2} ")


SQL |= {f"{name}_{WHOLE}": whole(SQL[name]) for name in LONG}
