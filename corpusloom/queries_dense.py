"""Queries over moments, solvers, projections and estimators; with their SQL.

Texts: TF-IDF of the reviews' 200 words. Vectors: ``embeddings``, of which domain 2 (vec_id modulo 3) is the target, with
labels known for every tenth of its rows. The SQL of solved matrices is in ``solver_sql``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom import solver_sql
from corpusloom.operators import baselines, denoise, estimators, features, regularized
from corpusloom.operators.moments import Moments, dense_rows, feature_rows, mean_gap, moments
from corpusloom.plans import experiments
from corpusloom.plans.partial import matrix_rows
from corpusloom.plans.session import kept
from corpusloom.queries_text import BASE, LENGTHS, SOURCE, TARGET, WHOLE, WORDS, Corpus, whole
from corpusloom.sources.tables import table

D = 64
#: Settings of the queries.
NOISE, REG, ALPHA, ETA = 0.9, 1e-2, 1.0, 0.1
PARAMS = regularized.Params()
CV = 3


def rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    return np.round(x, places) + 0.0


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    known = F.when(F.col("vec_id") % 3 < 2, "source").when(F.col("vec_id") % 10 == 0, "labelled").otherwise("unlabelled")
    rows = e.select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3).cast("int").alias("domain"), known.alias("role"), "label", "embedding")
    return dense_rows(rows.withColumn("cls", F.when(F.col("role") == "unlabelled", -1).otherwise(F.col("label"))), "embedding").drop("embedding")


def vector_moments(spark: SparkSession, folder: str) -> Moments:
    return moments(vectors(spark, folder), D, ["domain", "role", "cls"])


def texts(spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:
    """TF-IDF feature rows of all reviews."""
    c = Corpus(spark, folder, words)
    return feature_rows(c.docs, c.weighted(2).select("doc_id", "j", F.col("w").alias("x")))


def gram_text(spark: SparkSession, folder: str) -> DataFrame:
    c = Corpus(spark, folder)
    rows = feature_rows(c.docs, c.coded().select("doc_id", "j", F.col("tf").alias("x")))
    return matrix_rows(spark, ("i", "j"), s=moments(rows, WORDS, []).total()[2])


def gram_dense(spark: SparkSession, folder: str) -> DataFrame:
    return matrix_rows(spark, ("i", "j"), s=rounded(vector_moments(spark, folder).total()[2]))


def xty(spark: SparkSession, folder: str) -> DataFrame:
    m = vector_moments(spark, folder)
    return matrix_rows(spark, ("j", "cls"), v=rounded(regularized.parts(m, PARAMS).XY))


def domain_cross_moments(spark: SparkSession, folder: str) -> DataFrame:
    p = regularized.parts(vector_moments(spark, folder), PARAMS)
    return matrix_rows(spark, ("j", "dom"), xyd=rounded(p.XYD), pd=rounded(p.Pd))


def mda_expectations(spark: SparkSession, folder: str) -> DataFrame:
    P, Q = denoise.expectations(vector_moments(spark, folder).total()[2], NOISE, bias=False)
    return matrix_rows(spark, ("i", "j"), p=rounded(P), q=rounded(Q))


def _gap_rows(spark: SparkSession, M: np.ndarray) -> DataFrame:
    return matrix_rows(spark, ("i", "j"), m=rounded(M), qm=rounded(denoise.marginal(M, np.full(D, 1 - PARAMS.noise))))


def mmd_linear(spark: SparkSession, folder: str) -> DataFrame:
    return _gap_rows(spark, mean_gap(vector_moments(spark, folder), lambda g: g[1] == "source", lambda g: g[1] != "source"))


def mmd_multisource(spark: SparkSession, folder: str) -> DataFrame:
    return _gap_rows(spark, regularized.discrepancy(vector_moments(spark, folder)))


def mmd_class(spark: SparkSession, folder: str) -> DataFrame:
    return _gap_rows(spark, regularized.class_discrepancy(vector_moments(spark, folder)))


def domain_mi(spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:
    c = Corpus(spark, folder, words)
    voc = c.vocabulary()
    seen = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(k) for d, k in ((SOURCE, "df_s"), (TARGET, "df_t"))]
    df = voc.select(F.col("wid").alias("j")).join(c.coded(voc).groupBy("j").agg(*seen), "j", "left")
    ns, nt = (c.docs.where(F.col("domain") == d).count() for d in (SOURCE, TARGET))
    g = baselines.domain_information(df.fillna(0), ns, nt).select("j", (F.round("g", 9) + 0.0).alias("g"))
    first = F.row_number().over(features.Window.orderBy("g", "j")) <= words // 2  # over the words of a vocabulary
    return g.select("j", "g", first.alias("is_domain_independent"))


def sfa_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    S = moments(texts(spark, folder), WORDS, []).total()[2]
    norm = np.sqrt(np.diag(S))
    return matrix_rows(spark, ("i", "j"), q=rounded(S / np.outer(norm, norm)))


def filter_w(keep: str, spark: SparkSession, folder: str) -> DataFrame:
    w = gram_dense(spark, folder).withColumnRenamed("s", "v")
    out = features.top_per_row(w, 10) if keep == "top" else features.one_sign(w, keep == "positive")
    return out.select("i", "j", (F.col("v") + F.lit(0.0)).alias("v"))


def solved(spark: SparkSession, W: np.ndarray) -> DataFrame:
    """(i, j, w) of a solved matrix."""
    return matrix_rows(spark, ("i", "j"), w=rounded(W))


def ridge_domain_clf(spark: SparkSession, folder: str) -> DataFrame:
    m = vector_moments(spark, folder)
    xd = m.of(lambda g: g[1] != "source")[1] - m.of(lambda g: g[1] == "source")[1]
    return solved(spark, denoise.domain_classifier(m.total()[2], xd, ALPHA)[:, None]).select(F.col("i").alias("j"), "w")


def mda_solve(spark: SparkSession, folder: str) -> DataFrame:
    return solved(spark, denoise.mapping(moments(texts(spark, folder), WORDS, [], bias=True).total()[2], NOISE, REG))


def mda_nobias(spark: SparkSession, folder: str) -> DataFrame:
    return solved(spark, denoise.mapping(vector_moments(spark, folder).total()[2], NOISE, REG, bias=False))


def mda_reduced_output(spark: SparkSession, folder: str) -> DataFrame:
    """Only the 20 most frequent words are reconstructed; these are the first of the vocabulary."""
    rows = kept(texts(spark, folder))
    return solved(spark, denoise.mapping(moments(rows, WORDS, [], bias=True).total()[2], NOISE, REG, outputs=estimators.most_frequent(rows, 20)))


def mda_domainreg(spark: SparkSession, folder: str) -> DataFrame:
    m = vector_moments(spark, folder)
    xd = m.of(lambda g: g[1] != "source")[1] - m.of(lambda g: g[1] == "source")[1]
    return solved(spark, denoise.domain_mapping(m.total()[2], m.total()[1], xd, NOISE, ALPHA, ETA, reg=REG))


def reg_solve(method: str, iterate: bool, spark: SparkSession, folder: str) -> DataFrame:
    """W of a method; those with class classifiers have one for each source, or one that alternates with W until the loss settles."""
    return solved(spark, regularized.solve(method, vector_moments(spark, folder), PARAMS, iterate=iterate)[0])


def mda_project(spark: SparkSession, folder: str) -> DataFrame:
    """Hidden features tanh(x W')."""
    rows = vectors(spark, folder)
    W = denoise.mapping(moments(rows, D, []).total()[2], NOISE, REG, bias=False)
    return _hidden(denoise.project(rows.select("doc_id", "js", "xs"), W, D))


def _hidden(rows: DataFrame) -> DataFrame:
    return denoise.hidden_long(rows).select("doc_id", "i", (F.round("h", 6) + 0.0).alias("h"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """TF-IDF of two domains, domain-regularized denoising, hidden features of every review of them."""
    rows = kept(texts(spark, folder).where(F.col("domain").isin(SOURCE, TARGET)))
    m = moments(rows, WORDS, ["domain"])
    xd = m.of(lambda g: g[0] == TARGET)[1] - m.of(lambda g: g[0] == SOURCE)[1]
    W = denoise.domain_mapping(m.total()[2], m.total()[1], xd, NOISE, ALPHA, ETA, reg=REG)
    return _hidden(denoise.project(rows.select("doc_id", "js", "xs"), W, WORDS))


def msda_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Hidden features of the last of three layers."""
    outs, _ = denoise.stack(vectors(spark, folder).select("doc_id", "js", "xs"), D, layers=3, noise=0.5)
    return _hidden(outs[-1])


def filter_w_project(spark: SparkSession, folder: str) -> DataFrame:
    """Hidden features of a mapping of which each row keeps its ten largest weights."""
    rows = vectors(spark, folder)
    W = denoise.filtered(denoise.mapping(moments(rows, D, [], bias=True).total()[2], 0.5), "top", 10)
    return _hidden(denoise.project(rows.select("doc_id", "js", "xs"), W, D, bias=True))


def lsi_features(spark: SparkSession, folder: str) -> DataFrame:
    """Squared lengths of the reviews in the space of 20 latent directions, free of signs."""
    rows = kept(texts(spark, folder))
    V, s = baselines.latent(rows, WORDS, 20)
    z = baselines.latent_features(rows, V, s, WORDS)
    return z.select("doc_id", (F.round(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x * x), 6) + 0.0).alias("length2"))


def review_corpus(spark: SparkSession, folder: str, words: int = WORDS) -> estimators.Corpus:
    """All reviews of the two domains, written once; only fits of classifiers and scores leave out those without a label."""
    rows = kept(Corpus(spark, folder, words).rows(SOURCE, TARGET))
    return estimators.Corpus(rows.where(F.col("domain") == SOURCE), rows.where(F.col("domain") == TARGET), words)


def sfa_features(spark: SparkSession, folder: str) -> DataFrame:
    """Squared lengths of the reviews in the space of ten aligned directions."""
    corpus = review_corpus(spark, folder)
    order = estimators.informative_order(corpus)
    specific = np.sort(order[WORDS // 2 :])
    directions = baselines.alignment(moments(corpus.all(), WORDS, []), np.sort(order[: WORDS // 2]), specific, 10)
    z = baselines.aligned_features(corpus.all(), directions, specific, WORDS)
    return z.select("doc_id", (F.round(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x * x), 6) + 0.0).alias("length2"))


def _accuracy(spark: SparkSession, name: str, fitted: estimators.Adapter) -> DataFrame:
    values = (name, fitted.cv_score, fitted.score(fitted.corpus.target), fitted.strength)
    return spark.createDataFrame([values], "estimator string, cv_accuracy double, target_accuracy double, strength double")


def estimator(name: str, make, spark: SparkSession, folder: str, words: int = WORDS) -> DataFrame:  # noqa: ANN001
    return _accuracy(spark, name, make(review_corpus(spark, folder, words)).fit())


def beside_baseline(name: str, make, spark: SparkSession, folder: str) -> DataFrame:  # noqa: ANN001
    """The accuracy of the features as they are, and that of the adapted ones."""
    values = (name, *experiments.with_baseline(make(review_corpus(spark, folder))))
    return spark.createDataFrame([values], "estimator string, base_accuracy double, target_accuracy double")


def estimator_domreg_labelled(spark: SparkSession, folder: str) -> DataFrame:
    """One setting of the domain-regularized estimator, labelled target reviews among those that the classifier learns from."""
    c = review_corpus(spark, folder)
    both = estimators.Corpus(c.source, c.target, c.d, semi_supervised=True)
    return _accuracy(spark, "domain_regularized_labelled", estimators.DomainAdapter(both, alphas=(ALPHA,), etas=(ETA,), cv=CV).fit())


def estimator_lsi_mda(spark: SparkSession, folder: str) -> DataFrame:
    """Denoised features, then latent directions of them."""
    c = review_corpus(spark, folder)
    W = denoise.mapping(moments(c.all(), c.d, [], bias=True).total()[2], NOISE, REG)
    hidden = [denoise.project(rows, W, c.d, bias=True) for rows in (c.source, c.target)]
    return _accuracy(spark, "lsi_mda", estimators.LatentAdapter(estimators.Corpus(*hidden, c.d), 50, cv=CV).fit())


def _scores(spark: SparkSession, t: estimators.Transduction) -> DataFrame:
    values = (t.base_accuracy, t.accuracy, t.base_auc, t.auc, t.self_accuracy)
    return spark.createDataFrame([values], "base_accuracy double, accuracy double, base_auc double, auc double, self_accuracy double")


def transductive_binary(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, estimators.transductive(review_corpus(spark, folder), cv=CV, self_learning=True))


def _vector_corpus(spark: SparkSession, folder: str) -> estimators.Corpus:
    rows = vectors(spark, folder)
    return estimators.Corpus(rows.where("role = 'source'"), rows.where("role <> 'source'"), D)


def transductive_multiclass(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, estimators.transductive(_vector_corpus(spark, folder), cv=CV))


def transductive_testfeat(spark: SparkSession, folder: str) -> DataFrame:
    """The target's probabilities are denoised beside features of a vocabulary of the target's own."""
    c = Corpus(spark, folder)
    docs = c.docs.where(F.col("domain") == TARGET)
    counts = c.counts.where(F.col("domain") == TARGET)
    from corpusloom.operators import vocabulary, weighting

    n = docs.count()
    voc = vocabulary.by_frequency(counts, n, WORDS)
    coded = vocabulary.encode(counts, voc).select("doc_id", F.col("wid").alias("j"), "tf")
    w = weighting.weigh(coded, voc.select(F.col("wid").alias("j"), "df"), 2, n, 0.0)
    own = feature_rows(docs, w.select("doc_id", "j", F.col("w").alias("x")))
    return _scores(spark, estimators.transductive(review_corpus(spark, folder), cv=CV, target_features=(own, WORDS)))


def transductive_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Class scores of the target by the nearest class mean of the source vectors, denoised as decisions."""
    rows = vectors(spark, folder)
    m = vector_moments(spark, folder)
    listed = regularized.classes(m)
    means = np.stack([np.divide(s, n) for n, s, _ in (m.of(lambda g, c=c: g[1] == "source" and g[2] == c) for c in listed)])
    scored = denoise.project(rows.where("role <> 'source'"), means, D, "identity").select("doc_id", F.col("xs").alias("probability"))
    target = rows.where("role <> 'source'").select("doc_id", "label", "js", "xs").join(scored, "doc_id")
    return _scores(spark, estimators.transductive_scores(target, D, len(listed), hard=True))


def ssl_transductive(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, estimators.semi_supervised(review_corpus(spark, folder).source, WORDS))


def benchmark_task(spark: SparkSession, folder: str) -> DataFrame:
    """Task 0 of the registry (books to dvd) in its size: held-out reviews carry no label, so the labelled target is scored."""
    row = table(spark, folder, "tasks").orderBy("task_id").first()
    task = experiments.review_task(table(spark, folder, "reviews"), row["source_domain"], row["target_domain"], row["size"], WORDS)
    out = experiments.benchmark(experiments.Task(task.corpus), NOISE, cv=CV)
    return spark.createDataFrame([(row["task_id"], out["acc_mda"], out["acc_domreg"], out["alpha"], out["eta"])], "task_id int, acc_mda double, acc_domreg double, alpha double, eta double")


def transductive_job(spark: SparkSession, folder: str) -> DataFrame:
    """The job 12:0.9:2 of the registry."""
    out = experiments.transductive_job("12:0.9:2", table(spark, folder, "reviews"), table(spark, folder, "tasks"), WORDS, cv=CV)
    names = ("task_id", "noise", "feat_type", "base_accuracy", "accuracy", "base_auc", "auc")
    kinds = ("int", "double", "int", "double", "double", "double", "double")
    return spark.createDataFrame([tuple(out[n] for n in names)], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


QUERIES = {
    f.__name__: f
    for f in (
        gram_text, gram_dense, xty, domain_cross_moments, mda_expectations, mmd_linear, mmd_multisource, mmd_class, domain_mi, sfa_cooccurrence, ridge_domain_clf, mda_solve, mda_nobias,
        mda_reduced_output, mda_domainreg, mda_project, flagship, msda_stack, filter_w_project, lsi_features, sfa_features, estimator_lsi_mda, estimator_domreg_labelled, transductive_binary,
        transductive_multiclass, transductive_testfeat, transductive_scores, ssl_transductive, benchmark_task, transductive_job,
    )
} | {
    "filter_w_topk": partial(filter_w, "top"),
    "filter_w_pos": partial(filter_w, "positive"),
    "filter_w_neg": partial(filter_w, "negative"),
    f"domain_mi_{WHOLE}": partial(domain_mi, words=WHOLE),
    "no_transfer": partial(estimator, "no_transfer", lambda c: estimators.Adapter(c, cv=CV)),
    "estimator_mda": partial(estimator, "mda", lambda c: estimators.MdaAdapter(c, cv=CV)),
    "estimator_domreg": partial(estimator, "domain_regularized", lambda c: estimators.DomainAdapter(c, cv=CV)),
    "lsi_transfer": partial(estimator, "lsi", lambda c: estimators.LatentAdapter(c, 50, appended=True, cv=CV)),
    "mda_beside_baseline": partial(beside_baseline, "mda", lambda c: estimators.MdaAdapter(c, cv=CV)),
    "sfa_transfer": partial(beside_baseline, "sfa", lambda c: estimators.AlignedAdapter(c, WORDS // 2, 20, cv=CV)),
}
QUERIES |= {f"{name}_{WHOLE}": partial(QUERIES[name], words=WHOLE) for name in ("no_transfer", "estimator_mda", "estimator_domreg")}
CLASS_METHODS = ("TCW", "TFW", "TDCW", "TDFW", "TMCW", "TMFW", "TCMCW", "TCMFW")
REGULARIZED = {f"reg_{m.lower()}": (m, True) for m in regularized.METHODS} | {f"reg_{m.lower()}_per_source": (m, False) for m in CLASS_METHODS}
QUERIES |= {name: partial(reg_solve, *how) for name, how in REGULARIZED.items()}

VEC = """
WITH e AS (SELECT vec_id, vec_id % 3 AS dom, vec_id % 3 < 2 AS src, vec_id % 3 < 2 OR vec_id % 10 = 0 AS known, label,
    generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
g AS (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS s FROM e a JOIN e b USING (vec_id) GROUP BY ALL),
c AS (SELECT DISTINCT label AS cls FROM embeddings)
"""
_GAP = ", o AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS m FROM v a JOIN v b USING (k) GROUP BY ALL) SELECT i, j, round(m, 6) + 0.0 AS m, round(m * CASE WHEN i = j THEN 0.9 ELSE 0.9 * 0.9 END, 6) + 0.0 AS qm FROM o"
TFIDF = (
    BASE
    + LENGTHS
    + """, z AS (SELECT doc_id, j, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM y), t AS (SELECT doc_id, j, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM z)"""
)
_CELLS = ", cells AS (SELECT i, j FROM (SELECT unnest(generate_series(0, {0})) AS i), (SELECT unnest(generate_series(0, {1})) AS j)) "
SQL = {
    "gram_text": BASE + _CELLS.format(199, 199) + """, s AS (SELECT a.j AS i, b.j AS j, sum(a.tf * b.tf) AS s FROM x a JOIN x b USING (doc_id) GROUP BY ALL)
    SELECT i, j, CAST(coalesce(s, 0) AS DOUBLE) AS s FROM cells LEFT JOIN s USING (i, j)""",
    "gram_dense": VEC + "SELECT i, j, round(s, 6) + 0.0 AS s FROM g",
    "xty": VEC + "SELECT j, CAST(cls AS BIGINT) AS cls, round(sum(CASE WHEN label = cls THEN x ELSE -x END), 6) + 0.0 AS v FROM e, c WHERE known GROUP BY ALL",
    "domain_cross_moments": VEC
    + """SELECT j, dom, round(sum(CASE WHEN e.d = dom THEN x ELSE -x END), 6) + 0.0 AS xyd, round(sum(CASE WHEN dom = 2 THEN x ELSE -x END), 6) + 0.0 AS pd
    FROM (SELECT j, x, dom AS d FROM e) e, (SELECT unnest(generate_series(0, 2)) AS dom) GROUP BY ALL""",
    "mda_expectations": VEC + "SELECT i, j, round(s * (1 - CAST(0.9 AS DOUBLE)), 6) + 0.0 AS p, round(s * CASE WHEN i = j THEN 1 - CAST(0.9 AS DOUBLE) ELSE pow(1 - CAST(0.9 AS DOUBLE), 2) END, 6) + 0.0 AS q FROM g",
    "mmd_linear": VEC + ", v AS (SELECT j, 0 AS k, avg(x) FILTER (src) - avg(x) FILTER (NOT src) AS v FROM e GROUP BY j)" + _GAP,
    "mmd_multisource": VEC
    + """, a AS (SELECT j, avg(x) FILTER (dom = 0) AS a0, avg(x) FILTER (dom = 1) AS a1, avg(x) FILTER (dom = 2) AS a2 FROM e GROUP BY j),
    v AS (SELECT j, 0 AS k, a0 - a1 AS v FROM a UNION ALL SELECT j, 1, a0 - a2 FROM a UNION ALL SELECT j, 2, a1 - a2 FROM a)"""
    + _GAP,
    "mmd_class": VEC
    + """, a AS (SELECT j, cls, avg(x) FILTER (dom = 0) AS a0, avg(x) FILTER (dom = 1) AS a1, avg(x) FILTER (dom = 2) AS a2 FROM e JOIN c ON label = cls WHERE known GROUP BY ALL),
    v AS (SELECT j, 3 * cls AS k, coalesce(a0 - a1, 0) AS v FROM a UNION ALL SELECT j, 3 * cls + 1, coalesce(a0 - a2, 0) FROM a UNION ALL SELECT j, 3 * cls + 2, coalesce(a1 - a2, 0) FROM a)"""
    + _GAP,
    "domain_mi": BASE
    + """, f AS (SELECT j, 0.5 + count(*) FILTER (domain = 'books') AS s, 0.5 + count(*) FILTER (domain = 'dvd') AS t FROM x GROUP BY j),
    k AS (SELECT CAST(count(*) FILTER (domain = 'books') AS DOUBLE) AS ns, CAST(count(*) FILTER (domain = 'dvd') AS DOUBLE) AS nt FROM docs),
    g AS (SELECT j, round(s / (ns + nt) * (ln(s / (ns + nt) + 1e-8) - ln((s + t) / (ns + nt) + 1e-8) - ln(ns / (ns + nt) + 1e-8))
        + t / (ns + nt) * (ln(t / (ns + nt) + 1e-8) - ln((s + t) / (ns + nt) + 1e-8) - ln(nt / (ns + nt) + 1e-8)), 9) + 0.0 AS g FROM f, k)
    SELECT j, g, row_number() OVER (ORDER BY g, j) <= 100 AS is_domain_independent FROM g""",
    "sfa_cooccurrence": TFIDF + _CELLS.format(199, 199)
    + """, s AS (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS s FROM t a JOIN t b USING (doc_id) GROUP BY ALL), n2 AS (SELECT i, s AS n2 FROM s WHERE i = j)
    SELECT i, j, round(coalesce(s, 0) / sqrt(p.n2 * q.n2), 6) + 0.0 AS q FROM cells LEFT JOIN s USING (i, j) JOIN n2 p USING (i) JOIN (SELECT i AS j, n2 FROM n2) q USING (j)""",
    "filter_w_topk": VEC + "SELECT i, j, CASE WHEN row_number() OVER (PARTITION BY i ORDER BY round(s, 6) DESC, j) <= 10 THEN round(s, 6) + 0.0 ELSE CAST(0 AS DOUBLE) END AS v FROM g",
    "filter_w_pos": VEC + "SELECT i, j, greatest(round(s, 6), 0) + 0.0 AS v FROM g",
    "filter_w_neg": VEC + "SELECT i, j, least(round(s, 6), 0) + 0.0 AS v FROM g",
}
SQL |= {name: solver_sql.regularized(*how) for name, how in REGULARIZED.items()}


def _total_and_side(x: solver_sql.Algebra, rows: str, target: str) -> tuple[str, str]:
    """Columns of the sums of features and of those with the domain's sign, of rows (j, x and what ``target`` looks at)."""
    return tuple(x.matrix(f"(SELECT j AS i, 0 AS j, sum({v}) AS v FROM {rows} GROUP BY j)") for v in ("x", f"CASE WHEN {target} THEN x ELSE -x END"))


def _vector_sql(kind: str) -> str:
    x = solver_sql.Algebra(solver_sql.VECTORS)
    S = x.matrix("g", "s")
    total, xd = _total_and_side(x, "e", "NOT src")
    if kind == "ridge":
        return x.query(f"SELECT j, w FROM ({x.rows(x.solve(x.ridged(S, ALPHA), xd), ('j', 'one'))})")
    if kind == "domain":
        return x.rows(x.domain_mapping(S, total, xd, NOISE, ALPHA, ETA, REG))
    W = x.mapping(S, NOISE, REG, bias=False)
    if kind == "plain":
        return x.rows(W)
    return x.query(_PROJECTED.format(W=W, rows="(SELECT vec_id AS doc_id, list(x ORDER BY j) AS v FROM e GROUP BY vec_id)"))


_PROJECTED = """SELECT doc_id, CAST(generate_subscripts(h, 1) - 1 AS BIGINT) AS i, round(unnest(h), 6) + 0.0 AS h
FROM (SELECT doc_id, list_transform(W.m, lambda r: tanh(list_dot_product(r, rows.v))) AS h FROM {rows} rows, {W} W)"""
_ONE = "list_concat(v, [CAST(1 AS DOUBLE)])"


def _stack_sql(layers: int, noise: float, reg: float, top: int | None) -> str:
    """Layers of denoising with a bias over the vectors; ``top`` keeps the largest weights of each row."""
    x = solver_sql.Algebra(solver_sql.VECTORS)
    rows = x.table("SELECT vec_id AS doc_id, list(x ORDER BY j) AS v FROM e GROUP BY vec_id")
    for _ in range(layers):
        S = x.matrix(f"(SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM (SELECT doc_id, generate_subscripts({_ONE}, 1) AS i, unnest({_ONE}) AS x FROM {rows}) a JOIN (SELECT doc_id, generate_subscripts({_ONE}, 1) AS i, unnest({_ONE}) AS x FROM {rows}) b USING (doc_id) GROUP BY ALL)")
        W = x.mapping(S, noise, reg, bias=True)
        if top:
            W = x.table(f"SELECT list_transform(m, lambda r: list_transform(r, lambda y: CASE WHEN y >= list_sort(r, 'DESC')[{top}] THEN y ELSE CAST(0 AS DOUBLE) END)) AS m FROM {W}")
        rows = x.table(f"SELECT doc_id, list_transform(W.m, lambda r: tanh(list_dot_product(r, {_ONE}))) AS v FROM {rows}, {W} W")
    return x.query(f"SELECT doc_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS i, round(unnest(v), 6) + 0.0 AS h FROM {rows}")


def _text_sql(outputs: int | None = None, domains: bool = False) -> str:
    """Over TF-IDF of the reviews: W of denoising with a bias, or the hidden features of the domain-regularized one of two domains."""
    on = f"domain IN ('{SOURCE}', '{TARGET}')" if domains else "true"
    x = solver_sql.Algebra(TFIDF)
    d = x.table(f"SELECT doc_id, domain FROM docs WHERE {on}")
    every = x.table(f"SELECT doc_id, domain, j, x FROM t JOIN {d} USING (doc_id)" + ("" if domains else f" UNION ALL SELECT doc_id, domain, CAST({WORDS} AS BIGINT), CAST(1 AS DOUBLE) FROM {d}"))
    n = WORDS - 1 if domains else WORDS
    cells = x.table(f"SELECT i, j FROM (SELECT unnest(generate_series(0, {n})) AS i), (SELECT unnest(generate_series(0, {n})) AS j)")
    S = x.matrix(f"(SELECT i, j, coalesce(v, CAST(0 AS DOUBLE)) AS v FROM {cells} LEFT JOIN (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS v FROM {every} a JOIN {every} b USING (doc_id) GROUP BY ALL) USING (i, j))")
    if not domains:
        return x.rows(x.mapping(S, NOISE, REG, True, outputs))
    zero = f"(SELECT j, domain, x FROM {every} UNION ALL SELECT DISTINCT j, '{SOURCE}', CAST(0 AS DOUBLE) FROM {cells})"
    W = x.domain_mapping(S, *_total_and_side(x, zero, f"domain = '{TARGET}'"), NOISE, ALPHA, ETA, REG)
    full = f"(SELECT doc_id, list(coalesce(x, CAST(0 AS DOUBLE)) ORDER BY j) AS v FROM (SELECT doc_id, j FROM {d}, (SELECT DISTINCT j FROM {cells})) LEFT JOIN {every} USING (doc_id, j) GROUP BY doc_id)"
    return x.query(_PROJECTED.format(W=W, rows=full))


SQL |= {
    "ridge_domain_clf": _vector_sql("ridge"),
    "mda_nobias": _vector_sql("plain"),
    "mda_domainreg": _vector_sql("domain"),
    "mda_project": _vector_sql("project"),
    "msda_stack": _stack_sql(3, 0.5, 1e-5, None),
    "filter_w_project": _stack_sql(1, 0.5, 1e-2, 10),
    "mda_solve": _text_sql(),
    "mda_reduced_output": _text_sql(20),
    "flagship": _text_sql(domains=True),
}
SQL[f"domain_mi_{WHOLE}"] = whole(SQL["domain_mi"])
