"""Tasks end to end: corpora of a task, the two benchmarked estimators, transductive jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusloom.operators import estimators, vocabulary, weighting
from corpusloom.operators.moments import feature_rows
from corpusloom.plans.session import cut, kept
from corpusloom.plans.tasks import ALPHAS, ETAS, Job
from corpusloom.sources import newsgroups, reviews


@dataclass
class Task:
    """A corpus to adapt on and, where there is one, a held-out part of the target."""

    corpus: estimators.Corpus
    held_out: DataFrame | None = None
    #: The target beside a vocabulary of its own: rows, features.
    own: tuple[DataFrame, int] | None = None


def features(docs: DataFrame, counts: DataFrame, vocabulary_: DataFrame, words: int, code: int, fit: DataFrame | None = None) -> DataFrame:
    """Weighted feature rows of ``docs``; document frequencies come from the documents ``fit`` (all by default)."""
    fit = docs if fit is None else fit
    coded = vocabulary.encode(counts, vocabulary_).select("doc_id", F.col("wid").alias("j"), "tf")
    seen = coded.join(fit.select("doc_id"), "doc_id", "left_semi")
    n = fit.count()
    avgdl = (seen.agg(F.sum("tf")).first()[0] or 0) / max(n, 1)
    df = vocabulary_.select(F.col("wid").alias("j")).join(seen.groupBy("j").agg(F.count("*").alias("df")), "j", "left").fillna(0)
    return feature_rows(docs, weighting.weigh(coded, df, code, n, avgdl).select("doc_id", "j", F.col("w").alias("x")))


def review_task(all_reviews: DataFrame, source: str, target: str, size: str = "small", words: int = 5000, code: int = 2) -> Task:
    """Source and target of a size (small: labelled split, all: both splits), held-out target: its unlabeled split. The vocabulary
    and the frequencies come from source and target together, and apply to the held-out part too."""
    recs = reviews.records(all_reviews.where(F.col("domain").isin(source, target)))
    docs = kept(reviews.spine(recs))
    counts = kept(reviews.term_counts(recs).select("doc_id", "token", "tf"), "doc_id", placed=True)
    used = docs if size == "all" else docs.where("split = 'labelled'")
    voc = cut(vocabulary.by_frequency(counts.join(used.select("doc_id"), "doc_id", "left_semi"), used.count(), words))
    rows = kept(features(docs, counts, voc, words, code, used))
    chosen = rows if size == "all" else rows.where("split = 'labelled'")
    held = rows.where((F.col("domain") == target) & (F.col("split") == "unlabeled"))
    return Task(estimators.Corpus(chosen.where(F.col("domain") == source), chosen.where(F.col("domain") == target), words), held)


def news_task(posts: DataFrame, task_id: int, words: int = 10_000, code: int = 2, fit_all: bool = True, own: bool = False) -> Task:
    """Source and target of a newsgroup task (posts: doc_id, category, text); vocabulary of both or of the source only. With ``own``, the
    task also has the target's features over a vocabulary of the target only."""
    docs = kept(newsgroups.labelled_posts(posts.withColumn("text", newsgroups.clean(F.coalesce("text", F.lit("")))), task_id))
    counts = kept(newsgroups.tokens(docs), "doc_id")
    fit = docs if fit_all else docs.where("domain = 'source'")
    voc = cut(vocabulary.by_total(counts.join(fit.select("doc_id"), "doc_id", "left_semi"), words))
    rows = kept(features(docs.select("doc_id", "domain", "label"), counts, voc, words, code, fit))
    target = None
    if own:
        mine, theirs = docs.where("domain = 'target'").select("doc_id", "domain", "label"), counts.join(docs.where("domain = 'target'").select("doc_id"), "doc_id", "left_semi")
        target = kept(features(mine, theirs, cut(vocabulary.by_total(theirs, words)), words, code)), words
    return Task(estimators.Corpus(rows.where("domain = 'source'"), rows.where("domain = 'target'"), words), own=target)


def with_baseline(adapter: estimators.Adapter, test: DataFrame | None = None) -> tuple[float, float]:
    """(accuracy of the features as they are, accuracy of the adapter), both fitted on the adapter's corpus and scored on ``test`` or the target."""
    test = adapter.corpus.target if test is None else test
    plain = estimators.Adapter(adapter.corpus, adapter.cv, adapter.strengths).fit()
    return plain.score(test), adapter.fit().score(test)


def benchmark(task: Task, noise: float = 0.9, alphas: tuple = ALPHAS, etas: tuple = ETAS, **cv) -> dict:  # noqa: ANN003
    """Accuracies of the denoising and of the domain-regularized estimator on the held-out target (or the target), and the search.

    The target's labels are used for these scores only.
    """
    test = task.corpus.target if task.held_out is None else task.held_out
    plain = estimators.MdaAdapter(task.corpus, noise, **cv).fit()
    regular = estimators.DomainAdapter(task.corpus, noise, alphas, etas, **cv).fit()
    tried = sorted(regular.tried)
    return {"acc_mda": plain.score(test), "acc_domreg": regular.score(test), "alpha": regular.alpha, "eta": regular.eta, "tried": tried}


def transductive_job(text: str, reviews_: DataFrame, tasks: DataFrame, words: int = 5000, own_features: bool = False, **cv) -> dict:  # noqa: ANN003
    """A job ``task:noise:feature type`` over review tasks; ``own_features`` denoises beside a vocabulary of the target's own."""
    job = Job.parse(text)
    row = tasks.where(F.col("task_id") == job.task_id).first()
    if row is None:
        raise ValueError(f"no task {job.task_id}")
    corpus = review_task(reviews_, row["source_domain"], row["target_domain"], row["size"], words, job.feat_type).corpus
    beside = None
    if own_features:
        mine = review_task(reviews_, row["target_domain"], row["target_domain"], row["size"], words, job.feat_type).corpus
        beside = (mine.target, words)
    out = estimators.transductive(corpus, job.noise, target_features=beside, **cv)
    return {"task_id": job.task_id, "noise": job.noise, "feat_type": job.feat_type} | out.__dict__


def news_job(text: str, posts: DataFrame, words: int = 10_000, own_features: bool = False, **cv) -> dict:  # noqa: ANN003
    """A job ``task:noise:feature type`` over newsgroup tasks; ``own_features`` denoises beside a vocabulary of the target's own, and then
    classifies by a vocabulary of the source only."""
    job = Job.parse(text)
    task = news_task(posts, job.task_id, words, job.feat_type, fit_all=not own_features, own=own_features)
    out = estimators.transductive(task.corpus, job.noise, target_features=task.own, **cv)
    return {"task_id": job.task_id, "noise": job.noise, "feat_type": job.feat_type} | out.__dict__
