"""Queries do the whole job: all rows, words and settings that they name."""

import inspect
import re
from pathlib import Path

import numpy as np
import pytest

from corpusloom import queries_dense, queries_text
from corpusloom.operators import classify, estimators
from corpusloom.plans import experiments, tasks
from corpusloom.sources import reviews
from corpusloom.sources.tables import table
from tests.test_queries import QUERIES, SQL, database, rows

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


class Stopped(Exception):
    """Carries what a query passes on."""


def passed(monkeypatch, module, name, query, spark, folder=FOLDER):
    """Arguments with which ``query`` calls ``module.name``."""

    def stop(*args, **named):
        raise Stopped(args, named)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Stopped) as e:
        query(spark, folder)
    return e.value.args


def domain_docs(spark):
    docs = reviews.spine(reviews.records(table(spark, FOLDER, "reviews")))
    return {d: {r[0] for r in docs.where(docs.domain == d).select("doc_id").collect()} for d in ("books", "dvd")}


def ids(rows):
    return {r[0] for r in rows.select("doc_id").collect()}


def test_benchmark_task_takes_the_size_of_its_task(spark, monkeypatch):
    assert table(spark, FOLDER, "tasks").orderBy("task_id").first()["size"] == "all"
    args, _ = passed(monkeypatch, experiments, "benchmark", queries_dense.benchmark_task, spark)
    corpus, whole = args[0].corpus, domain_docs(spark)
    assert ids(corpus.source) == whole["books"] and ids(corpus.target) == whole["dvd"]
    assert not corpus.source.where("split = 'unlabeled'").isEmpty()


def test_adaptation_sees_reviews_without_a_label(spark, monkeypatch):
    corpus, whole = queries_dense.review_corpus(spark, FOLDER), domain_docs(spark)
    assert ids(corpus.source) == whole["books"] and ids(corpus.target) == whole["dvd"]
    assert not corpus.target.where("label IS NULL").isEmpty() and not corpus.target.where("label = -1").isEmpty()
    _, named = passed(monkeypatch, estimators, "transductive", queries_dense.transductive_testfeat, spark)
    assert ids(named["target_features"][0]) == whole["dvd"]


def test_sfa_features_shows_every_review(spark):
    whole = domain_docs(spark)
    assert ids(queries_dense.sfa_features(spark, FOLDER)) == whole["books"] | whole["dvd"]


@pytest.mark.parametrize("name", [*queries_text.LONG, "domain_mi"])
def test_whole_vocabulary(spark, name):
    """The same as the SQL with every number that stands for 200 words raised to 5,000; more than 200 of them occur."""
    sql = re.sub(r"\b20([01])\b", r"500\1", SQL[name]).replace("<= 100 ", "<= 2500 ")
    assert sql != SQL[name] and sql == SQL[f"{name}_5000"]
    df = QUERIES[f"{name}_5000"](spark, FOLDER)
    result = database().execute(sql)
    names, got = [d[0] for d in result.description], df.collect()
    assert rows(df.columns, got) == rows(names, result.fetchall())
    few = QUERIES[name](spark, FOLDER)
    assert rows(few.columns, few.collect()) != rows(df.columns, got)


@pytest.mark.parametrize("name, module, call", [("benchmark_task", experiments, "benchmark"), ("transductive_job", experiments, "transductive_job"), ("transductive_multiclass", estimators, "transductive")])
def test_the_whole_grid_is_searched(spark, monkeypatch, name, module, call):
    called = inspect.signature(getattr(module, call))
    args, named = passed(monkeypatch, module, call, QUERIES[name], spark)
    bound = called.bind(*args, **named)
    bound.apply_defaults()
    got = bound.arguments | bound.arguments.get("cv", {}) if isinstance(bound.arguments.get("cv"), dict) else bound.arguments
    assert got.get("strengths", classify.STRENGTHS) == classify.STRENGTHS
    if call == "benchmark":
        assert got["alphas"] == tasks.ALPHAS and got["etas"] == tasks.ETAS


def test_estimator_domreg_tries_all_settings(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(estimators, "cross_validated", lambda rows, d, k, strengths, n: tried.append(strengths) or (None, 1.0, 0.5))
    monkeypatch.setattr(estimators.Adapter, "score", lambda self, rows: 0.5)
    QUERIES["estimator_domreg"](spark, FOLDER)
    assert tried == [classify.STRENGTHS] * len(tasks.ALPHAS) * len(tasks.ETAS)


def test_argmax_over_the_whole_array(spark):
    want = {r[0]: max(range(len(r[1])), key=lambda j: (r[1][j], -j)) for r in table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()}
    assert max(want.values()) > 9
    assert {r[0]: r[1] for r in QUERIES["argmax_class"](spark, FOLDER).collect()} == want


def test_projection_by_the_solved_mapping(spark):
    e = table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()
    X = np.array([r[1] for r in e], float)
    S, q = X.T @ X, 1 - queries_dense.NOISE
    Q = S * (q * q)
    np.fill_diagonal(Q, q * np.diag(S))
    H = np.tanh(X @ np.linalg.inv(Q + queries_dense.REG * np.eye(len(S))) @ (q * S))
    at = {r[0]: k for k, r in enumerate(e)}
    got = QUERIES["mda_project"](spark, FOLDER).collect()
    assert len(got) == H.size
    assert max(abs(r["h"] - H[at[r["doc_id"]], r["i"]]) for r in got) < 2e-6


def test_estimators_write_no_counts_and_have_the_features_of_texts(spark, monkeypatch):
    want = {r["doc_id"]: r for r in queries_dense.texts(spark, FOLDER).where("domain in ('books', 'dvd')").collect()}
    monkeypatch.setattr(queries_text.Corpus, "once", lambda self: pytest.fail("counts of all terms are written"))
    got = {r["doc_id"]: r for r in queries_dense.review_corpus(spark, FOLDER).all().collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert [r[c] for c in ("domain", "split", "label")] == [want[k][c] for c in ("domain", "split", "label")]
        assert dict(zip(r["js"], r["xs"])) == pytest.approx(dict(zip(want[k]["js"], want[k]["xs"])), rel=1e-12)
