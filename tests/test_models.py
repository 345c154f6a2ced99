import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metrics
from corpusloom.operators import estimators
from corpusloom.operators.classify import STRENGTHS, TOLERANCE, cross_validated
from corpusloom.operators.moments import dense_rows

RNG = np.random.default_rng(3)


def corpus(spark, classes=2, n=160, d=5):
    y = RNG.integers(0, classes, size=n)
    x = RNG.normal(size=(n, d))
    x[np.arange(n), y] += 4
    df = spark.createDataFrame([(k, int(y[k]), [float(v) for v in x[k]]) for k in range(n)], "doc_id long, label int, v array<double>")
    rows = dense_rows(df, "v").drop("v").cache()
    return estimators.Corpus(rows.where("doc_id < 80"), rows.where("doc_id >= 80"), d), x, y


@pytest.mark.parametrize("most_local", [0, 10**9])
def test_gradients_end_where_the_optimum_is(spark, most_local):
    c, x, y = corpus(spark)
    xs, ys = np.c_[x[:80], np.ones(80)], y[:80]
    for strength in (1e-4, 0.5, 10.0):
        model, best, score = cross_validated(c.source, c.d, 2, (strength,), most_local=most_local)
        w = model.weights[0]
        at = lambda w: strength * xs.T @ (1 / (1 + np.exp(-xs @ w)) - ys) + w  # noqa: E731, B023
        assert np.linalg.norm(at(w)) <= 1.001 * TOLERANCE * np.linalg.norm(at(0 * w))
        assert best == strength and 0 <= score <= 1


@pytest.mark.parametrize("classes", [2, 4])
def test_both_plans_fit_the_same_models(spark, classes):
    c, _, _ = corpus(spark, classes)
    one, two = (cross_validated(c.source, c.d, 3, (1e-3, 1.0), most_local=k) for k in (0, 10**9))
    assert one[0].classes == two[0].classes == list(range(classes)) and one[1:] == two[1:]
    assert np.allclose(one[0].weights, two[0].weights, atol=1e-3)


@pytest.mark.parametrize("most_local", [0, 10**9])
def test_default_grid_at_5000_features(spark, most_local):
    rng, rows = np.random.default_rng(5), []
    for k in range(60):
        js = rng.choice(5000, 40, replace=False)
        rows.append((k, k % 2, [int(j) for j in [*js, 5000 - 1 - k % 2]], [1.0] * 41))
    rows = [(k, y, list(dict.fromkeys(js)), [1.0] * len(set(js))) for k, y, js, _ in rows]
    model, strength, score = cross_validated(spark.createDataFrame(rows, "doc_id long, label int, js array<bigint>, xs array<double>"), 5000, most_local=most_local)
    assert model.weights.shape == (1, 5001) and strength in STRENGTHS and score > 0.9


def test_labelled_target_rows_join_the_training(spark):
    c, _, _ = corpus(spark)
    both = estimators.Corpus(c.source, c.target, c.d, semi_supervised=True)
    assert both.n_training() == 160 and c.n_training() == 80
    fitted = estimators.DomainAdapter(both, 0.3, (1.0,), (0.01,), cv=2, strengths=(1.0,)).fit()
    assert fitted.score(c.target) > 0.9
    none = estimators.Corpus(c.source, c.target.withColumn("label", F.lit(None).cast("int")), c.d, semi_supervised=True)
    assert none.n_training() == 80


@pytest.mark.parametrize("classes", [2, 3])
def test_held_out_accuracy(spark, classes):
    c, _, _ = corpus(spark, classes)
    few = {"cv": 2, "strengths": (0.1, 1.0)}
    for fitted in (estimators.Adapter(c, **few), estimators.MdaAdapter(c, noise=0.3, outputs=4, **few), estimators.LatentAdapter(c, 3, True, **few), estimators.DomainAdapter(c, 0.3, (1.0,), (0.01,), **few)):
        assert fitted.fit().score(c.target) > 0.8
    t = estimators.transductive(c, 0.3, 2, (1.0,), self_learning=True)
    assert t.base_accuracy > 0.8 and t.accuracy > 0.5 and t.self_accuracy > 0.8


def test_errors_and_missing_labels(spark):
    c, _, _ = corpus(spark)
    with pytest.raises(ValueError):
        estimators.Adapter(c).predict(c.target)
    with pytest.raises(ValueError):
        cross_validated(c.source.where("label = 1"), c.d)
    assert c.has_target_labels() and not estimators.Corpus(c.source, c.target.withColumn("label", F.lit(-1)), c.d).has_target_labels()
    with pytest.raises(ValueError):
        estimators.transductive_scores(c.target, c.d, 2, hard=True)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert metrics.roc_auc(df).first()[0] == pytest.approx(0.875)
    assert metrics.roc_auc(df.where("label = 1")).first()[0] is None


def test_news_task_and_job(spark):
    from corpusloom.plans import experiments

    words = {"comp.graphics": "pixel image render", "sci.crypt": "doctor patient dose", "comp.windows.x": "pixel window render", "sci.space": "orbit patient dose"}
    posts = [(k, c, f"Subject: s\n\n{t} {'extra' if k % 2 else 'other'}") for k, (c, t) in enumerate(list(words.items()) * 6)]
    task = experiments.news_task(spark.createDataFrame(posts, "doc_id long, category string, text string"), 0, words=20)
    assert estimators.Adapter(task.corpus, 2, (1.0, 10.0)).fit().score(task.corpus.target) == 1.0
    out = experiments.benchmark(task, 0.3, (1.0,), (0.01,), cv=2, strengths=(1.0, 10.0))
    assert out["acc_mda"] > 0.9 and len(out["tried"]) == 1
    for own in (False, True):
        out = experiments.news_job("0:0.3:2", spark.createDataFrame(posts, "doc_id long, category string, text string"), 20, own, cv=2, strengths=(1.0, 10.0))
        assert out["base_accuracy"] == 1.0 and 0 <= out["accuracy"] <= 1
    base, adapted = experiments.with_baseline(estimators.MdaAdapter(task.corpus, 0.3, cv=2, strengths=(1.0, 10.0)))
    assert base == 1.0 and adapted > 0.9
    rows = [(k, d, "labelled", k % 2, [("good" if k % 2 else "bad", 1), (f"{d}{k % 3}", 2)]) for d in ("a", "b") for k in range(100 * (d == "b"), 100 * (d == "b") + 40)]
    table = spark.createDataFrame(rows, "review_id long, domain string, split string, label int, features array<struct<ts string, tfreq int>>")
    jobs = spark.createDataFrame([(3, "a", "b", "small")], "task_id int, source_domain string, target_domain string, size string")
    for own in (False, True):
        out = experiments.transductive_job("3:0.3:2", table, jobs, 10, own, cv=2, strengths=(1.0,))
        assert out["base_accuracy"] == 1.0 and out["accuracy"] > 0.9
    with pytest.raises(ValueError):
        experiments.transductive_job("4:0.3:2", table, jobs)


def test_stack_reconstructs_the_listed_outputs_first(spark):
    from corpusloom.operators import denoise

    c, _, _ = corpus(spark)
    outs, maps = denoise.stack(c.all().select("doc_id", "js", "xs"), c.d, 3, 0.5, outputs=np.array([0, 2]))
    assert [w.shape for w in maps] == [(2, 6), (2, 3), (2, 3)] and len(outs[-1].first()["xs"]) == 2
