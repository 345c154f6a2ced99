import pytest
from pyspark.sql import functions as F

from corpusloom.operators import features, vocabulary, weighting
from corpusloom.plans import tasks
from corpusloom.sources import newsgroups, reviews


def test_records_counts_and_empty_documents(spark):
    schema = "review_id long, domain string, split string, label int, features array<struct<ts string, tfreq int>>, token string"
    rows = [(1, "a", "labelled", 1, [("X ", 2), ("x", 1), (None, 3), (" ", 1), ("y", 0), ("z", None)], "c"), (2, "a", "labelled", 0, None, "c"), (3, "b", "unlabeled", -1, [], "c")]
    recs = reviews.records(spark.createDataFrame([*rows, rows[0]], schema))
    assert recs.count() == 3 and reviews.spine(recs).count() == 3
    assert [(r["doc_id"], r["token"], r["tf"]) for r in reviews.term_counts(recs).collect()] == [(1, "x", 3)]
    assert reviews.term_counts(recs.limit(0)).count() == 0
    assert features.labelled(recs).count() == 2 and features.has_labels(recs) and not features.has_labels(recs.where("doc_id = 3"))


def test_paths_and_sizes(spark):
    assert reviews.dataset_path("p", "dvd", "test") == "p/dvd/unlabeled.review"
    with pytest.raises(ValueError):
        reviews.dataset_path("p", "dvd", "huge")
    df = spark.createDataFrame([("positive.review",), ("unlabeled.review",)], "file_name string")
    assert [reviews.of_size(df, s).count() for s in ("small", "all", "test")] == [1, 2, 1]


def test_vocabulary_ties_and_bounds(spark):
    counts = spark.createDataFrame([(d, t, 1) for t, n in (("b", 3), ("a", 3), ("c", 2), ("d", 1), ("e", 9)) for d in range(n)], "doc_id long, token string, tf long")
    assert [(r["token"], r["wid"]) for r in vocabulary.by_frequency(counts, 10, 3).orderBy("wid").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert vocabulary.encode(counts, vocabulary.by_frequency(counts, 10, 1)).count() == 3
    with pytest.raises(ValueError):
        weighting.weigh(counts, counts, 9, 1, 1.0)


def test_news_tasks_and_clean_text(spark):
    posts = spark.createDataFrame([(1, "comp.graphics", "t"), (2, "sci.med", "u"), (3, "rec.autos", "v")], "doc_id long, category string, text string")
    got = {r["doc_id"]: (r["domain"], r["label"]) for r in newsgroups.labelled_posts(posts, 1).collect()}
    assert got == {1: ("target", 1), 2: ("source", 0)}
    with pytest.raises(ValueError):
        newsgroups.task(12)
    text = "From: x\nSubject: y\n\nIn article <1> z writes:\n> quoted\nHello there\nsecond line\n\n--\nme"
    assert spark.createDataFrame([(text,)], "t string").select(newsgroups.clean(F.col("t"))).first()[0] == "Hello there\nsecond line\n"


def test_jobs_results_and_ties(spark, tmp_path):
    assert tasks.Job.parse("12:0.9:2") == tasks.Job(12, 0.9, 2)
    scores = spark.createDataFrame([(1, 1.0, 2.0, 5.0), (1, 2.0, 1.0, 5.0), (1, 2.0, 3.0, 5.0), (1, 9.0, 9.0, None)], "task_id int, alpha double, eta double, score double")
    assert tuple(tasks.best_parameters(scores).first()) == (1, 2.0, 3.0, 5.0)
    (tmp_path / "12").write_text("81.5\n82.25\n")
    assert [tuple(r) for r in tasks.read_results(spark, str(tmp_path)).orderBy("line").collect()] == [("12", 0, 81.5), ("12", 1, 82.25)]
    tasks.write_corpus(spark.createDataFrame([("a", 1)], "domain string, x int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_earliest_delivery_counts(spark):
    rows = [(1, "a", "labelled", 1, [("x", 1)], "2020-01-02"), (1, "a", "labelled", 0, [("y", 1)], "2020-01-01"), (2, "b", None, None, None, None), (1, "a", "labelled", 1, [("z", 1)], None)]
    df = spark.createDataFrame(rows, "review_id long, domain string, split string, label int, features array<struct<ts string, tfreq int>>, at string")
    got = {r["doc_id"]: r for r in reviews.records(df.withColumn("loaded_at", F.col("at").cast("timestamp"))).collect()}
    assert got[1]["label"] == 0 and got[1]["features"][0]["ts"] == "y" and got[2]["domain"] == "b" and len(got) == 2


def test_raw_files_of_domains(spark, tmp_path):
    for domain, lines in (("dvd", ["a:1 b:2 a:3 #label#:positive", "broken #label#:negative", ""]), ("books", ["c:1 #label#:negative"])):
        (tmp_path / domain).mkdir()
        (tmp_path / domain / "labelled.review").write_text("\n".join(lines) + "\n")
    good, bad = reviews.read_files(spark, str(tmp_path), "dvd", "small")
    assert [r["label"] for r in good.collect()] == [1] and sorted(r["reason"] for r in bad.collect()) == ["empty", "entry"]
    recs = reviews.read_domains(spark, str(tmp_path), ("dvd", "books"), "small")
    assert recs.select("doc_id").distinct().count() == 2
    assert {(r["domain"], r["token"], r["tf"]) for r in reviews.term_counts(recs).collect()} == {("dvd", "a", 4), ("dvd", "b", 2), ("books", "c", 1)}


def test_labels_must_begin_at_zero(spark):
    docs = spark.createDataFrame([(1, 0), (2, 1), (3, -1), (4, None)], "doc_id long, label int")
    assert sorted(map(tuple, features.relabelled(docs).collect())) == [(1, -1), (2, 1)] and features.least_label(docs) == 0
    with pytest.raises(ValueError):
        features.relabelled(docs.where("doc_id = 2"))
    assert features.relabelled(docs.limit(0)).count() == 0


def test_news_tasks_by_name():
    assert [newsgroups.task_named(*x) for x in (("comp", "sci"), ("sci", "comp"), ("talk", "comp"))] == [0, 1, 11]
    with pytest.raises(ValueError):
        newsgroups.task_named("comp", "comp")


def test_scores_and_registry_are_written(spark, tmp_path):
    out = {"acc_mda": 0.8105, "acc_domreg": 0.8152, "tried": [(0.5, 1.0, 0.1), (0.7, 50.0, 1.0)]}
    tasks.write_scores(spark, str(tmp_path), 12, out, 5000, 2)
    got = tasks.read_results(spark, str(tmp_path / "scores/12/*.txt")).where("value IS NOT NULL").orderBy("line")
    assert [r["value"] for r in got.collect()] == [81.05, 81.52]
    rows = spark.read.parquet(str(tmp_path / "parameters/12")).orderBy("place").collect()
    assert [(r["score"], r["alpha"], r["eta"]) for r in rows] == out["tried"]
    tasks.write_registry(tasks.review_tasks(spark), str(tmp_path / "registry"))
    assert spark.read.parquet(str(tmp_path / "registry")).count() == 24
    jobs = tasks.job_results(spark, [{"task_id": 3, "noise": 0.5, "feat_type": 2, "base_accuracy": 0.5, "accuracy": 0.75, "auc": None}])
    assert jobs.first()["row"] == "3\t0.5\t2\t0.5\t0.75"


def test_bags_are_coded_where_they_stand(spark):
    schema = "review_id long, domain string, split string, label int, features array<struct<ts string, tfreq int>>"
    rows = [
        (1, "a", "labelled", 1, [("X ", 2), ("x", 1), (None, 3), (" ", 1), ("y", 0), ("z", None), ("\tÜ", 2), ("w", 5), None]),
        (2, "a", "labelled", 0, None),
        (3, "b", "unlabeled", None, []),
        (4, "b", "unlabeled", -1, [("w", 1)]),
        (5, "b", "unlabeled", -1, [("y", 4), ("x", 1), ("Y", 3)]),
    ]
    recs = reviews.records(spark.createDataFrame([*rows, rows[0]], schema))
    counts = reviews.term_counts(recs).select("doc_id", "token", "tf")
    voc = spark.createDataFrame([("x", 2, 7), ("ü", 1, 0), ("y", 1, 3)], "token string, df long, wid long")
    wanted = weighting.weigh(vocabulary.encode(counts, voc).withColumnRenamed("wid", "j"), voc.select(F.col("wid").alias("j"), "df"), 2, 5, 0.0)
    want = {(r["doc_id"], r["j"]): r["w"] for r in wanted.collect()}
    got = weighting.tfidf_rows(reviews.bags(recs), voc, 5).collect()
    assert {(r["doc_id"], r["domain"], r["split"], r["label"]) for r in got} == {r[:4] for r in rows} and len(got) == 5
    assert {(r["doc_id"], j): x for r in got for j, x in zip(r["js"], r["xs"])} == pytest.approx(want, rel=1e-12) and len(want) == 4
    assert [(r["js"], r["xs"]) for r in weighting.tfidf_rows(reviews.bags(recs), voc.limit(0), 5).collect()] == [([], [])] * 5
    assert weighting.tfidf_rows(reviews.bags(recs.limit(0)), voc, 5).count() == 0
