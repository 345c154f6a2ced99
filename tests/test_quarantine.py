from pyspark.sql import functions as F

from corpusloom.operators.quarantine import Rule, split_review_lines, split_rows, typed_rules

GOOD = "#label#:positive"


def reasons(spark, texts):
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line_id long, line_text string")
    _, bad = split_review_lines(lines)
    return {r["line_id"]: r["reason"] for r in bad.collect()}


def test_reasons_in_order(spark):
    cases = {
        None: "empty", "": "empty", " \t\r\n": "empty",
        f'a:1 b"c:2 {GOOD}': "quote", f'"a:1 {GOOD}': "quote", '"': "quote", f'""a:1 {GOOD}""': "quote",
        "a:1 b:2": "label", "a:1 #label#:neutral": "label", f"#label#:positive a:1 {GOOD}": "label", '""': "label", f"a:1 {GOOD}x": "label",
        f"a {GOOD}": "entry", f"a:1:2 {GOOD}": "entry", f":1 {GOOD}": "entry", f"a:1  b:2 {GOOD}": "entry", f" a:1 {GOOD}": "entry", f"a:x b {GOOD}": "entry",
        f"a: {GOOD}": "tfreq", f"a:x {GOOD}": "tfreq", f"a:0 {GOOD}": "tfreq", f"a:-1 {GOOD}": "tfreq", f"a:1.0 {GOOD}": "tfreq", f"a:2147483648 {GOOD}": "tfreq",
        f"a:+1 {GOOD}": "tfreq", f"a:99999999999999999999999 {GOOD}": "tfreq", f"a:٣ {GOOD}": "tfreq", f"a:1\t {GOOD}": "tfreq", f"a:000 {GOOD}": "tfreq",
    }
    found = reasons(spark, list(cases))
    assert [found.get(k) for k in range(len(cases))] == list(cases.values())


def test_loadable_lines(spark):
    texts = [GOOD, f"a:1 {GOOD}\r\n", f'"a:1 {GOOD} "', f"a:0007 b:2147483647 {GOOD}", f"a:{'0' * 60}5 {GOOD}", "a:1 #label#:negative \t", "é:1 " + GOOD]
    assert reasons(spark, texts) == {}
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line_id long, line_text string")
    records = {r["line_id"]: r for r in split_review_lines(lines)[0].collect()}
    assert records[0]["features"] == [] and records[0]["label"] == 1 and records[5]["label"] == 0
    assert [tuple(e) for e in records[3]["features"]] == [("a", 7), ("b", 2147483647)]
    assert [tuple(e) for e in records[4]["features"]] == [("a", 5)]


def test_long_line_empty_table_repeats_and_clashing_names(spark):
    long = " ".join(f"w{k}:{k + 1}" for k in range(200_000))
    assert reasons(spark, [f"{long} {GOOD}", f"{long} bad {GOOD}"]) == {1: "entry"}
    empty = spark.createDataFrame([], "line_id long, line_text string")
    assert [x.count() for x in split_review_lines(empty)] == [0, 0]
    twice = spark.createDataFrame([(1, "x"), (1, "x")], "line_id long, line_text string")
    assert split_review_lines(twice)[1].count() == 2
    other = spark.createDataFrame([(1, "a:1 " + GOOD, "mine", "own")], "line_id long, line_text string, reason string, fields string")
    assert split_review_lines(other)[0].columns == ["line_id", "fields", "features", "label"]


def test_typed_rules(spark):
    df = spark.createDataFrame([("1", "2020-01-01"), ("x", "2020-01-01"), (None, "never")], "a string, b string")
    good, bad = split_rows(df, typed_rules({"a": "int", "b": "date"}, required=["a"]))
    assert [tuple(r) for r in good.collect()] == [("1", "2020-01-01")]
    assert [r["_q_errors"] for r in bad.orderBy(F.col("a").desc()).collect()] == [["cast:a"], ["null:a", "cast:b"]]
    assert split_rows(df, [])[0].count() == 3 and split_rows(df, [Rule("none", F.lit(None).cast("boolean"))])[1].count() == 0
