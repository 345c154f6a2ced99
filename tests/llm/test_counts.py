"""Term counts and heavy hitters."""

import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import heavy, termcounts
from corpusloom.llm.bags import U, mix

SCHEMA = "review_id long, pos int, ts string, tfreq int, t string, n_total int"


def tokens(seed, n=3000):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        t = rng.choice(["the", "The ", "\tthe"]) if rng.random() < 0.34 else f"t{int(rng.paretovariate(0.6)) % 900}"
        rows.append((rng.choice([7, k // 20]), k, rng.choice([t, t, t, None, " "]), rng.choice([1, 1, 2, 0, None, -3]), "x", 1))
    return rows + rows[:200] + [(None, 1, "a", 1, "x", 1), (5, None, "b", 2, "x", 1), (5, None, "b", 2, "x", 1), (5, None, "c", 1, "x", 1), (6, 1, "w" * 300_000, 1, "x", 1)]


@pytest.mark.parametrize("places", [1 << 16, 200])
def test_counts_against_brute_force(spark, monkeypatch, places):
    monkeypatch.setattr(termcounts, "PLACES", places)  # beyond it, records are spread
    rows = tokens(1)
    rows += [(7, 40, "again", 1, "x", 1), (3, -5, "before", 2, "x", 1), (3, -5, "AFTER", 2, "x", 1), (3, -5, "after", 1, "x", 1)]
    total, records, valid = Counter(), {}, set()
    for r, p, t, f in {x[:4] for x in rows}:
        t = (t or "").lower().strip(" \t")
        if r is not None and t and f and f >= 1:
            valid.add((r, p, t, f))
    once = {}
    for r, p, t, f in sorted(valid, key=lambda x: x[2:]):
        once.setdefault((r, p) if p is not None else (r, p, t, f), (r, t, f))
    for r, t, f in once.values():
        total[t] += f
        records.setdefault(t, set()).add(r)
    want = {t: (total[t], len(records[t])) for t in total}
    for most in (1_000_000, 1):
        got = termcounts.term_frequencies(spark.createDataFrame(rows, SCHEMA).repartition(5), most).collect()
        assert len(got) == len(want) and {r["ts"]: (r["n_total"], r["n_records"]) for r in got} == want


def test_counters_over_chunks(monkeypatch):
    import pyarrow as pa

    c, rng = termcounts.Counters(), random.Random(2)
    rows = sorted((rng.randrange(50), rng.choice("abcdefg")) for _ in range(900))
    for low in range(0, 900, 37):
        part = rows[low : low + 37]
        c.add(pa.array([t for _, t in part]), np.array([r for r, _ in part]), np.ones(len(part), np.int64))
    got = {r["ts"]: (r["n_total"], r["n_records"]) for r in c.rows().to_pylist()}
    assert got == {t: (sum(x == t for _, x in rows), len({r for r, x in rows if x == t})) for t in "abcdefg"}


def test_marks_and_empty_table(spark):
    df = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 9, 3)], "ts string, n_total long, n_records long")
    assert {r["ts"]: r["mark"] for r in termcounts.marked(df, 4).collect()} == {"a": "rare", "b": None, "c": "common"}
    empty = spark.createDataFrame([], SCHEMA)
    assert termcounts.term_frequencies(empty).count() == 0
    assert heavy.heavy_hitters(empty, "ts", 0.01).count() == 0


def test_heavy_hitters_against_brute_force(spark):
    rows = tokens(3)
    count = Counter((r[2] or "").lower().strip(" \t") for r in rows)
    count.pop("", None)
    for share in (0.3, 0.01, 1 / 500):
        got = {r["ts"]: r["n_rows"] for r in heavy.heavy_hitters(spark.createDataFrame(rows, SCHEMA).repartition(3), "ts", share).collect()}
        assert got == {t: n for t, n in count.items() if n >= share * len(rows)}


def test_sketch_adds_up_and_estimates():
    rng, share = np.random.default_rng(1), 0.002
    h = mix(np.minimum(rng.pareto(0.8, 200_000), 1e6).astype(np.int64).astype(U))
    one, two, both = heavy.Sketch(share), heavy.Sketch(share), heavy.Sketch(share)
    one.add(h[:90_000])
    two.add(h[90_000:])
    both.add(h)
    assert np.array_equal(one.cells + two.cells, both.cells)
    keys, n = np.unique(h, return_counts=True)
    found = both.heavy(share * len(h))
    true = {int(k >> U(64 - both.bits[-1])): int(c) for k, c in zip(keys, n) if c >= share * len(h)}
    assert set(true) <= set(found) and all(abs(found[k] - c) < 0.5 * share * len(h) for k, c in true.items())


def test_sketch_follows_the_share():
    small, large = heavy.Sketch(0.01), heavy.Sketch(1e-4)
    assert large.width >= 32 / 1e-4 and small.width < large.width and small.exact < large.exact
    for share in (0.0, 1.5, 1e-7):
        with pytest.raises(ValueError):
            heavy.Sketch(share)
    noise = heavy.Sketch(0.5)
    noise.add(mix(np.arange(1, 300_000, dtype=U)))
    with pytest.raises(ArithmeticError):
        noise.heavy(1.0)


def test_small_shares_of_many_distinct_values(spark):
    """Terms of 1/100,000 of the rows, beside a term of a third of them and five million others."""
    from pyspark.sql import functions as F

    n, share = 9_000_000, 1e-5
    k = F.col("id")
    ts = F.when(k % 3 == 0, F.lit("hot")).when(k % 9000 == 1, F.concat(F.lit("h"), (F.col("id") / 9000).cast("int") % 10)).otherwise(F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(5_000_000))))
    df = spark.range(0, n, 1, 2).select(ts.alias("ts"))
    want = {(r["ts"], r["n"]) for r in df.groupBy("ts").agg(F.count("*").alias("n")).where(F.col("n") >= share * n).collect()}
    assert ("hot", n // 3) in want and len(want) >= 11
    got = heavy.heavy_hitters(df, "ts", share).collect()
    assert {(r["ts"], r["n_rows"]) for r in got} == want and all(abs(r["estimate"] - r["n_rows"]) <= share * n / 2 for r in got)
