"""Pair operators against brute force over small tables with every kind of dirt."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import automata, bags, icws

SCHEMA = "review_id long, split string, domain string, features array<struct<ts string, tfreq int>>, terms string"


def corpus(seed, n=120):
    rng = random.Random(seed)
    rows, words = [], [f"w{k}" for k in range(400)]
    for k in range(n):
        if rows and rng.random() < 0.6:
            own = list(rng.choice(rows)[3] or [])
            for _ in range(rng.randint(0, 4)):
                if own and rng.random() < 0.5:
                    own.pop(rng.randrange(len(own)))
                else:
                    own.append((rng.choice(words), rng.randint(1, 3)))
            rng.shuffle(own)
        else:
            own = [(rng.choice(words[: rng.choice([20, 400])]), rng.randint(1, 4)) for _ in range(rng.choice([1, 2, 3, 8, 30, 60, 200]))]
        own = [(rng.choice([t, t, t.upper(), f" {t}\t"]) if t else t, f) for t, f in own]
        rows.append((k, rng.choice(["labelled", "unlabeled"]), rng.choice(["books", None]), own, "extra"))
    rows += [(n, "labelled", "x", None, None), (n + 1, "unlabeled", "x", [], None), (n + 2, None, "x", rows[3][3], None), (n + 3, "labelled", "x", [(None, 1), (" \t", 2), ("a", 0), ("b", None), ("c", -1)], None)]
    return rows + [rows[0], rows[5]]


def bag(features):
    out = Counter()
    for t, f in features or []:
        t = (t or "").lower().strip(" \t")
        if t and f and f >= 1:
            out[t] += f
    return out


def brute(rows, weighted, threshold):
    each = {r[0]: (r[1], bag(r[3])) for r in rows}
    out = set()
    for a in each:
        for b in each:
            x, y = each[a][1], each[b][1]
            if a >= b or not x or not y:
                continue
            if weighted:
                sim = sum((x & y).values()) / sum((x | y).values())
            else:
                if {each[a][0], each[b][0]} != {"labelled", "unlabeled"}:
                    continue
                sim = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
            if sim >= threshold:
                out.add((a, b))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("per_shard", [60, 2_000_000])
def test_overlaps_are_complete(spark, seed, per_shard):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    members, links = automata.overlaps(df, passages_per_shard=per_shard)
    found = [tuple(r) for r in automata.record_overlaps(members, links).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, False, 0.8)
    counts = {(r["split"], r["domain"]): (r["n_records"], r["n_overlapping"]) for r in automata.overlap_counts(members, links).collect()}
    touched, each = {x for p in found for x in p}, {r[0]: r for r in rows}
    want = defaultdict(lambda: [0, 0])
    for k, r in each.items():
        if bag(r[3]) and r[1]:
            want[r[1], r[2]][0] += 1
            want[r[1], r[2]][1] += k in touched
    assert counts == {k: tuple(v) for k, v in want.items()}


def test_a_passage_of_many_records_is_dealt_over_shards(spark):
    """A third of all records share a stock of terms: no shard gets them all, and no pair is lost."""
    from pyspark.sql import functions as F

    rng, stock = random.Random(8), [(f"s{k}", 1) for k in range(30)]
    rows = []
    for k in range(240):
        own = [(f"u{k}-{j}", 1) for j in range(rng.choice([1, 2, 3, 9]))]
        rows.append((k, "labelled" if k % 2 else "unlabeled", "x", (stock if k % 3 == 0 else []) + own, None))
    df = spark.createDataFrame(rows, SCHEMA)
    members, links = automata.overlaps(df, passages_per_shard=80)
    assert {tuple(r) for r in automata.record_overlaps(members, links).collect()} == brute(rows, False, 0.8)
    bags_ = bags.hashed(df, F.col("review_id").alias("id"), "split", "domain")
    classes = []
    for per_shard in (80, 10**9):
        parts, shards = automata.fragments(bags_, "unlabeled", 0.8, per_shard)
        classes.append(max(r[1] for r in parts.groupBy("shard").agg(F.count_distinct("class")).collect()))
    assert classes[0] < 0.7 * classes[1]


@pytest.mark.parametrize("seed", range(2))
def test_coverage_merges_all_training_records(spark, seed):
    rows = corpus(seed + 20)
    got = {r["review_id"]: (r["n_terms"], r["n_covered"]) for r in automata.coverage(*automata.overlaps(spark.createDataFrame(rows, SCHEMA), cover=True)).collect()}
    each, want = {r[0]: (r[1], bag(r[3])) for r in rows}, defaultdict(set)
    for a, b in brute(rows, False, 0.8):
        one, two = (a, b) if each[a][0] == "unlabeled" else (b, a)
        want[one] |= each[one][1].keys() & each[two][1].keys()
    assert got == {k: (len(each[k][1]), len(v)) for k, v in want.items()} and got


@pytest.mark.parametrize("threshold", [0.7, 0.75, 0.95])
def test_other_thresholds(spark, threshold):
    rows = corpus(11)
    members, links = automata.overlaps(spark.createDataFrame(rows, SCHEMA), threshold=threshold)
    assert {tuple(r) for r in automata.record_overlaps(members, links).collect()} == brute(rows, False, threshold)


def test_overlap_thresholds_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        automata.overlaps(empty, threshold=0.6)
    members, links = automata.overlaps(empty)
    assert automata.record_overlaps(members, links).count() == 0 and automata.overlap_counts(members, links).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    members, links = icws.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.7)
    found = [tuple(r) for r in icws.record_pairs(members, links).collect()]
    want = brute(rows, True, 0.7)
    assert len(found) == len(set(found)) and set(found) <= want
    assert len(set(found) & want) >= 0.98 * len(want)
    assert members.count() == len({r[0] for r in rows if bag(r[3])})


def test_classes_say_the_same_as_pairs(spark):
    rows = corpus(4)
    members, links = icws.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.7)
    got = {r["review_id"]: r for r in icws.record_classes(members, links).collect()}
    pairs, each = brute(rows, True, 0.7), {r[0]: bag(r[3]) for r in rows}
    groups = defaultdict(list)
    for k, x in each.items():
        if x:
            groups[frozenset(x.items())].append(k)
    assert got.keys() == {k for k, x in each.items() if x}
    for ks in groups.values():
        linked = {frozenset(each[b if a == ks[0] else a].items()) for a, b in pairs if ks[0] in (a, b)} - {frozenset(each[ks[0]].items())}
        for k in ks:
            assert (got[k]["class_id"], got[k]["n_copies"], got[k]["n_links"]) == (min(ks), len(ks), len(linked))


@pytest.mark.parametrize("pool", [60, 200])
@pytest.mark.parametrize("own", [4, 6])
def test_edits_of_rare_terms(spark, pool, own):
    """Pairs that share common terms and differ in terms that no other record has."""
    rng, rows = random.Random(pool + own), []
    for k in range(1500):
        shared = rng.sample(range(pool), 30)
        for side in (0, 1):
            terms = [(f"c{t}", 1) for t in shared] + [(f"r{k}-{side}-{j}", 1) for j in range(own)]
            rows.append((2 * k + side, rng.choice(["labelled", "unlabeled"]), "x", terms, None))
    members, links = icws.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.7)
    found = {tuple(r) for r in icws.record_pairs(members, links).collect()}
    assert sum((2 * k, 2 * k + 1) in found for k in range(1500)) >= 0.99 * 1500


def test_settings_follow_from_the_threshold():
    counts = np.r_[np.full(50, 500.0), np.ones(5000)]
    for threshold in (0.5, 0.7, 0.8, 0.95):
        bands, rows = icws.settings(counts, 1000, threshold, 1e-3)
        least = threshold / (threshold + (1 - threshold) * icws.SPREAD)
        assert (1 - least**rows) ** bands <= 1e-3
    assert icws.settings(np.r_[np.full(50, 5e8), np.ones(5000)], 10**9, 0.7, 1e-3)[1] > icws.settings(counts, 1000, 0.7, 1e-3)[1]
    weights = icws.damped(np.array([1.0, 10.0, 1000.0]), 1000)
    assert weights[0] == pytest.approx(icws.SPREAD, abs=1e-3) and weights[2] == 1 and weights[0] > weights[1] > weights[2]


def test_tiles_find_what_single_comparisons_find():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    n = 700
    pick = rng.integers(0, 40, n)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 4)).astype(np.uint64)
    words = base[pick] ^ flips
    weight = np.sort(rng.integers(60, 150, n))
    cols = (np.arange(n), weight, *(words[:, k].copy() for k in range(4)))
    a, b = np.triu_indices(n, 1)
    good = icws.near(tuple(c[a] for c in cols), tuple(c[b] for c in cols), 0.7)
    want = set(zip(a[good].tolist(), b[good].tolist()))
    got = [p for x in icws.tiled(cols, None, 0.7) for p in zip(x[0].tolist(), x[1].tolist())]
    assert len(got) == len(want) and set(got) == want
    one, two = tuple(c[::2] for c in cols), tuple(c[1::2] for c in cols)
    apart = {tuple(sorted(p)) for x in icws.tiled(one, two, 0.7) for p in zip(x[0].tolist(), x[1].tolist())}
    assert apart == {p for p in want if p[0] % 2 != p[1] % 2}


def test_near_duplicates_of_nothing(spark):
    members, links = icws.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert icws.record_pairs(members, links).count() == 0


def test_large_buckets_give_the_same_pairs(spark):
    from pyspark.sql import functions as F

    df = bags.hashed(spark.createDataFrame(corpus(5), SCHEMA), F.col("review_id").alias("id"), "split", "domain")
    banded = icws.band_rows(df, 0.7, 1e-3, (8, 1))
    want = {tuple(r) for r in icws.candidates(banded, 0.7).collect()}
    for hot in (1, 3, 20):
        got = [tuple(r) for r in icws.candidates(banded, 0.7, hot).collect()]
        assert len(got) == len(want) and set(got) == want


def test_samples_collide_as_often_as_weights_agree():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 40, dtype=np.uint64)
    w = rng.integers(1, 5, 40).astype(float)
    other = w.copy()
    other[:12] += 3
    code = icws.Sampler(4000).codes(np.array([0, 40]), np.r_[h, h], np.log(np.r_[w, other]).astype(np.float32))
    assert abs((code[0] == code[1]).mean() - np.minimum(w, other).sum() / np.maximum(w, other).sum()) < 0.03


def test_blank_hash_is_the_one_of_the_session(spark):
    assert spark.sql("SELECT xxhash64('')").first()[0] == bags.BLANK
