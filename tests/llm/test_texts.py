"""Leaks, packing and splitting of texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import packing, splitting, winnow
from corpusloom.llm.tokens import RANKS, tokenizer

SCHEMA = "doc_id long, text string, key string, piece long, words string"


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def leak_case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "Ü1", "A-b"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([5, 19, 20, 25, 60]))) for k in range(15)] + [(90, None), (91, ""), (92, "same " * 30)]
    docs = []
    for k in range(60):
        w = text(rng.choice([0, 10, 40, 200])).split(" ")
        own = (rng.choice(items)[1] or "x").split(" ")
        n = rng.choice([0, 18, 19, 20, 21, 40])
        low = rng.randrange(max(1, len(own) - n))
        at = rng.randrange(len(w) + 1)
        docs.append((k, rng.choice([" ", "\n+ ", "; "]).join(w[:at] + own[low : low + n] + w[at:]), "k", 1, "w"))
    return docs + [(100, None, "k", 1, "w"), (101, "", "k", 1, "w"), (102, "same " * 25, "k", 1, "w"), docs[0]], items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("most", [500_000, 0])
def test_leaks_against_brute_force(spark, seed, most):
    docs, items = leak_case(seed)
    grams = lambda t: {tuple(words(t)[k : k + 20]) for k in range(len(words(t)) - 19)}
    want = {(d[0], i) for d in docs for i, t in items if grams(d[1]) & grams(t)}
    got = [tuple(r) for r in winnow.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, item_text string"), most_broadcast=most).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_leaks_of_nothing(spark):
    docs, items = leak_case(0)
    no_docs, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, item_text string")
    assert winnow.leaks(spark.createDataFrame(docs, SCHEMA), no_items).count() == 0
    assert winnow.leaks(no_docs, spark.createDataFrame(items, "item_id long, item_text string")).count() == 0


def test_words_across_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["ab cd", None, "", "e" * 50, "f-g", "tail", "x" * 7 + " é y"]
    want = [(k, w) for k, t in enumerate(texts) for w in words(t)]
    seen = []
    for piece in (1 << 20, 16, 5):
        monkeypatch.setattr(winnow, "PIECE", piece)
        rows, h = winnow.Words()(pa.array(texts))
        assert rows.tolist() == [k for k, _ in want]
        seen.append(h.tolist())
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0])) == len({w for _, w in want})


def documents():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "short", "x" * 3000, line(9000), "日本語" * 3000, "\n" * 9000, line(30) * 0 + "a b\r\n" * 5000]
    for _ in range(25):
        files = []
        for _ in range(rng.randint(1, 6)):
            hunks = "".join(f"@@ -{k} +{k} @@\n" + "".join(f"+    {line(rng.randint(1, 12))}\n" for _ in range(rng.randint(1, 60))) for k in range(rng.randint(1, 5)))
            files.append(f"diff --git a/{word()} b/{word()}\n{hunks}")
        texts.append(f"commit\n\n    {line(20)}\n\n    {line(9)}\n\n" + "".join(files))
    return [(k, t, "k", 7, "w") for k, t in enumerate(texts)]


def test_pieces(spark):
    docs, limit, overlap = documents(), 512, 64
    count = tokenizer(RANKS)
    rows = splitting.split_documents(spark.createDataFrame([*docs, docs[9]], SCHEMA).coalesce(1), limit, overlap).distinct().collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {d[0] for d in docs if d[1] and count.count(d[1]) > limit}
    for k, pieces in by.items():
        text, ends = docs[k][1].encode(), np.r_[0, count.ends(docs[k][1])]
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            begin = at - p["overlap"]
            assert p["text"].encode() == text[ends[begin] : ends[begin + p["n_tokens"]]]
            assert p["n_tokens"] <= limit and (not p["piece"] or overlap <= p["overlap"] <= overlap + 8)
            assert count.count(p["text"]) <= limit
            at = begin + p["n_tokens"]
        assert at == len(ends) - 1 and pieces[-1]["cut"] == "end"
        if k > 8:
            assert "token" not in {p["cut"] for p in pieces}


def test_pieces_fit_when_tokenized_alone(spark):
    """Texts whose pieces are parted within words, runs of blanks and letters of other scripts."""
    rng, limit = random.Random(9), 256
    texts = ["x" * 9000, " " * 9000, "\n \t" * 4000, "-" * 9000, "ab1" * 4000, "日本語" * 4000, "\u2003\n" * 3000, "\U0001f600" * 3000, "".join(chr(rng.randrange(33, 0x2000)) for _ in range(6000)), "a\n" + " " * 40 + "b\n" * 3000]
    count = tokenizer(RANKS)
    for reserve in (0, 16):
        rows = splitting.split_documents(spark.createDataFrame([(k, t, "k", 1, "w") for k, t in enumerate(texts)], SCHEMA), limit, 16, reserve or 1).collect()
        assert rows and max(count.count(r["text"]) for r in rows) <= limit


def test_plain_cuts():
    assert splitting.plain_cut(b"a\nb", 2, 8) and splitting.plain_cut(b"a\n   b", 2, 8) and splitting.plain_cut(b"ab", 0, 8)
    assert not splitting.plain_cut(b"ab", 1, 8) and not splitting.plain_cut(b"a\n" + b" " * 20 + b"b", 2, 8) and not splitting.plain_cut("a\n\u2003b".encode(), 2, 8)


def test_doubling_finds_the_cuts_that_follow_one_another():
    rng = np.random.default_rng(2)
    after = np.minimum(np.arange(200) + rng.integers(1, 9, 200), 199)
    want, at = [0], 0
    while at != 199:
        at = int(after[at])
        want.append(at)
    assert splitting.cuts(after, np.array([0])).tolist() == want
    with pytest.raises(ValueError):
        splitting.split_documents(None, 100, 50)


@pytest.mark.parametrize("shard", [7, 4096])
def test_containers(spark, shard):
    docs, capacity = documents(), 1000
    count = tokenizer(RANKS)
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA), capacity, shard).collect()
    sizes = {d[0]: count.count(d[1] or "") for d in docs}
    placed = Counter()
    parts = {}
    for r in rows:
        placed[r["container"]] += r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part"], r["n_tokens"]))
    assert max(placed.values()) <= capacity
    assert {k: sum(n for _, n in v) for k, v in parts.items()} == sizes
    for k, v in parts.items():
        assert sorted(p for p, _ in v) == list(range(len(v))) and (len(v) == 1 if sizes[k] <= capacity else len(v) == -(-sizes[k] // capacity))
    if shard > 100:
        assert len(placed) <= 1 + -(-sum(sizes.values()) // capacity)


def test_containers_of_a_corpus_are_full(spark):
    folder = "/root/testdata/sf0.01"
    rows = packing.pack(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert sum(r["n_tokens"] for r in rows) >= 0.97 * 4096 * len({r["container"] for r in rows})


def test_packing_keeps_likes_together(spark):
    docs = [(k, " ".join(f"g{k % 4}w{(k * 7 + j) % 30}" for j in range(40)), "k", 1, "w") for k in range(40)]
    size = max(tokenizer(RANKS).count(d[1]) for d in docs)
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA), size * 5).collect()
    boxes = {}
    for r in rows:
        boxes.setdefault(r["container"], set()).add(r["doc_id"] % 4)
    assert sum(len(b) for b in boxes.values()) <= len(boxes) + 2
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
