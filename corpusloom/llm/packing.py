"""Filling fixed-capacity containers with items: lexical retrieval packing.

Items are sized in tokens. Their words, hashed, form an inverted index with BM25 weights, sharded by lexical likeness: a consistent
sample of each item's words, weighted by rarity, is the key of a range partitioning, so alike items share a shard, shards have equal sizes and
a hot source or key spreads over as many as it fills. Within a shard, the largest unused item seeds a container;
its index returns unused neighbours by BM25 score, and the best that still fits enters, until little room is left,
which the largest item that fits takes.

Only an item above the capacity is split: its full parts are containers of their own, the rest is an item like others.

A shard's index is the only state of a task, bounded by ``shard_items`` whatever the size of a partition. Record counts
for BM25 come from a table of fixed size. Defined results: null and empty texts are items of size 0 and get a
container; equal rows are equal items; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.bags import BUCKETS, STEP, Batches, U, mix
from corpusloom.plans.partial import summed
from corpusloom.llm.tokens import RANKS, tokenizer
from corpusloom.llm.winnow import Words, pieces
from corpusloom.plans.session import cut

#: BM25's usual parameters.
K1, B = 1.2, 0.75
ITEM = "doc_id long, n_tokens long, terms array<int>, counts array<int>"


def measured(docs: DataFrame, tokens: str) -> DataFrame:
    """(doc_id, n_tokens, terms, counts): the size of each text and its words, hashed to 32 bits."""

    def emit(batches: Batches) -> Batches:
        encoder, split = tokenizer(tokens), Words()
        for batch in batches:
            for some in pieces(batch.column(1)):
                sizes = [encoder.count(t) if (t := x.as_py()) else 0 for x in batch.column(1)[some]]
                rows, words = split(batch.column(2)[some])
                code = (words >> U(32)).astype(np.uint32).view(np.int32)
                order = np.lexsort((code, rows))
                rows, code = rows[order], code[order]
                new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (code[1:] != code[:-1])][: len(rows)])
                counts = np.diff(np.r_[new, len(rows)]).astype(np.int32)
                offsets = pa.array(np.searchsorted(rows[new], np.arange(len(sizes) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (code[new], counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[some], pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n_tokens", "terms", "counts"])

    return docs.select("doc_id", "text", F.lower("text").alias("low")).mapInArrow(emit, ITEM)


class Index:
    """A BM25 index of one shard, from which items are taken."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, df: np.ndarray, n: int, mean: float) -> None:
        lengths = np.diff(starts)
        item = np.repeat(np.arange(len(sizes)), lengths)
        known = df[buckets(terms)]
        idf = np.log1p((n - known + 0.5) / (known + 0.5)).clip(0)
        words = np.bincount(item, counts, len(sizes))
        weight = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * words[item] / max(mean, 1e-9)))
        self.terms, self.own = np.unique(terms, return_inverse=True)
        order = np.argsort(self.own, kind="stable")
        self.posted, self.weight = item[order], weight[order].astype(np.float32)
        self.first = np.r_[0, np.cumsum(np.bincount(self.own, minlength=len(self.terms)))]
        self.starts, self.sizes = starts, sizes

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all items for the words of one."""
        t = self.own[self.starts[seed] : self.starts[seed + 1]]
        t = t[self.first[t + 1] - self.first[t] > 1]
        many = self.first[t + 1] - self.first[t]
        at = np.repeat(self.first[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(self.posted[at], self.weight[at], len(self.sizes))

    def containers(self, capacity: int) -> list[list[int]]:
        """Lists of items, the seed first."""
        free = np.ones(len(self.sizes), bool)
        out = []
        for seed in np.argsort(-self.sizes, kind="stable").tolist():
            if not free[seed]:
                continue
            free[seed] = False
            inside, room = [seed], capacity - int(self.sizes[seed])
            open_ = np.flatnonzero(free & (self.sizes <= room))
            score = self.scores(seed)[open_] if len(open_) else None
            while len(open_):
                # neighbours while there is room for several items, then the largest that fits, likest first
                best = int(np.argmax(score)) if room > capacity // 4 else int(np.lexsort((-score, -self.sizes[open_]))[0])
                taken = int(open_[best])
                free[taken] = False
                inside.append(taken)
                room -= int(self.sizes[taken])
                keep = self.sizes[open_] <= room
                keep[best] = False
                open_, score = open_[keep], score[keep]
            out.append(inside)
        return out


def buckets(terms: np.ndarray) -> np.ndarray:
    return (mix(terms.astype(np.int64).view(U)) % U(BUCKETS)).astype(np.intp)


def pack(docs: DataFrame, capacity: int = 4096, shard_items: int = 4096, tokens: str = RANKS) -> DataFrame:
    """(doc_id, part, n_tokens, container): the container of every document (doc_id, text), or of every part of one above the
    capacity. A container is named after its seed."""
    items = cut(measured(docs, tokens))

    def count(batches: Batches) -> np.ndarray:
        out = np.zeros(BUCKETS + 2, np.int64)
        for batch in batches:
            out[:BUCKETS] += np.bincount(buckets(batch.column(2).flatten().to_numpy()), minlength=BUCKETS)
            out[BUCKETS] += batch.num_rows
            out[BUCKETS + 1] += int(batch.column(3).flatten().to_numpy().sum())
        return out

    stats = summed(items, count, BUCKETS + 2, np.int64)
    n, mean = int(stats[BUCKETS]), float(stats[BUCKETS + 1]) / max(int(stats[BUCKETS]), 1)
    sent = docs.sparkSession.sparkContext.broadcast(stats[:BUCKETS].astype(np.int32))

    def keyed(batches: Batches) -> Batches:
        df = sent.value
        for batch in batches:
            terms = batch.column(2).flatten().to_numpy()
            starts = np.r_[0, np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]
            h = mix(terms.astype(np.int64).view(U) * U(STEP))
            # the least of exponential times whose rates are the words' rarities
            time = -np.log((h >> U(11)).astype(float) / 2.0**53 + 2.0**-54) / np.log1p(n / np.maximum(df[buckets(terms)], 1))
            key = np.zeros(batch.num_rows, np.int64)
            full = np.flatnonzero(np.diff(starts))
            if len(full):
                least = np.minimum.reduceat(time, starts[full])
                owner = np.repeat(np.arange(len(full)), np.diff(starts)[full])
                hit = np.flatnonzero(time == least[owner])
                key[full[owner[hit[::-1]]]] = h[hit[::-1]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", "doc_id", "n_tokens", "terms", "counts"])

    def shards(batches: Batches) -> Batches:
        waiting, rows = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, shard_items):
                part = batch.slice(low, shard_items)
                if rows and rows + part.num_rows > shard_items:
                    yield filled(waiting)
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows:
            yield filled(waiting)

    def filled(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, size = table.column(1).to_pylist(), table.column(2).to_numpy()
        terms, counts = (table.column(k).combine_chunks() for k in (3, 4))
        starts = np.r_[0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        full, rest = size // capacity, size % capacity
        whole = (full > 0) & (rest == 0)  # nothing is left of it
        index = Index(starts, terms.flatten().to_numpy(), counts.flatten().to_numpy(), rest, sent.value, n, mean)
        out = [(ids[k], part, capacity, f"{ids[k]}:{part}") for k in np.flatnonzero(full).tolist() for part in range(int(full[k]))]
        for inside in index.containers(capacity):
            inside = [k for k in inside if not whole[k]]
            out += [(ids[k], int(full[k]), int(rest[k]), f"{ids[inside[0]]}:{full[inside[0]]}") for k in inside]
        cols = list(zip(*out))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "part", "n_tokens", "container"])

    ordered = items.mapInArrow(keyed, f"key long, {ITEM}").repartitionByRange(max(1, ceil(n / shard_items)), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ordered.mapInArrow(shards, "doc_id long, part long, n_tokens long, container string")
