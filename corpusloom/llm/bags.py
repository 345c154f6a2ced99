"""Bags of records as hashed terms: shared parts of the pair operators.

A record's bag gives each term the sum of its frequencies. Terms are hashed in the JVM (xxhash64 of the normalised
term); sorting and merging a batch of records is vectorised over Arrow buffers. Two records with equal bags share a
*class id* (a 64-bit hash of the bag), under which exact copies travel once; a class id stands for different bags
with a probability of about n*n / 4e19 for n different bags.

Statistics about terms are kept in a table of fixed size (``BUCKETS`` hashed counters over all records), so what is
broadcast does not grow with the data: 1 MB. Terms that share a counter only shift an order or a weight, never a result.

Nulls: null or empty ``features``, null or blank terms, null or non-positive frequencies leave a record without
terms; such a record is in no class and no pair. Deliveries of one record fall into one class and count once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.terms import term
from corpusloom.plans.partial import Batches, summed
from corpusloom.plans.session import cut

#: The JVM's xxhash64 (seed 42) of the empty string, and odd multipliers for mixing (splitmix64).
BLANK = -7444071767201028348
MIX_A, MIX_B, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15

BUCKETS = 1 << 20
#: Bits of the table that says which classes take part in a candidate pair (1 MB).
MARKS = 1 << 23
#: Class ids that a task remembers in order not to send copies again; a bound on memory, beyond it copies are merged later.
REMEMBERED = 1 << 19

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits of x."""
    x = (x ^ (x >> U(30))) * U(MIX_A)
    x = (x ^ (x >> U(27))) * U(MIX_B)
    return x ^ (x >> U(31))


def hashed(records: DataFrame, *keep: str | Column) -> DataFrame:
    """``keep`` columns, then ``hs``, the hashed terms of ``features``, and ``fs``, their frequencies."""
    hs = F.transform("features", lambda e: F.xxhash64(term(F.coalesce(e["ts"], F.lit("")))))
    return records.select(*keep, hs.alias("hs"), F.col("features.tfreq").alias("fs"))


def merged(batch: pa.RecordBatch, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, hashes, frequencies): the bags of a batch's records that have terms, one after the other.

    Bag k belongs to row ``rows[k]`` and begins at ``starts[k]``. Its terms are ordered by hash, or first by
    ``rank[hash % BUCKETS]``.
    """
    hs, fs = batch.column("hs"), batch.column("fs")
    sizes = hs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rec = np.repeat(np.arange(len(sizes)), sizes)
    h = hs.flatten().to_numpy(zero_copy_only=False)
    f = fs.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    good = (h != BLANK) & (f >= 1)
    rec, h, f = rec[good], h[good].view(U), f[good].astype(np.int64)
    order = np.lexsort((h, rec) if rank is None else (h, rank[(h % U(BUCKETS)).astype(np.intp)], rec))
    rec, h, f = rec[order], h[order], f[order]
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h, f
    new = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (h[1:] != h[:-1])])
    f, rec, h = np.add.reduceat(f, new), rec[new], h[new]
    starts = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
    return rec[starts], starts, h, f


def class_ids(starts: np.ndarray, h: np.ndarray, f: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit id of each bag, equal for equal bags (of equal sets of terms, without frequencies)."""
    each = mix(h) if f is None else mix(h ^ mix(f.astype(U)))
    return mix(np.add.reduceat(each, starts)) if len(starts) else each


#: Frequencies that parity words tell apart; larger ones count as this one.
LEVELS = 4


def parity(starts: np.ndarray, h: np.ndarray, words: int, f: np.ndarray | None = None) -> list[np.ndarray]:
    """``words`` 64-bit words per bag in which every term flips one bit, with frequencies f a bit for each of its first LEVELS
    occurrences. The bits that differ between two bags are never more than the terms that only one of them has, or with
    frequencies the occurrences."""
    out = [np.zeros(len(h), U) for _ in range(words)]
    for level in range(1 if f is None else LEVELS):
        on = slice(None) if not level else np.flatnonzero(f > level)
        place = (mix(h[on] + U(level)) if level else h[on]) >> U(32)
        place = place % U(64 * words)
        bit = U(1) << (place % U(64))
        for k in range(words):
            out[k][on] ^= np.where(place // U(64) == U(k), bit, U(0))
    return [np.bitwise_xor.reduceat(x, starts) if len(starts) else x for x in out]


def spans(starts: np.ndarray, total: int) -> np.ndarray:
    """How many items each of the runs that begin at ``starts`` has."""
    return np.diff(np.r_[starts, total])


class Unseen:
    """Tells which class ids a task sees for the first time, as far back as REMEMBERED ids."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        first = np.zeros(len(ids), bool)
        for k, x in enumerate(ids.tolist()):
            if x not in self.seen:
                self.seen.add(x)
                first[k] = True
        return first


def term_counts(bags: DataFrame) -> tuple[np.ndarray, int]:
    """(record counts by hashed bucket, records with terms) over all rows of ``hashed(...)``; deliveries count as rows."""

    def partial(batches: Batches) -> np.ndarray:
        out = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            rows, _, h, _ = merged(batch)
            out[:BUCKETS] += np.bincount((h % U(BUCKETS)).astype(np.intp), minlength=BUCKETS)
            out[BUCKETS] += len(rows)
        return out

    both = summed(bags, partial, BUCKETS + 1, np.int64)
    return both[:BUCKETS], int(both[BUCKETS])


def marks_of(spark: SparkSession, pairs: DataFrame) -> np.ndarray:
    """A bit table (MARKS bits) of the class ids in ``pairs`` (a, b). It only saves work: an unmarked class is in no pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("i")).select(F.pmod("i", F.lit(MARKS)).alias("m"))
    words = ids.groupBy(F.shiftright("m", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m % 64 AS int))")).alias("v"))
    table = np.zeros(MARKS // 64, np.int64)
    for part in words.toArrow().to_batches():
        table[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return table.view(U)


def members(bags: DataFrame, marks: np.ndarray, weighted: bool) -> DataFrame:
    """(class, id, split, domain, hs, fs) of all records with terms. Terms and frequencies, ordered by hash, are null
    unless the class is marked. Deliveries of a record are still repeated."""
    sent = bags.sparkSession.sparkContext.broadcast(marks)

    def rows_of(batches: Batches) -> Batches:
        table = sent.value
        for batch in batches:
            rows, starts, h, f = merged(batch)
            ids = class_ids(starts, h, f if weighted else None).view(np.int64)
            m = np.mod(ids, MARKS)
            on = (table[m >> 6] >> (m & 63).astype(U)) & U(1) == 1
            n = spans(starts, len(h))
            keep = np.repeat(on, n)
            offsets = pa.array(np.r_[0, np.cumsum(np.where(on, n, 0))].astype(np.int32))
            hs = pa.ListArray.from_arrays(offsets, pa.array(h[keep].view(np.int64)), mask=pa.array(~on))
            fs = pa.ListArray.from_arrays(offsets, pa.array(f[keep]), mask=pa.array(~on))
            took = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), *(batch.column(c).take(took) for c in ("id", "split", "domain")), hs, fs], names=["class", "id", "split", "domain", "hs", "fs"]
            )

    return bags.mapInArrow(rows_of, "class long, id long, split string, domain string, hs array<long>, fs array<long>")


def similarity(weighted: bool, threshold: float, cover: bool = False) -> Callable[[Batches], Batches]:
    """Keeps the pairs (a, b, ha, fa, hb, fb) whose (weighted) Jaccard similarity reaches the threshold, with it as ``sim``; with
    ``cover`` also n_terms, the terms of a, and a bitmap of those that b holds."""

    def check(batches: Batches) -> Batches:
        for batch in batches:
            n = batch.num_rows
            lists = [batch.column(c) for c in ("ha", "fa", "hb", "fb")]
            na, nb = (lists[k].value_lengths().to_numpy(zero_copy_only=False) for k in (0, 2))
            pair = np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)])
            h = np.concatenate([lists[k].flatten().to_numpy() for k in (0, 2)])
            f = np.concatenate([lists[k].flatten().to_numpy() for k in (1, 3)]) if weighted else np.ones(len(h), np.int64)
            order = np.lexsort((h, pair))
            pair, h, f = pair[order], h[order], f[order]
            same = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
            low = np.bincount(pair[same], np.minimum(f[same], f[same + 1]), n)
            sim = low / np.maximum(np.bincount(pair, f, n) - low, 1)
            good = np.flatnonzero(sim >= threshold)
            cols = [batch.column("a").take(pa.array(good)), batch.column("b").take(pa.array(good)), pa.array(sim[good])]
            if cover:
                words = (na + 63) // 64
                offsets = np.r_[0, np.cumsum(words)]
                place = order[same] - (np.cumsum(na) - na)[pair[same]]  # the entry of a stands before that of b
                bits = np.zeros(offsets[-1], U)
                np.bitwise_or.at(bits, offsets[pair[same]] + (place >> 6), U(1) << (place & 63).astype(U))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(bits.view(np.int64)))
                cols += [pa.array(na[good].astype(np.int64)), lists.take(pa.array(good))]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "sim", "n_terms", "cover"][: len(cols)])

    return check


def verified(bags: DataFrame, pairs: DataFrame, weighted: bool, threshold: float, same: bool = False, cover: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): all records with their class, once each, and the candidate pairs of classes that reach the
    threshold exactly (a, b, sim). Only bags of classes in a pair are shuffled. With ``same``, pairs of a class with itself
    are kept, as they are; ``cover`` is that of ``similarity``."""
    spark = bags.sparkSession
    pairs = cut(pairs)
    every = cut(members(bags, marks_of(spark, pairs), weighted))
    terms = every.where(F.col("hs").isNotNull()).dropDuplicates(["class"])
    one = terms.select(F.col("class").alias("a"), F.col("hs").alias("ha"), F.col("fs").alias("fa"))
    two = terms.select(F.col("class").alias("b"), F.col("hs").alias("hb"), F.col("fs").alias("fb"))
    compared = pairs.where("a <> b").join(one, "a").join(two, "b").select("a", "b", "ha", "fa", "hb", "fb")
    links = compared.mapInArrow(similarity(weighted, threshold, cover), "a long, b long, sim double" + ", n_terms long, cover array<long>" * cover)
    if same:
        own = pairs.where("a = b").select("a", "b", F.lit(1.0).alias("sim"))
        if cover:  # a class covers itself: full words, then the rest of the terms
            size = F.size("ha").cast("bigint")
            word = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("ha") - 1, 6)), lambda w: F.when(F.size("ha") - 64 * w >= 64, F.lit(-1)).otherwise(F.expr("shiftrightunsigned(-1L, 64 - size(ha) % 64)")))
            own = own.join(one.select("a", "ha"), "a").select("a", "b", "sim", size.alias("n_terms"), word.cast("array<bigint>").alias("cover"))
        links = links.union(own)
    return every.select("class", "id", "split", "domain").dropDuplicates(["class", "id"]), links
