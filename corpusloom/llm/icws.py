"""Near-duplicate records with small edits: improved consistent weighted sampling over TF-IDF weights, banded.

Each record's bag gets TF-IDF weights (terms are the shingles of a bag, which has no word order). For each of
``bands * rows`` samples, the term that minimises the sampling key of Ioffe's scheme is taken, with its quantised weight; two bags
agree in a sample with a probability equal to the weighted Jaccard similarity of their weights. Records that agree in all rows of a
band meet in that band's bucket. Within a bucket, pairs are compared by exact bounds (total frequency, and parity
words that count differing occurrences from below), so only pairs that can reach the threshold leave it. Those are
verified by their weighted Jaccard similarity on the frequencies themselves. A bucket too large for one task is compared
in blocks spread over tasks.

Recall. The result is defined on frequencies, sampling sees weights, so the idf is damped to lie between 1 and ``SPREAD``: a pair of
frequency similarity t then has a weight similarity of at least t / (t + (1 - t) SPREAD), whatever terms its edits touch and
however large the collection is. ``settings`` derives the bands from that bound: a pair at the threshold whose edits are all of the
rarest and whose common terms are all of the commonest kind is missed with a probability of at most ``miss``, any other pair less often.
The rows of a band are those that cost the least work for the number of records and the similarity of random ones.

Random numbers of a (term, sample) come from one multiplied hash; gamma quantiles from tables of 65,536 steps.

Exact copies travel as one class. Buckets are streamed in sorted order and compared in vectors, so a
large bucket is neither held as pairs nor sent to the driver. Recall against brute force: see README.
"""

from __future__ import annotations

from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.bags import BUCKETS, MIX_A, STEP, Batches, U, Unseen, class_ids, hashed, merged, mix, parity, spans, term_counts, verified
from corpusloom.plans.session import cut

#: Steps of the quantile tables.
STEPS = 65536
#: How many times the weight of a term in every record a term in one record has.
SPREAD = 1.5
#: Nanoseconds, as measured: of a sample of a term, of a row that is shuffled, of a comparison within a bucket.
SAMPLE_NS, ROW_NS, COMPARE_NS = 11.0, 2000.0, 3.0
#: Entries of a block that stays in a core's cache while its samples are drawn.
BLOCK = 1 << 14


def gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 and scale 1 at the middles of STEPS equal parts."""
    u = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Draws the samples of bags: ``codes(starts, hashes, log weights)`` has a row for each bag, a column for each sample."""

    def __init__(self, samples: int) -> None:
        g = gamma_quantiles()
        self.r, self.inverse, self.log = (x.astype(np.float32) for x in (g, 1 / g, np.log(g)))
        self.odd = [U(x | 1) for x in mix(np.arange(1, samples + 1, dtype=U) * U(STEP)).tolist()]

    def codes(self, starts: np.ndarray, h: np.ndarray, logw: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), len(self.odd)), U)
        ends = np.r_[starts[1:], len(h)]
        first = 0
        while first < len(starts):  # whole bags, about BLOCK entries
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
            a, b = starts[first], ends[last - 1]
            self._block(out[first:last], starts[first:last] - a, h[a:b], logw[a:b])
            first = last
        return out

    def _block(self, out: np.ndarray, starts: np.ndarray, h: np.ndarray, logw: np.ndarray) -> None:
        size = spans(starts, len(h))
        for k, odd in enumerate(self.odd):
            z = (h * odd).view(np.uint16).reshape(-1, 4)
            beta = z[:, 1].astype(np.float32)
            beta *= np.float32(1 / STEPS)
            t = logw * self.inverse.take(z[:, 3])
            t += beta
            np.floor(t, out=t)
            key = beta  # becomes log c - r (t - beta + 1)
            key -= t
            key -= np.float32(1)
            key *= self.r.take(z[:, 3])
            key += self.log.take(z[:, 2])
            at = np.flatnonzero(key == np.repeat(np.minimum.reduceat(key, starts), size))
            if len(at) > len(starts):  # equal keys: the first
                owner = np.searchsorted(starts, at, "right")
                at = at[np.r_[True, owner[1:] != owner[:-1]]]
            out[:, k] = mix(h[at] ^ (t[at].astype(np.int64).view(U) * U(STEP)))


def damped(counts: np.ndarray, n: int) -> np.ndarray:
    """The idf of terms with these record counts: 1 for a term in every record (or nearly so) up to SPREAD for one in a single record."""
    return 1 + (SPREAD - 1) * np.log1p((n - counts) / np.maximum(counts, 1)).clip(0) / max(log1p(n), 1e-9)


def settings(counts: np.ndarray, n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bands, rows) for the record counts of terms and the number of records."""
    least = threshold / (threshold + (1 - threshold) * SPREAD)
    share, weight = np.minimum(counts / max(n, 1), 1), damped(counts, n)
    common = float((weight * share * share).sum())
    random = common / max(2 * float((weight * share).sum()) - common, 1e-9)  # similarity of two records drawn at random
    terms = counts.sum() / max(n, 1)
    best = None
    for rows in range(3, 9):
        bands = max(1, ceil(log(miss) / log1p(-min(least**rows, 1 - 1e-9))))
        cost = bands * (rows * terms * SAMPLE_NS + ROW_NS + n * random**rows * COMPARE_NS)
        if best is None or cost < best[0]:
            best = cost, bands, rows
    return best[1:]


def band_rows(bags: DataFrame, threshold: float, miss: float, fixed: tuple[int, int] | None = None) -> DataFrame:
    """(key, class, weight, p, q, r, s): a row for each class and band. ``fixed`` takes these bands and rows."""
    counts, n = term_counts(bags)
    bands, rows = fixed or settings(counts, n, threshold, miss)
    sent = bags.sparkSession.sparkContext.broadcast(np.log(damped(counts, n)).astype(np.float32))

    def emit(batches: Batches) -> Batches:
        idf, sampler, unseen = sent.value, Sampler(bands * rows), Unseen()
        for batch in batches:
            _, starts, h, f = merged(batch)
            if not len(h):
                continue
            ids = class_ids(starts, h, f)
            new = unseen(ids)
            take = np.repeat(new, spans(starts, len(h)))
            size = spans(starts, len(h))[new]
            h, f, ids = h[take], f[take], ids[new]
            if not len(ids):
                continue
            starts = np.r_[0, np.cumsum(size)[:-1]]
            logw = np.log(f).astype(np.float32) + idf[(h % U(BUCKETS)).astype(np.intp)]
            code = sampler.codes(starts, h, logw).reshape(len(ids), bands, rows)
            key = np.zeros((len(ids), bands), U)
            for k in range(rows):
                key = mix(key + code[:, :, k] * U(MIX_A))
            key = mix(key ^ np.arange(bands, dtype=U)[None, :] * U(STEP))
            weight, words = np.add.reduceat(f, starts), parity(starts, h, 4, f)
            fine = [np.where(weight > LONG, x, U(0)) for x in words[2:]]
            each = [ids.view(np.int64), weight, *(x.view(np.int64) for x in (words[0] ^ words[2], words[1] ^ words[3], *fine))]
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), *(pa.array(np.repeat(x, bands)) for x in each)], names=["key", *ROW])

    return bags.mapInArrow(emit, ", ".join(f"{c} long" for c in ("key", *ROW)))


#: What a row of a bucket says of a class: p and q are 128 parity bits; r and s, zero up to a weight of LONG, make them 256.
ROW = ("class", "weight", "p", "q", "r", "s")
LONG = 96
#: Rows of a bucket that one task compares with each other; a larger bucket is cut in blocks of so many.
HOT = 4096
#: Rows of a bucket from which on it is compared in tiles, and the rows of a tile's side.
MANY, TILE = 24, 256


def near(one: tuple, two: tuple, threshold: float) -> np.ndarray:
    """Which rows of two equally long sets of columns (ROW) may be pairs: sizes and differing occurrences allow it."""
    (ia, wa, *xa), (ib, wb, *xb) = one, two
    p, q, r, s = (a ^ b for a, b in zip(xa, xb))
    ones = lambda *x: sum(np.bitwise_count(y).astype(np.int64) for y in x)
    differ = np.where(np.minimum(wa, wb) > LONG, ones(p ^ r, q ^ s, r, s), ones(p, q))
    close = np.minimum(wa, wb) >= threshold * np.maximum(wa, wb) - 1e-9
    return close & (differ <= (wa + wb) * ((1 - threshold) / (1 + threshold)) + 1e-9) & (ia != ib)


def tiled(cols: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...] | None, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may reach the threshold within rows ordered by weight, or between them and ``others``. Tile against tile: parity
    words first, against the largest bound of the tile, then each pair that is left against its own."""
    found, two = [], cols if others is None else others
    share = (1 - threshold) / (1 + threshold)
    for i in range(0, len(cols[0]), TILE):
        one = tuple(c[i : i + TILE] for c in cols)
        for j in range(i if others is None else 0, len(two[0]), TILE):
            side = tuple(c[j : j + TILE] for c in two)
            low, high = max(one[1][0], side[1][0]), min(one[1][-1], side[1][-1])
            if high < threshold * low - 1e-9:  # all of one tile are too light for the other
                if others is None or side[1][0] > one[1][-1]:
                    break
                continue
            differ = np.bitwise_count(one[2][:, None] ^ side[2][None, :])
            differ += np.bitwise_count(one[3][:, None] ^ side[3][None, :])
            a, b = np.nonzero(differ <= min((int(one[1][-1]) + int(side[1][-1])) * share + 1e-9, 255))
            if others is None and i == j:
                a, b = a[a < b], b[a < b]
            if len(a):
                good = near(tuple(c[a] for c in one), tuple(c[b] for c in side), threshold)
                found.append((one[0][a[good]], side[0][b[good]]))
    return [x for x in found if len(x[0])]


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Columns as arrays; the bits of parity words are counted unsigned."""
    return tuple(batch.column(c).to_numpy().view(U if c in "pqrs" else np.int64) for c in names)


def _batch(found: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*found))
    x = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    none = [pa.nulls(x.shape[1], pa.int64()) for _ in names[2:]]
    return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), *none], names=names)


def candidates(banded: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: pairs of classes of a bucket that the bounds let reach the threshold, each once.

    Buckets are streamed in the order of key and weight. Those of at most ``hot`` rows are compared at once; the rows of
    larger ones are passed on by blocks, and pairs of blocks whose weights come near enough are compared in tasks of their own.
    """
    row, names = ROW, ["a", "b", "key", "block", *ROW]
    schema = ", ".join(f"{c} long" for c in names)

    def small(key: np.ndarray, cols: tuple) -> Batches:
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[heads, len(key)])
        found, step = [], 1
        for k in np.flatnonzero(sizes >= MANY).tolist():
            found += tiled(tuple(c[heads[k] : heads[k] + sizes[k]] for c in cols), None, threshold)
        at = np.flatnonzero(np.repeat(sizes < MANY, sizes))
        while len(at := at[(at < len(key) - step)]):
            at = at[(key[np.minimum(at + step, len(key) - 1)] == key[at])]
            at = at[cols[1][at] >= threshold * cols[1][at + step] - 1e-9]  # weights ascend
            good = near(tuple(c[at] for c in cols), tuple(c[at + step] for c in cols), threshold)
            if good.any():
                found.append((cols[0][at[good]], cols[0][at[good] + step]))
            step += 1
        if found:
            yield _batch(found, names)

    def passed(key: int, block: np.ndarray, cols: tuple) -> pa.RecordBatch:
        none = pa.nulls(len(block), pa.int64())
        arrays = [none, none, pa.array(np.full(len(block), key)), pa.array(block), *(pa.array(c.view(np.int64)) for c in cols)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def stream(batches: Batches) -> Batches:
        rest, sent_key, sent = None, None, 0  # rows of the last key; a hot key of which rows were passed on
        for batch in batches:
            now = _columns(batch, ("key", *row))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now))
            key = now[0]
            if not len(key):
                continue
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[heads, len(key)])
            large = (sizes > hot) | (key[heads] == sent_key)
            for k in np.flatnonzero(large).tolist():
                before = sent if key[heads[k]] == sent_key else 0
                part = slice(heads[k], heads[k] + sizes[k])
                yield passed(int(key[heads[k]]), (before + np.arange(sizes[k])) // hot, tuple(c[part] for c in now[1:]))
                sent_key, sent = int(key[heads[k]]), before + int(sizes[k])
            compare = np.repeat(~large & (np.arange(len(heads)) < len(heads) - 1), sizes)  # the last key may go on
            if compare.any():
                yield from small(key[compare], tuple(c[compare] for c in now[1:]))
            last = slice(heads[-1], None) if not large[-1] else slice(len(key), None)
            rest = tuple(c[last] for c in now)
        if rest is not None and len(rest[0]):
            yield from small(rest[0], rest[1:])

    def blocks(batches: Batches) -> Batches:
        rest = None
        for batch in batches:
            now = _columns(batch, ("key", "i", "j", "side", *row))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now))
            if len(now[0]):
                key, i, j = now[:3]
                heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
                for low, high in zip(heads[:-1], heads[1:]):
                    yield from cell(tuple(c[low:high] for c in now))
                now = tuple(c[heads[-1] :] for c in now)
            rest = now
        if rest is not None and len(rest[0]):
            yield from cell(rest)

    def cell(cols: tuple) -> Batches:
        side = cols[3]
        if cols[1][0] == cols[2][0]:
            for pairs in small(np.zeros(len(side), np.int64), cols[4:]):
                yield pairs.select(["a", "b"])
            return
        one, two = (tuple(c[side == k] for c in cols[4:]) for k in (0, 1))
        if found := tiled(one, two, threshold) if len(one[0]) and len(two[0]) else []:
            yield _batch(found, ["a", "b"])

    out = cut(banded.repartition("key").sortWithinPartitions("key", "weight").mapInArrow(stream, schema))
    pairs = out.where("a IS NOT NULL").select("a", "b")
    large = out.where("a IS NULL").drop("a", "b")
    if not large.isEmpty():
        span = large.groupBy("key", "block").agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
        left, right = (span.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high")]) for s in "ij")
        meet = (F.col("block_i") <= F.col("block_j")) & (F.col("high_i") >= threshold * F.col("low_j") - 1e-9)
        jobs = left.join(right, "key").where(meet).select("key", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
        sides = [(0, jobs.withColumn("block", F.col("i"))), (1, jobs.where("i < j").withColumn("block", F.col("j")))]
        one, two = (large.join(j, ["key", "block"]).select("key", "i", "j", F.lit(k).cast("long").alias("side"), *row) for k, j in sides)
        placed = one.union(two).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "weight")
        pairs = pairs.union(placed.mapInArrow(blocks, "a long, b long"))
    return pairs.distinct()


def near_duplicates(records: DataFrame, threshold: float = 0.8, miss: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records (review_id, split, domain, features): every record with terms once, with the class of
    its bag, and the links between classes (a, b, sim) with a weighted Jaccard similarity of at least the threshold.

    A pair is missed with a probability of at most ``miss``.
    """
    bags = hashed(records, F.col("review_id").alias("id"), "split", "domain")
    return verified(bags, candidates(band_rows(bags, threshold, miss), threshold), True, threshold)


def record_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(review_id, class_id, n_copies, n_links): of each record its class, named by the least record in it, the records of that class, and
    the other classes it is linked to. With ``links`` this says the same as all pairs of records, without writing them out."""
    copies = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    linked = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    each = copies.join(linked, "class", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return members.select(F.col("id").alias("review_id"), "class").join(each, "class").select("review_id", "class_id", "n_copies", "n_links")


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(review_id_a, review_id_b), a < b: the pairs of records that links and equal bags stand for."""
    one = members.select(F.col("class").alias("a"), F.col("id").alias("ia"))
    two = members.select(F.col("class").alias("b"), F.col("id").alias("ib"))
    linked = links.join(one, "a").join(two, "b").select("ia", "ib")
    same = one.join(two.withColumnRenamed("b", "a"), "a").where("ia < ib").select("ia", "ib")
    return linked.union(same).select(F.least("ia", "ib").alias("review_id_a"), F.greatest("ia", "ib").alias("review_id_b"))
