"""Same or near-same records across splits: sharded Aho-Corasick automata over normalised evaluation passages.

Normalisation. A record becomes the text of its distinct terms, rarest first (by hashed record counts, then by hash),
DIGITS characters a term, each digit with an alphabet of its own, so that no passage matches across terms and no node of an automaton has many children.

Passages. A pair with Jaccard similarity >= t and o common terms differs in at most d = o (1 - t) / t terms. The common terms
fall into at most d + 1 runs with nothing between them in either text, so among the first (k - 1)(d + 1) + 1 common terms one run has k:
some passage of k adjacent terms that begins within the first k d + 1 terms stands in both. Passages of three terms serve all pairs with
o >= 3 / (3 - 2 / t), passages of two terms the shorter ones, for records of one term it is that term with an end mark; a record that can
have partners of both kinds gives both. Passages of evaluation records are the patterns. Nothing is lost by this, for any t > 2/3.

Shards. A passage belongs to the shard of its characters, so a term that many records hold is spread. Per shard, an automaton holds the evaluation passages, and every training
text is scanned by the automaton of each shard in which it has a passage; it travels there once, as the fragment of
its text that holds those passages, overlapping passages merged. Shards are as many as the shuffle has tasks, more
where the passages exceed ``passages_per_shard`` on average. No passage is in more records than its rarest term: where that bound exceeds a quarter
of a shard, evaluation and training records are dealt into g groups each by their class, and each pair of groups meets in a shard of its own. So
a passage that a third of all records hold fills no shard, and what a task holds is bounded.

Candidates. A pair with a matched passage is a candidate where exact size bounds and a parity word allow it. A candidate's match is then
extended to the whole texts: the pair counts where the common terms reach the threshold, and the matched intervals of the
evaluation text, as a bitmap of its terms, are merged over all its training texts and shards into the coverage of the evaluation record.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.bags import BUCKETS, MIX_A, STEP, Batches, U, Unseen, class_ids, hashed, merged, mix, parity, spans, term_counts, verified
from corpusloom.plans.session import shuffle_width

#: Characters of a term: digits of DIGIT_BITS bits; digit k has the characters from 1 + (k << DIGIT_BITS) on. END follows a lone term,
#: GAP + k ends a piece of passages of k terms.
DIGITS, DIGIT_BITS, END, GAP = 4, 5, 250, 250
CODES = 1 << DIGITS * DIGIT_BITS
#: Training fragments of one scan, and bits of a shard's table of training passages (as a power of two).
SCAN, MARK_BITS = 4096, 22
#: Pairs that are looked at in one step.
PAIRS = 1 << 20
SCHEMA = pa.schema([("shard", pa.int64()), ("side", pa.int64()), ("class", pa.int64()), ("terms", pa.int64()), ("bits", pa.int64()), ("text", pa.binary())])


def spelled(codes: np.ndarray) -> np.ndarray:
    """(terms x DIGITS) characters of term codes."""
    shift = np.arange(DIGITS, dtype=np.uint32) * np.uint32(DIGIT_BITS)
    digit = (codes[:, None] >> shift[None, :]) & np.uint32((1 << DIGIT_BITS) - 1)
    return (1 + (np.arange(DIGITS, dtype=np.uint32) << np.uint32(DIGIT_BITS))[None, :] + digit).astype(np.uint8)


def long_from(threshold: float) -> int:
    """The least number of terms of a record for which passages of three terms find all partners with as many terms or more."""
    return ceil(ceil(3 / (3 - 2 / threshold) - 1e-9) / threshold - 1e-9)


def windows(size: np.ndarray, threshold: float, k: int) -> np.ndarray:
    """How many passages of k terms the texts of ``size`` terms give."""
    longer, least = size >= long_from(threshold), long_from(threshold)
    wanted = longer if k == 3 else ~longer | (size * threshold < least)
    reach = np.minimum(k * np.floor(size * (1 - threshold) / threshold + 1e-9).astype(np.int64) + 1, np.maximum(size - k + 1, 1))
    return np.where(wanted, reach, 0)


def fragments(records: DataFrame, evaluation: str, threshold: float, passages_per_shard: int) -> tuple[DataFrame, int]:
    """((shard, side, class, terms, bits, text), shards); side 0 is the evaluation split."""
    counts, n = term_counts(records)
    rank = np.minimum(np.log2(np.maximum(counts, 1)) * 4, 255).astype(np.uint8)
    sent = records.sparkSession.sparkContext.broadcast(rank)
    each = counts.sum() / max(n, 1)
    shards = max(shuffle_width(records.sparkSession), ceil(n * each * 3 * (1 - threshold) / threshold / passages_per_shard))

    def emit(batches: Batches) -> Batches:
        unseen = Unseen()
        for batch in batches:
            rows, starts, h, _ = merged(batch, sent.value)
            if not len(h):
                continue
            ids = class_ids(starts, h)
            side = np.array([x != evaluation for x in batch.column("split").take(pa.array(rows)).to_pylist()], np.int64)
            new = np.flatnonzero(unseen(ids ^ side.astype(U)))
            size = spans(starts, len(h))
            code = ((mix(h) >> U(16)) % U(CODES)).astype(np.uint32)
            most = np.exp2((sent.value[(h % U(BUCKETS)).astype(np.intp)] + 1) / 4)  # records of each term, at most
            bits = parity(starts, h, 1)[0]
            letters = spelled(code)
            for k in (2, 3):
                yield from emit_passages(k, starts, size, new, code, letters, side, ids, bits, most)

    def emit_passages(k: int, starts: np.ndarray, size: np.ndarray, new: np.ndarray, code: np.ndarray, letters: np.ndarray, side: np.ndarray, ids: np.ndarray, bits: np.ndarray, most: np.ndarray) -> Batches:
        reach = windows(size[new], threshold, k)
        owner = np.repeat(np.arange(len(new)), reach)
        if not len(owner):
            return
        i = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach)
        at = starts[new][owner] + i
        alone = size[new][owner] == 1
        key = mix(code[at].astype(U) + U(1))
        for j in range(1, k):
            key = mix(key ^ np.where(alone, 0, code[np.minimum(at + j, len(code) - 1)].astype(U) + U(1)))
        bound = most[at]
        for j in range(1, k):
            bound = np.where(alone, bound, np.minimum(bound, most[np.minimum(at + j, len(most) - 1)]))
        groups = np.maximum(np.ceil(bound / max(passages_per_shard // 4, 1)), 1).astype(np.int64)
        if (groups > 1).any():
            turn = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
            owner, i, at, alone, key, groups = (np.repeat(x, groups) for x in (owner, i, at, alone, key, groups))
            own = (ids[new[owner]] % groups.astype(U)).astype(np.int64)
            cell = np.where(side[new[owner]] == 0, own * groups + turn, turn * groups + own)
            key = np.where(groups > 1, mix(key ^ (cell + 1).astype(U) * U(STEP)), key)
        shard = (key % U(shards)).astype(np.int64)
        order = np.lexsort((i, shard, owner))
        owner, i, at, shard, alone = (x[order] for x in (owner, i, at, shard, alone))
        begin = np.r_[True, (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])]
        joined = ~begin & np.r_[False, i[1:] == i[:-1] + 1]
        # terms of each passage: the last one only where it goes on from the passage before; then a gap unless the next one goes on
        gap = ~np.r_[joined[1:], False]
        terms = np.where(joined | alone, 1, k)
        length = terms * DIGITS + alone + gap
        ends = np.cumsum(length)
        text = np.full(ends[-1], GAP + k, np.uint8)
        for j in range(k):
            on = np.flatnonzero((terms == k) & ~joined if j < k - 1 else ~alone)
            place = (ends - length)[on] + np.where(joined[on], 0, j * DIGITS)
            text[place[:, None] + np.arange(DIGITS)[None, :]] = letters[at[on] + j]
        on = np.flatnonzero(alone)
        text[(ends - length)[on][:, None] + np.arange(DIGITS)[None, :]] = letters[at[on]]
        text[(ends - length)[on] + DIGITS] = END
        heads = np.flatnonzero(begin)
        offsets = np.r_[(ends - length)[heads], ends[-1]]
        body = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])
        who = new[owner[heads]]
        cols = [shard[heads], side[who], ids[who].view(np.int64), size[who], bits[who].view(np.int64)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), body], names=["shard", "side", "class", "terms", "bits", "text"])

    return records.mapInArrow(emit, "shard long, side long, class long, terms long, bits long, text binary"), shards


class Texts:
    """The fragments of one side of a shard, one behind the other; classes are numbered, and each text's number is kept."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = table.column("class").to_numpy()
        self.terms, self.bits = table.column("terms").to_numpy(), table.column("bits").to_numpy().view(U)
        text = table.column("text").combine_chunks()
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        self.chars = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.ends = offsets[1:] - offsets[0]

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first character, characters) of the passages: as many terms as the gap behind a piece says, or a lone term and its mark."""
        gaps = np.flatnonzero(self.chars > GAP)
        begins, sizes = np.r_[0, gaps[:-1] + 1], np.diff(np.r_[-1, gaps]) - 1
        step = (self.chars[gaps].astype(np.int64) - GAP) * DIGITS
        many = np.maximum((sizes - step) // DIGITS + 1, 1)
        owner = np.repeat(np.arange(len(begins)), many)
        at = begins[owner] + DIGITS * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
        length = np.minimum(sizes, step)[owner]
        key = length.astype(U)
        for j in range(3 * DIGITS):
            on = j < length
            key = np.where(on, (key ^ self.chars[np.minimum(at + j, len(self.chars) - 1)].astype(U)) * U(MIX_A), key)
            key ^= key >> U(29)
        return mix(key), at, length


def scan(one: Texts, two: Texts, threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a evaluation class, b training class): an automaton of the passages of ``one`` scans all texts of ``two``.

    Passages that no training fragment can hold, by a bit table of those, are left out of the automaton.
    """
    key, at, length = one.passages()
    there = np.zeros(1 << MARK_BITS, bool)
    there[two.passages()[0] >> U(64 - MARK_BITS)] = True
    keep = np.flatnonzero(there[key >> U(64 - MARK_BITS)])
    patterns, begin, which = np.unique(key[keep], return_index=True, return_inverse=True)
    if not len(patterns):
        return
    order = np.argsort(which, kind="stable")
    posts = np.searchsorted(one.ends, at[keep][order], "right")
    first = np.r_[0, np.cumsum(np.bincount(which, minlength=len(patterns)))]
    import ahocorasick  # needed on executors, by this operator only

    letters = one.chars.tobytes().decode("latin-1")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, (low, n) in enumerate(zip(at[keep][begin].tolist(), length[keep][begin].tolist())):
        automaton.add_word(letters[low : low + n], k)
    automaton.make_automaton()
    for low in range(0, len(two.ends), SCAN):
        begin = int(two.ends[low - 1]) if low else 0
        end = int(two.ends[min(low + SCAN, len(two.ends)) - 1])
        hits = np.array(list(automaton.iter(two.chars[begin:end].tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
        many = np.cumsum((first[1:] - first[:-1])[hits[:, 1]])
        cuts = np.searchsorted(many, np.arange(PAIRS, int(many[-1]) if len(many) else 0, PAIRS))
        for some in np.split(hits, np.unique(cuts)):
            if len(some):
                yield from _pairs(one, two, some[:, 0] + begin, some[:, 1], posts, first, threshold)


def _pairs(one: Texts, two: Texts, end: np.ndarray, pattern: np.ndarray, posts: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs that hits (place in ``two``, pattern) make; a pattern of many records is taken in blocks of them."""
    most = int((first[pattern + 1] - first[pattern]).max())
    for low in range(0, most, PAIRS):
        many = np.clip(first[pattern + 1] - first[pattern] - low, 0, PAIRS)
        hit = np.repeat(np.arange(len(end)), many)
        a = posts[np.repeat(first[pattern] + low - np.cumsum(many) + many, many) + np.arange(len(hit))]
        b = np.searchsorted(two.ends, end, "right")[hit]
        ta, tb = one.terms[a], two.terms[b]
        differ = np.bitwise_count(one.bits[a] ^ two.bits[b])
        good = (np.minimum(ta, tb) >= threshold * np.maximum(ta, tb) - 1e-9) & (differ <= (ta + tb) * ((1 - threshold) / (1 + threshold)) + 1e-9)
        if good.any():
            pair = np.unique(np.stack([one.ids[a[good]], two.ids[b[good]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])


def candidates(parts: DataFrame, shards: int, threshold: float) -> DataFrame:
    """(a, b): pairs of an evaluation and a training class that a passage connects and the bounds allow, each once."""

    def shard(batches: Batches) -> Batches:
        table = pa.Table.from_batches(list(batches), schema=SCHEMA)  # a shard is a partition, of bounded size
        side = table.column("side").to_numpy()
        one, two = (table.filter(pa.array(side == k)) for k in (0, 1))
        if one.num_rows and two.num_rows:
            yield from scan(Texts(one), Texts(two), threshold)

    placed = parts.repartitionById(shards, F.col("shard").cast("int"))
    return placed.mapInArrow(shard, "a long, b long").distinct()


def overlaps(
    records: DataFrame, evaluation: str = "unlabeled", training: str = "labelled", threshold: float = 0.8, passages_per_shard: int = 2_000_000, cover: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records (review_id, split, domain, features): all records with terms, once each, with the class of
    their set of terms, and the links (a evaluation class, b training class, sim) of Jaccard similarity >= threshold (above 2/3).

    A class linked to itself holds records of both splits with equal sets. Records of other splits, without a split or
    without terms are in no link. With ``cover``, links also have ``n_terms``, the terms of a, and ``cover``, a bitmap (64 terms a number) of those that b holds.
    """
    if threshold <= 2 / 3:
        raise ValueError("the passages find every pair only for thresholds above 2/3")
    rows = records.where(F.col("split").isin(evaluation, training))
    bags = hashed(rows, F.col("review_id").alias("id"), "split", "domain")
    parts, shards = fragments(bags, evaluation, threshold, passages_per_shard)
    return verified(bags, candidates(parts, shards, threshold), False, threshold, same=True, cover=cover)


def record_overlaps(members: DataFrame, links: DataFrame, evaluation: str = "unlabeled") -> DataFrame:
    """(review_id_a, review_id_b), a < b: the pairs of an evaluation and a training record that the links stand for."""
    one = members.where(F.col("split") == evaluation).select(F.col("class").alias("a"), F.col("id").alias("ia"))
    two = members.where(F.col("split") != evaluation).select(F.col("class").alias("b"), F.col("id").alias("ib"))
    pairs = links.join(one, "a").join(two, "b")
    return pairs.select(F.least("ia", "ib").alias("review_id_a"), F.greatest("ia", "ib").alias("review_id_b"))


def overlap_counts(members: DataFrame, links: DataFrame, evaluation: str = "unlabeled") -> DataFrame:
    """(split, domain, n_records, n_overlapping): of each split and domain, records with terms and those with an overlap."""
    touched = links.select(F.col("a").alias("class"), F.lit(True).alias("eval")).union(links.select("b", F.lit(False))).distinct()
    side = members.withColumn("eval", F.col("split") == evaluation)
    on = side.join(touched.withColumn("hit", F.lit(1)), ["class", "eval"], "left")
    return on.groupBy("split", "domain").agg(F.count("*").alias("n_records"), F.count("hit").alias("n_overlapping"))


def coverage(members: DataFrame, links: DataFrame, evaluation: str = "unlabeled") -> DataFrame:
    """(review_id, domain, n_terms, n_covered): of every evaluation record with an overlap, its distinct terms and how many of them its
    training records hold together: matched intervals of the links (with ``cover``), merged by evaluation class."""
    words = links.select("a", "n_terms", F.posexplode("cover").alias("w", "bits")).groupBy("a", "n_terms", "w").agg(F.bit_or("bits").alias("bits"))
    merged_ = words.groupBy(F.col("a").alias("class"), "n_terms").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_covered"))
    own = members.where(F.col("split") == evaluation).select("class", F.col("id").alias("review_id"), "domain")
    return own.join(merged_, "class").select("review_id", "domain", "n_terms", "n_covered")
