"""Evaluation texts leaking into training texts: winnowing.

A text is the sequence of its words (longest runs of ASCII letters and digits of the lower-cased text), each hashed to 64
bits. Of every window of ``span - k + 1`` consecutive k-grams, the least hash is a fingerprint. Two texts that share ``span``
consecutive words share a whole window, hence a fingerprint in it. Hits are extended word by word to both sides, as
far as ``span`` words can reach, and count if the common run has ``span`` words.

Words, k-grams and windows are vectorised over the text buffers of Arrow batches, in pieces of fixed size, so a very
long text needs no more memory than its words. Test items stay with the tasks while they have at most
``most_broadcast`` fingerprints (checked); beyond it, fingerprints with the words around them are joined by a shuffle. Documents then
send only fingerprints that a bit table of the test fingerprints (16 MB, whatever their number) holds, so the words around others never travel;
the join is left to adaptive execution, which splits a fingerprint of very many documents.

Defined results: null or empty texts and texts of fewer than ``span`` words have no fingerprint and leak nothing; repeated
rows give their pair once; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.bags import MIX_B, STEP, Batches, U, mix
from corpusloom.plans.session import cut

#: Bytes of text that are split into words in one step.
PIECE = 1 << 20
#: Bits of the table of test fingerprints, as a power of two.
BITS = 27
#: An odd multiplier of the polynomial over a word's bytes.
BASE = STEP
WORD = np.zeros(256, bool)
WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(BASE)), np.full(n, U(pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """Splits the texts of a batch into hashed words."""

    def __init__(self) -> None:
        self.up, self.down = _powers(PIECE + 64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every word, in order."""
        texts = texts.cast(pa.large_string())
        sizes = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        data = np.frombuffer(sizes.buffers()[2] or b"", np.uint8)[: offsets[-1]] if len(sizes) else np.zeros(0, np.uint8)
        rows, hashes, low = [], [], int(offsets[0]) if len(sizes) else 0
        while low < len(data):
            high = min(low + PIECE, len(data))
            while high < len(data) and WORD[data[high - 1]] and WORD[data[high]]:  # not within a word
                back = np.flatnonzero(~WORD[data[low:high]])
                high = low + int(back[-1]) + 1 if len(back) else min(high + PIECE, len(data))
            start, h = self._piece(data[low:high], offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low)
            rows.append(np.searchsorted(offsets, start + low, "right") - 1)
            hashes.append(h)
            low = high
        return (np.concatenate(rows), np.concatenate(hashes)) if rows else (np.zeros(0, np.int64), np.zeros(0, U))

    def _piece(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(self.up):
            self.up, self.down = _powers(len(data))
        word = WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[breaks] = True
        edge[0] = edge[-1] = True
        start = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
        end = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False]))
        total = np.cumsum((data.astype(U) + U(1)) * self.up[: len(data)])
        h = (total[end] - np.where(start > 0, total[start - 1], U(0))) * self.down[start]
        return start, mix(h + (end - start).astype(U) * U(MIX_B))


def fingerprints(rows: np.ndarray, words: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of the k-grams that are least in a window of one text."""
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    grams = np.zeros(len(words) - k + 1, U)
    for j in range(k):
        grams = grams * U(STEP) + words[j : j + len(grams)]
    grams = mix(grams)
    window = span - k + 1
    least, width = grams, 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    inside = rows[:n] == rows[span - 1 :]
    chosen = np.zeros(len(grams), bool)
    for j in range(window):
        chosen[j : j + n] |= inside & (grams[j : j + n] == least)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def contexts(rows: np.ndarray, words: np.ndarray, at: np.ndarray, k: int, span: int, outside: int) -> np.ndarray:
    """The words around fingerprints, ``span - k`` to each side; ``outside`` stands where the text ends."""
    place = at[:, None] + np.arange(k - span, span)[None, :]
    inside = (place >= 0) & (place < len(words))
    place = np.clip(place, 0, max(len(words) - 1, 0))
    return np.where(inside & (rows[place] == rows[at][:, None]), words[place], U(outside))


def long_runs(one: np.ndarray, two: np.ndarray, k: int, span: int) -> np.ndarray:
    """Which pairs of contexts share a run of at least ``span`` words that covers the fingerprint in the middle."""
    same = one == two
    side = span - k
    left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
    right = np.cumprod(same[:, side + k :], axis=1).sum(axis=1)
    return same[:, side : side + k].all(axis=1) & (left + k + right >= span)


def bit_table(fingerprints_: DataFrame) -> np.ndarray:
    """Bits of the places, two for each, of fingerprints (fp)."""
    place = F.explode(F.array(*[F.shiftrightunsigned("fp", 64 - BITS), F.col("fp").bitwiseAND((1 << BITS) - 1)]))
    words = fingerprints_.select(place.alias("m")).groupBy(F.shiftright("m", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m % 64 AS int))")).alias("v"))
    table = np.zeros(1 << BITS - 6, np.int64)
    for part in words.toArrow().to_batches():
        table[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return table.view(U)


def in_table(table: np.ndarray, fp: np.ndarray) -> np.ndarray:
    on = np.ones(len(fp), bool)
    for m in (fp >> U(64 - BITS), fp & U((1 << BITS) - 1)):
        on &= (table[(m >> U(6)).astype(np.intp)] >> (m & U(63))) & U(1) == 1
    return on


def _prints(df: DataFrame, key: str, text: str, k: int, span: int, outside: int, table: np.ndarray | None = None) -> DataFrame:
    """(fp, key, context) of every fingerprint, or of those that a bit table holds."""
    sent = None if table is None else df.sparkSession.sparkContext.broadcast(table)

    def emit(batches: Batches) -> Batches:
        split = Words()
        for batch, some in ((b, s) for b in batches for s in pieces(b.column(1))):
            rows, words = split(batch.column(1)[some])
            at, fp = fingerprints(rows, words, k, span)
            if sent is not None:
                on = in_table(sent.value, fp)
                at, fp = at[on], fp[on]
            near = contexts(rows, words, at, k, span, outside)
            width = near.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(near.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), batch.column(0)[some].take(pa.array(rows[at])), lists], names=["fp", key, "context"])

    return df.select(key, F.lower(text).alias("text")).mapInArrow(emit, f"fp long, {key} long, context array<long>").select("fp", key, "context")


def leaks(corpus: DataFrame, items: DataFrame, k: int = 8, span: int = 20, most_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, item_id), each once: the documents (doc_id, text) in which at least ``span`` consecutive words of an
    item (item_id, item_text) stand consecutively."""
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    tests = _prints(items.select("item_id", "item_text"), "item_id", "item_text", k, span, 1).dropDuplicates()
    some = tests.limit(most_broadcast + 1).toArrow()
    docs = corpus.select("doc_id", F.lower("text").alias("text"))
    if some.num_rows > most_broadcast:
        tests = cut(tests)
        return _joined(_prints(corpus.where("doc_id IS NOT NULL AND text IS NOT NULL"), "doc_id", "text", k, span, 0, bit_table(tests.select("fp").distinct())), tests, k, span)
    fp = some.column(0).combine_chunks().to_numpy().view(U) if some.num_rows else np.zeros(0, U)
    order = np.argsort(fp)
    width = 2 * span - k
    near = some.column(2).combine_chunks().flatten().to_numpy().view(U).reshape(-1, width)[order] if some.num_rows else np.zeros((0, width), U)
    sent = corpus.sparkSession.sparkContext.broadcast((fp[order], some.column(1).to_numpy()[order], near))

    def hits(rows: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fp, item, near = sent.value
        at, found = fingerprints(rows, words, k, span)
        low, high = np.searchsorted(fp, found, "left"), np.searchsorted(fp, found, "right")
        hit = np.flatnonzero(high > low)
        for some in np.array_split(hit, max(1, int((high - low)[hit].sum()) // 50_000)):
            many = (high - low)[some]
            one = np.repeat(some, many)
            two = np.repeat(low[some] - np.cumsum(many) + many, many) + np.arange(len(one))
            good = long_runs(contexts(rows, words, at[one], k, span, 0), near[two], k, span)
            yield rows[at[one[good]]], item[two[good]]

    def scan(batches: Batches) -> Batches:
        split = Words()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for some in pieces(batch.column(1)):
                rows, words = split(batch.column(1)[some])
                for row, item in hits(rows, words):
                    pair = np.unique(np.stack([ids[some][row], item]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["doc_id", "item_id"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(scan, "doc_id long, item_id long").distinct()


def pieces(texts: pa.Array, most: int = 4 * PIECE) -> Iterator[slice]:
    """Runs of texts of about ``most`` bytes together."""
    sizes = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(sizes):
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield slice(low, high)
        low = high


def _joined(docs: DataFrame, tests: DataFrame, k: int, span: int) -> DataFrame:
    """The same by a join on fingerprints; contexts that repeat meet once."""

    def extend(batches: Batches) -> Batches:
        for batch in batches:
            one, two = (batch.column(c).flatten().to_numpy().view(U).reshape(batch.num_rows, -1) for c in (2, 3))
            good = pa.array(long_runs(one, two, k, span) if batch.num_rows else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["doc_id", "item_id"])

    pairs = docs.dropDuplicates().join(tests.withColumnRenamed("context", "other"), "fp")
    return pairs.select("doc_id", "item_id", "context", "other").mapInArrow(extend, "doc_id long, item_id long").distinct()
