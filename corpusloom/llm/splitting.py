"""Splitting oversized items at natural boundaries: pointer doubling.

Every boundary of a text is joined to its farthest legal successor, overlap included: a piece that follows a cut
at token e begins at e - overlap (at the next whole character below) and may end at most ``limit`` tokens later. Of the boundaries in reach, those of
the coarsest kind (file, hunk, paragraph, line) found in the farther half win, and of these the farthest; without any
there, the farthest of the nearer half; only without any at all, a cut between two tokens. The successor table is then squared: after k rounds it leads over 2^k cuts, and the cuts known so far lead to as many
new ones. So all greedy cuts of all texts of a batch come out in log2(pieces) vector steps instead of one after another.

Sizes are tokens of the whole text. A piece that is tokenized by itself may have more of them where a cut parts what the tokenizer's pattern
keeps together, so windows leave ``reserve`` tokens free. A cut behind a line end can only part a run of white space: where that
has at most half of ``reserve`` bytes, the piece fits for sure. Any other piece is tokenized by itself, and a text with one above the limit is
split again with twice the reserve.

Texts are independent rows, so there is no shuffle; a text of at most ``limit`` bytes cannot have more tokens and is
not tokenized. Defined results: null and empty texts and those within the limit give no pieces; equal rows give equal pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.bags import Batches
from corpusloom.llm.tokens import RANKS, Tokenizer, tokenizer

#: Kinds of boundaries from the coarsest; a cut stands where the match ends, or before it for files and hunks.
KINDS = ("file", "hunk", "paragraph", "line", "token", "end")
STARTS = [(0, re.compile(rb"^diff --git ", re.M)), (1, re.compile(rb"^@@ ", re.M))]
PARAGRAPH = re.compile(rb"\n[ \t\r]*\n")
#: Tokens of texts that are split in one step.
STEP_TOKENS = 1 << 21


def boundary_kinds(text: bytes, ends: np.ndarray) -> np.ndarray:
    """The kind of the boundary at each token position 0 .. n: an index of KINDS, or 9 where a cut would part a character."""
    data = np.frombuffer(text, np.uint8)
    at = np.r_[0, ends]
    inner = at[:-1]
    kinds = np.full(len(at), 4, np.uint8)
    kinds[:-1][(data[inner] & 0xC0) == 0x80] = 9
    line = np.zeros(len(data) + 1, bool)
    line[1:] = data == 10
    kinds[line[at]] = 3
    where = {}
    for m in PARAGRAPH.finditer(text):
        where[m.end()] = 2
    for kind, pattern in reversed(STARTS):
        for m in pattern.finditer(text):
            where[m.start()] = kind
    if where:
        places = np.fromiter(where, np.int64, len(where))
        k = np.searchsorted(at, places)
        hit = at[np.minimum(k, len(at) - 1)] == places
        kinds[k[hit]] = np.fromiter(where.values(), np.uint8, len(where))[hit]
    kinds[0] = kinds[-1] = 5
    return kinds


def successors(kinds: np.ndarray, first: np.ndarray, last: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, next): for every token position taken as a cut, where the following piece begins and ends.

    Positions of several texts stand one after the other; ``first`` and ``last`` give each position its text's.
    """
    n = len(kinds)
    position = np.arange(n)
    # the nearest position at or below that parts no character
    whole = np.maximum.accumulate(np.where(kinds != 9, position, 0))
    start = np.where(position == first, first, whole[np.maximum(position - overlap, first)])
    reach = np.minimum(start + limit, last)
    half = np.maximum(position, (position + reach) // 2)
    out = np.where(reach == last, last, 0)
    choices = [(kinds == k, half) for k in range(4)] + [(kinds < 4, position), (kinds == 4, position)]
    for there, floor in choices:
        farthest = np.maximum.accumulate(np.where(there, position, -1))[reach]
        out = np.where((out == 0) & (farthest > floor), farthest, out)
    return start, np.where(out > position, out, last)  # a window without any whole character ends the text


def cuts(after: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """All positions reached from ``heads`` by following ``after``: marks grow while the table is squared."""
    known, jump = heads, after
    while True:
        grown = np.union1d(known, jump[known])
        if len(grown) == len(known):
            return known
        known, jump = grown, jump[jump]


def split_texts(texts: list[bytes], ends: list[np.ndarray], limit: int, overlap: int) -> list[np.ndarray]:
    """For each text an array of pieces (first token, token after the last, kind of the cut at its end)."""
    kinds = [boundary_kinds(t, e) for t, e in zip(texts, ends)]
    sizes = np.array([len(k) for k in kinds])
    heads = np.cumsum(sizes) - sizes
    first, last = np.repeat(heads, sizes), np.repeat(heads + sizes - 1, sizes)
    kinds = np.concatenate(kinds)
    start, after = successors(kinds, first, last, limit, overlap)
    reached = cuts(after, heads)
    reached = reached[reached != last[reached]]
    pieces = np.stack([start[reached] - first[reached], after[reached] - first[reached], kinds[after[reached]]], axis=1)
    return np.split(pieces, np.searchsorted(reached, heads[1:]))


def plain_cut(text: bytes, at: int, most: int) -> bool:
    """Whether a cut is at an end of the text, or parts at most a run of ``most`` bytes of ASCII white space behind a line end."""
    if at in (0, len(text)):
        return True
    if text[at - 1] != 10 or text[at] >= 128:  # other white space may follow
        return False
    left, right = text[max(at - most, 0) : at], text[at : at + most]
    run = len(left) - len(left.rstrip()) + len(right) - len(right.lstrip())
    return run <= most and text[at + len(right) - len(right.lstrip()) :][:1] < b"\x80"


def split_documents(docs: DataFrame, limit: int = 2048, overlap: int = 128, reserve: int = 16, tokens: str = RANKS) -> DataFrame:
    """(doc_id, piece, n_tokens, overlap, cut, text) of the documents (doc_id, text) with more than ``limit`` tokens: pieces in
    order from 0, their tokens, how many of them the piece before has too, the kind of boundary at their end."""
    if not 0 <= 2 * overlap < limit - reserve:
        raise ValueError("overlap must be less than half of what a piece may hold")

    def emit(batches: Batches) -> Batches:
        encoder = tokenizer(tokens)
        for batch in batches:
            ids, texts, ends, waiting = [], [], [], 0
            for row, text in enumerate(batch.column(1)):
                whole = text.as_py()
                end = encoder.ends(whole)
                if len(end) > limit:
                    ids.append(row)
                    texts.append(whole.encode())
                    ends.append(end)
                    waiting += len(end)
                if waiting >= STEP_TOKENS:
                    yield out(batch, ids, texts, ends)
                    ids, texts, ends, waiting = [], [], [], 0
            if ids:
                yield out(batch, ids, texts, ends)

    def fitting(encoder: Tokenizer, texts: list[bytes], ends: list[np.ndarray]) -> list[np.ndarray]:
        free, todo, done = reserve, list(range(len(texts))), [np.zeros((0, 3), np.int64)] * len(texts)
        while todo:
            for k, pieces in zip(todo, split_texts([texts[k] for k in todo], [ends[k] for k in todo], limit - free, overlap)):
                done[k] = pieces
            free *= 2
            if 2 * overlap >= limit - free:
                break
            todo = [k for k in todo if too_long(encoder, texts[k], np.r_[0, ends[k]], done[k])]
        return done

    def too_long(encoder: Tokenizer, text: bytes, at: np.ndarray, pieces: np.ndarray) -> bool:
        for a, b, _ in pieces.tolist():
            if not (plain_cut(text, int(at[a]), reserve // 2) and plain_cut(text, int(at[b]), reserve // 2)) and encoder.count(text[at[a] : at[b]].decode()) > limit:
                return True
        return False

    def out(batch: pa.RecordBatch, ids: list[int], texts: list[bytes], ends: list[np.ndarray]) -> pa.RecordBatch:
        rows = []
        for row, text, end, pieces in zip(ids, texts, ends, fitting(tokenizer(tokens), texts, ends)):
            at = np.r_[0, end]
            before = 0
            for k, (a, b, kind) in enumerate(pieces.tolist()):
                rows.append((row, k, b - a, before - a if k else 0, KINDS[kind], text[at[a] : at[b]].decode()))
                before = b
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:4]), *map(pa.array, cols[4:])],
            names=["doc_id", "piece", "n_tokens", "overlap", "cut", "text"],
        )

    long = docs.select("doc_id", "text").where(F.octet_length("text") > limit)
    return long.mapInArrow(emit, "doc_id long, piece long, n_tokens long, overlap long, cut string, text string")
