"""Frequency of every distinct term: last-seen counters.

Tokens are hash-partitioned by record, so no hot term gathers in one task, and each partition is ordered by record and place. A record with
places from PLACES on may be hot: its deliveries are told apart first, by record and place, and its tokens are partitioned by record and term. A term's counter holds occurrences, records and the last record seen; a token
adds a record only if that last record is another one, so no set of records is kept. Partial counters are then added by term.

Counters of a task are flushed between two records once there are ``most_terms`` of them, which bounds its memory;
as they only add up, the result stays exact.

Defined results: tokens with a null or blank term, a null frequency or one below 1, or no record id do not count;
deliveries of one token (same record and place) count once, of different ones the least term with the lowest frequency; without a place, equal rows count once;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.terms import term
from corpusloom.llm.bags import Batches
from corpusloom.plans.session import cut, input_width

#: Rows that are counted in one vectorised step.
CHUNK = 1 << 18
#: A record with a place outside 0 .. PLACES - 1 is spread over tasks.
PLACES = 1 << 16
#: Stands for a missing place.
NOWHERE = -(1 << 62)


class Counters:
    """Last-seen counters: occurrences, records and last record of each term."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.all = [np.zeros(1024, np.int64) for _ in range(3)]

    def add(self, terms: pa.Array, records: np.ndarray, weights: np.ndarray) -> None:
        """Tokens in the order of their records, no record having been added before but the last one."""
        coded = pc.dictionary_encode(terms)
        own = np.array([self.index.setdefault(t, len(self.index)) for t in coded.dictionary.to_pylist()], np.int64)
        if len(self.index) > len(self.all[0]):
            self.all = [np.concatenate([x, np.zeros(max(len(x), len(self.index)), np.int64)]) for x in self.all]
        occurrences, seen, last = self.all
        which = own[coded.indices.to_numpy()]
        order = np.argsort(which, kind="stable")
        which, records = which[order], records[order]
        first = np.r_[True, which[1:] != which[:-1]]
        heads = np.flatnonzero(first)
        before = np.r_[0, records[:-1]]
        before[heads] = last[which[heads]]
        fresh = (records != before) | first & (seen[which] == 0)
        occurrences[which[heads]] += np.add.reduceat(weights[order], heads)
        seen[which[heads]] += np.add.reduceat(fresh.astype(np.int64), heads)
        last[which[heads]] = records[np.r_[heads[1:], len(records)] - 1]

    def rows(self) -> pa.RecordBatch:
        n = len(self.index)
        return pa.RecordBatch.from_arrays([pa.array(list(self.index), pa.string()), pa.array(self.all[0][:n]), pa.array(self.all[1][:n])], names=["ts", "n_total", "n_records"])


def term_frequencies(tokens: DataFrame, most_terms: int = 1_000_000) -> DataFrame:
    """(ts, n_total, n_records) of tokens (review_id, pos, ts, tfreq): total frequency and records of every term."""
    good = tokens.select("review_id", "pos", term(F.col("ts")).alias("t"), "tfreq").where("review_id IS NOT NULL AND t <> '' AND tfreq >= 1")
    width, parts = input_width(tokens), [(good, ["review_id"])]
    far = good.where((F.col("pos") < 0) | (F.col("pos") >= PLACES)).select("review_id")
    if not far.isEmpty():
        hot = cut(far.distinct())
        key = ["review_id", "pos", F.when(F.col("pos").isNull(), F.struct("t", "tfreq")).alias("_own")]
        once = good.join(hot, "review_id", "left_semi").groupBy(*key).agg(F.min(F.struct("t", "tfreq")).alias("_v")).select("review_id", "pos", "_v.t", "_v.tfreq")
        parts = [(good.join(hot, "review_id", "left_anti"), ["review_id"]), (once, ["review_id", "t"])]

    def count(batches: Batches) -> Batches:
        counters, waiting, rows, last = Counters(), [], 0, (None, None, None, None)

        def take() -> tuple:
            nonlocal waiting, rows, last
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting, rows = [], 0
            rec = table.column(0).to_numpy()
            pos = table.column(1).fill_null(NOWHERE).to_numpy()
            terms, freq = table.column(2).combine_chunks(), table.column(3).to_numpy()
            code = pc.dictionary_encode(terms).indices.to_numpy()
            other = (pos[1:] == NOWHERE) & ((code[1:] != code[:-1]) | (freq[1:] != freq[:-1]))
            now = (rec[0], pos[0], terms[0].as_py(), freq[0])
            new = np.r_[now[:2] != last[:2] or pos[0] == NOWHERE and now != last, (rec[1:] != rec[:-1]) | (pos[1:] != pos[:-1]) | other]
            apart = rec[0] != last[0]
            last = (rec[-1], pos[-1], terms[-1].as_py(), freq[-1])
            return apart, terms.filter(pa.array(new)), rec[new], freq[new].astype(np.int64)

        for batch in batches:
            if not batch.num_rows:
                continue
            pos = batch.column(1).cast(pa.int64())
            waiting.append(pa.RecordBatch.from_arrays([batch.column(0), pos, batch.column(2), batch.column(3)], names=["r", "p", "t", "f"]))
            rows += batch.num_rows
            if rows >= CHUNK:
                apart, *tokens = take()
                if apart and len(counters.index) >= most_terms:
                    yield counters.rows()
                    counters = Counters()
                if len(tokens[1]):
                    counters.add(*tokens)
        if rows:
            _, *tokens = take()
            if len(tokens[1]):
                counters.add(*tokens)
        yield counters.rows()

    sorted_ = [p.repartition(width, *by).sortWithinPartitions("review_id", "pos", "t", "tfreq") for p, by in parts]
    partial = reduce(DataFrame.union, [p.mapInArrow(count, "ts string, n_total long, n_records long") for p in sorted_])
    return partial.groupBy("ts").agg(F.sum("n_total").alias("n_total"), F.sum("n_records").alias("n_records"))


def marked(frequencies: DataFrame, n_all: int, least: int = 2, share: float = 0.5) -> DataFrame:
    """``frequencies`` with ``mark``: rare where fewer than ``least`` records hold the term, else common where more than
    ``share`` of ``n_all`` records do, else null."""
    mark = F.when(F.col("n_records") < least, "rare").when(F.col("n_records") > share * n_all, "common")
    return frequencies.withColumn("mark", mark)
