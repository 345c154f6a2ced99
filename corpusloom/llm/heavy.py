"""Most frequent items among billions: a hierarchical count-sketch over prefixes of hash bits.

First scan: every row's term is hashed to 64 bits; for each level, a prefix of the hash is counted in a count-sketch
(``depth`` rows of ``width`` counters, signed hashes). The shortest prefixes are few and counted exactly. Sketches
are linear: tasks add their own, the sums are added by slices. Memory is that of the counters, which follow from ``share`` alone,
whatever the number of rows or distinct values; a share that needs more than ``most_cells`` of them is refused.

Width. What no term of ``share`` holds has a second moment of at most share * N * N, so with width = 32 / share a row's standard error is at
most share * N / sqrt(32); a row is off by half of share * N only beyond 2.8 of these, or where two of the at most 2 / share heavier
prefixes meet, and an estimate (the median of 7 rows) only where four rows are. So prefixes from half of the threshold on are kept.

Descent: from the short prefixes that reach the threshold to their children, twice, to prefixes of about 40 bits: the candidates, at most
``8 / share`` at each level (checked).

Second scan: rows whose hash begins with a candidate are counted by term. The counts are exact, so a result never holds a
term below the threshold.

Defined results: null and blank terms count in the total only; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.terms import term
from corpusloom.llm.bags import BLANK, STEP, Batches, U, mix
from corpusloom.plans.partial import summed

#: Bits that each level adds to the prefixes; there are two sketched levels.
STEP_BITS, LEVELS = 12, 3
#: Rows whose equal hashes are added up before they reach the sketch.
CHUNK = 1 << 19


class Sketch:
    """A count-sketch for each level of prefixes, as one vector of counters that can be added to another's."""

    def __init__(self, share: float, cells: np.ndarray | None = None, depth: int = 7, most_cells: int = 1 << 26) -> None:
        if not 0 < share <= 1:
            raise ValueError("share must be above 0 and at most 1")
        self.share, self.depth = share, depth
        self.width = 1 << ceil(log2(32 / share))
        #: Bits of the prefixes of each level; the first level is counted exactly.
        first = max(12, ceil(log2(8 / share)))
        self.bits = tuple(first + STEP_BITS * k for k in range(LEVELS))
        self.exact = 1 << first
        self.size = 1 + self.exact + (LEVELS - 1) * depth * self.width
        if self.size > most_cells:
            raise ValueError(f"a share of {share} needs {self.size} counters, more than {most_cells}")
        self.cells = np.zeros(self.size, np.int64) if cells is None else cells

    def _table(self, level: int, row: int) -> np.ndarray:
        at = 1 + self.exact + ((level - 1) * self.depth + row) * self.width
        return self.cells[at : at + self.width]

    def _places(self, prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        z = mix(prefix + U((level * self.depth + row + 1) * STEP & (1 << 64) - 1))
        return (z % U(self.width)).astype(np.intp), np.where(z >> U(63) == 1, 1, -1)

    def add(self, hashes: np.ndarray) -> None:
        self.cells[0] += len(hashes)
        h, n = np.unique(hashes[hashes.view(np.int64) != BLANK], return_counts=True)
        for level, bits in enumerate(self.bits):
            prefix = h >> U(64 - bits)
            if level == 0:
                self.cells[1 : 1 + self.exact] += np.bincount(prefix.astype(np.intp), n, self.exact).astype(np.int64)
                continue
            for row in range(self.depth):
                place, sign = self._places(prefix, level, row)
                self._table(level, row)[:] += np.bincount(place, n * sign, self.width).astype(np.int64)

    def estimates(self, prefix: np.ndarray, level: int) -> np.ndarray:
        rows = []
        for row in range(self.depth):
            place, sign = self._places(prefix, level, row)
            rows.append(self._table(level, row)[place] * sign)
        return np.median(rows, axis=0)

    def heavy(self, least: float) -> dict[int, int]:
        """Prefixes of the last level with an estimate of at least half of ``least``: prefix to estimate."""
        short, most = self.cells[1 : 1 + self.exact], ceil(8 / self.share)
        found, counts = np.flatnonzero(short >= max(least, 1)).astype(U), None
        for level in range(1, LEVELS):
            kept = []
            for some in np.array_split(found, max(1, len(found) // 64)):
                child = (some[:, None] << U(STEP_BITS) | np.arange(1 << STEP_BITS, dtype=U)[None, :]).reshape(-1)
                value = self.estimates(child, level) if len(child) else np.zeros(0)
                on = value >= max(least / 2, 0.5)
                kept.append((child[on], value[on]))
            found, counts = (np.concatenate(x) for x in zip(*kept))
            if len(found) > most:
                raise ArithmeticError(f"{len(found)} prefixes seem heavy, more than {most}: the sketch does not tell this input's terms apart")
        return dict(zip(found.astype(np.int64).tolist(), np.round(counts).astype(np.int64).tolist()))


#: Candidates that are written into the plan; more are sent as a table.
IN_PLAN = 1000


def heavy_hitters(values: DataFrame, column: str, share: float, most_cells: int = 1 << 26) -> DataFrame:
    """(ts, estimate, n_rows, n_all): the terms of a column that at least ``share`` of all rows hold, whatever else the rows hold, with the
    sketch's estimate and the exact number of their rows, and the number of all rows."""
    spark = values.sparkSession
    hashed = values.select(F.xxhash64(term(F.coalesce(F.col(column), F.lit("")))).alias("h"))
    empty = Sketch(share, most_cells=most_cells)
    chunk = max(CHUNK, empty.width)

    def partial(batches: Batches) -> np.ndarray:
        sketch, waiting, rows = Sketch(share, most_cells=most_cells), [], 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy().view(U))
            rows += batch.num_rows
            if rows >= chunk:
                sketch.add(np.concatenate(waiting))
                waiting, rows = [], 0
        if waiting:
            sketch.add(np.concatenate(waiting))
        return sketch.cells

    sketch = Sketch(share, summed(hashed, partial, empty.size, np.int64), most_cells=most_cells)
    total = int(sketch.cells[0])
    found = sketch.heavy(share * total)
    if not found:
        return spark.createDataFrame([], "ts string, estimate long, n_rows long, n_all long")
    rows = values.select(term(F.col(column)).alias("ts")).withColumn("h", F.shiftrightunsigned(F.xxhash64("ts"), 64 - sketch.bits[-1]))
    estimates = F.broadcast(spark.createDataFrame(list(found.items()), "h long, estimate long"))  # at most 8 / share rows
    rows = rows.where(F.col("h").isin(list(found))) if len(found) <= IN_PLAN else rows.join(estimates.select("h"), "h", "left_semi")
    counted = rows.groupBy("ts", "h").agg(F.count("*").alias("n_rows")).where((F.col("n_rows") >= share * total) & (F.col("ts") != ""))
    return counted.join(estimates, "h").select("ts", "estimate", "n_rows", F.lit(total).cast("bigint").alias("n_all"))
