"""Sums of fixed-size vectors over all partitions, and tables of matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.session import shuffle_width

Batches = Iterator[pa.RecordBatch]
#: The widest vector, in numbers, that the driver may receive (1.6 GB of doubles).
WIDEST = 200_000_000
#: Numbers of a slice: what one row of partial sums holds.
SLICE = 1 << 16


def summed(df: DataFrame, partial: Callable[[Batches], np.ndarray], width: int, kind: type = np.float64, tasks: int | None = None) -> np.ndarray:
    """The sum of the vectors of ``width`` numbers that ``partial`` makes of each partition.

    Vectors travel in slices, zero slices not at all, and every reducer owns some slices; the driver receives each slice
    once. Partitions of the input are read several to a task, so partial vectors are as many as the cluster
    has cores, times four (or ``tasks``), however many files there are."""
    if width > WIDEST:
        raise ValueError(f"statistics of {width} numbers are too large for the driver; use fewer features or groups")
    size = np.dtype(kind).itemsize
    tasks = tasks or max(shuffle_width(df.sparkSession), 4 * df.sparkSession.sparkContext.defaultParallelism)

    def first(batches: Batches) -> Batches:
        v = np.ascontiguousarray(partial(batches), kind)
        for k in range(0, width, SLICE):
            part = v[k : k + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE]), pa.array([part.tobytes()], pa.binary())], names=["k", "v"])

    def add(batches: Batches) -> Batches:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(v.as_buffer(), kind)
                if k in out:
                    out[k] += part
                else:
                    out[k] = part.copy()
        for k, v in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.tobytes()], pa.binary())], names=["k", "v"])

    slices = -(-width // SLICE)
    parts = df.coalesce(tasks).mapInArrow(first, "k long, v binary").repartition(min(shuffle_width(df.sparkSession), slices), "k")
    total = np.zeros(width, kind)
    for batch in parts.mapInArrow(add, "k long, v binary").toArrow().to_batches():
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            at = k * SLICE
            total[at : at + len(v.as_py()) // size] = np.frombuffer(v.as_buffer(), kind)
    return total


def matrix_rows(spark: SparkSession, names: tuple[str, str], **values: np.ndarray) -> DataFrame:
    """Matrices of one shape as rows (row, column, values)."""
    shape = next(iter(values.values())).shape
    i, j = np.indices(shape)
    return spark.createDataFrame(pa.table({names[0]: i.reshape(-1), names[1]: j.reshape(-1)} | {k: np.ascontiguousarray(v).reshape(-1) for k, v in values.items()}))
