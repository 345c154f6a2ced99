"""Additive statistics of a stream of reviews: each micro-batch adds its own, a reader adds them up.

Second moments, sums and counts are linear in the rows, so a stream needs no state: every micro-batch writes its statistics under
its batch id, a batch that is run again replaces its own folder, and solvers read the sum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.moments import Moments, moments
from corpusloom.plans.partial import matrix_rows


def follow(rows: DataFrame, d: int, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the moments of each micro-batch of streamed feature rows (js, xs) to PATH/batch=N."""

    def add(batch: DataFrame, number: int) -> None:
        m = moments(batch, d, [], bias=True)
        matrix_rows(batch.sparkSession, ("i", "j"), s=m.S[0]).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def total(spark: SparkSession, path: str, d: int) -> Moments:
    """Moments of all micro-batches so far; the bias column holds the sums, its own place the count."""
    S = np.zeros((d + 1, d + 1))
    for part in spark.read.parquet(path).groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow().to_batches():  # (d + 1)^2 rows
        S[part.column("i").to_numpy(), part.column("j").to_numpy()] = part.column("s").to_numpy()
    return Moments([()], S[-1:, -1], S[-1:, :], S[None])
