"""Adding up arrays that every task counts into, in pieces, so that no task reads more than a few arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

PIECES = 16


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * size, "zstd", asbytes=True), np.int64)


def summed(df: DataFrame, count: Callable[[np.ndarray, pa.RecordBatch], None], size: int) -> np.ndarray:
    """The sum over all tasks of an int64 array of ``size`` entries, a bound on what reaches the driver.

    ``count`` adds a batch of ``df`` to the task's array. The arrays are added in groups of 64 tasks, again and again.
    """
    per_piece = -(-size // PIECES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(per_piece * PIECES, np.int64)
        for batch in batches:
            count(counts, batch)
        for piece, part in enumerate(np.split(counts, PIECES)):
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "counts": pa.array([_packed(part)], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (_unpacked(c, per_piece) for c in pdf["counts"]))
        return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "counts": [_packed(total)]})

    parts = checkpoint(df.mapInArrow(counted, "piece int, counts binary").select("piece", F.spark_partition_id().alias("part"), "counts"))
    tasks = parts.agg(F.max("part")).first()[0]
    while tasks:
        parts = parts.withColumn("part", F.expr("part div 64")).groupBy("piece", "part").applyInPandas(add, "piece int, part int, counts binary")
        tasks //= 64
    pieces = {r["piece"]: _unpacked(r["counts"], per_piece) for r in parts.collect()}
    return np.concatenate([pieces[p] for p in range(PIECES)])[:size] if pieces else np.zeros(size, np.int64)
