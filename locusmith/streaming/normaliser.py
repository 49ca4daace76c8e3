"""The running feature normaliser as a stateful stream: exponential averages of batch means and variances by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, batch long, mean double, var double, n_batches long"
STATE = "last long, mean double, var double, n_batches long"


def running_normaliser(batches: DataFrame, decay: float = 0.99) -> DataFrame:
    """Follows a stream of (key string, batch long, mean, var): a row of the averages after each new batch.

    Batches of a key are taken in order of their number; one that is not above the last is a replay and is skipped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, mean, var, n = state.get if state.exists else (None, 0.0, 0.0, 0)
        rows = []
        for r in pd.concat(frames).sort_values("batch").itertuples():
            if last is not None and r.batch <= last:
                continue
            mean, var = (r.mean, r.var) if n == 0 else (mean * decay + r.mean * (1 - decay), var * decay + r.var * (1 - decay))
            last, n = int(r.batch), n + 1
            rows.append((key[0], last, float(mean), float(var), n))
        if rows:
            state.update((last, float(mean), float(var), n))
        yield pd.DataFrame(rows, columns=["key", "batch", "mean", "var", "n_batches"])

    return batches.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
