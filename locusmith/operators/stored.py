"""Tables that a query uses several times, written once to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.folders import checkpoint_folder


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that what uses them neither computes them again nor depends on one executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()
