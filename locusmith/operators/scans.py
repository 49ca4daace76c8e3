"""Running sums along a coordinate in two levels: wide bins are summed, their sums are run over, and each wide bin takes up from what it is given.

What a wide bin takes over is a row of its own, put before the bin's other rows, so nothing is joined back; the first
level sees a row a wide bin, and no task more positions than a wide bin has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide_of(position: Column | str, width: int) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / width).cast("long")


def step_profile(steps: DataFrame, keys: list[str], position: str, step: str, width: int, name: str) -> DataFrame:
    """(keys, position, ``name``): at every position from a key's first step to before its last, the sum of the steps so far.

    ``steps`` has a row a position. Wide bins without steps are filled from what they take over.
    """
    own = steps.groupBy(*keys, wide_of(position, width).alias("_wide")).agg(F.sum(step).alias("_sum"), F.min(position).alias("_low"), F.max(position).alias("_high"))
    along = Window.partitionBy(*keys).orderBy("_wide")
    given = F.coalesce(F.sum("_sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wides = own.withColumns({"_given": given, "_next": F.lead("_wide").over(along), "_first": F.lag("_wide").over(along).isNull()})
    # The wide bin itself and the empty ones up to the next.
    wides = wides.withColumn("_at", F.explode(F.sequence("_wide", F.coalesce(F.col("_next") - 1, "_wide"))))
    itself = F.col("_at") == F.col("_wide")
    heads = wides.select(
        *keys, F.col("_at").alias("_wide"), F.when(itself & F.col("_first"), F.col("_low")).otherwise(F.col("_at") * width).alias(position), F.when(itself, F.col("_given")).otherwise(F.col("_given") + F.col("_sum")).alias(step),
        F.when(F.col("_next").isNull(), F.col("_high")).otherwise((F.col("_at") + 1) * width).alias("_until"), F.lit(0).alias("_kind"),
    )
    rows = heads.unionByName(steps.select(*keys, wide_of(position, width).alias("_wide"), position, step, F.lit(None).cast("long").alias("_until"), F.lit(1).alias("_kind")))
    whole = Window.partitionBy(*keys, "_wide")
    order = whole.orderBy(position, "_kind")
    run = rows.select(*keys, position, F.sum(step).over(order).alias(name), F.coalesce(F.lead(position).over(order), F.max("_until").over(whole)).alias("_until"))
    return run.where(F.col("_until") > F.col(position)).select(*keys, F.explode(F.sequence(position, F.col("_until") - 1)).alias(position), name)


def sums_before(values: DataFrame, points: DataFrame, keys: list[str], position: str, value: str, width: int, name: str) -> DataFrame:
    """``points`` with the sum of ``value`` at all smaller positions of their keys; 0 where there are none."""
    extra = [c for c in points.columns if c not in (*keys, position)]
    wide = wide_of(position, width).alias("_wide")
    known = values.groupBy(*keys, wide).agg(F.sum(value).alias("_sum"))
    both = known.unionByName(points.select(*keys, wide).distinct().withColumn("_sum", F.lit(0).cast("long"))).groupBy(*keys, "_wide").agg(F.sum("_sum").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)
    heads = both.select(*keys, "_wide", (F.col("_wide") * width).alias(position), F.sum("_sum").over(before).alias("_value"), F.lit(0).alias("_kind"))
    asked = points.select(*keys, wide_of(position, width).alias("_wide"), position, F.lit(None).cast("long").alias("_value"), F.lit(1).alias("_kind"), *extra)
    given = values.select(*keys, wide_of(position, width).alias("_wide"), position, F.col(value).alias("_value"), F.lit(2).alias("_kind"))
    rows = heads.unionByName(asked, allowMissingColumns=True).unionByName(given, allowMissingColumns=True)
    run = rows.withColumn(name, F.sum("_value").over(Window.partitionBy(*keys, "_wide").orderBy(position, "_kind").rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("_kind = 1").select(*points.columns, F.coalesce(name, F.lit(0)).alias(name))
