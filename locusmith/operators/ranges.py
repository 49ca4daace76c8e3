"""Running sums, row numbers, first rows and quantiles in groups of any size: each group is cut into ranges of its order, and a task sorts one range.

The cuts of a group are keys drawn by hash, so they follow the distribution of the keys and are the same in every run:
one of each of ``RANGES`` residue classes, and one in ``STEP`` of all others, so a range has about ``STEP`` keys however
many a group has. Nulls in the grouping columns form groups as in ``groupBy``; a null key comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

RANGES, STEP = 64, 50_000
#: Rows of a group meet its cuts in as many parts, so that no join key has a whole group.
PARTS = 64
#: Rows up to which a table of sums is run over in plain windows: no group of it is more than one task sorts in memory.
FEW = 200_000


def places(marks: Column, key: Column, powers: Column) -> Column:
    """How many of the ascending array ``marks`` are at or below the key: a search by halves over ``powers`` (see ``halves``)."""
    below = lambda n: (n <= F.size(marks)) & F.coalesce(F.get(marks, n - 1) <= key, F.lit(False))
    return F.aggregate(powers, F.lit(0), lambda found, step: F.when(below(found + step), found + step).otherwise(found))


def halves(size: Column) -> Column:
    """The powers of two up to ``size``, descending."""
    digits = F.when(size > 0, F.length(F.bin(size))).otherwise(0)
    return F.slice(F.array(*[F.lit(1 << b) for b in reversed(range(31))]), F.lit(32) - digits, digits)


def cut(rows: DataFrame, groups: list[str], order: list[str], ranges: int = RANGES, step: int = STEP) -> DataFrame:
    """Adds ``_group``, ``_key`` and ``_range``, the number of the group's cuts at or below the key.

    The cuts are found with partial aggregation, and meet the rows by group and part.
    """
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    keyed = rows.withColumns({"_group": F.struct(F.lit(0).alias("none"), *groups), "_key": key})
    place = F.xxhash64("_key")
    residue = F.when(F.pmod(place, F.lit(step)) == 0, place).otherwise(F.pmod(place, F.lit(ranges)))
    drawn = keyed.groupBy("_group", residue.alias("_class")).agg(F.min_by("_key", place).alias("_cut"))
    cuts = drawn.groupBy("_group").agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
    spread = cuts.withColumn("_halves", halves(F.size("_cuts"))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = keyed.withColumn("_part", F.pmod(place, F.lit(PARTS)).cast("int")).join(spread, ["_group", "_part"])
    return met.withColumn("_range", places(F.col("_cuts"), F.col("_key"), F.col("_halves"))).drop("_cuts", "_halves", "_part")


def _with_starts(ranged: DataFrame, sums: list[str]) -> DataFrame:
    """Adds, of every column c of ``sums``, ``_before_c``, its sum in the group's earlier ranges, and ``c_all``, its sum in the group."""
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = ranged.groupBy("_group", "_range").agg(*[F.sum(c).alias(c) for c in sums])
    own = [column for c in sums for column in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}"), F.sum(c).over(whole).alias(f"{c}_all"))]
    return ranged.join(each.select("_group", "_range", *own), ["_group", "_range"])


def running(rows: DataFrame, groups: list[str], order: list[str], sums: list[str], kept: bool = False) -> DataFrame:
    """Adds, of every column c of ``sums``, ``c_upto``, its sum up to and with the row's key, and ``c_all``, its sum in the group.

    The rows are stored once (unless the caller has, with ``kept``) and counted; up to ``FEW`` are run over in plain windows.
    """
    kept = rows if kept else stored(rows)
    if kept.count() <= FEW:
        whole = Window.partitionBy(*groups, F.lit(0))
        upto = whole.orderBy(*order)
        return kept.withColumns({f"{c}_{s}": F.sum(c).over(w) for c in sums for s, w in (("upto", upto), ("all", whole))})
    within = Window.partitionBy("_group", "_range").orderBy("_key")
    started = _with_starts(cut(kept, groups, order), sums)
    return started.withColumns({f"{c}_upto": F.col(f"_before_{c}") + F.sum(c).over(within) for c in sums}).select(*rows.columns, *[f"{c}_{s}" for c in sums for s in ("upto", "all")])


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Adds ``_at``, the row's number in its group from 0, and ``_all``, the group's rows; rows of one key are numbered in any order."""
    started = _with_starts(cut(rows.withColumn("_one", F.lit(1).cast("long")), groups, order), ["_one"])
    at = F.row_number().over(Window.partitionBy("_group", "_range").orderBy("_key")) - 1
    return started.withColumn("_at", F.col("_before__one") + at).select(*rows.columns, "_at", F.col("_one_all").alias("_all"))


def meet(rows: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Joins rows to a table of one row a group, in ``PARTS`` parts told by the columns ``by``, so that no key has a whole group."""
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))
    return parted.join(few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*on, "_part"], how).drop("_part")


def mark_firsts(rows: DataFrame, groups: list[str], order: list[str], limits: DataFrame, limit: str, name: str) -> DataFrame:
    """Adds whether a row is among the first of its group by ``order``, as many as ``limit`` of ``limits`` (a row a group) says; none without a limit.

    The rows are stored once. Ranges are counted: rows of ranges within the limit are in, rows of ranges beyond it out,
    and only the range in which the limit lies is sorted. Of rows of one key, any are taken.
    """
    kept = stored(rows)
    own = limits.select(*groups, F.col(limit).alias("_limit"))
    if kept.count() <= FEW:
        at = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return kept.withColumn("_at", at).join(own, groups, "left").select(*rows.columns, F.coalesce(F.col("_at") <= F.col("_limit"), F.lit(False)).alias(name))
    ranged = cut(kept, groups, order)
    counts = ranged.groupBy("_group", *groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(own, groups, "left")
    open_ = F.coalesce(F.col("_limit") - F.col("_before"), F.lit(0))
    met = ranged.join(reached.select("_group", "_range", open_.alias("_open"), "_n"), ["_group", "_range"])
    inside = (F.col("_open") > 0) & (F.col("_open") < F.col("_n"))
    plain = met.where(~inside).select(*rows.columns, (F.col("_open") > 0).alias(name))
    sorted_ = met.where(inside).withColumn("_at", F.row_number().over(Window.partitionBy("_group", "_range").orderBy("_key")))
    return plain.unionByName(sorted_.select(*rows.columns, (F.col("_at") <= F.col("_open")).alias(name)))


def firsts(rows: DataFrame, groups: list[str], order: list[str], limits: DataFrame, limit: str) -> DataFrame:
    """The rows that ``mark_firsts`` marks."""
    return mark_firsts(rows, groups, order, limits, limit, "_first").where("_first").drop("_first")


def quantiles(rows: DataFrame, groups: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(groups, ``quantiles``, ``n``): exact quantiles, linear between neighbours, of each group's values that are not null.

    Values are counted before they are run over, and a quantile takes the values that fill the places about it, so a
    group is never in one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    ran = running(counted, groups, [value], ["_c"])
    begin, end, last = F.col("_c_upto") - F.col("_c"), F.col("_c_upto") - 1, F.col("_c_all") - 1
    filled = lambda at: F.max(F.when((at >= begin) & (at <= end), F.col(value)))
    each = []
    for i, p in enumerate(probabilities):
        at = last * F.lit(float(p))
        each += [filled(F.floor(at)).alias(f"_low{i}"), filled(F.ceil(at)).alias(f"_high{i}")]
    points = ran.groupBy(*groups).agg(*each, F.max("_c_all").alias("n"))

    def between(i: int, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return points.select(*groups, F.array(*[between(i, p) for i, p in enumerate(probabilities)]).alias("quantiles"), "n")
