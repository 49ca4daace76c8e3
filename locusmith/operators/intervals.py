"""Interval operators on DataFrames with chrom, start and stop (0-based, half-open).

Range joins are equi joins on (chrom, bin): both sides are exploded over bins of ``width`` bases, and a pair counts
only in the bin where the later of the two begins, so no pair appears twice and nothing needs a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 8192
#: Bins of rows that lie together, and about how many rows a task and a bin have: columnar files hold each id of a task once while the ids fit a dictionary page, of 1 MB by default.
NEAR, NEAREST, TOGETHER = 2048, 512, 8192


def bin_of(position: Column | str, width: int = WIDTH) -> Column:
    return F.floor(F.col(position) / width).cast("long") if isinstance(position, str) else F.floor(position / width).cast("long")


def over_bins(df: DataFrame, width: int = WIDTH, name: str = "bin") -> DataFrame:
    """A row for each bin that an interval touches; empty intervals touch none."""
    return df.where(F.col("stop") > F.col("start")).withColumn(name, F.explode(F.sequence(bin_of("start", width), bin_of(F.col("stop") - 1, width))))


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def merge_intervals(df: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Disjoint union per chrom; touching intervals merge.

    Every wide bin merges the intervals that begin in it, at most one a start. An island that begins within the reach of
    earlier bins goes on with what they hold; of each bin only these, as one, and its last other island can meet another
    bin's, so the second level sees two rows a bin.
    """
    longest = df.groupBy("chrom", "start").agg(F.max("stop").alias("stop")).withColumn("_wide", bin_of("start", width))
    local = _islands(longest, ["chrom", "_wide"])
    along = Window.partitionBy("chrom").orderBy("_wide")
    reach = local.groupBy("chrom", "_wide").agg(F.max("stop").alias("_stop"))
    reach = reach.select("chrom", "_wide", F.max("_stop").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"))
    placed = local.join(reach, ["chrom", "_wide"]).withColumn("_head", F.col("_reach").isNull() | (F.col("start") > F.col("_reach")))
    last = Window.partitionBy("chrom", "_wide", "_head").orderBy(F.desc("start"))
    ranked = placed.withColumn("_last", F.col("_head") & (F.row_number().over(last) == 1))
    inner = ranked.where("_head AND NOT _last").select("chrom", "start", "stop")
    edges = ranked.where("_last OR NOT _head").groupBy("chrom", "_wide", "_last").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    # In a bin, what goes on from earlier bins comes before the last island of its own.
    order = Window.partitionBy("chrom").orderBy("_wide", "_last")
    owned = edges.withColumn("_from", F.last(F.when(F.col("_last"), F.col("start")), ignorenulls=True).over(order))
    outer = owned.groupBy("chrom", "_from").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return inner.unionByName(outer.select("chrom", "start", "stop"))


def overlap_join(left: DataFrame, right: DataFrame, prefix: str = "r_", width: int = WIDTH, bin_left: bool = True, clustered: bool = False, tasks: int = 0) -> DataFrame:
    """All pairs with left.start < right.stop and left.stop > right.start; right's columns but chrom get ``prefix``.

    ``clustered`` is for pairs that are written as they are, more of them than of rows: both sides are sorted before they meet, so a left row's pairs
    lie together and neighbours repeat almost the same right rows, which columnar files hold as runs; pairs themselves are never sorted. Tasks stay as
    many as ``spark.sql.shuffle.partitions`` says, or ``tasks`` if that is more (see together), since the size of what goes in, by which Spark would
    merge them, says little of the pairs.
    """
    a = over_bins(left, width, "_bin")
    b = over_bins(right, width, "_bin")
    b = b.select("chrom", "_bin", *[F.col(c).alias(prefix + c) for c in right.columns if c != "chrom"])
    if clustered:
        a = _sorted_by_bin(a, tasks, "start", "stop")
        b = _sorted_by_bin(b, tasks, prefix + "start", prefix + "stop").hint("merge")
    met = (F.col("start") < F.col(f"{prefix}stop")) & (F.col("stop") > F.col(f"{prefix}start"))
    return a.join(b, ["chrom", "_bin"]).where(met & (F.col("_bin") == bin_of(F.greatest(F.col("start"), F.col(f"{prefix}start")), width))).drop("_bin")


def together(df: DataFrame) -> dict[str, int]:
    """``width`` and ``tasks`` for a clustered join whose pairs repeat an id of each left row: narrower bins and more tasks the more rows there are, so that a task writes few ids."""
    rows, bins = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("chrom", bin_of("start", NEAR)))).first()
    width = NEAR
    while width > NEAREST and rows * width > TOGETHER * bins * NEAR:
        width //= 2
    return {"width": width, "tasks": -(-rows // TOGETHER)}


def _sorted_by_bin(df: DataFrame, tasks: int, *first: str) -> DataFrame:
    rest = [c for c in df.columns if c not in ("chrom", "_bin", *first)]
    tasks = max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartition(tasks, "chrom", "_bin").sortWithinPartitions("chrom", "_bin", *first, *rest)
    # Always true; without a filter that isn't deterministic, the optimizer drops a sort below a join.
    return ordered.where(F.spark_partition_id() >= 0)


def _matched(left: DataFrame, right: DataFrame, how: str, width: int) -> DataFrame:
    keys = left.select("chrom", "start", "stop").distinct()
    found = overlap_join(keys, right.select("chrom", "start", "stop"), width=width).select("chrom", "start", "stop").distinct()
    return left.join(found, ["chrom", "start", "stop"], how)


def overlapping(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of left that overlap an interval of right."""
    return _matched(left, right, "left_semi", width)


def not_overlapping(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of left that overlap no interval of right."""
    return _matched(left, right, "left_anti", width)


def overlap_flag(left: DataFrame, right: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """``left`` with whether an interval of right overlaps the row: one range join, reduced to a row for each interval met."""
    keys = ["chrom", "start", "stop"]
    met = overlap_join(left.select(*keys), right.select(*keys), width=width).groupBy(*keys).agg(F.lit(True).alias(name))
    return left.join(met, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def contained_in(left: DataFrame, merged: DataFrame, how: str = "left_semi", width: int = 1 << 16) -> DataFrame:
    """Rows of left that lie wholly inside one interval of ``merged`` (disjoint; see merge_intervals)."""
    wide = over_bins(merged, width, "_bin").select(F.col("chrom").alias("_c"), "_bin", F.col("start").alias("_s"), F.col("stop").alias("_e"))
    inside = (F.col("chrom") == F.col("_c")) & (bin_of("start", width) == F.col("_bin")) & (F.col("start") >= F.col("_s")) & (F.col("stop") <= F.col("_e"))
    return left.join(wide, inside, how)


def reciprocal(start: Column, stop: Column, other_start: Column, other_stop: Column) -> Column:
    """Overlap over the longer length; 0 where the intervals are disjoint or the other is missing."""
    shared = F.least(stop, other_stop) - F.greatest(start, other_start)
    return F.when(other_start.isNull() | (shared <= 0), F.lit(0.0)).otherwise(shared / F.greatest(stop - start, other_stop - other_start))


def reciprocal_pairs(candidates: DataFrame, truth: DataFrame, width: int = WIDTH, clustered: bool = False) -> DataFrame:
    """Overlapping (candidate, truth) pairs with their reciprocal overlap; ``clustered`` as in overlap_join."""
    pairs = overlap_join(candidates, truth, "t_", width, clustered=clustered)
    return pairs.withColumn("ro", reciprocal(F.col("start"), F.col("stop"), F.col("t_start"), F.col("t_stop")))


def _best_overlaps(keys: DataFrame, truth: DataFrame, width: int) -> DataFrame:
    """(chrom, start, stop, _best): the largest reciprocal overlap of each interval met; whole rows of numbers, so pairs are reduced where they are made."""
    return reciprocal_pairs(keys, truth.select("chrom", "start", "stop"), width).groupBy("chrom", "start", "stop").agg(F.max("ro").alias("_best"))


def best_match(candidates: DataFrame, truth: DataFrame, width: int = WIDTH) -> DataFrame:
    """The best truth interval of each candidate that overlaps one; the first in truth order among equals.

    Pairs are made twice: first for the largest overlap alone, then only those that reach it are ranked, so neither a shuffle nor a sort sees all pairs.
    """
    on = ["chrom", "start", "stop"]
    best = _best_overlaps(candidates.select(*on).distinct(), truth, width)
    pairs = reciprocal_pairs(candidates.join(best, on), truth, width).where("ro = _best")
    ranked = pairs.drop("_best").withColumn("_rank", F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("ro"), "t_start", "t_stop", "t_geno")))
    return ranked.where("_rank = 1").drop("_rank")


def label_candidates(candidates: DataFrame, truth: DataFrame, exclude: DataFrame, confident: DataFrame, least: float = 0.5, slop: int = 0) -> DataFrame:
    """Outcome, label and genotype of each distinct candidate, by the cascade: unconfident, true, ambiguous, partial, false."""
    on = ["chrom", "start", "stop"]
    keys = candidates.select(*on).distinct()
    # Truth and exclusions meet the candidates in one range join, which numbers alone reduce to a row for each candidate met;
    # only pairs of the largest overlap are made again for their genotype, as ordering all by structs would sort them.
    true = truth.groupBy(*on).agg(F.min("geno").alias("geno"))
    others = true.select(*on, F.lit(False).alias("out")).unionByName(exclude.select(*on, F.lit(True).alias("out")).distinct())
    pairs = overlap_join(keys, others, "t_").withColumn("ro", F.when(~F.col("t_out"), reciprocal(F.col("start"), F.col("stop"), F.col("t_start"), F.col("t_stop"))))
    found = pairs.groupBy(*on).agg(F.max("ro").alias("ro"), F.max(F.when(F.col("t_out"), F.lit(1))).alias("touched"))
    top = reciprocal_pairs(found.where("ro > 0").select(*on, F.col("ro").alias("_best")), true).where("ro = _best")
    best = top.groupBy(*on).agg(F.min_by("t_geno", F.struct("t_start", "t_stop")).alias("geno"))
    met = found.join(best, on, "left")
    padded = keys.withColumns({"_start": F.col("start"), "_stop": F.col("stop"), "start": F.col("start") - slop, "stop": F.col("stop") + slop})
    inside = contained_in(padded, merge_intervals(confident), "left").select("chrom", F.col("_start").alias("start"), F.col("_stop").alias("stop"), F.when(F.col("_s").isNotNull(), F.lit(True)).alias("sure"))
    flags = inside.join(met, on, "left")
    ro = F.coalesce("ro", F.lit(0.0))
    outcome = (
        F.when(F.col("sure").isNull(), "drop_unconfident")
        .when(ro >= least, "tp")
        .when(F.col("touched").isNotNull(), "drop_ambiguous")
        .when(ro > 0, "drop_below_reciprocal")
        .otherwise("fp")
    )
    label = F.when(F.col("outcome") == "tp", 1).when(F.col("outcome") == "fp", 0)
    return flags.withColumn("outcome", outcome).select(*on, "outcome", label.cast("int").alias("label"), F.when(F.col("outcome") == "tp", F.col("geno")).when(F.col("outcome") == "fp", 0).cast("int").alias("geno"))


def outcome_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def check_balance(labelled: DataFrame, low: float = 0.05, high: float = 0.95) -> float:
    """The share of true among labelled candidates; raises where it is outside [low, high]."""
    share = labelled.where("label IS NOT NULL").agg(F.avg("label")).first()[0]
    if share is None or not low <= share <= high:
        raise ValueError(f"degenerate benchmark: positive fraction {share}")
    return share


def far_from(windows: DataFrame, others: DataFrame, margin: Column | int = 0, width: int = WIDTH) -> DataFrame:
    """Rows of windows that don't overlap any of ``others`` widened by ``margin`` on both sides."""
    margin = margin if isinstance(margin, Column) else F.lit(margin)
    return not_overlapping(windows, others.select("chrom", (F.col("start") - margin).alias("start"), (F.col("stop") + margin).alias("stop")), width)
