"""Scans in two levels against plain sums."""

import random

from pyspark.sql import functions as F

from locusmith.operators import intervals as iv
from locusmith.operators import pileup as pl
from locusmith.operators import scans


def test_step_profile_over_gaps_and_borders(spark):
    rng = random.Random(3)
    for width in (1, 4, 7, 1000):
        steps = {}
        for chrom in ("a", "b", None):
            at = rng.randrange(30)
            for _ in range(rng.randrange(1, 15)):
                steps[chrom, at] = rng.randrange(-2, 5)
                at += rng.choice([1, 1, 2, 3, 8, 29])
        df = spark.createDataFrame([(c, p, v) for (c, p), v in steps.items()], "chrom string, bin long, step long")
        got = {(r["chrom"], r["bin"]): r["depth"] for r in scans.step_profile(df, ["chrom"], "bin", "step", width, "depth").collect()}
        want = {}
        for chrom in ("a", "b", None):
            own = sorted(p for c, p in steps if c == chrom)
            want |= {(chrom, p): sum(steps[chrom, q] for q in own if q <= p) for p in range(own[0], own[-1])}
        assert got == want


def test_sums_before_points(spark):
    rng = random.Random(4)
    values = {(c, p): rng.randrange(9) for c in ("a", "b") for p in rng.sample(range(-20, 200), 60)}
    points = [(c, p, i) for i, (c, p) in enumerate((c, p) for c in ("a", "b", "none") for p in (-50, -20, -1, 0, 7, 8, 64, 199, 200, 5000, 7))]
    given = spark.createDataFrame([(c, p, v) for (c, p), v in values.items()], "chrom string, bin long, depth long")
    for width in (1, 8, 10_000):
        got = scans.sums_before(given, spark.createDataFrame(points, "chrom string, bin long, id int"), ["chrom"], "bin", "depth", width, "upto")
        assert got.columns == ["chrom", "bin", "id", "upto"]
        assert sorted(map(tuple, got.collect())) == sorted((c, p, i, sum(v for (d, q), v in values.items() if d == c and q < p)) for c, p, i in points)


def test_no_partition_of_a_chrom(spark):
    """The positions of one chrom are parted into wide bins, of which none has over a fiftieth of them."""
    reads = spark.range(200_000).select(F.lit("1").alias("chrom"), (F.col("id") * 400).alias("start"), (F.col("id") * 400 + 150).alias("stop"))
    profile = pl.coverage(reads)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chrom" in plan
    sizes = [r["count"] for r in profile.groupBy(scans.wide_of("bin", pl.WIDE)).count().collect()]
    assert max(sizes) <= sum(sizes) / 50


def test_merge_over_wide_bins(spark):
    rng = random.Random(9)
    for width in (8, 50, 10_000):
        rows = [(c, s, s + rng.choice([1, 3, 5, 30, 200])) for c in ("1", "2") for s in (rng.randrange(3000) for _ in range(120))]
        got = sorted(map(tuple, iv.merge_intervals(spark.createDataFrame(rows, "chrom string, start long, stop long"), width).collect()))
        want = []
        for c, s, e in sorted(rows):
            if want and want[-1][0] == c and s <= want[-1][2]:
                want[-1] = (c, want[-1][1], max(e, want[-1][2]))
            else:
                want.append((c, s, e))
        assert got == want
