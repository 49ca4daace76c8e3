import random

import pytest
from pyspark.sql import functions as F

from locusmith.operators import intervals as iv
from locusmith.plans.registry import queries

COLS = "chrom string, start long, stop long"


def frame(spark, rows, chrom="1"):
    return spark.createDataFrame([(chrom, a, b) for a, b in rows], COLS)


def rows(df):
    return sorted((r["start"], r["stop"]) for r in df.collect())


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ([(300, 400), (100, 200), (150, 250), (400, 500)], [(100, 250), (300, 500)]),
        ([(0, 100), (100, 200)], [(0, 200)]),
        ([(1000, 500000), (2000, 2100), (3000, 3100)], [(1000, 500000)]),
        ([], []),
        ([(0, 3_000_000), (1_048_500, 1_048_700), (3_000_001, 3_000_002)], [(0, 3_000_000), (3_000_001, 3_000_002)]),
    ],
)
def test_merge(spark, given, expected):
    assert rows(iv.merge_intervals(frame(spark, given))) == expected


def test_contained_and_overlapping(spark):
    merged = frame(spark, [(100, 250), (300, 500)])
    asked = frame(spark, [(100, 200), (120, 180), (90, 150), (180, 260), (250, 300), (100, 251)])
    assert rows(iv.contained_in(asked, merged)) == [(100, 200), (120, 180)]
    asked = frame(spark, [(0, 50), (0, 101), (150, 160), (250, 300), (249, 260), (299, 310)])
    assert rows(iv.overlapping(asked, merged)) == [(0, 101), (150, 160), (249, 260), (299, 310)]
    assert rows(iv.not_overlapping(asked, merged)) == [(0, 50), (250, 300)]


def test_random_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(s, s + rng.randrange(1, 60_000)) for s in (rng.randrange(500_000) for _ in range(n))]
    left, right = make(120), make(60)
    got = sorted((r["start"], r["stop"], r["r_start"], r["r_stop"]) for r in iv.overlap_join(frame(spark, left), frame(spark, right)).collect())
    assert got == sorted((a, b, c, d) for a, b in left for c, d in right if a < d and b > c)


def test_cascade_reaches_every_outcome(spark):
    candidates = frame(spark, [(100, 200), (1000, 1100), (2000, 2100), (3000, 3100), (9000, 9100)])
    truth = spark.createDataFrame([("1", 105, 205, 2), ("1", 2080, 2500, 1)], COLS + ", geno int")
    out = iv.label_candidates(candidates, truth, frame(spark, [(1050, 1060)]), frame(spark, [(0, 5000)]))
    got = {r["start"]: (r["outcome"], r["label"], r["geno"]) for r in out.collect()}
    assert got == {100: ("tp", 1, 2), 1000: ("drop_ambiguous", None, None), 2000: ("drop_below_reciprocal", None, None), 3000: ("fp", 0, 0), 9000: ("drop_unconfident", None, None)}
    assert iv.check_balance(out) == 0.5
    with pytest.raises(ValueError):
        iv.check_balance(out.where("outcome = 'tp'"))


def runs(values):
    """How many runs of equal values there are."""
    return sum(1 for i, v in enumerate(values) if not i or v != values[i - 1])


def by_task(df):
    tasks = {}
    for row in df.withColumn("_task", F.spark_partition_id()).collect():
        tasks.setdefault(row["_task"], []).append(row)
    return tasks.values()


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_clustered_pairs_are_whole_and_lie_in_order(spark, broadcast):
    rng = random.Random(2)
    make = lambda n: [(s, s + rng.randrange(1, 20_000)) for s in (rng.randrange(50_000) for _ in range(n))]
    left, right = make(90) * 2, [*make(70), (100, 100)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        pairs = iv.overlap_join(frame(spark, left), frame(spark, right), clustered=True)
        tasks = [[(r["start"], r["stop"], r["r_start"], r["r_stop"]) for r in rows] for rows in by_task(pairs)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(pair for rows in tasks for pair in rows) == sorted((a, b, c, d) for a, b in left for c, d in right if a < d and b > c)
    for rows in tasks:
        bins = [max(a, c) // iv.WIDTH for a, _, c, _ in rows]
        assert runs(bins) == len(set(bins))
        assert runs(list(zip(bins, [r[:2] for r in rows], strict=True))) == len(set(zip(bins, [r[:2] for r in rows], strict=True)))


def test_read_windows_come_grouped_by_read(spark):
    found = queries()["j7_read_windows"](spark, "/root/testdata/sf0.001")
    for rows in by_task(found):
        at = [(r["chrom"], max(r["win_start"], r["read_start"]) // iv.WIDTH) for r in rows]
        assert runs(at) == len(set(at))
        for (one, row), (two, after) in zip(zip(at, rows, strict=True), zip(at[1:], rows[1:], strict=True)):
            assert one != two or row["read_start"] <= after["read_start"]
            assert row["read_id"] != after["read_id"] or one != two or row["win_start"] <= after["win_start"]


def test_reciprocal_pairs_come_grouped_by_candidate(spark):
    found = queries()["j4_reciprocal_overlap"](spark, "/root/testdata/sf0.01")
    for rows in by_task(found):
        at = [(r["chrom"], max(r["start"], r["t_start"]) // iv.WIDTH) for r in rows]
        assert runs(at) == len(set(at))
        for (one, row), (two, after) in zip(zip(at, rows, strict=True), zip(at[1:], rows[1:], strict=True)):
            assert one != two or (row["start"], row["stop"], row["t_start"]) <= (after["start"], after["stop"], after["t_start"])


def test_tasks_of_written_pairs_have_few_ids(spark):
    """Pairs that repeat an id of each left row: more rows make more tasks and narrower bins, with the same pairs; few rows leave them as they were."""
    reads = spark.range(60_000).select(F.floor(F.col("id") % 1500 / 1500 + 1).cast("string").alias("chrom"), (F.col("id") % 1500 * 7).alias("start"), (F.col("id") % 1500 * 7 + 50).alias("stop"), F.concat(F.lit("read:"), "id").alias("read_id"))
    windows = spark.createDataFrame([("1", 0, 900), ("1", 800, 15_000), ("2", 0, 9000)], "chrom string, start long, stop long")
    how = iv.together(reads)
    assert how["tasks"] == 8 and how["width"] == 1024 and iv.together(reads.limit(100)) == {"width": 2048, "tasks": 1}
    pairs = iv.overlap_join(reads, windows, "w_", clustered=True, **how)
    held = pairs.select("read_id").rdd.mapPartitions(lambda rows: [len({r[0] for r in rows})]).collect()
    plain = iv.overlap_join(reads, windows, "w_").select(*pairs.columns)
    assert sum(held) >= 60_000 and max(held) < 25_000 and pairs.count() == plain.count() and pairs.exceptAll(plain).isEmpty()
