"""Random windows, stated counts, Markdown tables, screens and shard files against plain Python."""

import hashlib
import random

import pytest

from locusmith.operators import inference as inf
from locusmith.operators import windows as wn
from locusmith.sources import tables


@pytest.mark.parametrize("n", [3, 60])
def test_random_windows_are_the_first_draws_that_pass(spark, n):
    rng = random.Random(1)
    contigs = {"1": 50_000, "2": 120_000, "short": 3_000}
    reads = [(c, s, s + 150) for c in ("1", "2") for s in (rng.randrange(30_000) for _ in range(400))]
    found = wn.random_windows(
        spark.createDataFrame(list(contigs.items()), "chrom string, length long"), spark.createDataFrame(reads, "chrom string, start long, stop long"), n, (1, 4, 16), (1.0, 2.0, 1.0), 1000, 5, "s"
    ).collect()
    unit = lambda k, what: int(hashlib.md5(f"s|{what}|{k}".encode()).hexdigest()[:13], 16) / 2**52
    want, k = [], 0
    while len(want) < n:
        at, chrom = int(unit(k, "chrom") * 170_000), "1"
        if at >= 50_000:
            chrom = "2"
        u = unit(k, "scale")
        scale = 1 if u < 0.25 else 4 if u < 0.75 else 16
        start = 1000 + int(unit(k, "start") * max(1, contigs[chrom] - 256 * scale - 2000))
        over = sum(c == chrom and s < start + 256 * scale and e > start for c, s, e in reads)
        if over >= 5:
            want.append((k, chrom, start, start + 256 * scale, scale, over))
        k += 1
    assert sorted(map(tuple, found)) == want and (n == 3 or k > 2 * n)


def test_random_windows_end_without_reads(spark):
    contigs = spark.createDataFrame([("1", 50_000)], "chrom string, length long")
    none = spark.createDataFrame([], "chrom string, start long, stop long")
    assert wn.random_windows(contigs, none, 5, (1,), margin=100, most_tries=3000).count() == 0
    assert wn.random_windows(contigs, none, 5, (1,), margin=100_000, most_tries=3000).count() == 0


TEXT = """Run on three seeds, then TEN  seeds and 12 seeds; 123 seeds and bone seeds are none.
| Arm | n_seeds | note |
|:----|--------:|
| a | 4 | x |
|b|five|y|

| Seeds |
|---|
| 9 |
no table
| Arm |
| 3 |"""


def test_stated_counts_and_cells(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "|"), (5, "nothing")], "id long, text string")
    got = sorted((r["id"], r["token"], r["n"]) for r in inf.stated_counts(texts, "id").collect())
    assert got == [(1, "12 seeds", 12), (1, "Seeds 9", 9), (1, "TEN  seeds", 10), (1, "n_seeds 4", 4), (1, "three seeds", 3)]
    cells = {(r["line"], r["heading"]): r["cell"] for r in inf.table_cells(texts, "id").where("id = 1").collect()}
    assert cells == {(3, "Arm"): "a", (3, "n_seeds"): "4", (3, "note"): "x", (4, "Arm"): "b", (4, "n_seeds"): "five", (4, "note"): "y", (8, "Seeds"): "9", (11, "Arm"): "3"}
    allowed = spark.createDataFrame([(3,), (12,), (4,)], "n long")
    assert sorted(r["token"] for r in inf.unsupported_counts(inf.stated_counts(texts, "id"), allowed).collect()) == ["Seeds 9", "TEN  seeds"]


def test_exclusions_need_reasons(spark):
    rows = [(1, True, None), (2, True, None), (3, False, "short"), (4, False, "  "), (5, False, None), (6, None, "lost")]
    population = spark.createDataFrame(rows, "doc_id long, eligible boolean, reason string")
    coded = spark.createDataFrame([(1,), (1,), (3,), (9,)], "doc_id long")
    got = {r["problem"]: r["n"] for r in inf.exclusion_problems(population, coded).collect()}
    assert got == {"excluded_without_reason": 2, "excluded_but_coded": 1, "eligible_unavailable": 1, "coded_not_screened": 1}


def test_shard_files_become_one_store(spark, tmp_path):
    spark.range(30).selectExpr("id AS start", "1 AS label").write.parquet(str(tmp_path / "s1"))
    spark.range(12).selectExpr("id AS start").write.parquet(str(tmp_path / "s2"))
    spark.range(99).write.parquet(str(tmp_path / "meta.old"))
    folders = [str(tmp_path / f) for f in ("s2", "meta.old", "s1")]
    whole = tables.consolidate_files(spark, folders, str(tmp_path / "store"))
    assert whole.count() == 42 and whole.where("label = -1").count() == 12 and "id" not in whole.columns
    with pytest.raises(FileNotFoundError):
        tables.consolidate_files(spark, [str(tmp_path / "meta.old")], str(tmp_path / "none"))
