import random

import numpy as np
import pytest

from locusmith.operators import ranges as rg
from locusmith.operators import scoring as sc
from locusmith.operators import windows as wn
from locusmith.operators.pileup import running_normaliser
from locusmith.operators.ranges import cut, numbered, running
from locusmith.sources.text import slices


def test_running_sums_and_numbers_equal_python(spark):
    rng = random.Random(5)
    rows = [(g, None if rng.random() < 0.02 else rng.choice([rng.random(), rng.gauss(0, 1e-6), 1e9 * rng.random(), 0.5]), rng.randrange(4)) for g in ("a", "a", "a", "b", None) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, k double, n int")
    found = sorted(map(tuple, running(df, ["g"], ["k"], ["n"]).collect()), key=repr)
    before = lambda x, y: x is None or (y is not None and x <= y)
    wanted = [(g, k, n, sum(m for h, j, m in rows if h == g and before(j, k)), sum(m for h, _, m in rows if h == g)) for g, k, n in rows]
    assert found == sorted(wanted, key=repr)
    placed = numbered(df, ["g"], ["k", "n"]).collect()
    for group in ("a", "b", None):
        own = sorted((r["_at"], r["k"] is not None, r["k"] or 0.0, r["n"]) for r in placed if r["g"] == group)
        assert [r[0] for r in own] == list(range(sum(g == group for g, _, _ in rows)))
        assert [r[1:] for r in own] == sorted(r[1:] for r in own)


def test_no_range_holds_a_large_share_of_a_group(spark):
    df = spark.range(20000).selectExpr("'g' AS g", "pow(rand(3), 40) AS k")
    sizes = [r["count"] for r in cut(df, ["g"], ["k"]).groupBy("_range").count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 4000 and len(sizes) > 40


def test_empty_tables_and_a_single_group(spark):
    empty = spark.createDataFrame([], "g string, score double, label int")
    assert sc.average_precision(empty, ["g"]).count() == 0 and numbered(empty, ["g"], ["score"]).count() == 0
    one = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.9, 1)], "score double, label int")
    assert sc.roc_auc(one, []).first()["roc_auc"] == 1.0 and sc.average_precision(one, []).first()["auprc"] == 1.0


def test_quantile_thresholds_equal_numpy(spark):
    rng = random.Random(8)
    scores = [round(rng.random() ** 3, 3) for _ in range(1500)]
    df = spark.createDataFrame([("g", s, int(rng.random() < s)) for s in scores], "g string, score double, label int")
    for most in (40, 200):
        points = np.unique([np.quantile(scores, i / (most - 1)) for i in range(most)])
        found = sorted(r["tau"] for r in sc.cuts(df, ["g"], most).collect())
        wanted = sorted({0.0, 1.0, *((points[1:] + points[:-1]) / 2)})
        merged = [t for i, t in enumerate(wanted) if i == 0 or t - wanted[i - 1] > 1e-12]
        kept = [t for i, t in enumerate(found) if i == 0 or t - found[i - 1] > 1e-12]
        assert np.allclose(kept, merged, atol=1e-12)


def test_normaliser_equals_the_recursion(spark):
    rng = random.Random(6)
    rows = [(k, b, rng.random(), None if k == "n" and b == 3 else rng.random()) for k in ("a", "n") for b in range(90)]
    found = {r["k"]: r for r in running_normaliser(spark.createDataFrame(rows, "k string, b int, mean double, var double"), "k", "b").collect()}
    mean, var = rows[0][2], rows[0][3]
    for _, _, m, v in rows[1:90]:
        mean, var = mean * 0.99 + m * 0.01, var * 0.99 + v * 0.01
    assert found["a"]["mean"] == pytest.approx(mean) and found["a"]["var"] == pytest.approx(var) and found["a"]["n_batches"] == 90
    assert found["n"]["var"] is None and found["n"]["mean"] is not None


def test_slices_over_block_borders(spark):
    rng = random.Random(7)
    bases = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("1", 103), ("2", 20), ("3", 0))}
    ranges = [(c, s, s + n, "x") for c in ("1", "2", "3", "unknown") for s in (0, 9, 10, 57, 99, 200) for n in (0, 1, 10, 31)] * 2
    found = slices(spark.createDataFrame(list(bases.items()), "chrom string, sequence string"), spark.createDataFrame(ranges, "chrom string, start long, stop long, name string"), 10)
    assert sorted(map(tuple, found.collect())) == sorted((c, s, e, x, bases[c][s:e]) for c, s, e, x in ranges if c in bases)


@pytest.fixture(params=["ranges", "windows"])
def both_plans(request, monkeypatch):
    """Small tables take plain windows; this takes the ranges of large ones too."""
    if request.param == "ranges":
        monkeypatch.setattr(rg, "FEW", -1)


def test_running_quantiles_and_firsts(spark, both_plans):
    rng = random.Random(15)
    rows = [(g, None if rng.random() < 0.05 else rng.choice([round(rng.random(), 2), rng.gauss(0, 9)]), i) for i, g in enumerate(rng.choice("aaaaabc") for _ in range(900))]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {r["g"]: r for r in rg.quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    for g in "abc":
        own = [v for h, v, _ in rows if h == g and v is not None]
        assert got[g]["n"] == len(own) and np.allclose(got[g]["quantiles"], np.quantile(own, [0.0, 0.1, 0.5, 0.77, 1.0]), rtol=1e-12)
    limits = spark.createDataFrame([("a", 333), ("b", 0), ("d", 5)], "g string, n int")
    for g, want in (("a", 333), ("b", 0), ("c", 0)):
        own = sorted((v is not None, v or 0.0, i) for h, v, i in rows if h == g)
        taken = {r["i"] for r in rg.firsts(df.where(f"g = '{g}'"), ["g"], ["v", "i"], limits, "n").collect()}
        assert taken == {i for *_, i in own[:want]}
    marked = rg.mark_firsts(df, ["g"], ["v", "i"], limits, "n", "first").collect()
    assert len(marked) == len(rows) and sum(r["first"] for r in marked) == 333
    ran = rg.running(df.where("v IS NOT NULL"), ["g"], ["v"], ["i"]).collect()
    for r in ran:
        assert r["i_upto"] == sum(i for g, v, i in rows if g == r["g"] and v is not None and v <= r["v"]) and r["i_all"] == sum(i for g, v, i in rows if g == r["g"] and v is not None)


def test_metrics_of_both_plans(spark, both_plans):
    rng = random.Random(16)
    rows = [(g, round(rng.random(), 3), rng.randrange(2)) for g in "ab" for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    found = {r["g"]: r for r in sc.score_arms(df, df, ["g"]).collect()}
    for g in "ab":
        own = [(s, y) for h, s, y in rows if h == g]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        area = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        f1 = lambda t: 2 * sum(s >= t for s in pos) / (sum(s >= t for s in pos) * 2 + sum(s >= t for s in neg) + sum(s < t for s in pos))  # noqa: B023, E731
        assert found[g]["roc_auc"] == pytest.approx(area) and found[g]["f1_at_half"] == pytest.approx(f1(0.5)) and found[g]["f1_at_tau"] == pytest.approx(f1(found[g]["tau"]))
        assert f1(found[g]["tau"]) >= max(f1(t / 50) for t in range(51)) - 0.02


@pytest.mark.parametrize("few", [-1, 10**6])
def test_matched_strata_in_one_large_group(spark, monkeypatch, few):
    """2,000 positives against a pool of 200,000 in one group: quotas are met, medians agree, and no plan sorts the group in a window."""
    monkeypatch.setattr(rg, "FEW", few)
    pos = spark.range(2000).selectExpr("'g' AS g", "pow(rand(1), 2) AS v", "id AS k")
    pool = spark.range(200_000).selectExpr("'g' AS g", "rand(2) * 1.5 AS v", "id AS k")
    kept = wn.match_strata(pos, pool, ["g"], "v", ["k"])
    assert kept.count() == 6000 and kept.where("first").count() > 5000
    assert wn.match_offset(pos, kept, ["g"], "v").first()["offset"] < 0.02
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and (few > 0 or "Window [row_number() windowspecdefinition(g" not in plan)
