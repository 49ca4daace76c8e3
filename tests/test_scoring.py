import random

import pytest
from pyspark.sql import functions as F

from locusmith.functions.special import t_quantile, t_two_sided
from locusmith.operators import inference as inf
from locusmith.operators import scoring as sc
from locusmith.operators import windows as wn


def frame(spark, scores, labels):
    return spark.createDataFrame([("g", float(s), y) for s, y in zip(scores, labels, strict=True)], "g string, score double, label int")


def test_separated_scores(spark):
    df = frame(spark, [0.01, 0.02, 0.03, 0.04, 0.10, 0.12, 0.14, 0.16], [0] * 4 + [1] * 4)
    r = sc.score_arms(df, df, ["g"]).first()
    assert (r["auprc"], r["roc_auc"], r["f1_at_half"], r["f1_at_tau"], r["tau_selected"]) == (1.0, 1.0, 0.0, 1.0, True)


def test_degenerate_groups(spark):
    df = frame(spark, [0.2, 0.2], [1, 1])
    r = sc.score_arms(df, df, ["g"]).first()
    assert r["tau"] == 0.5 and r["auprc"] is None and r["roc_auc"] is None
    assert sc.roc_auc(frame(spark, [0.3, 0.3, 0.3], [0, 1, 1]), ["g"]).first()["roc_auc"] == 0.5


def test_auc_and_threshold_equal_brute_force(spark):
    rng = random.Random(2)
    s = [round(rng.random(), 2) for _ in range(200)]
    y = [int(rng.random() < 0.2 + 0.6 * v) for v in s]
    df = frame(spark, s, y)
    p, n = [v for v, k in zip(s, y, strict=True) if k], [v for v, k in zip(s, y, strict=True) if not k]
    auc = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    assert sc.roc_auc(df, ["g"]).first()["roc_auc"] == pytest.approx(auc)

    def f1(t):
        tp = sum(v >= t and k for v, k in zip(s, y, strict=True))
        return 2 * tp / (sum(v >= t for v in s) + sum(y)) if tp else 0.0

    u = sorted(set(s))
    cuts = [0.0, *((a + b) / 2 for a, b in zip(u, u[1:], strict=False)), 1.0]
    best = max(f1(t) for t in cuts)
    tau = sc.select_threshold(df, ["g"]).first()["tau"]
    assert tau == pytest.approx(min(t for t in cuts if f1(t) > best - 1e-12))


def test_many_scores_use_the_quantile_grid(spark):
    df = spark.range(2000).select(F.lit("g").alias("g"), (F.col("id") / 2000).alias("score"), (F.col("id") >= 900).cast("int").alias("label"))
    assert sc.cuts(df, ["g"]).count() == 513
    assert sc.select_threshold(df, ["g"]).first()["tau"] == pytest.approx(0.45, abs=0.002)


def test_budgets(spark):
    df = spark.createDataFrame([(0.01, 3452), (1.0, 77), (1.5, 10), (0.5, 1)], "frac double, pool long")
    assert [r[0] for r in df.select(wn.label_budget(F.col("frac"), F.col("pool"))).collect()] == [35, 77, None, None]
    n = spark.createDataFrame([(35,), (96,), (60,)], "n long")
    assert [r[0] for r in n.select(wn.validation_size(F.col("n"))).collect()] == [0, 19, 12]


def test_matching_follows_the_positives(spark):
    pos = spark.range(60).select(F.lit("c").alias("g"), (F.col("id") % 3 * 0.25 + 0.01).alias("x"), F.col("id").alias("key"))
    pool = spark.range(5000).select(F.lit("c").alias("g"), (F.col("id") / 2500).alias("x"), F.col("id").alias("key"))
    kept = wn.match_strata(pos, pool, ["g"], "x", ["key"], 2)
    assert kept.count() == 120
    assert abs(kept.agg(F.expr("percentile(x, 0.5)")).first()[0] - 0.26) < 0.2
    assert wn.match_strata(pos, pool.limit(50), ["g"], "x", ["key"], 2).count() == 50


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, None, 0.005]
    df = spark.createDataFrame([("f", str(i), v) for i, v in enumerate(p)], "family string, test string, p double")
    r = {x["test"]: (x["p_holm"], x["q_bh"]) for x in inf.multiplicity_report(df, ["family"]).collect()}
    assert r["4"] == pytest.approx((0.02, 0.02)) and r["0"] == pytest.approx((0.03, 0.02)) and r["2"] == pytest.approx((0.06, 0.04)) and r["1"] == pytest.approx((0.06, 0.04))
    assert r["3"] == (None, None)


def test_t_distribution():
    assert t_two_sided([2.0, 12.706205], [10.0, 1.0]) == pytest.approx([0.073388, 0.05], abs=1e-6)
    assert t_quantile(0.975, [9.0])[0] == pytest.approx(2.262157, abs=1e-5)
