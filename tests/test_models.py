"""Fitted controls, intervals, primary contrasts, hash ranks and stores against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from locusmith.operators import inference as inf
from locusmith.operators import models
from locusmith.operators import scoring as sc
from locusmith.operators import windows as wn
from locusmith.sources import tables

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    rows = []
    for i in range(240):
        label = int(rng.random() < 0.3)
        rows.append((i, label, rng.gauss(1.2 * label, 1), rng.gauss(-0.5 * label, 2)))
    return rows


def split(spark, points):
    df = spark.createDataFrame(points, "id long, label int, x double, y double")
    return df.where("id % 4 != 0"), df.where("id % 4 = 0")


def test_logistic_control_equals_newtons_method(spark, points):
    got = {r["id"]: r["score"] for r in models.logistic(*split(spark, points), FEATURES).collect()}
    train = np.array([p for p in points if p[0] % 4])
    x, y = train[:, 2:], train[:, 1]
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    # The mean of weighted losses, and half the penalty 1 / n on the slopes.
    w, penalty = np.zeros(3), np.array([1.0, 1.0, 0.0]) / len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (weight * (p - y)) / weight.sum() + penalty * w
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + np.diag(penalty), gradient)
    for i, _, a, b in points:
        if i % 4 == 0:
            want = 1 / (1 + math.exp(-float(np.append((np.array([a, b]) - mean) / sd, 1) @ w)))
            assert got[i] == pytest.approx(want, abs=2e-3)


def test_boosted_control_ranks_and_one_class_is_constant(spark, points):
    train, test = split(spark, points)
    scored = models.boosted(train, test, FEATURES)
    assert sc.roc_auc(scored.selectExpr("'g' AS g", "score", "label"), ["g"]).first()["roc_auc"] > 0.65
    assert {r["score"] for r in models.boosted(train.where("label = 0"), test, FEATURES).collect()} == {0.0}


def test_sweep_scores_each_budget(spark, points):
    train, test = split(spark, points)
    got = {(r["seed"], r["frac"]): r for r in models.sweep(train, test, FEATURES, "id", (0.5, 1.0), (0,)).collect()}
    assert set(got) == {(0, 0.5), (0, 1.0)}
    own = wn.budget_subsets(train, (1.0,), "id", 0)
    fitted = models.logistic(own.where("part = 'train'"), test, FEATURES).selectExpr("'g' AS g", "score", "label")
    assert got[0, 1.0]["roc_auc"] == pytest.approx(sc.roc_auc(fitted, ["g"]).first()["roc_auc"])


def test_hash_ranks_are_places_in_the_order(spark):
    rows = [(g, i) for g in "ab" for i in range(700)]
    df = spark.createDataFrame(rows, "g string, id long")
    got = wn.budget_subsets(df, (0.1, 1.0), "id", 5, True, ["g"]).collect()
    order = sorted(range(700), key=lambda i: hashlib.md5(f"5|{i}".encode()).hexdigest())
    for g in "ab":
        chosen = {r["id"]: r["part"] for r in got if r["g"] == g and r["frac"] == 0.1}
        assert set(chosen) == set(order[:70]) and {i for i, p in chosen.items() if p == "val"} == set(order[:14])
        assert sum(r["g"] == g and r["frac"] == 1.0 for r in got) == 700


def test_intervals_and_primary_contrast(spark):
    rng = random.Random(9)
    values = {(a, s): 0.5 + 0.03 * (a == "A") + rng.gauss(0, 0.02) for a in "AR" for s in range(10)}
    runs = spark.createDataFrame([("O", a, s, 0.1, "auprc", v) for (a, s), v in values.items()], "benchmark string, arm string, seed int, frac double, metric string, value double")
    r = inf.holm(inf.with_p(inf.with_interval(inf.paired_t(inf.seed_paired(runs, "A", "R")))), ["benchmark"]).first()
    d = np.array([values["A", s] - values["R", s] for s in range(10)])
    error = d.std(ddof=1) / math.sqrt(10)
    # Quantiles of Student's t with nine degrees of freedom.
    assert (r["ci_lo"], r["ci_hi"]) == (pytest.approx(d.mean() - 2.262157163 * error), pytest.approx(d.mean() + 2.262157163 * error))
    assert r["mde80"] == pytest.approx((2.262157163 + 0.883403860) * error) and r["p_holm"] == r["p"]
    u = np.linspace(0, abs(d.mean() / error), 200_001)
    density = math.gamma(5) / math.gamma(4.5) / math.sqrt(9 * math.pi) * (1 + u * u / 9) ** -5
    assert r["p"] == pytest.approx(1 - 2 * np.trapezoid(density, u), abs=1e-8)


def test_window_store_prunes_and_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", i, i % 3 - 1, "s", "train" if i % 2 else "test") for i in range(50)], "chrom string, start long, label int, sample string, split string")
    tables.write_windows(df, str(tmp_path / "w"), 10)
    read = tables.read_windows(spark, str(tmp_path / "w"), "test", labelled=False)
    assert read.count() == 25 and "label" not in read.columns
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and len(read.inputFiles()) <= len(tables.read_windows(spark, str(tmp_path / "w")).inputFiles())
    runs = [("O", s, f, int(f * 100), a, m, s + f) for s in (0, 1) for f in (0.1, 1.0) for a in ("A", "N") for m in ("auprc", "f1")]
    table = spark.createDataFrame(runs, "benchmark string, seed int, frac double, n int, arm string, metric string, value double")
    tables.write_documents(table, str(tmp_path / "d"), ["A", "N"], ["auprc", "f1"])
    got = {(r["seed"], r["frac"], r["arm"], r["metric"], r["value"]) for r in tables.read_runs(spark, str(tmp_path / "d")).collect()}
    assert got == {(s, f, f"arm_{a}", m, v) for _, s, f, _, a, m, v in runs}


def test_quoted_texts_and_audit_problems(spark):
    source = spark.createDataFrame([(0.0321,), (2.9e-7,)], "value double")
    quoted = spark.createDataFrame([("0.03",), ("0.032",), ("0.0325",), ("3e-07",), ("5e-07",), ("n/a",)], "text string")
    assert {r["text"]: r["found"] for r in inf.quoted_text(quoted, source).collect()} == {"0.03": True, "0.032": True, "0.0325": False, "3e-07": True, "5e-07": False, "n/a": False}
    axes = spark.createDataFrame([(1, "a", "yes"), (1, "b", "no"), (2, "a", "yes")], "doc_id long, axis string, code string")
    quotes = spark.createDataFrame([(1, "a", "yes", True), (1, "a", "no", True), (2, "a", "yes", None), (3, "a", "x", True)], "doc_id long, axis string, code string, verified boolean")
    eligible = spark.createDataFrame([(1,), (4,), (5,)], "doc_id long")
    got = {r["problem"]: r["n"] for r in inf.audit_problems(axes, quotes, eligible).collect()}
    assert got == {"not_one_quote": 2, "other_code": 1, "quote_of_no_axis": 1, "not_verified": 1, "coded_not_eligible": 1, "eligible_not_coded": 2}


def newton(rows, one_step=60):
    """Slopes of the logistic control in numpy, standardised and balanced as the library's."""
    x, y = np.array([r[2:] for r in rows], float), np.array([r[1] for r in rows], float)
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = np.column_stack([np.divide(x - mean, sd, out=np.zeros_like(x), where=sd > 0), np.ones(len(x))])
    weight, w, penalty = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())), np.zeros(z.shape[1]), np.array([1.0] * x.shape[1] + [0.0])
    for _ in range(one_step):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * w)
    return mean, sd, w


def test_grouped_fits_equal_single_ones(spark, points):
    rows = [(g, *p[:4], 7.0) for g in ("a", "b") for p in points if g == "a" or p[0] % 3] + [("c", i, 0, 1.0 * i, 2.0, 7.0) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id long, label int, x double, y double, flat double")
    got = {r["g"]: r for r in models.logistic_fits(df, ["g"], ["x", "y", "flat"]).collect()}
    for g in ("a", "b"):
        mean, sd, w = newton([r[1:] for r in rows if r[0] == g])
        assert np.allclose(got[g]["center"], mean) and np.allclose(got[g]["scale"], sd) and np.allclose(got[g]["slopes"], w, atol=1e-8)
    assert got["c"]["slopes"] is None


def test_grouped_sweep_equals_fits_one_by_one(spark, points):
    train, test = split(spark, points)
    fracs, seeds = (0.01, 0.3, 1.0), (0, 4)
    grouped = {(r["seed"], r["frac"]): r for r in models.logistic_sweep(train, test, FEATURES, "id", fracs, seeds).collect()}
    single = {(r["seed"], r["frac"]): r for r in models.sweep(train, test, FEATURES, "id", fracs, seeds).collect()}
    assert set(grouped) == set(single) and len(grouped) == 6
    for key, r in grouped.items():
        assert r["roc_auc"] == pytest.approx(single[key]["roc_auc"], abs=5e-3) and r["tau_selected"] == single[key]["tau_selected"]


def test_fitted_temperature_equals_a_dense_search(spark):
    rng = random.Random(11)
    rows = [(g, round(rng.gauss(0, 3), 2), int(rng.random() < (0.5 if g == "flat" else 1 / (1 + math.exp(-rng.gauss(0, 1)))))) for g in ("a", "flat") for _ in range(300)]
    rows = [(g, z, y if g == "flat" else int(rng.random() < 1 / (1 + math.exp(-z / 1.7)))) for g, z, y in rows] + [("sure", z, int(z > 0)) for z in (-2.0, -1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, logit double, label int")
    got = {r["g"]: r for r in sc.fitted_temperature(df, ["g"], (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)).collect()}
    for g in ("a", "flat", "sure"):
        z, y = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        nll = lambda t: float(np.mean(np.logaddexp(0, z / t) - z / t * y))  # noqa: B023, E731
        low, high = 0.25, 8.0
        for _ in range(4):
            grid = np.linspace(low, high, 401)
            best = int(np.argmin([nll(t) for t in grid]))
            low, high = grid[max(0, best - 1)], grid[min(400, best + 1)]
        assert got[g]["temperature"] == pytest.approx(grid[best], abs=1e-4) and got[g]["nll"] <= nll(grid[best]) + 1e-9
