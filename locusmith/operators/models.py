"""The two classical control models on MLlib, the sweep over label budgets, and the sweep of logistic fits as one grouped Newton iteration."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import score_arms
from .stored import stored
from .windows import budget_subsets


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x").transform(df)


def _classes(train: DataFrame) -> dict[int, int]:
    return {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}


def _constant(test: DataFrame) -> DataFrame:
    return test.withColumn("score", F.lit(0.0))


def logistic(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """``test`` with the score of a logistic regression: standardised on the training rows, balanced weights, L2 with C = 1."""
    counts = _classes(train)
    if len(counts) < 2:
        return _constant(test)
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(_vectors(train, features))
    fit_on = scaler.transform(_vectors(train, features)).withColumn("_w", weight)
    model = LogisticRegression(featuresCol="_z", labelCol="label", weightCol="_w", regParam=1.0 / n, standardization=False).fit(fit_on)
    return model.transform(scaler.transform(_vectors(test, features))).withColumn("score", vector_to_array("probability")[1]).select(*test.columns, "score")


def boosted(train: DataFrame, test: DataFrame, features: list[str], rounds: int = 20) -> DataFrame:
    """``test`` with the score of boosted trees."""
    if len(_classes(train)) < 2:
        return _constant(test)
    model = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, stepSize=0.1, maxBins=255, minInstancesPerNode=20, seed=1).fit(_vectors(train, features))
    return model.transform(_vectors(test, features)).withColumn("score", vector_to_array("probability")[1]).select(*test.columns, "score")


def sweep(train: DataFrame, test: DataFrame, features: list[str], key: str, fracs: tuple[float, ...], seeds: tuple[int, ...], fit=logistic) -> DataFrame:
    """Fits at each budget and seed (a small grid on the driver; every fit and score is distributed) and scores as one table."""
    scored = None
    for seed in seeds:
        chosen = budget_subsets(train, fracs, key, seed)
        for frac in fracs:
            own = chosen.where(F.col("frac") == frac)
            both = test.withColumn("_part", F.lit("test")).unionByName(own.where("part = 'val'").select(*test.columns).withColumn("_part", F.lit("val")))
            fitted = fit(own.where("part = 'train'"), both, features).select("label", "score", "_part", F.lit(seed).alias("seed"), F.lit(frac).alias("frac"))
            scored = fitted if scored is None else scored.unionByName(fitted)
    parts = [scored.where(F.col("_part") == p).drop("_part") for p in ("test", "val")]
    return score_arms(*parts, ["seed", "frac"])


def _dot(features: list[str], slopes: str) -> object:
    return reduce(lambda a, b: a + b, [F.col(f) * F.col(slopes)[i] for i, f in enumerate(features)]) + F.col(slopes)[len(features)]


def logistic_fits(train: DataFrame, fits: list[str], features: list[str], rounds: int = 12) -> DataFrame:
    """(fits, center, scale, slopes): the logistic control of every group at once, by iteratively reweighted least squares.

    Each round is one grouped sum of gradients and Hessians over stored rows; the driver solves the small systems. It
    holds a vector a fit, and there are as many fits as the caller's grid of seeds and budgets has. Groups of one class
    have null slopes. Standardised on the group's rows, balanced weights, L2 with C = 1 on the slopes.
    """
    spark, k = train.sparkSession, len(features)
    count = F.count(F.lit(1))
    stats = train.groupBy(*fits).agg(count.alias("n"), F.sum("label").cast("long").alias("n1"), F.array(*[F.avg(f) for f in features]).alias("center"), F.array(*[F.coalesce(F.stddev_samp(f), F.lit(0.0)) for f in features]).alias("scale"))
    known = [r.asDict() for r in stats.collect()]
    kinds = ", ".join(f"`{c}` {train.schema[c].dataType.simpleString()}" for c in fits)
    vectors = "center array<double>, scale array<double>"
    usable = {tuple(r[c] for c in fits): r for r in known if 0 < r["n1"] < r["n"]}
    weights = [(*key, r["center"], r["scale"], r["n"] / (2 * (r["n"] - r["n1"])), r["n"] / (2 * r["n1"])) for key, r in usable.items()]
    found = {key: np.zeros(k + 1) for key in usable}
    if usable:
        tied = train.join(F.broadcast(spark.createDataFrame(weights, f"{kinds}, {vectors}, w0 double, w1 double")), fits)
        scaled = lambda i, f: F.when(F.col("scale")[i] > 0, (F.col(f) - F.col("center")[i]) / F.col("scale")[i]).otherwise(F.lit(0.0)).alias(f)
        rows = stored(tied.select(*fits, "label", F.when(F.col("label") == 1, F.col("w1")).otherwise(F.col("w0")).alias("_w"), *[scaled(i, f) for i, f in enumerate(features)]))
        pairs = list(combinations_with_replacement(range(k + 1), 2))
        x = [*[F.col(f) for f in features], F.lit(1.0)]
        for _ in range(rounds):
            now = spark.createDataFrame([(*key, v.tolist()) for key, v in found.items()], f"{kinds}, _b array<double>")
            met = rows.join(F.broadcast(now), fits).withColumn("_p", 1 / (1 + F.exp(-_dot(features, "_b"))))
            pull, bend = F.col("_w") * (F.col("_p") - F.col("label")), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
            sums = met.withColumns({"_pull": pull, "_bend": bend}).groupBy(*fits).agg(F.array(*[F.sum(F.col("_pull") * c) for c in x]).alias("_g"), F.array(*[F.sum(F.col("_bend") * x[i] * x[j]) for i, j in pairs]).alias("_h"))
            moved = 0.0
            for r in sums.collect():
                key = tuple(r[c] for c in fits)
                penalty = np.array([1.0] * k + [0.0])
                hessian = np.diag(penalty)
                for (i, j), value in zip(pairs, r["_h"], strict=True):
                    hessian[i, j] += value
                    hessian[j, i] += value if i != j else 0.0
                step = np.linalg.solve(hessian, np.array(r["_g"]) + penalty * found[key])
                found[key] = found[key] - step
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-10:
                break
    out = [(*[r[c] for c in fits], r["center"], r["scale"], found[key].tolist() if (key := tuple(r[c] for c in fits)) in found else None) for r in known]
    return spark.createDataFrame(out, f"{kinds}, {vectors}, slopes array<double>")


def logistic_sweep(train: DataFrame, test: DataFrame, features: list[str], key: str, fracs: tuple[float, ...], seeds: tuple[int, ...]) -> DataFrame:
    """``sweep`` of the logistic control with all fits in one iteration; the fits' vectors, a row each, are broadcast to the rows they score."""
    chosen = reduce(DataFrame.unionByName, [budget_subsets(train, fracs, key, s).withColumn("seed", F.lit(s)) for s in seeds])
    chosen = stored(chosen.select("seed", "frac", "part", "label", *features))
    fits = logistic_fits(chosen.where("part = 'train'"), ["seed", "frac"], features)
    standard = [F.when(F.col("scale")[i] > 0, (F.col(f) - F.col("center")[i]) / F.col("scale")[i]).otherwise(F.lit(0.0)).alias(f) for i, f in enumerate(features)]

    def scored(rows: DataFrame) -> DataFrame:
        own = rows.select("label", "seed", "frac", "slopes", *standard)
        score = F.when(F.col("slopes").isNull(), F.lit(0.0)).otherwise(1 / (1 + F.exp(-_dot(features, "slopes"))))
        return own.select("seed", "frac", "label", score.alias("score"))

    every = test.select("label", *features).withColumn("_f", F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(float(f)).alias("frac")) for s in seeds for f in fracs]))).select("label", *features, "_f.*")
    on = lambda rows: rows.join(F.broadcast(fits), ["seed", "frac"])
    return score_arms(scored(on(every)), scored(on(chosen.where("part = 'val'").drop("part"))), ["seed", "frac"])
