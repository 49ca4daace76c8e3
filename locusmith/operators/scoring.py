"""Scores against labels: thresholds, average precision, ROC-AUC, calibration, conformal sets, strata and transfer.

Every operator works on any number of groups (arm, seed, fraction ...) at once. Rows are first summed by distinct
score with partial aggregation, so the running sums see a row per distinct score of a group, and no task a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import halves, meet, places, running
from .stored import stored

GRID = 512


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1_columns(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is empty."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def prf_at(df: DataFrame, groups: list[str], tau: Column | float = 0.5, suffix: str = "at_half") -> DataFrame:
    """Precision, recall and F1 of predicting positive from ``tau`` on (a constant or a column that is constant in a group)."""
    hit = F.col("score") >= (tau if isinstance(tau, Column) else F.lit(float(tau)))
    counts = df.groupBy(*groups).agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"))
    return _from_counts(counts, groups, suffix)


def _prf(scores: DataFrame, groups: list[str], tau: Column | float, suffix: str) -> DataFrame:
    """``prf_at`` of counted scores (see ``by_score``)."""
    hit = F.col("score") >= (tau if isinstance(tau, Column) else F.lit(float(tau)))
    total = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("long")
    counts = scores.groupBy(*groups).agg(total(hit, F.col("pos")).alias("tp"), total(hit, F.col("cnt") - F.col("pos")).alias("fp"), total(~hit, F.col("pos")).alias("fn"))
    return _from_counts(counts, groups, suffix)


def _from_counts(counts: DataFrame, groups: list[str], suffix: str) -> DataFrame:
    p, r, f = f1_columns(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*groups, p.alias(f"p_{suffix}"), r.alias(f"r_{suffix}"), f.alias(f"f1_{suffix}"))


def by_score(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups, "score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("cnt"))


def _curve(scores: DataFrame, groups: list[str], kept: bool = False) -> DataFrame:
    """Distinct scores of each group with pos, cnt, and their sums up to the score (``_upto``) and in the group (``_all``)."""
    return running(scores, groups, ["score"], ["pos", "cnt"], kept)


def _precision_steps() -> Column:
    above = lambda c: F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)
    ap = F.sum(F.when(F.col("pos_all") > 0, F.col("pos") / F.col("pos_all") * above("pos") / above("cnt")))
    one_class = (F.first("pos_all") == 0) | (F.first("pos_all") == F.first("cnt_all"))
    return F.when(~one_class, ap)


def _rank_area() -> Column:
    rank = F.col("cnt_upto") - F.col("cnt") + (F.col("cnt") + 1) / 2
    p, q = F.sum("pos"), F.sum(F.col("cnt") - F.col("pos"))
    return F.when((p > 0) & (q > 0), (F.sum(F.col("pos") * rank) - p * (p + 1) / 2) / (p * q))


def average_precision(df: DataFrame, groups: list[str]) -> DataFrame:
    """Step sum of precision over recall, ties stepping together; null for a group of one class."""
    return _curve(by_score(df, groups), groups).groupBy(*groups).agg(_precision_steps().alias("auprc"))


def roc_auc(df: DataFrame, groups: list[str]) -> DataFrame:
    """Mann-Whitney AUC from tie-averaged ranks; null for a group of one class."""
    return _curve(by_score(df, groups), groups).groupBy(*groups).agg(_rank_area().alias("roc_auc"))


def threshold_free(df: DataFrame, groups: list[str]) -> DataFrame:
    return _free(by_score(df, groups), groups)


def _free(scores: DataFrame, groups: list[str], kept: bool = False) -> DataFrame:
    return _curve(scores, groups, kept).groupBy(*groups).agg(_precision_steps().alias("auprc"), _rank_area().alias("roc_auc"), (F.sum("pos") / F.sum("cnt")).alias("pos_rate"))


def _cut_arrays(scores: DataFrame, groups: list[str], most: int, kept: bool = False) -> DataFrame:
    """The thresholds of ``cuts`` as one ascending array ``taus`` of each group of counted scores.

    Quantiles lie linearly between their neighbours. A score fills the places cnt_upto - cnt to cnt_upto - 1 of its
    group and takes part in every quantile of which a neighbouring place is one of these; of a group with few
    distinct scores it stands for itself.
    """
    distinct = running(scores.withColumn("one", F.lit(1).cast("long")), groups, ["score"], ["one", "cnt"], kept)
    last, begin, end = F.col("cnt_all") - 1, F.col("cnt_upto") - F.col("cnt"), F.col("cnt_upto") - 1
    place = lambda i: last * (i / F.lit(most - 1))
    within = lambda at: (at >= begin) & (at <= end)
    nearest = lambda at, step: F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor(at * (most - 1) / F.greatest(last, F.lit(1))) + step))
    touched = F.filter(F.sequence(nearest(begin - 1, -1), nearest(end + 1, 1)), lambda i: within(F.floor(place(i))) | within(F.ceil(place(i))))
    spread = F.transform(touched, lambda i: F.struct(i.cast("long").alias("i"), place(i).alias("at")))
    itself = F.array(F.struct(F.col("one_upto").alias("i"), begin.cast("double").alias("at")))
    near = distinct.withColumn("_q", F.explode(F.when(F.col("one_all") <= most, itself).otherwise(spread)))
    low, high = (F.max(F.when(within(f("_q.at")), F.col("score"))) for f in (F.floor, F.ceil))
    points = near.groupBy(*groups, "_q").agg(low.alias("low"), high.alias("high"))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("_q.at") - F.col("_q.at")) * F.col("low") + (F.col("_q.at") - F.floor("_q.at")) * F.col("high"))
    arrays = points.groupBy(*groups).agg(F.sort_array(F.collect_set(between)).alias("us"))
    middle = F.transform(F.slice("us", F.lit(2), F.size("us")), lambda u, i: (u + F.get("us", i)) / 2)
    ends = F.when(F.size("us") > 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    return arrays.select(*groups, F.array_sort(F.array_union(ends, middle)).alias("taus"))


def cuts(df: DataFrame, groups: list[str], most: int = GRID) -> DataFrame:
    """Candidate thresholds: 0, the midpoints of consecutive distinct scores, and 1.

    Where a group has over ``most`` distinct scores, the distinct values of as many quantiles of all scores stand for them.
    """
    return _cut_arrays(by_score(df, groups), groups, most).select(*groups, F.explode("taus").alias("tau"))


def select_threshold(df: DataFrame, groups: list[str], most: int = GRID) -> DataFrame:
    """The least threshold of the greatest F1 on ``df``; 0.5 for a group of one class.

    A group has few thresholds, so its scores are counted by the number of thresholds at or below them; sums of these
    counts from above are the predictions of each threshold.
    """
    own = F.struct(F.lit(0).alias("none"), *groups).alias("_group")
    scores = stored(by_score(df, groups))
    taus = _cut_arrays(scores, groups, most, True).select(own, F.col("taus").alias("_taus"), halves(F.size("taus")).alias("_halves"))
    placed = scores.withColumn("_group", own).join(taus, "_group").withColumn("_place", places(F.col("_taus"), F.col("score"), F.col("_halves")))
    counted = placed.groupBy("_group", "_place").agg(F.sum("pos").alias("pos"), F.sum("cnt").alias("cnt"), F.first("_taus").alias("_taus"))
    # Places without a score count as the next place above that has one; a group has most + 2 of them.
    filled = counted.groupBy("_group").agg(F.first("_taus").alias("_taus"), F.map_from_entries(F.collect_list(F.struct("_place", F.struct("pos", "cnt")))).alias("_counts"), F.sum("pos").alias("n_pos"), F.sum("cnt").alias("n"))
    each = filled.select("_group", "n_pos", "n", "_counts", F.posexplode("_taus").alias("_at", "at")).withColumn("_own", F.try_element_at("_counts", F.col("_at") + 1))
    above = Window.partitionBy("_group").orderBy(F.desc("_at"))
    sums = {name: F.sum(F.coalesce(F.col(f"_own.{c}"), F.lit(0))).over(above) for name, c in (("tp", "pos"), ("seen", "cnt"))}
    swept = each.withColumns(sums).select("_group.*", "at", "tp", "seen", "n_pos", "n")
    f1 = f1_columns(F.col("tp"), F.col("seen") - F.col("tp"), F.col("n_pos") - F.col("tp"))[2]
    best = swept.withColumn("f1", F.round(f1, 12)).groupBy(*groups).agg(F.max_by("at", F.struct(F.col("f1"), -F.col("at"))).alias("tau"), F.first("n_pos").alias("p"), F.first("n").alias("n"))
    return best.select(*groups, F.when((F.col("p") == 0) | (F.col("p") == F.col("n")), 0.5).otherwise(F.col("tau")).alias("tau"))


def score_arms(test: DataFrame, validation: DataFrame | None, groups: list[str]) -> DataFrame:
    """The full metric record of each group: threshold-free metrics, and P, R and F1 at 0.5 and at the selected threshold."""
    scores = stored(by_score(test, groups))
    record = _free(scores, groups, True).join(_prf(scores, groups, 0.5, "at_half"), groups)
    taus = select_threshold(validation, groups).withColumn("tau_selected", F.lit(True)) if validation is not None else None
    keyed = record.join(taus, groups, "left") if taus is not None else record.withColumns({"tau": F.lit(0.5), "tau_selected": F.lit(False)})
    keyed = keyed.withColumns({"tau": F.coalesce("tau", F.lit(0.5)), "tau_selected": F.coalesce("tau_selected", F.lit(False))})
    at_tau = _prf(scores.join(keyed.select(*groups, "tau"), groups), groups, F.col("tau"), "at_tau")
    return keyed.join(at_tau, groups).withColumns({"F1": F.col("f1_at_half"), "P": F.col("p_at_half"), "R": F.col("r_at_half")})


def separability(features: DataFrame, names: list[str], groups: list[str] | None = None) -> DataFrame:
    """ROC-AUC of every feature alone (in each group): raw, oriented, and the side on which positives lie."""
    groups = groups or []
    long = features.unpivot([*groups, "label"], names, "feature", "score").where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    counts = long.groupBy(*groups, "feature").agg(F.count(F.lit(1)).alias("n_test"), F.sum("label").alias("n_pos"))
    auc = roc_auc(long, [*groups, "feature"]).join(counts, [*groups, "feature"])
    return auc.select(*groups, "feature", "n_test", "n_pos", F.col("roc_auc").alias("auc"), F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("auc_oriented"), F.when(F.col("roc_auc") >= 0.5, "high").otherwise("low").alias("deletion_side"))


def stratified_recall(df: DataFrame, groups: list[str], stratum: Column, tau: float = 0.5) -> DataFrame:
    """Recall of positives in each stratum; empty strata have no row."""
    positives = df.where("label = 1").withColumn("stratum", stratum).where("stratum IS NOT NULL")
    return positives.groupBy(*groups, "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= tau).cast("double")).alias("recall"))


def calibration_error(df: DataFrame, groups: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error of the winning class; bins are (low, high], so confidence 0 is in none."""
    confidence = F.greatest("score", 1 - F.col("score"))
    correct = ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    binned = df.select(*groups, confidence.alias("conf"), correct.alias("right")).withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("conf"))))
    each = binned.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("cnt"), F.avg("conf").alias("conf"), F.avg("right").alias("right"))
    gap = F.sum(F.when(F.col("bin") > 0, F.col("cnt") * F.abs(F.col("right") - F.col("conf"))).otherwise(0.0))
    return each.groupBy(*groups).agg((gap / F.sum("cnt")).alias("ece"))


def temperature(df: DataFrame, groups: list[str], grid: tuple[float, ...]) -> DataFrame:
    """The temperature of the grid that minimises the mean negative log likelihood of sigmoid(logit / T); ``df`` has logit and label.

    Every temperature is an aggregate of its own, so no row is repeated for one.
    """

    def loss(t: float) -> Column:
        z = F.col("logit") / F.lit(t)
        return F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col("label"))

    losses = df.groupBy(*groups).agg(*[loss(float(t)).alias(f"_{i}") for i, t in enumerate(grid)])
    each = [F.struct(F.round(f"_{i}", 12).alias("r"), F.lit(float(t)).alias("t"), F.col(f"_{i}").alias("nll")) for i, t in enumerate(grid)]
    return losses.withColumn("b", F.array_min(F.array(*each))).select(*groups, F.col("b.t").alias("temperature"), F.col("b.nll").alias("nll"))


def fitted_temperature(df: DataFrame, groups: list[str], grid: tuple[float, ...], rounds: int = 6) -> DataFrame:
    """The temperature within the grid's ends that minimises the mean negative log likelihood, to about 1e-9 (see ``temperature``).

    Logits are counted and stored once. Newton's steps on log T begin at the best of the grid; each round is one grouped
    sum of both derivatives, and groups meet their temperature in parts.
    """
    counts = stored(df.groupBy(*groups, "logit", "label").agg(F.count(F.lit(1)).alias("_n")))
    mean = lambda c: F.sum(F.col("_n") * c) / F.sum("_n")
    loss = lambda z: F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col("label")
    losses = counts.groupBy(*groups).agg(*[mean(loss(F.col("logit") / F.lit(float(t)))).alias(f"_{i}") for i, t in enumerate(grid)])
    best = F.array_min(F.array(*[F.struct(F.col(f"_{i}").alias("nll"), F.lit(float(t)).alias("t")) for i, t in enumerate(grid)]))
    at = losses.select(*groups, best["t"].alias("temperature"))
    for _ in range(rounds):
        at = stored(at)
        s = 1 / F.col("temperature")
        p = 1 / (1 + F.exp(-F.col("logit") * s))
        slope, bend = F.col("logit") * (p - F.col("label")), F.col("logit") * F.col("logit") * p * (1 - p)
        sums = meet(counts, at, groups, ["logit", "label"]).groupBy(*groups, "temperature").agg(mean(slope).alias("_g"), mean(bend).alias("_h"))
        # Derivatives by log T of a loss that is convex in s = 1 / T.
        first, second = -s * F.col("_g"), s * F.col("_g") + s * s * F.col("_h")
        curve = F.when(second > 0, second).otherwise(s * s * F.col("_h"))
        step = F.when(curve > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -first / curve))).otherwise(F.lit(0.0))
        moved = F.greatest(F.lit(float(min(grid))), F.least(F.lit(float(max(grid))), F.col("temperature") * F.exp(step)))
        at = sums.select(*groups, moved.alias("temperature"))
    at = stored(at)
    return meet(counts, at, groups, ["logit", "label"]).groupBy(*groups, "temperature").agg(mean(loss(F.col("logit") / F.col("temperature"))).alias("nll"))


def conformal_threshold(df: DataFrame, groups: list[str], alpha: float = 0.1) -> DataFrame:
    """Order statistic of the nonconformity of calibration rows at ceil((n + 1)(1 - alpha)) / n, at most 1, taken from above."""
    s = F.when(F.col("label") == 1, 1 - F.col("score")).otherwise(F.col("score"))
    counts = df.select(*groups, s.alias("s")).groupBy(*groups, "s").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = running(counts, groups, ["s"], ["cnt"]).withColumnsRenamed({"cnt_upto": "upto", "cnt_all": "n"})
    q = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"), F.lit(1.0))
    place = F.ceil(F.round(q * (F.col("n") - 1), 9)) + 1
    return ranked.where(F.col("upto") >= place).groupBy(*groups).agg(F.min("s").alias("qhat"))


def conformal_sets(df: DataFrame, thresholds: DataFrame, groups: list[str]) -> DataFrame:
    """Which labels each row's score admits."""
    return df.join(thresholds, groups).withColumns({"keep0": F.col("score") <= F.col("qhat"), "keep1": (1 - F.col("score")) <= F.col("qhat")})


def conformal_coverage(sets: DataFrame, groups: list[str]) -> DataFrame:
    covered = F.when(F.col("label") == 1, F.col("keep1")).otherwise(F.col("keep0"))
    return sets.groupBy(*groups).agg(F.avg(covered.cast("double")).alias("coverage"), F.avg(F.col("keep0").cast("int") + F.col("keep1").cast("int")).alias("mean_size"), F.count(F.lit(1)).alias("n"))


def sampled_uncertainty(df: DataFrame, item: str) -> DataFrame:
    """Predictive, aleatoric and epistemic entropy of items from sampled class probabilities (item, sample, class, p)."""
    entropy = lambda p: -F.sum(p * F.log(p + 1e-9))
    total = df.groupBy(item, "class").agg(F.avg("p").alias("p")).groupBy(item).agg(entropy(F.col("p")).alias("predictive"), F.max("p").alias("confidence"))
    noise = df.groupBy(item, "sample").agg(entropy(F.col("p")).alias("h")).groupBy(item).agg(F.avg("h").alias("aleatoric"))
    return total.join(noise, item).withColumn("epistemic", F.col("predictive") - F.col("aleatoric"))


def transfer(validation: DataFrame, inside: DataFrame, outside: DataFrame, groups: list[str]) -> DataFrame:
    """A threshold chosen once, applied to two populations: F1 and average precision of each, and their gaps."""
    taus = select_threshold(validation, groups)

    def record(df: DataFrame, name: str) -> DataFrame:
        at = prf_at(df.join(taus, groups), groups, F.col("tau"), "at_tau").join(prf_at(df, groups), groups).join(average_precision(df, groups), groups)
        return at.select(*groups, *[F.col(c).alias(f"{name}_{c}") for c in ("f1_at_tau", "f1_at_half", "auprc")])

    both = record(inside, "in").join(record(outside, "out"), groups).join(taus, groups)
    return both.withColumns({f"gap_{c}": F.col(f"in_{c}") - F.col(f"out_{c}") for c in ("f1_at_tau", "auprc", "f1_at_half")})


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    return 1 / (1 + F.exp(logit0 - logit1))
