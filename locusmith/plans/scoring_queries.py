"""Scoring and calibration queries (E, P9) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as sc
from ..operators import windows as wn
from .pileup_queries import round_all, rounded
from .registry import register
from .views import sql_over, view

KEYS = ["arm", "seed"]
K = "arm, seed"


def prf(source: str, tau: str, suffix: str) -> str:
    return f"""{suffix}_c AS (SELECT {K}, count(*) FILTER (score >= {tau} AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= {tau} AND label = 0)::DOUBLE AS fp, count(*) FILTER (score < {tau} AND label = 1)::DOUBLE AS fn FROM {source} GROUP BY {K}),
{suffix}_p AS (SELECT {K}, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM {suffix}_c),
{suffix} AS (SELECT {K}, p AS p_{suffix}, r AS r_{suffix}, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1_{suffix} FROM {suffix}_p)"""


def free(source: str, name: str = "free", keys: str = K) -> str:
    return f"""{name}_s AS (SELECT {keys}, score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS cnt FROM {source} GROUP BY {keys}, score),
{name}_w AS (SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) AS tp, sum(cnt) OVER (PARTITION BY {keys} ORDER BY score DESC) AS seen, sum(pos) OVER (PARTITION BY {keys}) AS n_pos, sum(cnt) OVER (PARTITION BY {keys}) AS n, coalesce(sum(cnt) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (cnt + 1) / 2 AS rank FROM {name}_s),
{name} AS (SELECT {keys}, CASE WHEN min(n_pos) > 0 AND min(n_pos) < min(n) THEN sum(pos / n_pos * tp / seen) END AS auprc, CASE WHEN min(n_pos) > 0 AND min(n_pos) < min(n) THEN (sum(pos * rank) - min(n_pos) * (min(n_pos) + 1) / 2) / (min(n_pos) * (min(n) - min(n_pos))) END AS roc_auc, sum(pos) / sum(cnt) AS pos_rate FROM {name}_w GROUP BY {keys})"""


TAU = f"""val AS (SELECT * FROM {{predictions}} WHERE part = 'val'), test AS (SELECT * FROM {{predictions}} WHERE part = 'test'),
u AS (SELECT DISTINCT {K}, score FROM val),
mid AS (SELECT {K}, (score + lead(score) OVER (PARTITION BY {K} ORDER BY score)) / 2 AS tau FROM u UNION ALL SELECT DISTINCT {K}, 0.0::DOUBLE FROM u UNION ALL SELECT DISTINCT {K}, 1.0::DOUBLE FROM u),
swept AS (SELECT m.arm, m.seed, m.tau, count(*) FILTER (v.score >= m.tau AND v.label = 1)::DOUBLE AS tp, count(*) FILTER (v.score >= m.tau AND v.label = 0)::DOUBLE AS fp, count(*) FILTER (v.score < m.tau AND v.label = 1)::DOUBLE AS fn FROM (SELECT * FROM mid WHERE tau IS NOT NULL) m JOIN val v ON m.arm = v.arm AND m.seed = v.seed GROUP BY m.arm, m.seed, m.tau),
f AS (SELECT {K}, tau, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 12) AS f1 FROM swept),
taus AS (SELECT {K}, tau FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY f1 DESC, tau) AS rn FROM f) WHERE rn = 1)"""


def predictions(spark, d, part: str | None = None):
    df = view(spark, d, "predictions")
    return df if part is None else df.where(F.col("part") == part)


HALF = ("p_at_half", "r_at_half", "f1_at_half")


@register("e1_prf_at_threshold", sql_over("WITH " + prf("{predictions}", "0.5", "at_half") + f" SELECT {K}, " + rounded(*HALF) + " FROM at_half"))
def e1(spark, d):
    return round_all(sc.prf_at(predictions(spark, d), KEYS), *HALF)


@register("e2_select_threshold", sql_over("WITH " + TAU + f" SELECT {K}, round(tau, 9) + 0.0 AS tau FROM taus"))
def e2(spark, d):
    return round_all(sc.select_threshold(predictions(spark, d, "val"), KEYS), "tau", digits=9)


@register("e3_average_precision", sql_over("WITH " + free("{predictions}") + f" SELECT {K}, " + rounded("auprc") + " FROM free"))
def e3(spark, d):
    return round_all(sc.average_precision(predictions(spark, d), KEYS), "auprc")


@register("e4_roc_auc", sql_over("WITH " + free("{predictions}") + f" SELECT {K}, " + rounded("roc_auc") + " FROM free"))
def e4(spark, d):
    return round_all(sc.roc_auc(predictions(spark, d), KEYS), "roc_auc")


@register("e5_pos_rate", sql_over(f"SELECT {K}, round(avg(label), 7) + 0.0 AS pos_rate FROM {{predictions}} GROUP BY {K}"))
def e5(spark, d):
    return round_all(predictions(spark, d).groupBy(*KEYS).agg(F.avg("label").alias("pos_rate")), "pos_rate")


RECORD = ("auprc", "roc_auc", "pos_rate", *HALF, "tau", "p_at_tau", "r_at_tau", "f1_at_tau")


@register(
    "e6_metric_record",
    sql_over("WITH " + TAU + ", " + free("test") + ", " + prf("test", "0.5", "at_half") + ", tested AS (SELECT t.*, tau FROM test t JOIN taus x ON t.arm = x.arm AND t.seed = x.seed), " + prf("tested", "tau", "at_tau")
    + f" SELECT {K}, " + rounded(*RECORD) + ", true AS tau_selected, round(f1_at_half, 7) + 0.0 AS F1, round(p_at_half, 7) + 0.0 AS P, round(r_at_half, 7) + 0.0 AS R FROM free JOIN at_half USING (arm, seed) JOIN at_tau USING (arm, seed) JOIN taus USING (arm, seed)"),
)
def e6(spark, d):
    return round_all(sc.score_arms(predictions(spark, d, "test"), predictions(spark, d, "val"), KEYS), *RECORD, "F1", "P", "R")


FEATS = [f"f{i}" for i in range(1, 13)]


@register(
    "e7_single_feature_auc",
    sql_over("WITH long AS (SELECT 'f' || cast(i AS string) AS feature, embedding[i]::DOUBLE AS score, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label FROM {embeddings} CROSS JOIN (SELECT unnest(range(1, 13)) AS i) AS n), " + free("long", "free", "feature") + ", c AS (SELECT feature, count(*) AS n_test, cast(sum(label) AS bigint) AS n_pos FROM long GROUP BY feature) SELECT feature, n_test, n_pos, round(roc_auc, 7) + 0.0 AS auc, round(greatest(roc_auc, 1 - roc_auc), 7) + 0.0 AS auc_oriented, CASE WHEN roc_auc >= 0.5 THEN 'high' ELSE 'low' END AS deletion_side FROM free JOIN c USING (feature)"),
)
def e7(spark, d):
    e = view(spark, d, "embeddings")
    table = e.select((F.col("label") < 3).cast("int").alias("label"), *[F.element_at("embedding", i).cast("double").alias(f"f{i}") for i in range(1, 13)])
    return round_all(sc.separability(table, FEATS), "auc", "auc_oriented")


@register("e8_length_recall", sql_over(f"SELECT {K}, CASE WHEN del_len < 200 THEN '50-200' WHEN del_len < 500 THEN '200-500' WHEN del_len < 1000 THEN '500-1000' WHEN del_len < 5000 THEN '1000-5000' ELSE '5000+' END AS stratum, count(*) AS n, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE), 7) + 0.0 AS recall FROM {{predictions}} WHERE label = 1 GROUP BY {K}, 3"))
def e8(spark, d):
    return round_all(sc.stratified_recall(predictions(spark, d), KEYS, wn.length_stratum(F.col("del_len"))), "recall")


@register(
    "e9_calibration_error",
    sql_over(f"WITH c AS (SELECT {K}, greatest(score, 1 - score) AS conf, CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS good FROM {{predictions}}), b AS (SELECT *, len(list_filter([i / 15.0::DOUBLE FOR i IN range(15)], lambda e: e < conf)) AS bin FROM c), g AS (SELECT {K}, bin, count(*) AS cnt, avg(conf) AS conf, avg(good) AS good FROM b GROUP BY {K}, bin) SELECT {K}, round(sum(CASE WHEN bin > 0 THEN cnt * abs(good - conf) ELSE 0 END) / sum(cnt), 7) + 0.0 AS ece FROM g GROUP BY {K}"),
)
def e9(spark, d):
    return round_all(sc.calibration_error(predictions(spark, d), KEYS), "ece")


TEMPS = tuple(i / 10 for i in range(2, 51, 2))


@register(
    "e10_temperature_grid",
    sql_over(f"WITH z AS (SELECT {K}, label, (score - 0.5) * 6 / t AS z, t FROM {{predictions}} CROSS JOIN (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in TEMPS)}]) AS t) AS g), n AS (SELECT {K}, t, avg(CASE WHEN z > 0 THEN ln(1 + exp(-z)) + z * (1 - label) ELSE ln(1 + exp(z)) - z * label END) AS nll FROM z GROUP BY {K}, t) SELECT {K}, t AS temperature, round(nll, 6) + 0.0 AS nll FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY round(nll, 12), t) AS rn FROM n) WHERE rn = 1"),
)
def e10(spark, d):
    logits = predictions(spark, d).withColumn("logit", (F.col("score") - 0.5) * 6)
    return round_all(sc.temperature(logits, KEYS, TEMPS), "nll", digits=6)


@register(
    "e10_temperature",
    sql_over(f"""WITH RECURSIVE c AS (SELECT {K}, (score - 0.5) * 6 AS z, label AS y, count(*)::DOUBLE AS n FROM {{predictions}} GROUP BY {K}, score, label),
l AS (SELECT {K}, list(struct_pack(z := z, y := y, n := n)) AS c FROM c GROUP BY {K}),
r AS (SELECT {K}, 0 AS i, 1.0::DOUBLE / {max(TEMPS)} AS lo, 1.0::DOUBLE / {min(TEMPS)} AS hi FROM l
  UNION ALL SELECT {K}, i + 1, CASE WHEN g > 0 THEN lo ELSE mid END, CASE WHEN g > 0 THEN mid ELSE hi END FROM (SELECT r.*, (lo + hi) / 2 AS mid, list_sum(list_transform(c, lambda x: x.n * x.z * (1 / (1 + exp(-x.z * (lo + hi) / 2)) - x.y))) AS g FROM r JOIN l USING ({K}) WHERE i < 60)),
t AS (SELECT {K}, lo AS s FROM r WHERE i = 60)
SELECT {K}, round(1 / min(s), 6) + 0.0 AS temperature, round(sum(n * (ln(1 + exp(-abs(z * s))) + greatest(z * s, 0) - z * s * y)) / sum(n), 9) + 0.0 AS nll FROM t JOIN c USING ({K}) GROUP BY {K}"""),
)
def e10_fitted(spark, d):
    """The continuous minimum; its twin halves the interval of 1 / T in which the derivative changes sign."""
    logits = predictions(spark, d).withColumn("logit", (F.col("score") - 0.5) * 6)
    return round_all(round_all(sc.fitted_temperature(logits, KEYS, TEMPS), "temperature", digits=6), "nll", digits=9)


QHAT = f"""s AS (SELECT {K}, CASE WHEN label = 1 THEN 1 - score ELSE score END AS s FROM {{predictions}} WHERE part = 'val'),
ranked AS (SELECT {K}, s, row_number() OVER (PARTITION BY {K} ORDER BY s) AS rn, count(*) OVER (PARTITION BY {K}) AS n FROM s),
qhats AS (SELECT {K}, min(s) AS qhat FROM ranked WHERE rn >= ceil(round(least(ceil((n + 1) * (1 - 0.1::DOUBLE)) / n, 1.0) * (n - 1), 9)) + 1 GROUP BY {K})"""


@register("e11_conformal", sql_over("WITH " + QHAT + f", k AS (SELECT p.arm, p.seed, p.label, qhat, score <= qhat AS keep0, (1 - score) <= qhat AS keep1 FROM {{predictions}} p JOIN qhats q ON p.arm = q.arm AND p.seed = q.seed WHERE part = 'test') SELECT {K}, round(min(qhat), 7) + 0.0 AS qhat, round(avg(CASE WHEN CASE WHEN label = 1 THEN keep1 ELSE keep0 END THEN 1.0 ELSE 0.0 END::DOUBLE), 7) + 0.0 AS coverage, round(avg(cast(keep0 AS int) + cast(keep1 AS int)), 7) + 0.0 AS mean_size, count(*) AS n FROM k GROUP BY {K}"))
def e11(spark, d):
    qhat = sc.conformal_threshold(predictions(spark, d, "val"), KEYS)
    covered = sc.conformal_coverage(sc.conformal_sets(predictions(spark, d, "test"), qhat, KEYS), KEYS).join(qhat, KEYS)
    return round_all(covered, "qhat", "coverage", "mean_size")


UNCERTAIN = ("predictive", "aleatoric", "epistemic", "confidence")


@register(
    "e12_sampled_uncertainty",
    sql_over("WITH s AS (SELECT l_suppkey AS item, l_linenumber AS sample, avg(l_discount) * 9 AS p1 FROM {lineitem} GROUP BY 1, 2), c AS (SELECT item, sample, 1 AS cls, least(p1, 1.0) AS p FROM s UNION ALL SELECT item, sample, 0, 1 - least(p1, 1.0) FROM s), t AS (SELECT item, -sum(p * ln(p + 1e-9)) AS predictive, max(p) AS confidence FROM (SELECT item, cls, avg(p) AS p FROM c GROUP BY item, cls) GROUP BY item), a AS (SELECT item, avg(h) AS aleatoric FROM (SELECT item, sample, -sum(p * ln(p + 1e-9)) AS h FROM c GROUP BY item, sample) GROUP BY item) SELECT item, " + rounded("predictive", "aleatoric", "confidence", digits=6) + ", round(predictive - aleatoric, 6) + 0.0 AS epistemic FROM t JOIN a USING (item)"),
)
def e12(spark, d):
    s = view(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("sample")).agg(F.least(F.avg("l_discount") * 9, F.lit(1.0)).alias("p1"))
    long = s.select("item", "sample", F.explode(F.array(F.struct(F.lit(1).alias("class"), F.col("p1").alias("p")), F.struct(F.lit(0).alias("class"), (1 - F.col("p1")).alias("p")))).alias("c")).select("item", "sample", "c.*")
    return round_all(sc.sampled_uncertainty(long, "item"), *UNCERTAIN, digits=6)


GAPS = ("f1_at_tau", "auprc", "f1_at_half")


@register(
    "e13_transfer",
    sql_over("WITH " + TAU + ", ins AS (SELECT t.*, tau FROM test t JOIN taus x ON t.arm = x.arm AND t.seed = x.seed WHERE chrom_int <= 11), outs AS (SELECT t.*, tau FROM test t JOIN taus x ON t.arm = x.arm AND t.seed = x.seed WHERE chrom_int > 11), "
    + prf("ins", "tau", "i_tau") + ", " + prf("ins", "0.5", "i_half") + ", " + free("ins", "i_free") + ", " + prf("outs", "tau", "o_tau") + ", " + prf("outs", "0.5", "o_half") + ", " + free("outs", "o_free")
    + f", j AS (SELECT arm, seed, tau, f1_i_tau AS in_f1_at_tau, f1_i_half AS in_f1_at_half, i_free.auprc AS in_auprc, f1_o_tau AS out_f1_at_tau, f1_o_half AS out_f1_at_half, o_free.auprc AS out_auprc FROM taus JOIN i_tau USING (arm, seed) JOIN i_half USING (arm, seed) JOIN i_free USING (arm, seed) JOIN o_tau USING (arm, seed) JOIN o_half USING (arm, seed) JOIN o_free USING (arm, seed)) SELECT {K}, round(tau, 9) + 0.0 AS tau, "
    + rounded(*[f"{p}_{c}" for p in ("in", "out") for c in GAPS]) + ", " + ", ".join(f"round(in_{c} - out_{c}, 7) + 0.0 AS gap_{c}" for c in GAPS) + " FROM j"),
)
def e13(spark, d):
    test = predictions(spark, d, "test")
    out = sc.transfer(predictions(spark, d, "val"), test.where("chrom_int <= 11"), test.where("chrom_int > 11"), KEYS)
    return round_all(round_all(out, "tau", digits=9), *[f"{p}_{c}" for p in ("in", "out", "gap") for c in GAPS])


@register("p9_softmax_positive", sql_over("SELECT l_suppkey, round(avg(1 / (1 + exp(l_tax * 10 - l_discount * 10))), 7) + 0.0 AS mean_score, count(*) AS n FROM {lineitem} GROUP BY l_suppkey"))
def p9(spark, d):
    p = sc.softmax_positive(F.col("l_tax") * 10, F.col("l_discount") * 10)
    return round_all(view(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg(p).alias("mean_score"), F.count(F.lit(1)).alias("n")), "mean_score")
