"""Aggregation, inference and audit queries (G, T, J10 to J16, P11 to P13, X) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as inf
from .pileup_queries import round_all, rounded
from .registry import register
from .views import sql_over, view

C = "benchmark, frac, metric"
SUMMED = f"summed AS (SELECT {C}, arm, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS sd, stddev_pop(value) AS sd_pop, count(*) AS n FROM {{runs}} GROUP BY {C}, arm)"
A, B = "A", "R"


def runs(spark, d):
    return view(spark, d, "runs")


def summed(spark, d, population=False):
    return inf.summary(runs(spark, d), [*inf.CELL, "arm"], population)


@register("g1_mean_sd_sample", sql_over("WITH " + SUMMED + f" SELECT {C}, arm, {rounded('mean', 'sd')}, n FROM summed"))
def g1(spark, d):
    return round_all(summed(spark, d), "mean", "sd")


@register("g1_mean_sd_population", sql_over("WITH " + SUMMED + f" SELECT {C}, arm, round(mean, 7) + 0.0 AS mean, round(sd_pop, 7) + 0.0 AS sd, n FROM summed"))
def g1b(spark, d):
    return round_all(summed(spark, d, True), "mean", "sd")


@register("g2_per_seed_list", sql_over(f"SELECT {C}, arm, string_agg(printf('%.6f', value), ';' ORDER BY seed, value) AS per_seed FROM {{runs}} GROUP BY {C}, arm"))
def g2(spark, d):
    return inf.seed_list(runs(spark, d), [*inf.CELL, "arm"], 6)


EFF = ("auprc_mean", "auprc_sd", "f1_at_tau_mean", "f1_at_tau_sd")


@register("g3_label_efficiency", sql_over("SELECT benchmark, arm, frac, count(DISTINCT seed) AS n_seeds, " + ", ".join(f"round({f}(value) FILTER (metric = '{m}'), 7) + 0.0 AS {m}_{n}" for m in ("auprc", "f1_at_tau") for f, n in (("avg", "mean"), ("stddev_pop", "sd"))) + " FROM {runs} GROUP BY benchmark, arm, frac"))
def g3(spark, d):
    return round_all(inf.efficiency_table(runs(spark, d), ["auprc", "f1_at_tau"]), *EFF)


@register("g4_calibration_table", sql_over("SELECT benchmark, arm, round(avg(value), 11) + 0.0 AS mean, round(stddev_pop(value), 11) + 0.0 AS sd, round(quantile_cont(value, 0.5), 11) + 0.0 AS median FROM {runs} WHERE frac = 1.0 GROUP BY benchmark, arm"))
def g4(spark, d):
    full = runs(spark, d).where("frac = 1.0").groupBy("benchmark", "arm").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.expr("percentile(value, 0.5)").alias("median"))
    return round_all(full, "mean", "sd", "median", digits=11)


@register("g5_strata_over_seeds", sql_over("WITH r AS (SELECT arm, seed, CASE WHEN del_len < 1000 THEN 'short' ELSE 'long' END AS stratum, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE) AS recall FROM {predictions} WHERE label = 1 GROUP BY 1, 2, 3) SELECT arm, stratum, round(avg(recall), 7) + 0.0 AS mean, round(stddev_samp(recall), 7) + 0.0 AS sd, count(*) AS n FROM r GROUP BY arm, stratum"))
def g5(spark, d):
    from ..operators import scoring as sc

    stratum = F.when(F.col("del_len") < 1000, "short").otherwise("long")
    recall = sc.stratified_recall(view(spark, d, "predictions"), ["arm", "seed"], stratum)
    return round_all(inf.summary(recall.withColumnRenamed("recall", "value"), ["arm", "stratum"]), "mean", "sd")


@register("g6_ablation_table", sql_over("WITH " + SUMMED + f" SELECT benchmark, cast(frac AS DOUBLE) AS frac, arm, metric, {rounded('mean', 'sd')}, n FROM summed"))
def g6(spark, d):
    return round_all(summed(spark, d).select("benchmark", F.col("frac").cast("double").alias("frac"), "arm", "metric", "mean", "sd", "n"), "mean", "sd")


@register("g7_transfer_table", sql_over("WITH " + SUMMED + " SELECT arm, frac, metric, round(avg(mean) FILTER (benchmark = 'F'), 7) + 0.0 AS in_dist, round(avg(mean) FILTER (benchmark = 'O'), 7) + 0.0 AS held_out, round(avg(mean) FILTER (benchmark = 'F') - avg(mean) FILTER (benchmark = 'O'), 7) + 0.0 AS gap FROM summed GROUP BY arm, frac, metric"))
def g7(spark, d):
    s = summed(spark, d)
    at = lambda b: F.avg(F.when(F.col("benchmark") == b, F.col("mean")))
    return round_all(s.groupBy("arm", "frac", "metric").agg(at("F").alias("in_dist"), at("O").alias("held_out"), (at("F") - at("O")).alias("gap")), "in_dist", "held_out", "gap")


@register("g8_control_table", sql_over("WITH " + SUMMED + f", c AS (SELECT benchmark, frac, round(avg(value), 9) + 0.0 AS chance FROM {{runs}} WHERE arm = 'N' GROUP BY benchmark, frac) SELECT s.benchmark, s.frac, metric, arm, {rounded('mean', 'sd')}, n, chance FROM summed s JOIN c ON s.benchmark = c.benchmark AND s.frac = c.frac WHERE arm IN ('A', 'R')"))
def g8(spark, d):
    chance = runs(spark, d).where("arm = 'N'").groupBy("benchmark", "frac").agg((F.round(F.avg("value"), 9) + 0.0).alias("chance"))
    return round_all(summed(spark, d).where(F.col("arm").isin("A", "R")).join(chance, ["benchmark", "frac"]), "mean", "sd")


@register("g9_ceiling", sql_over("WITH " + SUMMED + " SELECT benchmark, metric, arm, round(arg_max(mean, frac) - arg_min(mean, frac), 7) + 0.0 AS gain, round(arg_min(mean, frac) / arg_max(mean, frac), 7) + 0.0 AS share_of_ceiling, round(max(frac) / min(frac), 7) + 0.0 AS label_multiplier FROM summed GROUP BY benchmark, metric, arm"))
def g9(spark, d):
    return round_all(inf.ceiling(summed(spark, d), ["benchmark", "metric", "arm"]), "gain", "share_of_ceiling", "label_multiplier")


@register("g10_provenance", sql_over("SELECT benchmark, arm, metric, frac, count(DISTINCT seed) = count(*) AS one_run_per_seed, count(*) AS n FROM {runs} GROUP BY benchmark, arm, metric, frac"))
def g10(spark, d):
    return runs(spark, d).groupBy("benchmark", "arm", "metric", "frac").agg((F.count_distinct("seed") == F.count(F.lit(1))).alias("one_run_per_seed"), F.count(F.lit(1)).alias("n"))


PAIR = f"pair AS (SELECT a.benchmark, a.frac, a.metric, a.mean AS ma, b.mean AS mb, a.sd AS sda, b.sd AS sdb, a.n AS na, b.n AS nb FROM summed a JOIN summed b ON a.benchmark = b.benchmark AND a.frac = b.frac AND a.metric = b.metric WHERE a.arm = '{A}' AND b.arm = '{B}')"


@register("g11_wins", sql_over("WITH " + SUMMED + ", " + PAIR + " SELECT benchmark, metric, count(*) FILTER (ma > mb) AS wins, count(*) AS of FROM pair GROUP BY benchmark, metric").replace("AS of FROM", 'AS "of" FROM'))
def g11(spark, d):
    return inf.wins(summed(spark, d), A, B)


@register("g12_variance_ratio", sql_over("WITH " + SUMMED + ", " + PAIR + f" SELECT {C}, round(sda, 7) + 0.0 AS sd_a, round(sdb, 7) + 0.0 AS sd_b, CASE WHEN sdb <> 0 THEN round(sda / sdb, 6) + 0.0 END AS ratio FROM pair"))
def g12(spark, d):
    return round_all(round_all(inf.variance_ratio(summed(spark, d), A, B), "sd_a", "sd_b"), "ratio", digits=6)


@register("g13_saturation", sql_over("WITH " + SUMMED + " SELECT benchmark, arg_max(arm, mean) AS best_arm, round(max(mean), 7) + 0.0 AS best_mean, count(*) AS n_arms FROM summed WHERE metric = 'auprc' AND frac = 1.0 GROUP BY benchmark"))
def g13(spark, d):
    full = summed(spark, d).where("metric = 'auprc' AND frac = 1.0")
    return round_all(full.groupBy("benchmark").agg(F.max_by("arm", "mean").alias("best_arm"), F.max("mean").alias("best_mean"), F.count(F.lit(1)).alias("n_arms")), "best_mean")


STRICT = "strict AS (SELECT doc_id, source, axis_a, axis_b, axis_c, axis_d, CASE WHEN axis_a IN ('uniform', 'simulated', 'no') THEN 1 ELSE 0 END AS d1, CASE WHEN axis_b = 'yes' THEN 1 ELSE 0 END AS d2, CASE WHEN axis_c = 'missing' THEN 1 ELSE 0 END AS d3, CASE WHEN axis_d <> 'reported' THEN 1 ELSE 0 END AS d4 FROM {codes})"


@register("p11_strict_flags", sql_over("WITH " + STRICT + " SELECT *, d1 + d2 + d3 + d4 AS n_strict FROM strict"))
def p11(spark, d):
    return inf.strict_flags(view(spark, d, "codes"))


@register("g14_audit_counts", sql_over("WITH " + STRICT + " SELECT source, count(*) AS n, cast(sum(d1) AS bigint) AS n_d1, cast(sum(d4) AS bigint) AS n_d4, count(*) FILTER (d1 + d2 + d3 + d4 >= 3) AS three_or_more, min(d1 + d2 + d3 + d4) AS least FROM strict GROUP BY source"))
def g14(spark, d):
    s = inf.strict_flags(view(spark, d, "codes"))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("d1").alias("n_d1"), F.sum("d4").alias("n_d4"), F.count_if(F.col("n_strict") >= 3).alias("three_or_more"), F.min("n_strict").alias("least"))


@register("g15_inclusion_screen", sql_over("SELECT CASE WHEN l.doc_id IS NULL THEN 'not coded' WHEN d.n_chars < 500 THEN 'too short' ELSE 'eligible' END AS reason, count(*) AS n FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON d.doc_id = l.doc_id GROUP BY 1"))
def g15(spark, d):
    coded = view(spark, d, "labels").select("doc_id").distinct().withColumn("coded", F.lit(True))
    reason = F.when(F.col("coded").isNull(), "not coded").when(F.col("n_chars") < 500, "too short").otherwise("eligible")
    return view(spark, d, "documents").select("doc_id", "n_chars").join(coded, "doc_id", "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("g16_plot_series", sql_over("WITH " + SUMMED + " SELECT benchmark, metric, arm, count(*) AS n_points, string_agg(printf('%.2f:%.4f', frac, mean), ' ' ORDER BY frac) AS points FROM summed GROUP BY benchmark, metric, arm"))
def g16(spark, d):
    s = inf.series(summed(spark, d), ["benchmark", "metric", "arm"])
    text = F.array_join(F.transform("points", lambda p: F.format_string("%.2f:%.4f", p["x"].cast("double"), p["y"])), " ")
    return s.select("benchmark", "metric", "arm", F.size("points").cast("long").alias("n_points"), text.alias("points"))


@register("j10_seed_paired", sql_over(f"SELECT a.benchmark, a.frac, a.metric, a.seed, round(a.value - b.value, 7) + 0.0 AS d FROM {{runs}} a JOIN {{runs}} b ON a.benchmark = b.benchmark AND a.frac = b.frac AND a.metric = b.metric AND a.seed = b.seed WHERE a.arm = '{A}' AND b.arm = '{B}'"))
def j10(spark, d):
    return round_all(inf.seed_paired(runs(spark, d), A, B).select(*inf.CELL, "seed", "d"), "d")


PUBLISHED = "published AS (SELECT benchmark, frac, metric, arm, round(avg(value), 3) + CASE WHEN frac = 0.05 THEN 0.01 ELSE 0 END AS value FROM {runs} WHERE NOT (arm = 'N' AND frac = 0.1) GROUP BY benchmark, frac, metric, arm UNION ALL SELECT benchmark, 2.0, metric, 'extra', 0.5 FROM {runs} GROUP BY benchmark, metric)"


@register("j11_reconcile", sql_over("WITH " + SUMMED + ", " + PUBLISHED + " SELECT coalesce(p.benchmark, s.benchmark) AS benchmark, coalesce(p.frac, s.frac) AS frac, coalesce(p.metric, s.metric) AS metric, coalesce(p.arm, s.arm) AS arm, round(p.value, 7) + 0.0 AS published, round(s.mean, 7) + 0.0 AS source, CASE WHEN s.arm IS NULL THEN 'not_in_source' WHEN p.arm IS NULL THEN 'not_published' WHEN round(p.value, 3) = round(s.mean, 3) THEN 'match' ELSE 'mismatch' END AS status FROM published p FULL OUTER JOIN summed s ON p.benchmark = s.benchmark AND p.frac = s.frac AND p.metric = s.metric AND p.arm = s.arm"))
def j11(spark, d):
    r, keys = runs(spark, d), [*inf.CELL, "arm"]
    shown = r.where("NOT (arm = 'N' AND frac = 0.1)").groupBy(*keys).agg(F.avg("value").alias("m")).select(*keys, (F.round("m", 3) + F.when(F.col("frac") == 0.05, 0.01).otherwise(0)).alias("value"))
    extra = r.select("benchmark", "metric").distinct().select("benchmark", F.lit(2.0).cast("decimal(3,2)").alias("frac"), "metric", F.lit("extra").alias("arm"), F.lit(0.5).alias("value"))
    shown = shown.unionByName(extra)
    return round_all(inf.reconcile(shown, summed(spark, d).withColumnRenamed("mean", "value"), keys), "published", "source")


@register("j12_quoted_values", sql_over("WITH q AS (SELECT family, test, 3 AS digits, round(p, 3) + CASE WHEN length(test) % 3 = 0 THEN 0.001 ELSE 0 END AS value FROM {tests} WHERE p IS NOT NULL) SELECT family, test, digits, round(q.value, 7) + 0.0 AS value, EXISTS (SELECT 1 FROM {tests} t WHERE abs(t.p - q.value) <= 0.0005 + 1e-9 AND t.p IS NOT NULL) AS found FROM q"))
def j12(spark, d):
    t = view(spark, d, "tests").where("p IS NOT NULL")
    quoted = t.select("family", "test", F.lit(3).alias("digits"), (F.round(F.col("p").cast("double"), 3) + F.when(F.length("test") % 3 == 0, 0.001).otherwise(0)).alias("value"))
    return round_all(inf.quoted_values(quoted, t.select(F.col("p").cast("double").alias("value"))), "value")


@register("j13_paired_separability", sql_over("WITH " + SUMMED + " SELECT a.arm, a.frac, a.metric, round(a.mean - b.mean, 7) + 0.0 AS delta FROM summed a JOIN summed b ON a.arm = b.arm AND a.frac = b.frac AND a.metric = b.metric WHERE a.benchmark = 'F' AND b.benchmark = 'O'"))
def j13(spark, d):
    s, on = summed(spark, d), ["arm", "frac", "metric"]
    a, b = s.where("benchmark = 'F'").select(*on, F.col("mean").alias("a")), s.where("benchmark = 'O'").select(*on, F.col("mean").alias("b"))
    return round_all(a.join(b, on).select(*on, (F.col("a") - F.col("b")).alias("delta")), "delta")


@register("j14_audit_integrity", sql_over("SELECT 'coded_not_in_documents' AS problem, count(*) AS n FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id) UNION ALL SELECT 'eligible_not_coded', count(*) FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE d.doc_id = l.doc_id) UNION ALL SELECT 'coded_twice', count(*) FROM (SELECT doc_id FROM {labels} GROUP BY doc_id HAVING count(*) > 1)"))
def j14(spark, d):
    coded, docs = view(spark, d, "labels").select("doc_id"), view(spark, d, "documents").select("doc_id")
    named = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    twice = coded.groupBy("doc_id").count().where("count > 1")
    return named(coded.join(docs, "doc_id", "left_anti"), "coded_not_in_documents").unionByName(named(docs.join(coded, "doc_id", "left_anti"), "eligible_not_coded")).unionByName(named(twice, "coded_twice"))


@register("j15_literal_spans", sql_over("SELECT doc_id, contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(split_part(d.text, chr(10), 1), '\\s+', ' ', 'g'))) AS verified, length(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) AS n_chars FROM (SELECT doc_id, regexp_replace(translate(text, '“”‘’–—' || chr(160), '\"\"''''-- '), '-\\s*\\n\\s*', '', 'g') AS text FROM {documents}) d"))
def j15(spark, d):
    text = inf.normal_text(F.col("text"))
    first = inf.normal_text(F.element_at(F.split(F.regexp_replace(F.translate("text", "“”‘’–— ", "\"\"''-- "), r"-\s*\n\s*", ""), "\n"), 1))
    return view(spark, d, "documents").select("doc_id", text.contains(first).alias("verified"), F.length(text).cast("long").alias("n_chars"))


NORMAL = """trim(regexp_replace(regexp_replace(translate(text, '“”‘’–—' || chr(160), '""''''-- '), '-\\s*\\n\\s*', '', 'g'), '\\s+', ' ', 'g'))"""


@register("j15_benchmark_spans", sql_over("WITH q AS (SELECT item_id, " + NORMAL + " AS quote FROM {benchmark}), s AS (SELECT doc_id, " + NORMAL + " AS source FROM {documents}) SELECT item_id, count(DISTINCT doc_id) AS n_sources, count(DISTINCT doc_id) > 0 AS verified FROM q LEFT JOIN s ON quote <> '' AND contains(source, quote) WHERE item_id IS NOT NULL GROUP BY item_id"))
def j15_benchmark(spark, d):
    found = inf.literal_spans(view(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), "text"), view(spark, d, "documents"))
    return found.select(F.col("quote_id").alias("item_id"), "n_sources", "verified")


@register("j16_arm_ranks", sql_over("WITH " + SUMMED + ", k AS (SELECT arm, frac, metric FROM summed GROUP BY arm, frac, metric HAVING count(DISTINCT benchmark) > 1), r AS (SELECT s.*, row_number() OVER (PARTITION BY s.benchmark, s.frac, s.metric ORDER BY mean DESC, s.arm) AS rank FROM summed s JOIN k ON s.arm = k.arm AND s.frac = k.frac AND s.metric = k.metric) SELECT arm, frac, metric, cast(arg_min(rank, benchmark) AS int) AS rank_first, cast(arg_max(rank, benchmark) AS int) AS rank_second, cast(arg_min(rank, benchmark) - arg_max(rank, benchmark) AS int) AS rank_change FROM r GROUP BY arm, frac, metric"))
def j16(spark, d):
    return inf.arm_ranks(summed(spark, d))


WELCH = "w AS (SELECT *, sda * sda / na AS x, sdb * sdb / nb AS y FROM pair)"
WELCH_COLS = f"{C}, '{A}' AS arm_a, '{B}' AS arm_b, round(ma, 7) + 0.0 AS mean_a, round(mb, 7) + 0.0 AS mean_b, round(ma - mb, 7) + 0.0 AS diff, CASE WHEN na > 1 AND nb > 1 AND x + y > 0 THEN round((ma - mb) / sqrt(x + y), 6) + 0.0 END AS t, CASE WHEN na > 1 AND nb > 1 AND x + y > 0 THEN round((x + y) * (x + y) / (x * x / (na - 1) + y * y / (nb - 1)), 6) + 0.0 END AS df"


def _welch(spark, d):
    w = inf.welch(runs(spark, d), [(A, B)])
    return round_all(round_all(w, "mean_a", "mean_b", "diff"), "t", "df", digits=6)


@register("t1_welch", sql_over("WITH " + SUMMED + ", " + PAIR + ", " + WELCH + f" SELECT {WELCH_COLS}, na AS n_a, nb AS n_b FROM w"))
def t1(spark, d):
    return _welch(spark, d)


DIFFS = f"diffs AS (SELECT a.benchmark, a.frac, a.metric, a.value AS a, b.value AS b, a.value - b.value AS d FROM {{runs}} a JOIN {{runs}} b ON a.benchmark = b.benchmark AND a.frac = b.frac AND a.metric = b.metric AND a.seed = b.seed WHERE a.arm = '{A}' AND b.arm = '{B}'), paired AS (SELECT {C}, count(*) AS n_seeds, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS diff, stddev_samp(d) AS diff_sd FROM diffs GROUP BY {C})"
PAIRED_COLS = f"{C}, n_seeds, {rounded('mean_a', 'mean_b', 'diff', 'diff_sd')}, CASE WHEN n_seeds > 2 AND diff_sd > 0 THEN round(diff / (diff_sd / sqrt(n_seeds)), 6) + 0.0 END AS t, CASE WHEN n_seeds > 2 AND diff_sd > 0 THEN (n_seeds - 1)::DOUBLE END AS df"


def _paired(spark, d):
    return inf.paired_t(inf.seed_paired(runs(spark, d), A, B))


@register("t2_paired_t", sql_over("WITH " + DIFFS + f" SELECT {PAIRED_COLS} FROM paired"))
def t2(spark, d):
    return round_all(round_all(_paired(spark, d), "mean_a", "mean_b", "diff", "diff_sd"), "t", digits=6)


#: Weights of Simpson's rule, and the two-sided p value of t by the integral of Student's density from 0 to |t|.
SIMPSON = "simpson AS (SELECT i / 2000.0::DOUBLE AS u, CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 6000.0::DOUBLE AS w FROM range(0, 2001) AS r(i))"


def p_sql(t: str = "t0", df: str = "df0") -> str:
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * pow(1 + {t} * {t} * u * u / {df}, -({df} + 1) / 2)"
    return f"CASE WHEN {t} IS NOT NULL THEN greatest(0, 1 - 2 * abs({t}) * (SELECT sum(w * {density}) FROM simpson)) END"


TESTED = "tested AS (SELECT *, CASE WHEN n_seeds > 2 AND diff_sd > 0 THEN diff / (diff_sd / sqrt(n_seeds)) END AS t0, (n_seeds - 1)::DOUBLE AS df0 FROM paired)"
WELCHED = "welched AS (SELECT *, CASE WHEN na > 1 AND nb > 1 AND x + y > 0 THEN (ma - mb) / sqrt(x + y) END AS t0, CASE WHEN na > 1 AND nb > 1 AND x + y > 0 THEN (x + y) * (x + y) / (x * x / (na - 1) + y * y / (nb - 1)) END AS df0 FROM w)"


@register("t3_p_values", sql_over("WITH " + DIFFS + ", " + TESTED + ", " + SIMPSON + f" SELECT {PAIRED_COLS}, round({p_sql()}, 6) + 0.0 AS p FROM tested"))
def t3(spark, d):
    return round_all(round_all(inf.with_p(_paired(spark, d)), "mean_a", "mean_b", "diff", "diff_sd"), "t", "p", digits=6)


#: Quantiles of Student's t for the degrees of freedom at hand, by halving an interval in which Simpson's integral of the density passes p.
QUANTILES = """asked AS (SELECT DISTINCT df0, p FROM tested CROSS JOIN (SELECT unnest([0.975::DOUBLE, 0.8::DOUBLE]) AS p) AS ps WHERE t0 IS NOT NULL),
halved AS (SELECT df0, p, 0 AS i, 0.0::DOUBLE AS lo, 50.0::DOUBLE AS hi FROM asked
  UNION ALL SELECT df0, p, i + 1, CASE WHEN below < p THEN mid ELSE lo END, CASE WHEN below < p THEN hi ELSE mid END FROM (SELECT *, (lo + hi) / 2 AS mid, 0.5 + (lo + hi) / 2 * exp(lgamma((df0 + 1) / 2) - lgamma(df0 / 2)) / sqrt(df0 * pi()) *
    list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END / 6000.0::DOUBLE * pow(1 + ((lo + hi) / 2 * k / 2000.0::DOUBLE) * ((lo + hi) / 2 * k / 2000.0::DOUBLE) / df0, -(df0 + 1) / 2))) AS below FROM halved WHERE i < 48)),
quants AS (SELECT df0, max(CASE WHEN p > 0.9 THEN lo END) AS q, max(CASE WHEN p < 0.9 THEN lo END) AS q80 FROM halved WHERE i = 48 GROUP BY df0)"""
INTERVAL_COLS = ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in (("ci_lo", "diff - q * diff_sd / sqrt(n_seeds)"), ("ci_hi", "diff + q * diff_sd / sqrt(n_seeds)"), ("mde80", "(q + q80) * diff_sd / sqrt(n_seeds)")))
INTERVALS = ("ci_lo", "ci_hi", "mde80")


def _rounded_tests(df, *more):
    return round_all(round_all(df, "mean_a", "mean_b", "diff", "diff_sd"), "t", *INTERVALS, *more, digits=6)


@register("t4_interval_and_power", sql_over("WITH RECURSIVE " + DIFFS + ", " + TESTED + ", " + QUANTILES + f" SELECT {PAIRED_COLS}, {INTERVAL_COLS} FROM tested LEFT JOIN quants USING (df0)"))
def t4(spark, d):
    return _rounded_tests(inf.with_interval(_paired(spark, d)))


HOLM = """known AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS rn FROM {tests} WHERE p IS NOT NULL),
adjusted AS (SELECT family, test, p, least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY family ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS p_holm, least(1.0, min(m * p / rn::DOUBLE) OVER (PARTITION BY family ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q_bh FROM known),
report AS (SELECT t.family, t.test, t.p, a.p_holm, a.q_bh, CASE WHEN t.p IS NULL THEN NULL WHEN a.p_holm < 0.05 THEN 'survives Holm' WHEN a.q_bh < 0.05 THEN 'survives BH only' WHEN t.p < 0.05 THEN 'LOST to multiplicity' ELSE 'not significant' END AS verdict FROM {tests} t LEFT JOIN adjusted a ON t.family = a.family AND t.test = a.test)"""


def _tests(spark, d):
    return view(spark, d, "tests").withColumn("p", F.col("p").cast("double"))


@register("t5_holm", sql_over("WITH " + HOLM + " SELECT family, test, round(p, 7) + 0.0::DOUBLE AS p, round(p_holm, 7) + 0.0::DOUBLE AS p_holm FROM report"))
def t5(spark, d):
    return round_all(inf.holm(_tests(spark, d), ["family"]), "p", "p_holm")


@register("t6_benjamini_hochberg", sql_over("WITH " + HOLM + " SELECT family, test, round(p, 7) + 0.0::DOUBLE AS p, round(q_bh, 11) + 0.0::DOUBLE AS q_bh FROM report"))
def t6(spark, d):
    return round_all(round_all(inf.benjamini_hochberg(_tests(spark, d), ["family"]), "p"), "q_bh", digits=11)


@register("t7_families", sql_over("SELECT 'A' AS x, family, concat(test, '/', family) AS test, round(p, 7) + 0.0::DOUBLE AS p FROM {tests} WHERE family = 'A' UNION ALL SELECT 'N', concat(family, '/all'), test, round(p, 7) + 0.0::DOUBLE FROM {tests} WHERE family <> 'A'").replace("SELECT 'A' AS x, family", "SELECT family").replace("SELECT 'N', concat", "SELECT concat"))
def t7(spark, d):
    t = _tests(spark, d)
    both = inf.families((t.where("family = 'A'"), ["family"], ["test", "family"]), (t.where("family <> 'A'").withColumn("scope", F.lit("all")), ["family", "scope"], ["test"]))
    return round_all(both, "p")


@register("t8_multiplicity_report", sql_over("WITH " + HOLM + " SELECT family, test, round(p, 7) + 0.0::DOUBLE AS p, round(p_holm, 7) + 0.0::DOUBLE AS p_holm, round(q_bh, 11) + 0.0::DOUBLE AS q_bh, verdict FROM report"))
def t8(spark, d):
    return round_all(round_all(inf.multiplicity_report(_tests(spark, d), ["family"]), "p", "p_holm"), "q_bh", digits=11)


@register("t8_multiplicity_totals", sql_over("WITH " + HOLM + " SELECT count(p) AS n_tests, count(*) FILTER (p < 0.05) AS nominal, count(*) FILTER (q_bh < 0.05) AS bh, count(*) FILTER (p_holm < 0.05) AS holm FROM report"))
def t8b(spark, d):
    return inf.multiplicity_totals(inf.multiplicity_report(_tests(spark, d), ["family"]))


@register("t9_best_of_family", sql_over("WITH " + SUMMED + f", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {C} ORDER BY mean DESC, CASE arm WHEN 'A' THEN 1 ELSE 2 END) AS rn FROM summed WHERE arm IN ('A', 'N') AND n > 1) WHERE rn = 1) SELECT b.benchmark, b.frac, b.metric, b.arm AS arm_a, s.arm AS arm_b, round(b.mean, 7) + 0.0 AS mean_a, round(s.mean, 7) + 0.0 AS mean_b, round(b.mean - s.mean, 7) + 0.0 AS diff, CASE WHEN b.sd * b.sd / b.n + s.sd * s.sd / s.n > 0 THEN round((b.mean - s.mean) / sqrt(b.sd * b.sd / b.n + s.sd * s.sd / s.n), 6) + 0.0 END AS t FROM b JOIN summed s ON b.benchmark = s.benchmark AND b.frac = s.frac AND b.metric = s.metric WHERE s.arm = 'R' AND s.n > 1"))
def t9(spark, d):
    return round_all(round_all(inf.best_of_family(summed(spark, d), ["A", "N"], ["R"]).drop("df"), "mean_a", "mean_b", "diff"), "t", digits=6)


BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY " + C + " ORDER BY mean DESC, CASE arm WHEN 'A' THEN 1 ELSE 2 END) AS rn FROM summed WHERE arm IN ('A', 'N') AND n > 1) WHERE rn = 1), w AS (SELECT b.benchmark, b.frac, b.metric, b.arm AS arm_a, s.arm AS arm_b, b.mean AS ma, s.mean AS mb, b.n AS na, s.n AS nb, b.sd * b.sd / b.n AS x, s.sd * s.sd / s.n AS y FROM best b JOIN summed s ON b.benchmark = s.benchmark AND b.frac = s.frac AND b.metric = s.metric WHERE s.arm = 'R' AND s.n > 1)"
LED = "CASE WHEN p IS NULL OR p >= 0.05 THEN 'tie' WHEN ma > mb THEN 'a' ELSE 'b' END"
MEANS = "round(ma, 7) + 0.0 AS mean_a, round(mb, 7) + 0.0 AS mean_b, round(ma - mb, 7) + 0.0 AS diff, round(t0, 6) + 0.0 AS t, round(df0, 6) + 0.0 AS df, round(p, 6) + 0.0 AS p"


@register("t9_leader", sql_over("WITH " + SUMMED + ", " + BEST + ", " + WELCHED + ", " + SIMPSON + f", ps AS (SELECT *, {p_sql()} AS p FROM welched) SELECT {C}, arm_a, arm_b, {MEANS}, {LED} AS leader FROM ps"))
def t9b(spark, d):
    led = inf.with_p(inf.best_of_family(summed(spark, d), ["A", "N"], ["R"])).withColumn("leader", inf.leader())
    return round_all(round_all(led, "mean_a", "mean_b", "diff"), "t", "df", "p", digits=6)


@register("t10_rule_sensitivity", sql_over("WITH " + SUMMED + ", " + PAIR + f" SELECT {C}, round(ma, 7) + 0.0 AS mean_a, round(mb, 7) + 0.0 AS mean_b, CASE WHEN mb <= 1e-9 THEN 'inf'::DOUBLE ELSE round(ma / mb, 6) + 0.0 END AS ratio FROM pair"))
def t10(spark, d):
    return round_all(round_all(inf.rule_sensitivity(summed(spark, d), A, B), "mean_a", "mean_b"), "ratio", digits=6)


def every_pair(pairs: str) -> str:
    return f"w AS (SELECT a.benchmark, a.frac, a.metric, a.arm AS arm_a, b.arm AS arm_b, a.mean AS ma, b.mean AS mb, a.n AS na, b.n AS nb, a.sd * a.sd / a.n AS x, b.sd * b.sd / b.n AS y FROM summed a JOIN summed b ON a.benchmark = b.benchmark AND a.frac = b.frac AND a.metric = b.metric WHERE (a.arm, b.arm) IN ({pairs}))"


@register("t11_pairwise_contrasts", sql_over("WITH " + SUMMED + ", " + every_pair("('A', 'N'), ('A', 'R'), ('N', 'R')") + ", " + WELCHED + ", " + SIMPSON + f", ps AS (SELECT *, {p_sql()} AS p FROM welched) SELECT {C}, arm_a, arm_b, na AS n_a, nb AS n_b, {MEANS}, {LED} AS verdict FROM ps"))
def t11(spark, d):
    tested = inf.with_p(inf.welch(runs(spark, d), [("A", "N"), ("A", "R"), ("N", "R")])).withColumn("verdict", inf.leader())
    return round_all(round_all(tested, "mean_a", "mean_b", "diff"), "t", "df", "p", digits=6)


@register("t12_primary_verdicts", sql_over("WITH " + DIFFS + ", " + TESTED + ", " + SIMPSON + f""", ps AS (SELECT *, {p_sql()} AS p FROM tested),
ranked AS (SELECT *, count(*) OVER (PARTITION BY benchmark, metric) AS m, row_number() OVER (PARTITION BY benchmark, metric ORDER BY p) AS rn FROM ps WHERE p IS NOT NULL),
adjusted AS (SELECT {C}, least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY benchmark, metric ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS p_holm FROM ranked)
SELECT ps.benchmark, ps.frac, ps.metric, round(diff, 7) + 0.0 AS diff, round(p, 6) + 0.0 AS p, round(p_holm, 6) + 0.0 AS p_holm, CASE WHEN p_holm < 0.05 THEN CASE WHEN diff > 0 THEN 'a better' ELSE 'b better' END ELSE 'not separated' END AS verdict
FROM ps LEFT JOIN adjusted a ON ps.benchmark = a.benchmark AND ps.frac = a.frac AND ps.metric = a.metric"""))
def t12b(spark, d):
    return round_all(round_all(t12(spark, d).select(*inf.CELL, "diff", "p", "p_holm", "verdict"), "diff"), "p", "p_holm", digits=6)


@register("t10_rule_p", sql_over("WITH " + SUMMED + ", " + every_pair("('A', 'R')") + ", " + WELCHED + ", " + SIMPSON + f" SELECT {C}, CASE WHEN mb <= 1e-9 THEN 'inf'::DOUBLE ELSE round(ma / mb, 6) + 0.0 END AS ratio, round({p_sql()}, 6) + 0.0 AS p FROM welched"))
def t10b(spark, d):
    """The ratio of two arms under each scoring rule, with the p value of their difference under it."""
    p = inf.with_p(inf.welch(runs(spark, d), [(A, B)])).select(*inf.CELL, "p")
    return round_all(inf.rule_sensitivity(summed(spark, d), A, B).join(p, inf.CELL).select(*inf.CELL, "ratio", "p"), "ratio", "p", digits=6)


@register("g7_transfer_p", sql_over("WITH " + SUMMED + ", w AS (SELECT a.frac, a.metric, a.arm, a.mean AS ma, b.mean AS mb, a.n AS na, b.n AS nb, a.sd * a.sd / a.n AS x, b.sd * b.sd / b.n AS y FROM summed a JOIN summed b ON a.arm = b.arm AND a.frac = b.frac AND a.metric = b.metric WHERE a.benchmark = 'F' AND b.benchmark = 'O'), " + WELCHED + ", " + SIMPSON + f" SELECT arm, frac, metric, round(ma, 7) + 0.0 AS in_dist, round(mb, 7) + 0.0 AS held_out, round(ma - mb, 7) + 0.0 AS gap, CASE WHEN arm = 'A' THEN round({p_sql()}, 6) + 0.0 END AS p FROM welched"))
def g7b(spark, d):
    """In-distribution against held-out benchmark; Welch's p on the first arm's rows only."""
    swapped = runs(spark, d).select("benchmark", F.col("arm").alias("own"), "frac", "metric", "value").withColumnRenamed("benchmark", "arm")
    tested = inf.with_p(inf.welch(swapped, [("F", "O")], ["own", "frac", "metric"]))
    shown = tested.select(F.col("own").alias("arm"), "frac", "metric", F.col("mean_a").alias("in_dist"), F.col("mean_b").alias("held_out"), F.col("diff").alias("gap"), F.when(F.col("own") == A, F.col("p")).alias("p"))
    return round_all(round_all(shown, "in_dist", "held_out", "gap"), "p", digits=6)


CLAIM = "SELECT concat_ws(' ', '{kind}', benchmark, metric) AS claim, frac, round(t0, 6) + 0.0 AS statistic, round({p}, 6) + 0.0 AS p, round({a}, 7) + 0.0 AS mean_a, round({b}, 7) + 0.0 AS mean_b, CASE WHEN {b} > 0 THEN concat('ratio ', printf('%.2f', round({a} / {b}, 2))) ELSE 'no ratio' END AS note FROM {of}"


@register("t13_claims", sql_over("WITH " + SUMMED + ", " + every_pair("('A', 'R')") + ", " + WELCHED + ", " + DIFFS + ", " + TESTED + ", " + SIMPSON + " " + CLAIM.format(kind="welch", p=p_sql(), a="ma", b="mb", of="welched") + " UNION ALL " + CLAIM.format(kind="paired", p=p_sql(), a="mean_a", b="mean_b", of="tested")))
def t13b(spark, d):
    """Each claim with its test, statistic, p value, means and the ratio of these."""

    def claim(tests, kind):
        ratio = F.when(F.col("mean_b") > 0, F.concat(F.lit("ratio "), inf.render(F.col("mean_a") / F.col("mean_b"), 2))).otherwise("no ratio")
        return inf.with_p(tests).select(F.concat_ws(" ", F.lit(kind), "benchmark", "metric").alias("claim"), "frac", F.col("t").alias("statistic"), "p", "mean_a", "mean_b", ratio.alias("note"))

    both = claim(inf.welch(runs(spark, d), [(A, B)]), "welch").unionByName(claim(_paired(spark, d), "paired"))
    return round_all(round_all(both, "statistic", "p", digits=6), "mean_a", "mean_b")


T12 = DIFFS + ", " + TESTED + ", " + QUANTILES + ", " + SIMPSON + f""", known AS (SELECT tested.*, {p_sql()} AS p FROM tested),
ranked AS (SELECT *, count(p) OVER (PARTITION BY benchmark, metric) AS m, row_number() OVER (PARTITION BY benchmark, metric, p IS NULL ORDER BY p) AS rn FROM known),
adjusted AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY benchmark, metric, p IS NULL ORDER BY rn ROWS UNBOUNDED PRECEDING)) END AS p_holm FROM ranked)"""


@register("t12_primary_contrast", sql_over("WITH RECURSIVE " + T12 + f" SELECT {PAIRED_COLS}, {INTERVAL_COLS}, round(p, 6) + 0.0 AS p, round(p_holm, 6) + 0.0 AS p_holm, CASE WHEN p_holm < 0.05 THEN CASE WHEN diff > 0 THEN 'a better' ELSE 'b better' END ELSE 'not separated' END AS verdict FROM adjusted LEFT JOIN quants USING (df0)"))
def t12(spark, d):
    tested = inf.holm(inf.with_p(inf.with_interval(_paired(spark, d))), ["benchmark", "metric"])
    verdict = F.when(F.col("p_holm") < 0.05, F.when(F.col("diff") > 0, "a better").otherwise("b better")).otherwise("not separated")
    return _rounded_tests(tested.withColumn("verdict", verdict), "p", "p_holm")


@register("t13_claims_table", sql_over("WITH " + SUMMED + ", " + PAIR + ", " + WELCH + ", " + DIFFS + f" SELECT concat_ws(' ', 'welch', benchmark, metric) AS claim, frac, CASE WHEN na > 1 AND nb > 1 AND x + y > 0 THEN round((ma - mb) / sqrt(x + y), 6) + 0.0 END AS statistic FROM w UNION ALL SELECT concat_ws(' ', 'paired', benchmark, metric), frac, CASE WHEN n_seeds > 2 AND diff_sd > 0 THEN round(diff / (diff_sd / sqrt(n_seeds)), 6) + 0.0 END FROM paired"))
def t13(spark, d):
    row = lambda df, kind: df.select(F.concat_ws(" ", F.lit(kind), "benchmark", "metric").alias("claim"), "frac", F.col("t").alias("statistic"))
    return round_all(row(inf.welch(runs(spark, d), [(A, B)]), "welch").unionByName(row(_paired(spark, d), "paired")), "statistic", digits=6)


@register("p12_verdicts", sql_over("WITH " + HOLM + " SELECT verdict, count(*) AS n FROM report GROUP BY verdict"))
def p12(spark, d):
    return inf.multiplicity_report(_tests(spark, d), ["family"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@register("p13_render", sql_over("WITH " + SUMMED + f" SELECT {C}, arm, printf('%.3f', round(mean, 3)) AS shown, printf('%+.2f', round(mean - 0.5, 2) + 0.0) AS signed FROM summed"))
def p13(spark, d):
    return summed(spark, d).select(*inf.CELL, "arm", inf.render(F.col("mean"), 3).alias("shown"), inf.render(F.col("mean") - 0.5, 2, True).alias("signed"))


@register("x1_quoted_tokens", sql_over("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]+ = \"[0-9a-f]+\"|[0-9]+ (?:seeds|runs)|version [0-9.]+|Version [0-9.]+')) AS token FROM {documents}) GROUP BY token"))
def x1(spark, d):
    pattern = '[A-Za-z_]+ = "[0-9a-f]+"|[0-9]+ (?:seeds|runs)|version [0-9.]+|Version [0-9.]+'
    return view(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register("x2_text_lint", sql_over("SELECT page_id, len(regexp_extract_all(html, '(?:src|href)=\"/[^\"]*\"')) AS n_absolute, len(regexp_extract_all(html, 'TODO|FIXME|XXX|\\{\\{[^}]*\\}\\}')) AS n_placeholders FROM {pages}").replace("{pages}", "pages").replace("\\\\", "\\"))
def x2(spark, d):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), 0)).cast("long")
    return view(spark, d, "pages").select("page_id", n('(?:src|href)="/[^"]*"').alias("n_absolute"), n(r"TODO|FIXME|XXX|\{\{[^}]*\}\}").alias("n_placeholders"))


@register("x3_numbering", sql_over("SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn) AS last, count(DISTINCT turn) = count(*) AND max(turn) - min(turn) + 1 = count(*) AS contiguous FROM {conversations} GROUP BY conv_id"))
def x3(spark, d):
    seen = F.array_sort(F.collect_list("turn"))
    return view(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max("turn").alias("last"), (seen == F.sequence(F.min("turn"), F.max("turn"))).alias("contiguous"))
