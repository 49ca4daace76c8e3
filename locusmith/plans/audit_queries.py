"""Separability by benchmark, provenance, quotations and audits (J12, J13, J14, G4, G10, G13), and stores that are written and read (S8, S10 to S13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as inf
from ..operators import scoring as sc
from ..sources import tables
from ..sources.folders import shared_folder
from .inference_queries import NORMAL
from .pileup_queries import round_all
from .registry import _SQL, register
from .scoring_queries import FEATS, KEYS, free, predictions
from .source_queries import _documents, _flat, _labelled
from .views import sql_over, view

BENCHED = "long AS (SELECT benchmark, 'f' || cast(i AS string) AS feature, embedding[i]::DOUBLE AS score, label FROM {benchmark_vectors} CROSS JOIN (SELECT unnest(range(1, 13)) AS i) AS n), " + free("long", "auc", "benchmark, feature") + ", own AS (SELECT benchmark, feature, greatest(roc_auc, 1 - roc_auc) AS auc FROM auc), sizes AS (SELECT benchmark, feature, count(*) AS n_test, cast(sum(label) AS bigint) AS n_pos FROM long GROUP BY benchmark, feature)"


def _separability(spark, d):
    """Single-feature AUC of each benchmark's vectors; the first twelve elements stand for the features."""
    v = view(spark, d, "benchmark_vectors")
    table = v.select("benchmark", "label", *[F.element_at("embedding", i).cast("double").alias(f"f{i}") for i in range(1, 13)])
    return sc.separability(table, FEATS, ["benchmark"])


@register("j13_separability_deltas", sql_over("WITH " + BENCHED + " SELECT f.feature, round(f.auc, 7) + 0.0 AS auc_f, round(o.auc, 7) + 0.0 AS auc_o, round(h.auc, 7) + 0.0 AS auc_h, round(f.auc - o.auc, 7) + 0.0 AS delta_fo, round(f.auc - h.auc, 7) + 0.0 AS delta_fh, round(o.auc - h.auc, 7) + 0.0 AS delta_oh FROM own f JOIN own o ON f.feature = o.feature AND f.benchmark = 'F' AND o.benchmark = 'O' JOIN own h ON f.feature = h.feature AND h.benchmark = 'H'"))
def j13(spark, d):
    """Differences of a feature's oriented AUC between two benchmarks and among three."""
    s = _separability(spark, d)
    wide = s.groupBy("feature").agg(*[F.max(F.when(F.col("benchmark") == b, F.col("auc_oriented"))).alias(f"auc_{b.lower()}") for b in "FOH"])
    deltas = wide.withColumns({"delta_fo": F.col("auc_f") - F.col("auc_o"), "delta_fh": F.col("auc_f") - F.col("auc_h"), "delta_oh": F.col("auc_o") - F.col("auc_h")})
    return round_all(deltas, *[c for c in deltas.columns if c != "feature"])


@register("g13_best_feature", sql_over("WITH " + BENCHED + ", best AS (SELECT benchmark, arg_max(feature, auc) AS best_feature, max(auc) AS best_auc FROM own GROUP BY benchmark), control AS (SELECT benchmark, avg(value) AS control FROM {runs} WHERE arm = 'N' AND metric = 'auprc' AND frac = 1.0 GROUP BY benchmark) SELECT b.benchmark, best_feature, round(best_auc, 7) + 0.0 AS best_auc, n_test, n_pos, round(control, 7) + 0.0 AS control_auprc FROM best b JOIN sizes s ON b.benchmark = s.benchmark AND b.best_feature = s.feature LEFT JOIN control c ON b.benchmark = c.benchmark"))
def g13(spark, d):
    """The best single feature of each benchmark, its test rows, and the control's AUPRC at the full budget."""
    best = _separability(spark, d).groupBy("benchmark").agg(F.max_by(F.struct("feature", "auc_oriented", "n_test", "n_pos"), "auc_oriented").alias("b"))
    control = view(spark, d, "runs").where("arm = 'N' AND metric = 'auprc' AND frac = 1.0").groupBy("benchmark").agg(F.avg("value").alias("control_auprc"))
    shown = best.join(control, "benchmark", "left").select("benchmark", F.col("b.feature").alias("best_feature"), F.col("b.auc_oriented").alias("best_auc"), "b.n_test", "b.n_pos", "control_auprc")
    return round_all(shown, "best_auc", "control_auprc")


@register("g4_calibration_errors", f"SELECT arm, round(avg(ece), 6) + 0.0 AS ece_mean, round(stddev_pop(ece), 6) + 0.0 AS ece_sd, round(quantile_cont(ece, 0.5), 6) + 0.0 AS ece_median, round(avg(temperature), 6) + 0.0 AS t_mean, round(stddev_pop(temperature), 6) + 0.0 AS t_sd FROM ({_SQL['e9_calibration_error']}) e JOIN ({_SQL['e10_temperature_grid']}) t USING (arm, seed) GROUP BY arm")
def g4(spark, d):
    """Calibration error and temperature of the arms over their seeds."""
    from .registry import queries

    both = queries()["e9_calibration_error"](spark, d).join(queries()["e10_temperature_grid"](spark, d), KEYS)
    return round_all(both.groupBy("arm").agg(F.avg("ece").alias("ece_mean"), F.stddev_pop("ece").alias("ece_sd"), F.expr("percentile(ece, 0.5)").alias("ece_median"), F.avg("temperature").alias("t_mean"), F.stddev_pop("temperature").alias("t_sd")), "ece_mean", "ece_sd", "ece_median", "t_mean", "t_sd", digits=6)


@register("g10_encoders_and_batches", sql_over("SELECT benchmark, arm, count(DISTINCT seed) AS n_seeds, count(DISTINCT encoder) AS n_encoders, count(DISTINCT encoder) = count(DISTINCT seed) AS encoder_per_seed, count(DISTINCT batch) = 1 AS one_batch FROM {provenance} GROUP BY benchmark, arm"))
def g10(spark, d):
    p = view(spark, d, "provenance")
    seeds, encoders = F.count_distinct("seed"), F.count_distinct("encoder")
    return p.groupBy("benchmark", "arm").agg(seeds.alias("n_seeds"), encoders.alias("n_encoders"), (encoders == seeds).alias("encoder_per_seed"), (F.count_distinct("batch") == 1).alias("one_batch"))


SHOWN = "CASE WHEN p < 0.02 THEN printf('%.4e', p + CASE WHEN length(test) % 3 = 0 THEN 0.001 ELSE 0 END) WHEN length(test) % 2 = 0 THEN printf('%.2f', (floor(p * 100 + 1e-9) + CASE WHEN length(test) % 3 = 0 THEN 1 ELSE 0 END) / 100.0) ELSE printf('%.4f', floor(p * 10000 + 0.5 + 1e-9) / 10000.0) END"


@register("j12_quoted_texts", sql_over("WITH v AS (SELECT family, test, p::DOUBLE AS p FROM {tests} WHERE p > 0), q AS (SELECT family, test, " + SHOWN + " AS text FROM v), r AS (SELECT *, text::DOUBLE AS value, contains(text, 'e') AS sci, length(split_part(text, '.', 2)) AS digits FROM q) SELECT family, test, text, EXISTS (SELECT 1 FROM v WHERE CASE WHEN r.sci THEN abs(v.p - r.value) <= 0.15 * r.value ELSE abs(v.p - r.value) <= 0.5 * pow(10, -r.digits) + 1e-9 END) AS found FROM r"))
def j12(spark, d):
    """Quoted p values with decimals of their own, some with exponents, against all source values."""
    v = view(spark, d, "tests").select("family", "test", F.col("p").cast("double").alias("p")).where("p > 0")
    two = F.format_string("%.2f", (F.floor(F.col("p") * 100 + 1e-9) + F.when(F.length("test") % 3 == 0, 1).otherwise(0)) / 100.0)
    text = F.when(F.col("p") < 0.02, F.format_string("%.4e", F.col("p") + F.when(F.length("test") % 3 == 0, 0.001).otherwise(0.0))).when(F.length("test") % 2 == 0, two).otherwise(F.format_string("%.4f", F.floor(F.col("p") * 10000 + 0.5 + 1e-9) / 10000.0))
    return inf.quoted_text(v.select("family", "test", text.alias("text")), v.select(F.col("p").alias("value")))


@register("j14_audit_problems", sql_over("WITH spans AS (SELECT item_id, bool_or(s.source IS NOT NULL) AS verified FROM (SELECT item_id, " + NORMAL + " AS quote FROM {benchmark}) q LEFT JOIN (SELECT " + NORMAL + """ AS source FROM {documents}) s ON quote <> '' AND contains(source, quote) GROUP BY item_id),
given AS (SELECT a.*, s.verified FROM {audit_quotes} a LEFT JOIN spans s ON a.item_id = s.item_id), eligible AS (SELECT doc_id FROM {documents} WHERE n_chars >= 500), coded AS (SELECT DISTINCT doc_id FROM {axes})
SELECT 'not_one_quote' AS problem, count(*) AS n FROM {axes} x LEFT JOIN (SELECT doc_id, axis, count(*) AS k FROM given GROUP BY doc_id, axis) g ON x.doc_id = g.doc_id AND x.axis = g.axis WHERE coalesce(k, 0) <> 1
UNION ALL SELECT 'other_code', count(*) FROM given g JOIN {axes} x ON x.doc_id = g.doc_id AND x.axis = g.axis WHERE g.code <> x.code
UNION ALL SELECT 'quote_of_no_axis', count(*) FROM given g WHERE NOT EXISTS (SELECT 1 FROM {axes} x WHERE x.doc_id = g.doc_id AND x.axis = g.axis)
UNION ALL SELECT 'not_verified', count(*) FROM given WHERE NOT coalesce(verified, false)
UNION ALL SELECT 'coded_not_eligible', count(*) FROM coded c WHERE NOT EXISTS (SELECT 1 FROM eligible e WHERE e.doc_id = c.doc_id)
UNION ALL SELECT 'eligible_not_coded', count(*) FROM eligible e WHERE NOT EXISTS (SELECT 1 FROM coded c WHERE e.doc_id = c.doc_id)"""))
def j14(spark, d):
    """Quotes per coded paper and axis: one each, of the same code, literally in some source; coded against eligible papers."""
    spans = inf.literal_spans(view(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), "text"), view(spark, d, "documents"))
    quotes = view(spark, d, "audit_quotes").join(spans.select(F.col("quote_id").alias("item_id"), "verified"), "item_id", "left").select("doc_id", "axis", "code", "verified")
    eligible = view(spark, d, "documents").where("n_chars >= 500").select("doc_id")
    return inf.audit_problems(view(spark, d, "axes"), quotes, eligible)


@register("s8_unlabelled_store", sql_over("SELECT split, -1 AS label, count(*) AS n, true AS small_files FROM (SELECT CASE WHEN cast(chrom AS int) <= 11 THEN 'train' ELSE 'test' END AS split FROM {reads}) GROUP BY split"))
def s8(spark, d):
    """Unlabelled windows through the sink, at most 2,048 to a file, and back."""
    r = view(spark, d, "reads").select("chrom", "start", F.lit(-1).alias("label"), F.lit("u").alias("sample"), F.when(F.col("chrom").cast("int") <= 11, "train").otherwise("test").alias("split"))
    path = shared_folder(spark, "unlabelled")
    tables.write_windows(r, path, 2048)
    files = tables.read_windows(spark, path).groupBy("split", "label", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("split", "label").agg(F.sum("n").alias("n"), (F.max("n") <= 2048).alias("small_files"))


@register("s10_store_scan", _flat("SELECT chrom, start, bin_size, geno, label FROM flat WHERE split = 'test'"))
def s10(spark, d):
    """Windows written by sample and split, and one split of them read, which prunes the other's files."""
    path = shared_folder(spark, "windows")
    tables.write_windows(_labelled(spark, d).withColumn("sample", F.lit("s")), path)
    return tables.read_windows(spark, path, "test").select("chrom", "start", "bin_size", "geno", "label")


@register("s11_results_read", sql_over("SELECT cast(seed AS int) AS seed, cast(frac AS DOUBLE) AS frac, concat('arm_', arm) AS arm, metric, value FROM {runs}"))
def s11(spark, d):
    """Result documents of all benchmarks and seeds written as JSON and read as long runs; the seed is in the path."""
    path = shared_folder(spark, "results")
    tables.write_documents(_documents(spark, d), path, ["A", "N", "R"], ["auprc", "f1_at_tau"])
    return tables.read_runs(spark, path).select("seed", "frac", "arm", "metric", "value")


@register("s12_result_csv", sql_over("SELECT family, test, round(p, 6) + 0.0::DOUBLE AS p FROM {tests}"))
def s12(spark, d):
    path = shared_folder(spark, "table")
    view(spark, d, "tests").select("family", "test", F.col("p").cast("double").alias("p")).write.option("header", True).csv(path)
    return round_all(spark.read.schema("family string, test string, p double").option("header", True).csv(path), "p", digits=6)


@register("s13_document_sink", sql_over("SELECT benchmark, cast(seed AS int) AS seed, count(DISTINCT frac) AS n_budgets, count(*) AS n_values, round(sum(value), 6) + 0.0 AS total FROM {runs} GROUP BY benchmark, seed"))
def s13(spark, d):
    """Budgets and values of every evaluation document, from the files that the sink writes."""
    path = shared_folder(spark, "documents")
    tables.write_documents(_documents(spark, d), path, ["A", "N", "R"], ["auprc", "f1_at_tau"])
    values = F.flatten(F.transform("label_efficiency", lambda r: F.array(*[r[f"arm_{a}"][m] for a in "ANR" for m in ("auprc", "f1_at_tau")])))
    read = spark.read.json(path).select("benchmark", F.col("seed").cast("int").alias("seed"), F.size("label_efficiency").cast("long").alias("n_budgets"), F.filter(values, lambda v: v.isNotNull()).alias("v"))
    return round_all(read.select("benchmark", "seed", "n_budgets", F.size("v").cast("long").alias("n_values"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total")), "total", digits=6)


SCREENED = """population AS (SELECT doc_id, n_chars >= 500 AS eligible, CASE WHEN n_chars >= 500 THEN NULL WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 7 = 0 THEN NULL ELSE 'too short' END AS reason FROM {documents}), coded AS (SELECT DISTINCT doc_id FROM {axes})"""


@register("j14_exclusion_reasons", sql_over("WITH " + SCREENED + """ SELECT 'excluded_without_reason' AS problem, count(*) AS n FROM population WHERE NOT eligible AND trim(coalesce(reason, '')) = ''
UNION ALL SELECT 'excluded_but_coded', count(*) FROM population p WHERE NOT eligible AND EXISTS (SELECT 1 FROM coded c WHERE c.doc_id = p.doc_id)
UNION ALL SELECT 'eligible_unavailable', count(*) FROM population p WHERE eligible AND NOT EXISTS (SELECT 1 FROM coded c WHERE c.doc_id = p.doc_id)
UNION ALL SELECT 'coded_not_screened', count(*) FROM coded c WHERE NOT EXISTS (SELECT 1 FROM population p WHERE c.doc_id = p.doc_id)"""))
def j14_reasons(spark, d):
    """Every screened document is coded, unavailable, or excluded for a reason that is recorded."""
    reason = F.when(F.col("n_chars") >= 500, F.lit(None).cast("string")).when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise("too short")
    population = view(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 500).alias("eligible"), reason.alias("reason"))
    return inf.exclusion_problems(population, view(spark, d, "axes").select("doc_id"))


WORDS = list(inf.NUMBER_WORDS)
STATED = """notes AS (SELECT l_suppkey AS note_id, l_suppkey % 12 AS k, l_suppkey % 15 AS j, l_suppkey % 13 AS i FROM {lineitem} GROUP BY l_suppkey),
allowed AS (SELECT DISTINCT count(DISTINCT seed) AS n FROM {runs} GROUP BY benchmark, arm, frac, metric)"""


@register("x1_unsupported_counts", sql_over("WITH " + STATED + f""", stated AS (SELECT note_id, j AS n, cast(j AS string) || ' seeds' AS token FROM notes
UNION ALL SELECT note_id, least(k, 10) + 2, ['{"', '".join(w.title() for w in WORDS)}'][cast(least(k, 10) + 1 AS int)] || ' seeds' FROM notes UNION ALL SELECT note_id, i, 'Seeds ' || cast(i AS string) FROM notes)
SELECT note_id, token, cast(n AS bigint) AS n FROM stated WHERE n NOT IN (SELECT n FROM allowed)"""))
def x1_counts(spark, d):
    """Seed counts that notes state in digits, words and a table, less those that the runs have; the notes are spelt out from the line items."""
    s = F.col("note_id")
    title = F.element_at(F.array(*[F.lit(w.title()) for w in WORDS]), (F.least(s % 12, F.lit(10)) + 1).cast("int"))
    table = F.concat(F.lit("\n\n| Arm | Seeds |\n|---|:-:|\n| a | "), (s % 13).cast("string"), F.lit(" |\n"))
    text = F.concat(F.lit("An arm of "), (s % 15).cast("string"), F.lit(" seeds. "), title, F.lit(" seeds for the other; 7seeds and 123 seeds aren't counts."), table)
    notes = view(spark, d, "lineitem").select(F.col("l_suppkey").alias("note_id")).distinct().withColumn("text", text)
    allowed = view(spark, d, "runs").groupBy("benchmark", "arm", "frac", "metric").agg(F.count_distinct("seed").alias("n"))
    return inf.unsupported_counts(inf.stated_counts(notes, "note_id"), allowed).select("note_id", "token", "n")


@register("s9_shard_files", _flat(", whole AS (SELECT chrom, start, label, geno, del_len FROM flat UNION ALL SELECT chrom, start, -1, -1, -1 FROM {candidates}) SELECT chrom, label, geno, count(*) AS n, cast(sum(del_len) AS bigint) AS del_len FROM whole GROUP BY chrom, label, geno").replace(" , whole", ", whole"))
def s9_files(spark, d):
    """Labelled and unlabelled shards with sidecars beside them, made one store, whose rows are counted."""
    shards, store = shared_folder(spark, "shards"), shared_folder(spark, "store")
    _labelled(spark, d).write.parquet(f"{shards}/labelled")
    view(spark, d, "candidates").select("chrom", "start").write.parquet(f"{shards}/unlabelled")
    view(spark, d, "candidates").select("chrom").write.parquet(f"{shards}/meta.index")
    return tables.consolidate_files(spark, [f"{shards}/labelled", f"{shards}/unlabelled", f"{shards}/meta.index"], store).groupBy("chrom", "label", "geno").agg(F.count(F.lit(1)).alias("n"), F.sum("del_len").alias("del_len"))
