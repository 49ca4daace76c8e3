"""Source, sink and model queries (S, P5, M). Text lines are spelt out from the tables, parsed, and held against the tables' own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..operators import windows as wn
from ..sources import tables, text
from ..sources.folders import shared_folder
from .interval_queries import CONFIDENT
from .registry import register
from .views import sql_over, view


def _lines(df, *parts):
    return df.select(F.concat_ws("\t", *[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("value"))


def _string(name):
    return F.col(name).cast("string")


@register("s1_bed_scan", sql_over("WITH " + CONFIDENT + " SELECT * FROM confident"))
def s1(spark, d):
    raw = view(spark, d, "confident_raw")
    lines = _lines(raw, F.concat(F.lit("chr"), F.col("chrom")), _string("start"), _string("stop"))
    noise = lines.limit(1).select(F.explode(F.array(F.lit("# note"), F.lit("track name=x"), F.lit(""), F.lit("browser position"))).alias("value"))
    return text.parse_bed(lines.unionByName(noise))


def _vcf(spark, d):
    """A line for each order: a passing deletion, a filtered one or an insertion, with the genotype of two samples."""
    o = view(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "INS").otherwise("DEL")
    length = 50 + (F.col("o_orderkey") * 31) % 4000
    start = (F.col("o_orderkey") * 7919) % 990000
    info = F.concat(F.lit("SVTYPE="), kind, F.lit(";SVLEN=-"), length.cast("string"), F.lit(";END="), F.when(kind == "INS", start + 1).otherwise(start + length).cast("string"))
    gt = F.when(F.col("o_orderstatus") == "F", "1/1").when(F.col("o_orderstatus") == "O", "0/1").otherwise("0/0")
    filt = F.when(F.col("o_orderkey") % 3 == 0, "LowQual").otherwise("PASS")
    body = _lines(o, (F.col("o_custkey") % 22 + 1).cast("string"), (start + 1).cast("string"), ".", "N", "<X>", ".", filt, info, "GT", gt, F.lit("0|1"))
    head = o.limit(1).select(F.lit("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s1", "s2"])).alias("value"))
    return head.unionByName(body)


ORDER = "cast(o_custkey % 22 + 1 AS string) AS chrom, (o_orderkey * 7919) % 990000 AS start, (o_orderkey * 7919) % 990000 + 50 + (o_orderkey * 31) % 4000 AS stop"


@register("s2_curated_vcf_positives", sql_over(f"SELECT {ORDER}, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS geno FROM {{orders}} WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderstatus IN ('F', 'O')"))
def s2(spark, d):
    return text.parse_curated_vcf(_vcf(spark, d))[0]


@register("s2_curated_vcf_exclusions", sql_over(f"WITH raw AS (SELECT {ORDER} FROM {{orders}}), m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM raw), i AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT chrom, min(start) AS start, max(stop) AS stop FROM i GROUP BY chrom, island"))
def s2b(spark, d):
    return text.parse_curated_vcf(_vcf(spark, d))[1]


@register("s3_sample_vcf", sql_over(f"SELECT {ORDER}, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS geno FROM {{orders}} WHERE o_orderkey % 5 <> 0 AND o_orderstatus IN ('F', 'O')"))
def s3(spark, d):
    return text.parse_sample_vcf(_vcf(spark, d), "s1")


@register("s4_candidate_vcf", sql_over("SELECT count(*) AS n_read, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0) AS n_kept FROM {orders}"))
def s4(spark, d):
    return text.parse_candidate_vcf(_vcf(spark, d))[1]


@register("p5_variant_predicates", sql_over(f"SELECT {ORDER} FROM {{orders}} WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0"))
def p5(spark, d):
    return text.parse_candidate_vcf(_vcf(spark, d))[0]


@register("s5_alignment_scan", sql_over("SELECT read_id, chrom, start, stop, least(mapq, 60) AS mapq, is_reverse FROM {short_reads} WHERE chrom = '3' AND start < 400000 AND stop > 100000"))
def s5(spark, d):
    lines = _read_lines(spark, d)
    region = lines.limit(1).select(F.lit("3").alias("chrom"), F.lit(100000).cast("long").alias("start"), F.lit(400000).cast("long").alias("stop"))
    return text.scan_sam(lines, region).select("read_id", "chrom", "start", "stop", F.col("mapq").cast("long").alias("mapq"), "is_reverse")


def _read_lines(spark, d):
    """SAM lines of the short reads, one aligned run each."""
    r = view(spark, d, "short_reads")
    flag = 1 + F.when(F.col("is_reverse"), 16).otherwise(0) + F.when(F.col("is_proper"), 2).otherwise(0)
    cigar = F.concat((F.col("n_first") + F.col("n_second")).cast("string"), F.lit("M"))
    length = (F.col("n_first") + F.col("n_second")).cast("int")
    return _lines(r, F.col("read_id"), flag.cast("string"), F.col("chrom"), (F.col("start") + 1).cast("string"), _string("mapq"), cigar, "=", "0", _string("tlen"), F.repeat(F.lit("A"), length), F.repeat(F.lit("I"), length))


REGIONS = "regions AS (SELECT DISTINCT cast(c_custkey % 5 + 1 AS string) AS chrom, (c_custkey * 15013) % 900000 AS start, (c_custkey * 15013) % 900000 + 500 AS stop FROM {customer} WHERE c_custkey % 50 = 0)"


@register("s5_region_store", sql_over("WITH " + REGIONS + " SELECT read_id, r.chrom, r.start, r.stop, least(mapq, 60) AS mapq, is_reverse FROM {short_reads} r WHERE EXISTS (SELECT 1 FROM regions g WHERE g.chrom = r.chrom AND r.start < g.stop AND r.stop > g.start)"))
def s5_store(spark, d):
    """Reads written by chrom and wide bin, and those of many regions read back, whose bins alone are opened."""
    path = shared_folder(spark, "reads")
    text.write_reads(text.parse_sam(_read_lines(spark, d)).drop("seq", "quals"), path, 1 << 16)
    regions = spark.sql(f"SELECT * FROM ({REGIONS[REGIONS.index('(') + 1 : -1]})", customer=view(spark, d, "customer"))
    return text.read_regions(spark, path, regions, 1 << 16).select("read_id", "chrom", "start", "stop", F.col("mapq").cast("long").alias("mapq"), "is_reverse")


@register("s6_fasta_blocks", sql_over("SELECT cast(doc_id AS string) AS chrom, length(b) AS n, md5(b) AS digest FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS b FROM {documents})"))
def s6_blocks(spark, d):
    """Letters of all documents written as wrapped FASTA, read by lines into blocks, and put together again."""
    path = shared_folder(spark, "fasta")
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    view(spark, d, "documents").select(F.concat(F.lit(">"), _string("doc_id"), F.lit(" note\n"), F.regexp_replace(letters, "(.{60})(?=.)", "$1\n"))).write.text(path)
    blocks = text.load_fasta_blocks(spark, path, 4096)
    whole = blocks.groupBy("chrom").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "bases")))["bases"], "").alias("b"))
    return whole.select("chrom", F.length("b").cast("long").alias("n"), F.md5("b").alias("digest"))


@register("s6_reference_slices", sql_over("SELECT cast(item_id AS string) AS chrom, cast(s AS bigint) AS start, cast(s + 20 AS bigint) AS stop, substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), cast(s + 1 AS int), 20) AS bases FROM {benchmark} CROSS JOIN (VALUES (0), (10), (25)) AS v(s)"))
def s6(spark, d):
    b = view(spark, d, "benchmark").select(F.concat(_string("item_id"), F.lit(" note\n"), F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]", ""), "(.{60})", "$1\n")).alias("value"))
    contigs = text.parse_fasta(b)
    ranges = contigs.select("chrom", F.explode(F.array(*[F.lit(s).cast("long") for s in (0, 10, 25)])).alias("start")).withColumn("stop", F.col("start") + 20)
    return text.slices(contigs, ranges)


def _labelled(spark, d):
    w = wn.positive_windows(view(spark, d, "truth"), view(spark, d, "contigs"))
    return w.select("chrom", F.col("win_start").alias("start"), "bin_size", "geno", "del_len", (F.col("geno") - 1).alias("label"), wn.split_of(wn.chrom_to_int(F.col("chrom"))).alias("split"))


FLAT = "flat AS (SELECT chrom, win_start AS start, bin_size, geno, del_len, geno - 1 AS label, CASE WHEN cast(chrom AS int) <= 11 THEN 'train' ELSE 'test' END AS split FROM placed)"


def _flat(sql: str) -> str:
    from .interval_queries import WINDOWED

    return sql_over("WITH " + WINDOWED + ", " + FLAT + " " + sql)


@register("s7_window_manifest", _flat("SELECT split, cast(floor((rn - 1) / 256) AS bigint) AS shard, count(*) AS n, count(*) FILTER (label = 1) AS n_pos FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY chrom, start, del_len, geno) AS rn FROM flat) GROUP BY 1, 2"))
def s7(spark, d):
    return tables.manifest(tables.with_shards(_labelled(spark, d), ["split"], ["chrom", "start", "del_len", "geno"], 256), ["split"])


@register("s8_unlabelled_manifest", sql_over("SELECT chrom, cast(floor((rn - 1) / 2048) AS bigint) AS shard, count(*) AS n, cast(0 AS bigint) AS n_pos FROM (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY start, read_id) AS rn FROM {reads}) GROUP BY 1, 2"))
def s8(spark, d):
    r = view(spark, d, "reads").select("chrom", "start", "read_id", F.lit(-1).alias("label"))
    return tables.manifest(tables.with_shards(r, ["chrom"], ["start", "read_id"], 2048), ["chrom"])


@register("s9_consolidate", _flat(", unlabelled AS (SELECT chrom, start FROM {candidates}) SELECT chrom, label, geno, count(*) AS n, cast(sum(del_len) AS bigint) AS del_len FROM (SELECT chrom, start, label, geno, del_len FROM flat UNION ALL SELECT chrom, start, -1, -1, -1 FROM unlabelled) GROUP BY chrom, label, geno").replace(" , unlabelled", ", unlabelled"))
def s9(spark, d):
    whole = tables.consolidate(_labelled(spark, d), view(spark, d, "candidates").select("chrom", "start"))
    return whole.groupBy("chrom", "label", "geno").agg(F.count(F.lit(1)).alias("n"), F.sum("del_len").alias("del_len"))


@register("s10_split_scan", _flat("SELECT chrom, start, bin_size FROM flat WHERE split = 'test'"))
def s10(spark, d):
    return _labelled(spark, d).where("split = 'test'").select("chrom", "start", "bin_size")


def _documents(spark, d):
    """Runs of all benchmarks with the columns of result documents."""
    r = view(spark, d, "runs").withColumn("frac", F.col("frac").cast("double"))
    return r.withColumnRenamed("n", "runs_n").withColumn("n", (F.col("frac") * 1000).cast("long")).select("benchmark", "seed", "frac", "n", "arm", "metric", "value")


@register("s11_results_scan", sql_over("SELECT seed, cast(frac AS DOUBLE) AS frac, concat('arm_', arm) AS arm, metric, value FROM {runs}"))
def s11(spark, d):
    r = _documents(spark, d)
    metrics = F.struct(*[F.max(F.when((F.col("metric") == m), F.col("value"))).alias(m) for m in ("auprc", "f1_at_tau")])
    arms = r.groupBy("benchmark", "seed", "frac", "n", "arm").agg(metrics.alias("m")).groupBy("benchmark", "seed", "frac", "n")
    nested = arms.agg(*[F.max(F.when(F.col("arm") == a, F.col("m"))).alias(f"arm_{a}") for a in ("A", "N", "R")])
    return tables.long_runs(nested.select("seed", F.struct("frac", "n", "arm_A", "arm_N", "arm_R").alias("r"))).select("seed", "frac", "arm", "metric", "value")


@register("s12_result_table", sql_over("SELECT family, test, round(p, 6) + 0.0::DOUBLE AS p FROM {tests}"))
def s12(spark, d):
    t = view(spark, d, "tests").select("family", "test", F.col("p").cast("double").alias("p"))
    lines = t.select(F.to_csv(F.struct("family", "test", "p")).alias("line"))
    return lines.select(F.from_csv("line", "family string, test string, p double").alias("r")).select("r.family", "r.test", (F.round("r.p", 6) + 0.0).alias("p"))


@register("s13_evaluation_documents")
def s13(spark, d):
    return tables.documents_of(_documents(spark, d))


@register("s14_chunk_check", sql_over("WITH lines AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, l_linenumber, l_quantity FROM {lineitem}), c AS (SELECT file, i * 100 + CASE WHEN l_quantity > 49 THEN 10 ELSE 0 END AS start, CASE WHEN l_quantity < 2 THEN 90 ELSE 100 END AS length FROM lines), s AS (SELECT *, coalesce(max(start + length) OVER (PARTITION BY file ORDER BY start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM c), e AS (SELECT file, count(*) FILTER (start > seen) AS gaps, count(*) FILTER (start < seen) AS \"overlaps\", count(*) FILTER (length <> 100) AS wrong, cast(sum(length) AS bigint) AS bytes, cast(max(start + length) AS bigint) AS \"end\", cast(count(*) * 100 AS bigint) AS total FROM s GROUP BY file) SELECT *, gaps = 0 AND \"overlaps\" = 0 AND wrong = 0 AND \"end\" = total AS whole FROM e"))
def s14(spark, d):
    from pyspark.sql import Window

    li = view(spark, d, "lineitem").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1)
    start = F.col("i") * 100 + F.when(F.col("l_quantity") > 49, 10).otherwise(0)
    chunks = li.select(F.col("l_orderkey").alias("file"), start.cast("long").alias("start"), F.when(F.col("l_quantity") < 2, 90).otherwise(100).cast("long").alias("length"), F.lit(100).cast("long").alias("expected"))
    return tables.chunk_check(chunks, chunks.groupBy("file").agg((F.count(F.lit(1)) * 100).alias("total")))


FEATS = [f"f{i}" for i in range(1, 13)]


def _features(spark, d):
    e = view(spark, d, "embeddings")
    t = e.select("vec_id", (F.col("label") < 3).cast("int").alias("label"), *[F.element_at("embedding", i).cast("double").alias(f"f{i}") for i in range(1, 13)])
    return t.where("vec_id % 4 <> 0"), t.where("vec_id % 4 = 0")


@register("m1_logistic_control")
def m1(spark, d):
    return models.logistic(*_features(spark, d), FEATS).select("vec_id", "label", "score")


@register("m2_boosted_control")
def m2(spark, d):
    return models.boosted(*_features(spark, d), FEATS).select("vec_id", "label", "score")


@register("m3_budget_sweep")
def m3(spark, d):
    train, test = _features(spark, d)
    return models.logistic_sweep(train, test, FEATS, "vec_id", (0.01, 0.05, 0.1, 0.25, 0.5, 1.0), tuple(range(10)))
