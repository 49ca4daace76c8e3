"""Interval, window and sampling queries (J, C, P) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import windows as wn
from .registry import register
from .views import sql_over, view

MERGED = """{name}_marked AS (SELECT chrom, start, stop, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {{{raw}}}),
{name}_island AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM {name}_marked),
{name} AS (SELECT chrom, min(start) AS start, max(stop) AS stop FROM {name}_island GROUP BY chrom, island)"""


def merged(name: str, raw: str) -> str:
    return MERGED.format(name=name, raw=raw)


CONFIDENT = merged("confident", "confident_raw")
WINDOWED = """sized AS (SELECT t.*, stop - start AS del_len, CASE WHEN (stop - start) * 2 <= 256 THEN 1 WHEN (stop - start) * 2 <= 512 THEN 2 WHEN (stop - start) * 2 <= 1024 THEN 4 WHEN (stop - start) * 2 <= 2048 THEN 8 WHEN (stop - start) * 2 <= 4096 THEN 16 WHEN (stop - start) * 2 <= 8192 THEN 32 ELSE 64 END AS bin_size FROM {truth} t),
placed AS (SELECT s.*, bin_size * 256 AS span, greatest(0, least(cast(floor((start + stop) / 2) AS bigint) - bin_size * 128, length - bin_size * 256)) AS win_start FROM sized s JOIN {contigs} c ON s.chrom = c.chrom)"""
GRID = """grid AS (SELECT chrom, length, bin_size, unnest(range(0, greatest(1, length - bin_size * 256), greatest(64, bin_size * 64))) AS start FROM {contigs} CROSS JOIN (VALUES (1), (2), (4), (8), (16), (32), (64)) AS b(bin_size)),
free AS (SELECT chrom, start, start + bin_size * 256 AS stop, bin_size FROM grid g
  WHERE NOT EXISTS (SELECT 1 FROM {truth} t WHERE t.chrom = g.chrom AND g.start < t.stop + bin_size * 256 AND g.start + bin_size * 256 > t.start - bin_size * 256)
    AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.chrom = g.chrom AND abs(g.start - p.win_start) < greatest(g.bin_size * 256, p.span)))"""
POOL = CONFIDENT + ",\n" + WINDOWED + ",\n" + GRID + """,
pool AS (SELECT f.* FROM free f
  WHERE EXISTS (SELECT 1 FROM confident c WHERE c.chrom = f.chrom AND f.start >= c.start AND f.stop <= c.stop)
    AND NOT EXISTS (SELECT 1 FROM {exclude_raw} e WHERE e.chrom = f.chrom AND f.start < e.stop AND f.stop > e.start))"""
SCALES = wn.SCALES


@register("j1_merge_intervals", sql_over("WITH " + CONFIDENT + " SELECT * FROM confident"))
def j1(spark, d):
    return iv.merge_intervals(view(spark, d, "confident_raw"))


@register("j2_contained_in", sql_over("WITH " + CONFIDENT + " SELECT c.* FROM {candidates} c WHERE EXISTS (SELECT 1 FROM confident f WHERE f.chrom = c.chrom AND c.start >= f.start AND c.stop <= f.stop)"))
def j2(spark, d):
    return iv.contained_in(view(spark, d, "candidates"), iv.merge_intervals(view(spark, d, "confident_raw")))


@register("j3_overlaps", sql_over("SELECT c.*, EXISTS (SELECT 1 FROM {exclude_raw} e WHERE e.chrom = c.chrom AND c.start < e.stop AND c.stop > e.start) AS touched FROM {candidates} c"))
def j3(spark, d):
    c, e = view(spark, d, "candidates"), view(spark, d, "exclude_raw")
    return iv.overlap_flag(c, e, "touched")


PAIRS = """pairs AS (SELECT c.chrom, c.start, c.stop, t.start AS t_start, t.stop AS t_stop, t.geno AS t_geno,
  (least(c.stop, t.stop) - greatest(c.start, t.start)) / greatest(c.stop - c.start, t.stop - t.start)::DOUBLE AS ro
  FROM {candidates} c JOIN {truth} t ON c.chrom = t.chrom AND c.start < t.stop AND c.stop > t.start)"""
BEST = PAIRS + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, start, stop ORDER BY ro DESC, t_start, t_stop, t_geno) AS rn FROM pairs) WHERE rn = 1)"""


@register("j4_reciprocal_overlap", sql_over("WITH " + PAIRS + " SELECT chrom, start, stop, t_start, t_stop, t_geno, round(ro, 9) AS ro FROM pairs"))
def j4(spark, d):
    return iv.reciprocal_pairs(view(spark, d, "candidates"), view(spark, d, "truth"), clustered=True).withColumn("ro", F.round("ro", 9))


@register("j5_best_match", sql_over("WITH " + BEST + " SELECT chrom, start, stop, t_start, t_stop, t_geno, round(ro, 9) AS ro FROM best"))
def j5(spark, d):
    return iv.best_match(view(spark, d, "candidates"), view(spark, d, "truth")).withColumn("ro", F.round("ro", 9))


LABELLED = CONFIDENT + ", " + BEST + """, flagged AS (SELECT c.*, b.ro, b.t_geno,
  EXISTS (SELECT 1 FROM confident f WHERE f.chrom = c.chrom AND c.start >= f.start AND c.stop <= f.stop) AS sure,
  EXISTS (SELECT 1 FROM {exclude_raw} e WHERE e.chrom = c.chrom AND c.start < e.stop AND c.stop > e.start) AS touched
  FROM {candidates} c LEFT JOIN best b ON c.chrom = b.chrom AND c.start = b.start AND c.stop = b.stop),
labelled AS (SELECT chrom, start, stop, CASE WHEN NOT sure THEN 'drop_unconfident' WHEN coalesce(ro, 0) >= 0.5 THEN 'tp' WHEN touched THEN 'drop_ambiguous' WHEN coalesce(ro, 0) > 0 THEN 'drop_below_reciprocal' ELSE 'fp' END AS outcome, t_geno FROM flagged)"""


@register(
    "j6_label_candidates",
    sql_over("WITH " + LABELLED + " SELECT chrom, start, stop, outcome, CASE outcome WHEN 'tp' THEN 1 WHEN 'fp' THEN 0 END AS label, CASE outcome WHEN 'tp' THEN t_geno WHEN 'fp' THEN 0 END AS geno FROM labelled"),
)
def j6(spark, d):
    return iv.label_candidates(view(spark, d, "candidates"), view(spark, d, "truth"), view(spark, d, "exclude_raw"), view(spark, d, "confident_raw"))


@register("j6_outcome_counts", sql_over("WITH " + LABELLED + " SELECT outcome, count(*) AS n FROM labelled GROUP BY outcome"))
def j6_counts(spark, d):
    return iv.outcome_counts(j6(spark, d))


@register("j7_read_windows", sql_over("WITH " + WINDOWED + " SELECT p.chrom, p.win_start, p.span, r.read_id, r.start AS read_start FROM placed p JOIN {reads} r ON p.chrom = r.chrom AND r.start < p.win_start + p.span AND r.stop > p.win_start"))
def j7(spark, d):
    w = wn.positive_windows(view(spark, d, "truth"), view(spark, d, "contigs")).select("chrom", F.col("win_start").alias("start"), (F.col("win_start") + F.col("span")).alias("stop"), "span")
    reads = view(spark, d, "reads").select("chrom", "start", "stop", "read_id")
    pairs = iv.overlap_join(reads, w, "w_", clustered=True, **iv.together(reads))
    return pairs.select("chrom", F.col("w_start").alias("win_start"), F.col("w_span").alias("span"), "read_id", F.col("start").alias("read_start"))


@register("j9_proximity_anti", sql_over("SELECT c.* FROM {candidates} c WHERE NOT EXISTS (SELECT 1 FROM {truth} t WHERE t.chrom = c.chrom AND c.start < t.stop + 2000 AND c.stop > t.start - 2000)"))
def j9(spark, d):
    return iv.far_from(view(spark, d, "candidates"), view(spark, d, "truth"), 2000)


@register("p1_chrom_to_int", sql_over("SELECT name, CASE WHEN bare = 'X' THEN 23 WHEN bare = 'Y' THEN 24 WHEN bare IN ('M', 'MT') THEN 25 ELSE coalesce(try_cast(bare AS int), -1) END AS number, n FROM (SELECT name, regexp_replace(name, '^chr', '') AS bare, count(*) AS n FROM (SELECT concat('chr', CASE o_custkey % 27 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'MT' WHEN 26 THEN 'Un' ELSE cast(o_custkey % 27 AS string) END) AS name FROM {orders}) GROUP BY name)"))
def p1(spark, d):
    key = F.col("o_custkey") % 27
    name = F.concat(F.lit("chr"), F.when(key == 23, "X").when(key == 24, "Y").when(key == 25, "MT").when(key == 26, "Un").otherwise(key.cast("string")))
    named = view(spark, d, "orders").select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return named.select("name", wn.chrom_to_int(F.col("name")).alias("number"), "n")


@register("p2_chrom_split", sql_over("SELECT CASE WHEN cast(chrom AS int) BETWEEN 1 AND 11 THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(start) AS first_start FROM {truth} GROUP BY 1"))
def p2(spark, d):
    return view(spark, d, "truth").groupBy(wn.split_of(wn.chrom_to_int(F.col("chrom"))).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"))


@register("p3_bin_for_len", sql_over("WITH " + WINDOWED + " SELECT chrom, start, stop, bin_size FROM sized"))
def p3(spark, d):
    return view(spark, d, "truth").select("chrom", "start", "stop", wn.bin_for_len(F.col("stop") - F.col("start")).alias("bin_size"))


@register("p4_positive_windows", sql_over("WITH " + WINDOWED + " SELECT chrom, start, stop, geno, del_len, bin_size, span, win_start, round((start - win_start) / span::DOUBLE, 9) AS bp0, round((stop - win_start) / span::DOUBLE, 9) AS bp1 FROM placed"))
def p4(spark, d):
    return wn.positive_windows(view(spark, d, "truth"), view(spark, d, "contigs")).withColumns({c: F.round(c, 9) for c in ("bp0", "bp1")})


@register("p7_length_strata", sql_over("SELECT CASE WHEN del_len < 200 THEN '50-200' WHEN del_len < 500 THEN '200-500' WHEN del_len < 1000 THEN '500-1000' WHEN del_len < 5000 THEN '1000-5000' ELSE '5000+' END AS stratum, count(*) AS n FROM {predictions} GROUP BY 1"))
def p7(spark, d):
    return view(spark, d, "predictions").groupBy(wn.length_stratum(F.col("del_len")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@register("c1_tile_windows", sql_over("WITH t AS (SELECT chrom, bin_size, unnest(range(0, greatest(1, length - bin_size * 256), 1024)) AS start FROM {contigs} CROSS JOIN (VALUES (1), (2), (4), (8), (16), (32), (64)) AS b(bin_size)) SELECT t.chrom, bin_size, count(DISTINCT t.start) AS n_windows, count(DISTINCT r.read_id) AS n_reads FROM t LEFT JOIN {reads} r ON r.chrom = t.chrom AND r.start >= t.start AND r.start < t.start + 1024 GROUP BY t.chrom, bin_size"))
def c1(spark, d):
    tiles = wn.tile(view(spark, d, "contigs"), SCALES, 1024).withColumn("cell", iv.bin_of("start", 1024))
    # Tiles of a scale are all cells from 0 to its last, so a read counts where its first cell has one: ids are grouped once for all scales.
    reads = view(spark, d, "reads").select("chrom", "read_id", iv.bin_of("start", 1024).alias("cell")).where("cell >= 0 AND read_id IS NOT NULL")
    counts = reads.groupBy("chrom", "read_id").agg(F.min("cell").alias("cell")).groupBy("chrom", "cell").agg(F.count(F.lit(1)).alias("n"))
    return tiles.join(counts, ["chrom", "cell"], "left").groupBy("chrom", "bin_size").agg(F.count_distinct("start").alias("n_windows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_reads"))


@register("c2_seeded_subsample", sql_over("SELECT * FROM (SELECT chrom, start, stop FROM {candidates} ORDER BY md5(concat_ws('|', '7', chrom, cast(start AS string), cast(stop AS string))), chrom, start, stop LIMIT 100) ORDER BY chrom, start, stop"))
def c2(spark, d):
    return wn.first_by_hash(view(spark, d, "candidates"), 100, ["chrom", "start", "stop"], 7).orderBy("chrom", "start", "stop")


def _positives(spark, d):
    return wn.positive_windows(view(spark, d, "truth"), view(spark, d, "contigs"))


def _pool(spark, d, strict: bool):
    confident = iv.merge_intervals(view(spark, d, "confident_raw")) if strict else None
    return wn.negative_grid(view(spark, d, "contigs"), view(spark, d, "truth"), _positives(spark, d), SCALES, confident, view(spark, d, "exclude_raw") if strict else None)


SAMPLED = """quota AS (SELECT chrom, bin_size, count(*) * 3 AS quota FROM placed GROUP BY chrom, bin_size),
sampled AS (SELECT s.chrom, s.start, s.stop, s.bin_size FROM (SELECT *, row_number() OVER (PARTITION BY chrom, bin_size ORDER BY md5(concat_ws('|', '0', chrom, cast(start AS string), cast(bin_size AS string))), chrom, start, bin_size) AS rn FROM {pool}) s JOIN quota q ON s.chrom = q.chrom AND s.bin_size = q.bin_size WHERE rn <= quota)"""


@register("c3_uniform_negatives", sql_over("WITH " + WINDOWED + ", " + GRID + ", " + SAMPLED.replace("{pool}", "free") + " SELECT * FROM sampled"))
def c3(spark, d):
    return wn.sample_to_quota(_pool(spark, d, False), wn.quotas(_positives(spark, d), ["chrom", "bin_size"]), ["chrom", "bin_size"])


@register(
    "c4_confident_negatives",
    sql_over("WITH " + POOL + ", " + SAMPLED.replace("{pool}", "pool") + ", n AS (SELECT chrom, bin_size, count(*) AS placed FROM sampled GROUP BY chrom, bin_size) SELECT q.chrom, q.bin_size, q.quota, coalesce(n.placed, 0) AS placed, q.quota - coalesce(n.placed, 0) AS unplaced FROM quota q LEFT JOIN n ON q.chrom = n.chrom AND q.bin_size = n.bin_size"),
)
def c4(spark, d):
    wanted = wn.quotas(_positives(spark, d), ["chrom", "bin_size"])
    return wn.unplaced(wn.sample_to_quota(_pool(spark, d, True), wanted, ["chrom", "bin_size"]), wanted, ["chrom", "bin_size"])


@register("c6_candidate_grid", sql_over("WITH " + POOL + " SELECT * FROM pool"))
def c6(spark, d):
    return _pool(spark, d, True)


@register("c10_seeded_permutation", sql_over("SELECT chrom, start, stop, geno FROM {truth} ORDER BY md5(concat_ws('|', 'perm', chrom, cast(start AS string), cast(stop AS string))), chrom, start, stop LIMIT 64"))
def c10(spark, d):
    return wn.first_by_hash(view(spark, d, "truth"), 64, ["chrom", "start", "stop"], "perm").select("chrom", "start", "stop", "geno")


POOLS = "pools AS (SELECT l_suppkey AS pool_id, count(*) AS pool FROM {lineitem} GROUP BY l_suppkey), fracs AS (SELECT pool_id, pool, frac FROM pools CROSS JOIN (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.25), (0.5), (1.0)) AS f(frac)), budgets AS (SELECT *, greatest(2, least(pool, cast(round_even(frac * pool, 0) AS bigint))) AS budget FROM fracs)"


def _budgets(spark, d):
    pools = view(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pool_id")).agg(F.count(F.lit(1)).alias("pool"))
    fracs = pools.withColumn("frac", F.explode(F.array(*[F.lit(f) for f in (0.01, 0.05, 0.1, 0.25, 0.5, 1.0)])))
    return fracs.withColumn("budget", wn.label_budget(F.col("frac"), F.col("pool")))


@register("c11_label_budget", sql_over("WITH " + POOLS + " SELECT * FROM budgets"))
def c11(spark, d):
    return _budgets(spark, d)


@register("c12_budget_split", sql_over("WITH " + POOLS + ", v AS (SELECT *, cast(round_even(budget * 0.2, 0) AS bigint) AS nv FROM budgets) SELECT pool_id, frac, budget, CASE WHEN nv >= 12 AND budget - nv >= 12 THEN nv ELSE 0 END AS n_val, budget - CASE WHEN nv >= 12 AND budget - nv >= 12 THEN nv ELSE 0 END AS n_train FROM v"))
def c12(spark, d):
    n_val = wn.validation_size(F.col("budget"))
    return _budgets(spark, d).select("pool_id", "frac", "budget", n_val.alias("n_val"), (F.col("budget") - n_val).alias("n_train"))


def _subset_sql(nested: bool) -> str:
    key = "md5(concat_ws('|', '3', cast(o_orderkey AS string)))" if nested else "md5(concat_ws('|', '3', cast(frac AS string), cast(o_orderkey AS string)))"
    return f"""WITH many AS (SELECT o_orderstatus, o_orderkey, frac FROM {{orders}} CROSS JOIN (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.25), (0.5), (1.0)) AS f(frac)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY o_orderstatus, frac) AS n, row_number() OVER (PARTITION BY o_orderstatus, frac ORDER BY {key}, o_orderkey) AS rn FROM many),
chosen AS (SELECT *, greatest(2, least(n, cast(round_even(frac * n, 0) AS bigint))) AS budget FROM ranked),
valid AS (SELECT *, cast(round_even(budget * 0.2, 0) AS bigint) AS nv FROM chosen WHERE rn <= budget)
SELECT o_orderstatus, o_orderkey, frac, budget, CASE WHEN nv >= 12 AND budget - nv >= 12 AND rn <= nv THEN 'val' ELSE 'train' END AS part FROM valid"""


def _subsets(spark, d, nested: bool):
    rows = view(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    return wn.budget_subsets(rows, (0.01, 0.05, 0.1, 0.25, 0.5, 1.0), "o_orderkey", 3, nested, ["o_orderstatus"])


@register("c13_nested_subsets", sql_over(_subset_sql(True)))
def c13(spark, d):
    return _subsets(spark, d, True)


@register("c13_independent_subsets", sql_over(_subset_sql(False)))
def c13b(spark, d):
    return _subsets(spark, d, False)


@register(
    "c14_coverage_downsample",
    sql_over("WITH r AS (SELECT read_id, chrom, cast(floor(start / 16384) AS bigint) AS cell FROM {reads}), ranked AS (SELECT *, count(*) OVER (PARTITION BY chrom, cell) AS n, row_number() OVER (PARTITION BY chrom, cell ORDER BY md5(concat_ws('|', '0', read_id)), read_id) AS rn FROM r) SELECT DISTINCT chrom, cell, read_id FROM ranked WHERE rn <= least(greatest(cast(round_even(n * 0.5::DOUBLE, 0) AS bigint), 1), 64)"),
)
def c14(spark, d):
    cells = view(spark, d, "reads").select("read_id", "chrom", iv.bin_of("start", 16384).alias("cell"))
    return wn.thin_rows(cells, ["chrom", "cell"], ["read_id"], 0.5, 64).distinct()
