"""Random windows and quantile-matched negatives (C5, C7, C8, C9) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import pileup as pl
from ..operators import windows as wn
from ..operators.stored import stored
from .interval_queries import POOL, SCALES, _pool
from .pileup_queries import COVER, round_all
from .registry import register
from .views import sql_over, view

GROUPS = ["chrom", "bin_size"]


def _ratio(source: str, name: str) -> str:
    return f"""{name}_sum AS (SELECT w.chrom, w.bin_size, w.start, w.key, coalesce(sum(CASE WHEN v.bin >= cast(floor((w.start + w.bin_size * 64) / 64) AS bigint) AND v.bin < cast(floor((w.start + w.bin_size * 192) / 64) AS bigint) THEN depth END), 0) AS centre, coalesce(sum(depth), 0) AS everything
  FROM ({source}) w LEFT JOIN cover v ON v.chrom = w.chrom AND v.bin >= cast(floor(w.start / 64) AS bigint) AND v.bin < cast(floor((w.start + w.bin_size * 256) / 64) AS bigint) GROUP BY w.chrom, w.bin_size, w.start, w.key),
{name} AS (SELECT chrom, bin_size, start, key, centre / (everything - centre)::DOUBLE AS ratio FROM {name}_sum WHERE everything > centre)"""


MATCHED = POOL + ", " + COVER + ", " + _ratio("SELECT chrom, bin_size, win_start AS start, start AS key FROM placed WHERE bin_size <= 64", "pos") + ", " + _ratio("SELECT chrom, bin_size, start, 0 AS key FROM pool", "neg") + """,
cuts AS (SELECT chrom, bin_size, list_sort(list_distinct([quantile_cont(ratio, 0.1), quantile_cont(ratio, 0.2), quantile_cont(ratio, 0.3), quantile_cont(ratio, 0.4), quantile_cont(ratio, 0.5), quantile_cont(ratio, 0.6), quantile_cont(ratio, 0.7), quantile_cont(ratio, 0.8), quantile_cont(ratio, 0.9)])) AS cuts, quantile_cont(ratio, 0.5) AS median, count(*) AS n_pos FROM pos GROUP BY chrom, bin_size),
lim AS (SELECT c.*, least(n_pos * 3, n_pool) AS keep FROM cuts c JOIN (SELECT chrom, bin_size, count(*) AS n_pool FROM neg GROUP BY chrom, bin_size) n ON c.chrom = n.chrom AND c.bin_size = n.bin_size),
pos_in AS (SELECT p.chrom, p.bin_size, len(list_filter(l.cuts, lambda c: c <= p.ratio)) AS stratum, min(n_pos) AS n_pos, min(keep) AS keep, count(*) AS n_in FROM pos p JOIN lim l ON p.chrom = l.chrom AND p.bin_size = l.bin_size GROUP BY 1, 2, 3),
ranked AS (SELECT n.*, len(list_filter(l.cuts, lambda c: c <= n.ratio)) AS stratum, l.median, l.keep FROM neg n JOIN lim l ON n.chrom = l.chrom AND n.bin_size = l.bin_size),
drawn AS (SELECT r.*, row_number() OVER (PARTITION BY r.chrom, r.bin_size, r.stratum ORDER BY md5(concat_ws('|', '0', r.chrom, cast(r.start AS string), cast(r.bin_size AS string))), r.chrom, r.start, r.bin_size) <= coalesce(cast(floor(n_in / n_pos::DOUBLE * p.keep) AS bigint), 0) AS first
  FROM ranked r LEFT JOIN pos_in p ON r.chrom = p.chrom AND r.bin_size = p.bin_size AND r.stratum = p.stratum),
fill AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY chrom, bin_size) AS got, row_number() OVER (PARTITION BY chrom, bin_size, first ORDER BY abs(ratio - median), chrom, start, bin_size) AS nxt FROM drawn),
kept AS (SELECT * FROM fill WHERE first OR nxt <= keep - got),
offsets AS (SELECT p.chrom, p.bin_size, pos_median, neg_median, abs(pos_median - neg_median) AS gap FROM (SELECT chrom, bin_size, quantile_cont(ratio, 0.5) AS pos_median FROM pos GROUP BY 1, 2) p JOIN (SELECT chrom, bin_size, quantile_cont(ratio, 0.5) AS neg_median FROM kept GROUP BY 1, 2) k ON p.chrom = k.chrom AND p.bin_size = k.bin_size)"""


def _scored(spark, d):
    """Positives and pool with finite depth ratios."""
    profile = stored(pl.coverage(view(spark, d, "reads")))
    placed = wn.positive_windows(view(spark, d, "truth"), view(spark, d, "contigs")).where(F.col("bin_size").isin(*SCALES))
    pos = placed.select("chrom", "bin_size", F.col("win_start").alias("start"), "span")
    pool = _pool(spark, d, True).withColumn("span", F.col("stop") - F.col("start"))
    return pl.centre_flank(profile, pos).where("ratio IS NOT NULL"), pl.centre_flank(profile, pool).where("ratio IS NOT NULL")


def _matched(spark, d):
    pos, pool = map(stored, _scored(spark, d))
    return pos, wn.match_strata(pos, pool, GROUPS, "ratio", ["chrom", "start", "bin_size"])


@register("c5_random_windows", sql_over("""WITH tiles AS (SELECT chrom, length, unnest(range(0, greatest(1, length - 4096), 1024)) AS start FROM {contigs}),
counted AS (SELECT t.chrom, t.start, t.start + 4096 AS stop, 16 AS bin_size, count(*) AS n_reads FROM tiles t JOIN {reads} r ON r.chrom = t.chrom AND r.start < t.start + 4096 AND r.stop > t.start WHERE t.start >= 10000 AND t.start + 4096 <= t.length - 10000 GROUP BY t.chrom, t.start HAVING count(*) >= 5),
quota AS (SELECT chrom, cast(floor(length / (SELECT sum(length) FROM {contigs})::DOUBLE * 2000) AS bigint) AS quota FROM {contigs})
SELECT c.chrom, start, stop, bin_size, n_reads FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY md5(concat_ws('|', 'random', chrom, cast(start AS string), cast(bin_size AS string))), start) AS rn FROM counted) c JOIN quota q ON c.chrom = q.chrom WHERE rn <= quota"""))
def c5(spark, d):
    """Windows in proportion to contig length, away from the edges, with at least five reads."""
    contigs = view(spark, d, "contigs")
    total = contigs.agg(F.sum("length").alias("all"))
    wanted = contigs.join(F.broadcast(total)).select("chrom", F.floor(F.col("length") / F.col("all") * 2000).cast("long").alias("quota"), "length")
    tiles = wn.tile(contigs, (16,)).join(wanted.select("chrom", "length"), "chrom").where((F.col("start") >= 10_000) & (F.col("stop") <= F.col("length") - 10_000)).drop("length")
    counted = iv.overlap_join(tiles, view(spark, d, "reads").select("chrom", "start", "stop")).groupBy("chrom", "start", "stop", "bin_size").agg(F.count(F.lit(1)).alias("n_reads")).where("n_reads >= 5")
    return wn.sample_to_quota(counted, wanted.select("chrom", "quota"), ["chrom"], "random")


C5_SCALES, C5_WEIGHTS, C5_TRIES = (1, 2, 4, 8, 16, 32, 64), (4, 3, 3, 2, 2, 1, 1), 40_000
_unit = lambda what: f"(('0x' || substr(md5(concat_ws('|', 'random', '{what}', cast(draw AS string))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_scale = "CASE " + " ".join(f"WHEN u < {sum(C5_WEIGHTS[: i + 1]) / sum(C5_WEIGHTS)!r}::DOUBLE THEN {s}" for i, s in enumerate(C5_SCALES)) + " ELSE 64 END"


@register("c5_weighted_windows", sql_over(f"""WITH usable AS (SELECT chrom, length, coalesce(sum(length) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length) OVER () AS total FROM {{contigs}} WHERE length > 300000),
draws AS (SELECT draw, {_scale} AS bin_size, {_unit('chrom')} AS uc, {_unit('start')} AS us FROM (SELECT draw, {_unit('scale')} AS u FROM range(0, {C5_TRIES}) AS t(draw))),
placed AS (SELECT draw, chrom, bin_size, 100000 + cast(floor(us * greatest(1, length - bin_size * 256 - 200000)) AS bigint) AS start FROM draws JOIN usable ON cast(floor(uc * total) AS bigint) >= before AND cast(floor(uc * total) AS bigint) < before + length),
passed AS (SELECT p.draw, p.chrom, p.start, p.start + p.bin_size * 256 AS stop, p.bin_size, count(*) AS n_reads FROM placed p JOIN {{reads}} r ON r.chrom = p.chrom AND r.start < p.start + p.bin_size * 256 AND r.stop > p.start GROUP BY p.draw, p.chrom, p.start, p.bin_size HAVING count(*) >= 5)
SELECT * FROM passed ORDER BY draw LIMIT 2000"""))
def c5_weighted(spark, d):
    """Exactly 2,000 windows of weighted scales, drawn and refilled until enough have five reads; the twin draws 40,000 times at once."""
    return wn.random_windows(view(spark, d, "contigs"), view(spark, d, "reads"), 2000, C5_SCALES, C5_WEIGHTS, seed="random", most_tries=C5_TRIES)


@register("c7_quantile_matched", sql_over("WITH " + MATCHED + " SELECT chrom, bin_size, start, round(ratio, 7) + 0.0 AS ratio, cast(stratum AS int) AS stratum, first FROM kept"))
def c7(spark, d):
    return round_all(_matched(spark, d)[1].select("chrom", "bin_size", "start", "ratio", "stratum", "first"), "ratio")


@register("c8_matched_groups", sql_over("WITH " + MATCHED + " SELECT k.chrom, k.bin_size, count(*) AS n_kept, count(*) FILTER (first) AS n_by_stratum, min(keep) AS quota FROM kept k GROUP BY k.chrom, k.bin_size"))
def c8(spark, d):
    pos, pool = map(stored, _scored(spark, d))
    kept = wn.match_strata(pos, pool, GROUPS, "ratio", ["chrom", "start", "bin_size"])
    size = pool.groupBy(*GROUPS).agg(F.count(F.lit(1)).alias("n_pool"))
    quota = pos.groupBy(*GROUPS).agg((F.count(F.lit(1)) * 3).alias("want")).join(size, GROUPS).select(*GROUPS, F.least("want", "n_pool").alias("quota"))
    return kept.groupBy(*GROUPS).agg(F.count(F.lit(1)).alias("n_kept"), F.count_if(F.col("first")).alias("n_by_stratum")).join(quota, GROUPS)


@register("c9_match_offsets", sql_over("WITH " + MATCHED + ' SELECT chrom, bin_size, round(pos_median, 7) + 0.0 AS pos_median, round(neg_median, 7) + 0.0 AS neg_median, round(gap, 7) + 0.0 AS "offset" FROM offsets'))
def c9(spark, d):
    return round_all(wn.match_offset(*_matched(spark, d), GROUPS, "ratio"), "pos_median", "neg_median", "offset")
