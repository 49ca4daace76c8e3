"""Coverage, pileup and feature queries (A, J8, P6, P8, P10, P14, R1) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pileup as pl
from ..operators import windows as wn
from ..operators.stored import stored
from .interval_queries import WINDOWED
from .registry import register
from .views import sql_over, view

#: Windows with at least one base: id, start, stop, scale.
WINDOWS = WINDOWED + """,
wins AS (SELECT DISTINCT concat_ws(':', chrom, cast(win_start AS string), cast(bin_size AS string)) AS window_id, chrom, win_start AS start, win_start + span AS stop, bin_size FROM placed)"""
COVER = """steps AS (SELECT chrom, cast(floor(start / 64) AS bigint) AS bin, 1 AS step FROM {reads} UNION ALL SELECT chrom, cast(floor(stop / 64) AS bigint) + 1, -1 FROM {reads}),
summed AS (SELECT chrom, bin, sum(step) AS step FROM steps GROUP BY chrom, bin),
ran AS (SELECT chrom, bin, sum(step) OVER (PARTITION BY chrom ORDER BY bin) AS depth, lead(bin) OVER (PARTITION BY chrom ORDER BY bin) AS until FROM summed),
cover AS (SELECT chrom, unnest(range(bin, until)) AS bin, cast(depth AS bigint) AS depth FROM ran WHERE until IS NOT NULL)"""
SIZES = """usable AS (SELECT chrom, tlen, row_number() OVER (PARTITION BY chrom ORDER BY start, read_id) AS rn FROM {short_reads} WHERE is_proper AND NOT is_reverse AND tlen > 0),
sizes AS (SELECT c.chrom, coalesce(avg(tlen), 450.0) AS isize_mean, coalesce(stddev_pop(tlen) + 1e-6, 100.0) AS isize_sd FROM (SELECT DISTINCT chrom FROM {short_reads}) c LEFT JOIN (SELECT * FROM usable WHERE rn <= 2000) u ON c.chrom = u.chrom GROUP BY c.chrom)"""
SIGNALS = SIZES + """,
signals AS (SELECT r.*, least(mapq, 60) / 60.0::DOUBLE AS mapq_s, CASE WHEN is_reverse THEN 1.0 ELSE 0.0 END::DOUBLE AS strand_s, CASE WHEN is_proper THEN 0.0 ELSE 1.0 END::DOUBLE AS disc_s, CASE WHEN n_clip > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS clip_s,
  CASE WHEN tlen = 0 THEN 0.0 ELSE greatest(-5.0, least(5.0, (abs(tlen) - isize_mean) / isize_sd)) / 5.0 END::DOUBLE AS isize_z FROM {short_reads} r JOIN sizes s ON r.chrom = s.chrom)"""
BASED = WINDOWS + ", " + SIGNALS + """,
runs AS (SELECT s.*, n_clip AS q0, start AS r0, n_first AS n FROM signals s UNION ALL SELECT s.*, n_clip + n_first + n_insert, start + n_first, n_second FROM signals s),
met AS (SELECT w.window_id, w.start AS win_start, w.bin_size, r.* , unnest(range(greatest(0, w.start - r.r0), least(r.n, w.stop - r.r0))) AS i FROM wins w JOIN runs r ON w.chrom = r.chrom AND r.r0 < w.stop AND r.r0 + r.n > w.start),
pairs AS (SELECT *, q0 + i AS q, cast(floor((r0 + i - win_start) / bin_size) AS bigint) AS col, substr('ACGTN', cast((base_seed + (q0 + i) * (q0 + i)) % 5 + 1 AS int), 1) AS base, (qual_seed + (q0 + i) * 7) % 70 AS qual FROM met),
depth AS (SELECT window_id, col, least(count(DISTINCT read_id) / (60.0::DOUBLE * bin_size), 1.0) AS depth FROM pairs GROUP BY window_id, col, bin_size),
kept AS (SELECT window_id, read_id FROM (SELECT window_id, read_id, row_number() OVER (PARTITION BY window_id ORDER BY md5(concat_ws('|', '0', read_id)), read_id) AS rn FROM (SELECT DISTINCT window_id, read_id FROM pairs)) WHERE rn <= 64),
cells AS (SELECT p.window_id, p.read_id, p.col, avg(CASE WHEN base = 'A' THEN 1.0 ELSE 0.0 END::DOUBLE) AS base_a, avg(CASE WHEN base = 'C' THEN 1.0 ELSE 0.0 END::DOUBLE) AS base_c, avg(CASE WHEN base = 'G' THEN 1.0 ELSE 0.0 END::DOUBLE) AS base_g, avg(CASE WHEN base = 'T' THEN 1.0 ELSE 0.0 END::DOUBLE) AS base_t,
  avg(least(qual, 60) / 60.0::DOUBLE) AS base_quality, min(mapq_s) AS mapq_s, min(strand_s) AS strand_s, min(disc_s) AS disc_s, min(clip_s) AS clip_s, min(isize_z) AS isize_z
  FROM pairs p JOIN kept k ON p.window_id = k.window_id AND p.read_id = k.read_id GROUP BY p.window_id, p.read_id, p.col)"""
FEATURED = BASED + """,
dense AS (SELECT g.window_id, g.col, coalesce(d.depth, 0.0) AS depth FROM (SELECT window_id, unnest(range(0, 256)) AS col FROM wins) g LEFT JOIN depth d ON g.window_id = d.window_id AND g.col = d.col),
smooth AS (SELECT *, CASE WHEN col >= 31 THEN avg(depth) OVER (PARTITION BY window_id ORDER BY col ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) END AS sm FROM dense),
per_column AS (SELECT window_id, avg(depth) AS depth_mean, stddev_pop(depth) AS depth_sd, min(depth) AS depth_min, avg(CASE WHEN col >= 85 AND col < 170 THEN depth END) AS centre, avg(CASE WHEN col < 85 OR col >= 170 THEN depth END) AS flank, min(sm) AS low FROM smooth GROUP BY window_id),
per_cell AS (SELECT window_id, avg(disc_s) AS discordant_rate, avg(clip_s) AS clip_rate, avg(abs(isize_z)) AS isize_absz_mean, max(abs(isize_z)) AS isize_absz_max, avg(mapq_s) AS mapq_mean, count(DISTINCT read_id)::DOUBLE AS n_read_rows, count(*) / 16384.0::DOUBLE AS valid_frac FROM cells GROUP BY window_id),
features AS (SELECT c.window_id, depth_mean, depth_sd, depth_min, CASE WHEN flank > 1e-9 THEN centre / flank ELSE 1.0 END AS depth_centre_flank_ratio, depth_mean - low AS depth_max_drop, coalesce(discordant_rate, 0.0) AS discordant_rate, coalesce(clip_rate, 0.0) AS clip_rate, coalesce(isize_absz_mean, 0.0) AS isize_absz_mean, coalesce(isize_absz_max, 0.0) AS isize_absz_max, coalesce(mapq_mean, 0.0) AS mapq_mean, coalesce(n_read_rows, 0.0) AS n_read_rows, coalesce(valid_frac, 0.0) AS valid_frac FROM per_column c LEFT JOIN per_cell p ON c.window_id = p.window_id)"""


def rounded(*names: str, digits: int = 7) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def round_all(df, *names: str, digits: int = 7):
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def round_cells(df, *names: str, digits: int = 7):
    """``round_all`` for the many numbers of at most 1 of cells: by scaling, as DuckDB does, without a decimal for each."""
    scale = float(10**digits)
    return df.withColumns({n: F.signum(n) * F.floor(F.abs(n) * scale + 0.5) / scale + 0.0 for n in names})


def short_reads(spark, d):
    """Reads with a cigar, a base string and base qualities, spelt out from the view's run lengths."""
    r = view(spark, d, "short_reads")
    total = F.col("n_clip") + F.col("n_first") + F.col("n_insert") + F.col("n_second")
    places = F.sequence(F.lit(0).cast("long"), total - 1)
    spelt = F.array_join(F.transform(places, lambda q: F.substring(F.lit("ACGTN"), ((F.col("base_seed") + q * q) % 5 + 1).cast("int"), F.lit(1))), "")
    # Squares repeat every five places.
    period = F.get(F.array(*[F.lit("".join("ACGTN"[(seed + q * q) % 5] for q in range(5))) for seed in range(5)]), (F.col("base_seed") % 5).cast("int"))
    repeated = F.substring(F.repeat(period, F.ceil(total / 5).cast("int")), F.lit(1), total.cast("int"))
    op = lambda name, n: F.struct(F.lit(name).alias("op"), F.col(n).cast("long").alias("len"))
    cigar = F.filter(F.array(op("S", "n_clip"), op("M", "n_first"), op("I", "n_insert"), op("M", "n_second")), lambda c: c["len"] > 0)
    return r.withColumns(
        {
            "cigar": cigar,
            "seq": F.when(F.col("base_seed") >= 0, repeated).otherwise(spelt),
            "quals": F.transform(places, lambda q: ((F.col("qual_seed") + q * 7) % 70).cast("byte")),
        }
    )


def _windows(spark, d):
    w = wn.positive_windows(view(spark, d, "truth"), view(spark, d, "contigs"))
    return w.select(F.concat_ws(":", "chrom", F.col("win_start").cast("string"), F.col("bin_size").cast("string")).alias("window_id"), "chrom", F.col("win_start").alias("start"), (F.col("win_start") + F.col("span")).alias("stop"), "bin_size").distinct()


def _signals(spark, d):
    reads = short_reads(spark, d)
    return pl.read_signals(reads, stored(pl.insert_size(reads)))


def _cells(spark, d, windows=None):
    return pl.cells(stored(_windows(spark, d)) if windows is None else windows, _signals(spark, d))


def _features(spark, d):
    windows = stored(_windows(spark, d))
    return pl.window_features(windows, pl.depth_rows(windows, short_reads(spark, d)), _cells(spark, d, windows))


@register("a1_coverage_profile", sql_over("WITH " + COVER + " SELECT * FROM cover"))
def a1(spark, d):
    return pl.coverage(view(spark, d, "reads"))


@register(
    "a2_centre_flank_ratio",
    sql_over("WITH " + WINDOWED + ", " + COVER + """, edge AS (SELECT chrom, win_start AS start, span, cast(floor(win_start / 64) AS bigint) AS a, cast(floor((win_start + floor(span / 4)) / 64) AS bigint) AS b, cast(floor((win_start + floor(span * 3 / 4)) / 64) AS bigint) AS c, cast(floor((win_start + span) / 64) AS bigint) AS e, start AS call FROM placed),
parts AS (SELECT w.chrom, w.start, w.span, w.call, coalesce(sum(CASE WHEN v.bin >= b AND v.bin < c THEN depth END), 0) AS centre, coalesce(sum(CASE WHEN v.bin < b OR v.bin >= c THEN depth END), 0) AS flank FROM (SELECT DISTINCT * FROM edge) w LEFT JOIN cover v ON v.chrom = w.chrom AND v.bin >= w.a AND v.bin < w.e GROUP BY w.chrom, w.start, w.span, w.call)
SELECT w.chrom, w.start, w.span, w.call, CASE WHEN flank > 0 THEN round(centre / flank::DOUBLE, 7) + 0.0 END AS ratio FROM edge w JOIN parts p ON w.chrom = p.chrom AND w.start = p.start AND w.span = p.span AND w.call = p.call"""),
)
def a2(spark, d):
    """A row for each call, also where calls are alike."""
    w = wn.positive_windows(view(spark, d, "truth"), view(spark, d, "contigs")).select("chrom", F.col("win_start").alias("start"), "span", F.col("start").alias("call"))
    return round_all(pl.centre_flank(pl.coverage(view(spark, d, "reads")), w), "ratio")


@register("a3_insert_size", sql_over("WITH " + SIZES + " SELECT chrom, " + rounded("isize_mean", "isize_sd", digits=5) + " FROM sizes"))
def a3(spark, d):
    return round_all(pl.insert_size(short_reads(spark, d)), "isize_mean", "isize_sd", digits=5)


@register("p6_read_signals", sql_over("WITH " + SIGNALS + " SELECT read_id, " + rounded("mapq_s", "strand_s", "disc_s", "clip_s", "isize_z") + " FROM signals"))
def p6(spark, d):
    reads = short_reads(spark, d)
    names = ("mapq_s", "strand_s", "disc_s", "clip_s", "isize_z")
    return round_all(pl.read_signals(reads, pl.insert_size(reads)).select("read_id", *names), *names)


@register("j8_aligned_pairs", sql_over("WITH " + BASED + " SELECT window_id, read_id, count(*) AS n_bases, cast(sum(q) AS bigint) AS sum_q, cast(sum(col) AS bigint) AS sum_col FROM pairs GROUP BY window_id, read_id"))
def j8(spark, d):
    return pl.pair_sums(_windows(spark, d), short_reads(spark, d))


CELL = ("base_a", "base_c", "base_g", "base_t", "base_quality", "mapq_s", "strand_s", "disc_s", "clip_s", "isize_z")


@register("a4_pileup_cells", sql_over("WITH " + BASED + " SELECT window_id, read_id, col, " + rounded(*CELL) + " FROM cells"))
def a4(spark, d):
    return round_cells(_cells(spark, d), *CELL)


@register("a5_column_depth", sql_over("WITH " + BASED + " SELECT window_id, col, " + rounded("depth") + " FROM depth"))
def a5(spark, d):
    return round_all(pl.column_depth(stored(_windows(spark, d)), short_reads(spark, d)), "depth")


CONSENSUS = """consensus AS (SELECT chrom, pos, min(base) AS base FROM (SELECT s.chrom, s.start + i AS pos, substr('ACGTN', cast((base_seed + (n_clip + i) * (n_clip + i)) % 5 + 1 AS int), 1) AS base FROM (SELECT *, unnest(range(0, n_first)) AS i FROM {short_reads}) s) GROUP BY chrom, pos)"""


@register(
    "a6_reference_columns",
    sql_over("WITH " + WINDOWS + ", " + CONSENSUS + """, counted AS (SELECT w.window_id, cast(floor((b.pos - w.start) / w.bin_size) AS bigint) AS col, w.bin_size, b.base FROM wins w JOIN consensus b ON w.chrom = b.chrom AND b.pos >= w.start AND b.pos < w.stop),
f AS (SELECT window_id, col, count(*) FILTER (base = 'A') / bin_size::DOUBLE AS ref_a, count(*) FILTER (base = 'C') / bin_size::DOUBLE AS ref_c, count(*) FILTER (base = 'G') / bin_size::DOUBLE AS ref_g, count(*) FILTER (base = 'T') / bin_size::DOUBLE AS ref_t FROM counted GROUP BY window_id, col, bin_size)
SELECT window_id, col, """ + rounded("ref_a", "ref_c", "ref_g", "ref_t") + ", round(1 - ref_a - ref_c - ref_g - ref_t, 7) + 0.0 AS ref_n FROM f"),
)
def a6(spark, d):
    first = F.substring("seq", (F.col("n_clip") + 1).cast("int"), F.col("n_first").cast("int"))
    places = pl.least_bases(short_reads(spark, d).select("chrom", "start", first.alias("bases")))
    return round_all(pl.reference_columns(stored(_windows(spark, d)), places), "ref_a", "ref_c", "ref_g", "ref_t", "ref_n")


@register("a7_column_profile", sql_over("WITH " + BASED + " SELECT c.window_id, c.col, " + ", ".join(f"round(avg({n}), 11) + 0.0 AS {n}" for n in CELL) + ", round(min(depth), 11) + 0.0 AS depth FROM cells c JOIN depth d ON c.window_id = d.window_id AND c.col = d.col GROUP BY c.window_id, c.col"))
def a7(spark, d):
    return round_cells(pl.column_profiles(stored(_windows(spark, d)), _signals(spark, d)), *CELL, "depth", digits=11)


@register("a8_window_features", sql_over("WITH " + FEATURED + " SELECT window_id, " + rounded(*pl.FEATURES, digits=11) + " FROM features"))
def a8(spark, d):
    return round_all(_features(spark, d), *pl.FEATURES, digits=11)


@register("a9_feature_table", sql_over("WITH " + FEATURED + " SELECT CASE WHEN cast(chrom AS int) <= 11 THEN 'train' ELSE 'test' END AS split, count(*) AS n_windows, round(avg(depth_mean), 7) + 0.0 AS depth_mean, round(avg(clip_rate), 7) + 0.0 AS clip_rate FROM features f JOIN wins w ON f.window_id = w.window_id GROUP BY 1"))
def a9(spark, d):
    joined = _features(spark, d).join(_windows(spark, d).select("window_id", "chrom"), "window_id")
    counted = joined.groupBy(wn.split_of(wn.chrom_to_int(F.col("chrom"))).alias("split")).agg(F.count(F.lit(1)).alias("n_windows"), F.avg("depth_mean").alias("depth_mean"), F.avg("clip_rate").alias("clip_rate"))
    return round_all(counted, "depth_mean", "clip_rate")


@register(
    "p8_rgb_cells",
    sql_over("WITH " + BASED + " SELECT window_id, read_id, col, round(greatest(0.0, least(1.0, base_a * (0.4 + 0.6 * mapq_s) + 0.5 * disc_s)), 7) + 0.0 AS red, round(greatest(0.0, least(1.0, base_t * (0.4 + 0.6 * mapq_s) + 0.5 * clip_s)), 7) + 0.0 AS green, round(greatest(0.0, least(1.0, base_c * (0.4 + 0.6 * mapq_s))), 7) + 0.0 AS blue FROM cells"),
)
def p8(spark, d):
    return round_cells(pl.rgb(_cells(spark, d)).select("window_id", "read_id", "col", "red", "green", "blue"), "red", "green", "blue")


@register("p10_clean_features", sql_over("SELECT l_orderkey % 1000 AS bucket, round(sum(CASE WHEN isnan(x) OR abs(x) = 'inf'::DOUBLE THEN 0.0 ELSE x END), 4) + 0.0 AS total, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_quantity / l_tax END AS x FROM {lineitem}) GROUP BY 1"))
def p10(spark, d):
    x = F.when(F.col("l_tax") == 0, float("nan")).when(F.col("l_discount") == 0, float("inf")).otherwise(F.try_divide("l_quantity", "l_tax"))
    df = view(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("bucket"), pl.clean(x).alias("x"))
    return df.groupBy("bucket").agg((F.round(F.sum("x"), 4) + 0.0).alias("total"), F.count(F.lit(1)).alias("n"))


@register("p14_standardise", sql_over("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - avg(l_quantity) OVER ()) / sqrt(greatest(var_pop(l_quantity) OVER (), 1e-8)), 6) + 0.0 AS l_quantity, round((l_tax - avg(l_tax) OVER ()) / sqrt(greatest(var_pop(l_tax) OVER (), 1e-8)), 6) + 0.0 AS l_tax FROM {lineitem}"))
def p14(spark, d):
    df = view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    return round_all(pl.standardise(df, ["l_quantity", "l_tax"]), "l_quantity", "l_tax", digits=6)


@register(
    "r1_running_normaliser",
    sql_over("""WITH RECURSIVE b AS (SELECT event_type, cast(ts AS date) AS day, avg(value) AS mean, var_pop(value) AS var, row_number() OVER (PARTITION BY event_type ORDER BY cast(ts AS date)) AS n FROM {events} GROUP BY event_type, cast(ts AS date)),
s AS (SELECT event_type, n, mean, var FROM b WHERE n = 1 UNION ALL SELECT b.event_type, b.n, s.mean * 0.99 + b.mean * (1 - 0.99), s.var * 0.99 + b.var * (1 - 0.99) FROM s JOIN b ON b.event_type = s.event_type AND b.n = s.n + 1)
SELECT event_type, round(arg_max(mean, n), 6) + 0.0 AS mean, round(arg_max(var, n), 5) + 0.0 AS var, max(n) AS n_batches FROM s GROUP BY event_type"""),
)
def r1(spark, d):
    batches = view(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return pl.running_normaliser(batches, "event_type", "day").withColumns({"mean": F.round("mean", 6) + 0.0, "var": F.round("var", 5) + 0.0})
