"""Window geometry, candidate grids, hash-ordered sampling and label budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import contained_in, not_overlapping, overlap_join
from .ranges import firsts, halves, mark_firsts, meet, places, quantiles
from .stored import stored

WIN = 256
SCALES = (1, 2, 4, 8, 16, 32, 64)


def normal_chrom(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def chrom_to_int(chrom: Column) -> Column:
    """1 to 22, X 23, Y 24, M and MT 25, and -1 for anything else."""
    name = normal_chrom(chrom)
    return F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25).otherwise(F.coalesce(name.try_cast("int"), F.lit(-1))).cast("int")


def split_of(number: Column) -> Column:
    return F.when(number.between(1, 11), "train").when(number.between(12, 22), "test")


def bin_for_len(length: Column, win: int = WIN) -> Column:
    """The least scale whose window covers twice the length, 64 at most."""
    out = F.lit(SCALES[-1])
    for scale in reversed(SCALES[:-1]):
        out = F.when(length * 2 <= win * scale, scale).otherwise(out)
    return out.cast("int")


def positive_windows(calls: DataFrame, contigs: DataFrame, win: int = WIN) -> DataFrame:
    """A window centred on each call, inside its contig, with both ends of the call as fractions of the window."""
    span = F.col("bin_size") * win
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("long")
    sized = calls.withColumn("del_len", F.col("stop") - F.col("start")).withColumn("bin_size", bin_for_len(F.col("del_len"), win)).withColumn("span", span.cast("long"))
    placed = sized.join(contigs, "chrom").withColumn("win_start", F.greatest(F.lit(0), F.least(middle - F.floor(F.col("span") / 2).cast("long"), F.col("length") - F.col("span"))))
    fraction = lambda c: (F.col(c) - F.col("win_start")) / F.col("span")
    return placed.withColumns({"bp0": fraction("start"), "bp1": fraction("stop")}).drop("length")


def length_stratum(length: Column) -> Column:
    return F.when(length < 50, None).when(length < 200, "50-200").when(length < 500, "200-500").when(length < 1000, "500-1000").when(length < 5000, "1000-5000").when(length < 1_000_000_000, "5000+")


def tile(contigs: DataFrame, scales: tuple[int, ...] = (1,), stride: int | None = None, win: int = WIN) -> DataFrame:
    """Window starts at every stride of every contig for each scale; (chrom, start, stop, bin_size)."""
    sized = contigs.select("chrom", "length", F.explode(F.array(*[F.lit(s) for s in scales])).alias("bin_size")).withColumn("span", (F.col("bin_size") * win).cast("long"))
    step = F.lit(stride).cast("long") if stride else F.greatest(F.lit(win // 4), F.floor(F.col("span") / 4)).cast("long")
    starts = sized.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.col("length") - F.col("span")) - 1, step)))
    return starts.select("chrom", "start", (F.col("start") + F.col("span")).alias("stop"), "bin_size")


def unit_draw(seed: int | str, number: str, what: str) -> Column:
    """A reproducible number in [0, 1) of the column ``number``: 52 bits of an md5."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.col(number).cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def tries(contigs: DataFrame, first: int, last: int, scales: tuple[int, ...], weights: tuple[float, ...], margin: int, seed: int | str, win: int = WIN) -> DataFrame:
    """(draw, chrom, start, stop, bin_size) of the draws from ``first`` to before ``last``.

    A contig is drawn by its length through the cumulative lengths (those of at most three margins are left out), a scale
    by its weight, a place between the margins evenly. Contigs are one row of arrays: a table of names, not of data.
    """
    spark = contigs.sparkSession
    usable = contigs.where(F.col("length") > 3 * margin).select("chrom", F.col("length").cast("long").alias("length"))
    ordered = F.array_sort(F.collect_list(F.struct("chrom", "length")))
    cumulated = F.aggregate("c", F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["length"])))
    table = usable.agg(ordered.alias("c")).where("size(c) > 0").select("c", cumulated.alias("upto")).select("c", "upto", halves(F.size("upto")).alias("halves"))
    at = spark.range(first, last).withColumnRenamed("id", "draw").join(F.broadcast(table))
    point = F.floor(unit_draw(seed, "draw", "chrom") * F.element_at("upto", -1)).cast("long")
    share = [sum(weights[: i + 1]) / sum(weights) for i in range(len(weights))]
    scale = F.coalesce(*[F.when(unit_draw(seed, "draw", "scale") < c, s) for c, s in zip(share, scales, strict=True)], F.lit(scales[-1]))
    drawn = at.withColumn("own", F.get("c", places(F.col("upto"), point, F.col("halves")) - 1)).withColumn("bin_size", scale.cast("int")).withColumn("span", (F.col("bin_size") * win).cast("long"))
    room = F.greatest(F.lit(1), F.col("own.length") - F.col("span") - 2 * margin)
    begin = margin + F.floor(unit_draw(seed, "draw", "start") * room).cast("long")
    return drawn.select("draw", F.col("own.chrom").alias("chrom"), begin.alias("start"), (begin + F.col("span")).alias("stop"), "bin_size")


def random_windows(
    contigs: DataFrame, reads: DataFrame, n: int, scales: tuple[int, ...] = SCALES, weights: tuple[float, ...] | None = None, margin: int = 100_000, least_reads: int = 5, seed: int | str = 0, most_tries: int | None = None
) -> DataFrame:
    """The first ``n`` random windows, in the order of their draws, with at least ``least_reads`` reads; (draw, chrom, start, stop, bin_size, n_reads).

    Draws are made and met with reads in rounds, each as large as what is missing needs at the rate so far, until ``n``
    are kept or ``most_tries`` (a thousand times ``n``) are made. The rows don't depend on the rounds.
    """
    weights = weights or tuple(1.0 for _ in scales)
    most_tries, made, kept, found = most_tries or 1000 * n, 0, 0, None
    while kept < n and made < most_tries:
        size = min(most_tries - made, max(1000, 2 * (n - kept) if not kept else int(1.2 * (n - kept) * made / kept)))
        asked = tries(contigs, made, made + size, scales, weights, margin, seed)
        met = overlap_join(asked, reads.select("chrom", "start", "stop")).groupBy(*asked.columns).agg(F.count(F.lit(1)).alias("n_reads"))
        passed = stored(met.where(F.col("n_reads") >= least_reads))
        found = passed if found is None else found.unionByName(passed)
        made, kept = made + size, kept + passed.count()
    if found is None:
        raise ValueError("no windows are asked for")
    limit = contigs.sparkSession.createDataFrame([(0, n)], "_all int, n int")
    return firsts(found.withColumn("_all", F.lit(0)), ["_all"], ["draw"], limit, "n").drop("_all")


def hash_key(seed: int | str, *columns: str) -> Column:
    """A reproducible random order: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def first_by_hash(df: DataFrame, n: int | Column, keys: list[str], seed: int | str, groups: list[str] | None = None) -> DataFrame:
    """Up to n rows (of each group) in hash order."""
    order = Window.partitionBy(*(groups or [])).orderBy(hash_key(seed, *keys), *keys) if groups else None
    if order is None:
        return df.orderBy(hash_key(seed, *keys), *keys).limit(n)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def negative_grid(contigs: DataFrame, truth: DataFrame, positives: DataFrame, scales: tuple[int, ...], confident: DataFrame | None = None, exclude: DataFrame | None = None, win: int = WIN) -> DataFrame:
    """Every grid window that is a span away from truth and positive windows, inside ``confident`` and off ``exclude``."""
    grid = tile(contigs, scales, win=win).withColumns({"_start": F.col("start"), "_stop": F.col("stop")})
    # A window widened by its own span keeps clear of truth; windows near a positive meet a point of each in the reach of the wider one.
    span = F.col("_stop") - F.col("_start")
    grid = not_overlapping(grid.withColumns({"start": F.col("start") - span, "stop": F.col("stop") + span}), truth)
    reach = F.explode(F.array(*[F.struct(F.lit(s).alias("bin_size"), F.greatest(F.lit(s * win).cast("long"), F.col("span")).alias("reach")) for s in scales]))
    near = positives.select("chrom", "win_start", "span").distinct().withColumn("r", reach)
    near = near.select(F.concat_ws(":", "chrom", "r.bin_size").alias("chrom"), (F.col("win_start") - F.col("r.reach") + 1).alias("start"), (F.col("win_start") + F.col("r.reach")).alias("stop"))
    # The scale is part of the key, so one join serves all scales.
    points = grid.select(F.concat_ws(":", "chrom", "bin_size").alias("chrom"), F.col("chrom").alias("_chrom"), "bin_size", F.col("_start").alias("start"), (F.col("_start") + 1).alias("stop"), "_stop")
    grid = not_overlapping(points, near).select(F.col("_chrom").alias("chrom"), "start", F.col("_stop").alias("stop"), "bin_size")
    if confident is not None:
        grid = contained_in(grid, confident)
    if exclude is not None:
        grid = not_overlapping(grid, exclude)
    return grid.select("chrom", "start", "stop", "bin_size")


def quotas(positives: DataFrame, groups: list[str], per_positive: int = 3) -> DataFrame:
    return positives.groupBy(*groups).agg((F.count(F.lit(1)) * per_positive).alias("quota"))


def sample_to_quota(pool: DataFrame, wanted: DataFrame, groups: list[str], seed: int | str = 0) -> DataFrame:
    """The first rows of each group by hash, up to the group's quota."""
    placed = pool.withColumn("_hash", hash_key(seed, "chrom", "start", "bin_size"))
    return firsts(placed, groups, ["_hash", "chrom", "start", "bin_size"], wanted, "quota").drop("_hash")


def unplaced(sampled: DataFrame, wanted: DataFrame, groups: list[str]) -> DataFrame:
    placed = sampled.groupBy(*groups).agg(F.count(F.lit(1)).alias("placed"))
    return wanted.join(placed, groups, "left").select(*groups, "quota", F.coalesce("placed", F.lit(0)).alias("placed"), (F.col("quota") - F.coalesce("placed", F.lit(0))).alias("unplaced"))


def match_strata(positives: DataFrame, pool: DataFrame, groups: list[str], value: str, keys: list[str], per_positive: int = 3, strata: int = 10, seed: int | str = 0) -> DataFrame:
    """Rows of the pool whose distribution of ``value`` follows the positives', within each group.

    Strata are the positives' quantiles; each takes its share of the quota at random (by hash), and what that leaves
    open is filled by closeness to the positives' median. Both tables are read several times, so they had best be stored
    (see ``stored``). Quantiles come from counted values, and both draws sort the
    range of a group in which its limit lies, so no group is in one task.
    """
    inner = [i / strata for i in range(1, strata)]
    total = positives.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_pos"))
    found = quantiles(positives, groups, value, [*inner, 0.5]).join(total, groups)
    cuts = found.select(*groups, F.array_sort(F.array_distinct(F.slice("quantiles", 1, len(inner)))).alias("cuts"), F.element_at("quantiles", -1).alias("median"), "n_pos")
    stratum = F.size(F.filter("cuts", lambda c: c <= F.col(value)))
    of_pos = meet(positives, cuts.drop("n_pos"), groups, [value]).withColumn("stratum", stratum).groupBy(*groups, "stratum").agg(F.count(F.lit(1)).alias("n_in"))
    size = pool.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_pool"))
    limits = cuts.join(size, groups).withColumn("keep", F.least(F.col("n_pos") * per_positive, F.col("n_pool")))
    wants = of_pos.join(limits, groups).select(*groups, "stratum", F.floor(F.col("n_in") / F.col("n_pos") * F.col("keep")).cast("long").alias("want"))
    placed = meet(pool, limits.select(*groups, "cuts", "median"), groups, keys).withColumns({"stratum": stratum, "_hash": hash_key(seed, *keys), "_gap": F.abs(F.col(value) - F.col("median"))})
    drawn = stored(mark_firsts(placed.drop("cuts", "median"), [*groups, "stratum"], ["_hash", *keys], wants, "want", "first"))
    got = drawn.where("first").groupBy(*groups).agg(F.count(F.lit(1)).alias("got"))
    open_ = limits.join(got, groups, "left").select(*groups, (F.col("keep") - F.coalesce("got", F.lit(0))).alias("open"))
    filled = firsts(drawn.where("NOT first"), groups, ["_gap", *keys], open_, "open")
    return drawn.where("first").unionByName(filled).select(*pool.columns, "stratum", "first")


def match_offset(positives: DataFrame, kept: DataFrame, groups: list[str], value: str) -> DataFrame:
    """|median of positives - median of kept| of each group."""
    middle = lambda df, name: quantiles(df, groups, value, [0.5]).select(*groups, F.col("quantiles")[0].alias(name))
    return middle(positives, "pos_median").join(middle(kept, "neg_median"), groups).withColumn("offset", F.abs(F.col("pos_median") - F.col("neg_median")))


def check_match(offsets: DataFrame, most: float = 0.25) -> float:
    """The median offset; raises where it is above ``most``."""
    median = offsets.agg(F.expr("percentile(offset, 0.5)")).first()[0]
    if median is None or median > most:
        raise ValueError(f"matching failed: median offset {median}")
    return median


def label_budget(frac: Column, pool: Column) -> Column:
    """max(2, min(pool, frac * pool rounded half to even)); null for frac outside (0, 1] or a pool under 2."""
    n = F.greatest(F.lit(2), F.least(pool, F.bround(frac * pool, 0).cast("long")))
    return F.when((frac > 0) & (frac <= 1) & (pool >= 2), n)


def validation_size(n: Column, share: float = 0.2, least: int = 12) -> Column:
    """Labels of a budget that go to validation: none unless both sides get ``least``."""
    size = F.bround(n * F.lit(float(share)), 0).cast("long")
    return F.when((size >= least) & (n - size >= least), size).otherwise(F.lit(0)).cast("long")


def budget_subsets(rows: DataFrame, fracs: tuple[float, ...], key: str, seed: int | str, nested: bool = True, groups: list[str] | None = None, share: float = 0.2) -> DataFrame:
    """Each fraction's labelled rows, parted into validation and training: prefixes of one order, or an order for each fraction."""
    groups = groups or []
    fractions = F.explode(F.array(*[F.lit(float(f)) for f in fracs]))
    salt = [F.lit(str(seed))] if nested else [F.lit(str(seed)), F.col("frac").cast("string")]
    many = rows if nested else rows.withColumn("frac", fractions)
    own = groups if nested else [*groups, "frac"]
    ranked = hash_ranks(many.withColumn("_at", F.md5(F.concat_ws("|", *salt, F.col(key).cast("string")))), own, "_at", [key])
    # One order serves all fractions of nested subsets.
    ranked = ranked.withColumn("frac", fractions) if nested else ranked
    budget = label_budget(F.col("frac"), F.col("_n"))
    chosen = ranked.where(F.col("_rank") <= budget).withColumn("budget", budget)
    return chosen.withColumn("part", F.when(F.col("_rank") <= validation_size(F.col("budget"), share), "val").otherwise("train")).select(*rows.columns, "frac", "budget", "part")


def hash_ranks(rows: DataFrame, groups: list[str], at: str, ties: list[str]) -> DataFrame:
    """Adds ``_n``, the rows of a group, and ``_rank``, a row's place in the order of ``at`` (hex digits), then ``ties``.

    Rows are counted by the first three digits; running sums of the 4,096 counts of a group are where each range
    begins, so a task sorts one range of a group.
    """
    ranged = rows.withColumn("_range", F.substring(at, 1, 3))
    counts = ranged.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_in"))
    whole = Window.partitionBy(*groups, F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_n", F.sum("_in").over(whole)).withColumn("_first", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    within = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(at, *ties))
    return ranged.join(starts, [*groups, "_range"]).withColumn("_rank", F.col("_first") + within).drop("_range", "_first")


def thin_rows(reads: DataFrame, groups: list[str], keys: list[str], frac: float, cap: int, seed: int | str = 0) -> DataFrame:
    """round(frac * rows) of each group's rows, 1 at least and ``cap`` at most, in hash order."""
    w = Window.partitionBy(*groups)
    ranked = reads.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(hash_key(seed, *keys), *keys)))
    keep = F.least(F.greatest(F.bround(F.col("_n") * F.lit(float(frac)), 0).cast("long"), F.lit(1)), F.lit(cap))
    return ranked.where(F.col("_rank") <= keep).drop("_n", "_rank")
