"""Runs over seeds and arms: summaries, contrasts, multiplicity, and audits of published cells.

``runs`` has benchmark, arm, seed, frac, metric, value (and n).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import p_value, quantile

CELL = ["benchmark", "frac", "metric"]


def summary(runs: DataFrame, groups: list[str], population: bool = False) -> DataFrame:
    """Mean, deviation (population, or sample with 0 for one seed) and number of the values of each group."""
    sd = F.stddev_pop("value") if population else F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    return runs.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*groups).agg(F.avg("value").alias("mean"), sd.alias("sd"), F.count(F.lit(1)).alias("n"))


def seed_list(runs: DataFrame, groups: list[str], digits: int = 4) -> DataFrame:
    """The values of each group in the order of seeds, joined by semicolons."""
    ordered = F.array_sort(F.collect_list(F.struct("seed", "value")))
    return runs.groupBy(*groups).agg(F.array_join(F.transform(ordered, lambda x: F.format_string(f"%.{digits}f", x["value"])), ";").alias("per_seed"))


def efficiency_table(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each benchmark, arm and fraction with mean and deviation of every metric."""
    aggs = [x for m in metrics for x in (F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(f"{m}_mean"), F.stddev_pop(F.when(F.col("metric") == m, F.col("value"))).alias(f"{m}_sd"))]
    return runs.groupBy("benchmark", "arm", "frac").agg(F.count_distinct("seed").alias("n_seeds"), *aggs)


def ceiling(summaries: DataFrame, groups: list[str]) -> DataFrame:
    """Gain from the least to the greatest budget and the share of the ceiling that the least one reaches; rows have frac and mean."""
    ends = summaries.groupBy(*groups).agg(F.min_by("mean", "frac").alias("at_least"), F.max_by("mean", "frac").alias("at_most"), F.min("frac").alias("low"), F.max("frac").alias("high"))
    return ends.select(*groups, (F.col("at_most") - F.col("at_least")).alias("gain"), F.try_divide("at_least", "at_most").alias("share_of_ceiling"), (F.col("high") / F.col("low")).alias("label_multiplier"))


def series(summaries: DataFrame, groups: list[str]) -> DataFrame:
    """Each group's points (x, y, sd) in order, for plotting."""
    return summaries.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(F.col("frac").alias("x"), F.col("mean").alias("y"), F.col("sd")))).alias("points"))


def variance_ratio(summaries: DataFrame, a: str, b: str) -> DataFrame:
    wide = summaries.groupBy(*CELL).agg(F.max(F.when(F.col("arm") == a, F.col("sd"))).alias("sd_a"), F.max(F.when(F.col("arm") == b, F.col("sd"))).alias("sd_b"))
    return wide.withColumn("ratio", F.try_divide("sd_a", "sd_b"))


def wins(summaries: DataFrame, a: str, b: str) -> DataFrame:
    """Fractions at which arm a's mean is above b's."""
    x = summaries.where(F.col("arm") == a).select(*CELL, F.col("mean").alias("a"))
    y = summaries.where(F.col("arm") == b).select(*CELL, F.col("mean").alias("b"))
    return x.join(y, CELL).groupBy("benchmark", "metric").agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count(F.lit(1)).alias("of"))


def arm_ranks(summaries: DataFrame) -> DataFrame:
    """Ranks of the arms that both benchmarks have, by mean within a fraction and metric, and the change of rank between two benchmarks."""
    common = summaries.groupBy("arm", "frac", "metric").agg(F.count_distinct("benchmark").alias("k")).where("k > 1").drop("k")
    ranked = summaries.join(common, ["arm", "frac", "metric"]).withColumn("rank", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("mean"), "arm")))
    both = ranked.groupBy("arm", "frac", "metric").agg(F.min_by("rank", "benchmark").alias("rank_first"), F.max_by("rank", "benchmark").alias("rank_second"))
    return both.withColumn("rank_change", F.col("rank_first") - F.col("rank_second"))


def moments(runs: DataFrame, groups: list[str]) -> DataFrame:
    return runs.groupBy(*groups).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("k"))


def welch(runs: DataFrame, pairs: list[tuple[str, str]], cell: list[str] = CELL) -> DataFrame:
    """Welch's t and its degrees of freedom for declared pairs of arms in each cell; null under two seeds or without variance."""
    each = moments(runs, [*cell, "arm"])
    declared = F.array(*[F.struct(F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b")) for a, b in pairs])
    a = each.select(*cell, F.col("arm").alias("arm_a"), F.col("m").alias("mean_a"), F.col("v").alias("v_a"), F.col("k").alias("n_a")).withColumn("p", F.explode(declared)).where("arm_a = p.arm_a").withColumn("arm_b", F.col("p.arm_b")).drop("p")
    b = each.select(*cell, F.col("arm").alias("arm_b"), F.col("m").alias("mean_b"), F.col("v").alias("v_b"), F.col("k").alias("n_b"))
    both = a.join(b, [*cell, "arm_b"])
    x, y = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    usable = (F.col("n_a") > 1) & (F.col("n_b") > 1) & (x + y > 0)
    df = (x + y) ** 2 / (x * x / (F.col("n_a") - 1) + y * y / (F.col("n_b") - 1))
    diff = F.col("mean_a") - F.col("mean_b")
    return both.select(*cell, "arm_a", "arm_b", "mean_a", "mean_b", "n_a", "n_b", diff.alias("diff"), F.when(usable, diff / F.sqrt(x + y)).alias("t"), F.when(usable, df).alias("df"))


def seed_paired(runs: DataFrame, a: str, b: str, cell: list[str] = CELL) -> DataFrame:
    """Differences of two arms on the seeds that both have."""
    x = runs.where(F.col("arm") == a).select(*cell, "seed", F.col("value").alias("a"))
    y = runs.where(F.col("arm") == b).select(*cell, "seed", F.col("value").alias("b"))
    return x.join(y, [*cell, "seed"]).withColumn("d", F.col("a") - F.col("b"))


def paired_t(differences: DataFrame, groups: list[str] = CELL, least: int = 3) -> DataFrame:
    """Mean difference, its deviation, and t with n - 1 degrees of freedom from ``least`` seeds on."""
    each = differences.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("diff"), F.stddev_samp("d").alias("diff_sd"))
    usable = (F.col("n_seeds") >= least) & (F.col("diff_sd") > 0)
    return each.withColumns({"t": F.when(usable, F.col("diff") / (F.col("diff_sd") / F.sqrt("n_seeds"))), "df": F.when(usable, (F.col("n_seeds") - 1).cast("double"))})


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", p_value(F.col("t"), F.col("df")))


def with_interval(tests: DataFrame) -> DataFrame:
    """95% interval of the mean difference and the least difference found with 80% power."""
    error = F.col("diff_sd") / F.sqrt("n_seeds")
    upper = quantile(0.975)(F.col("df"))
    return tests.withColumn("q", upper).withColumns({"ci_lo": F.col("diff") - F.col("q") * error, "ci_hi": F.col("diff") + F.col("q") * error, "mde80": (F.col("q") + quantile(0.80)(F.col("df"))) * error}).drop("q")


def holm(tests: DataFrame, family: list[str], p: str = "p", out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p values within a family; nulls stay null and don't count."""
    known = F.col(p).isNotNull()
    whole = Window.partitionBy(*family)
    order = Window.partitionBy(*family, known).orderBy(p)
    m, rank = F.count(p).over(whole), F.row_number().over(order)
    stepped = tests.withColumn("_s", F.when(known, (m - rank + 1) * F.col(p)))
    return stepped.withColumn(out, F.when(known, F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))))).drop("_s")


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str = "p", out: str = "q_bh") -> DataFrame:
    """Step-up adjusted p values within a family; nulls stay null and don't count."""
    known = F.col(p).isNotNull()
    whole = Window.partitionBy(*family)
    rank = F.row_number().over(Window.partitionBy(*family, known).orderBy(p))
    stepped = tests.withColumn("_r", rank).withColumn("_s", F.when(known, F.count(p).over(whole) * F.col(p) / F.col("_r")))
    down = Window.partitionBy(*family, known).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn(out, F.when(known, F.least(F.lit(1.0), F.min("_s").over(down)))).drop("_r", "_s")


def multiplicity_verdict(alpha: float = 0.05) -> Column:
    # The wording of the verdicts.
    return (
        F.when(F.col("p").isNull(), None).when(F.col("p_holm") < alpha, "survives Holm").when(F.col("q_bh") < alpha, "survives BH only").when(F.col("p") < alpha, "LOST to multiplicity").otherwise("not significant")
    )


def multiplicity_report(tests: DataFrame, family: list[str], alpha: float = 0.05) -> DataFrame:
    return benjamini_hochberg(holm(tests, family), family).withColumn("verdict", multiplicity_verdict(alpha))


def multiplicity_totals(report: DataFrame, alpha: float = 0.05) -> DataFrame:
    return report.agg(F.count("p").alias("n_tests"), F.count_if(F.col("p") < alpha).alias("nominal"), F.count_if(F.col("q_bh") < alpha).alias("bh"), F.count_if(F.col("p_holm") < alpha).alias("holm"))


def families(*sources: tuple[DataFrame, list[str], list[str]]) -> DataFrame:
    """One table of tests from several: (table with p, columns of the family, columns of the test's name)."""
    out = None
    for df, family, name in sources:
        own = df.select(F.concat_ws("/", *[F.col(c).cast("string") for c in family]).alias("family"), F.concat_ws("/", *[F.col(c).cast("string") for c in name]).alias("test"), F.col("p"))
        out = own if out is None else out.unionByName(own)
    return out


def best_of_family(summaries: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Best arm by mean of each of two families in every cell, the earlier listed among equals, of arms with over one seed."""

    def best(arms: list[str], suffix: str) -> DataFrame:
        place = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col("arm"))
        ranked = summaries.where(F.col("arm").isin(arms) & (F.col("n") > 1)).withColumn("_r", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("mean"), place)))
        return ranked.where("_r = 1").select(*CELL, F.col("arm").alias(f"arm_{suffix}"), F.col("mean").alias(f"mean_{suffix}"), F.col("sd").alias(f"sd_{suffix}"), F.col("n").alias(f"n_{suffix}"))

    both = best(first, "a").join(best(second, "b"), CELL)
    x, y = F.col("sd_a") ** 2 / F.col("n_a"), F.col("sd_b") ** 2 / F.col("n_b")
    diff = F.col("mean_a") - F.col("mean_b")
    return both.select(*CELL, "arm_a", "arm_b", "mean_a", "mean_b", diff.alias("diff"), F.when(x + y > 0, diff / F.sqrt(x + y)).alias("t"), F.when(x + y > 0, (x + y) ** 2 / (x * x / (F.col("n_a") - 1) + y * y / (F.col("n_b") - 1))).alias("df"))


def leader(alpha: float = 0.05) -> Column:
    return F.when(F.col("p").isNull() | (F.col("p") >= alpha), "tie").when(F.col("diff") > 0, "a").otherwise("b")


def rule_sensitivity(summaries: DataFrame, a: str, b: str) -> DataFrame:
    """Ratio of two arms' means under every scoring rule; infinite where the denominator is about 0."""
    x = summaries.where(F.col("arm") == a).select(*CELL, F.col("mean").alias("mean_a"))
    y = summaries.where(F.col("arm") == b).select(*CELL, F.col("mean").alias("mean_b"))
    return x.join(y, CELL).withColumn("ratio", F.when(F.col("mean_b") <= 1e-9, F.lit(float("inf"))).otherwise(F.try_divide("mean_a", "mean_b")))


def render(value: Column, digits: int, signed: bool = False) -> Column:
    """The value with ``digits`` decimals, halves away from zero, optionally with its sign."""
    return F.format_string(f"%{'+' if signed else ''}.{digits}f", F.round(value, digits) + 0.0)


def reconcile(published: DataFrame, source: DataFrame, keys: list[str], value: str = "value", digits: int = 3) -> DataFrame:
    """Cells of either table with their class: match, mismatch after rounding, missing from the source or from the publication."""
    a = published.select(*keys, F.col(value).alias("published"), F.lit(True).alias("_a"))
    b = source.select(*keys, F.col(value).alias("source"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "not_in_source").when(F.col("_a").isNull(), "not_published").when(F.round("published", digits) == F.round("source", digits), "match").otherwise("mismatch")
    return a.join(b, keys, "full_outer").select(*keys, "published", "source", kind.alias("status"))


def quoted_values(quoted: DataFrame, source: DataFrame) -> DataFrame:
    """Whether each quoted value (text, digits, value) is some source value at its own precision, or within half a unit of its last place.

    Source values are rounded to every precision that is quoted, so the match is an equi join; half-unit neighbours
    are the two roundings of a source value up and down.
    """
    scales = quoted.select("digits").distinct()
    unit = F.pow(F.lit(10.0), F.col("digits"))
    at = source.select("value").distinct().join(F.broadcast(scales)).select("digits", F.explode(F.array_distinct(F.array(F.round(F.col("value") * unit).cast("long"), F.floor(F.col("value") * unit + 0.5 + 1e-9).cast("long"), F.ceil(F.col("value") * unit - 0.5 - 1e-9).cast("long")))).alias("scaled")).distinct()
    asked = quoted.withColumn("scaled", F.round(F.col("value") * unit).cast("long"))
    return asked.join(at.withColumn("found", F.lit(True)), ["digits", "scaled"], "left").select(*quoted.columns, F.coalesce("found", F.lit(False)).alias("found"))


def quoted_text(quoted: DataFrame, source: DataFrame) -> DataFrame:
    """Whether each quoted text is some source value: at the decimals it shows, or within 15% where it has an exponent.

    ``quoted`` has a column text, ``source`` a column value. Values within 15% lie in the same or the next power of
    1.15, so these meet by an equi join too.
    """
    shown = quoted.select("text").distinct().withColumn("value", F.col("text").try_cast("double")).where("value IS NOT NULL")
    plain = shown.where(~F.lower("text").contains("e")).withColumn("digits", F.length(F.regexp_extract("text", r"\.(\d+)$", 1)))
    found = quoted_values(plain.select("text", "digits", "value"), source).where("found").select("text")
    power = F.floor(F.log("value") / F.log(F.lit(1.15)))
    near = shown.where(F.lower("text").contains("e") & (F.col("value") > 0)).select("text", "value", F.explode(F.array(power - 1, power, power + 1)).alias("power"))
    of = source.where("value > 0").select(F.col("value").alias("other"), power.alias("power")).distinct()
    met = near.join(of, "power").where(F.abs(F.col("other") - F.col("value")) <= 0.15 * F.col("value")).select("text")
    held = found.unionByName(met).distinct().withColumn("found", F.lit(True))
    return quoted.join(held, "text", "left").select(*quoted.columns, F.coalesce("found", F.lit(False)).alias("found"))


def audit_problems(axes: DataFrame, quotes: DataFrame, eligible: DataFrame) -> DataFrame:
    """Numbers of what breaks an audit: (problem, n).

    ``axes`` has a row for each coded paper and axis (doc_id, axis, code), ``quotes`` the quotes given for them
    (doc_id, axis, code, verified), ``eligible`` the papers that may be coded (doc_id).
    """
    on = ["doc_id", "axis"]
    given = quotes.groupBy(*on).agg(F.count(F.lit(1)).alias("n_quotes"))
    counted = axes.join(given, on, "left")
    coded = axes.select("doc_id").distinct()
    problems = {
        "not_one_quote": counted.where(F.coalesce("n_quotes", F.lit(0)) != 1),
        "other_code": quotes.join(axes.select(*on, F.col("code").alias("_code")), on).where("code != _code"),
        "quote_of_no_axis": quotes.join(axes, on, "left_anti"),
        "not_verified": quotes.where(~F.coalesce("verified", F.lit(False))),
        "coded_not_eligible": coded.join(eligible, "doc_id", "left_anti"),
        "eligible_not_coded": eligible.join(coded, "doc_id", "left_anti"),
    }
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n") for name, rows in problems.items()]
    return reduce(DataFrame.unionByName, parts)


def exclusion_problems(population: DataFrame, coded: DataFrame) -> DataFrame:
    """Numbers of what breaks a screen: (problem, n).

    ``population`` has a row a paper screened (doc_id, eligible, reason), ``coded`` the papers coded (doc_id). A paper that
    isn't eligible needs a reason that isn't blank; every eligible one is coded or counted as unavailable.
    """
    own = population.withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    of = coded.select("doc_id").distinct().withColumn("_coded", F.lit(True))
    met = own.join(of, "doc_id", "left")
    problems = {
        "excluded_without_reason": met.where(~F.col("eligible") & (F.trim(F.coalesce("reason", F.lit(""))) == "")),
        "excluded_but_coded": met.where(~F.col("eligible") & F.col("_coded").isNotNull()),
        "eligible_unavailable": met.where(F.col("eligible") & F.col("_coded").isNull()),
        "coded_not_screened": of.join(own.select("doc_id"), "doc_id", "left_anti"),
    }
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n") for name, rows in problems.items()]
    return reduce(DataFrame.unionByName, parts)


#: Number words of stated counts.
NUMBER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}


def table_cells(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, heading, cell): the cells of Markdown tables, a row each, with the heading of their column.

    Consecutive lines that begin with a bar are a table; its first line has the headings, lines of dashes and colons are
    rules. Tables are found inside a text's lines, without a window over texts.
    """
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = texts.select(key, F.split(text, "\n").alias("_lines"))
    bar = lambda i: F.coalesce(F.trim(F.get("_lines", i)).startswith("|"), F.lit(False))
    numbers = F.sequence(F.lit(0), F.size("_lines") - 1)
    # The line of the headings of every line: the last line up to it that begins a table.
    heads = F.aggregate(
        numbers, F.array().cast("array<int>"), lambda s, i: F.concat(s, F.array(F.when(~bar(i), F.lit(None).cast("int")).when((i > 0) & bar(i - 1), F.element_at(s, -1)).otherwise(i)))
    )
    placed = lines.where(F.exists("_lines", lambda x: F.trim(x).startswith("|"))).withColumn("_heads", heads)
    rows = placed.select(key, "_lines", F.posexplode("_heads").alias("line", "_head")).where("_head IS NOT NULL AND line > _head")
    own = rows.select(key, "line", cells(F.get("_lines", F.col("line"))).alias("_own"), cells(F.get("_lines", F.col("_head"))).alias("_names")).where(~F.forall("_own", lambda c: c.rlike("^[-: ]*$")))
    return own.select(key, "line", F.explode(F.arrays_zip(F.col("_names").alias("heading"), F.col("_own").alias("cell"))).alias("_c")).select(key, "line", "_c.heading", "_c.cell")


def stated_counts(texts: DataFrame, key: str, noun: str = "seeds", text: str = "text") -> DataFrame:
    """(key, token, n): every count of ``noun`` that texts state, in digits (one or two), in words, or in a table's column of that name."""
    digits = F.regexp_extract_all(text, F.lit(rf"\b[0-9]{{1,2}}\s+{noun}\b"), 0)
    words = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{'|'.join(NUMBER_WORDS)})\s+{noun}\b"), 0)
    first = F.lower(F.regexp_extract("token", r"^(\w+)", 1))
    number = F.coalesce(first.try_cast("long"), F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])[first].cast("long"))
    prose = texts.select(key, F.explode(F.concat(digits, words)).alias("token")).select(key, "token", number.alias("n"))
    cells = table_cells(texts, key, text).where(F.lower("heading").isin(noun, f"n_{noun}"))
    shown = cells.select(key, F.concat_ws(" ", "heading", "cell").alias("token"), F.col("cell").try_cast("long").alias("n")).where("n IS NOT NULL")
    return prose.unionByName(shown)


def unsupported_counts(stated: DataFrame, allowed: DataFrame) -> DataFrame:
    """The stated counts (.., n) that no source table has (allowed: n)."""
    return stated.join(allowed.select("n").distinct(), "n", "left_anti")


def normal_text(text: Column) -> Column:
    """Text with typographic quotes and dashes made plain, words joined over hyphenated line breaks, and white space made single."""
    plain = F.translate(text, "“”‘’–— ", "\"\"''-- ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"-\s*\n\s*", ""), r"\s+", " "))


def literal_spans(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """For each quote (quote_id, text): the number of sources (doc_id, text) that it is a literal span of, after normalisation.

    The words between a quote's first and last are whole words of any text that holds it. So candidates meet by four
    of them in a row (a single one in quotes of under six words) and are verified on the whole texts. Quotes of under
    three words are compared with every source. A quote without characters, or null, is a span of none.
    """
    q = quotes.select("quote_id", normal_text(F.col("text")).alias("quote")).where("quote_id IS NOT NULL").distinct()
    d = sources.select("doc_id", normal_text(F.col("text")).alias("source"))
    inner = q.where("quote != ''").withColumn("w", F.split("quote", " ")).withColumn("n", F.size("w"))
    anchor = F.when(F.col("n") >= 6, F.array_join(F.slice("w", 2, 4), " ")).otherwise(F.element_at("w", 2))
    anchored = inner.where("n >= 3").select("quote_id", "quote", anchor.alias("gram"))
    places = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))
    grams = F.array_union("w", F.when(F.size("w") >= 4, places).otherwise(F.array().cast("array<string>")))
    parts = d.withColumn("w", F.split("source", " ")).select("doc_id", "source", F.explode(F.array_distinct(grams)).alias("gram"))
    met = parts.join(anchored, "gram").select("quote_id", "quote", "doc_id", "source")
    short = d.join(F.broadcast(inner.where("n < 3").select("quote_id", "quote")), F.col("source").contains(F.col("quote"))).select("quote_id", "quote", "doc_id", "source")
    found = met.unionByName(short).where(F.col("source").contains(F.col("quote"))).groupBy("quote_id").agg(F.countDistinct("doc_id").alias("n_sources"))
    return q.select("quote_id").distinct().join(found, "quote_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)).cast("long")).withColumn("verified", F.col("n_sources") > 0)


def strict_flags(codes: DataFrame) -> DataFrame:
    """Defect flags of coded axes a to d and their number; unclear is never a defect on a and b."""
    flags = {
        "d1": F.col("axis_a").isin("uniform", "simulated", "no"),
        "d2": F.col("axis_b") == "yes",
        "d3": F.col("axis_c") == "missing",
        "d4": F.col("axis_d") != "reported",
    }
    out = codes.withColumns({k: F.coalesce(v, F.lit(False)).cast("int") for k, v in flags.items()})
    return out.withColumn("n_strict", F.col("d1") + F.col("d2") + F.col("d3") + F.col("d4"))
