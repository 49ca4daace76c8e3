"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text. A source takes each of its documents ``full`` times, and once more
those whose hash lies below the source's threshold. The threshold is found without sorting: sizes are summed by
source and hash bucket, the running sum names the bucket in which the budget ends, and only the documents of that
bucket are summed again by finer buckets. The last bucket is one hash value, in other words one document or rows that
repeat it: of its rows as many are taken as come nearest to what is left of the budget.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null id hashes as
the empty key; rows of one id and other texts are drawn apart, and of rows of one id and text any may be taken;
documents of a source without words aren't taken; an empty
table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, hash_bits, join_small

#: Bits of the hash that each level resolves, most significant first.
LEVELS = (12, 16, 16, 16)
RUNS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(RUNS)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null stand-in for the source; nulls come last in its order."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target of each source: its weighted share of ``share`` times all words, at most ``most`` times its own words.

    What sources above that limit leave is shared again by weight, which ends where each source gets
    min(limit, level * weight) for one common level. Sources in order of limit / weight reach their limit first, so
    the level is that of the first source that stays within its limit when all before it are at theirs. ``sizes`` has
    a row for each source (key, source_size); one window over all of them is a sort of the list of sources only.
    """
    order = Window.orderBy("key")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "key")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level")))
    return leveled.select("key", "source_size", F.least(F.col("limit"), F.coalesce(F.max("fits").over(everything), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source: full copies, the hash below which its documents are taken once more, and of how many rows of that hash (``partial``).

    ``sized``: key, size, hash; ``goals``: key, source_size, target.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("full", full).select("key", "source_size", "target", "full", (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("start"))
    state, rest = checkpoint(state), sum(LEVELS)
    for width in LEVELS:
        above, rest = rest, rest - width
        inside = sized if above == sum(LEVELS) else join_small(sized.withColumn("_at", F.shiftright("hash", above)), state.select("key", F.shiftright("start", above).alias("_at")), ["key", "_at"])
        held = inside.groupBy("key", F.shiftleft(F.shiftright("hash", rest), rest).alias("low")).agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
        running = F.sum("held").over(Window.partitionBy("key").orderBy("low"))
        summed = held.withColumn("upto", running)
        found = summed.join(state.select("key", "budget"), "key").where(F.col("upto") > F.col("budget")).groupBy("key").agg(F.min_by(F.struct("low", "held", "upto", "n"), "low").alias("at"))
        state = checkpoint(
            state.join(found, "key", "left").select(
                "key", "source_size", "target", "full",
                F.when(F.col("at").isNull(), F.col("budget")).otherwise(F.col("budget") - (F.col("at.upto") - F.col("at.held"))).alias("budget"),
                F.coalesce(F.col("at.low"), F.col("start")).alias("start"),
                F.col("at.held").alias("held"),
                F.col("at.n").alias("n"),
            )
        )
    # The rows of the last hash are alike, so a share of their words is that share of the rows.
    near = F.floor(F.col("budget") / F.col("held") * F.col("n") + 0.5)
    some = F.when(F.col("held").isNotNull() & (F.col("budget") > 0), F.least(near, F.col("n"))).otherwise(F.lit(0)).cast("long")
    whole = (some == F.coalesce("n", F.lit(-1))).cast("long")
    # Without a budget nothing is taken once more, nor are documents without words below the first hash that has some.
    more = F.col("target") > F.col("full") * F.col("source_size")
    return state.select(
        "key", "source_size", "target", "full",
        F.when(more, F.col("start") + whole).otherwise(F.lit(0)).cast("long").alias("threshold"),
        F.when(more & (whole == 0), some).otherwise(F.lit(0)).cast("long").alias("partial"),
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, size, hash) of every document, and the thresholds of every source; both checkpointed."""
    sized = checkpoint(docs.select("doc_id", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text"), seed).alias("hash")))
    sizes = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    return sized, checkpoint(thresholds(sized, targets(sizes, weights, share, most)))


def doc_hash(doc_id: Column, text: Column, seed: str) -> Column:
    return hash_bits(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))), 15)


def with_copies(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds to rows with ``key`` and ``hash`` the columns of ``limits`` and ``copies``, how often the mix takes the row.

    Rows of a last hash that is taken in part are numbered: they are stored, counted by task, and numbered in each
    task's share from where its count begins. Without such a hash there is nothing to number.
    """
    met = join_small(rows, limits, ["key"])
    copies = F.col("full") + (F.col("hash") < F.col("threshold")).cast("long")
    if limits.where("partial > 0").isEmpty():
        return met.withColumn("copies", copies)
    last = (F.col("hash") == F.col("threshold")) & (F.col("partial") > 0)
    dealt = checkpoint(met.where(last)).withColumn("_task", F.spark_partition_id())
    counts = dealt.groupBy("key", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("key", "_task", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("key", "_task").orderBy("hash"))
    numbered = dealt.join(starts, ["key", "_task"]).withColumn("copies", F.col("full") + (number <= F.col("partial")).cast("long"))
    return met.where(~last).withColumn("copies", copies).unionByName(numbered.drop("_task", "_before"))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    sized, limits = plan(docs, **options)
    return with_copies(sized, limits).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``."""
    _, limits = plan(docs, seed=seed, **options)
    held = docs.select(F.struct(*docs.columns).alias("doc"), source_key(docs["source"]).alias("key"), doc_hash(docs["doc_id"], docs["text"], seed).alias("hash"))
    taken = with_copies(held, limits).where(F.col("copies") > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1)))).alias("copy")).select("doc.*")


SQL_SIZES = r"""
sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 15))::BIGINT AS hash
  FROM {docs}),
sources AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap FROM sources),
leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
goals AS (
  SELECT key, source_size, least(cap, weight * (SELECT max(level) FROM leveled WHERE level <= cap / weight)) AS target
  FROM leveled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_copies FROM goals),
per_hash AS (SELECT key, hash, sum(size)::BIGINT AS held, count(*) AS n FROM sized GROUP BY key, hash),
running AS (
  SELECT p.*, sum(held) OVER (PARTITION BY p.key ORDER BY hash) AS upto, target - full_copies * source_size AS budget
  FROM per_hash p JOIN budgets USING (key)),
cuts AS (
  SELECT key, min(hash) AS threshold,
         arg_min(CASE WHEN budget > upto - held THEN least(n, floor((budget - (upto - held)) / held * n + 0.5)) ELSE 0 END, hash)::BIGINT AS some
  FROM running WHERE upto > budget AND budget > 0 GROUP BY key),
counted AS (SELECT *, row_number() OVER (PARTITION BY key, hash ORDER BY doc_id) AS i FROM sized),
mixed AS (
  SELECT s.*, b.source_size, b.target,
         b.full_copies + CASE WHEN s.hash < coalesce(c.threshold, 0) OR (s.hash = c.threshold AND s.i <= c.some) THEN 1 ELSE 0 END AS copies
  FROM counted s JOIN budgets b USING (key) LEFT JOIN cuts c USING (key))
"""
SQL = (
    "WITH "
    + SQL_SIZES.format(docs="documents")
    + "SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM mixed"
)
