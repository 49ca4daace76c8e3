"""Window stores, result documents and tables, and the integrity of chunked downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import numbered

SENTINELS = {"label": -1, "geno": -1, "del_len": -1, "bp0": float("nan"), "bp1": float("nan")}


def write_windows(windows: DataFrame, path: str, rows: int = 1024) -> None:
    """Parquet by sample and split, with at most ``rows`` rows a file; rows are dealt by ranges first, so a task writes few splits and no split is one task's."""
    ranged = windows.repartitionByRange("sample", "split", F.xxhash64(*windows.columns))
    ranged.write.mode("overwrite").partitionBy("sample", "split").option("maxRecordsPerFile", rows).parquet(path)


def with_shards(windows: DataFrame, groups: list[str], order: list[str], rows: int = 1024) -> DataFrame:
    """Numbers rows within each group and cuts them into shards of ``rows``."""
    return numbered(windows, groups, order).withColumn("shard", F.floor(F.col("_at") / rows).cast("long")).drop("_at", "_all")


def manifest(sharded: DataFrame, groups: list[str]) -> DataFrame:
    return sharded.groupBy(*groups, "shard").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"))


def consolidate(*tables: DataFrame, sentinels: dict | None = None) -> DataFrame:
    """All rows of the tables; columns that one lacks are null, or its sentinel where given."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    fill = SENTINELS if sentinels is None else sentinels
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items() if c in out.columns})


def consolidate_files(spark: SparkSession, folders: list[str], path: str, sidecar: str = "meta.", sentinels: dict | None = None) -> DataFrame:
    """One store of the shards in ``folders``, and its rows; folders whose name begins with ``sidecar`` are left out.

    The store must have as many rows as the shards' files say that they hold, else ValueError.
    """
    shards = [f for f in sorted(folders) if not f.rstrip("/").rsplit("/", 1)[-1].startswith(sidecar)]
    if not shards:
        raise FileNotFoundError(f"no shards in {folders}")
    parts = [spark.read.parquet(f) for f in shards]
    consolidate(*parts, sentinels=sentinels).write.parquet(path)
    store, expected = spark.read.parquet(path), sum(p.count() for p in parts)
    if (found := store.count()) != expected:
        raise ValueError(f"{found} rows of {expected} in {path}")
    return store


def read_windows(spark: SparkSession, path: str, split: str = "all", labelled: bool = True) -> DataFrame:
    """Windows of a split; the filter prunes partitions and an unlabelled read takes no label columns."""
    df = spark.read.parquet(path)
    df = df if split == "all" else df.where(F.col("split") == split)
    return df if labelled else df.drop("label", "geno", "bp0", "bp1", "del_len")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Long runs (arm, seed, frac, n, metric, value) of result documents; the seed is in the path of the file."""
    seed = F.regexp_extract("_metadata.file_path", r"seed=?(\d+)", 1).cast("int")
    df = spark.read.option("multiLine", True).json(path)
    return long_runs(df.select(seed.alias("seed"), F.explode("label_efficiency").alias("r")))


def write_documents(runs: DataFrame, path: str, arms: list[str], metrics: list[str]) -> None:
    """One JSON document for each benchmark and seed, in a folder of its own: metrics nested by arm, arms by budget.

    ``runs`` has benchmark, seed, frac, n, arm, metric, value.
    """
    named = F.struct(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    each = runs.groupBy("benchmark", "seed", "frac", "n", "arm").agg(named.alias("m"))
    budgets = each.groupBy("benchmark", "seed", "frac", "n").agg(*[F.max(F.when(F.col("arm") == a, F.col("m"))).alias(f"arm_{a}") for a in arms])
    nested = budgets.groupBy("benchmark", "seed").agg(F.array_sort(F.collect_list(F.struct("frac", "n", *[f"arm_{a}" for a in arms]))).alias("label_efficiency"))
    nested.write.partitionBy("benchmark", "seed").json(path)


def long_runs(df: DataFrame, not_arms: tuple[str, ...] = ("frac", "n", "n_train", "n_val")) -> DataFrame:
    """Turns every arm's metric struct of ``r`` into rows; arms are found by name, nulls and NaN go."""
    arms = [f for f in df.schema["r"].dataType.fields if f.name not in not_arms]
    rows = [
        F.struct(F.lit(a.name).alias("arm"), F.lit(m.name).alias("metric"), F.col(f"r.`{a.name}`.`{m.name}`").cast("double").alias("value"))
        for a in arms
        for m in a.dataType.fields
        if m.dataType.typeName() in ("double", "float", "integer", "long")
    ]
    long = df.select("seed", F.col("r.frac").alias("frac"), F.col("r.n").alias("n"), F.explode(F.array(*rows)).alias("x")).select("seed", "frac", "n", "x.*")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def documents_of(runs: DataFrame) -> DataFrame:
    """One document a benchmark and seed: an array of budgets with a map of arms to maps of metrics."""
    metrics = runs.groupBy("benchmark", "seed", "frac", "n", "arm").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    arms = metrics.groupBy("benchmark", "seed", "frac", "n").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", F.to_json("metrics").alias("m"))))).alias("arms"))
    return arms.groupBy("benchmark", "seed").agg(F.array_sort(F.collect_list(F.struct("frac", "n", F.to_json("arms").alias("arms")))).alias("label_efficiency"))


def chunk_check(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """Of each file's chunks (file, start, length, expected): gaps and overlaps, wrong lengths, and whether they fill [0, total)."""
    order = Window.partitionBy("file").orderBy("start", "length")
    seen = F.coalesce(F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = chunks.withColumn("_seen", seen)
    each = marked.groupBy("file").agg(
        F.count_if(F.col("start") > F.col("_seen")).alias("gaps"), F.count_if(F.col("start") < F.col("_seen")).alias("overlaps"), F.count_if(F.col("length") != F.col("expected")).alias("wrong"),
        F.sum("length").alias("bytes"), F.max(F.col("start") + F.col("length")).alias("end"),
    )
    whole = (F.col("gaps") == 0) & (F.col("overlaps") == 0) & (F.col("wrong") == 0) & (F.col("end") == F.col("total"))
    return each.join(totals, "file").withColumn("whole", whole)
