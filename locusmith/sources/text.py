"""BED, VCF, SAM and FASTA text as DataFrames. Every ``load_`` reads files, every ``parse_`` takes their lines (value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import bin_of, merge_intervals, over_bins
from ..operators.stored import stored
from ..operators.windows import normal_chrom

#: Rows up to which regions are broadcast.
BROADCAST_ROWS = 200_000
#: Bases of a block of a stored sequence.
BLOCK = 1 << 16
VCF = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def parse_bed(lines: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    """Merged intervals; blank lines, comments and track or browser lines are skipped and a leading chr goes."""
    parts = lines.where(~F.trim("value").rlike("^(#|track|browser)") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    rows = parts.select(normal_chrom(F.col("p")[0]).alias("chrom"), F.col("p")[1].try_cast("long").alias("start"), F.col("p")[2].try_cast("long").alias("stop"))
    return merge_intervals(rows.where(F.col("chrom").isin(chroms)) if chroms else rows)


def load_bed(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    return parse_bed(spark.read.text(path), chroms)


def _records(lines: DataFrame) -> DataFrame:
    parts = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("p"))
    named = parts.select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(VCF)], "p")
    info = F.str_to_map("info", F.lit(";"), F.lit("="))
    first = named.withColumns({"pos": F.col("pos").try_cast("long"), "info": info, "start": F.col("pos").try_cast("long") - 1})
    length = F.abs(F.get(F.split(F.col("info")["SVLEN"], ","), F.lit(0)).try_cast("long"))
    end = F.coalesce(F.col("info")["END"].try_cast("long"), F.col("start") + F.length("ref"))
    return first.withColumns({"svtype": F.col("info")["SVTYPE"], "svlen": length, "end": end})


def _alleles(field: Column) -> Column:
    return F.split(F.get(F.split(field, ":"), F.lit(0)), r"[/|]")


def _passes() -> Column:
    return F.size(F.array_except(F.split("filter", ";"), F.array(F.lit("PASS"), F.lit("."), F.lit("")))) == 0


def parse_curated_vcf(lines: DataFrame, chroms: list[str] | None = None, least: int = 50, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(positives with genotype, merged exclusions of all records). A positive is a passing deletion of fitting length with a called alternative allele."""
    r = _records(lines).withColumn("chrom", normal_chrom(F.col("chrom")))
    r = r.where(F.col("chrom").isin(chroms)) if chroms else r
    reach = F.greatest(F.col("end"), F.col("start") + F.when(F.coalesce("svlen", F.lit(0)) > 0, F.col("svlen")).otherwise(1))
    exclusions = merge_intervals(r.select("chrom", "start", reach.alias("stop")))
    called = F.filter(_alleles(F.col("p")[9]), lambda a: a != ".")
    span = F.col("end") - F.col("start")
    positive = (F.col("svtype") == "DEL") & _passes() & span.between(least, most) & F.exists(called, lambda a: a != "0")
    geno = F.when(F.forall(called, lambda a: a == "1"), 2).otherwise(1)
    return r.where(positive).select("chrom", "start", F.col("end").alias("stop"), geno.alias("geno")), exclusions


def parse_sample_vcf(lines: DataFrame, sample: str, least: int = 50, most: int = 1_000_000) -> DataFrame:
    """Deletions that one sample of a multi-sample file carries; filters are ignored and chr stays. Raises if the sample is absent."""
    header = lines.where(F.col("value").startswith("#CHROM")).select(F.split("value", "\t").alias("h")).first()
    if header is None or sample not in header["h"]:
        raise ValueError(f"no sample {sample}")
    alts = F.size(F.filter(_alleles(F.get("p", F.lit(header["h"].index(sample)))), lambda a: F.coalesce(a.try_cast("int"), F.lit(0)) > 0))
    r = _records(lines).withColumn("end", F.when((F.col("end") <= F.col("start")) & F.col("svlen").isNotNull(), F.col("start") + F.col("svlen")).otherwise(F.col("end")))
    kept = r.where((F.col("svtype") == "DEL") & (F.col("end") - F.col("start")).between(least, most) & (alts > 0))
    return kept.select("chrom", "start", F.col("end").alias("stop"), F.when(alts >= 2, 2).otherwise(1).alias("geno"))


def parse_candidate_vcf(lines: DataFrame, least: int = 50, most: int = 1_000_000, pass_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(candidate deletions, one row with n_read and n_kept)."""
    r = _records(lines).withColumn("chrom", normal_chrom(F.col("chrom")))
    keep = F.coalesce((F.col("svtype") == "DEL") & (F.col("end") - F.col("start")).between(least, most), F.lit(False))
    keep = keep & _passes() if pass_only else keep
    return r.where(keep).select("chrom", "start", F.col("end").alias("stop")), r.agg(F.count(F.lit(1)).alias("n_read"), F.count_if(keep).alias("n_kept"))


def _sam_fields(lines: DataFrame) -> DataFrame:
    """The fields of SAM lines of mapped primary alignments in one array ``p``; generators hand on each line and split it, so filters neither make nor split it again."""
    body = lines.select(F.explode(F.array("value")).alias("value")).where(~F.col("value").startswith("@"))
    p = body.select(F.explode(F.array(F.split("value", "\t"))).alias("p"))
    return p.where(F.col("p")[1].cast("int").bitwiseAND(4 | 256 | 2048) == 0)


def _sam_rows(p: DataFrame) -> DataFrame:
    flag = F.col("p")[1].cast("int")
    cut = F.regexp_extract_all(F.col("p")[5], F.lit(r"(\d+)([MIDNSHP=X])"), 0)
    cigar = F.transform(cut, lambda c: F.struct(F.substring(c, -1, 1).alias("op"), F.substring(c, F.lit(1), F.length(c) - 1).cast("long").alias("len")))
    # Operations that use the reference, summed from the text, so that whoever needs no cigar doesn't spell it.
    used = F.aggregate(F.regexp_extract_all(F.col("p")[5], F.lit("(\\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))
    bit = lambda n: flag.bitwiseAND(n) != 0
    start = F.col("p")[3].cast("long") - 1
    return p.select(
        F.col("p")[0].alias("read_id"), flag.alias("flag"), F.col("p")[2].alias("chrom"), start.alias("start"), F.col("p")[4].cast("int").alias("mapq"),
        cigar.alias("cigar"), F.col("p")[8].cast("long").alias("tlen"), F.col("p")[9].alias("seq"),
        F.transform(F.filter(F.split(F.col("p")[10], ""), lambda c: c != ""), lambda c: F.ascii(c) - 33).alias("quals"),
        (start + used).alias("stop"), bit(16).alias("is_reverse"), bit(1).alias("is_paired"), (~bit(1) | bit(2)).alias("is_proper"),
    )


def parse_sam(lines: DataFrame) -> DataFrame:
    """Mapped primary alignments of SAM text with flags, cigar operations and base qualities spelt out."""
    return _sam_rows(_sam_fields(lines))


def scan_sam(lines: DataFrame, regions: DataFrame, width: int = 1 << 16) -> DataFrame:
    """The alignments of SAM lines that overlap any of the regions (chrom, start, stop), each row once.

    Lines of other chroms go before more than their fields is parsed, and up to ``BROADCAST_ROWS`` bins of regions are
    broadcast, so that no line is shuffled.
    """
    wide, few = _wide_regions(regions, width)
    chroms = wide.select("_chrom").distinct()
    near = _sam_fields(lines).join(F.broadcast(chroms) if few else chroms, F.col("p")[2] == F.col("_chrom"), "left_semi")
    reads = over_bins(_sam_rows(near), width, "_bin")
    met = reads.join(F.broadcast(wide) if few else wide, (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_wide")))
    return _met_once(met, "_bin", width).select(*[c for c in reads.columns if c != "_bin"])


def parse_fasta(lines: DataFrame) -> DataFrame:
    """(chrom, sequence) of records, one row each (value: a record without its leading >)."""
    return lines.where(F.trim("value") != "").select(F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


def load_fasta(spark: SparkSession, path: str) -> DataFrame:
    return parse_fasta(spark.read.option("lineSep", ">").text(path))


def blocks(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """(chrom, block, bases): sequences in pieces of ``size`` bases, numbered from 0."""
    pieces = F.regexp_extract_all("sequence", F.lit("(?s).{1,%d}" % size), F.lit(0))
    return sequences.select("chrom", F.posexplode(pieces).alias("block", "bases")).withColumn("block", F.col("block").cast("long"))


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, piece, at, value): the lines of text files; ``piece`` is where a task's part of the file begins, ``at`` orders the lines of a part."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"), "value")


def fasta_blocks(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """(chrom, block, bases) of FASTA lines (see ``load_lines``), with no record in one row or task.

    Parts of files are summed, and the sums run over per file: how many bases lie before a part, and which record it goes
    on with. In a part, a line's place in its record is the bases so far less those before the record's header. Lines are
    cut where blocks end, and a block is put together from its lines. Records without bases have one empty block, lines
    before any header go. The bases of one line are one row, so records should be wrapped.
    """
    header = F.col("value").startswith(">")
    rows = lines.select("file", "piece", "at", F.when(header, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), F.when(header, "").otherwise(F.regexp_replace("value", r"\s", "")).alias("bases"))
    rows = rows.withColumn("n", F.length("bases").cast("long"))
    inside = Window.partitionBy("file", "piece").orderBy("at")
    placed = rows.withColumn("upto", F.sum("n").over(inside)).withColumn("mark", F.last(F.when(F.col("name").isNotNull(), F.struct("name", F.col("upto").alias("begin"))), ignorenulls=True).over(inside))
    parts = placed.groupBy("file", "piece").agg(F.sum("n").alias("sum"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("at"))).alias("mark"))
    along = Window.partitionBy("file").orderBy("piece")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    started = parts.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    marked = F.when(F.col("mark").isNotNull(), F.struct(F.col("mark.name").alias("name"), (F.col("base") + F.col("mark.begin")).alias("begin")))
    given = started.select("file", "piece", "base", F.last(marked, ignorenulls=True).over(before).alias("given"))
    met = placed.join(given, ["file", "piece"])
    chrom = F.when(F.col("mark").isNotNull(), F.col("mark.name")).otherwise(F.col("given.name"))
    begin = F.when(F.col("mark").isNotNull(), F.col("base") + F.col("mark.begin")).otherwise(F.col("given.begin"))
    spans = met.select(chrom.alias("chrom"), (F.col("base") + F.col("upto") - F.col("n") - begin).alias("start"), "bases", "n", F.col("name").isNotNull().alias("head")).where("chrom IS NOT NULL AND (n > 0 OR head)")
    blocks_of = F.sequence(bin_of("start", size), bin_of(F.col("start") + F.greatest("n", F.lit(1)) - 1, size))
    cut = spans.withColumn("block", F.explode(blocks_of)).withColumn("skip", F.greatest(F.col("block") * size - F.col("start"), F.lit(0)))
    end = F.least(F.col("n"), (F.col("block") + 1) * size - F.col("start"))
    pieces = cut.select("chrom", "block", (F.col("start") + F.col("skip")).alias("start"), F.substring("bases", (F.col("skip") + 1).cast("int"), (end - F.col("skip")).cast("int")).alias("piece"))
    return pieces.groupBy("chrom", "block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "piece")))["piece"], "").alias("bases"))


def load_fasta_blocks(spark: SparkSession, path: str, size: int = BLOCK) -> DataFrame:
    return fasta_blocks(load_lines(spark, path), size)


def slices(sequences: DataFrame, ranges: DataFrame, size: int = BLOCK) -> DataFrame:
    """The bases of each range (chrom, start, stop) of a known chrom, as far as its sequence goes."""
    return slices_of(blocks(sequences, size), ranges, size, sequences.select("chrom"))


def slices_of(stored_blocks: DataFrame, ranges: DataFrame, size: int = BLOCK, chroms: DataFrame | None = None) -> DataFrame:
    """``slices`` of stored blocks (chrom, block, bases), which ranges meet in an equi join; known chroms are those with a block unless given."""
    keys = ["chrom", "start", "stop"]
    first, last = F.floor(F.col("start") / size), F.floor((F.greatest(F.col("stop"), F.col("start") + 1) - 1) / size)
    asked = ranges.select(*keys).distinct().withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start") - F.col("block") * size, F.lit(0))
    end = F.least(F.col("stop") - F.col("block") * size, F.lit(size))
    piece = F.substring("bases", (begin + 1).cast("int"), (end - begin).cast("int"))
    met = asked.join(stored_blocks, ["chrom", "block"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", piece.alias("piece")))).alias("_pieces"))
    known = ranges.join(chroms if chroms is not None else stored_blocks.select("chrom"), "chrom", "left_semi")
    return known.join(met, keys, "left").select(*ranges.columns, F.coalesce(F.array_join("_pieces.piece", ""), F.lit("")).alias("bases"))


def write_reads(reads: DataFrame, path: str, width: int = 1 << 20, rows: int = 1_000_000) -> None:
    """A store of reads (chrom, start, stop, ...) by chrom and wide bin; a read is in each bin that it touches.

    Reads are dealt by ranges of their place, so a bin of any depth is written by as many tasks as it needs.
    """
    placed = over_bins(reads, width, "wide").withColumn("of", F.concat(F.lit("_"), "chrom"))
    placed.repartitionByRange("of", "wide", "start").sortWithinPartitions("of", "wide", "start").write.partitionBy("of", "wide").option("maxRecordsPerFile", rows).parquet(path)


def _wide_regions(regions: DataFrame, width: int) -> tuple[DataFrame, bool]:
    """Merged regions (_chrom, _wide, _start, _stop, and the stop _before) in each wide bin that they touch, within the bins' bounds, and whether they are few."""
    merged = stored(merge_intervals(regions.where("stop > start")))
    before = F.lag("stop").over(Window.partitionBy("chrom").orderBy("start"))
    wide = stored(over_bins(merged.withColumn("_before", before), width, "_wide")).select(F.col("chrom").alias("_chrom"), "_wide", F.col("start").alias("_start"), F.col("stop").alias("_stop"), "_before")
    n, low, high = wide.agg(F.count(F.lit(1)), F.min("_wide"), F.max("_wide")).first()
    return (wide.where(F.col("_wide").between(low, high)) if n else wide), n <= BROADCAST_ROWS


def _met_once(met: DataFrame, wide: str, width: int) -> DataFrame:
    """Of reads joined with regions in wide bins, those that overlap: a read counts for the first region that it overlaps, in the bin in which the later of the two begins."""
    first = (F.col("start") < F.col("_stop")) & (F.col("stop") > F.col("_start")) & (F.col("_before").isNull() | (F.col("_before") <= F.col("start")))
    return met.where(first & (F.col(wide) == bin_of(F.greatest("start", "_start"), width)))


def read_regions(spark: SparkSession, path: str, regions: DataFrame, width: int = 1 << 20) -> DataFrame:
    """The reads of a store that overlap any of the regions (chrom, start, stop), each row once; other bins' files aren't read.

    Merged regions meet the store by its partition columns, so they prune its files when the query runs.
    """
    wide, few = _wide_regions(regions, width)
    wide = wide.withColumn("_of", F.concat(F.lit("_"), "_chrom"))
    # The bounds prune when the query is planned, the broadcast when it runs; more regions than that meet the bins within the bounds by shuffle.
    reads = spark.read.parquet(path)
    met = reads.join(F.broadcast(wide) if few else wide, (F.col("of") == F.col("_of")) & (F.col("wide") == F.col("_wide")))
    return _met_once(met, "wide", width).select(*[c for c in reads.columns if c not in ("of", "wide")])
