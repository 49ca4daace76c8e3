import json
from pyspark.sql import functions as F

from locusmith.sources import tables, text
from locusmith.streaming.normaliser import running_normaliser

HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts"


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# c\ntrack x\nchr1\t300\t400\n1 100 200\n\nchr1\t150\t250\n1\t400\t500\n2\t1\t2\n")
    got = sorted(map(tuple, text.load_bed(spark, str(tmp_path / "a.bed"), ["1"]).collect()))
    assert got == [("1", 100, 250), ("1", 300, 500)]


def test_curated_vcf(spark):
    row = lambda pos, kind, filt, gt, end, size: f"chr1\t{pos}\t.\tN\t<X>\t.\t{filt}\tSVTYPE={kind};SVLEN={size};END={end}\tGT\t{gt}"
    vcf = lines(
        spark, HEAD, row(1000, "DEL", "PASS", "0/1", 1300, -300), row(5000, "DEL", ".", "1/1", 5600, -600), row(9000, "DEL", "LowQual", "0/1", 9300, -300), row(12000, "DEL", "PASS", "0/0", 12300, -300),
        row(15000, "DEL", "PASS", "0/1", 15020, -20), row(17000, "INS", "PASS", "0/1", 17000, 900),
    )
    positives, exclusions = text.parse_curated_vcf(vcf)
    assert sorted(map(tuple, positives.collect())) == [("1", 999, 1300, 1), ("1", 4999, 5600, 2)]
    spans = sorted((r["start"], r["stop"]) for r in exclusions.collect())
    assert len(spans) == 6 and spans[-1] == (16999, 17899)


def test_sam_and_fasta(spark, tmp_path):
    sam = lines(spark, "@HD", "r1\t99\t1\t101\t60\t3S5M2D4M1I2M\t=\t300\t400\tAAACGTACGTACGTA\tIIIIIIIIIIIIIII", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI")
    r = text.parse_sam(sam).collect()
    assert len(r) == 1 and (r[0]["start"], r[0]["stop"], r[0]["is_proper"], r[0]["quals"][0]) == (100, 113, True, 40)
    from locusmith.operators.pileup import aligned_runs

    runs = sorted((x["run_q"], x["run_r"], x["run_len"]) for x in aligned_runs(text.parse_sam(sam)).collect())
    assert runs == [(3, 100, 5), (8, 107, 4), (13, 111, 2)]
    (tmp_path / "a.fa").write_text(">c1 note\nACGT\nAC\n>c2\nTTTT\n")
    assert sorted(map(tuple, text.load_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("c1", "ACGTAC"), ("c2", "TTTT")]


def test_window_store_and_result_documents(spark, tmp_path):
    w = spark.range(40).select("id", F.lit("s").alias("sample"), F.when(F.col("id") < 25, "train").otherwise("test").alias("split"), (F.col("id") % 2).cast("int").alias("label"))
    tables.write_windows(w, str(tmp_path / "w"), 10)
    assert tables.read_windows(spark, str(tmp_path / "w"), "train").count() == 25
    assert "label" not in tables.read_windows(spark, str(tmp_path / "w"), labelled=False).columns
    both = tables.consolidate(w, spark.range(3))
    assert both.where("label = -1").count() == 3
    (tmp_path / "x_seed3.json").write_text('{"label_efficiency": [{"frac": 0.5, "n": 10, "one": {"auprc": 0.5, "f1": null}, "two": {"auprc": 0.25, "f1": 1.0}}]}')
    runs = tables.read_runs(spark, str(tmp_path / "x_seed3.json"))
    assert sorted((r["seed"], r["arm"], r["metric"], r["value"]) for r in runs.collect()) == [(3, "one", "auprc", 0.5), (3, "two", "auprc", 0.25), (3, "two", "f1", 1.0)]


def test_stream_equals_batch(spark, tmp_path):
    from locusmith.operators.pileup import running_normaliser as batch

    rows = [("a", 1, 2.0, 1.0), ("a", 2, 4.0, 3.0), ("b", 1, 1.0, 1.0), ("a", 3, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, batch long, mean double, var double")
    df.write.parquet(str(tmp_path / "in"))
    stream = running_normaliser(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("normaliser_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["key"]: (r["mean"], r["var"]) for r in spark.sql("SELECT key, max_by(mean, batch) AS mean, max_by(var, batch) AS var FROM normaliser_out GROUP BY key").collect()}
    assert got == {r["key"]: (r["mean"], r["var"]) for r in batch(df, "key", "batch").collect()}


def test_evaluation_documents_hold_every_run(spark):
    from locusmith.plans import registry
    from locusmith.plans.views import view

    d = "/root/testdata/sf0.001"
    runs = {(r["benchmark"], r["seed"], float(r["frac"]), r["arm"], r["metric"]) for r in view(spark, d, "runs").collect()}
    documents = registry.queries()["s13_evaluation_documents"](spark, d).collect()
    assert len(documents) == len({r[:2] for r in runs}) and len({r[0] for r in runs}) == 2
    held = [(x["benchmark"], x["seed"], b["frac"], arm, metric) for x in documents for b in x["label_efficiency"] for arm, m in json.loads(b["arms"]).items() for metric in json.loads(m)]
    assert len(held) == len(set(held)) and set(held) == runs


def test_quotes_are_sought_in_other_texts(spark):
    from locusmith.operators import inference as inf

    sources = [(1, "The cat sat on the mat and then it slept"), (2, "a multi-\n line  “word” here and there again"), (3, "nothing"), (4, None)]
    quotes = [(1, "at sat on the mat an"), (2, 'multiline "word"  here and'), (3, "cat sat on a mat and then"), (4, "sat on th"), (5, "on the"), (6, ""), (7, None), (8, "dog sat on the mat and")]
    got = inf.literal_spans(spark.createDataFrame(quotes, "quote_id long, text string"), spark.createDataFrame(sources, "doc_id long, text string"))
    assert {r["quote_id"]: (r["n_sources"], r["verified"]) for r in got.collect()} == {i: (int(i in (1, 2, 4, 5)), i in (1, 2, 4, 5)) for i in range(1, 9)}


def test_fasta_by_lines(spark, tmp_path):
    """Records of many sizes in several files, read by parts of 4 kB, equal the records, however parts and blocks fall."""
    import random

    rng = random.Random(2)
    want = {}
    for f in range(3):
        out = ["stray line before any header"] if f == 1 else []
        for i, n in enumerate((0, 1, 59, 60, 61, 5000, 20_000, 3)):
            name, width = f"r{f}_{i}", rng.choice((7, 60, 100))
            want[name] = "".join(rng.choice("ACGTN") for _ in range(n))
            out += [f">{name} a note", *[want[name][k : k + width] for k in range(0, n, width)]]
        (tmp_path / f"{f}.fa").write_text("\n".join(out) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        blocks = text.load_fasta_blocks(spark, str(tmp_path), 1000)
        assert text.load_lines(spark, str(tmp_path)).select("file", "piece").distinct().count() > 15
        rows = sorted((r["chrom"], r["block"], r["bases"]) for r in blocks.collect())
        ranges = spark.createDataFrame([(c, s, s + n) for c in want for s in (0, 999, 4321) for n in (1, 2500)], "chrom string, start long, stop long")
        pieces = text.slices_of(blocks, ranges, 1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == sorted((c, k, b[k * 1000 : k * 1000 + 1000]) for c, b in want.items() for k in range(max(1, -(-len(b) // 1000))))
    assert {(r["chrom"], r["start"], r["stop"]): r["bases"] for r in pieces} == {(c, s, s + n): want[c][s : s + n] for c in want for s in (0, 999, 4321) for n in (1, 2500)}


def test_read_store_prunes(spark, tmp_path):
    """Regions open the files of their own bins alone, and every read comes once however many regions and bins it meets."""
    reads = spark.range(3000).selectExpr("id % 3 AS chrom_no", "concat('', id % 3) AS chrom", "(id * 733) % 100000 AS start", "(id * 733) % 100000 + 50 + id % 2500 AS stop", "id % 7 AS tag").drop("chrom_no")
    reads = reads.unionByName(reads.where("start < 300"))
    text.write_reads(reads, str(tmp_path / "reads"), 1000)
    given = [("0", 500, 900), ("0", 950, 1000), ("0", 1400, 3300), ("2", 99_990, 105_000), ("2", 10, 20), ("1", 5, 5), ("9", 0, 10)]
    found = text.read_regions(spark, str(tmp_path / "reads"), spark.createDataFrame(given, "chrom string, start long, stop long"), 1000)
    want = [tuple(r) for r in reads.collect() if any(c == r["chrom"] and r["start"] < e and r["stop"] > s and e > s for c, s, e in given)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 30
    plan = found._jdf.queryExecution().executedPlan()

    def leaves(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        children = [node.children().apply(i) for i in range(node.children().size())]
        return [node] if not children else [x for c in children for x in leaves(c)]

    opened = [n.metrics().get("numFiles").get().value() for n in leaves(plan) if n.metrics().contains("numFiles")]
    total = sum(1 for _ in (tmp_path / "reads").rglob("*.parquet"))
    assert opened and max(opened) < total / 5


def test_sam_lines_are_split_once(spark):
    """Filters on flags are part of no plan that splits a line again, and a place needs no spelt cigar."""
    sam = lines(spark, "@HD\tVN:1", "r1\t16\t1\t11\t60\t3H7=2X5N1I1S\t=\t0\t0\tA\tI", "r2\t256\t1\t11\t60\t5M\t=\t0\t0\tA\tI")
    parsed = text.parse_sam(sam).select("read_id", "start", "stop", "is_reverse")
    assert [tuple(r) for r in parsed.collect()] == [("r1", 10, 24, True)]
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and "transform(" not in plan


def test_sam_scan_splits_each_line_once(spark):
    """Reads that overlap regions, each once, against plain Python; unmapped and secondary ones go, and the plan neither shuffles lines nor splits them again."""
    import random

    draw = random.Random(3)
    cigars = {"10M": 10, "2S5M3D4M1I2M6S": 14, "5M100N5M": 110, "3H7=2X": 9, "*": 0}
    rows = [(f"r{i}", draw.choice([0, 16, 99, 4, 256, 2048, 1]), draw.choice("123"), draw.randrange(1, 3000), draw.choice(list(cigars))) for i in range(600)]
    sam = lines(spark, "@HD\tVN:1", *["\t".join(map(str, (n, f, c, at, 60, g, "=", 0, 0, "A", "I"))) for n, f, c, at, g in rows + rows[:5]])
    regions = [("1", 100, 400), ("1", 300, 500), ("1", 1020, 1030), ("2", 0, 3000), ("2", 7, 7), ("4", 0, 9)]
    kept = [(n, at - 1, at - 1 + cigars[g], c) for n, f, c, at, g in rows + rows[:5] if not f & (4 | 256 | 2048)]
    want = sorted(r for r in kept if r[2] > r[1] and any(c == r[3] and r[1] < e and r[2] > b for c, b, e in regions))
    found = text.scan_sam(sam, spark.createDataFrame(regions, "chrom string, start long, stop long"), 64)
    assert sorted((r["read_id"], r["start"], r["stop"], r["chrom"]) for r in found.collect()) == want
    cigar = {r["read_id"]: "".join(f"{c['len']}{c['op']}" for c in r["cigar"]) for r in found.collect()}
    assert all(cigar[n] == g for n, _, _, _, g in rows if n in cigar)
    plan = found.select("read_id", "stop")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and "SortMergeJoin" not in plan
