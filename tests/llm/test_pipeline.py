"""Every stage of the pipeline keeps the columns, and its decisions hold on a small corpus."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    text = lambda i: " ".join(f"w{(i * 37 + k * 11) % 501}" for k in range(60))
    item = " ".join(f"item{i}" for i in range(15))
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, text(1), "en", "s0", 1), (101, text(2) + " more", "en", "s1", 1), (102, "pre " + item, "en", "s2", 1), (103, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    assert stages["toxicity"](spark, docs, str(tmp_path)).columns == docs.columns
    unique = {r["doc_id"] for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect()}
    assert unique == {*range(40), 102, 103}
    clean = {r["doc_id"] for r in stages["decontaminate"](spark, docs, str(tmp_path)).collect()}
    assert clean == {r[0] for r in rows} - {102}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {*range(40), 103} and all(0 <= r["shard"] < 8 for r in out)
