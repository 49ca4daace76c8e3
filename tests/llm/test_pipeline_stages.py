"""The stages of the pipeline against plain Python: toxic documents by their labels, copies by counted words, slots without gaps."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KIND = "garden river window morning letter bread music bridge winter paper".split()
RUDE = "vileword grubscum dreckhead snarlpig mudfool".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """600 documents, a third of them toxic, with labels of every second one; null texts, sources and ids, an empty text, repeated rows."""
    rng, path = random.Random(11), tmp_path_factory.mktemp("stages")
    rows, toxic = [], {}
    for i in range(600):
        words = [rng.choice(KIND) + rng.choice(("", "s", "ly")) for _ in range(rng.randrange(20, 60))]
        toxic[i] = i % 3 == 0
        if toxic[i]:
            for at in rng.sample(range(len(words)), 8):
                words[at] = rng.choice(RUDE)
        rows.append((i, " ".join(words), "en", rng.choice(("a", "a", "b", "c", None)), 1))
    rows += [(600, None, None, "a", 0), (601, "", None, None, 0), (None, "no id here", "en", "b", 1)] + [(602, "the same row again", "en", "c", 1)] * 5
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(not toxic[i]), int(toxic[i])) for i in range(600) if i % 2 == 0 or zlib.crc32(str(i).encode()) % 3 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, toxic


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_toxic_documents_go_and_clean_ones_stay(spark, folder):
    path, rows, toxic = folder
    out = STAGES["toxicity"](spark, read(spark, path), path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = Counter(tuple(r) for r in out.collect())
    assert all(kept[r] == n for r, n in Counter(rows).items() if r[0] is None or not toxic.get(r[0], False))
    gone = sum(toxic[i] and not any(k[0] == i for k in kept) for i in range(600))
    assert gone >= 0.95 * sum(toxic.values())


def test_sources_are_mixed_to_their_targets(spark, folder):
    path, rows, _ = folder
    out = [tuple(r) for r in STAGES["mix_sources"](spark, read(spark, path), path).collect()]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r)
    for r in out:
        taken[r[3]] += size(r)
    given, mixed = Counter(rows), Counter(out)
    assert set(mixed) <= set(given) and all(n <= 2 * given[r] for r, n in mixed.items())
    # The share of 150% by weights 3, 1, 2, 3 over a, b, c and null, each at most twice its words.
    weights, target, left, open_ = {"a": 3, "b": 1, "c": 2, None: 3}, dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-6:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in sizes)
        open_ = {s for s in open_ if target[s] < 2 * sizes[s]}
        target = {s: min(t, 2.0 * sizes[s]) for s, t in target.items()}
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)


def test_shards_and_slots(spark, folder):
    path, rows, _ = folder
    out = STAGES["shard"](spark, read(spark, path), path).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, shard_of = defaultdict(list), {}
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"] and r["grown_shard"] in (r["shard"], 8)
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_every_stage_takes_an_empty_table(spark, folder):
    path, _, _ = folder
    empty = read(spark, path).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name
