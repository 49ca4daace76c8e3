"""Mixing, decontamination and sharding against plain Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from locusmith.llm import decontaminate, mixing, sharding

SCHEMA = "doc_id long, text string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, n=300, seed=4):
    rng = random.Random(seed)
    words = [f"wört{i}" if i % 3 else f"Word{i}" for i in range(400)]
    rows = [(i, rng.choice(("", " ", "\n")) + rng.choice((" ", ". ", "\t")).join(rng.choice(words) for _ in range(rng.randrange(1, 60))), rng.choice(("a", "b", "b", "b", "c", None)), i) for i in range(n)]
    rows += [(n, None, "a", 0), (n + 1, "", None, 0), (n + 2, "  \n ", "b", 0), (None, "no id", "c", 0), (5, rows[5][1], rows[5][2], 5), (n + 3, "long " * 5000, "c", 0)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_mix(spark):
    rows, df = documents(spark)
    got = mixing.mixed_sizes(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-6:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in order)
        open_ -= {s for s in order if target[s] >= 2 * sizes[s]}
        target = {s: min(target[s], 2.0 * sizes[s]) for s in order}
    of = {r["doc_id"]: r for r in got}
    taken = defaultdict(int)
    for r in rows:
        taken[r[2]] += of[r[0]]["taken"]
        assert math.isclose(of[r[0]]["target"], target[r[2]], rel_tol=1e-9) and of[r[0]]["taken"] <= 2 * of[r[0]]["size"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size(r[1]) for r in rows if r[2] == s) + 1
    mixed = mixing.mix(df.withColumnRenamed("n_chars", "copies"))
    assert mixed.columns == ["doc_id", "text", "source", "copies"]
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mixed_sizes(df.limit(0)).count() == 0


def test_decontaminate(spark):
    rng = random.Random(9)
    _, df = documents(spark, 40)
    items = [(1, " ".join(f"Item{i}, É{i}" for i in range(20))), (2, "short one"), (3, None), (4, "..."), (5, "short one"), (6, " ".join(f"item{i} É{i}" for i in range(8)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    base = [f"b{i}" for i in range(60)]
    rows = [(100, "x " * 30 + items[0][1].upper().replace("É", "É") + " y", None, 0), (101, "SHORT one and a Short ONE", None, 0), (102, items[5][1], None, 0), (103, " ".join(base) + " short one " + " ".join(base), None, 0), (104, " ".join(f"item{i} é{i}" for i in range(8)), None, 0)]
    rng.shuffle(rows)
    whole = df.unionByName(spark.createDataFrame(rows, SCHEMA))

    windows = {(tuple(w[k : k + 13]), i) for i, t in items for w in [WORD.findall(lowered(t))] if w for k in range(max(1, len(w) - 12))}
    for r in decontaminate.report(whole, benchmark).collect():
        text = next(t for i, t, *_ in [*documents(spark, 40)[0], *rows] if i == r["doc_id"])
        words, hit, ids = WORD.findall(lowered(text)), set(), set()
        for w, i in windows:
            for p in range(len(words) - len(w) + 1):
                if tuple(words[p : p + len(w)]) == w:
                    hit |= set(range(p, p + len(w)))
                    ids.add(str(i))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(words), len(hit), len(ids), sha), r
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words))
    kept = decontaminate.drop_contaminated(whole.withColumnRenamed("n_chars", "n_hit"), benchmark)
    assert kept.columns == ["doc_id", "text", "source", "n_hit"]
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] and r["doc_id"] >= 100} == {103, 104}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(whole, benchmark).collect()}
    assert cut[101] == "and a " and cut[102] == "" and cut[103].split() == base + base
    assert decontaminate.report(whole, benchmark.limit(0)).where("contaminated").count() == 0


def test_shards(spark):
    rows, df = documents(spark, 2000)
    got = sharding.shard_documents(df).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert 0.06 < sum(r["grown_shard"] == 8 for r in got) / len(got) < 0.17
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2000]["size"] == 1 and by_id[2000]["text_crc32"] == 0
    leaves = sharding.tree(8)
    heavier = [(a, b, c, 2.0 if c == 0 else w) for a, b, c, w in leaves]
    moved = df.select(sharding.shard_of(df["doc_id"], leaves).alias("x"), sharding.shard_of(df["doc_id"], heavier).alias("y")).where("x != y").collect()
    assert moved and all(r["y"] in (0, 1, 2, 3) for r in moved)
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_empty_texts_of_a_full_source(spark):
    """A source at its limit takes everything twice and nothing more, whatever the hashes of its empty texts."""
    rows = [(i, "" if i % 2 else "w " * 30, "a", 0) for i in range(40)] + [(100 + i, "w " * 900, "b", 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in mixing.mixed_sizes(df).collect()}
    assert all(got[i]["copies"] == 2 for i in range(40)) and max(r["copies"] for r in got.values()) == 2
    assert mixing.mix(df).where("source = 'a'").count() == 80


def test_rows_of_one_id_come_near_the_target(spark):
    """Null ids with unlike texts are drawn apart, and of rows that are alike in id and text as many are taken as fit."""
    rows = [(None, f"w{i} " * 10, "a", i) for i in range(300)] + [(None, "same " * 10, "b", i) for i in range(300)] + [(i, "x " * 10, "c", i) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mixed_sizes(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in got) == 900
    targets = {"a": 6000.0, "b": 2500.0, "c": 5000.0}
    mixed = mixing.mix(df).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_chars").alias("distinct")).collect()
    for r in mixed:
        assert abs(10 * r["n"] - targets[r["source"]]) <= 10 and r["distinct"] == 300 if r["source"] == "a" else abs(10 * r["n"] - targets[r["source"]]) <= 10
    alike = mixing.mixed_sizes(df.where("source = 'b'"), weights=(1,), share=0.37, most=2.0).groupBy("taken").count().collect()
    assert {r["taken"]: r["count"] for r in alike} == {0: 189, 10: 111}


def test_many_windows_in_blocks_and_a_common_word(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(640)] + [(9000, "the"), (None, "nobody asked this short question")]
    rows = [(i, " ".join(rng.choice(("the", "of", f"z{i}")) for _ in range(40)), None, 0) for i in range(60)]
    rows += [(100 + i, f"the {items[i][1]} of", None, 0) for i in range(20)] + [(200, "So nobody asked THIS short question here", None, 0)] + [(7, "the the", None, 0)] * 50
    df, benchmark = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "WINDOW_ROWS", 11_000)
    windows, _ = decontaminate.item_windows(benchmark)
    assert windows.count() > 30_000
    got = decontaminate.report(df, benchmark).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    for i, text, *_ in rows[:60]:
        if i != 7:
            n = text.split().count("the")
            assert (by[i]["n_words"], by[i]["n_hit"], by[i]["n_items"], by[i]["items_sha256"]) == (40, n, int(n > 0), sha(["9000"] if n else []))
    assert all((by[100 + i]["n_hit"], by[100 + i]["items_sha256"]) == (61, sha(sorted([str(i), "9000"]))) for i in range(20))
    assert (by[200]["n_hit"], by[200]["n_items"], by[200]["items_sha256"], by[200]["contaminated"]) == (5, 0, sha([]), True)
    assert sum(r["doc_id"] == 7 and r["n_hit"] == 2 for r in got) == 50


def plain_shard(doc_id, leaves):
    """The descent through region, rack and shard, drawn with hashlib."""
    chosen = leaves
    for level, name in enumerate(("region", "rack", "shard")):
        weights = defaultdict(float)
        for leaf in chosen:
            weights[leaf[level]] += leaf[3]
        draw = lambda c: -math.log((int(hashlib.md5(f"{doc_id}:{name}:{c}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / weights[c]  # noqa: B023, E731
        child = min(sorted(weights), key=draw) if len(weights) > 1 else next(iter(weights))
        chosen = [leaf for leaf in chosen if leaf[level] == child]
    return chosen[0][2]


def test_shards_equal_a_plain_descent(spark):
    rows, df = documents(spark, 500)
    for r in sharding.shard_documents(df).collect():
        own = "" if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"]) == (plain_shard(own, sharding.tree(8)), plain_shard(own, sharding.tree(9)))


def test_slots_of_many_equal_rows(spark):
    df = spark.createDataFrame([(1, "same", "a", 0)] * 3000 + [(None, "x", "a", 0)] * 500 + [(i, str(i), "a", 0) for i in range(50)], SCHEMA).repartition(7)
    slots = defaultdict(list)
    for r in sharding.shard_documents(df).collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 3550 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_items_of_windows_meet_in_blocks(spark, monkeypatch):
    """More links of windows and items than one broadcast holds: the same rows, with windows of one word that all documents have."""
    rows = [(i, " ".join(["common", f"w{i}", "two words"] * (1 + i % 3)), None, 0) for i in range(40)]
    items = [(i, ("Common", "two words", f"w{i} two", "words common")[i % 4]) for i in range(30)] + [(99, None)]
    df, benchmark = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    usual = {tuple(r) for r in decontaminate.report(df, benchmark).collect()}
    assert max(r[3] for r in usual) > 8
    monkeypatch.setattr(decontaminate, "HIT_ROWS", 5)
    assert {tuple(r) for r in decontaminate.report(df, benchmark).collect()} == usual
