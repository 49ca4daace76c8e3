"""Tries, borders and the rows of the filter audit against plain Python and the SQL twin."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import pytest

from locusmith.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, n string, part string"


def made(seed=5):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "δ", "#tag", "e", "w1", "w2"]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.3 else f"u{rng.randrange(200)}" for _ in range(rng.randrange(90))) for _ in range(40)]
    texts += ["", None, " \t\n", "same start " * 400 + "a", "same start " * 400 + "b", "same start " * 400, "x" * 50_000, "é" * 300]
    rows = [(i, rng.choice(texts), rng.choice(["s1", "s2", "", None]), "clash", "clash") for i in range(300)]
    rows += [(1000 + i, "hot text", "hot", None, None) for i in range(150)] + [(1000, "hot text", "hot", None, None)] * 5 + [(None, "hot text", "s1", None, None), (7, "another text of seven", "s1", None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1200, 3)] + [(3, 1, 1), (None, 1, 1)]
    return rows, labels


def expected(rows, labels):
    least, good, toxic = {}, set(), set()
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    failed = []
    for i, t, source, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        failed.append((source or "", {x for x in f if f[x]}, i in good, i in toxic))
    out, removed = {}, {}
    for part in {f[0] for f in failed}:
        for order in map("".join, permutations("ABCDE")):
            live = [f[1:] for f in failed if f[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                now = [f for f in live if x in f[0]]
                unique = sum(f[0] == {x} for f in live + gone)
                live = [f for f in live if x not in f[0]]
                out[part, order, step] = (len(live), len(now), sum(x in f[0] for f in gone), unique, sum(f[1] for f in now), sum(f[2] for f in now))
                removed[part, x] = removed.get((part, x), 0) + len(now)
                gone += now
    return sorted((*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_rows(spark):
    rows, labels = made()
    got = fa.audit(spark.createDataFrame(rows, DOCS).repartition(6), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(tuple, got)) == expected(rows, labels)


def test_sql_twin():
    rows, labels = made(6)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    con.execute("CREATE TABLE labels (doc_id bigint, quality int, toxic int)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert sorted(con.execute(fa.SQL).fetchall()) == expected(rows, labels)


def test_trie_keeps_least_ids():
    rng = random.Random(8)
    trie, want = fa.Trie(), {}
    for key in rng.sample(range(10_000), 3000):
        text = "".join(rng.choice("abé") for _ in range(rng.randrange(7))) * rng.randrange(1, 4)
        trie.insert(text, key)
        want[text] = min(want.get(text, key), key)
    assert dict(trie.texts()) == want and len(list(trie.texts())) == len(want)
    assert dict(trie.digests()) == {hashlib.md5(t.encode()).hexdigest(): k for t, k in want.items()}


@pytest.mark.parametrize("held", [50, 10**9])
def test_ranges_and_borders(spark, monkeypatch, held):
    """Texts that differ only after 3,000 characters still part into ranges, and handing tries on early changes nothing."""
    monkeypatch.setattr(fa, "HELD", held)
    rows = [(i, "p" * 3000 + f"{i % 500:03d}") for i in range(2000)] + [(5000 + i, f"q{i % 3}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cuts = fa.borders(docs, "text", 16)
    assert len(cuts) > 8 and cuts == sorted(set(cuts)) and fa.borders(docs.repartition(5), "text", 16) == cuts
    got = {(r["doc_id"], r["digest"]) for r in fa.least_ids(docs, "doc_id", "text", 16).collect()}
    least = {}
    for i, t in rows:
        least[t] = min(least.get(t, i), i)
    assert got == {(i, hashlib.md5(t.encode()).hexdigest()) for t, i in least.items()}


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(spark.createDataFrame([], DOCS), labels).collect() == []
    assert fa.audit(spark.createDataFrame([(1, None, None, None, None)], DOCS), labels).count() == 600
