import itertools
import math
import random
from collections import Counter

import pytest

from locusmith.llm import neardup
from locusmith.llm.words import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_classes(rows, threshold=0.8, rarest=neardup.RAREST):
    """Classes by all pairs of whole texts under TF-IDF with exact document frequencies of words, in plain Python."""
    grams, words = {}, {i: tokens(text) for i, text in rows}
    for i, own in words.items():
        n = min(5, len(own))
        if own:
            grams[i] = Counter(tuple(own[k : k + n]) for k in range(len(own) - n + 1))
    df = Counter(w for own in words.values() for w in set(own))
    idf = {w: 1 - math.log(max(n / len(rows), rarest)) for w, n in df.items()}

    def weight(g, tf):
        return tf * sum(idf[w] for w in g) / len(g)

    weighted = {i: {g: weight(g, tf) for g, tf in c.items()} for i, c in grams.items()}
    total = {i: sum(w.values()) for i, w in weighted.items()}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = {}
    for i, w in weighted.items():
        for g in w:
            inverted.setdefault(g, []).append(i)
    pairs = {p for ids in inverted.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = sum(min(w, weighted[b][g]) for g, w in weighted[a].items() if g in weighted[b])
        if both / (total[a] + total[b] - both) >= threshold - 1e-9:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i, _ in rows}


def corpus(n_groups, seed=3, copies=4):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 40, 200, 350, 420, 900)))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 60)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own).title() + rng.choice(("", ".", "!")))
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    return {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}


def test_equals_brute_force(spark):
    rows = corpus(40)
    assert run(spark, rows) == brute_classes(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"c{rng.randrange(5000)}" for _ in range(80))) for i in range(10)]
    assert run(spark, rows) == brute_classes(rows)


def test_bridges_of_a_large_group(spark):
    """Each of 15 texts is like one near copy of the base alone; nearly all bands that it shares with that are the base's."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(1200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 41):
        own = list(base)
        own[i * 25] = f"x{i}"
        rows.append((i, " ".join(own)))
        if i <= 15:
            for k in rng.sample([k for k in range(0, 1200, 10) if k != i * 25], 9):
                own[k] = f"y{i}z{k}"
            rows.append((100 + i, " ".join(own)))
    expected = brute_classes(rows)
    assert set(expected.values()) == {0}
    assert run(spark, rows) == expected


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 7)
    test_bridges_of_a_large_group(spark)


def test_rows_do_not_follow_from_the_size_of_buckets(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in corpus(8, seed=9, copies=8)], SCHEMA)
    rows = {tuple(r) for r in neardup.near_duplicates(df).collect()}
    monkeypatch.setattr(neardup, "SMALL", 2)
    assert {tuple(r) for r in neardup.near_duplicates(df).collect()} == rows


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, None), (3, ""), (4, "..."), (5, "one two"), (6, "One, two!"), (7, long), (8, long + " end"), (9, "a a a a a a"), (9, "a a a a a a")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows] + [(None, "one two", None, None, None)], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}
    kept = neardup.drop_near_duplicates(df.withColumnRenamed("n_chars", "_gone"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "_gone"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 7, 9, None], key=str)


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text stands here")], "doc_id long, text string")
    assert neardup.drop_near_duplicates(df).count() == 3


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.drop_near_duplicates(empty).count() == 0


def test_text_ids(spark):
    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_large_group_around_the_threshold(spark):
    """350 copies of one text, each with up to twice as many changes as the threshold lets pass; all that brute force joins is joined."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 350):
        own = list(base)
        for k in rng.sample(range(2, 198, 5), rng.randrange(1, 9)):
            own[k] = f"x{i}k{k}"
        rows.append((i, " ".join(own)))
    expected = brute_classes(rows)
    got = run(spark, rows)
    joined = [i for i, c in expected.items() if c == 0 and i]
    assert 50 < len(joined) < len(rows) - 1
    assert sum(got[i] == 0 for i in joined) >= 0.98 * len(joined)
    assert all(expected[i] == 0 for i, c in got.items() if c == 0)


def test_similarity_to_the_representative(spark):
    """Links are verified pairs of different texts that connect each class; every text is compared with its class's own."""
    rows = [*corpus(25, seed=21), (9000, None), (9001, "...")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    classes = brute_classes(rows)
    got = {r["doc_id"]: r for r in neardup.represented(df).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == classes
    similar = exact_similarity(rows)
    for i, r in got.items():
        own = similar(i, r["class_id"])
        assert (r["similarity"] is None) == (own is None) and (own is None or math.isclose(r["similarity"], own, abs_tol=0.02)), i
    links = neardup.verified_links(df).collect()
    text_of = {i: r["text_id"] for i, r in got.items()}
    parent = {i: text_of[i] for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v, s in links:
        assert u < v and text_of[u] == u and text_of[v] == v and s >= 0.8 and math.isclose(s, similar(u, v), abs_tol=0.02)
        x, y = sorted((find(u), find(v)))
        parent[y] = x
    assert {i: find(i) for i, _ in rows} == classes


def exact_similarity(rows):
    words = {i: tokens(text) for i, text in rows}
    df = Counter(w for own in words.values() for w in set(own))
    idf = {w: 1 - math.log(max(n / len(rows), neardup.RAREST)) for w, n in df.items()}

    def weighted(own):
        n = min(5, len(own))
        grams = Counter(tuple(own[k : k + n]) for k in range(len(own) - n + 1))
        return {g: tf * sum(idf[w] for w in g) / n for g, tf in grams.items()}

    def similar(a, b):
        if not words[a] or not words[b]:
            return None
        x, y = weighted(words[a]), weighted(words[b])
        both = sum(min(w, y[g]) for g, w in x.items() if g in y)
        return both / (sum(x.values()) + sum(y.values()) - both)

    return similar


def test_hot_buckets_and_hot_texts(spark, monkeypatch):
    """Rows are those of one plan, where more buckets than are broadcast are met in tiers and hot texts are repeated."""
    rng = random.Random(15)
    base = [f"b{rng.randrange(5000)}" for _ in range(150)]
    rows = [*corpus(10, seed=16), (800, " ".join(base))]
    for i in range(60):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((801 + i, " ".join(own)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    usual = {tuple(r) for r in neardup.represented(df).collect()}
    monkeypatch.setattr(neardup, "HOT", 7)
    assert {tuple(r) for r in neardup.represented(df).collect()} == usual
    monkeypatch.setattr(neardup, "HOT", 40)
    monkeypatch.setattr(neardup, "KEYS", 3)
    assert {tuple(r) for r in neardup.represented(df).collect()} == usual


def test_long_texts_near_the_threshold_share_a_band():
    """Pairs of 150 to 10,000 words and a similarity of 0.80 to 0.85 are candidates, in either form of signatures."""
    rng = random.Random(31)
    weights = neardup.Weights(neardup.np.zeros(1 << neardup.WORD_BITS), 1_000_000)
    for n, pairs in ((150, 40), (1_000, 40), (10_000, 12)):
        near = met = 0
        while near < pairs:
            own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = list(own)
            for k in rng.sample(range(n), max(1, round(n * rng.uniform(0.018, 0.022)))):
                other[k] = f"y{rng.randrange(10**6)}"
            (_, _, raw, bounds), *more = list(neardup.blocks(neardup.pa.array([" ".join(own), " ".join(other)])))
            assert not more
            found, weight, first = weights.shingles(raw, bounds)
            a, b = slice(first[0], first[1]), slice(first[1], first[2])
            if not 0.80 <= neardup._alike(found[a], weight[a], found[b], weight[b]) <= 0.85:
                continue
            left, right = neardup.bands(found, weight, first)
            near, met = near + 1, met + bool(set(left) & set(right))
        assert met >= 0.98 * near, (n, met, near)
