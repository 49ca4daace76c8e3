"""Filter interaction audit: what each of five filters removes in every order, with duplicates found in radix tries.

A: under 50 words; B: under 65 distinct words in a hundred; C: over 5 letters A-Z in a hundred code points; D: holds any
of ``#$%&*|``; E: the text is that of a smaller doc_id. Words are maximal runs without ASCII white space.

Duplicates. Texts are dealt to ranges whose borders are the shortest prefixes that part neighbours of a sorted draw of
texts, so borders are as long as the texts around them are alike. Every task first enters its texts into a compressed
trie with the least id at each terminal, and hands on each different text once: a text that a third of all rows have
is one row a task. The tries of the ranges merge these, and their traversal yields the least id of each text with the
text's digest. A row fails E unless its (id, digest) is among them. Texts cross the network once, all else is narrow.

A document's outcome is a mask of five bits; masks are counted by part, and all orders follow from the counts.

Nulls and the like: a null text is empty, a null source is the part '' and joins the empty one. A null doc_id is neither
smaller nor larger than another, so such a row never fails E. Repeated rows count each, and rows of the least doc_id
don't fail E. A doc_id has quality or toxic 1 if any of its labels has; ids without labels have neither. An empty table
has no parts and gives no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Characters of texts that a task's trie holds before it is handed on.
HELD = 16_000_000
#: Characters of a drawn text that are read first for borders; more where drawn texts agree on these.
DEPTH = 256
#: Ranges of texts at most; the driver draws four texts a range.
MOST_RANGES = 1 << 16


class Trie:
    """A radix trie of texts: edges hold runs of characters, terminals the least id of their text."""

    __slots__ = ("chars", "root")

    def __init__(self) -> None:
        self.root: list = [{}, None]
        self.chars = 0

    def insert(self, text: str, key) -> None:
        node, at = self.root, 0
        while at < len(text):
            edge = node[0].get(text[at])
            if edge is None:
                node[0][text[at]] = edge = [text[at:], [{}, None]]
                self.chars += len(text) - at
                node = edge[1]
                break
            label = edge[0]
            if not text.startswith(label, at):
                alike = _alike(label, text, at)
                edge[0], edge[1] = label[:alike], [{label[alike]: [label[alike:], edge[1]]}, None]
                at += alike
            else:
                at += len(label)
            node = edge[1]
        node[1] = key if node[1] is None else min(node[1], key)

    def texts(self) -> Iterator[tuple[str, object]]:
        """Every text with its least id."""
        todo = [("", self.root)]
        while todo:
            text, node = todo.pop()
            if node[1] is not None:
                yield text, node[1]
            todo.extend((text + label, child) for label, child in node[0].values())

    def digests(self) -> Iterator[tuple[str, object]]:
        """The md5 of every text with its least id; what texts share is hashed once."""
        todo = [(hashlib.md5(usedforsecurity=False), self.root)]
        while todo:
            state, node = todo.pop()
            if node[1] is not None:
                yield state.hexdigest(), node[1]
            for label, child in node[0].values():
                below = state.copy()
                below.update(label.encode())
                todo.append((below, child))


def _alike(label: str, text: str, at: int) -> int:
    """How many first characters of ``label`` the text has at ``at``."""
    low, high = 0, len(label)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def borders(texts: DataFrame, column: str, ranges: int) -> list[str]:
    """Ascending prefixes that cut the different texts into about ``ranges`` equal ranges; the same in every run.

    The text of the least hash of every residue class is drawn, so copies don't weigh and all rows count; only the
    balance of the ranges depends on the draw.
    """
    place = F.xxhash64(column)
    hashed = texts.select(place.alias("h"), F.col(column).alias("t"))
    read = lambda depth: F.struct("h", F.substring("t", 1, depth).alias("t"), (F.length("t") > depth).alias("more"))
    drawn = hashed.groupBy(F.pmod("h", F.lit(4 * ranges)).alias("class")).agg(F.min(read(DEPTH)).alias("d")).select("d.*").collect()
    known, depth = {r["h"]: (r["t"], r["more"]) for r in drawn}, DEPTH
    while True:
        seen: dict[str, int] = {}
        for text, _ in known.values():
            seen[text] = seen.get(text, 0) + 1
        tied = [h for h, (text, more) in known.items() if more and seen[text] > 1]
        if not tied:
            break
        depth *= 8
        wanted = F.broadcast(texts.sparkSession.createDataFrame([(h,) for h in tied], "h long"))
        deeper = hashed.join(wanted, "h", "left_semi").select(read(depth).alias("d")).groupBy("d.h").agg(F.min("d").alias("d")).select("d.*")
        known |= {r["h"]: (r["t"], r["more"]) for r in deeper.collect()}
    ordered = sorted({text for text, _ in known.values()})
    out = []
    for i in range(4, len(ordered), 4):
        before, text = ordered[i - 1], ordered[i]
        out.append(text[: _alike(before, text, 0) + 1])
    return out


def least_ids(docs: DataFrame, key: str, column: str, ranges: int | None = None) -> DataFrame:
    """(key, digest): the least id of every different text, with the text's md5; ids and texts must not be null."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = borders(docs, column, min(ranges or 4 * parts, MOST_RANGES))
    kind = docs.schema[key].dataType.simpleString()
    parts = min(parts, len(cuts) + 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()

        def handed() -> Iterator[pa.RecordBatch]:
            rows, chars = [], 0
            for text, least in trie.texts():
                rows.append((bisect_right(cuts, text), least, text))
                chars += len(text)
                if len(rows) == 1000 or chars > HELD // 4:
                    yield batch(rows)
                    rows, chars = [], 0
            yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            own = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], ids), pa.array([r[2] for r in rows], pa.string())]
            return pa.RecordBatch.from_arrays(own, names=["range", "least", "text"])

        for given in batches:
            ids = given.column(0).type
            for least, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                trie.insert(text, least)
            if trie.chars > HELD:
                yield from handed()
                trie = Trie()
        if trie.chars or trie.root[1] is not None:
            yield from handed()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = Trie(), None

        def found() -> Iterator[pa.RecordBatch]:
            rows = list(trie.digests())
            for i in range(0, len(rows), 10_000):
                some = rows[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in some], ids), pa.array([r[0] for r in some], pa.string())], names=[key, "digest"])

        for given in batches:
            ids = given.column(1).type
            for place, least, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), given.column(2).to_pylist(), strict=True):
                if place != now and now is not None:
                    yield from found()
                    trie = Trie()
                now = place
                trie.insert(text, least)
        if now is not None:
            yield from found()

    dealt = docs.select(key, column).mapInArrow(local, f"range int, least {kind}, text string")
    own = F.floor(F.col("range") * F.lit(parts).cast("long") / (len(cuts) + 1)).cast("int")
    return dealt.repartitionById(parts, own).sortWithinPartitions("range").mapInArrow(merged, f"`{key}` {kind}, digest string")


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    bit = lambda letter, failed: F.when(failed, 1 << FILTERS.index(letter)).otherwise(0)
    counted = F.transform(F.array(words), lambda w: bit("A", F.size(w) < 50) + bit("B", F.size(F.array_distinct(w)) * 100 < F.size(w) * 65))
    return (F.get(counted, F.lit(0)) + bit("C", F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5) + bit("D", text.rlike(r"[#$%&*|]"))).cast("int")


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail."""
    text = F.coalesce("text", F.lit(""))
    kept = least_ids(docs.where("doc_id IS NOT NULL").select("doc_id", text.alias("text")), "doc_id", "text").withColumn("least", F.lit(True))
    marked = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    narrow = docs.select("doc_id", F.md5(text).alias("digest"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"))
    # Counted first, so that a row which is repeated without end is one row to join.
    rows = narrow.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(kept, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
    duplicate = F.when(F.col("doc_id").isNotNull() & F.col("least").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return joined.groupBy("part", (F.col("mask") + duplicate).alias("mask")).agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of all 120 orders, for every part.

    A filter's figures depend on the set of filters before it alone, so each part has 80 of them, which the orders pick
    from; ``shapley`` weighs a set by the orders that begin with it.
    """
    bits = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    sets = [(own, before) for own in bits.values() for before in range(32) if not before & own]
    weight = lambda before: math.factorial(before.bit_count()) * math.factorial(4 - before.bit_count())
    cases = F.array(*[F.struct(F.lit(own).alias("own"), F.lit(before).alias("before"), F.lit(weight(before)).alias("weight")) for own, before in sets])
    each = outcomes(docs, labels).withColumn("c", F.explode(cases)).select("part", "mask", "n", "good", "toxic", "c.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda test, value="n": F.sum(F.when(test, F.col(value)).otherwise(0))
    figures = each.groupBy("part", "own", "before", "weight").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    entry = F.struct((F.col("own") * 32 + F.col("before")).alias("k"), F.struct(*names).alias("v"))
    share = F.struct("own", (F.col("removed") * F.col("weight")).alias("s"))
    parts = figures.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("figures"), F.collect_list(share).alias("shares"))
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            steps.append(("".join(order), step, bits[letter], before))
            before |= bits[letter]
    # One literal of text, as thousands of literal columns would be slow to plan.
    plain = F.split(F.lit(";".join(":".join(map(str, s)) for s in steps)), ";")
    rows = parts.withColumn("s", F.explode(plain)).withColumn("s", F.split("s", ":"))
    rows = rows.select("part", "figures", "shares", F.col("s")[0].alias("filter_order"), F.col("s")[1].cast("int").alias("step"), F.col("s")[2].cast("int").alias("own"), F.col("s")[3].cast("int").alias("before"))
    shapley = F.aggregate(F.filter("shares", lambda x: x["own"] == F.col("own")), F.lit(0).cast("long"), lambda s, x: s + x["s"])
    figure = F.element_at("figures", F.col("own") * 32 + F.col("before"))
    return rows.select("part", "filter_order", "step", *[figure[n].alias(n) for n in names], shapley.alias("shapley"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(words) < 50 WHEN 'B' THEN 100 * len(list_distinct(words)) < 65 * len(words)
    WHEN 'C' THEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) WHEN 'D' THEN regexp_matches(text, '[#$%&*|]') ELSE coalesce(w.doc_id > least, false) END) AS failed
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM x a, x b, x c, x e, x g WHERE a.x NOT IN (b.x, c.x, e.x, g.x) AND b.x NOT IN (c.x, e.x, g.x) AND c.x NOT IN (e.x, g.x) AND e.x <> g.x),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, failed, list_contains(failed, own) AS fails, list_has_any(failed, before) AS earlier FROM m, s),
t AS (SELECT part, filter_order, step, own, cast(sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS bigint) AS kept, cast(sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS bigint) AS removed,
  cast(sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS bigint) AS redundant, cast(sum(CASE WHEN failed = [own] THEN n ELSE 0 END) AS bigint) AS unique_fails,
  cast(sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS bigint) AS good_lost, cast(sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS bigint) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) OVER (PARTITION BY part, own) AS bigint) AS shapley FROM t"""
