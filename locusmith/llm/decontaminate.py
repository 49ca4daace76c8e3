"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the word windows of every document.

Words are runs of 0-9, a-z and anything beyond ASCII, once A-Z are lower-cased. An item gives a window for each 13
consecutive words, or one window if it has fewer. One scan of the documents hashes the window at every word, looks it
up in the broadcast hashes of the benchmark's windows, and verifies what it finds word by word; it also counts words.
Nothing but a row for each document and one for each verified hit leaves the scan. Hit words are the union of a
document's hits.

Windows are broadcast in blocks of up to WINDOW_ROWS rows and WINDOW_BYTES bytes, counted before; a benchmark of more
blocks is scanned for block by block, so documents' positions are never shuffled, and no word or window can be a hot
key. The items of the windows meet the documents that hold these in the same way, in blocks of HIT_ROWS.

Defined results: a null or wordless text has no words and no hits; null and wordless items have no windows; an item
without an id hits words but isn't named; equal items with different ids all count; rows with equal id and text get
the same result each; a null id is an id of its own; empty tables give no hits; other columns pass through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

WINDOW = 13
#: Rows and bytes of a block of windows that is broadcast; rows of hit documents up to which these are.
WINDOW_ROWS, WINDOW_BYTES, HIT_ROWS = 500_000, 1 << 27, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, and words, before A-Z are lower-cased.
GAPS, WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """The lower-cased words; the first and the last part may be empty, where the text doesn't begin or end with a word."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS)


def count_words(parts: Column) -> Column:
    empty = (F.element_at(parts, 1) == "").cast("long") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return (F.size(parts) - empty).cast("long")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, words): the different windows with a number each; (window, item): the items that hold them. Both checkpointed."""
    items = benchmark.select("item_id", F.filter(split_words(F.col("text")), lambda w: w != "").alias("all")).where(F.size("all") > 0)
    starts = items.select("item_id", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))).alias("start"))
    held = starts.select(F.col("item_id").cast("string").alias("item"), F.slice("all", F.col("start"), F.lit(window)).alias("words")).distinct()
    windows = checkpoint(held.select("words").distinct().withColumn("window", F.monotonically_increasing_id()))
    return windows, checkpoint(held.where("item IS NOT NULL").join(windows, "words").select("window", "item"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, digest, n_words, start, n, window): a row for each document, with start 0, and one for each place where a
    window occurs; places count words and empty first parts from 1. Checkpointed."""
    held = windows.select("window", "words", F.size("words").alias("n"), F.xxhash64("words").alias("key"))
    size = held.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.array_join("words", " ")) + 64).alias("bytes"), F.collect_set("n").alias("lengths")).first()
    n_blocks = max(1, -(-size["rows"] // WINDOW_ROWS), -(-(size["bytes"] or 0) // WINDOW_BYTES))
    parts = docs.select("doc_id", F.xxhash64("text").alias("digest"), split_words(F.col("text")).alias("parts")).withColumn("n_words", count_words(F.col("parts")))

    lengths = sorted(size["lengths"]) or [WINDOW]

    def scanned(block: int) -> DataFrame:
        own = held.where(F.pmod("window", F.lit(n_blocks)) == block) if n_blocks > 1 else held
        # The first block also keeps start 0, at one length, for the document itself.
        at = parts.withColumn("start", F.explode(F.sequence(F.lit(min(block, 1)), F.size("parts"))))
        at = at.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths])))
        at = at.where(F.when(F.col("start") == 0, F.col("length") == lengths[0]).otherwise(F.col("start") + F.col("length") <= F.size("parts") + 1))
        words = F.slice("parts", F.greatest("start", F.lit(1)), F.col("length"))
        found = at.withColumn("key", F.when(F.col("start") > 0, F.xxhash64(words))).join(F.broadcast(own), "key", "left")
        return found.where((F.col("start") == 0) | (words == F.col("words"))).select("doc_id", "digest", "n_words", "start", "n", "window")

    return checkpoint(reduce(DataFrame.unionByName, [scanned(k) for k in range(n_blocks)]))


def per_document(found: DataFrame, links: DataFrame) -> DataFrame:
    """Hit words and items of the documents that have any; grouped by document, so a group is at most a document long."""
    own = found.where("start > 0")
    spans = own.groupBy("doc_id", "digest").agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    held = own.select("doc_id", "digest", "window").distinct()
    n_blocks = max(1, -(-links.count() // HIT_ROWS))
    block = F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks))
    named = reduce(DataFrame.unionByName, [held.join(F.broadcast(links.where(block == k) if n_blocks > 1 else links), "window") for k in range(n_blocks)])
    named = named.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"].cast("long") + span["n"]
        return F.struct((state["hit"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(span["start"].cast("long"), state["upto"]))).alias("hit"), F.greatest(state["upto"], end).alias("upto"))

    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    both = spans.alias("a").join(named.alias("b"), same, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select("a.doc_id", "a.digest", "n_words", "spans", F.aggregate("spans", zero, add)["hit"].alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, hit words and items, and whether a twentieth of its words is hit."""
    windows, links = item_windows(benchmark, window)
    found = hits(docs, windows)
    hit = checkpoint(per_document(found, links).select("doc_id", "digest", "n_hit", "n_items", "items_sha256"))
    hit = F.broadcast(hit) if hit.count() <= HIT_ROWS else hit
    both = found.where("start = 0").alias("a").join(hit.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        "a.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def _with_hits(docs: DataFrame, found: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Joins what ``keep`` names of the few documents with hits to ``docs``, under names that are free there."""
    names = fresh(docs, "_id", "_digest", *(f"_{k}" for k in keep))
    small = checkpoint(found.select(F.col("doc_id").alias(names[0]), F.col("digest").alias(names[1]), *(F.col(k).alias(n) for k, n in zip(keep, names[2:], strict=True))))
    small = F.broadcast(small) if small.count() <= HIT_ROWS else small
    return docs.join(small, docs["doc_id"].eqNullSafe(small[names[0]]) & (F.xxhash64(docs["text"]) == small[names[1]]), "left"), names


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with the columns of ``docs``."""
    columns = docs.columns
    windows, links = item_windows(benchmark, window)
    found = per_document(hits(docs, windows), links).where(contaminated(F.col("n_hit"), F.col("n_words")))
    marked, names = _with_hits(docs, found.select("doc_id", "digest", "n_hit"), ["n_hit"])
    return marked.where(F.col(names[2]).isNull()).select(*columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, without the hit words and what stands between a hit word and the next word."""
    columns = docs.columns
    windows, links = item_windows(benchmark, window)
    marked, names = _with_hits(docs, per_document(hits(docs, windows), links).select("doc_id", "digest", "spans"), ["spans"])
    spans = F.col(names[2])
    lead = F.regexp_extract("text", "^" + GAPS, 0)
    shift = F.when(lead == "", F.lit(0)).otherwise(F.lit(1))
    tokens = F.regexp_extract_all("text", F.lit(f"{WORDS}(?:{GAPS})?"), 0)
    left = F.filter(tokens, lambda t, i: ~F.exists(spans, lambda s: (i + 1 + shift >= s["start"]) & (i + 1 + shift < s["start"] + s["n"])))
    text = F.when(spans.isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(left, "")))
    return marked.withColumn("text", text).select(*columns)


SQL_FLAGS = r"""
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 12], ' ') AS window_text, least(len(w), 13) AS n FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
words AS (
  SELECT {keys}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
places AS (SELECT {keys}, w, unnest(range(1, len(w) + 1)) AS p FROM words),
runs AS (SELECT {keys}, p, n, array_to_string(w[p : p + n - 1], ' ') AS window_text FROM places CROSS JOIN lengths WHERE p + n - 1 <= len(w)),
found AS (SELECT {keys}, p, r.n, item_id FROM runs r JOIN windows USING (window_text, n)),
hit AS (SELECT {keys}, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT {keys}, unnest(range(p, p + n)) AS q FROM found) GROUP BY {keys}),
named AS (
  SELECT {keys}, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT {keys}, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY {keys}),
flags AS (
  SELECT {keys}, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
         sha256(coalesce(ids, '')) AS items_sha256,
         coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM words LEFT JOIN hit USING ({keys}) LEFT JOIN named USING ({keys}))
"""
SQL = "WITH " + SQL_FLAGS.format(docs="documents", keys="doc_id") + "SELECT * FROM flags"
