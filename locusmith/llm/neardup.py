"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

1. Document frequencies of words. Each task counts the documents that have a word into an array of 2 ** WORD_BITS hashed
   buckets, and the arrays are added up: every word of every document counts, and the table has the same size for any
   corpus. A word's idf is 1 - ln(max(share of the documents that have it, ``rarest``)), so it follows from shares and
   stays the same as a corpus grows. A shingle weighs its count times the mean idf of its words, in LEVELS steps.
2. Signatures. Texts of small total weight get BANDS * ROWS consistent weighted samples over all their shingles. For larger texts the shingles are dealt to
   as many bins by hash, and each bin gives one sample, so that every shingle is evaluated about once (an empty bin
   takes a sample over all shingles). Weights at which either form could meet a similar partner get both. The least value of a sample is its identity: it follows from
   the shingle, the slot and the quantised weight alone.
3. Candidates. Documents of equal words are one text. Texts that agree in all rows of a band share a bucket. Buckets
   of up to SMALL texts give all pairs; a larger one compares all its texts with a leader. Where that leaves more
   than one component in a large bucket, all its pairs of unlike components are compared in blocks (see ``_bridges``).
4. Every candidate pair is verified by the weighted Jaccard similarity of the whole texts; links of at least
   ``threshold`` are joined into components. A document's class is the least id of its component.

Defined results: null and wordless texts are classes of their own by id; texts of under five words are one shingle;
equal words make equal classes; ids are integers (others raise TypeError); rows of equal id are one document, which is a class of its own, never dropped, if
their words differ; ties don't arise, as ids order everything; a null id is left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import checkpoint, fresh, join_small
from .components import components
from .dense import summed
from .words import blocks, distinct, hash_ngrams, hash_words, mix, ngram_means

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 18, 4
SLOTS = BANDS * ROWS
#: Bits of a word's bucket; steps of a shingle's weight; share of all documents below which rarer words weigh no more.
WORD_BITS, LEVELS, RAREST = 20, 255, 1 / 1024
#: Effective number of shingles from which a text is binned, and up to which it is sampled in full.
BINNED_FROM, FULL_TO = 185, 250
#: Texts of a bucket up to which all pairs are compared as rows; elements that are sampled at once.
SMALL, AT_ONCE = 24, 4096
#: Keys of larger buckets up to which these are broadcast; members of a bucket, or pairs of a text, above which a key is hot.
KEYS, HOT = 1_000_000, 10_000
#: Texts and bytes of a block of a larger bucket.
BLOCK_TEXTS, BLOCK_BYTES = 256, 1 << 23
_SEEDS = mix(np.arange(1, 2 * SLOTS + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_UNIT = 1.0 / (1 << 32)


def frequencies(docs: DataFrame) -> np.ndarray:
    """The number of documents that have a word of each bucket; all words of all documents count."""

    def add(counts: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, _, raw, bounds in blocks(batch.column(0)):
            found = distinct(*hash_words(raw, bounds))[0]
            counts += np.bincount((found >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=len(counts))

    return summed(docs.select("text"), add, 1 << WORD_BITS)


class Weights:
    """Shingles and their weights: tf times the mean idf of a shingle's words, in LEVELS steps of the greatest idf.

    The step stands in the lowest bits of the shingle's hash, so equal shingles weigh the same wherever they are met.
    """

    def __init__(self, df: np.ndarray, n_docs: int, rarest: float = RAREST) -> None:
        share = np.maximum(df, 1) / max(n_docs, 1)
        idf = 1 - np.log(np.clip(share, rarest, 1.0))
        self.idf = (idf / (1 - np.log(rarest))).astype(np.float32)

    def shingles(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of each whole text, their weights, and the index of each text's first."""
        return self.of_words(*hash_words(raw, bounds))

    def of_words(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, gram_first = hash_ngrams(hashes, first, SHINGLE)
        idf = self.idf[(hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)].astype(np.float64)
        step = np.maximum(np.rint(ngram_means(idf, first, SHINGLE) * LEVELS), 1).astype(np.uint64)
        found, tf, own_first = distinct(grams & ~np.uint64(LEVELS) | step, gram_first)
        return found, tf * ((found & np.uint64(LEVELS)).astype(np.float64) / LEVELS), own_first


def _sample(found: np.ndarray, log_weight: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The sampled value ln(a) of each element: r and c are Gamma(2, 1), beta is uniform, t quantises the log weight."""
    x = mix(found + seeds)
    y = mix(x + np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64(0xFFFFFFFF)
    r = -np.log((((x >> np.uint64(32)).astype(np.float64) + 0.5) * _UNIT) * (((x & low).astype(np.float64) + 0.5) * _UNIT))
    c = -np.log((((y >> np.uint64(32)).astype(np.float64) + 0.5) * _UNIT) * (((y & low).astype(np.float64) + 0.5) * _UNIT))
    beta = ((x ^ (y >> np.uint64(7))) & low).astype(np.float64) * _UNIT
    t = np.floor(log_weight / r + beta)
    return np.log(c) - r * (t - beta + 1.0)


def _mins(found: np.ndarray, log_weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least value of every slot of texts that are sampled in full."""
    out = np.empty((len(first) - 1, SLOTS))
    at = 0
    while at < len(first) - 1:
        upto = max(at + 1, int(np.searchsorted(first, first[at] + AT_ONCE, "right")) - 1)
        rows = slice(first[at], first[upto])
        out[at:upto] = np.minimum.reduceat(_sample(found[rows, None], log_weight[rows, None], _SEEDS[None, :SLOTS]), first[at:upto] - first[at], axis=0)
        at = upto
    return out


def _binned(found: np.ndarray, log_weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least value of every bin; an empty bin takes that of a sample over all shingles of the text."""
    n = len(first) - 1
    out = np.full(n * SLOTS, np.inf)
    owner = np.repeat(np.arange(n), np.diff(first))
    np.minimum.at(out, owner * SLOTS + (mix(found) % np.uint64(SLOTS)).astype(np.int64), _sample(found, log_weight, _SEEDS[SLOTS]))
    for at in np.flatnonzero(np.isinf(out)):
        rows = slice(first[at // SLOTS], first[at // SLOTS + 1])
        out[at] = _sample(found[rows], log_weight[rows], _SEEDS[SLOTS + 1 + at % SLOTS]).min()
    return out.reshape(n, SLOTS)


def _keys(least: np.ndarray, form: int) -> np.ndarray:
    """Keys of the bands of each text, from the bits of its least values."""
    rows = np.ascontiguousarray(least).view(np.uint64).reshape(len(least), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(form), (len(least), BANDS))
    for k in range(ROWS):
        key = mix(key + rows[:, :, k])
    return key.view(np.int64)


def _gather(first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Element indices of the chosen texts, and the index of each one's first among them."""
    lengths = np.diff(first)[chosen]
    out_first = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
    return np.repeat(first[:-1][chosen] - out_first[:-1], lengths) + np.arange(out_first[-1]), out_first


def bands(found: np.ndarray, weight: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """Keys of the bands of each text: BANDS in either form, twice as many where both forms apply, none without words."""
    out: list[list[int]] = [[] for _ in range(len(first) - 1)]
    total = np.diff(np.concatenate(([0.0], np.cumsum(weight)))[first])
    words = np.diff(first) > 0
    log_weight = np.log(weight)
    with np.errstate(over="ignore"):
        for form, (chosen, least) in enumerate(((words & (total <= FULL_TO), _mins), (words & (total > BINNED_FROM), _binned))):
            chosen = np.flatnonzero(chosen)
            if len(chosen):
                rows, own_first = _gather(first, chosen)
                for i, keys in zip(chosen, _keys(least(found[rows], log_weight[rows], own_first), form).tolist(), strict=True):
                    out[i] += keys
    return out


def signatures(docs: DataFrame, weights) -> DataFrame:
    """(doc_id, words, bands): a hash of the sequence of words, null if there are none, and the keys of the bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = weights.value
        for batch in batches:
            for a, b, raw, bounds in blocks(batch.column(1)):
                hashes, first = hash_words(raw, bounds)
                found, weight, own_first = weigh.of_words(hashes, first)
                words = [xxhash.xxh3_128_digest(hashes[i:j]) if j > i else None for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0).slice(a, b - a), "words": pa.array(words, pa.binary()), "bands": pa.array(bands(found, weight, own_first), pa.list_(pa.int64()))}
                )

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, words binary, bands array<long>")


def _met(members: DataFrame, keyed: DataFrame) -> DataFrame:
    """The members of the checkpointed buckets (key, n and more), with what these hold.

    Up to KEYS buckets are broadcast. Of more, the hot ones are met first and the others, of at most HOT members each,
    by shuffle, so that no task gets a hot bucket.
    """
    if keyed.count() <= KEYS:
        return members.join(F.broadcast(keyed), "key")
    hot = checkpoint(keyed.where(F.col("n") > HOT))
    cold = join_small(members, hot.select("key"), ["key"], "left_anti", limit=KEYS)
    return join_small(members, hot, ["key"], limit=KEYS).unionByName(cold.join(keyed.where(F.col("n") <= HOT), "key"))


def _unmet(members: DataFrame, keyed: DataFrame) -> DataFrame:
    """The members of no bucket of ``keyed``; hot buckets are left out before others are shuffled, as in ``_met``."""
    if keyed.count() <= KEYS:
        return members.join(F.broadcast(keyed.select("key")), "key", "left_anti")
    hot = checkpoint(keyed.where(F.col("n") > HOT).select("key"))
    return join_small(members, hot, ["key"], "left_anti", limit=KEYS).join(keyed.select("key"), "key", "left_anti")


def _sized(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of ids in buckets of up to SMALL members, each set once; the members of larger ones with a leader.

    The leader is the member whose large buckets hold the most texts: the original of many copies is like most of
    them, while two copies have each one's changes between them.
    """
    sized = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = checkpoint(sized.where(F.col("n") > SMALL))
    small = _unmet(members, many).join(sized.where(F.col("n") <= SMALL).select("key"), "key").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    large = checkpoint(_met(members, many).select("key", "id", "n"))
    known = large.groupBy("id").agg(F.sum("n").alias("known"))
    leaders = checkpoint(large.join(known, "id").groupBy("key").agg(F.max_by("id", F.struct("known", F.xxhash64("id"))).alias("leader"), F.first("n").alias("n")))
    return small.select("ids").distinct(), _met(large.select("key", "id"), leaders).select("key", "id", "leader")


def _all_pairs(small: DataFrame) -> DataFrame:
    """Pairs (u < v) in each set."""

    def later(a, i):
        return F.transform(F.slice("ids", i + 2, F.size("ids")), lambda b: F.struct(a.alias("u"), b.alias("v")))

    return small.select(F.explode(F.flatten(F.transform("ids", later))).alias("p")).select("p.*")


def _led(large: DataFrame) -> DataFrame:
    return large.where("id != leader").select(F.least("leader", "id").alias("u"), F.greatest("leader", "id").alias("v"))


def _alike(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts with words, by their sorted shingles and the weights of these."""
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[place] == a
    shared = np.minimum(x[same], y[place[same]]).sum()
    return shared / (x.sum() + y.sum() - shared)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the checkpointed ids."""
    return join_small(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, ["id"], limit=1_000_000)


def _similar(pairs: DataFrame, docs: DataFrame, weights) -> DataFrame:
    """The checkpointed pairs (u, v) with the weighted Jaccard similarity of their whole texts.

    A text of over HOT pairs is repeated once for each HOT of them, which are dealt to the repeats by hash.
    """

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weigh = weights.value
        for left, right in batches:
            out = []
            for at in range(0, len(left), 200):
                both = pa.array([x for pair in zip(left[at : at + 200], right[at : at + 200], strict=True) for x in pair])
                sets = []
                for _, _, raw, bounds in blocks(both):
                    found, weight, first = weigh.shingles(raw, bounds)
                    sets += [(found[i:j], weight[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
                out += [_alike(*left_set, *right_set) for left_set, right_set in zip(sets[::2], sets[1::2], strict=True)]
            yield pd.Series(out, dtype="float64")

    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("u"), F.lit(0).alias("v")), F.struct(F.col("v").alias("id"), F.lit(0).alias("u"), F.lit(1).alias("v")))).alias("e"))
    parts = [F.ceil(F.sum(f"e.{side}") / F.lit(HOT)).cast("int").alias(f"parts_{side}") for side in "uv"]
    ids = checkpoint(ends.groupBy(F.col("e.id").alias("id")).agg(*parts))
    hot = checkpoint(ids.where("parts_u > 1 OR parts_v > 1"))
    texts, met = _texts(docs, ids), pairs
    for side, other, name in (("u", "v", "a"), ("v", "u", "b")):
        own = texts.where(F.col(f"parts_{side}") > 0).select(F.col("id").alias(side), F.col("text").alias(name), F.explode(F.sequence(F.lit(0), F.col(f"parts_{side}") - 1)).alias("part"))
        dealt = join_small(met, hot.select(F.col("id").alias(side), F.greatest(f"parts_{side}", F.lit(1)).alias("parts")), [side], "left")
        met = dealt.withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts").join(own, [side, "part"]).drop("part")
    return met.select("u", "v", alike("a", "b").alias("similarity"))


def _verified(pairs: DataFrame, docs: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs whose whole texts are at least ``threshold`` alike by weighted Jaccard, with that similarity."""
    return _similar(pairs, docs, weights).where(F.col("similarity") >= threshold).dropDuplicates(["u", "v"])


def _bridged(rows: pd.DataFrame, weigh: Weights, threshold: float) -> pd.DataFrame:
    """Links (u < v) with similarities that join the components of a block: each text of its rest against all its members.

    A pair is compared in the least bucket that it shares, and not once the links found here join its components.
    """
    rows = rows.sort_values(["id", "query"], ignore_index=True)
    texts = rows.drop_duplicates("id").reset_index(drop=True)
    found, weight, first = [], [], [np.zeros(1, np.int64)]
    for _, _, raw, bounds in blocks(pa.array(texts["text"], pa.large_string())):
        own, own_weight, own_first = weigh.shingles(raw, bounds)
        found.append(own)
        weight.append(own_weight)
        first.append(own_first[1:] + first[-1][-1])
    found, weight, first = np.concatenate(found), np.concatenate(weight), np.concatenate(first)
    total = np.add.reduceat(weight, first[:-1])
    key, ids = rows["key"].iat[0], texts["id"].to_numpy()
    keys = np.full((len(texts), 2 * BANDS), key)
    for i, own in enumerate(texts["bands"]):
        keys[i, : len(own)] = own
    classes, inverse = np.unique(texts["component"].to_numpy(), return_inverse=True)
    known = pd.Index(ids)
    members = known.get_indexer(rows.loc[~rows["query"], "id"])
    in_rest = texts["rest"].to_numpy()
    links = []
    for r in known.get_indexer(rows.loc[rows["query"], "id"]):
        near = np.minimum(total[members], total[r]) >= (threshold - 1e-9) * np.maximum(total[members], total[r])
        others = members[near & (inverse[members] != inverse[r]) & ~(in_rest[members] & (ids[members] < ids[r]))]
        others = others[~np.isin(keys[others], keys[r][keys[r] < key]).any(axis=1)]
        if not len(others):
            continue
        at, own_first = _gather(first, others)
        mine, my_weight = found[first[r] : first[r + 1]], weight[first[r] : first[r + 1]]
        place = np.minimum(np.searchsorted(mine, found[at]), len(mine) - 1)
        shared = np.where(mine[place] == found[at], np.minimum(my_weight[place], weight[at]), 0.0)
        shared = np.add.reduceat(shared, own_first[:-1])
        for m in others[shared >= (threshold - 1e-9) * (total[others] + total[r] - shared)]:
            if inverse[m] == inverse[r]:
                continue
            u, v = (r, m) if ids[r] < ids[m] else (m, r)
            a, b = slice(first[u], first[u + 1]), slice(first[v], first[v + 1])
            similarity = _alike(found[a], weight[a], found[b], weight[b])
            if similarity >= threshold:
                inverse[inverse == inverse[m]] = inverse[r]
                links.append((int(ids[u]), int(ids[v]), float(similarity)))
    return pd.DataFrame(links, columns=["u", "v", "similarity"]).astype({"u": "int64", "v": "int64", "similarity": "float64"})


def _bridges(large: DataFrame, links: DataFrame, texts: DataFrame, docs: DataFrame, weights, threshold: float) -> DataFrame:
    """Links (u < v) that join all components which verified pairs of the large buckets (key, id) connect.

    The rest of a bucket is what isn't in its most frequent component. Every text of the rest is compared with every
    member of another component, in tasks of one block of the rest and one of the members, dealt by hash. So the rows
    grow with the product of a bucket and its rest only by the size of a block, and no pair is left out.
    """
    label = components(links).select(F.col("node").alias("id"), "component")
    named = checkpoint(large.select("key", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id")))
    counted = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    most = checkpoint(counted.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "most"))
    mixed = checkpoint(join_small(named, most, ["key"]).select("key", "id", "component", (F.col("component") != F.col("most")).alias("rest")))
    if not mixed.count():
        return links.limit(0)
    whole = checkpoint(_texts(docs, checkpoint(mixed.select("id").distinct())).dropDuplicates(["id"]).join(texts.select("id", "bands"), "id"))
    load = F.lit(1 / BLOCK_TEXTS) + F.col("bytes") / BLOCK_BYTES
    loaded = mixed.join(whole.select("id", F.octet_length("text").alias("bytes")), "id")
    blocked = checkpoint(loaded.groupBy("key").agg(F.ceil(F.sum(load)).cast("int").alias("n_members"), F.ceil(F.sum(F.when(F.col("rest"), load))).cast("int").alias("n_rest")))
    placed = join_small(mixed, blocked, ["key"])
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = ["key", "id", "component", "rest"]
    members = placed.select(*columns, F.lit(False).alias("query"), F.explode(every("n_rest")).alias("a"), own(F.col("n_members")).alias("b"))
    queries = placed.where("rest").select(*columns, F.lit(True).alias("query"), own(F.col("n_rest")).alias("a"), F.explode(every("n_members")).alias("b"))

    def bridged(rows: pd.DataFrame) -> pd.DataFrame:
        return _bridged(rows, weights.value, threshold)

    return members.union(queries).join(whole, "id").groupBy("key", "a", "b").applyInPandas(bridged, "u long, v long, similarity double")


def _links(texts: DataFrame, docs: DataFrame, weights, threshold: float) -> DataFrame:
    """Verified links (u < v, similarity) between texts (id, bands), which connect all that verified pairs of a common bucket do."""
    small, large = _sized(texts.select(F.explode("bands").alias("key"), "id"))
    large = checkpoint(large)
    pairs = checkpoint(_all_pairs(small).union(_led(large)).distinct())
    links = checkpoint(_verified(pairs, docs, weights, threshold))
    if not large.count():
        return links
    return checkpoint(links.union(_bridges(large, links, texts, docs, weights, threshold)).dropDuplicates(["u", "v"]))


def _compared(docs: DataFrame, threshold: float, rarest: float) -> tuple:
    """The broadcast weights; (doc_id, words) of the documents; (words, text_id) of the different texts; their links."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id has to be an integer column, not {kind.simpleString()}")
    spark, n_docs = docs.sparkSession, docs.count()
    weights = spark.sparkContext.broadcast(Weights(frequencies(docs), n_docs, rarest))
    signed = signatures(docs, weights).groupBy("doc_id").agg(F.min("words").alias("words"), F.max("words").alias("other"), F.count("words").alias("n_with"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    alone = F.col("words").isNull() | (F.col("words") != F.col("other")) | (F.col("n_with") != F.col("n"))
    signed = checkpoint(signed.select("doc_id", F.when(~alone, F.col("words")).alias("words"), "bands"))
    texts = checkpoint(signed.where("words IS NOT NULL").groupBy("words").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    return weights, signed.select("doc_id", "words"), texts.select("words", F.col("id").alias("text_id")), _links(texts, docs, weights, threshold)


def _classes(texts: DataFrame, links: DataFrame) -> DataFrame:
    """The texts with the component of those that have links."""
    return texts.join(components(links).select(F.col("node").alias("text_id"), "component"), "text_id", "left")


def _members(signed: DataFrame, named: DataFrame, *more: str) -> DataFrame:
    whole = signed.join(named, "words", "left")
    return whole.select("doc_id", F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("component", "text_id", "doc_id").alias("class_id"), *more)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, rarest: float = RAREST) -> DataFrame:
    """One row per distinct doc_id: doc_id, text_id (least id with the same words) and class_id.

    A class_id is the least id of all documents that similar or equal texts connect. Links aren't counted: in large
    buckets only those are sought that join components, so their number would follow from the size of the bucket.
    """
    _, signed, texts, links = _compared(docs, threshold, rarest)
    return _members(signed, _classes(texts, links))


def verified_links(docs: DataFrame, threshold: float = THRESHOLD, rarest: float = RAREST) -> DataFrame:
    """(u, v, similarity), u < v: verified pairs of different texts, named by their text_id, which connect each class.

    Buckets of up to SMALL texts give all their pairs, larger ones those with their leader and those that join what is
    left apart. With the text_id of every document these are the pairs of representatives and the membership.
    """
    return _compared(docs, threshold, rarest)[3]


def represented(docs: DataFrame, threshold: float = THRESHOLD, rarest: float = RAREST) -> DataFrame:
    """``near_duplicates``, and ``similarity``: that of a document's whole text with the text of its class_id.

    This pairs each text with its class's representative, whatever buckets they met in. It is 1 for equal words, null
    for documents that are classes of their own because they have no words or several texts, and may be below
    ``threshold`` where only a chain of links joins the two. What links already verified isn't compared again.
    """
    weights, signed, texts, links = _compared(docs, threshold, rarest)
    named = checkpoint(_classes(texts, links))
    pairs = named.where("component != text_id").select(F.col("component").alias("u"), F.col("text_id").alias("v"))
    known = checkpoint(pairs.join(links, ["u", "v"], "left"))
    others = checkpoint(known.where("similarity IS NULL").select("u", "v"))
    found = known.where("similarity IS NOT NULL")
    if others.count():
        found = found.unionByName(_similar(others, docs, weights).dropDuplicates(["u", "v"]))
    found = found.select(F.col("v").alias("text_id"), "similarity")
    return _members(signed, named.join(found, "text_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(1.0))), "similarity")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that of the least id, with the columns of ``docs``.

    Documents without an id or without words stay; equal rows of one id that has a class give one row.
    """
    columns = docs.columns
    gone = near_duplicates(docs, threshold).where("doc_id != class_id").select("doc_id")
    (name,) = fresh(docs, "_gone")
    gone = checkpoint(gone.withColumnRenamed("doc_id", name))
    gone = F.broadcast(gone) if gone.count() <= 1_000_000 else gone
    left = docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti").select(*columns)
    again = checkpoint(left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(name)))
    if not again.count():
        return left
    again = F.broadcast(again) if again.count() <= 1_000_000 else again
    twice = left.join(again, left["doc_id"] == again[name], "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, left["doc_id"] == again[name], "left_anti").select(*columns).unionByName(twice.select(*columns))
