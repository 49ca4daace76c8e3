"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Unigrams and bigrams of whole texts are hashed into BUCKETS. The raw model counts the n-grams of all documents, the
target model those of documents labelled good; both are smoothed. A document's log weight is the sum over its n-grams
of the log ratio of their probabilities. Adding Gumbel noise (from a hash of the id, so reruns agree) and keeping the
greatest k draws k documents without replacement in proportion to their weights.

The k-th greatest key is found by counting keys in nested ranges (4096 at a time) and refining only the range that
holds it; nothing is sorted. Keys of the last range are numbered by hash ranges.

The target model is fitted on a bounded sample: the ``target_rows`` good labels of the least hashed ids.

Defined results: a null or wordless text has log weight 0; equal texts have equal weights but noise of their own;
without good labels all weights are 0; a null id hashes as the empty key; rows with equal ids share their noise;
exactly ceil(share * rows) rows are selected; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hash_bits
from .dense import summed
from .sharding import with_slots
from .words import blocks, hash_ngrams, hash_words

BUCKETS = 1 << 14
#: Bits of a key, and bits that each level resolves.
BITS, WIDTH = 48, 12


def features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text of each."""
    hashes, first = hash_words(raw, bounds)
    pairs, pair_first = hash_ngrams(hashes, first, 2)
    owners = np.arange(len(bounds) - 1)
    both = np.concatenate((hashes >> np.uint64(20), pairs))
    return (both % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((np.repeat(owners, np.diff(first)), np.repeat(owners, np.diff(pair_first))))


def log_ratio(docs: DataFrame, labels: DataFrame, target_rows: int) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket; all documents count for the raw model."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = good.orderBy(hash_bits(F.col("doc_id"), 15), "doc_id").limit(target_rows).withColumn("good", F.lit(1))
    flagged = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))

    def count(counts: np.ndarray, batch: pa.RecordBatch) -> None:
        good = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, raw, bounds in blocks(batch.column(0)):
            found, owner = features(raw, bounds)
            counts[:BUCKETS] += np.bincount(found, minlength=BUCKETS)
            counts[BUCKETS:] += np.bincount(found[good[a:b][owner] == 1], minlength=BUCKETS)

    total = summed(flagged, count, 2 * BUCKETS)
    raw, target = total[:BUCKETS] + 1.0, total[BUCKETS:] + 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if total[BUCKETS:].any() else np.zeros(BUCKETS)


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Adds ``selected``: true for exactly k rows of the greatest keys; ``rows`` has no nulls or NaN in the key."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.withColumn("selected", F.lit(False))
    scale = ((1 << BITS) - 1) / (high - low) if high > low else 0.0
    ranked = rows.withColumn("_at", F.floor((F.col(key) - low) * scale).cast("long"))
    prefix, need, rest, inside = 0, k, BITS, ranked
    while rest and need:
        rest -= WIDTH
        counts = {r["b"]: r["count"] for r in inside.groupBy(F.shiftright("_at", rest).alias("b")).count().collect()}
        for b in sorted(counts, reverse=True):
            prefix = b
            if counts[b] >= need:
                break
            need -= counts[b]
        inside = ranked.where(F.shiftright("_at", rest) == prefix)
    if not need:
        return ranked.drop("_at").withColumn("selected", F.lit(False))
    edge = F.shiftright("_at", rest)
    clear = ranked.where(edge != prefix).withColumn("selected", edge > prefix)
    last = with_slots(inside.withColumn("_one", F.lit(0)), "_one", "_slot", [key, "doc_id"])
    return clear.unionByName(last.withColumn("selected", F.col("_slot") < need).drop("_one", "_slot")).drop("_at")


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, target_rows: int = 20_000, seed: str = "gumbel") -> DataFrame:
    """One row per document: its log importance weight, its key with Gumbel noise, and whether it is drawn."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels, target_rows))

    @F.pandas_udf("double")
    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of_bucket = ratios.value
        for texts in batches:
            out = []
            for _, _, raw, bounds in blocks(pa.array(texts, pa.string())):
                found, owner = features(raw, bounds)
                out.append(np.bincount(owner, weights=of_bucket[found], minlength=len(bounds) - 1))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    uniform = (hash_bits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 13) + 0.5) / float(1 << 52)
    scored = checkpoint(docs.select("doc_id", weight("text").alias("log_weight")).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    return top_k(scored, "key", ceil(share * scored.count()))
