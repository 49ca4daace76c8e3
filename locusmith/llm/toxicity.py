"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (of its lower-cased UTF-8 bytes, with marked ends),
hashed into buckets, so an unseen misspelling shares most of them. A window of WINDOW consecutive words has the mean
of its words' vectors, and a linear softmax on it gives the class. A few toxic words drown in the mean of a long text,
so all windows of a text are classified. Training draws the windows of a toxic text around its words of about the
greatest log odds; a second round adds the windows of other texts that the first takes for toxic. Random misspellings
of words of either class go into training. A logistic fit on three margins of the softmax, those of the worst window,
of the mean of the whole text and of the worst single word, makes the score; it is fitted on texts that the model was
not trained on and on toxic ones of them with the worst word misspelled.

The model is fitted on a bounded sample: ``per_class`` labelled rows of each class by hash of the id, without texts of
over ``longest`` characters. Scoring takes every word of every text. As the softmax is linear, scoring needs only what
each n-gram adds to the margin; these numbers are whole multiples of 1 / SCALE, so sums don't depend on their order and
equal texts score the same anywhere. N-grams are hashed for whole Arrow columns in pieces of PIECE bytes, so a word of
any length needs no more than a few bytes of memory for each of its own.

Defined results: a null or wordless text has margins of 0; equal texts score the same; without labels of both classes
the score is the smoothed share of toxic labels; repeated and conflicting labels of an id count as toxic if any is; of
repeated rows of an id the least text is learnt from; other columns pass through untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hash_bits
from .words import blocks

DIM, BUCKET_BITS, SHORTEST, LONGEST, WINDOW = 16, 17, 3, 6, 5
BUCKETS, PIECE, SCALE = 1 << BUCKET_BITS, 1 << 16, 1 << 18
ROUNDS, EPOCHS, RATE, DECAY, BATCH = 2, 10, 0.5, 3e-4, 256
PREDICT_FROM = 0.7
#: Characters that stand for letters in disguised words.
LOOKALIKES = {"a": "@4", "b": "8", "e": "3", "g": "9", "i": "1!", "l": "1|", "o": "0", "s": "$5", "t": "7+"}
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: 0 for what separates words, 1 for marks, which belong to a word between its other characters only, 2 for the rest.
_KIND = np.array([0 if c <= 32 or c == 127 else 1 if c < 128 and not chr(c).isalnum() else 2 for c in range(256)], np.uint8)
_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def bare(token: str) -> str:
    return token.strip(_EDGES)


def split(text: str | None) -> list[str]:
    """The words of a text, as ``words_of`` finds them in bytes."""
    kept = "".join(c if ord(c) > 32 and ord(c) != 127 else " " for c in (text or "").lower())
    return [w for w in map(bare, kept.split(" ")) if w]


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of lower-cased texts with a 0 for whatever separates words and between texts; first and last place of each word."""
    out = np.zeros(len(raw) + len(bounds), np.uint8)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        out[a + i + 1 : b + i + 1] = raw[a:b]
    kind = _KIND[out]
    out[kind == 0] = 0
    mark = np.flatnonzero(np.diff((kind == 1).astype(np.int8), prepend=0, append=0))
    for a, b in zip(mark[::2].tolist(), mark[1::2].tolist(), strict=True):
        if out[a - 1] == 0 or b == len(out) or out[b] == 0:
            out[a:b] = 0
    edges = np.flatnonzero(np.diff((out != 0).astype(np.int8), prepend=0, append=0))
    return out, edges[::2], edges[1::2]


def grams(out: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first place, n, buckets, valid) of the n-grams whose second byte stands at each place, piece by piece.

    An n-gram lies in one word with the 0 before and after it, which mark its ends.
    """
    padded = np.concatenate((out, np.zeros(LONGEST, np.uint8)))
    with np.errstate(over="ignore"):
        for at in range(1, len(out), PIECE):
            n_here = min(PIECE, len(out) - at)
            piece = padded[at - 1 : at + n_here + LONGEST].astype(np.uint32)
            inside = piece != 0
            hashed = piece[:n_here] * _STEP + piece[1 : n_here + 1]
            valid = np.ones(n_here, bool)
            for n in range(3, LONGEST + 1):
                hashed = hashed * _STEP + piece[n - 1 : n_here + n - 1]
                valid = valid & inside[n - 2 : n_here + n - 2]
                if n >= SHORTEST:
                    mixed = (hashed ^ (hashed >> np.uint32(15))) * _SPREAD + np.uint32(n)
                    yield at, n, mixed >> np.uint32(32 - BUCKET_BITS), valid


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, and the index of each word's first."""
    raw = np.frombuffer("\n".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    out, first, _ = words_of(raw, np.array([0, len(raw)]))
    owners, buckets = [], []
    for at, _, found, valid in grams(out):
        where = np.flatnonzero(valid)
        owners.append((np.searchsorted(first, where + at, "right") - 1).astype(np.int32))
        buckets.append(found[where].astype(np.int32))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def text_margins(texts: pa.Array, margins: np.ndarray) -> np.ndarray:
    """Margins of each text in units of 1 / SCALE: of its worst window, of the mean of its words, of its worst word."""
    out = np.zeros((len(texts), 3))
    for a, b, raw, bounds in blocks(pc.utf8_lower(texts)):
        data, first, last = words_of(raw, bounds)
        if not len(first):
            continue
        sums, counts = np.zeros(len(data), np.int32), np.zeros(len(data), np.uint8)
        for at, _, found, valid in grams(data):
            here = slice(at, at + len(found))
            sums[here] += np.where(valid, margins[found], 0)
            counts[here] += valid
        words = np.add.reduceat(sums, first, dtype=np.int64) // np.add.reduceat(counts, first, dtype=np.int64)
        bounds = np.searchsorted(first, bounds + np.arange(len(bounds)))
        total = np.concatenate(([0], np.cumsum(words)))
        for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), a):
            if y > x:
                n = min(WINDOW, y - x)
                windows = total[x + n : y + 1] - total[x : y - n + 1]
                out[i] = windows.max() / WINDOW, (total[y] - total[x]) / (y - x), words[x:y].max()
    return out


class Model:
    """Embeddings and softmax; ``margins`` has what each bucket adds to the toxic class's logit over the other's."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
        self.output, self.bias = np.zeros((DIM, 2)), np.array([2.0, -2.0])
        #: Weights of the three margins of a text and of a constant.
        self.weights = np.array([0.0, 0.0, 0.0, 0.0])
        self._squares = [np.full(x.shape, 1e-4) for x in (self.embedding, self.output, self.bias)]

    @property
    def margins(self) -> np.ndarray:
        return np.rint((self.embedding @ (self.output[:, 1] - self.output[:, 0])) * SCALE).clip(-(1 << 28), 1 << 28).astype(np.int32)

    def fit(self, windows: list[list[str]], labels: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS) -> None:
        """Adagrad over minibatches; gradients flow to the softmax and to all n-gram vectors at once."""
        known = {w: i for i, w in enumerate(dict.fromkeys(w for own in windows for w in own))}
        flat, first = word_grams(list(known))
        lengths = np.diff(first)
        ids = np.full((len(windows), WINDOW), -1)
        for row, own in enumerate(windows):
            ids[row, : len(own)] = [known[w] for w in own]
        for epoch in range(epochs):
            rate, order = RATE * (1 - epoch / epochs), rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                row_of, column = np.nonzero(ids[rows] >= 0)
                words, inverse = np.unique(ids[rows][row_of, column], return_inverse=True)
                spans = np.concatenate([np.arange(first[w], first[w + 1]) for w in words])
                buckets, owner, n = flat[spans], np.repeat(np.arange(len(words)), lengths[words]), lengths[words][:, None]
                vectors = np.add.reduceat(self.embedding[buckets], np.concatenate(([0], np.cumsum(lengths[words])[:-1]))) / n
                hidden = np.zeros((len(rows), DIM))
                np.add.at(hidden, row_of, vectors[inverse] / WINDOW)
                logits = hidden @ self.output + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), labels[rows]] -= 1
                back = p @ self.output.T / WINDOW
                of_word = np.zeros((len(words), DIM))
                np.add.at(of_word, inverse, back[row_of])
                order_of = np.argsort(buckets, kind="stable")
                begins = np.flatnonzero(np.diff(buckets[order_of], prepend=-1))
                touched = buckets[order_of][begins]
                gradient = DECAY * self.embedding[touched] + np.add.reduceat((of_word / n)[owner[order_of]], begins)
                self._squares[0][touched] += gradient**2
                self.embedding[touched] -= rate * gradient / np.sqrt(self._squares[0][touched])
                for value, square, g in ((self.output, self._squares[1], hidden.T @ p), (self.bias, self._squares[2], p.sum(axis=0))):
                    square += g**2
                    value -= rate * g / np.sqrt(square)

    def calibrate(self, found: np.ndarray, labels: np.ndarray) -> None:
        """Newton's method with halved steps for a logistic fit on the three margins, with a weak prior on their weights."""
        mean, spread = found.mean(axis=0), found.std(axis=0) + 1e-9
        x = np.column_stack([(found - mean) / spread, np.ones(len(found))])
        w, prior = np.zeros(4), np.array([0.05, 0.05, 0.05, 1e-3])

        def loss(v: np.ndarray) -> float:
            z = x @ v
            return float(np.sum(np.logaddexp(0, z) - labels * z) + 0.5 * np.sum(prior * v * v))

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(prior), x.T @ (p - labels) + prior * w)
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = np.append(w[:3] / spread, w[3] - np.sum(w[:3] * mean / spread))


def misspelled(word: str, rng: np.random.Generator) -> str:
    """One or two random edits: a swap, a doubled, lost or foreign letter, or a look-alike."""
    for _ in range(int(rng.integers(1, 3))):
        if len(word) < 4:
            return word
        i, kind = int(rng.integers(0, len(word) - 1)), int(rng.integers(0, 5))
        if kind == 0:
            word = word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        elif kind == 1:
            word = word[: i + 1] + word[i:]
        elif kind == 2:
            word = word[:i] + word[i + 1 :]
        elif kind == 3:
            word = word[:i] + chr(97 + int(rng.integers(0, 26))) + word[i + 1 :]
        else:
            options = LOOKALIKES.get(word[i], word[i])
            word = word[:i] + options[int(rng.integers(0, len(options)))] + word[i + 1 :]
    return word


def train(texts: list[str], labels: np.ndarray, seed: int = 1) -> Model:
    """Fits the model on three of every four texts, and the score on the fourth."""
    rng = np.random.default_rng(seed)
    docs = [split(t) for t in texts]
    held = np.arange(len(docs)) % 4 == 3
    toxic = [d for d, y, h in zip(docs, labels, held, strict=True) if y == 1 and d and not h]
    clean = [d for d, y, h in zip(docs, labels, held, strict=True) if y == 0 and d and not h]
    model = Model(seed)
    if not toxic or not clean:
        share = (float(np.sum(labels)) + 1) / (len(labels) + 2)
        model.weights[3] = np.log(share / (1 - share))
        return model
    in_toxic, in_clean = (Counter(w for d in group for w in set(d)) for group in (toxic, clean))
    odds = {w: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((in_clean[w] + 0.5) / (len(clean) + 1)) for w, n in in_toxic.items()}

    def cut(doc: list[str], i: int) -> list[str]:
        start = max(0, min(i, len(doc) - WINDOW))
        return doc[start : start + WINDOW]

    telling = []
    for d in toxic:
        values = np.array([odds[w] for w in d])
        telling.append(np.flatnonzero(values >= values.max() - 1))
    hardest: list[list[str]] = []
    for turn in range(ROUNDS):
        windows, ys = [], []
        for d, places in zip(toxic, telling, strict=True):
            for _ in range(4):
                peak = int(rng.choice(places))
                own = cut(d, peak - int(rng.integers(0, WINDOW)))
                windows.append(own if rng.random() < 0.5 else [misspelled(w, rng) if w == d[peak] or rng.random() < 0.1 else w for w in own])
                ys.append(1)
        for d in clean:
            for _ in range(max(4, 12 * len(toxic) // len(clean))):
                own = cut(d, int(rng.integers(0, len(d))))
                windows.append(own if rng.random() < 0.5 else [misspelled(w, rng) if rng.random() < 0.3 else w for w in own])
                ys.append(0)
        windows += hardest
        ys += [0] * len(hardest)
        model.fit(windows, np.array(ys), rng)
        if turn + 1 < ROUNDS:
            for d, values in zip(clean, _word_margins(clean, model.margins), strict=True):
                n = min(WINDOW, len(d))
                for i in np.argsort(-np.convolve(values, np.ones(n), "valid"))[:3]:
                    hardest += [d[i : i + WINDOW]] * 2
    everything = not held.any() or len({*labels[held]}) < 2
    chosen = [i for i in range(len(docs)) if held[i] or everything]
    damaged = [i for i in chosen if labels[i] == 1 and docs[i]]
    shown = [texts[i] for i in chosen]
    for i, values in zip(damaged, _word_margins([docs[i] for i in damaged], model.margins), strict=True):
        d, peak = docs[i], int(np.argmax(values))
        shown.append(" ".join([*d[:peak], misspelled(d[peak], rng), *d[peak + 1 :]]))
    model.calibrate(text_margins(pa.array(shown, pa.string()), model.margins) / SCALE, labels[[*chosen, *damaged]].astype(float))
    return model


def _word_margins(docs: list[list[str]], margins: np.ndarray) -> list[np.ndarray]:
    """The margin of each word of each document."""
    known = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    if not known:
        return [np.zeros(0) for _ in docs]
    flat, first = word_grams(list(known))
    values = np.add.reduceat(margins[flat].astype(np.int64), first[:-1]) / np.diff(first) / SCALE
    return [values[[known[w] for w in d]] if d else np.zeros(0) for d in docs]


def held_out(doc_id: Column) -> Column:
    """Rows that labels are not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 50_000) -> Model:
    """Fits a model on a bounded sample of labelled rows; only those rows and texts reach the driver."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ordered = usable.withColumn("at", hash_bits(F.col("doc_id"), 15))
    sample = ordered.where("toxic = 1").orderBy("at", "doc_id").limit(per_class).union(ordered.where("toxic = 0").orderBy("at", "doc_id").limit(per_class))
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.length("text").between(1, longest))
    rows = found.groupBy("doc_id", "at", "toxic").agg(F.min("text").alias("text")).orderBy("at", "doc_id").select("text", "toxic").collect()
    return train([r["text"] for r in rows], np.array([int(r["toxic"]) for r in rows], dtype=int))


def scorer(docs: DataFrame, model: Model):
    """A column function: the score of a text."""
    held = docs.sparkSession.sparkContext.broadcast((model.margins, model.weights))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        margins, weights = held.value
        for texts in batches:
            found = text_margins(pa.array(texts, pa.large_string()), margins) / SCALE
            z = found[:, 0] * weights[0] + found[:, 1] * weights[1] + found[:, 2] * weights[2] + weights[3]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))), dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: whether its label was held out, its score from 0 to 1, and the prediction."""
    score = scorer(docs, learn(docs, labels, **options))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of ``docs``."""
    columns, (name,) = docs.columns, fresh(docs, "_score")
    score = scorer(docs, learn(docs, labels, **options))
    return docs.withColumn(name, score("text")).where(F.col(name) < PREDICT_FROM).select(*columns)
