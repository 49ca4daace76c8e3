"""Language identification by cross-parsing entropy.

Each language's labelled text becomes a suffix automaton, which accepts exactly the substrings of that text. A
document is parsed from left to right into longest matches: the automaton is followed as far as it goes, a phrase
ends there, and the parse starts again at the root. Fewer phrases mean that the document is built from longer pieces
of the language's text. A phrase costs log2(length of the text) for its place there and ``ESCAPE`` bits for its length
and the byte that ends it, so a language with a tiny text, in which every byte is a phrase, isn't cheap; the phrases'
cost by the length of the document estimates the cross entropy, and the language of the least estimate wins (the
first in order if equal).

Texts are sequences of the UTF-8 bytes of their lower-cased letters, with a space for each run of other characters, so
an automaton has at most 256 symbols, those of its language's own sample, whatever the number of letters. The
automata of all languages are one table, and all segments of a batch of documents take their steps together, so
a step is a few numpy operations over all segments and languages. Segments are cut from whole texts at fixed lengths,
which costs each language at most one phrase a segment.

The automata are built from a bounded sample: ``per_language`` distinct ids by hash, ``chars`` characters of each
language, at most a twentieth of them from one document, from a place that the hash of its id gives (of several rows
of an id, the least such part). At most ``most_languages`` are learnt, those with the most labelled rows that have a
letter; a language without letters isn't. With so many languages that their tables would exceed ``most_bytes``, every
language gets fewer characters; the bound is proven before anything is broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal texts get equal results; a
table without learnable rows makes every text ``und``; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, hash_bits

CHARS, PER_LANGUAGE, MOST_LANGUAGES, SEGMENT, BATCH_CHARS, MOST_BYTES, ESCAPE = 16_000, 150, 256, 512, 3_000_000, 1 << 28, 16


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(codes: list[int], n_codes: int) -> np.ndarray:
    """Transitions [state, code] of the suffix automaton of a sequence, -1 where there is none; state 0 is the root."""
    following: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for code in codes:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        following.append({})
        at = last
        while at >= 0 and code not in following[at]:
            following[at][code] = new
            at = link[at]
        if at >= 0:
            to = following[at][code]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                clone = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                following.append(dict(following[to]))
                while at >= 0 and following[at].get(code) == to:
                    following[at][code] = clone
                    at = link[at]
                link[to] = link[new] = clone
        last = new
    table = np.full((len(length), n_codes), -1, np.int32)
    for state, out in enumerate(following):
        for code, to in out.items():
            table[state, code] = to
    return table


def plain(text: str) -> bytes:
    """UTF-8 of the lower-cased letters, with a space for each run of other characters."""
    chars = points(text.lower())
    out = np.where(letters()[np.minimum(chars, 0x10FFFF)], chars, np.uint32(32))
    space = out == 32
    return out[~(space & np.concatenate(([False], space[:-1])))].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


class Parser:
    """Codes of bytes and one table for all languages: entry [state + code] is the next state's row, or, where a
    phrase ends, the complement of the row to which the same byte leads from the root. A byte that the
    root doesn't know leads to a last row, from which every byte ends the phrase. Each language has codes for the bytes
    of its own sample and one for all others."""

    def __init__(self, samples: dict[str, str], most_bytes: int = MOST_BYTES) -> None:
        own = {k: t for k, text in sorted(samples.items()) if (t := plain(text)).strip()}
        self.languages = list(own)
        # Twice as many states as bytes and two more rows, of four bytes for each code.
        room = most_bytes // (4 * max(1, len(self.languages)))
        own = {k: t[: max(1, room // (2 * (len(set(t)) + 2)) - 2)] for k, t in own.items()}
        self.codes = np.zeros((max(1, len(self.languages)), 256), np.int32)
        tables, self.roots, offset = [], [], 0
        for row, k in enumerate(self.languages):
            known = sorted(set(own[k]))
            n_codes = len(known) + 1
            self.codes[row] = len(known)
            self.codes[row, known] = np.arange(len(known))
            built = automaton(self.codes[row][np.frombuffer(own[k], np.uint8)].tolist(), n_codes)
            rows = built.astype(np.int64) * n_codes + offset
            unknown = offset + built.size
            again = np.where(built[0] >= 0, rows[0], unknown)
            filled = np.where(built >= 0, rows, ~again[None, :])
            filled[0] = again
            tables.append(np.concatenate((filled, ~again[None, :])).astype(np.int32).ravel())
            self.roots.append(offset)
            offset = unknown + n_codes
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        if self.table.nbytes > max(most_bytes, 1 << 20):
            raise ValueError(f"{len(self.languages)} languages need {self.table.nbytes} bytes")
        self.bits = np.array([np.log2(len(own[k])) + ESCAPE for k in self.languages])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each plain text in each language."""
        pieces = [(owner, at) for owner, t in enumerate(texts) for at in range(0, len(t), SEGMENT)]
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not pieces:
            return out
        whole = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        owner = np.array([o for o, _ in pieces])
        begin = np.array([starts[o] + at for o, at in pieces])
        length = np.minimum(begin + SEGMENT, starts[owner + 1]) - begin
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(begin), axis=1)
        count = np.zeros(state.shape, np.int32)
        for step, n in enumerate(active.tolist()):
            now = state[:, :n]
            to = self.table[now + self.codes[:, whole[begin[:n] + step]]]
            ended = to >> 31
            count[:, :n] -= ended
            state[:, :n] = to ^ ended
        count += state != roots
        np.add.at(out, owner, count.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and by what part its estimate is below the next best."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        at = 0
        while at < len(texts):
            coded, ids, size = [], [], 0
            while at < len(texts) and size < BATCH_CHARS:
                text = texts[at]
                if text:
                    own = plain(text)
                    if own.strip():
                        coded.append(own)
                        ids.append(at)
                        size += len(own)
                at += 1
            if ids:
                bits = self.phrases(coded) * self.bits / np.array([len(c) for c in coded])[:, None]
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(ids)), best]
                rest = np.partition(bits, 1, axis=1)[:, 1] if len(self.languages) > 1 else low * 2
                scores[ids] = np.clip(1 - low / rest, 0, 1)
                for i, b in zip(ids, best.tolist(), strict=True):
                    names[i] = self.languages[b]
        return names, scores


def held_out(doc_id: Column) -> Column:
    """Rows that languages are not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, chars: int = CHARS, per_language: int = PER_LANGUAGE, most_bytes: int = MOST_BYTES, most_languages: int = MOST_LANGUAGES) -> Parser:
    """Builds the automata from a bounded sample of every language's documents; the driver gets at most ``per_language`` parts of each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", "doc_id", hash_bits(F.col("doc_id"), 15).alias("at"))
    largest = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).select("lang")
    ids = usable.distinct().join(F.broadcast(largest), "lang")
    first = checkpoint(ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))).where(F.col("rank") <= per_language))
    chosen = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    size = chars // 20
    place = F.pmod(F.col("at"), F.greatest(F.length("text") - size + 1, F.lit(1))).cast("int") + 1
    parts = docs.select("lang", "doc_id", "text").where("text IS NOT NULL").join(chosen, ["lang", "doc_id"]).select("lang", "rank", F.substring("text", place, F.lit(size)).alias("part"))
    rows = parts.groupBy("lang", "rank").agg(F.min("part").alias("part")).orderBy("lang", "rank").collect()
    samples: dict[str, str] = {}
    for r in rows:
        own = samples.setdefault(str(r["lang"]), "")
        if len(own) < chars:
            samples[str(r["lang"])] = (own + " " + r["part"])[:chars]
    return Parser(samples, most_bytes)


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: whether it was held out, the predicted language and a score from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = held.value
        for texts in batches:
            names, scores = parser.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
