"""Hashed words and word shingles of whole Arrow columns in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Maps A-Z to a-z and whatever isn't 0-9, a-z or beyond ASCII to 0.
_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
_SPACED = bytes(int(c) or 32 for c in _TABLE)
#: Odd multipliers of a 64-bit mix, of a word's bytes and of a shingle's words.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE, _ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at once, unless one text is longer.
BLOCK = 1 << 20


def tokens(text: str | bytes | None) -> list[bytes]:
    """UTF-8 words of the whole text: runs of 0-9, a-z and bytes beyond ASCII, with A-Z lower-cased."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_SPACED).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BYTE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, bounds) of runs of texts of about BLOCK bytes; bounds start at 0. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, "right")) - 1)
        yield first, last, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def hash_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in ``raw``, and the index of each text's first word (and the end).

    A word's hash is a polynomial of its bytes, taken from running sums, then mixed.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    byte = _TABLE[raw]
    inside = np.zeros(len(byte) + 2, bool)
    inside[1:-1] = byte != 0
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(byte))]
    begins[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        # The last byte of a word weighs 1, so equal words hash alike wherever they stand: sum(b * P^-i) * P^end.
        inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(byte) - 1, _INVERSE, np.uint64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte * inverse)))
        forward = _powers(len(byte))
        hashes = mix((sums[end] - sums[start]) * forward[end - 1] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, bounds)


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


_INVERSE = _inverse(int(_BYTE))


def ngram_places(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and first word of every run of n consecutive words, and the index of each text's first run; fewer words are one run."""
    counts = np.diff(first)
    kept = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    out_first = np.concatenate((np.zeros(1, np.int64), np.cumsum(kept)))
    owner = np.repeat(np.arange(len(counts)), kept)
    return owner, first[:-1][owner] + np.arange(len(owner)) - out_first[:-1][owner], out_first


def hash_ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words of each text, and the index of each text's first; fewer words are one n-gram."""
    counts = np.diff(first)
    owner, place, out_first = ngram_places(first, n)
    with np.errstate(over="ignore"):
        factors = np.cumprod(np.full(n, _ODD, np.uint64)) | np.uint64(1)
        sums = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
        for k in range(n):
            sums += hashes[k : k + len(sums)] * factors[k]
        out = np.zeros(len(owner), np.uint64)
        whole = counts[owner] >= n
        out[whole] = mix(sums[place[whole]] + np.uint64(n))
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            own = hashes[first[i] : first[i + 1]]
            out[out_first[i] : out_first[i] + 1] = mix((own * factors[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    return out, out_first


def ngram_means(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The mean of the values of each n-gram's words, added in the order of the words, so that equal n-grams have equal means."""
    counts = np.diff(first)
    owner, place, out_first = ngram_places(first, n)
    sums = np.zeros(max(len(values) - n + 1, 0))
    for k in range(n):
        sums += values[k : k + len(sums)]
    out = np.zeros(len(owner))
    whole = counts[owner] >= n
    out[whole] = sums[place[whole]] / n
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        out[out_first[i]] = values[first[i] : first[i + 1]].mean()
    return out


def distinct(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct n-grams in order, their counts, and the index of each text's first."""
    grams = grams.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        grams[a:b].sort()
    if not len(grams):
        return grams, np.zeros(0, np.int64), first
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[first[:-1][first[:-1] < len(grams)]] = True
    at = np.flatnonzero(new)
    return grams[at], np.diff(np.append(at, len(grams))), np.searchsorted(at, first)
