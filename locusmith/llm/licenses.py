"""License scans by fuzzy short-notice search.

A notice within k errors of a pattern holds one of any k + 1 pieces of the pattern unchanged (pigeonhole). So every
pattern is split into k + 1 exact seeds; only around a seed's places is the whole pattern looked for with at most k
errors. Areas in which no place can end a notice, by one bit-parallel pass of edit distances over them, are left out;
in the others the regex library verifies the notice and reports the span and the errors it found. Base labels come
from the exact word sequences of the contract; the fuzzy notices add theirs.

Defined results: a null text is empty; equal texts get equal results; of overlapping notices of one pattern the one with
the fewest errors stays, then the first; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import tokens

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices, their labels and the errors that they may have.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license, version 2.0", "apache", 4),
    ("www.apache.org/licenses/license-2.0", "apache", 3),
    ("under the gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under cc by-nc 4.0", "cc-by-nc", 1),
    ("licensed under cc by-sa 4.0", "cc-by-sa", 1),
    ("licensed under cc by 4.0", "cc-by", 1),
    ("creative commons attribution", "cc-by", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("all rights reserved", "proprietary", 1),
)


def seeds(pattern: str, errors: int) -> list[tuple[int, str]]:
    """The pattern in errors + 1 pieces of about equal length, with their offsets."""
    cuts = [round(i * len(pattern) / (errors + 1)) for i in range(errors + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def letter_masks(pattern: str) -> dict[str, int]:
    """For each character of the pattern, the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


_FUZZY = [(label, errors, len(pattern), seeds(pattern, errors), regex.compile(f"(?be)(?:{regex.escape(pattern)}){{e<={errors}}}"), letter_masks(pattern)) for pattern, label, errors in NOTICES]
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ends(text: str, left: int, right: int, masks: dict[str, int], size: int, errors: int) -> list[int]:
    """Where text[left:right] may end a notice: the ends of all parts of it within ``errors`` edits of the pattern.

    The column of edit distances is kept as bits of its rises and falls, so a character costs a few integer operations.
    """
    every, top = (1 << size) - 1, 1 << (size - 1)
    rises, falls, distance, out = every, 0, size, []
    for at in range(left, right):
        same = masks.get(text[at], 0) | falls
        level = ((rises + (same & rises)) ^ rises) | same
        down, up = rises & level, falls | every & ~(rises | level)
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up <<= 1
        falls, rises = up & level & every, (down << 1 | ~(up | level)) & every
        if distance <= errors:
            out.append(at + 1)
    return out


def possible(text: str, areas: set[tuple[int, int]], own: tuple) -> list[tuple[int, int]]:
    """The areas in which a notice may end; areas that overlap are passed over once."""
    _, errors, size, _, _, masks = own
    out: list[tuple[int, int]] = []
    waiting, upto = sorted(areas), 0
    while upto < len(waiting):
        first, (left, right) = upto, waiting[upto]
        while upto < len(waiting) and waiting[upto][0] <= right:
            right = max(right, waiting[upto][1])
            upto += 1
        found = ends(text, left, right, masks, size, errors)
        for a, b in waiting[first:upto] if found else ():
            at = bisect.bisect_left(found, a + size - errors)
            if at < len(found) and found[at] <= b:
                out.append((a, b))
    return out


def _best(text: str, area: tuple[int, int], own: tuple) -> tuple[int, int, int, int, int] | None:
    """(errors, start, end, area) of the best notice in an area of a text, if there is any."""
    found = own[4].search(text, *area)
    return (sum(found.fuzzy_counts), found.start(), found.end(), *area) if found else None


def notices(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, errors) of the notices in a text whose A-Z are lower-cased.

    Every seed's area that may hold one is searched by itself; it is too short for two notices. The best of all comes first; where a
    kept notice of the pattern overlaps the best of an area, what it leaves of the area is searched again. So every
    notice overlaps a kept one of its pattern with no more errors, or is kept. An area is searched a few times, and
    overlaps are looked up in order, so the time follows the number of seeds.
    """
    out: list[tuple[int, int, str, int]] = []
    for own in _FUZZY:
        label, errors, size, parts, _, _ = own
        areas: set[tuple[int, int]] = set()
        for offset, seed in parts:
            at = text.find(seed)
            while at >= 0:
                areas.add((max(0, at - offset - errors), min(len(text), at - offset + size + errors)))
                at = text.find(seed, at + 1)
        heap = [best for area in possible(text, areas, own) if (best := _best(text, area, own))]
        heapq.heapify(heap)
        starts: list[int] = []
        ends: dict[int, int] = {}
        while heap:
            e, a, b, left, right = heapq.heappop(heap)
            at = bisect.bisect_left(starts, b)
            if at and ends[starts[at - 1]] > a:
                x, y = starts[at - 1], ends[starts[at - 1]]
                for area in ((left, min(right, x)), (max(left, y), right)):
                    if area[1] - area[0] >= size - errors and (best := _best(text, area, own)):
                        heapq.heappush(heap, best)
                continue
            starts.insert(at, a)
            ends[a] = b
            out.append((a, b, label, e))
    return sorted(out)


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        own = [w.encode() for w in phrase.split()]
        at = -1
        while True:
            try:
                at = words.index(own[-1], at + 1)
            except ValueError:
                break
            start = at - len(own) + 1
            if start >= 0 and words[start : at + 1] == own:
                out.append((start, label))
    return sorted(out)


def digest(text: str | None) -> tuple:
    """What the contract asks of a text: word and place counts, first and last place, labels, and a score."""
    words = tokens(text)
    base = places(words) if b"license" in words else []
    lowered = (text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower()
    fuzzy = notices(lowered)
    exact = {label for _, label in base}
    labels = exact | {label for _, _, label, _ in fuzzy}
    score = 1.0 if exact else max((1 - e / (b - a + 1) for a, b, _, e in fuzzy), default=0.0)
    first, last = (base[0][0], base[-1][0]) if base else (None, None)
    spans = ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e in fuzzy)
    return len(words), len(base), first, last, ",".join(sorted(exact)), ",".join(sorted(labels)), float(score), spans


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("fuzzy_spans", pa.string())]
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, fuzzy_spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places and labels, all labels, a score, and the fuzzy spans with their errors."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = list(zip(*(digest(t) for t in part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True))], names=["doc_id", *(n for n, _ in _FIELDS)])

    return docs.select("doc_id", "text").mapInArrow(one, f"doc_id {kind}, {_SCHEMA}")
