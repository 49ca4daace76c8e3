"""Secret scans: three base patterns, and candidate strings whose characters are as mixed as random ones.

A candidate is a run of 20 or more characters of the Base64 alphabet with a digit in it. It belongs to the narrowest
class that holds all its characters (digits, hex, letters and digits, any), and each class has its own least entropy.
A window of WINDOW characters slides over the candidate; the counts of its characters change by one in and one out,
and with them the sum of n * log2(n), so a step costs the same for any window. Runs of windows at or above the class's
least entropy become spans of kind ``entropy``. Runs of digits alone are numbers, and their class asks for more bits than
ten characters can have, so it is never reported. Allow-listed candidates (placeholders, UUIDs, words joined by marks)
and those that a base span covers are left out.

Defined results: a null text is empty; spans are code points with the end exclusive, ordered by start, kind and end;
other columns don't matter; rows with equal texts get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Kinds in their order.
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT = re.compile(r"[0-9]")
#: Classes from the narrowest, with the least entropy in bits of a window (random windows of 20 have about 2.9, 3.4, 4.1 and 4.1).
CLASSES = ((re.compile(r"[0-9]+"), 9.0), (re.compile(r"[0-9a-f]+|[0-9A-F]+"), 3.1), (re.compile(r"[A-Za-z0-9]+"), 3.7), (re.compile(r".+"), 3.8))
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"(?i).*(example|placeholder|changeme|xxxx|your[_-]).*"),
    re.compile(r"([A-Za-z]+[-_/+=]+)*[A-Za-z]+[0-9]{0,4}"),
    re.compile(r"[0-9/_+=-]+"),
)
_TERMS = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def _order(span: tuple[int, str, int]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[1]), span[2]


def entropic(candidate: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of the candidate that windows of at least ``least`` bits a character cover."""
    counts: dict[str, int] = {}
    total, spans, most = 0.0, [], window * (log2(window) - least)
    for end, c in enumerate(candidate, 1):
        n = counts.get(c, 0)
        total += _TERMS[n + 1] - _TERMS[n]
        counts[c] = n + 1
        if end > window:
            gone = candidate[end - window - 1]
            n = counts[gone]
            total += _TERMS[n - 1] - _TERMS[n]
            counts[gone] = n - 1
        if end >= window and total <= most + 1e-9:
            if spans and spans[-1][1] >= end - window:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - window, end))
    return spans


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, each leftmost and non-overlapping; matches that are too short are dropped."""
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def found(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and further spans of a whole text, in order."""
    text = text or ""
    base, more = sorted(base_spans(text), key=_order), []
    at = upto = 0
    for m in _CANDIDATE.finditer(text):
        own = m[0]
        # Base spans that begin up to the candidate have passed; one of them covers it if the furthest end does.
        while at < len(base) and base[at][0] <= m.start():
            upto = max(upto, base[at][2])
            at += 1
        if m.end() <= upto or not _DIGIT.search(own) or any(p.fullmatch(own) for p in ALLOWED):
            continue
        least = next(bits for pattern, bits in CLASSES if pattern.fullmatch(own))
        more += [(m.start() + a, "entropy", m.start() + b) for a, b in entropic(own, least)]
    return base, sorted(more, key=_order)


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def digest(text: str | None) -> tuple[int, int, int, str, str, int]:
    base, more = found(text)
    kinds = [k for _, k, _ in base]
    both = sorted(base + more, key=_order)
    return (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both), len(more))


_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a hash of the base spans, and all spans."""

    @F.pandas_udf(_SCHEMA)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in _SCHEMA.split(", ")]
        for texts in batches:
            yield pd.DataFrame([digest(t) for t in texts], columns=names)

    return docs.select("doc_id", spans("text").alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mask``, overlapping spans by one."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            out, upto = [], 0
            base, more = found(text)
            for a, _, b in sorted(base + more):
                if a >= upto:
                    out += [text[upto:a], mask]
                upto = max(upto, b)
            return "".join([*out, text[upto:]])

        return texts.map(one)

    return docs.withColumn("text", masked("text"))
