"""Media columns in Ogg: pages with checksums, packets by lacing values, logical streams and granule positions.

Writing cuts packets into segments of up to 255 bytes (the lacing values), packs them into pages with a sequence
number for each logical stream, and lets a packet run over into the stream's next page. Reading finds pages by their
capture pattern, verifies each page's checksum, sorts pages to their streams by serial number, joins segments to
packets, drops what a lost or damaged page has cut, and dates each packet that ends a page by the page's granule
position. Ogg's checksum is a CRC-32 without reflection; reversing the bits of every byte turns it into zlib's.

A payload is dealt in packets of 576 bytes to two logical streams in turn; each stream begins with a header packet.

Defined results: a null text is empty and becomes one block of padding; equal texts give equal bytes; texts of any
length are stored whole; rows repeat as they are; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

BLOCK, RATE, STREAMS, SEGMENTS = 576, 48_000, 2, 64
#: Samples that features are computed of at once, a multiple of BLOCK.
PIECE = 576 << 11
#: Fixed values of the format: capture pattern, page header, flags of a page, and the position of a page that ends no packet.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST, NO_POSITION = 1, 2, 4, -1
MAGIC = b"PCM8raw\x00"
_REVERSED = bytes(int(f"{c:08b}"[::-1], 2) for c in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, no reflection, start 0 and no final change."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def pages(serial: int, packets: list[bytes], positions: list[int], segments: int = SEGMENTS) -> list[bytes]:
    """The pages of a logical stream; ``positions`` has the granule position at the end of each packet. The first packet has a page of its own."""
    out: list[bytes] = []

    def emit(lacing: list[int], body: list[bytes], position: int, flags: int) -> None:
        blank = HEADER.pack(CAPTURE, 0, flags, position, serial, len(out), 0, len(lacing)) + bytes(lacing) + b"".join(body)
        out.append(blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:])

    lacing: list[int] = []
    body: list[bytes] = []
    position, continued = NO_POSITION, 0
    for number, (packet, at) in enumerate(zip(packets, positions, strict=True)):
        start, lengths = 0, [255] * (len(packet) // 255) + [len(packet) % 255]
        for i, n in enumerate(lengths):
            if len(lacing) == segments:
                emit(lacing, body, position, continued | (FIRST if not out else 0))
                lacing, body, position, continued = [], [], NO_POSITION, CONTINUED if i else 0
            lacing.append(n)
            body.append(packet[start : start + n])
            start += n
        position = at
        if number == 0 and len(packets) > 1:
            emit(lacing, body, position, continued | (FIRST if not out else 0))
            lacing, body, position, continued = [], [], NO_POSITION, 0
    emit(lacing, body, position, continued | LAST | (FIRST if not out else 0))
    return out


@dataclass
class Stream:
    """What has been read of a logical stream."""

    packets: list[bytes] = field(default_factory=list)
    #: Granule position of each packet, None where its page gives none.
    positions: list[int | None] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _next: int = 0
    _open: list[bytes] | None = None


def demultiplex(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of places where a page was damaged."""
    streams: dict[int, Stream] = {}
    at = damaged = 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if len(data) - at < HEADER.size:
            damaged += 1
            break
        _, version, flags, position, serial, number, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(lacing)
        page = data[at:end]
        if version != 0 or len(lacing) < n or end > len(data) or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            damaged += 1
            at += 1
            continue
        own = streams.setdefault(serial, Stream())
        if number != own._next:
            own.lost += 1
            own._open = None
        if not flags & CONTINUED and own._open is not None:
            own._open = None
        skipping = bool(flags & CONTINUED) and own._open is None
        parts, start = own._open if own._open is not None else [], HEADER.size + n
        ended = []
        for length in lacing:
            parts.append(page[start : start + length])
            start += length
            if length < 255:
                if not skipping:
                    own.packets.append(b"".join(parts))
                    own.positions.append(None)
                    ended.append(len(own.packets) - 1)
                skipping, parts = False, []
        own._open = parts if n and lacing[-1] == 255 and not skipping else None
        if ended and position != NO_POSITION:
            own.positions[ended[-1]] = position
        own.pages, own._next, own.ended = own.pages + 1, number + 1, own.ended or bool(flags & LAST)
        at = end
    return streams, damaged


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 with bytes 255 up to a positive multiple of 576, and its length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def store(payload: bytes) -> bytes:
    """The payload as an Ogg file of two interleaved logical streams."""
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    serials = [(zlib.crc32(payload) + k) & 0xFFFFFFFF for k in range(STREAMS)]
    streams = []
    for k, serial in enumerate(serials):
        own = blocks[k::STREAMS]
        header = MAGIC + struct.pack("<IBB", RATE, k, STREAMS)
        streams.append(pages(serial, [header, *own], [0, *(BLOCK * (i + 1) for i in range(len(own)))]))
    return b"".join(p[i] for i in range(max(map(len, streams))) for p in streams if i < len(p))


def load(media: bytes) -> tuple[bytes, list[Stream]]:
    """The payload, and its streams in their order; raises if a page is damaged or missing."""
    streams, damaged = demultiplex(media)
    ordered = sorted((s for s in streams.values() if s.packets and s.packets[0].startswith(MAGIC)), key=lambda s: s.packets[0][len(MAGIC) + 4])
    if damaged or len(ordered) != STREAMS or any(s.lost or not s.ended for s in ordered):
        raise ValueError("damaged Ogg data")
    n = sum(len(s.packets) - 1 for s in ordered)
    return b"".join(ordered[i % STREAMS].packets[i // STREAMS + 1] for i in range(n)), ordered


def timestamps(stream: Stream, rate: int = RATE) -> list[float | None]:
    """Seconds at the end of each packet, from the granule positions and, between them, from the packets' samples."""
    out: list[float | None] = []
    position: int | None = 0
    for packet, at in zip(stream.packets, stream.positions, strict=True):
        position = at if at is not None else None if position is None else position + (0 if packet.startswith(MAGIC) else len(packet))
        out.append(None if position is None else position / rate)
    return out


def digest(text: str | None) -> tuple:
    payload, n = padded(text)
    media = store(payload)
    back, streams = load(media)
    total = crossings = 0
    energies, before = [], np.zeros(0, np.int16)
    for at in range(0, len(back), PIECE):
        samples = np.frombuffer(back, np.uint8, min(PIECE, len(back) - at), at).astype(np.int16) - np.int16(128)
        total += int(samples.sum(dtype=np.int64))
        energies.append((samples.astype(np.int32) ** 2).reshape(-1, BLOCK).sum(axis=1))
        crossings += int(np.count_nonzero(np.diff(np.signbit(np.concatenate((before, samples))))))
        before = samples[-1:]
    energy = np.concatenate(energies) / BLOCK
    seconds = max(t for s in streams for t in timestamps(s) if t is not None)
    feature = f"packets={'+'.join(str(len(s.packets) - 1) for s in streams)};pages={'+'.join(str(s.pages) for s in streams)};seconds={seconds:.6f};mean={total / len(back):.6f};rms={np.sqrt(energy.mean()):.6f};peak={np.sqrt(energy.max()):.6f};crossings={crossings}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(docs: DataFrame) -> DataFrame:
    """One row per document: digests of the stored and of the read bytes, and features of the samples."""

    @F.pandas_udf(_SCHEMA)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in _SCHEMA.split(", ")]
        for texts in batches:
            yield pd.DataFrame([digest(t) for t in texts], columns=names)

    return docs.select("doc_id", features("text").alias("f")).select("doc_id", "f.*")


def with_media(docs: DataFrame, column: str = "media") -> DataFrame:
    """The documents with their text as an Ogg file in a binary column, under ``column`` or, if taken, that name after underscores."""

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: store(padded(t)[0]))

    return docs.withColumn(fresh(docs, column)[0], stored("text"))


def packets(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per packet of every file: stream, number, bytes and the time at its end; damaged pages are counted."""
    kind = "array<struct<serial:long,packet:int,seconds:double,data:binary,damaged:int>>"

    @F.pandas_udf(kind)
    def read(files: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> list[dict]:
            streams, damaged = demultiplex(data or b"")
            return [{"serial": serial, "packet": i, "seconds": t, "data": p, "damaged": damaged} for serial, s in streams.items() for i, (p, t) in enumerate(zip(s.packets, timestamps(s), strict=True))]

        return files.map(one)

    return media.select(key, F.explode(read(column)).alias("p")).select(key, "p.*")
