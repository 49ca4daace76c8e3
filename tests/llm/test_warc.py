"""Archives round trip, their format, and the rows of the query against plain Python and its SQL twin."""

import base64
import glob
import hashlib
import io
import random
import struct

import duckdb
import pytest
import zstandard

from locusmith.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def made(seed=1):
    rng = random.Random(seed)
    bodies = [f"<html><title>{i}</title><p>{'wörd ' * rng.randrange(60)}{rng.random()}</p>" for i in range(60)] + ["", "x" * 700_000]
    rows = [(i, f"http://h.example/ü {i}\r\nEvil: 1", rng.choice(bodies), "clash") for i in range(300)] + [(1000 + i, None, "<p>hot</p>", None) for i in range(200)]
    return [*rows, (2000, "u", None, None), (None, "u", "<p>hot</p>", None), (None, None, "alone", None), (1199, None, "<p>hot</p>", None)]


def expected(rows, least=0):
    groups = {}
    for page, _, html, _ in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        leader = max(ids) if ids and len(raw) >= least else page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == leader else "revisit", None if page == leader else leader))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 11])
def test_rows(spark, tmp_path, least):
    rows = made()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    read = warc.archive(pages, f"file://{tmp_path}/a", least)
    got = read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, least)
    # Responses hold the whole payload, revisits none.
    whole = {(r["page_id"], r["url"], r["html"]) for r in read.where("record_type = 'response'").collect()}
    uri = lambda u: (u or "").replace("ü", "%C3%BC").replace(" ", "%20").replace("\r\n", "%0D%0A")
    assert whole <= {(p, uri(u), h or "") for p, u, h, _ in rows} and {h for _, _, h in whole} == {h or "" for _, _, h, _ in rows}
    assert read.where("record_type = 'revisit' AND html IS NOT NULL").count() == 0


def test_shuffled_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 3)
    rows = made(2)
    got = warc.classify(spark.createDataFrame(rows, SCHEMA), limit=0).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], *r[3:]) for r in expected(rows)], key=str)


def test_sql_twin(spark):
    rows = [r for r in made(3)]
    pages = spark.createDataFrame(rows, SCHEMA).select("page_id", "url", "html").toPandas()
    pages["page_id"] = pages["page_id"].astype("Int64")
    con = duckdb.connect()
    con.register("pages", pages)
    assert sorted(con.execute(warc.SQL).fetchall(), key=str) == expected(rows)


def test_format_and_rolling(spark, tmp_path):
    """Every archive begins with its dictionary in a skippable frame; records are frames of their own; dictionaries pay off."""
    rows = [(i, "http://a.example/", f"<!DOCTYPE html><html><head><meta charset=utf-8></head><body>Page {i} of the site</body></html>", None) for i in range(2000)]
    pages = warc.classify(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    archives = warc.write_archives(pages, f"file://{tmp_path}/b", archive_bytes=300_000, sample_bytes=100_000, dictionary_bytes=4096).collect()
    assert len(archives) > 2 and sum(a["records"] for a in archives) == 2000
    assert {a["path"] for a in archives} == set(glob.glob(f"{tmp_path}/b/*.warc.zst"))
    data = open(archives[0]["path"], "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and len(data) == archives[0]["bytes"] and zstandard.ZstdCompressionDict(data[8 : 8 + size]).dict_id()
    records = list(warc.frames(io.BytesIO(data), piece=7))
    assert len(records) == archives[0]["records"] and all(r.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") for r in records)
    assert len(data) - size < sum(len(zstandard.compress(r)) for r in records) / 2
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(records[0].replace(b"Page", b"Pace"))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.frames(io.BytesIO(data[:-3])))


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).collect() == []
