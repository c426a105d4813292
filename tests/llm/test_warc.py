from __future__ import annotations

import base64
import gzip
import hashlib

from pyspark.sql import types as T

from catalux.llm import warc
from catalux.llm.files import place

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("digest", T.StringType()), T.StructField("path", T.IntegerType())])


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGES)


def brute(rows):
    last = {}
    for i, _, h in rows:
        last.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        known = [x for x in last[h or ""] if x is not None]
        first = max(known) if known else None
        revisit = first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "<p>x</p>"), (9, "http://a/9", "<p>x</p>"), (4, "http://a/4\r\nX: y", "<p>x</p>"), (2, None, None),
        (3, "u", ""), (None, "u", "<p>x</p>"), (None, "u", "only here"), (7, "ü", "é\r\n\r\nWARC/1.1\r\n\r\n日本" * 50), (8, "v", "a" * 300_000),
        (5, "dup", "tie"), (5, "dup", "tie"), (-6, "neg", "tie")]


def test_round_trip(spark):
    df = pages(spark, ROWS)
    got = sorted((tuple(r) for r in warc.archived(df).collect()), key=str)
    assert got == brute(ROWS)


def test_files_are_plain_warc_and_ranges_read_single_records(spark):
    index = warc.write(pages(spark, ROWS).coalesce(1))
    row = index.where("page_id = 7").first()
    where, inner = place(row["path"])
    with where.open_input_file(inner) as f:
        data = gzip.decompress(f.read_at(row["length"], row["offset"]))
        whole = gzip.decompress(f.read_at(f.size(), 0))
    head, http, payload = warc.parsed(data)
    assert payload.decode() == ROWS[7][2] and head["WARC-Type"] == "response" and head["WARC-Target-URI"] == "ü"
    assert whole.count(b"WARC-Record-ID") == index.where(index.path == row["path"]).count()
    some = {r["page_id"]: r for r in warc.read(index.where("page_id in (8, 1, 7)")).collect()}
    assert set(some) == {1, 7, 8} and some[8]["payload"] == b"a" * 300_000 and some[1]["refers_to"] == 9
    assert index.schema.names == ["path", "offset", "length", "url", "digest", "page_id", "record_type"]


def test_empty(spark):
    assert warc.archived(pages(spark, [])).count() == 0
