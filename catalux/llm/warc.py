"""WARC (operator 6): archives with an index, read back by coalesced byte ranges.

Writing: payload digests find the groups of equal payloads (counted before any payload moves); the record of
the largest page_id is the response, the others revisit it.  Every task writes its records, one gzip member
each, and returns index rows: path, offset, length, URL, digest.  The index is a table in the shared folder
and names finished files only, so a file of a lost task is never read.

Reading: index rows are selected first; those of one stretch of a file are sorted by offset, neighbours (gap up to
``GAP`` bytes) become one read, and the records are cut out of it.  Payload digests are verified.

Defined results: a null html is an empty payload; all rows that share the largest page_id of a group are
responses; a null page_id is the smallest; in a group without any page_id all are responses; a null url has
no target header.  Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalux.llm.files import make_folder, place
from catalux.llm.tables import pick, with_likely, written
from catalux.session import shared_path

LEVEL = 4
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
GAP = 64 << 10
DATE = "1970-01-01T00:00:00Z"
INDEX = "path string, offset long, length long, url string, digest string, page_id long, record_type string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record: a response, or a revisit (headers of the response only) where ``refers_to`` is given."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload (empty for a revisit) of one record."""
    def fields(raw: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])

    raw, rest = data.split(b"\r\n\r\n", 1)
    head = fields(raw)
    http, payload = rest[: int(head["Content-Length"])].split(b"\r\n\r\n", 1)
    return head, fields(http), payload


def _page(record_id: str) -> int | None:
    value = record_id[len("<urn:page:"):-1]
    return None if value == "none" else int(value)


def write(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html); the index table."""
    p = pick(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("sha", F.sha1("html"))
    groups = written(p.groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1 and first_id is not null").select("sha", "first_id"), "payload-groups")
    flagged = with_likely(p, "sha", groups.select("sha"), "likely")
    single = flagged.where("not likely").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    grouped = (flagged.where("likely").join(groups, "sha", "left").select(
        "page_id", "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")))
    folder = shared_path(pages.sparkSession, "llm", "warc")
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, offset = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    path, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    where, inner = place(path)
                    out = where.open_output_stream(inner, compression=None)   # members are compressed one by one
                payload = html.encode()
                name = digest(payload)
                member = gzip.compress(record(page_id, url, payload, name, refers_to), LEVEL, mtime=0)
                out.write(member)
                rows.append((path, offset, len(member), url, name, page_id, "response" if refers_to is None else "revisit"))
                offset += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 7, (
                    pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                ["path", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    return written(single.unionByName(grouped).mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """The records that ``index`` rows point at."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset")
        where, inner = place(frame["path"].iloc[0])
        spans = list(zip(frame["offset"].tolist(), frame["length"].tolist()))
        out, k = [], 0
        with where.open_input_file(inner) as f:
            while k < len(spans):
                start, end, m = spans[k][0], sum(spans[k]), k + 1
                while m < len(spans) and spans[m][0] <= end + GAP:
                    end, m = sum(spans[m]), m + 1
                data = memoryview(f.read_at(end - start, start))
                for offset, length in spans[k:m]:
                    head, http, payload = parsed(zlib.decompress(data[offset - start: offset - start + length], 31))
                    kind, name = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != name:
                        raise ValueError(f"payload digest differs at {inner}:{offset}")
                    out.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(http["Content-Length"]),
                                name, kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None, payload))
                k = m
        columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    return (index.withColumn("stretch", F.floor(F.col("offset") / RANGE_BYTES)).groupBy("path", "stretch")
            .applyInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, "
                                "record_type string, refers_to long, payload binary"))


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages, read every record back, and describe it."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
