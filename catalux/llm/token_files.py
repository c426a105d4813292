"""Token-ID files (operator 4): a concatenated id array with Elias-Fano encoded document boundaries.

Documents are range-partitioned by doc_id and sorted; every task encodes its texts and writes one file (more when it
grows beyond ``FILE_IDS`` ids).  A file is a fixed header, a JSON directory, the Elias-Fano sections, and the ids as
little-endian unsigned integers (2 bytes when the vocabulary allows, else 4).  Two monotone lists are
Elias-Fano encoded: where each document starts among the file's ids, and the doc_ids.  Each has a directory of
every ``SAMPLE``-th upper bit, so ``select(i)`` reads one offset without decoding the list.

The manifest (one row a file) gives each file's first id in the whole corpus: a running sum over files.
It names files of finished tasks only.

Encoding: the tokenizers library encodes distinct pieces once per worker; a text is cut only before single spaces
between visible characters, where the byte-level pre-tokenizer always starts a new word, so the ids are those of the
whole text.  Special-token strings in a text are ordinary text.

Defined results: null and empty texts hold the end id only; rows without doc_id come first; rows that
share a doc_id are ordered by text hash, then text; an empty table has no files and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalux.llm.files import make_folder, place
from catalux.llm.tables import pick, written
from catalux.llm.textnp import prefix_hash, segments, span_hash, text_buffer
from catalux.session import shared_path

MAGIC = b"EFTOK001"
SAMPLE = 256
FILE_IDS = 16 << 20
READ_DOCS = 4_096
CACHE_PIECES = 1 << 20


# ---------------------------------------------------------------- Elias-Fano

@dataclass
class EliasFano:
    """A monotone list of n integers below ``universe``: lower bits packed, upper bits in unary, sampled positions of ones."""

    n: int
    low_bits: int
    base: int
    low: np.ndarray      # uint8
    high: np.ndarray     # uint8, little bit order
    sample: np.ndarray   # uint64: place of every SAMPLE-th one

    @staticmethod
    def encode(values: np.ndarray) -> "EliasFano":
        n = len(values)
        base = int(values[0]) if n else 0
        v = (values.astype(np.int64) - base).astype(np.uint64)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(),
                          bitorder="little")
        ones = ((v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros((int(ones[-1]) // 8 + 1) if n else 0, dtype=np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return EliasFano(n, bits, base, low, high, ones[::SAMPLE].astype(np.uint64))

    def select(self, first: int, last: int) -> np.ndarray:
        """Values first .. last - 1, reading only the bits between their sampled neighbours."""
        if first >= last:
            return np.zeros(0, np.int64)
        start = int(self.sample[first // SAMPLE])
        after = -(-last // SAMPLE)
        end = int(self.sample[after]) if after < len(self.sample) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start >> 3: (end + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[start & 7:]) + start
        k = first - first // SAMPLE * SAMPLE
        ones = ones[k: k + last - first]
        upper = (ones - np.arange(first, last)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return upper + self.base
        a, z = first * self.low_bits, last * self.low_bits
        raw = np.unpackbits(self.low[a >> 3: (z + 7) >> 3], bitorder="little")[a & 7: (a & 7) + z - a]
        lower = raw.reshape(-1, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return upper + lower + self.base

    def sections(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.sample.astype("<u8").tobytes()]

    def figures(self) -> dict:
        return {"n": self.n, "low_bits": self.low_bits, "base": self.base}

    @staticmethod
    def from_sections(figures: dict, parts: list[bytes]) -> "EliasFano":
        return EliasFano(figures["n"], figures["low_bits"], figures["base"], np.frombuffer(parts[0], np.uint8),
                         np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u8"))


def file_bytes(ids: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray, without_id: int) -> list[bytes]:
    """One token file: ids (already 2 or 4 bytes wide), document starts, ascending doc_ids of all but the first ``without_id``."""
    lists = [EliasFano.encode(np.append(starts, len(ids))), EliasFano.encode(doc_ids)]
    parts = [s for x in lists for s in x.sections()]
    directory = json.dumps({"id_bytes": ids.itemsize, "ids": len(ids), "docs": len(starts), "without_id": without_id,
                            "starts": lists[0].figures(), "doc_ids": lists[1].figures(),
                            "sizes": [len(p) for p in parts]}).encode()
    return [MAGIC, struct.pack("<Q", len(directory)), directory, *parts, ids.astype(ids.dtype.newbyteorder("<")).tobytes()]


class TokenFile:
    """Random access to one token file: document k's doc_id, and its ids, by reading just their bytes."""

    def __init__(self, path: str):
        where, inner = place(path)
        self.file = where.open_input_file(inner)
        head = self.file.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        (size,) = struct.unpack("<Q", head[8:])
        self.about = json.loads(self.file.read_at(size, 16))
        at, parts = 16 + size, []
        for n in self.about["sizes"]:
            parts.append(self.file.read_at(n, at))
            at += n
        self.body = at
        self.starts = EliasFano.from_sections(self.about["starts"], parts[:3])
        self.doc_ids = EliasFano.from_sections(self.about["doc_ids"], parts[3:])

    def ids_of(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (last - first + 1) of documents first .. last - 1 within the file, and all their ids."""
        bounds, width = self.starts.select(first, last + 1), self.about["id_bytes"]
        raw = self.file.read_at(int(bounds[-1] - bounds[0]) * width, self.body + int(bounds[0]) * width)
        return bounds, np.frombuffer(raw, f"<u{width}")

    def names_of(self, first: int, last: int) -> list[int | None]:
        none = self.about["without_id"]
        return [None] * max(0, min(last, none) - first) + self.doc_ids.select(max(first, none) - none, max(last, none) - none).tolist()


# ---------------------------------------------------------------- encoding

_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)      # first bytes of two-byte characters none of which is white space
_LEAD[0xC3:0xE0] = True


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a text can be cut: rows, and single spaces between visible characters."""
    cut = np.zeros(len(buf) + 1, dtype=bool)
    if len(buf) > 3:
        before = _VISIBLE[buf[1:-2]] | ((buf[1:-2] >= 0x80) & _LEAD[buf[:-3]])
        cut[2:-2] = (buf[2:-1] == 0x20) & before & (_VISIBLE[buf[3:]] | _LEAD[buf[3:]])
    cut[offsets] = True
    return np.flatnonzero(cut[:-1]) if len(buf) else np.zeros(0, np.int64)


class Encoder:
    """Ids of texts; distinct pieces are encoded once and kept, up to a bounded number."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.opens = np.zeros(size, dtype=bool)      # ids whose string begins with a space
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[k] = token.startswith("Ġ")
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _store(self, hashes: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.known), len(hashes)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while k + n > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used: self.used + len(ids)] = ids
        self.at[k: k + n] = self.used + np.cumsum(sizes) - sizes
        self.size[k: k + n] = sizes
        self.used += len(ids)
        self.known.update(zip(hashes, range(k, k + n)))

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, spaces: np.ndarray) -> None:
        second, last = np.minimum(starts + 1, len(buf) - 1), ends - 1
        plain = (buf[starts] == 0x20) & (spaces == 1) & (ends - starts > 1) & (_VISIBLE[buf[second]] | _LEAD[buf[second]])
        plain &= _VISIBLE[buf[last]] | ((buf[last] >= 0x80) & _LEAD[buf[np.maximum(last - 1, 0)]])
        data = memoryview(buf)
        chosen = np.flatnonzero(plain)
        if len(chosen):
            joined = b"".join(data[a:z] for a, z in zip(starts[chosen].tolist(), ends[chosen].tolist())).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            head = np.flatnonzero(self.opens[ids])
            if len(head) != len(chosen):
                raise RuntimeError("a piece did not begin a word")
            self._store(hashes[chosen].tolist(), ids, np.diff(np.append(head, len(ids))))
        rest = np.flatnonzero(~plain)
        if len(rest):
            texts = [bytes(data[a:z]).decode() for a, z in zip(starts[rest].tolist(), ends[rest].tolist())]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._store(hashes[rest].tolist(), np.array([i for e in got for i in e], np.int64), np.array([len(e) for e in got]))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and how many each has."""
        if len(buf) == 0:
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        starts = piece_starts(buf, offsets)
        ends = np.append(starts[1:], len(buf))
        unique, first, inverse = np.unique(span_hash(prefix_hash(buf), starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self.clear()
        keys = unique.tolist()
        new = np.array([k for k, h in enumerate(keys) if h not in self.known], dtype=np.int64)
        if len(new):
            space = np.concatenate([[0], np.cumsum(buf == 0x20)])
            a, z = starts[first[new]], ends[first[new]]
            self._learn(buf, a, z, unique[new], space[z] - space[a])
        index = np.array([self.known[h] for h in keys], dtype=np.int64)[inverse]
        size = self.size[index]
        total = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.at[index] - total[:-1], size) + np.arange(total[-1])
        row = np.searchsorted(starts, offsets)
        return self.pool[where], np.diff(total[row])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- writing and reading

def write(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files; their manifest: part, seq, path, docs, ids."""
    folder = shared_path(docs.sparkSession, "llm", "tokens")
    make_folder(folder)
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text")]
    rows = (pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
            .withColumn("h", F.xxhash64("text")).repartitionByRange(*order[:2]).sortWithinPartitions(*order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, sizes, names, seq = [], [], [], 0

        def flush() -> pa.RecordBatch:
            path, n = f"{folder}/{uuid.uuid4().hex}.tok", np.concatenate(sizes)
            known = [x for x in names if x is not None]
            body = np.concatenate(ids)
            where, inner = place(path)
            with where.open_output_stream(inner, compression=None) as out:
                for piece in file_bytes(body, np.cumsum(n) - n, np.array(known, np.int64), len(names) - len(known)):
                    out.write(piece)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "docs": len(names), "ids": len(body)}])

        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j in segments(off):
                got, n = enc.encode(buf[off[i]: off[j]], off[i: j + 1] - off[i])
                # the end id after each document
                ids.append(np.insert(got, np.cumsum(n), end_id).astype(enc.dtype))
                sizes.append(n + 1)
                names += doc_ids[i:j]
                if sum(map(len, ids)) >= FILE_IDS:
                    yield flush()
                    ids, sizes, names, seq = [], [], [], seq + 1
        if names:
            yield flush()

    return written(rows.select("doc_id", "text").mapInArrow(run, "part long, seq long, path string, docs long, ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    files = sorted(manifest.collect(), key=lambda r: (r["part"], r["seq"]))   # one row a file
    base, rows = 0, []
    for r in files:
        rows.append((r["path"], r["docs"], base))
        base += r["ids"]
    spark = manifest.sparkSession
    jobs = (spark.createDataFrame(rows, "path string, docs long, base long")
            .select("path", "docs", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(READ_DOCS).cast("long"))).alias("first"))
            .repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                file, first = TokenFile(job["path"]), job["first"]
                last = min(first + READ_DOCS, job["docs"])
                bounds, ids = file.ids_of(first, last)
                wide = memoryview(ids.astype("<u4")).cast("B")
                at = ((bounds - bounds[0]) * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.names_of(first, last), pa.int64()), pa.array(bounds[:-1] + job["base"]),
                     pa.array(np.diff(bounds)), pa.array([zlib.crc32(wide[a:z]) for a, z in zip(at, at[1:])], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return jobs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    return read(write(docs, tokenizer, end_id))
