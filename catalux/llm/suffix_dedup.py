"""Exact removal of repeated byte strings (operator 9): a sparse suffix array by bucket-pointer refinement.

Only sampled suffixes are sorted: in every string of 200 bytes the smallest q-gram hash (leftmost of
equals) is its anchor, so two equal strings have their anchors at the same offset, and each 200-byte
window belongs to exactly one anchor.

1. Anchors fall into q-gram buckets; buckets of one anchor are finished.
2. Buckets are refined by the identifier of the whole stretch of an anchor's windows.  Anchors whose
   stretch occurs again are finished: all their windows repeat.
3. In buckets that still hold different stretches, one text of each stretch is taken, and its positions are
   refined by sorting on (own bucket, bucket of the position 32, then 64, then 72 bytes later): each round uses
   the buckets of the round before, until buckets stand for 200 equal bytes.
4. Stretches of a bucket with more than ``HOT`` different ones are first cut into pieces of ``CELL`` windows each;
   their buckets are the 188 bytes that all windows of a piece share, and pieces are refined as stretches were.
   Only of piece buckets that are too large in their turn are the windows counted over all tasks, so no group is unbounded.

Bytes covered by a repeated window are removed, first occurrences too; matches never cross documents.
First buckets compare 64-bit hashes of q-grams and stretches.

Defined results: null and empty texts have 0 bytes and nothing removed; texts shorter than 200 bytes
keep all; repeated rows are documents of their own (their texts of 200 bytes or more go whole);
rows without doc_id take part under a hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalux.llm.tables import likely_members, with_likely, written
from catalux.llm.textnp import U64, mix, prefix_hash, segments, span_hash, text_buffer

LENGTH = 200
Q = 32
REACH = LENGTH - Q + 1     # q-grams in a window
PART = 2_000               # stretches sorted together, about (some 300 bytes each, and 100 times that in arrays beside them)
HOT = PART                 # a bucket of more different stretches than a part is counted over all tasks
CELL = 13                  # windows of a piece, by how far the anchor is behind their start (169 = 13 * 13 places)
SLICE = 1 << 20


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """min of x[s : s + width] for every s."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def anchors(buf: np.ndarray, offsets: np.ndarray):
    """(row, anchor, first and last window start, bucket, stretch) of all windows; places count from ``buf``'s start."""
    sizes = np.diff(offsets)
    if len(buf) < LENGTH or sizes.max(initial=0) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(buf)
    place = np.arange(len(buf) - Q + 1)
    gram = span_hash(prefix, place, place + Q)
    low = sliding_minimum((gram >> U64(32) << U64(32)) | place.astype(np.uint64), REACH)
    at = (low & U64(0xFFFFFFFF)).astype(np.int64)
    room = np.zeros(len(at) + 1, dtype=np.int32)       # windows that end inside their own row
    long_rows = np.flatnonzero(sizes >= LENGTH)
    np.add.at(room, offsets[long_rows], 1)
    np.add.at(room, offsets[long_rows + 1] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(room[:-1]) > 0)
    at = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    lo, hi, p = start[head], start[np.append(head[1:], len(start)) - 1], at[head]
    stretch = mix(span_hash(prefix, lo, hi + LENGTH) + (p - lo).astype(np.uint64))
    return np.searchsorted(offsets, lo, side="right") - 1, p, lo, hi, gram[p], stretch


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            key, tie = batch.column("key").to_numpy(), batch.column("tie").to_numpy().astype(np.int64)
            for i, j in segments(off, SLICE):
                for a in range(off[i], max(off[j] - LENGTH + 1, off[i] + 1), SLICE):   # several only in a long text
                    z = off[j] if j > i + 1 else min(off[j], a + SLICE + LENGTH - 1)
                    row, p, lo, hi, bucket, stretch = anchors(buf[a:z], np.clip(off[i: j + 1], a, z) - a)
                    base = a - off[i + row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[i + row]), pa.array((p + base) << 16 | tie[i + row]),
                         pa.array(((p - lo) << 16 | (hi - lo)).astype(np.int32)), pa.array(bucket.view(np.int64)),
                         pa.array(stretch.view(np.int64))], ["key", "place", "span", "bucket", "stretch"])
                    if j > i + 1:
                        break

    return docs.select("key", "tie", "text").mapInArrow(run, "key long, place long, span int, bucket long, stretch long")


def repeated_starts(buf: np.ndarray, wanted: np.ndarray, length: int = LENGTH, q: int = Q) -> np.ndarray:
    """Of the window starts ``wanted`` (each window inside its own text), those whose ``length`` bytes start at another too."""
    place = np.arange(len(buf) - q + 1)
    _, rank, count = np.unique(span_hash(prefix_hash(buf), place, place + q), return_inverse=True, return_counts=True)
    rank = rank.astype(np.int64)
    open_ = place[count[rank] > 1]                 # buckets of one are finished
    have = q
    while 2 * have <= length:
        i = open_[open_ + have < len(rank)]
        _, inverse, count = np.unique(rank[i] * (rank.max() + 1) + rank[i + have], return_inverse=True, return_counts=True)
        rank = rank.copy()
        rank[i] = rank.max() + 1 + inverse
        open_, have = i[count[inverse] > 1], 2 * have
    i = np.intersect1d(wanted, open_, assume_unique=True)
    if have < length:
        i = i[i + length - have < len(rank)]
        _, inverse, count = np.unique(rank[i] * (rank.max() + 1) + rank[i + length - have],
                                      return_inverse=True, return_counts=True)
        return i[count[inverse] > 1]
    _, inverse, count = np.unique(rank[i], return_inverse=True, return_counts=True)
    return i[count[inverse] > 1]


def _windows_of(frame: pd.DataFrame):
    """The joined stretches, where each one begins, all window starts and their rows."""
    texts = frame["bytes"].to_list()
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    width = frame["width"].to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), width)
    start = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + begin[row]
    return np.frombuffer(b"".join(texts), np.uint8), begin, start, row


def _spans(frame: pd.DataFrame, begin: np.ndarray, start: np.ndarray, row: np.ndarray) -> pd.DataFrame:
    """Runs of window starts as byte spans of the documents."""
    new = np.ones(len(start), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    r = row[head]
    shift = frame["start"].to_numpy()[r] - begin[r]
    tail = start[np.append(head[1:], len(start))[:len(head)] - 1] if len(head) else start
    return pd.DataFrame({"key": frame["key"].to_numpy()[r], "tie": frame["tie"].to_numpy()[r],
                         "a": start[head] + shift, "z": tail + shift + LENGTH})


_SPAN_TYPE = "key long, tie int, a long, z long"


def _sorted_part(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.reset_index(drop=True)
    buf, begin, start, row = _windows_of(frame)
    hit = repeated_starts(buf, start)
    keep = np.isin(start, hit, assume_unique=True)
    return _spans(frame, begin, start[keep], row[keep])


def pieces(frame: pd.DataFrame) -> pd.DataFrame:
    """The stretches cut into pieces of at most CELL windows: equal windows lie in pieces of one bucket."""
    frame = frame.reset_index(drop=True)
    buf, begin, start, row = _windows_of(frame)
    anchor = begin[:-1] + frame["back"].to_numpy()
    cell = (anchor[row] - start) // CELL
    new = np.ones(len(start), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
    head = np.flatnonzero(new)
    r, c, lo, hi = row[head], cell[head], start[head], start[np.append(head[1:], len(start)) - 1]
    prefix = prefix_hash(buf)
    at = anchor[r]
    shared = span_hash(prefix, at - CELL * c, at + LENGTH - CELL * (c + 1) + 1)
    data = memoryview(buf)
    return pd.DataFrame({
        "key": frame["key"].to_numpy()[r], "tie": frame["tie"].to_numpy()[r],
        "bucket": mix(shared + c.astype(np.uint64)).view(np.int64),
        "stretch": mix(span_hash(prefix, lo, hi + LENGTH) + (at - lo).astype(np.uint64)).view(np.int64),
        "start": lo - begin[r] + frame["start"].to_numpy()[r], "width": (hi - lo + 1).astype(np.int32),
        "bytes": [bytes(data[x: y + LENGTH]) for x, y in zip(lo.tolist(), hi.tolist())]})


def _refined(found: DataFrame, one, name: str) -> tuple[DataFrame, DataFrame]:
    """Of each different stretch (column ``one``; its bucket; many: too large a bucket) one, where some repeat nothing as a
    whole; and (bucket, stretch) of those that occur again."""
    classes = written(found.groupBy("bucket", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")), name)
    # one stretch of a bucket alone repeats nothing; where all stretches repeat nothing is left to find
    open_ = written(classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("stretches"), F.min("n").alias("least"))
                    .where("stretches > 1 and least = 1").select("bucket", "stretches"), "open-" + name)
    return (classes.join(open_, "bucket").select("bucket", (F.col("stretches") > HOT).alias("many"), "one"),
            classes.where("n > 1").select("bucket", "stretch"))


def _piece_texts(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of the pieces that occur again, and one text of each different piece that is left to look at."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pieces(frame)

    found = written(hot.mapInPandas(run, "key long, tie int, bucket long, stretch long, start long, width int, bytes binary"),
                    "pieces")
    rows, again = _refined(found, F.struct("key", "tie", "start", "width", "bytes"), "piece-classes")
    whole = found.join(again, ["bucket", "stretch"], "left_semi").select(
        "key", "tie", F.col("start").alias("a"), (F.col("start") + F.col("width") - 1 + LENGTH).alias("z"))
    return whole, written(rows.select("bucket", "many", "one.*"), "piece-texts")


def _counted_windows(hot: DataFrame) -> DataFrame:
    """Repeated windows of buckets of any size: counted by hash over all tasks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            buf, begin, start, row = _windows_of(frame)
            yield pd.DataFrame({
                "window": span_hash(prefix_hash(buf), start, start + LENGTH).view(np.int64),
                "key": frame["key"].to_numpy()[row], "tie": frame["tie"].to_numpy()[row],
                "a": start - begin[row] + frame["start"].to_numpy()[row]})

    windows = written(hot.mapInPandas(run, "window long, key long, tie int, a long"), "windows")
    again = written(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"), "again")
    return windows.join(again, "window").select("key", "tie", "a", (F.col("a") + LENGTH).alias("z"))


def _stretch_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes of each row's stretch, cut out of its document."""
    by_doc = written(rows.groupBy("key", "tie").agg(F.collect_list(F.struct("bucket", "many", "start", "width", "back")).alias("cuts")),
                     "cuts")  # a document's own anchors: no more than its length
    near = likely_members(docs, "key", by_doc.select("key")).join(by_doc, ["key", "tie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            cuts = batch.column("cuts")
            n, flat = np.diff(cuts.offsets.to_numpy()), cuts.flatten()
            row = np.repeat(np.arange(batch.num_rows), n)
            start, width = flat.field("start").to_numpy(), flat.field("width").to_numpy()
            data, at = memoryview(buf), off[row] + start
            texts = [bytes(data[a: a + w + LENGTH - 1]) for a, w in zip(at.tolist(), width.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), batch.column("tie").take(pa.array(row)), flat.field("bucket"),
                 flat.field("many"), pa.array(start), pa.array(width), flat.field("back"), pa.array(texts, pa.binary())],
                ["key", "tie", "bucket", "many", "start", "width", "back", "bytes"])

    return near.select("key", "tie", "text", "cuts").mapInArrow(
        run, "key long, tie int, bucket long, many boolean, start long, width int, back int, bytes binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, tie, spans) of every text with a repeated window; docs: key, tie, text."""
    found = written(_anchor_rows(docs), "anchors")
    live = written(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "live")
    alive = written(likely_members(found, "bucket", live).join(live, "bucket", "left_semi"), "alive")
    classes, again = _refined(alive, F.struct("key", "place", "span"), "stretches")
    place, back, more = F.shiftright("place", 16), F.shiftright("span", 16), F.col("span").bitwiseAND(0xFFFF)
    whole = (alive.join(again, ["bucket", "stretch"], "left_semi")
             .select("key", F.col("place").bitwiseAND(0xFFFF).cast("int").alias("tie"), (place - back).alias("a"),
                     (place - back + more + LENGTH).alias("z")))
    rows = (classes.select("bucket", "many", "one.*")
            .select("key", F.col("place").bitwiseAND(0xFFFF).cast("int").alias("tie"), "bucket", "many",
                    (place - back).alias("start"), (more + 1).alias("width"), back.alias("back")))
    texts = written(_stretch_texts(docs, rows), "stretch-texts")
    piece_whole, piece_texts = _piece_texts(texts.where("many"))
    columns = ["key", "tie", "bucket", "start", "width", "bytes"]
    usual = texts.where("not many").select(*columns).unionByName(piece_texts.where("not many").select(*columns))
    parts = max(1, usual.count() // PART)
    refined = (usual.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts))).groupBy("part")
               .applyInPandas(_sorted_part, _SPAN_TYPE))
    spans = whole.unionByName(piece_whole).unionByName(refined).unionByName(_counted_windows(piece_texts.where("many")))
    return written(spans.groupBy("key", "tie").agg(F.collect_list(F.struct("a", "z")).alias("spans")), "spans")


def _key_and_tie(doc_id, text) -> list:
    """A row by its doc_id and its text: 64 bits of both together and, by another seed, 16 of the text."""
    return [F.xxhash64(doc_id.cast("long"), F.xxhash64(text, F.lit("key"))).alias("key"),
            F.xxhash64(text, F.lit("row")).bitwiseAND(0xFFFF).cast("int").alias("tie")]


def _merged(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans in order: starts and ends of the maximal runs."""
    flat = spans.values
    a, z = flat.field("a").to_numpy(), flat.field("z").to_numpy()
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > z[:-1]
    head = np.flatnonzero(new)
    return a[head], z[np.append(head[1:], len(a)) - 1]


def _kept(data: bytes, spans: pa.Scalar) -> tuple[bytes, int, int]:
    """Remaining bytes, bytes removed, maximal removed runs."""
    if spans is None or not spans.is_valid:
        return data, 0, 0
    a, z = _merged(spans)
    parts, at = [], 0
    for x, y in zip(a.tolist(), z.tolist()):
        parts.append(data[at:x])
        at = y
    parts.append(data[at:])
    return b"".join(parts), int((z - a).sum()), len(a)


def _with_spans(docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """Columns c0, c1, ... of ``docs`` and ``spans`` (null: none).  Texts without a repeat are not shuffled."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    place = docs.columns.index(text)
    value = F.col(names[place]).cast("string")
    plain = docs.toDF(*names).select("*", *_key_and_tie(F.col(names[docs.columns.index("doc_id")]), value))
    spans = repeated_spans(plain.select("key", "tie", value.alias("text")))
    flagged = with_likely(plain, "key", spans.select("key"), "likely")
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    return (flagged.where("likely").join(spans, ["key", "tie"], "left").select(*names, "spans")
            .unionByName(flagged.where("not likely").select(*names, none))), names


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    joined, names = _with_spans(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(names[1]))
            data, spans, out = memoryview(buf), batch.column("spans"), []
            for r in range(batch.num_rows):
                kept, removed, runs = _kept(bytes(data[off[r]: off[r + 1]]), spans[r])
                out.append((removed, runs, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names[0]), pa.array(np.diff(off)), pa.array([x[0] for x in out], pa.int64()),
                 pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (a character cut in two goes) and ``length`` brought up to date."""
    joined, names = _with_spans(docs, text)
    place = docs.columns.index(text)
    count = docs.columns.index(length) if length in docs.columns else None
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in names]
            hit = np.flatnonzero(batch.column("spans").is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                texts, spans = columns[place].to_pylist(), batch.column("spans")
                sizes = columns[count].to_pylist() if count is not None else None
                for r in hit.tolist():
                    texts[r] = _kept(texts[r].encode(), spans[r])[0].decode("utf-8", "ignore")
                    if sizes is not None:
                        sizes[r] = len(texts[r])
                columns[place] = pa.array(texts, columns[place].type)
                if sizes is not None:
                    columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, schema).toDF(*docs.columns)
