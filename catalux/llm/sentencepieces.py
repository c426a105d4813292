"""SentencePiece encoding and decoding (operator 8): a relational lattice, folded with higher-order functions.

Encoding: texts are cut into atoms, at every place that no piece of the table crosses (most are words with
their leading mark).  Distinct atoms form a table: their substrings of bounded length are exploded, equi-joined to
the piece table (32,000 rows or so, bounded by the model file) and grouped by atom; ``aggregate`` folds the edges:

* of a unigram model by Viterbi: for each end the best way there, then the way back;
* of a merge-ranked (BPE) model, for which Viterbi gives other ids than the model's library, by merges: in each step the
  best-ranked edge that two neighbouring symbols fill, leftmost of equals.

A character without a piece becomes its UTF-8 byte pieces.  Texts are written as blocks of bounded size; a block
sends its distinct atoms to the tasks that own their hash ranges and gets their ids back, so no word table is
broadcast.  Atoms of more than ``LONG`` characters are merged with a heap instead, so that unbroken runs of any length
take n log n.

Decoding: pieces are joined, byte pieces give their bytes, marks become spaces, the leading mark goes.  Decoding
an encoding gives back the text, except that a U+2581 in a text comes back as a space.

Defined results: null and empty texts have no ids and decode to the empty text; equal texts have equal
ids; of equally good ways the one with the longer last piece wins.  Only doc_id and the text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalux.llm.files import place
from catalux.llm.lm_scoring import _packed as pack
from catalux.llm.lm_scoring import blocks, unpacked
from catalux.llm.sqltext import let
from catalux.llm.tables import written
from catalux.llm.textnp import U64, mix, segments, text_buffer
from catalux.session import shared_path

MARK = "▁"
RANGE_BYTES = 4 << 20          # text a hash range
DECODE_ROWS = 256
LATTICE_ATOMS = 20_000         # atoms a task of the lattice
LONG = 48                      # characters of an atom that the lattice takes
LEVEL = 6                      # of zstd, for what is written or shuffled once
NO_PIECE = -20.0               # unigram score of a character that is spelt in bytes


# ---------------------------------------------------------------- the piece table

@dataclass
class Pieces:
    """The table of a model file, and what follows from it."""

    strings: list[str]
    score: np.ndarray
    usable: np.ndarray       # ordinary pieces (no control, unknown or byte pieces)
    byte_id: np.ndarray      # id of each byte's piece
    ranked: bool             # scores are merge ranks, not log probabilities

    @staticmethod
    def load(path: str) -> "Pieces":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        strings, raw = [model.id_to_piece(k) for k in range(n)], np.array([model.get_score(k) for k in range(n)])
        usable = np.array([not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
                           for k in range(n)])
        byte_id = np.full(256, -1, np.int64)
        for k in range(n):
            if model.is_byte(k):
                byte_id[int(strings[k][3:5], 16)] = k
        if (byte_id < 0).any():
            raise ValueError("a model without byte pieces cannot spell every text")
        known = raw[usable]
        ranked = bool(len(known) and (known == np.round(known)).all())
        return Pieces(strings, raw, usable, byte_id, ranked)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s, k, float(x)) for k, (s, x, ok) in enumerate(zip(self.strings, self.score, self.usable)) if ok]
        return spark.createDataFrame(rows, "piece string, id int, score double")

    @property
    def longest(self) -> int:
        return max(len(s) for s, ok in zip(self.strings, self.usable) if ok)

    def joins(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of each code point, and which classes follow each other inside a piece."""
        used = sorted({c for s, ok in zip(self.strings, self.usable) if ok and len(s) > 1 for c in s})
        kind = np.zeros(0x110000, dtype=np.int32)
        kind[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
        follows = np.zeros((len(used) + 1, len(used) + 1), dtype=bool)
        for s, ok in zip(self.strings, self.usable):
            if ok:
                for a, b in zip(s, s[1:]):
                    follows[kind[ord(a)], kind[ord(b)]] = True
        return kind, follows

    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces (marks as spaces), and each id's first byte and length."""
        spelt = set(self.byte_id.tolist())
        parts = [bytes([int(s[3:5], 16)]) if k in spelt else (s.replace(MARK, " ").encode() if ok else b"")
                 for k, (s, ok) in enumerate(zip(self.strings, self.usable))]
        size = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


# ---------------------------------------------------------------- atoms

class Cutter:
    """Cuts texts into atoms."""

    def __init__(self, kind: np.ndarray, follows: np.ndarray):
        self.kind, self.follows = kind, follows

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, code points, atom starts, atom hashes, first atom of each row) for row ranges of bounded size."""
        buf, off = text_buffer(column)
        for i, j in segments(off):
            texts = [bytes(buf[a:z]).decode() for a, z in zip(off[i:j].tolist(), off[i + 1: j + 1].tolist())]
            marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
            points = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.int64)
            rows = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
            kinds = self.kind[points]
            cut = np.ones(len(points), dtype=bool)
            if len(points) > 1:
                cut[1:] = ~self.follows[kinds[:-1], kinds[1:]]
            cut[rows[rows < len(points)]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(points))
            yield i, points, starts, _hashes(points, starts, ends), np.searchsorted(starts, rows)


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of code points, by place in the run: independent of where it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(points)) - np.repeat(starts, ends - starts)
    value = mix(points.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * U64(0xD1B54A32D192ED03) + U64(1))
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


# ---------------------------------------------------------------- lattice

def viterbi(edges: Column, length: Column) -> Column:
    """Ids along the best way from 0 to ``length``; edges: array<struct<e, s, score, id>> sorted by e, then s."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(0).alias("id")))

    def step(best: Column, x: Column) -> Column:
        way = F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), x["s"].alias("s"), x["id"].alias("id"))
        return (F.when(F.size(best) == x["e"], F.array_append(best, way))
                .when(way["score"] > F.get(best, x["e"])["score"], F.array_append(F.slice(best, F.lit(1), x["e"]), way))
                .otherwise(best))

    def back(best: Column) -> Column:
        begin = F.struct(length.alias("at"), F.array().cast("array<int>").alias("ids"))
        return F.aggregate(F.sequence(F.lit(1), length), begin, lambda acc, _: F.when(acc["at"] == 0, acc).otherwise(
            F.struct(F.get(best, acc["at"])["s"].alias("at"),
                     F.array_append(acc["ids"], F.get(best, acc["at"])["id"]).alias("ids"))),
            lambda acc: F.reverse(acc["ids"]))

    return let(F.aggregate(edges, start, step), back)


def merges(edges: Column, length: Column) -> Column:
    """Ids after merging single characters; edges: array<struct<e, s, score, id>> sorted by e, then s, all characters among them."""
    # state: for each place the end and id of the symbol that starts there, or end -1
    single = F.transform(F.filter(edges, lambda x: x["e"] - x["s"] == 1), lambda x: F.struct(x["e"].alias("e"), x["id"].alias("id")))
    wide = F.sort_array(F.transform(F.filter(edges, lambda x: x["e"] - x["s"] > 1), lambda x: F.struct(
        (-x["score"]).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["id"].alias("id"))))

    def fold(better: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            hit = F.get(F.filter(better, lambda p: F.get(state, F.get(state, p["s"])["e"])["e"] == p["e"]), F.lit(0))
            return let(hit, lambda h: F.when(h.isNull(), state).otherwise(F.transform(state, lambda x, i: F.when(
                i == h["s"], F.struct(h["e"].alias("e"), h["id"].alias("id"))).when(
                i == F.get(state, h["s"])["e"], F.struct(F.lit(-1).alias("e"), F.lit(0).alias("id"))).otherwise(x))))

        return F.aggregate(F.sequence(F.lit(1), length), single, step, lambda state: F.transform(
            F.filter(state, lambda x: x["e"] > 0), lambda x: x["id"]))

    return let(wide, fold)


def merged_long(text: str, table: dict[str, tuple[float, int]]) -> list[int]:
    """The same merges with a heap, for long atoms; a character c without a piece is -c - 1."""
    n = len(text)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple] = []

    def offer(a: int) -> None:
        if a >= 0 and end[a] < n and (found := table.get(text[a: end[end[a]]])):
            heapq.heappush(heap, (-found[0], a, end[a], end[end[a]]))

    for a in range(n):
        offer(a)
    while heap:
        _, a, b, z = heapq.heappop(heap)
        if alive[a] and end[a] == b and b < n and alive[b] and end[b] == z:
            end[a], alive[b] = z, False
            if z < n:
                before[z] = a
            offer(a)
            offer(before[a])
    return [table[text[a: end[a]]][1] if text[a: end[a]] in table else -ord(text[a]) - 1 for a in range(n) if alive[a]]


def encoded_atoms(atoms: DataFrame, pieces: DataFrame, longest: int, ranked: bool) -> DataFrame:
    """``ids`` of each row of ``atoms`` (owner, k, atom); a code point c without a piece is -c - 1."""
    n = F.length("atom")
    # an atom becomes some fifty substrings: so many atoms a task that their edges are grouped in memory
    parts = max(1, atoms.count() // LATTICE_ATOMS)
    rows = atoms.repartition(parts, "owner", "k").select("owner", "k", "atom", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    rows = rows.select("owner", "k", "atom", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("size"))
    rows = rows.select("owner", "k", "s", "size", F.substring("atom", F.col("s") + 1, F.col("size")).alias("piece"))
    # the piece table is bounded by the model file
    met = rows.join(F.broadcast(pieces), "piece", "left").where("id is not null or size = 1")
    edge = F.struct((F.col("s") + F.col("size")).alias("e"), "s", F.coalesce("score", F.lit(NO_PIECE)).alias("score"),
                    F.coalesce("id", -F.ascii("piece") - 1).alias("id"))
    fold = merges if ranked else viterbi
    return (met.groupBy("owner", "k").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
            .select("owner", "k", fold(F.col("edges"), F.element_at("edges", -1)["e"]).alias("ids")))


# ---------------------------------------------------------------- blocks

_ATOMS = "kind string, owner long, block long, k int, atom string, places binary"


def _requests(table: DataFrame, cutter: Cutter, ranges: int) -> DataFrame:
    """Distinct atoms of each block, cut by hash range."""
    shift = U64(64 - ranges.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                keys, texts = _distinct(cutter, data)
                owner = (keys >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
                cut = np.flatnonzero(np.diff(owner, prepend=-1, append=ranges))
                for a, z in zip(cut, cut[1:]):
                    # in hash order: the place in this list stands for the atom, so the hashes stay here
                    packed = pack(pa.RecordBatch.from_arrays([pa.array(texts[a:z], pa.string())], ["atom"]), LEVEL)
                    yield pa.RecordBatch.from_pylist(
                        [{"owner": int(owner[a]), "block": block, "data": packed}],
                        pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("data", pa.binary())]))

    return table.mapInArrow(run, "owner long, block long, data binary")


def _distinct(cutter: Cutter, data: bytes) -> tuple[np.ndarray, list[str]]:
    """Ascending hashes of a block's distinct atoms, and the atoms."""
    keys, texts = [], []
    for _, points, starts, hashes, _ in cutter(unpacked(data)["text"]):
        unique, first = np.unique(hashes, return_index=True)
        ends = np.append(starts[1:], len(points))
        text = points.astype("<u4").tobytes().decode("utf-32-le") if len(points) else ""
        keys.append(unique)
        texts += [text[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())]
    keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
    unique, first = np.unique(keys, return_index=True)
    return unique, [texts[k] for k in first.tolist()]


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """Distinct atoms of one hash range (kind 'a'), and where each block's atoms are among them (kind 'b')."""
    parts = [unpacked(d) for d in frame["data"]]
    coded = pa.concat_tables(parts)["atom"].combine_chunks().dictionary_encode()
    texts, inverse = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    owner = int(frame["owner"].iloc[0])
    atoms = pd.DataFrame({"kind": "a", "owner": owner, "block": 0, "k": np.arange(len(texts)), "atom": texts, "places": b""})
    sizes = np.cumsum([p.num_rows for p in parts])[:-1]
    places = [_squeezed(x.astype("<u4").tobytes()) for x in np.split(inverse, sizes)]
    return pd.concat([atoms, pd.DataFrame({"kind": "b", "owner": owner, "block": frame["block"], "k": [p.num_rows for p in parts],
                                           "atom": "", "places": places})])


def _squeezed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def _id_type(pieces: int) -> str:
    """The narrowest integers that hold every id."""
    return "<u2" if pieces <= 1 << 16 else "<u4"


def _answers(byte_id: np.ndarray, table: dict[str, tuple[float, int]], id_type: str):
    """Ids of each block's atoms of one hash range: how many each has, and all of them."""
    def run(atoms: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        atoms, spelt = atoms.sort_values("k"), []
        for ids, text in zip(atoms["ids"], atoms["atom"]):
            ids = np.asarray(merged_long(text, table) if text else ids, np.int64)
            if (ids < 0).any():
                ids = np.concatenate([[i] if i >= 0 else byte_id[np.frombuffer(chr(-i - 1).encode(), np.uint8)] for i in ids.tolist()])
            spelt.append(ids)
        size = np.array([len(x) for x in spelt])
        flat, at, out = np.concatenate([*spelt, np.zeros(0, np.int64)]).astype(id_type), np.cumsum(size) - size, []
        for row in wanted.itertuples():
            k = np.frombuffer(pa.decompress(row.places, decompressed_size=4 * row.n_atoms, codec="zstd"), "<u4")
            n = size[k]
            where = np.repeat(at[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((row.block, row.owner, _squeezed(n.astype("<u4").tobytes()), int(len(k)),
                        _squeezed(flat[where].tobytes()), int(n.sum())))
        return pd.DataFrame(out, columns=["block", "owner", "sizes", "n", "ids", "total"])

    return run


def _block_answers(folder: str, block: int, id_type: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's atoms in hash order: first place and number of each, and all ids."""
    import pyarrow.dataset
    where, inner = place(f"{folder}/block={block}")
    rows = pyarrow.dataset.dataset(inner, filesystem=where, format="parquet").to_table().sort_by("owner").to_pylist()
    size = [np.frombuffer(pa.decompress(r["sizes"], decompressed_size=4 * r["n"], codec="zstd"), "<u4") for r in rows]
    width = np.dtype(id_type).itemsize
    ids = [np.frombuffer(pa.decompress(r["ids"], decompressed_size=width * r["total"], codec="zstd"), id_type) for r in rows]
    return (np.concatenate([*size, np.zeros(0, "<u4")]).astype(np.int64), np.concatenate([*ids, np.zeros(0, id_type)]))


def _piece_ids(docs: DataFrame, model: str):
    """The blocks of ``docs``, and a function from a batch of blocks to (rows, ids, bounds of each row's ids), bounded in size."""
    spark, pieces = docs.sparkSession, Pieces.load(model)
    cutter, byte_id, id_type = Cutter(*pieces.joins()), pieces.byte_id, _id_type(len(pieces.strings))
    table = blocks(docs, LEVEL)
    size = table.agg(F.sum(F.length("data"))).first()[0] or 0
    ranges = 1 << max(0, int(2.5 * size / RANGE_BYTES).bit_length())
    met = written(_requests(table, cutter, ranges).groupBy("owner").applyInPandas(_joined, _ATOMS), "atoms")
    atoms = met.where("kind = 'a'").select("owner", "k", "atom")
    short = (F.length("atom") <= LONG) | F.lit(not pieces.ranked)
    ids = (encoded_atoms(atoms.where(short), pieces.table(spark), pieces.longest, pieces.ranked).withColumn("atom", F.lit(""))
           .unionByName(atoms.where(~short).withColumn("ids", F.array().cast("array<int>"))))
    by_string = {p: (float(x), k) for k, (p, x, ok) in enumerate(zip(pieces.strings, pieces.score, pieces.usable)) if ok}
    answers = (ids.groupBy("owner").cogroup(
        met.where("kind = 'b'").select("owner", "block", "k", "places").toDF("owner", "block", "n_atoms", "places").groupBy("owner"))
               .applyInPandas(_answers(byte_id, by_string, id_type), "block long, owner long, sizes binary, n long, ids binary, total long"))
    folder = shared_path(spark, "llm", "piece-ids")
    answers.repartition("block").write.partitionBy("block").parquet(folder)

    def run(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
            texts = unpacked(data)
            cuts = [(i, h, first) for i, _, _, h, first in cutter(texts["text"])]
            hashes = np.concatenate([*(h for _, h, _ in cuts), np.zeros(0, np.uint64)])
            cuts = [(i, len(h), first) for i, h, first in cuts]
            which = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
            if len(hashes):
                n, flat = _block_answers(folder, block, id_type)
            else:
                n, flat = np.zeros(0, np.int64), np.zeros(0, id_type)
            del hashes
            at, done = np.cumsum(n) - n, 0
            for i, m, first in cuts:
                k = which[done: done + m]
                done += m
                total = np.concatenate([[0], np.cumsum(n[k])])
                where = np.repeat(at[k] - total[:-1], n[k]) + np.arange(total[-1])
                yield texts.slice(i, len(first) - 1), flat[where].astype(np.int32), total[first]

    return table, run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text, ids) of every row."""
    table, pieces_of = _piece_ids(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, bounds in pieces_of(batch):
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].combine_chunks(), rows["text"].combine_chunks().cast(pa.string()),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["doc_id", "text", "ids"])

    return table.mapInArrow(run, "doc_id long, text string, ids array<int>")


def decoded_bytes(ids: np.ndarray, bounds: np.ndarray, spelling: tuple) -> list[bytes]:
    """The text of each run ids[bounds[r]:bounds[r + 1]], as UTF-8."""
    pool, at, size = spelling
    n = size[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    data = pool[np.repeat(at[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
    edge = total[bounds].tolist()
    return [data[a + 1: z] if z > a and data[a: a + 1] == b" " else data[a:z] for a, z in zip(edge, edge[1:])]


def decoded(frame: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of the rows (doc_id, ids)."""
    spelling = Pieces.load(model).spelling()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(i, DECODE_ROWS)
                ids = batch.column("ids")
                out = decoded_bytes(ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py(), spelling)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], ["doc_id", "text"])

    return frame.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 of every row."""
    table, pieces_of = _piece_ids(docs, model)
    spelling = Pieces.load(model).spelling()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, bounds in pieces_of(batch):
                wide, at = memoryview(ids.astype("<u4")).cast("B"), (bounds * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].combine_chunks(), pa.array(np.diff(bounds).astype(np.int64)),
                     pa.array([zlib.crc32(wide[a:z]) for a, z in zip(at, at[1:])], pa.int64()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in decoded_bytes(ids, bounds, spelling)], pa.string())],
                    ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return table.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
