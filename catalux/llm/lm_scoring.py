"""LM scoring (operator 5): a weighted backoff automaton over smoothed word bigrams.

States are the root and one state a word seen in training (and the document end, which also begins
documents).  State h has an arc for every word w seen after h, with weight

    P(w | h) = (1 - b) c(h w) / c(h) + b P(w),    P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

and a failure arc of weight b to the root, whose arcs carry P(w); words unknown to the root share the mass of one
word.  b depends on how often h was seen; for each class of counts it is the value, from a grid, that
gives training tokens the highest probability when each is left out of its own counts.

Counts never meet in one place.  Documents are written as blocks of bounded size; every block sends its distinct
words and bigrams, with counts, to the task that owns their hash range (one row a block and range, so a
frequent word costs one entry a block), gets back their totals, builds the states and arcs that its
documents can reach, and traverses each document once from left to right.  Sums are kept for every grid value,
so choosing b needs no further pass.

Defined results: null and empty texts are the end token alone; a row without doc_id is a training row;
without training rows every token has probability 1.  Only doc_id and the text are read.
Words are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalux.llm.tables import held_out, pick, written
from catalux.llm.textnp import U64, mix, segments, text_buffer, word_hashes

END = U64(0x3C6EF372FE94F82B)
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20            # text a hash range
BACKOFF = (0.99, 0.9, 0.7, 0.4, 0.15)
SEEN = (1, 2, 4, 8, 32, 1024)    # classes of c(h): 0, 1, 2-3, 4-7, 8-31, 32-1023, more
CELLS = (len(SEEN) + 1) * len(BACKOFF)


# ---------------------------------------------------------------- blocks

def _packed(batch: pa.RecordBatch, level: int = 1) -> bytes:
    sink = pa.BufferOutputStream()
    codec = pa.Codec("zstd", compression_level=level)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def blocks(docs: DataFrame, level: int = 1) -> DataFrame:
    """(block, data): all rows in packed blocks of about BLOCK_BYTES of text (a longer text is a block of its own)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_pylist([{"block": (part << 32) + seq, "data": _packed(table.to_batches()[0], level)}])

        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            for i, j in segments(off):
                held.append(batch.slice(i, j - i))
                size += int(off[j] - off[i])
                if size >= BLOCK_BYTES:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    rows = pick(docs, doc_id="long", text="string").withColumn("held_out", held_out("doc_id", 5, 1))
    return written(rows.mapInArrow(run, "block long, data binary"), "blocks")


@dataclass
class Tokens:
    """Tokens of a block's documents in order, an end after each document; history is the token before, an end at first."""

    table: pa.Table
    token: np.ndarray
    row: np.ndarray       # document of each token
    train: np.ndarray     # per token

    @staticmethod
    def of(data: bytes) -> "Tokens":
        table = unpacked(data)
        parts, sizes = [], []
        for _, words, first in word_hashes(table["text"]):
            parts.append(np.insert(words, first[1:], END))
            sizes.append(np.diff(first) + 1)
        row = np.repeat(np.arange(table.num_rows), np.concatenate([*sizes, np.zeros(0, np.int64)]))
        held = table["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        return Tokens(table, np.concatenate([*parts, np.zeros(0, np.uint64)]), row, ~held[row])

    @property
    def bigram(self) -> np.ndarray:
        before = np.concatenate([[END], self.token[:-1]])    # the token before a document's first is an end
        return mix(before * U64(0x9FB21C651E98DF25) + self.token)


# ---------------------------------------------------------------- counts

def _requests(table: DataFrame, ranges: int) -> DataFrame:
    """Distinct words (kind 0) and bigrams (kind 1) of each block with their counts in training rows, cut by hash range."""
    shift = U64(64 - ranges.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                t = Tokens.of(data)
                for kind, values in ((0, t.token), (1, t.bigram)):
                    keys, inverse = np.unique(values, return_inverse=True)
                    count = np.bincount(inverse, t.train, len(keys)).astype(COUNT)
                    del inverse
                    owner = (keys >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
                    cut = np.flatnonzero(np.diff(owner, prepend=-1, append=ranges))
                    rows = [(kind, int(owner[a]), block, keys[a:z].tobytes(), _small(count[a:z], COUNT)) for a, z in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                        ["kind", "owner", "block", "keys", "counts"])

    return table.mapInArrow(run, "kind int, owner long, block long, keys binary, counts binary")


# counts of one block fit 32 bits (a text has fewer bytes), totals of the corpus do not
COUNT, TOTAL = np.dtype("<u4"), np.dtype("<u8")


def _small(count: np.ndarray, kind: np.dtype) -> bytes:
    """Unsigned integers, compressed."""
    return pa.compress(count.astype(kind).tobytes(), codec="zstd", asbytes=True) if len(count) else b""


def _large(data: bytes, n: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=kind.itemsize * n, codec="zstd"), kind) if n else np.zeros(0, kind)


_ANSWER = "kind int, owner long, block long, n long, data binary, distinct long, total double"


def _totals(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals of one hash range, sent back to every block in the order of its keys; and how many there are."""
    keys = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
    sizes = [len(k) for k in keys]
    counts = np.concatenate([_large(c, n, COUNT) for c, n in zip(frame["counts"], sizes)])
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, counts, len(unique))
    back = np.split(total[inverse], np.cumsum(sizes)[:-1])
    out = pd.DataFrame({"kind": frame["kind"], "owner": frame["owner"], "block": frame["block"], "n": sizes,
                        "data": [_small(x, TOTAL) for x in back], "distinct": 0, "total": 0.0})
    figures = {"kind": frame["kind"].iloc[0], "owner": frame["owner"].iloc[0], "block": None, "n": 0, "data": b"",
               "distinct": int((total > 0).sum()), "total": float(total.sum())}
    return pd.concat([out, pd.DataFrame([figures])]).astype({"block": "Int64"})


# ---------------------------------------------------------------- automaton

@dataclass
class Automaton:
    """The states and arcs that one block can reach: parallel arrays over its tokens' places.

    ``root``: log10 weight of each token's arc at the root; ``state_seen``: count of the state the token is read in;
    ``arc_seen``: count of the arc, 0 where only the failure arc leads on.
    """

    word_count: np.ndarray
    state_seen: np.ndarray
    arc_seen: np.ndarray
    tokens: float
    words: float

    def weights(self, backoff: float) -> np.ndarray:
        """Probability of each token: its own arc, or the failure arc and then the root's arc."""
        root, known = self.root_weights(), self.state_seen > 0
        return np.where(known, (1 - backoff) * self.arc_seen / np.maximum(self.state_seen, 1) + backoff * root, root)

    def root_weights(self) -> np.ndarray:
        return (self.word_count + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    def classes(self) -> np.ndarray:
        return np.searchsorted(SEEN, self.state_seen, side="right")

    def left_out(self, chosen: np.ndarray) -> "Automaton":
        """The chosen training tokens, each without its own occurrence."""
        return Automaton(self.word_count[chosen] - 1, self.state_seen[chosen] - 1, self.arc_seen[chosen] - 1,
                         self.tokens - 1, self.words)


def _sums(a: Automaton, row: np.ndarray, n: int) -> np.ndarray:
    """(n, CELLS): log10 probability by class of state and grid value, one left-to-right pass over the tokens of each row."""
    cell, out = row * (len(SEEN) + 1) + a.classes(), []
    for b in BACKOFF:
        out.append(np.bincount(cell, np.log10(a.weights(b)), n * (len(SEEN) + 1)).reshape(n, -1))
    return np.stack(out, axis=2).reshape(n, CELLS)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, left_out boolean, sums array<double>"


def _traversed(tokens: float, words: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        t = Tokens.of(frame.loc[frame["kind"] == -1, "data"].iloc[0])
        count = {}
        for kind, values in ((0, t.token), (1, t.bigram)):
            part = frame[frame["kind"] == kind].sort_values("owner")
            have = np.concatenate([_large(d, n, TOTAL) for d, n in zip(part["data"], part["n"])] + [np.zeros(0, TOTAL)])
            count[kind] = have[np.unique(values, return_inverse=True)[1]].astype(float)
        first = np.flatnonzero(np.diff(t.row, prepend=-1))
        seen = np.concatenate([[0.0], count[0][:-1]])
        ends = count[0][t.token == END]
        seen[first] = ends[0] if len(ends) else 0          # the state in which documents begin
        a = Automaton(count[0], seen, count[1], tokens, words)
        n = t.table.num_rows
        out = pd.DataFrame({
            "doc_id": pd.array(t.table["doc_id"].to_pylist(), dtype="Int64"),
            "held_out": t.table["held_out"].to_numpy(),
            "n_tokens": np.bincount(t.row, minlength=n), "n_known": np.bincount(t.row, a.word_count > 0, n).astype(np.int64),
            "base_score": np.bincount(t.row, np.log10(a.root_weights()), n),
            "left_out": False, "sums": list(_sums(a, t.row, n))})
        if t.train.any():
            loo = _sums(a.left_out(t.train), np.zeros(int(t.train.sum()), np.int64), 1)[0]
            out = pd.concat([out, pd.DataFrame([{"doc_id": None, "held_out": False, "n_tokens": 0, "n_known": 0,
                                                 "base_score": 0.0, "left_out": True, "sums": loo}]).astype({"doc_id": "Int64"})])
        return out

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    table = blocks(docs)
    size = table.agg(F.sum(F.length("data"))).first()[0] or 0
    ranges = 1 << max(0, int(2.5 * size / RANGE_BYTES).bit_length())      # packed text is about 0.4 of the text
    answers = written(_requests(table, ranges).groupBy("kind", "owner").applyInPandas(_totals, _ANSWER), "totals")
    words, tokens = answers.where("block is null and kind = 0").agg(F.sum("distinct"), F.sum("total")).first()
    words, tokens = float(words or 0), float(tokens or 0)
    met = (answers.where("block is not null").select("block", "kind", "owner", "n", "data").unionByName(table.select(
        "block", F.lit(-1).alias("kind"), F.lit(-1).cast("long").alias("owner"), F.lit(0).cast("long").alias("n"), "data")))
    rows = written(met.groupBy("block").applyInPandas(_traversed(tokens, words), _SCORED), "scored")
    loo = rows.where("left_out").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(CELLS)]).first()
    best = np.array([x or 0.0 for x in loo]).reshape(-1, len(BACKOFF)).argmax(axis=1)
    score = sum((F.get("sums", F.lit(int(k * len(BACKOFF) + g))) for k, g in enumerate(best)), F.lit(0.0))
    return rows.where("not left_out").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score",
        score.alias("score"))
