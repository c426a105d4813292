"""Quality classifier (operator 10): histogram gradient-boosted trees over document statistics.

* ``document_features``: one row of statistics per text, numpy over Arrow buffers, whole texts.
* ``fit_trees``: boosting on quantile histograms with Newton leaves, on a bounded sample of labelled
  rows (``max_rows``, chosen by a hash of doc_id; the documented bound of what reaches the driver).
* ``Trees``: complete binary trees flattened into arrays; all rows of a batch step down together.

Defined results: null and empty texts have all-zero statistics and get a score like any other text;
labels that are null are not learnt from; without any usable label every score is 0.5; repeated
doc_ids are scored row by row; extra columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalux.llm.tables import held_out, pick
from catalux.llm.textnp import prefix_hash, segments, shingle_hashes, span_hash, text_buffer, word_spans

MAX_FIT_ROWS = 20_000
KEEP_AT = 0.7
DEPTH, ROUNDS, RATE, BINS = 4, 60, 0.15, 64

_CLASSES = ("lower", "upper", "digit", "blank", "newline", "symbol", "bang", "bar", "point", "high", "other")
_CLASS_OF = np.full(256, _CLASSES.index("other"), dtype=np.int64)
for _name, _bytes in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)),
                      ("blank", (9, 11, 12, 13, 32)), ("newline", (10,)), ("symbol", b"#*$%&<>"), ("bang", b"!"),
                      ("bar", b"|"), ("point", b".,;:?'\"()-"), ("high", range(128, 256))):
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)
FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "bangs", "bars", "points", "high",
            "others", "newlines", "blanks", "distinct_words", "repeated_lines", "repeated_shingles", "short_words",
            "long_words")


def document_features(column: pa.Array) -> np.ndarray:
    """(rows, features) of float64; a null or empty text is all zeros."""
    buf, off = text_buffer(column)
    out = np.zeros((len(off) - 1, len(FEATURES)))
    for i, j in segments(off):
        part, rel = buf[off[i]: off[j]], off[i: j + 1] - off[i]
        n_bytes = np.diff(rel)
        kinds = np.bincount(np.repeat(np.arange(j - i) * 16, n_bytes) + _CLASS_OF[part], minlength=16 * (j - i))
        kinds = kinds.reshape(j - i, 16)[:, :len(_CLASSES)].astype(float)
        c = {name: kinds[:, k] for k, name in enumerate(_CLASSES)}
        starts, ends, first = word_spans(part, rel)
        prefix = prefix_hash(part)
        words, length = span_hash(prefix, starts, ends), ends - starts
        line_end = np.flatnonzero(part == 10)
        n_words = np.diff(first)
        total = np.concatenate([[0], np.cumsum(length)])
        short = np.concatenate([[0], np.cumsum(length <= 3)])
        long_ = np.concatenate([[0], np.cumsum(length >= 16)])
        w, letters = np.maximum(n_words, 1), np.maximum(c["lower"] + c["upper"] + c["high"], 1)
        b = np.maximum(n_bytes, 1)
        f = out[i:j]
        f[:, 0], f[:, 1] = np.log1p(n_bytes), np.log1p(n_words)
        f[:, 2] = (total[first[1:]] - total[first[:-1]]) / w
        f[:, 3], f[:, 4] = c["upper"] / letters, c["digit"] / b
        f[:, 5], f[:, 6], f[:, 7], f[:, 8] = c["symbol"] / w, c["bang"] / w, c["bar"] / w, c["point"] / w
        f[:, 9], f[:, 10], f[:, 11], f[:, 12] = c["high"] / b, c["other"] / b, c["newline"] / w, c["blank"] / b
        f[:, 16] = (short[first[1:]] - short[first[:-1]]) / w
        f[:, 17] = (long_[first[1:]] - long_[first[:-1]]) / w
        for r in np.flatnonzero(n_words):
            own = words[first[r]: first[r + 1]]
            f[r, 13] = len(np.unique(own)) / len(own)
            if len(own) > 5:
                grams = shingle_hashes(own, 5)
                f[r, 15] = 1 - len(np.unique(grams)) / len(grams)
            cut = line_end[np.searchsorted(line_end, rel[r]): np.searchsorted(line_end, rel[r + 1])]
            if len(cut):
                a, z = np.concatenate([[rel[r]], cut + 1]), np.concatenate([cut, [rel[r + 1]]])
                a, z = a[z > a], z[z > a]
                f[r, 14] = 1 - len(np.unique(span_hash(prefix, a, z))) / max(len(a), 1)
    return out


@dataclass
class Trees:
    """Flattened complete trees: feature and threshold of every inner node, value of every leaf."""

    base: float
    feature: np.ndarray    # (trees, 2^depth - 1)
    threshold: np.ndarray  # go right where x > threshold; +inf: no split
    value: np.ndarray      # (trees, 2^depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            out += self.value[t, node - inner]
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, rounds: int = ROUNDS, rate: float = RATE,
              bins: int = BINS, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boost ``rounds`` trees of logistic loss on quantile histograms.  Constant when a class is missing."""
    inner, leaves = 2**depth - 1, 2**depth
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(n_features)]
    binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(n_features)], axis=1)
    raw = np.full(len(y), base)
    feature, threshold = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf)
    value = np.zeros((rounds, leaves))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width, start = 2**level, 2**level - 1
            at = node - start
            best = np.full(width, 1e-9)
            for k in range(n_features):
                if not len(edges[k]):
                    continue
                cell = at * (bins + 1) + binned[:, k]
                g = np.bincount(cell, grad, width * (bins + 1)).reshape(width, bins + 1)
                h = np.bincount(cell, hess, width * (bins + 1)).reshape(width, bins + 1)
                gl, hl = g.cumsum(1)[:, :len(edges[k])], h.cumsum(1)[:, :len(edges[k])]
                gs, hs = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gr, hr = gs - gl, hs - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hr < least)] = 0
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                for q in np.flatnonzero(top > best):
                    best[q] = top[q]
                    feature[t, start + q], threshold[t, start + q] = k, edges[k][cut[q]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        raw += value[t, leaf]
    return Trees(base, feature, threshold, value)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Trees:
    """Fit on labelled rows whose crc32(doc_id) mod 4 is not 2; at most about ``max_rows`` of them, by hash of doc_id."""
    known = (pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null")
             .where(~held_out("doc_id", 4, 2)))
    share = max_rows / max(known.count(), max_rows)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # at most about max_rows rows of 12 bytes: a proven bound for the broadcast
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id").select("text", "quality")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = document_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float64())), batch.column("quality").cast(pa.int32())], ["x", "y"])

    got = rows.mapInArrow(features, "x array<double>, y int").toArrow()
    if got.num_rows == 0:
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1))
    y = (got["y"].to_numpy() == 1).astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows arrive in
    return fit_trees(x[order], y[order])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(document_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s),
                 pa.array((s >= KEEP_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return (pick(docs, doc_id="long", text="string").withColumn("held_out", held_out("doc_id", 4, 2))
            .mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, model: Trees, text: str = "text", at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``at``, all columns unchanged."""
    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(document_features(batch.column(place)))
            yield batch.filter(pa.array(s >= at))

    return docs.mapInArrow(kept, docs.schema)
