"""Embedding (V8) as a partition-wise Arrow transform.

Text is truncated JVM-side (X30) and its sha1 computed JVM-side; Python
sees Arrow batches only.  The embedder is pluggable: any callable mapping a
list of strings to an (n, dim) float32 array, created once per Python
worker (``make_embedder`` is pickled, not the model).  Without one, the
deterministic hash embedder is used: seed = first 8 bytes of sha1(text)
XOR a fixed seed, ``dim`` standard normals, unit-normalised.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalux.functions import fixed
from catalux.functions.text import truncate_text

HASH_DIM = 384
_WORKER_MODELS: dict = {}
MAX_WORKER_MODELS = 2


def hash_vectors(sha1_hex: list, dim: int, seed: int = fixed.HASH_EMBED_SEED) -> np.ndarray:
    out = np.zeros((len(sha1_hex), dim), dtype=np.float32)
    for i, h in enumerate(sha1_hex):
        if h is None:
            continue
        rng = np.random.default_rng(int(h[:16], 16) ^ seed)
        v = rng.normal(0, 1, dim).astype(np.float32)
        n = np.linalg.norm(v)
        out[i] = v if n == 0 else v / n
    return out


def _embed_isolated(model, texts: list) -> tuple[pa.Array, list]:
    """Embed a batch; if the model fails, retry row by row so one bad row cannot sink the batch.

    Rows that still fail get an empty vector and their error's text; the
    sync job records it (R2) and they are retried on the next run.
    """
    try:
        vecs = np.asarray(model(texts), dtype=np.float32)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * (vecs.shape[1] if len(texts) else 0)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(vecs.reshape(-1))), [None] * len(texts)
    except Exception:  # noqa: BLE001 - isolate the failing rows
        out, errors = [], []
        for t in texts:
            try:
                out.append(np.asarray(model([t]), dtype=np.float32)[0].tolist())
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                out.append([])
                errors.append(f"{type(e).__name__}: {e}")
        return pa.array(out, type=pa.list_(pa.float32())), errors


def embed_frame(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = HASH_DIM,
                make_embedder: Callable[[], Callable[[list], np.ndarray]] | None = None,
                max_chars: int = fixed.EMBED_MAX_CHARS, error_col: str | None = None) -> DataFrame:
    """Append ``out_col`` (array<float>, unit length) computed from ``text_col``; and ``error_col`` (NULL: none), if named."""
    cols = df.columns
    staged = df.select("*", truncate_text(text_col, max_chars).alias("_embed_in"),
                       F.sha1(truncate_text(text_col, max_chars).cast("binary")).alias("_embed_sha1"))
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType(), False))]
                              + ([T.StructField(error_col, T.StringType())] if error_col else []))
    # a name of its own for each call: a worker that serves several jobs never mixes up their models
    key = uuid.uuid4().hex

    def kernel(batches):
        model = None
        if make_embedder is not None:
            model = _WORKER_MODELS.get(key)
            if model is None:
                while len(_WORKER_MODELS) >= MAX_WORKER_MODELS:
                    _WORKER_MODELS.pop(next(iter(_WORKER_MODELS)))
                model = _WORKER_MODELS.setdefault(key, make_embedder())
        for rb in batches:
            texts = rb.column(rb.schema.get_field_index("_embed_in")).to_pylist()
            errors = [None] * len(texts)
            if model is not None:
                arr, errors = _embed_isolated(model, [t or "" for t in texts])
            else:
                vecs = hash_vectors(rb.column(rb.schema.get_field_index("_embed_sha1")).to_pylist(), dim)
                flat = pa.array(vecs.reshape(-1), type=pa.float32())
                arr = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32)), flat)
            fields = [rb.column(rb.schema.get_field_index(c)) for c in cols]
            more = [pa.array(errors, pa.string())] if error_col else []
            yield pa.RecordBatch.from_arrays(fields + [arr, *more], names=cols + [out_col] + ([error_col] if error_col else []))
    return staged.mapInArrow(kernel, out_schema)
