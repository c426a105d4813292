from __future__ import annotations

import zlib

import numpy as np
import pytest

from catalux.llm import token_files
from tests.llm.conftest import DOCS, rows_of


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def expected(rows, path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    start, out = 0, []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(docs, path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    monkeypatch.setattr(token_files, "READ_DOCS", 5)
    got = sorted(tuple(r) for r in token_files.round_trip(docs, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(sorted(rows_of(docs).items()), path)


def test_nulls_ties_empty(spark, empty_docs, path):
    assert token_files.round_trip(empty_docs, path).count() == 0
    df = spark.createDataFrame([(3, "b", "en", "s", 1), (3, "b", "en", "s", 1), (None, None, "en", "s", 0), (-5, "a c", "en", "s", 3)], DOCS)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.round_trip(df, path).collect()), key=lambda r: r[1])
    assert got == [(None, 0, 1), (-5, 1, 3), (3, 4, 2), (3, 6, 2)]


def test_documents_are_read_by_select(docs, path):
    manifest = token_files.write(docs, path, 2)
    row = max(manifest.collect(), key=lambda r: r["docs"])
    file = token_files.TokenFile(row["path"])
    bounds, ids = file.ids_of(1, 2)
    assert ids[-1] == 2 and len(ids) == bounds[1] - bounds[0] and file.about["id_bytes"] == 2
    assert len(file.names_of(0, row["docs"])) == row["docs"]
