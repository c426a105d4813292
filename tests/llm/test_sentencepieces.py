from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalux.llm import sentencepieces as S
from tests.llm.conftest import rows_of


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_ids_equal_the_library_and_decode_to_the_text(docs, path, monkeypatch):
    import sentencepiece
    monkeypatch.setattr("catalux.llm.lm_scoring.BLOCK_BYTES", 20_000)
    monkeypatch.setattr(S, "RANGE_BYTES", 20_000)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    by_id = rows_of(docs)
    got = {r["doc_id"]: r for r in S.round_trip(docs, path).collect()}
    assert set(got) == set(by_id)
    for i, t in by_id.items():
        ids = model.encode(t or "")
        assert got[i]["n_ids"] == len(ids) and got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()), t
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode(docs, path):
    by_id = rows_of(docs)
    got = {r["doc_id"]: r["text"] for r in S.decoded(S.encoded(docs, path), path).collect()}
    assert got == {i: t or "" for i, t in by_id.items()}


def test_viterbi_fold(spark):
    """A unigram table against the best of all segmentations."""
    rng = random.Random(6)
    table = {"".join(rng.choices("abc", k=rng.randint(1, 3))): -rng.random() * 5 for _ in range(25)}
    names = sorted(table)
    pieces = spark.createDataFrame([(p, k, table[p]) for k, p in enumerate(names)], "piece string, id int, score double")
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 8))) for _ in range(60)]
    atoms = spark.createDataFrame([(k % 3, k, w) for k, w in enumerate(words)], "owner long, k int, atom string")
    got = {r["k"]: r["ids"] for r in S.encoded_atoms(atoms, pieces, 3, False).collect()}

    def score(ids, word):
        assert "".join(names[i] if i >= 0 else chr(-i - 1) for i in ids) == word
        return sum(table[names[i]] if i >= 0 else S.NO_PIECE for i in ids)

    def best(word):
        if not word:
            return 0.0
        return max((table.get(word[:n], S.NO_PIECE if n == 1 else -1e9)) + best(word[n:]) for n in (1, 2, 3) if n <= len(word))

    for k, w in enumerate(words):
        assert abs(score(got[k], w) - best(w)) < 1e-9


def test_both_merge_forms_agree(spark):
    rng = random.Random(8)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(60)} | set("abc"))
    ranks = list(range(len(names)))
    rng.shuffle(ranks)
    table = {p: (-float(r), k) for k, (p, r) in enumerate(zip(names, ranks))}
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 14))) for _ in range(150)]
    pieces = spark.createDataFrame([(p, k, s) for p, (s, k) in table.items()], "piece string, id int, score double")
    atoms = spark.createDataFrame([(k % 3, k, w) for k, w in enumerate(words)], "owner long, k int, atom string")
    got = {r["k"]: r["ids"] for r in S.encoded_atoms(atoms, pieces, 4, True).collect()}
    assert all(got[k] == S.merged_long(w, table) for k, w in enumerate(words))


def test_empty(empty_docs, path):
    assert S.round_trip(empty_docs, path).count() == 0
