"""The numpy parts by themselves, without Spark."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from catalux.llm import suffix_dedup, token_files
from catalux.llm.length_buckets import optimal_boundaries
from catalux.llm.textnp import text_buffer, word_hashes
from tests.llm.conftest import awkward_texts


def test_word_hashes_depend_on_the_word_only():
    texts = ["b a", None, "a", "  a\tb\n", "", "ab", "x" * 3_000_000 + " a"]
    got = {}
    for i, words, first in word_hashes(pa.array(texts)):
        for r in range(len(first) - 1):
            got[i + r] = words[first[r]: first[r + 1]].tolist()
    a = got[2][0]
    assert got[0][1] == a and got[3][0] == a and got[3][1] == got[0][0] and got[6][1] == a
    assert got[1] == got[4] == [] and got[5] != got[0][:1] and got[5][0] != a


def brute_repeats(texts: list[bytes], length: int) -> list[set]:
    seen: dict[bytes, list] = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s: s + length], []).append((d, s))
    out = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                out[d].update(range(s, s + length))
    return out


def test_anchor_windows_are_partitioned():
    texts = [t or "" for t in awkward_texts()]
    buf, off = text_buffer(pa.array(texts))
    row, p, lo, hi, bucket, stretch = suffix_dedup.anchors(buf, off)
    windows = [(r, s) for r, a, z in zip(row, lo, hi) for s in range(a, z + 1)]
    want = [(r, s) for r in range(len(texts)) for s in range(off[r], off[r + 1] - suffix_dedup.LENGTH + 1)]
    assert windows == want
    assert ((p >= lo) & (p <= lo + suffix_dedup.REACH - 1) & (p >= hi)).all()


def test_repeated_starts():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 100, 3000, dtype=np.uint8)
    text[1500:1900] = text[200:600]
    text[2500:2750] = text[1600:1850]
    want = sorted({s for s in range(2801) for t in [bytes(text[s: s + 200])]
                   if bytes(text).find(t) != s or bytes(text).find(t, s + 1) >= 0})
    assert suffix_dedup.repeated_starts(text, np.arange(2801)).tolist() == want


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(0, 100_000, 7)), [0, 10**12, 10**12 + 1, 2 * 10**12],
                                    sorted(random.Random(2).choices(range(10**6), k=3000)), [-(2**62), 0, 2**40]])
def test_elias_fano(values):
    v = np.array(values, dtype=np.int64)
    e = token_files.EliasFano.encode(v)
    e = token_files.EliasFano.from_sections(e.figures(), e.sections())
    assert e.select(0, len(v)).tolist() == values
    for i in range(0, len(v), 97):
        assert e.select(i, min(i + 5, len(v))).tolist() == values[i: i + 5]
    if len(v) > 3000:
        assert len(e.low) + len(e.high) < len(v) * (2 + np.log2((v[-1] + 1) / len(v)) + 1) / 8 + 16


def test_encoder_equals_the_library_on_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rng = random.Random(9)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "ü ", " ß", " ", "　", " ", "日本", "🙂", "'s", "'ll", "12", "!!", "\x85",
                " x", "­", "<|endoftext|>", "\x00", "Ġ", "ł", "ſ", "\x1c", " \n "]
    texts = awkward_texts() + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    enc = token_files.Encoder(path)
    for chunk in (texts, texts[::-1]):
        buf, off = text_buffer(pa.array(chunk))
        ids, n = enc.encode(buf, off)
        at = np.concatenate([[0], np.cumsum(n)])
        for r, e in enumerate(whole.encode_batch([t or "" for t in chunk], add_special_tokens=False)):
            assert ids[at[r]: at[r + 1]].tolist() == e.ids, repr(chunk[r])


def test_boundaries_are_optimal():
    from itertools import combinations
    rng = random.Random(4)
    for _ in range(20):
        lengths = sorted(rng.choices(range(1, 40), k=30))
        values = sorted(set(lengths))
        count = np.array([lengths.count(v) for v in values])
        for k in (1, 2, 3, 50):
            got = optimal_boundaries(np.array(values), count, count * np.array(values), k)

            def padding(ends):
                return sum(next(e for e in ends if e >= x) - x for x in lengths)

            best = min(padding([*c, values[-1]]) for m in range(min(k, len(values))) for c in combinations(values[:-1], m)) \
                if k < 4 else 0
            assert padding(got) == best and len(got) <= k
    assert optimal_boundaries(np.array([]), np.array([]), np.array([]), 3) == []
