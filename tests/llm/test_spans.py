from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.spans import _bit_map, _hashes, _points, _sliding_min, shared_share, shared_spans, super_kmers


def brute(docs, k):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - k + 1):
            where.setdefault(t[i : i + k], set()).add(d)
    out = {}
    for d, t in docs:
        cover = set()
        for i in range(len(t or "") - k + 1):
            if len(where[t[i : i + k]]) > 1:
                cover.update(range(i, i + k))
        if cover:
            out[d] = len(cover)
    return out


def corpus(seed, n=60, alphabet="abcdefgh äß😀"):
    rng = random.Random(seed)
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 90))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(parts) if rng.random() < 0.4 else "".join(rng.choice(alphabet) for _ in range(40)) for _ in range(rng.randint(1, 5)))) for i in range(n)]
    return docs + [(n, docs[0][1]), (n + 1, docs[0][1]), (n + 2, None), (n + 3, ""), (n + 4, "ab" * 200), (n + 5, "ab" * 150 + "c"), (n + 6, "a" * 300)]


@pytest.mark.parametrize("chunk", [2000, 3])
def test_against_brute_force(spark, chunk):
    docs = corpus(1)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, mini string")
    got = {r.doc_id: r.shared_chars for r in shared_share(shared_spans(df, k=50, m=9, chunk=chunk)).collect()}
    assert got == brute(docs, 50)


def test_a_third_share_one_passage(spark):
    rng = random.Random(2)
    same = "".join(rng.choice("abcdef") for _ in range(200))
    docs = [(i, "".join(rng.choice("abcdef") for _ in range(100)) + (same if i % 3 == 0 else "") + "".join(rng.choice("abcdef") for _ in range(100))) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.shared_chars for r in shared_share(shared_spans(df, k=60, m=9, chunk=10)).collect()}
    assert got == brute(docs, 60)


def test_empty(spark):
    assert shared_share(shared_spans(spark.createDataFrame([], "doc_id long, text string"), k=50, m=9)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab😀", min_size=0, max_size=120))
def test_super_kmers_hold_every_window_once(text):
    seen = [i for _, a, b in super_kmers(text, 20, 5) for i in range(a, b - 19)]
    assert seen == list(range(len(text) - 19))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 8))
def test_hash_depends_on_content_alone(text, k):
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    h = _hashes(_points(text), k)
    by = {}
    for i, x in enumerate(h.tolist()):
        assert by.setdefault(text[i : i + k], x) == x
    assert len(set(by.values())) == len(by)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 50, 97).astype(np.uint64)
    for w in (1, 2, 7, 97):
        assert _sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(98 - w)]


@pytest.mark.parametrize("bits", [64, 1 << 17])
def test_bit_map(spark, bits):
    minis = [0, 1, 5, 63, 64, 2**17 - 1, -1, -(2**63), 2**63 - 1]
    got = _bit_map(spark.createDataFrame([(x,) for x in minis], "mini long"), bits)
    assert {i for i in range(bits) if got[i >> 3] >> (i & 7) & 1} == {x % bits for x in minis}
