from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.llm.leaks import WalkEmbedding, find_leaks, needle_texts, repetitions, word_forms, words_of

WORDS = [f"wort{i}" for i in range(300)]


@pytest.mark.parametrize(
    "a, b",
    [
        ("Größe", "GROESSE"), ("Größe", "Grosse"), ("café", "CAFÉ"), ("Ma­schi​ne", "Maschine"), ("&#252;ber &amp; &lt;b&gt;x", "über x"),
        ("<p>eins</p>zwei", "eins zwei"), ("k<b>ur</b>z", "kurz"), ("a_b-c", "a b c"), ("säen", "saeen"),
    ],
)
def test_words(a, b):
    assert words_of(a) == words_of(b)
    assert any(x == y for x in word_forms(a) for y in word_forms(b))


def test_words_that_only_look_alike():
    assert word_forms("does") != word_forms("dos") and word_forms("Israel") != word_forms("Isral")
    assert word_forms("Müll") == [["mull"], ["muell"]] and word_forms("Mull") == [["mull"]]
    assert word_forms("Mu\u0308ll") == word_forms("Mü\u00adll") == word_forms("Müll")


def test_repetitions_reach_their_target():
    assert repetitions(12, 0, 6, 0.98) == 1
    assert repetitions(24, 1, 6, 0.9) < repetitions(24, 2, 6, 0.9) < repetitions(24, 2, 6, 0.98)
    r = repetitions(24, 2, 6, 0.98)
    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**63, (1000, 24), dtype=np.uint64)
    b = a.copy()
    for row in b:
        row[rng.choice(24, 2, replace=False)] = rng.integers(1, 2**63, 2, dtype=np.uint64)
    walk, at = WalkEmbedding(24, r, 6), np.arange(1000) * 24
    assert (walk.keys(a.ravel(), at) == walk.keys(b.ravel(), at)).any(0).mean() >= 0.95


def test_no_words():
    assert words_of(None) == words_of("") == words_of("--- ... <br>") == []
    assert word_forms(None) == word_forms("") == word_forms("--- ... <br>") == []


def test_against_brute_force(spark):
    rng = random.Random(0)
    items = {str(k): [rng.choice(WORDS) for _ in range(rng.choice([5, 12, 40]))] for k in range(30)}
    docs = {}
    for d in range(200):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            s = rng.choice(list(items.values()))
            n = rng.randint(8, 16)
            a = rng.randint(0, max(0, len(s) - n))
            w[10:10] = s[a : a + n]
        docs[d] = w
    has = lambda w, s: any(s[i : i + 12] == w[j : j + 12] for i in range(len(s) - 11) for j in range(len(w) - 11))
    want = {(d, k) for d, w in docs.items() for k, s in items.items() if has(w, s)}
    df = spark.createDataFrame([(d, rng.choice([" ", ", ", "<br>"]).join(w).upper(), "x") for d, w in docs.items()] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(k, " ".join(s)) for k, s in items.items()] + [("n", None), ("e", "")], "item_id string, text string")
    for batch in (4000, 7):
        assert {(r.doc_id, r.item_id) for r in find_leaks(df, it, batch_items=batch).collect()} == want
    assert find_leaks(df.limit(0), it).count() == 0 and find_leaks(df, it.limit(0)).count() == 0


def test_edited_passages(spark):
    rng = random.Random(1)
    item = [rng.choice(WORDS) for _ in range(60)]
    docs = []
    for d in range(40):
        w = [rng.choice(WORDS) for _ in range(30)] + item + [rng.choice(WORDS) for _ in range(30)]
        for p in rng.sample(range(30, 90), 4):
            w[p] = "anders"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    assert find_leaks(df, it, window=24, max_edits=2, target_recall=1.0).count() == 40
    assert find_leaks(df, it, window=24, max_edits=2, target_recall=0.98).count() >= 39


def test_edited_passages_against_brute_force(spark):
    rng = random.Random(4)
    items = {str(k): [rng.choice(WORDS) for _ in range(rng.choice([23, 24, 24, 40]))] for k in range(12)}
    docs = {}
    for d in range(120):
        k = rng.choice(list(items))
        s = list(items[k][-24:])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = "anders"
        if rng.random() < 0.5:
            del s[rng.randrange(len(s))]
            s.insert(rng.randrange(len(s) + 1), "neu")
        docs[d] = [rng.choice(WORDS) for _ in range(rng.randint(0, 9))] + s + [rng.choice(WORDS) for _ in range(rng.randint(0, 9))]

    def distance(x, y):
        prev = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            cur = [i]
            for j, b in enumerate(y, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
            prev = cur
        return prev[-1]

    want = {}
    for d, w in docs.items():
        for k, s in items.items():
            e = min((distance(w[i : i + 24], s[j : j + 24]) for i in range(len(w) - 23) for j in range(len(s) - 23) if set(w[i : i + 24]) & set(s[j : j + 24])), default=99)
            if e <= 2:
                want[d, k] = e
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(k, " ".join(s)) for k, s in items.items()], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in find_leaks(df, it, window=24, max_edits=2, target_recall=1.0).collect()}
    assert got == want and {0, 1, 2} <= set(want.values())
    sampled = {(r.doc_id, r.item_id): r.edits for r in find_leaks(df, it, window=24, max_edits=2, target_recall=0.98).collect()}
    assert len(sampled.keys() & want.keys()) >= 0.95 * len(want) and sampled.keys() <= want.keys()


def test_needle_without_detail(spark):
    n = spark.createDataFrame([("a", None), ("b", "{}"), ("c", '{"stellenangebotsBeschreibung": "x"}'), ("d", "kein json")], "id string, detail string")
    assert [tuple(r) for r in needle_texts(n).collect()] == [("c", "x")]
