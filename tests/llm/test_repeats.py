from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.llm import repeats as R

SCHEMA = "id long, batch_no int, title string, company string, description string, a string"


def posting(rng, n=14):
    return [" ".join(f"w{rng.randint(0, 4000)}" for _ in range(9)) + "." for _ in range(n)]


def expected(rows, least=0.5):
    accepted, out = [], {}
    for i, b, t, c, d, _ in sorted(rows):
        if not d or not R.words_of(d):
            continue
        g, same = R.grams(d), (R.employer(c), R.role(t))
        hits = [(R.overlap(g, h), -j) for j, h, s in accepted if s == same] if b > 0 else []
        best = max(hits, default=(0, 0))
        if best[0] >= least:
            out[i] = -best[1]
        else:
            accepted.append((i, g, same))
    return out


def test_against_brute_force(spark):
    rng = random.Random(0)
    rows, base = [], []
    for i in range(260):
        b = min(5, i // 50)
        kind = rng.random()
        if base and b and kind < 0.45:
            t, c, s = rng.choice(base)
            s = list(s)
            if kind < 0.1:
                rng.shuffle(s)
            elif kind < 0.2:
                s = s[1:]
            elif kind < 0.3:
                s = posting(rng)
            text = ("\n" if kind < 0.15 else " ").join(s)
            rows.append((i, b, rng.choice([t, t.upper(), f"{t} (m/w/d)"]), rng.choice([c, c.replace(" GmbH", ""), c.upper()]), f"<p>{text}</p>" if kind < 0.05 else text, "x"))
        else:
            t, c, s = f"Role{rng.randint(0, 3)}", f"Firm{rng.randint(0, 4)} GmbH", posting(rng)
            base.append((t, c, s))
            rows.append((i, b, t, c, " ".join(s), "x"))
    rows += [(300, 3, "R", "C", None, "x"), (301, 3, "R", "C", "", "x"), (302, 3, None, None, "nur wenige Worte hier", "x"), (303, 4, None, None, "Nur wenige Worte hier!", "x"), (304, 5, "R", "C", "- ?", "x")]
    got = {r.b: r.a for r in R.find_repeats(spark.createDataFrame(rows, SCHEMA), segments=3).collect()}
    assert got == expected(rows)
    assert got[303] == 302


def test_a_third_are_copies_and_chains(spark):
    rng = random.Random(1)
    s = posting(rng)
    rows = [(0, 0, "A", "B", " ".join(s), "x")] + [(i, 1 + i % 5, "A", "B", " ".join(s), "x") for i in range(1, 60)]
    got = {r.b: r.a for r in R.find_repeats(spark.createDataFrame(rows, SCHEMA), segments=3).collect()}
    assert got == dict.fromkeys(range(1, 60), 0)


def test_a_third_are_near_copies_with_slips(spark):
    rng = random.Random(2)
    s = " ".join(posting(rng)).split()
    rows = [(i, 0, "A", "B", " ".join(posting(rng)), "x") for i in range(40)]
    for i in range(40, 940):
        w = list(s)
        for p in rng.sample(range(len(w)), 6):
            w[p] = f"slip{i}x{p}"
        rows.append((i, 1, "A", "B", " ".join(w if i % 3 == 0 else posting(rng)), "x"))
    got = {r.b: r.a for r in R.find_repeats(spark.createDataFrame(rows, SCHEMA), segments=3).collect()}
    assert got == dict.fromkeys(range(45, 940, 3), 42)
    assert got == expected(rows)


def test_shared_in_narrow_blocks():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, n).astype(np.uint32)) for n in (5, 40, 80, 1)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]
    assert R.shared(sets[:3], sets, width=16).tolist() == want


def test_empty_and_history_only(spark):
    df = spark.createDataFrame([(1, 0, "A", "B", "eins zwei drei", "x")], SCHEMA)
    assert R.find_repeats(df).count() == 0
    assert R.find_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 30, 900])
def test_graph_finds_what_exhaustive_search_finds(n):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(n, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = R.Graph.build(v)
    q, node, s = g.search(v)
    top = {}
    for a, b, x in sorted(zip(q.tolist(), node.tolist(), s.tolist()), key=lambda t: -t[2]):
        top.setdefault(a, []).append(b)
    exact = np.argsort(-(v @ v.T), axis=1)[:, :5]
    assert np.mean([len(set(top[i][:5]) & set(e.tolist())) / len(e) for i, e in enumerate(exact)]) >= 0.9


def test_keys():
    assert R.employer("ACME GmbH & Co. KG") == R.employer(" acme ") == "acme"
    assert R.employer("GmbH") == "gmbh"
    assert R.role("Lead Dev / Ops (m/w/d) - Remote 80-100%") == R.role("lead dev, ops") == "lead dev ops"
    assert R.overlap(R.grams("a b a b"), R.grams("a b")) == pytest.approx(1 / 3)


def test_five_calls_on_a_stored_index(spark, tmp_path):
    rng = random.Random(7)
    rows, base = [], []
    for i in range(180):
        if base and rng.random() < 0.5:
            t, c, s = rng.choice(base)
            s = s[1:] if rng.random() < 0.5 else s
        else:
            t, c, s = f"Role{rng.randint(0, 3)}", f"Firm{rng.randint(0, 9)}", posting(rng)
            base.append((t, c, s))
        rows.append((i, i // 30, t, c, " ".join(s), "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "index")
    R.RepeatIndex.create(spark, path, segments=3, layers=3).accept(R.RepeatIndex.load(spark, path).describe(df.where("batch_no = 0")))
    got = {}
    for k in range(1, 6):
        index = R.RepeatIndex.load(spark, path)
        assert len(index.layers) <= 3
        got |= {r.b: r.a for r in index.add_batch(df.where(f"batch_no = {k}")).collect()}
    assert got == expected(rows)
    # an index whose last layer was not entered in the manifest is as before
    before = R.RepeatIndex.load(spark, path)
    before._write(before.describe(df.where("batch_no = 1")), "layer-unfinished")
    assert R.RepeatIndex.load(spark, path).layers == before.layers


def test_a_role_of_an_employer_stands_in_one_chunk(spark, tmp_path, monkeypatch):
    import io

    monkeypatch.setattr(R, "SHARD", 12)
    rng = random.Random(11)
    # one role with more postings than two shards hold, and many with few
    rows = [(i, 0, f"Role {'x' * (i % 16) if i % 2 else 'hot'}", "Firm", " ".join(posting(rng, 3)), "x") for i in range(120)]
    index = R.RepeatIndex.create(spark, str(tmp_path / "index"), segments=1)
    index.accept(index.describe(spark.createDataFrame(rows, SCHEMA)))
    chunks, pieces = {}, {}
    for r in index._read(index.layers[0]).collect():
        with np.load(io.BytesIO(bytes(r.blob))) as z:
            pieces.setdefault(r.chunk, []).append(len(z["ids"]))
            for same in z["same"].tolist():
                chunks.setdefault(same, set()).add(r.chunk)
    assert len(pieces) > 1 and sum(map(sum, pieces.values())) == 120
    assert all(len(c) == 1 for c in chunks.values()) and max(map(len, pieces.values())) > 1
    # each posting is found again, in whichever piece it stands
    again = spark.createDataFrame([(1000 + i, 1, *r[2:]) for i, r in enumerate(rows)], SCHEMA)
    assert {r.b: r.a for r in index.add_batch(again).collect()} == {1000 + i: i for i in range(120)}
