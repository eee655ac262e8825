from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import derive, discovery, series


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>eins</p><p>zwei &amp; drei</p>", "eins zwei & drei"), ("&lt;b&gt;fett&lt;/b&gt; Text", "fett Text"), ("<script>x()</script>a<style>b</style>", "a"),
        ("un<b>ter</b>brochen", "unterbrochen"), ("", None), (None, None), ("<br>", None), ("<p>offen", "offen"), ("a < b", "a < b"),
    ],
)
def test_html(page, want):
    assert derive.html_text(page) == want


def test_terms_and_places(spark):
    df = spark.createDataFrame([("Senior Lead Dev", "Wien; Graz oder  Linz | ; "), ("Praktikum", None), (None, ""), ("internal auditor", "Oderberg")], "t string, p string")
    got = [tuple(r) for r in df.select(derive.first_term("t", derive.SENIORITY), derive.places_named("p")).collect()]
    assert got == [("lead", ["Wien", "Graz", "Linz"]), ("intern", []), ("unknown", []), ("unknown", ["Oderberg"])]


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, None), (2, "abc"), (3, "abd"), (4, "abc"), (5, "")], "id long, text string")
    v = {r.id: np.array(r.vec) for r in derive.embed(rows, 64).collect()}
    assert all(len(x) == 64 and np.linalg.norm(x) == pytest.approx(1, abs=1e-5) for x in v.values())
    assert (v[2] == v[4]).all() and (v[1] == v[5]).all()
    assert abs(float(v[2] @ v[3])) < 0.5
    long = spark.createDataFrame([(1, "x" * 5000 + "a"), (2, "x" * 5000 + "b")], "id long, text string")
    a, b = [np.array(r.vec) for r in derive.embed(long, 64).orderBy("id").collect()]
    assert abs(float(a @ b)) < 0.5


RULES = (("boards.example", "b"), ("one.example", "o"))


def test_boards(spark):
    urls = ["https://acme.boards.example/1", "https://boards.example/de/acme/1", "https://www.boards.example", "http://one.example/x?y=ab", "https://else.where/", "kein link", None, "https://notboards.example/"]
    got = [tuple(r.r) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(discovery.resolve_board("u", RULES).alias("r")).collect()]
    assert got == [("board", "b", "acme"), ("board", "b", "acme"), ("no_board", "b", None), ("board", "o", "x"), ("unknown_host", None, None), ("no_url", None, None), ("no_url", None, None), ("unknown_host", None, None)]


def test_tokens(spark):
    df = spark.createDataFrame([("https://x.y/jobs/7/a1?gh=123&z=4#f", "s"), (None, None)], "u string, s string")
    got = [r[0] for r in df.select(discovery.id_tokens("u", "s")).collect()]
    assert got[0] == ["jobs", "a1", "123", "s:jobs", "s:a1", "s:123"]


def test_copies(spark):
    rows = [(3, "Dev (m/w)", "A GmbH", ["Wien", "Graz"]), (1, "dev m w", "a-gmbh", ["GRAZ"]), (2, "Dev", "A GmbH", ["Graz"]), (4, None, "A", ["Graz"]), (5, "Dev (m/w)", "A GmbH", []), (6, "Dev m w", "AGmbH", None)]
    got = {tuple(r) for r in discovery.link_copies(spark.createDataFrame(rows, "id long, title string, company string, places array<string>")).collect()}
    assert got == {(3, 1), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)}


def test_plan(spark):
    rows = [("a", "x", i % 4) for i in range(40)] + [("a", "y", 1)] * 3 + [("b", "z", 1)] * 5
    got = {tuple(r) for r in discovery.plan_scans(spark.createDataFrame(rows, "s string, c string, n int"), ["s", "c", "n"], 10).collect()}
    assert got == {(1, "b", None, None, 5), (2, "a", "y", None, 3)} | {(3, "a", "x", k, 10) for k in range(4)}


def test_delta(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("b", 1, 3), ("c", None, 4)], "k string, t int, id int")
    assert [tuple(r) for r in discovery.delta_window(df, "k", "t", F.lit(4), "id").collect()] == [("a", 2, 7)]


def test_set_changes_and_usual(spark):
    df = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 2), ("d2", 2), ("d2", 3), ("d4", 1)], "day string, u int")
    assert sorted(map(tuple, series.set_changes(df, "day", "u").collect())) == [("d2", 1, 1), ("d4", 1, 2)]
    out = series.against_previous(df, F.col("day"), F.count("*"), 2).orderBy("day").collect()
    assert [(r.n, r.usual) for r in out] == [(2, None), (3, 2.0), (1, 2.5)]


def test_until_weak(spark):
    rows = [("q", i + 1, 90.0 if i < 2 or i == 5 else 10.0) for i in range(20)] + [("n", 1, None), ("n", 2, None)]
    df = spark.createDataFrame(rows, "q string, place int, score double")
    got = {r.q: r.n for r in series.until_weak(df, ["q"], "place", "score", 2, 30.0).groupBy("q").agg(F.count("*").alias("n")).collect()}
    assert got == {"q": 10, "n": 2}


def test_hashed_embeddings_take_whole_texts(spark, tmp_path):
    from millrace.plans import derived

    rows = [(k, "T", "C", "L", "wort " * 300 + end) for k, end in ((1, "eins"), (2, "zwei"))]
    spark.createDataFrame(rows, "id long, title string, company string, location_text string, description string").write.parquet(f"{tmp_path}/job.parquet")
    got = {(r.id, r.i): r.x for r in derived.hashed_embeddings(spark, str(tmp_path)).collect()}
    a, b = [[got[k, i] for i in range(64)] for k in (1, 2)]
    assert len(got) == 128 and a != b
