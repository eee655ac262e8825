"""Small cases of the core operators: nulls, ties, empty tables, clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.numbers import wilson
from millrace.io import bounded, cut
from millrace.operators import archive, evaluation, joins, retrieval, series, spatial, tables
from millrace.sources import files, payloads


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr).first()[0]


def test_text(spark):
    assert one(spark, T.fold("x"), "MÜNCHEN Straße Łódź") == "munchen strasse łodz"
    assert one(spark, T.normalise("x"), "  WPP—Media!! ") == "wpp media"
    assert one(spark, T.collapse("x"), " \t\xa0 ") is None
    assert one(spark, T.fold("x"), None) is None
    assert one(spark, T.tokens("x"), None) == []
    assert one(spark, T.urls_in("x"), "see [https://x.y/p/1a2b.] and https://x.y/p/1a2b, http://z?q=1!") == ["https://x.y/p/1a2b", "http://z?q=1"]
    assert one(spark, T.site("x"), "https://Jobs.Example.org:80/a") == "example.org"
    assert one(spark, T.host("x"), "not a url") is None


def test_pairing_key_ignores_spelling(spark):
    df = spark.createDataFrame([("Dev (m/w)", "WPP Media", None), ("dev m w", "wppmedia", None), ("Dev", "Ddome GmbH", "ddome"), ("Dev", "DataDome", "ddome"), ("Dev", "Ddome GmbH", None)], "t string, c string, b string")
    k = [r[0] for r in df.select(T.pairing_key("t", "c", "b")).collect()]
    assert k[0] == k[1] and k[2] == k[3] and k[3] != k[4]


def test_wilson(spark):
    df = spark.createDataFrame([(1, 1), (20, 40), (0, 0)], "h int, n int")
    low, high = wilson(F.col("h"), F.col("n"))
    (a, b), (c, d), none = [tuple(r) for r in df.select(low, high).collect()]
    assert b == 1 and a < 0.3 and 0.35 < c < 0.5 < d < 0.65
    assert none == (None, None)


def test_dense_topk_ties_nulls_and_spaces(spark):
    schema = "id long, vec array<float>, q string"
    c = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [0.0, 1.0], "x"), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [1.0], "x"), (7, [float("nan"), 1.0], "x")], schema)
    q = c.select(F.col("id").alias("q"), "vec")
    got = rows(retrieval.dense_topk(q, c, 2))
    assert got == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)]
    assert retrieval.dense_topk(q.limit(0), c, 2).count() == 0


def test_lexical_needs_all_words(spark):
    d = spark.createDataFrame([(1, "Senior Ingenieur", "Bau"), (2, "Ingenieur", "senior senior"), (3, None, None), (4, "Ingenieur", "")], "id long, title string, body string")
    q = spark.createDataFrame([(9, "SENIOR ingenieur"), (8, ""), (7, None), (6, "ingenieur fehlt")], "q long, text string")
    assert rows(retrieval.lexical_topk(q, d, {"title": 10, "body": 1})) == [(9, 1, 20, 1), (9, 2, 12, 2)]


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", x, p) for p, x in enumerate([10, 20, 30], 1)] + [(1, "b", x, p) for p, x in enumerate([30, 40, 50], 1)], "q long, arm string, id long, pos int")
    assert retrieval.fuse(lists).orderBy("pos").first().id == 30
    assert rows(retrieval.best_ranks(lists)) == [(1, 10, 1), (1, 20, 2), (1, 30, 1), (1, 40, 2), (1, 50, 3)]
    assert retrieval.fuse(lists.limit(0)).count() == 0


def test_counterfactual(spark):
    pool = spark.createDataFrame([(1, i, d) for i, d in enumerate([0.1, 0.2, 0.5])], "q long, id long, dist double")
    p = spark.createDataFrame([(1, 8, 0.3), (1, 9, 0.05), (2, 7, 0.1)], "q long, id long, dist double")
    assert rows(retrieval.counterfactual(pool, p, 2)) == [(1, 8, None), (1, 9, 1), (2, 7, 1)]


def test_counterfactual_places_of_more_queries_than_a_block(spark, tmp_path):
    from millrace.plans import reference

    n = 4400
    ids = spark.range(n).select((F.col("id") * 50).alias("vec_id")).union(spark.range(n).where(f"id < 200 OR id >= {n - 200}").select(F.col("id") * 50 + 1))
    e = ids.select("vec_id", F.array(F.cos("vec_id"), F.sin("vec_id")).cast("array<float>").alias("embedding"))
    e.repartition(8).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r.q for r in reference.counterfactual_places(spark, str(tmp_path)).collect()]
    assert sorted(got) == [50 * k for k in range(n) if k < 200 or k >= n - 200]


def test_measures(spark):
    r = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "q long, id long, pos int")
    w = spark.createDataFrame([(1, 6), (1, 6), (1, 9)], "q long, id long")
    assert rows(evaluation.recall_and_mrr(r, w, (1, 2))) == [(1, 2, 0.0, 0.5, 0.25)]
    back = spark.createDataFrame([(1, 7, 1), (1, 6, 2), (1, 5, 3)], "q long, id long, pos int")
    assert rows(evaluation.spearman(r, back)) == [(1, 3, -1.0)]
    assert rows(evaluation.jaccard(r, back, 2)) == [(1, pytest.approx(0.333333))]
    lab = spark.createDataFrame([(1, 5, False), (1, 6, True), (1, 7, True)], "q long, id long, good boolean")
    assert rows(evaluation.inversions(r, lab)) == [(1, 2, -2)]


def test_upserts(spark):
    cur = spark.createDataFrame([(1, "a", "k"), (2, "b", None), (None, "n", "n")], "k long, v string, first string")
    new = spark.createDataFrame([(2, "B", "z"), (3, "c", "y")], "k long, v string, first string")
    assert rows(tables.upsert(cur, new, ["k"], keep=["first"]).where("k IS NOT NULL")) == [(1, "a", "k"), (2, "B", "z"), (3, "c", "y")]
    assert rows(tables.insert_absent(cur.where("k IS NOT NULL"), new, ["k"]).select("k", "v")) == [(1, "a"), (2, "b"), (3, "c")]
    assert tables.upsert(cur.limit(0), new.limit(0), ["k"]).count() == 0


def test_keyset_pages_walk_both_ways(spark):
    df = spark.createDataFrame([(i, float(i // 2)) for i in range(10)], "id int, s double")
    first = tables.keyset_page(df, "s", "id", 4).collect()
    nxt = tables.keyset_page(df, "s", "id", 4, after=(first[-1].s, first[-1].id)).collect()
    assert [r.id for r in first + nxt] == [9, 8, 7, 6, 5, 4, 3, 2]
    assert tables.keyset_page(df, "s", "id", 4, before=(nxt[0].s, nxt[0].id)).collect() == first


def test_series(spark):
    e = spark.createDataFrame([(1, "2026-01-01", False), (2, "2026-01-02", True), (3, "2026-01-03", True), (4, "2026-01-03", None)], "id long, d string, f boolean").withColumns({"at": F.to_timestamp("d"), "k": F.lit("a")})
    s = series.streaks(e.where("id < 4"), ["k"], "at", "id", F.col("f")).first()
    assert (s.streak, s.flagged) == (2, 2)
    assert [tuple(r) for r in series.islands(e, ["k"], ["id"], F.col("f")).select("rows", "first", "last").collect()] == [(2, 2, 3)]
    out = series.daily_series(e, F.to_date("at"), {"n": F.count("*")}, "2026-01-01", "2026-01-05", 2).orderBy("day").collect()
    assert [(r.n, r.n_trailing) for r in out] == [(1, 1), (1, 2), (2, 3), (None, 2), (None, None)]
    assert series.median_of_last(e, ["k"], "at", "id", F.col("id"), 3).first().median == 3


def test_spatial(spark):
    p = spark.createDataFrame([(1, "Wien", 48.2, 16.37, 100, ["Vienna"]), (2, "Mödling", 48.085, 16.283, 10, None), (3, "Graz", 47.07, 15.44, 50, []), (4, "Nirgends", None, None, 1, [])], "id int, name string, lat double, lon double, population int, alternates array<string>")
    assert [r.id for r in spatial.nearby(p.where("id = 1"), p, 30).orderBy("id").collect()] == [1, 2]
    q = spark.createDataFrame([("Vie",), ("mö",), ("x",), (None,)], "prefix string")
    assert rows(spatial.suggest(q, p)) == [("Vie", 1, 1), ("mö", 2, 1)]


def test_asof_and_range(spark):
    left = spark.createDataFrame([("a", 5, "l"), ("a", 0, "l"), ("b", 5, "l")], "k string, t int, tag string")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 3, 2.0), ("a", 9, 3.0)], "k string, t int, v double")
    assert rows(joins.asof_join(left, right, ["k"], "t", "v").select("k", "t", "v")) == [("a", 0, None), ("a", 5, 1.0), ("b", 5, None)]
    pts = spark.createDataFrame([(i,) for i in range(10)], "p long")
    spans = spark.createDataFrame([(2, 5, "x"), (4, 4, "empty"), (0, 30, "y")], "a long, b long, n string")
    assert joins.range_join(pts, spans, "p", "a", "b", 4).where("n = 'x'").count() == 3
    assert joins.range_join(pts, spans, "p", "a", "b", 4).count() == 13


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01-01 10:00:00"), (2, "2026-01-02 10:00:00"), (3, "2026-01-05 10:00:00"), (4, None)], "id long, s string").withColumn("at", F.to_timestamp("s"))
    days = archive.frozen_days(df, "at", "2026-01-05", 0)
    archive.export_days(df, "at", days, str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert sorted(r.id for r in back.collect()) == [1, 2]
    assert archive.frozen_days(df, "at", "2026-01-06", 0, existing=back.select("day").distinct()).count() == 1


def test_sources(spark, tmp_path):
    docs = [
        (1, "greenhouse", "A ", "listing", '{"title": " Dev\\u00a0 ", "company_name": "X", "location": {"name": "Wien"}, "salary_from": 5.5, "full_time": true}'),
        (2, "personio", "b", "listing", '{"name": "Op", "subcompany": "Y", "office": "Graz", "salary": null, "schedule": "part-time"}'),
        (3, "arbeitsagentur", "c", "listing", '{"stellenangebotsTitel": "Koch", "firma": "Z", "stellenlokationen": [{"adresse": {"ort": "Linz"}}]}'),
        (4, "greenhouse", "d", "listing", "broken"),
        (5, "nobody", "e", "listing", "{}"),
        (6, "greenhouse", "a", "detail", '{"description": "text"}'),
    ]
    df = spark.createDataFrame(docs, "id long, source string, external_id string, kind string, payload string").withColumn("fetched_at", F.current_timestamp())
    got = {r.id: r for r in payloads.merge_details(payloads.read_listings(df), df).collect()}
    assert (got[1].title, got[1].place, got[1].salary_from, got[1].full_time, got[1].description) == ("Dev", "Wien", 5.5, True, "text")
    assert (got[2].title, got[2].full_time) == ("Op", False)
    assert got[3].place == "Linz" and got[4].title is None and got[5].title is None
    (tmp_path / "b.xml").write_text("<jobs><position><id>1</id><name>A</name></position><position><id>2</id></position></jobs>")
    assert files.read_xml_board(spark, str(tmp_path / "b.xml")).count() == 2
    (tmp_path / "l.csv").write_text("name;link\nA;https://a.example/1\nB;https://b.example/2\n")
    csv = files.read_list(spark, str(tmp_path / "l.csv"))
    assert csv.columns == ["name", "link"] and files.link_column(csv) == "link"
    (tmp_path / "w.json").write_text('{"data": [{"u": "https://a.example"}], "meta": 1}')
    assert files.link_column(files.read_list(spark, str(tmp_path / "w.json"))) == "u"
    (tmp_path / "t.txt").write_text("https://a.example\nhttps://b.example\n")
    assert files.read_list(spark, str(tmp_path / "t.txt")).count() == 2


def test_cut_and_bounded(spark):
    df = spark.range(10)
    assert cut(df).count() == 10
    assert bounded(df, 10)[1] and not bounded(df, 9)[1]
