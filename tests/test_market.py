from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import parse as P
from millrace.functions import text as T
from millrace.operators import changes, joins, locations, search, series
from millrace.sources import files, payloads

DOC = "id long, title string, company string, location string, description string, posted timestamp, q string, rank string"


def day(n):
    return dt.datetime(2026, 1, n)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Ingenieur Netze", "Alpha", "Wien", "Wir bauen Netze", day(1), "x", "x"),
        (2, "Wirtschaftsingenieur", "Beta", "Graz", None, day(2), "x", "x"),
        (3, "Ingenieure gesucht", None, None, "netz", day(3), "x", "x"),
        (4, None, None, None, None, None, "x", "x"),
        (5, "Koch", "Gamma", "Linz", "Ingenieur Netz Praktikum", None, "x", "x"),
    ]
    return spark.createDataFrame(rows, DOC)


def ranked(spark, docs, *texts):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q long, text string")
    out = {}
    for r in search.newest_first(search.word_matches(q, docs), docs).orderBy("q", "pos").collect():
        out.setdefault(r.q, []).append((r.id, r["rank"]))
    return out


def test_word_arm(spark, docs):
    got = ranked(spark, docs, "Ingenieur", "netze ingenieure", "ingenieur -praktikum", "", None, "der die", "--", "zzz")
    # by title, then the substring inside a longer word, which has no rank
    assert got[0] == [(3, 10), (1, 10), (5, 1), (2, 0)]
    assert [i for i, _ in got[1]] == [1, 3, 5]
    assert 5 not in [i for i, _ in got[2]]
    assert set(got) <= {0, 1, 2}
    assert ranked(spark, docs.limit(0), "Ingenieur") == {}


def test_lexical_place_and_insert(spark):
    pool = spark.createDataFrame([(1, 1, 0.9, day(1)), (1, 2, 0.5, day(20)), (1, 3, 0.5, day(5)), (1, 4, 0.5, None)], "q long, id long, rank double, posted timestamp")
    probes = spark.createDataFrame([(1, 90, 0.5, day(10)), (1, 91, 0.5, None)], "q long, id long, rank double, posted timestamp")
    assert {r.id: r.before for r in search.lexical_place(pool, probes).collect()} == {90: 2, 91: 4}

    def put(ids, probe, before, depth):
        lists = spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "q long, id long, pos int")
        p = spark.createDataFrame([(1, probe, before)], "q long, id long, before int")
        return [r.id for r in search.insert_at(lists, p, depth).orderBy("pos").collect()]

    assert put([1, 2, 3], 9, 1, 3) == [1, 9, 2]
    assert put([1, 2, 3], 9, 3, 3) == [1, 2, 3]
    assert put([1, 9, 3], 9, 0, 3) == [9, 1, 3]
    assert put([1, 2, 3], 9, None, 3) == [1, 2, 3]


AREA = "id long, blank boolean, dedup_group string, closed_at timestamp, first_seen_at timestamp, countries array<string>, place_ids array<int>, unplaced_countries array<string>, work_mode string"


@pytest.fixture(scope="module")
def wien(spark):
    places = spark.createDataFrame([(1, "AT", 48.2, 16.37), (2, "AT", 48.08, 16.28), (3, "AT", 47.07, 15.44), (4, "DE", 52.5, 13.4)], "id int, country string, lat double, lon double")
    readers = spark.createDataFrame([("r", [], [1], 30, True), ("home", [], [1], 30, False), ("any", [], [], 30, True)], "area string, countries array<string>, city_ids array<int>, radius_km int, remote boolean")
    return locations.areas(readers, places)


def test_areas(wien):
    got = {r.area: (r.area_ids, r.area_countries, r.anywhere) for r in wien.collect()}
    assert got == {"r": ([1, 2], ["AT"], False), "home": ([1, 2], ["AT"], False), "any": ([], [], True)}


@pytest.mark.parametrize(
    "name, row, kept, at_home",
    [
        ("nothing stated", ([], [], [], "unknown"), True, True),
        ("inside", (["AT"], [2], [], "onsite"), True, True),
        ("outside", (["AT"], [3], [], "onsite"), False, False),
        ("town unknown", (["AT"], [], ["AT"], "onsite"), True, True),
        ("other country", (["DE"], [], ["DE"], None), False, False),
        ("other town", (["DE"], [4], [], "onsite"), False, False),
        ("remote", ([], [], [], "remote"), True, False),
        ("remote elsewhere", (["DE"], [], ["DE"], "remote"), True, False),
        ("either of two", (["DE", "FR"], [], ["DE", "FR"], "onsite"), False, False),
        ("nulls", (None, None, None, None), True, True),
    ],
)
def test_what_an_area_admits(spark, wien, name, row, kept, at_home):
    rows = spark.createDataFrame([(1, False, None, None, day(1), *row)], AREA)
    got = {r.area: r.kept for r in locations.admitted(rows, wien).collect()}
    assert (got["r"], got["home"]) == (kept, at_home)


def test_blank_copies_follow_their_twins(spark, wien):
    none = ([], [], [], "unknown")
    rows = spark.createDataFrame(
        [
            (1, True, "a", None, day(2), *none), (2, False, "a", None, day(1), ["AT"], [3], [], "onsite"),
            (3, True, "b", None, day(2), *none), (4, False, "b", None, day(1), ["AT"], [2], [], "onsite"),
            (5, True, "c", None, day(2), *none), (6, False, "c", day(9), day(1), ["AT"], [2], [], "onsite"),
            (7, False, "d", None, day(2), *none), (8, False, "d", None, day(1), ["AT"], [3], [], "onsite"),
            (9, True, None, None, day(2), *none), (10, True, "e", None, day(2), *none), (11, True, "e", None, day(1), *none),
        ],
        AREA,
    )
    got = {r.id: (r.kept, r.closed_at_origin) for r in locations.admitted(rows, wien).where("area = 'r'").collect()}
    assert got[1] == (False, False) and got[3] == (True, False) and got[5] == (True, True) and got[7] == (True, False)
    assert got[9] == got[10] == got[11] == (True, False)


@pytest.mark.parametrize(
    "text, countries, towns",
    [("Wien, Österreich", ["AT"], ["wien"]), ("Spain / Austria", ["AT", "ES"], []), ("DACH", ["AT", "CH", "DE"], []), (None, [], []), ("", [], []), ("Remote; Köln (DE)", ["DE"], ["koln"])],
)
def test_place_texts(spark, text, countries, towns):
    r = spark.createDataFrame([(text,)], "t string").select(locations.countries_of("t").alias("c"), locations.towns_of("t").alias("w"), locations.names_remote("t").alias("r")).first()
    assert (r.c, r.w, r.r) == (countries, towns, text is not None and "Remote" in text)


def test_merge_rules(spark):
    cur = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", None, "y"), (None, "n", 0, "z")], "k long, t string, n long, s string")
    new = spark.createDataFrame([(1, None, 5), (3, "c", 7), (2, "bb", 2)], "k long, t string, n long")
    got = {r.k: (r.t, r.n, r.s) for r in changes.merge(cur, new, ["k"], {"t": "prefer", "n": "add", "s": "clear"}).collect()}
    assert got == {1: ("a", 6, None), 2: ("bb", 2, None), 3: ("c", 7, None), None: ("n", 0, "z")}
    assert {r.k for r in changes.merge(cur, new, ["k"], {}, insert=False).collect()} == {1, 2, None}
    assert changes.merge(cur.limit(0), new, ["k"], {}).count() == 3


def test_unique_where_guarded(spark):
    cur = spark.createDataFrame([(1, "u"), (2, "")], "i long, u string")
    new = spark.createDataFrame([(3, "u"), (4, ""), (5, ""), (7, "v"), (6, "v")], "i long, u string")
    assert {r.i for r in changes.add_unless_held(cur, new, ["u"], F.col("u") != "", ["i"]).collect()} == {1, 2, 4, 5, 6}


def test_health_and_streaks_agree(spark):
    rows = [("a", 1, 1, True), ("a", 2, 2, False), ("a", 3, 3, False), ("b", 1, 4, False), ("c", 1, 5, True), ("c", 1, 6, False), ("d", 2, 7, None), ("d", 1, 8, True)]
    e = spark.createDataFrame([(k, day(t), i, ok) for k, t, i, ok in rows], "k string, at timestamp, id long, ok boolean")
    assert {r.k: r.failures for r in changes.fold_health(e, ["k"], "at", "id", F.col("ok")).collect()} == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert {r.k: r.streak for r in series.streaks(e, ["k"], "at", "id", ~F.coalesce("ok", F.lit(False))).collect()} == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_asof_join_carries_values_over_slots(spark):
    left = spark.createDataFrame([("a", 1), ("a", 12), ("a", 95), ("b", 5), ("c", 50)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 12, 30), ("a", 12, 25), ("b", 6, 1), ("c", 3, None), ("c", 2, 7)], "k string, t long, v long")
    got = {(r.k, r.t): r.v for r in joins.asof_join(left, right, ["k"], "t", "v", F.floor(F.col("t") / 10)).collect()}
    assert got == {("a", 1): None, ("a", 12): 30, ("a", 95): 30, ("b", 5): None, ("c", 50): 7}


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_parsers(spark):
    assert [one(spark, v, P.instant("x")) for v in ("1768413531", "1768413531536", "2026-01-14", "2026-01-14T10:00:00Z", "2026-01-14T10:00:00+01:00", "heute", "", None)] == [1768413531000000, 1768413531536000, 1768348800000000, 1768384800000000, 1768381200000000, None, None, None]
    assert [one(spark, v, P.score_in("x")) for v in ('ok {"score": 88, "a": {"b": 1}} x', '{"score": 101}', '{"score": "7"}', '{"score": 7.5}', "none", None)] == [88, None, 7, None, None, None]
    assert [one(spark, v, P.registrable("x")) for v in ("https://a.b.example/x", "https://u.v.github.io", "http://one", None)] == ["b.example", "v.github.io", "one", None]
    assert one(spark, "https://a.example/p?utm_source=1&x=%20&y#f", P.without_tracking("x")) == "https://a.example/p?x=%20&y"
    assert one(spark, "https://a.example/p?ref=2", P.without_tracking("x")) == "https://a.example/p"
    assert [one(spark, v, P.is_slug("x")) for v in ("a-b.c_1", "-a", "a b", "", None, "x" * 81)] == [True, False, False, False, False, False]
    assert [one(spark, v, P.looks_like_code("x")) for v in ("WPP", "Wpp", "ABCDE", "ÄG")] == [True, False, False, True]
    assert [one(spark, n, P.pause_days(F.col("x")), "int") for n in (0, 1, 2, 3, 9, 60)] == [0, 1, 2, 4, 7, 7]
    assert one(spark, ["B", " a", "A", "", None, "b", "c"], P.merged_words(F.array(F.lit("c")), F.col("x")), "array<string>") == ["c", "B", " a"]
    assert one(spark, None, P.merged_words(F.col("x"), F.col("x")), "array<string>") == []
    assert one(spark, [0.1, -2.0], P.vector_text("x"), "array<double>") == "[0.100000,-2.000000]"
    assert one(spark, "12345 Bad Ort (Nord) 3", P.place_spellings("x")) == ["12345 bad ort (nord) 3", "bad ort", "bad-ort"]
    assert [one(spark, n, changes.backoff_seconds(F.col("x")), "int") for n in (0, 1, 4, 5)] == [60, 120, 960, 2592000]


def test_canonical_postings(spark):
    rows = [
        (1, "lever", " X1 ", "listing", '{"id":"x1","title":" A  B ","company_name":"C","location":{"name":"Wien | Graz"},"salary_from":"50","full_time":true}', day(1)),
        (2, "lever", "x1", "listing", '{"title":"Neu","location":{"name":"Remote"}}', day(2)), (3, "lever", "X1", "detail", '{"description":"Text"}', day(1)),
        (4, "jobicy", "y", "listing", "kein json", day(1)), (5, "nix", "z", "listing", "{}", day(1)), (6, "lever", None, "listing", "{}", day(1)),
        (7, "arbeitsagentur", "a", "listing", '{"stellenangebotsTitel":"T","verguetungsangabe":"JAHRESGEHALT","gehaltsspanneVon":1.5,"arbeitszeitVollzeit":false}', day(1)),
    ]
    got = {r.source: r for r in payloads.canonical_postings(spark.createDataFrame(rows, "id long, source string, external_id string, kind string, payload string, fetched_at timestamp")).collect()}
    assert len(got) == 4
    assert (got["lever"].title, got["lever"].listing_id, got["lever"].description, got["lever"].locations, got["lever"].remote) == ("Neu", 2, "Text", ["Remote"], True)
    assert (got["jobicy"].title, got["jobicy"].remote, got["nix"].title) == (None, True, None)
    assert (got["arbeitsagentur"].pay_period, got["arbeitsagentur"].salary_from, got["arbeitsagentur"].full_time) == ("YEAR", 1.5, False)


def test_keys_for_linking(spark):
    assert [one(spark, v, T.employer_key("x")) for v in ("ACME GmbH & Co. KG", "Acme", "GmbH", "Müller-Bau e. V.", None)] == ["acme", "acme", "gmbh", "muller bau", None]
    assert [one(spark, v, T.role_key("x")) for v in ("Lead Dev (m/w/d)", "Lead  Dev w/m/d", "Koch (all genders)", "Entwickler*in", None)] == ["lead dev", "lead dev", "koch", "entwickler", None]


def test_boards_in_toml():
    assert files.boards_in_toml('lever = [" a ", "b", "", "a"]\nashby = ["c"]') == [("lever", "a"), ("lever", "b"), ("ashby", "c")]
    assert files.boards_in_toml("") == []
    with pytest.raises(ValueError):
        files.boards_in_toml("lever = 3")


def test_links_of_list_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;url\nAlpha;https://a.example\nBeta;\n")
    (tmp_path / "b.json").write_text('{"meta": 1, "rows": [{"site": "https://b.example", "who": "B"}]}')
    (tmp_path / "c.json").write_text('[{"site": "https://c.example", "tags": [{"x": 1}]}]')
    (tmp_path / "d.txt").write_text("https://d.example\nkein link\n")
    (tmp_path / "e.csv").write_text("name,age\nAlpha,3\n")
    got = {r.link: r.rest for r in files.read_links(spark, [str(tmp_path / f) for f in ("a.csv", "b.json", "c.json", "d.txt", "e.csv")]).collect()}
    assert got == {"https://a.example": {"name": "Alpha"}, "https://b.example": {"who": "B"}, "https://c.example": {}, "https://d.example": {}}
    assert files.read_links(spark, []).count() == 0
