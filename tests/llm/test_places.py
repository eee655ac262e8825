from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.places import Gazetteer, Trie, entries_within, limit_for, map_to_places

PLACES = [
    (1, "Wolmheim", "DE", "Zeilland", 500, ["Alizares"]), (2, "Sankt Grendücklmoor", "DE", "Moorgau", 90, []), (3, "Müssurwrode", "DE", "Scharkgau", 10, None), (4, "Müssurwrode", "ES", "Gizonaland", 99, []),
    (5, "Brandolmheim an der Vils", "DE", "Zeilland", 5, []), (6, "Straßberg", "AT", None, 7, []), (7, "Véraulbigny", "FR", "Morgau", 7, []),
]


@pytest.fixture(scope="module")
def g():
    return Gazetteer(PLACES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Wolmheim", 1), ("  WOLMHEIM \xa0", 1), ("Alizares", 1), ("Wolmhiem", 1), ("Wolmhem", 1), ("Wollmheim", 1), ("Großraum Wolmheim, Zeilland, Deutschland", 1), ("12345 Wolmheim (Altstadt)", 1),
        ("Wolmheim-Nord", 1), ("Wolmheim L8 1QZ", 1), ("hybrid: Wolmheim, Werk 2", 1), ("bei St. Grenduecklmoor", 2), ("Sankt Grenducklmoor", 2), ("Müssurwrode, Spain", 4), ("Muessurwrode / BRD", 3),
        ("Müssurwrode, Gizonaland", 4), ("Müssurwrode", 4), ("Brandolmheim a.d. Vils", 5), ("Brandolmheim/Vils", 5), ("STRASSBERG", 6), ("VERAULBIGNY", 7), ("Véraulbingy", 7),
        ("Unbekanntstadt", -1), ("Wolmxxim", -1), ("Wolmhem (AT)", -1),
    ],
)
def test_mentions(g, text, want):
    assert [p for p, _ in g.read(text)] == [want]


@pytest.mark.parametrize("text", ["", "  ", "Remote", "Homeoffice", "Deutschland", "EMEA", "Zeilland", "AT", "hybrid", "Raum Deutschland", "12345", "(), /"])
def test_no_town(g, text):
    assert not g.read(text)


def edits(a, b):
    p2, p = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            v = min(p[j] + 1, c[j - 1] + 1, p[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, p2[j - 2] + 1)
            c.append(v)
        p2, p = p, c
    return p[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=30), min_size=1, max_size=12, unique=True), st.text("abc", min_size=1, max_size=30))
def test_trie_against_brute_force(words, query):
    t = Trie()
    for i, w in enumerate(words):
        t.add(w, i)
    got = {(k, e) for k, _, e in t.search(query)}
    want = {(edits(query, w), i) for i, w in enumerate(words) if edits(query, w) <= limit_for(min(len(w), len(query)))}
    assert got == want


def test_operator(spark):
    places = spark.createDataFrame(PLACES, "id int, name string, country string, region string, population int, alternates array<string>")
    m = spark.createDataFrame([(1, "Wolmheim; Nirgendwo oder Alizares"), (1, "Wolmheim"), (2, None), (3, ""), (4, "Remote | Straßberg" + " " * 50_000)], "key long, mention string")
    assert {(r.key, r.place_id) for r in map_to_places(m, places).collect()} == {(1, 1), (1, -1), (4, 6)}
    assert map_to_places(m.limit(0), places).count() == 0
    assert {r.place_id for r in map_to_places(m, places.limit(0)).collect()} == {-1}
    with pytest.raises(ValueError):
        map_to_places(m, places, max_places=3)


def test_all_entries_before_one_is_settled_on(spark, g):
    assert g.entries("Müssurwrode, Spain") == [(3, 0), (4, 0)]
    assert g.entries("Wolmhiem") == [(1, 1)] and g.entries("Remote") == [] and g.entries("Unbekanntstadt") == []
    df = spark.createDataFrame([(1, "Muessurwrode; Wolmheim"), (2, "Wolmheim"), (3, None), (4, " ")], "key long, mention string")
    places = spark.createDataFrame(PLACES, "id int, name string, country string, region string, population int, alternates array<string>")
    assert {tuple(r) for r in entries_within(df, places).collect()} == {("Muessurwrode", 3, 0), ("Muessurwrode", 4, 0), (" Wolmheim", 1, 0), ("Wolmheim", 1, 0)}
    assert entries_within(df.limit(0), places).count() == 0
