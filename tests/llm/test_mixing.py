from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.llm.mixing import budget_tree, language_code, mix, token_counts

TARGETS = "plan string, source string, target_share double, max_repeats int, corpus_fraction double"


def leaf(domain, language, source, weight, cap):
    return {"domain": domain, "language": language, "source": source, "weight": weight, "cap": cap}


def test_shortage_goes_to_siblings_first():
    leaves = budget_tree([leaf("d", "de", "a", 0.5, 10.0), leaf("d", "de", "b", 0.25, 100.0), leaf("d", "en", "c", 0.25, 100.0)], 100)
    assert {x["source"]: round(x["budget"], 6) for x in leaves} == {"a": 10, "b": 65, "c": 25}


def test_then_to_the_domain_then_to_all():
    leaves = budget_tree([leaf("d", "de", "a", 0.5, 10.0), leaf("d", "en", "b", 0.25, 30.0), leaf("e", "de", "c", 0.25, 1000.0)], 100)
    assert {x["source"]: round(x["budget"], 6) for x in leaves} == {"a": 10, "b": 30, "c": 60}
    full = budget_tree([leaf("d", "de", "a", 1.0, 10.0)], 100)
    assert full[0]["budget"] == 10


def test_languages(spark):
    df = spark.createDataFrame([("de_DE",), ("English",), ("FRA",), ("zz",), (None,), (" nl ",)], "x string")
    assert [r[0] for r in df.select(language_code(F.col("x"))).collect()] == ["de", "en", "fr", None, None, "nl"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {i} with some words in it", ["Big ", "big", "small-one"][0 if i % 10 else 2], ["de", "en", None][i % 3], "advert", "x") for i in range(600)]
    rows += [(900, None, "big", "de", "advert", "x"), (901, "", "big", "de", "advert", "x"), (902, "kein plan", "other", "de", None, "x"), (903, "quelle fehlt", None, "de", "advert", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string, tokens string")


def test_shares_and_caps(spark, docs):
    t = spark.createDataFrame([("p", "big", 0.7, 1, 0.2), ("p", "small_one", 0.3, 2, 0.2), ("q", "big", 0.5, 1, 0.9), ("q", "small_one", 0.3, 3, 0.9), ("q", "ghost", 0.2, 3, 0.9)], TARGETS)
    selection, report = mix(docs, t)
    r = {(x.plan, x.source): x for x in report.collect()}
    assert r["p", "big"].actual_share == pytest.approx(0.7, abs=0.02) and r["p", "small_one"].actual_share == pytest.approx(0.3, abs=0.02)
    assert all(sum(x.actual_share for x in r.values() if x.plan == p) == pytest.approx(1, abs=1e-5) for p in "pq")
    assert r["q", "ghost"].tokens == 0 and r["q", "ghost"].shortage
    got = selection.groupBy("plan", "doc_id").agg(F.sum("copies").alias("c"), F.count("*").alias("n")).collect()
    assert all(x.n == 1 for x in got)
    assert max(x.c for x in got if x.plan == "p") <= 2
    assert not {900, 901, 902, 903} & {x.doc_id for x in got}
    again, _ = mix(docs, t, bucket_rows=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))


def test_empty(spark, docs):
    t = spark.createDataFrame([("p", "big", 1.0, None, 0.5)], TARGETS)
    assert mix(docs.limit(0), t)[0].count() == 0
    assert mix(docs, t.limit(0))[1].count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    n = [r[0] for r in df.select(token_counts(F.col("t"))).collect()]
    assert n[:3] == [2, 0, 0] and n[3] > 1


def test_selection_against_a_plain_walk(spark, docs):
    """Each leaf's extra epoch is a prefix of its seeded order: whole tokens sums, no document skipped before the last taken."""
    t = spark.createDataFrame([("p", "big", 0.6, 2, 0.4), ("p", "small_one", 0.4, 3, 0.4)], TARGETS)
    selection, report = mix(docs, t, bucket_rows=40)
    took = {r.doc_id: r for r in selection.collect()}
    n = {r.doc_id: r for r in docs.where("text <> ''").select("doc_id", F.coalesce(language_code(F.col("lang")), F.lit("und")).alias("language"), F.regexp_replace(F.lower(F.trim("source")), "[ -]+", "_").alias("source"), token_counts(F.col("text")).alias("n")).collect()}
    leaves = {}
    for i, r in n.items():
        leaves.setdefault((r.language, r.source), []).append(i)
    size = 0.4 * sum(r.n for r in n.values())
    for (language, source), ids in leaves.items():
        if source not in ("big", "small_one"):
            assert not set(ids) & set(took)
            continue
        held = sum(n[i].n for i in ids)
        share = {"big": 0.6, "small_one": 0.4}[source] * size * held / sum(n[i].n for i in n if n[i].source == source)
        least, most = min(took[i].copies if i in took else 0 for i in ids), max(took[i].copies if i in took else 0 for i in ids)
        got = sum(took[i].copies * n[i].n for i in ids if i in took)
        assert most - least <= 1 and most <= {"big": 2, "small_one": 3}[source]
        if share < {"big": 2, "small_one": 3}[source] * held:
            assert got >= share - max(n[i].n for i in ids) - 1
    r = {x.source: x.tokens for x in report.collect()}
    assert sum(r.values()) <= size + 10
