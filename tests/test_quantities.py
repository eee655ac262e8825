from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from millrace.operators.quantities import BIN, against_facets, fit_unit_mixture, hidden_units, normalise_quantities

SCHEMA = "quote_id long, job_id long, amount_min decimal(18,6), currency string, period string, raw_text string"


@pytest.fixture(scope="module")
def rates(spark):
    fx = spark.createDataFrame([("EUR", Decimal("1.0")), ("CHF", Decimal("1.0427")), ("SEK", Decimal("0.0884")), ("GBP", Decimal("1.1683"))], "currency string, eur_per_unit decimal(10,4)")
    per = spark.createDataFrame([("YEAR", 1), ("MONTH", 12), ("WEEK", 52), ("DAY", 220), ("HOUR", 1720)], "period string, periods_per_year int")
    return fx, per


def value(spark, rates, amount=None, currency=None, period=None, text=None):
    amount = None if amount is None else Decimal(str(amount))
    df = spark.createDataFrame([(1, 1, amount, currency, period, text)], SCHEMA)
    r = normalise_quantities(df, *rates).first()
    return r.unit_source, None if r.eur_year is None else float(r.eur_year)


@pytest.mark.parametrize(
    "case, want",
    [
        (dict(amount=40000, currency="EUR", period="YEAR"), 40000),
        (dict(amount=57.5, currency="T€", period="YEAR"), 57500),
        (dict(amount=2050, currency="EUR-Cent", period="HOUR"), 35260),
        (dict(text="Vergütung 35.000,- - 38,500 EUR par an"), 35000),
        (dict(text="94\xa0000 bis 103.500 € jährlich"), 94000),
        (dict(text="Fr. 79'500,00 to 103'500 p.a."), 79500 * 1.0427),
        (dict(text="66,5 TCHF annually"), 66500 * 1.0427),
        (dict(text="862.75 to 1.035,25 kr per hour"), 862.75 * 1720 * 0.0884),
        (dict(amount=4150, currency="GBP", period="YEAR", text="£ 4.150,- - 4.550 per month"), 4150 * 12 * 1.1683),
        (dict(amount=53000, period="YEAR", text="53000 Euro"), 53000),
        (dict(amount=320, currency="eur ", period="UNKNOWN", text="320 Euro Tagessatz"), 70400),
    ],
)
def test_stated_units(spark, rates, case, want):
    source, got = value(spark, rates, **case)
    assert source == "stated"
    assert got == pytest.approx(want, abs=0.01)


@pytest.mark.parametrize("case", [dict(), dict(text=""), dict(text="laut Tarif E9"), dict(text="VB"), dict(currency="EUR", period="YEAR"), dict(amount=0, currency="EUR", period="YEAR"), dict(amount=-5, currency="EUR", period="YEAR")])
def test_nothing_stated(spark, rates, case):
    assert value(spark, rates, **case) == ("none", None)


def test_empty_table_and_extra_columns(spark, rates):
    df = spark.createDataFrame([], SCHEMA + ", eur string, cur string")
    out = normalise_quantities(df, *rates)
    assert out.count() == 0 and {"eur", "cur"} <= set(out.columns)


def test_mixture_tells_months_from_years():
    rng = np.random.default_rng(0)
    pay = np.exp(rng.normal(np.log(45000), 0.3, 4000))
    rows = [("EUR", None, round(float(np.log(x / 12 if i % 2 else x)) / BIN)) for i, x in enumerate(pay)]
    rows += [("EUR", "YEAR", round(float(np.log(x)) / BIN)) for x in pay[:500]]
    bins = pd.DataFrame(rows, columns=["cur", "per", "bin"]).value_counts(dropna=False).rename("n").reset_index()
    fitted, found = fit_unit_mixture(bins, {"EUR": 1.0}, {"YEAR": 1, "MONTH": 12, "HOUR": 1720})
    assert abs(np.exp(found["mean"]) - 45000) < 3000
    open_ = fitted[fitted.per.isna()]
    want = np.where(open_.bin * BIN < np.log(12000), "MONTH", "YEAR")
    assert (open_.n * (open_.best_per == want)).sum() / open_.n.sum() > 0.97


def test_facets_take_the_highest_version(spark, rates):
    q = spark.createDataFrame([(1, 7, Decimal(40000), "EUR", "YEAR", None), (1, 7, Decimal(40000), "EUR", "YEAR", None), (2, 8, Decimal(40000), "EUR", "YEAR", None), (3, 9, Decimal(40000), "EUR", "YEAR", None)], SCHEMA)
    f = spark.createDataFrame([(7, 10, Decimal(99), "2026-01-02"), (7, 11, Decimal(40300), "2026-01-01"), (8, 11, Decimal(40500), "2026-01-01")], "job_id long, derive_version int, salary_min_eur_year decimal(18,6), derived_at string")
    got = {tuple(r) for r in against_facets(normalise_quantities(q, *rates), f).collect()}
    assert got == {(1, 40000, "ok"), (2, 40000, "wrong"), (3, 40000, "missing")}


@pytest.mark.parametrize("case", [dict(amount=100, currency="XYZ", period="YEAR"), dict(amount=100, currency="USD", period="YEAR"), dict(amount=100, currency="EUR", period="FORTNIGHT")])
def test_a_unit_that_is_not_known_is_not_guessed(spark, rates, case):
    assert value(spark, rates, **case) == ("unknown unit", None)


def test_hidden_units(spark, rates):
    rng = np.random.default_rng(1)
    pay = np.exp(rng.normal(np.log(45000), 0.25, 1200))
    rows = [(i, i, Decimal(str(round(x / (12 if i % 3 == 0 else 1), 2))), "EUR", "MONTH" if i % 3 == 0 else "YEAR", None) for i, x in enumerate(pay)]
    got = {r.hidden: r for r in hidden_units(spark.createDataFrame(rows, SCHEMA), *rates).collect()}
    assert got["period"].right > 0.97 and got["period"].sure_right > 0.97 and got["period"].n + got["currency"].n > 400
