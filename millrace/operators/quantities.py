"""Quantities recorded in different units: salaries to euros a year."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of currencies, with the currency and its size in whole units.
CURRENCY_WORDS = {
    "eur-cent": ("EUR", "0.01"), "eurocent": ("EUR", "0.01"), "cents": ("EUR", "0.01"), "cent": ("EUR", "0.01"), "ct": ("EUR", "0.01"),
    "euro": ("EUR", "1"), "euros": ("EUR", "1"), "eur": ("EUR", "1"), "€": ("EUR", "1"),
    "us$": ("USD", "1"), "usd": ("USD", "1"), "$": ("USD", "1"),
    "sfr.": ("CHF", "1"), "sfr": ("CHF", "1"), "fr.": ("CHF", "1"), "chf": ("CHF", "1"),
    "gbp": ("GBP", "1"), "£": ("GBP", "1"),
    "pln": ("PLN", "1"), "zł": ("PLN", "1"),
    "sek": ("SEK", "1"), "kr": ("SEK", "1"),
    "czk": ("CZK", "1"), "kč": ("CZK", "1"),
}

# How texts name periods, as patterns over lower-case text.
PERIOD_PATTERNS = (
    ("HOUR", r"/\s?h(?!\p{L})|stunde|(?<!\p{L})std\.?(?!\p{L})|hour|heure|(?<!\p{L})uur(?!\p{L})|all'ora|por hora"),
    ("DAY", r"tagessatz|(?<!\p{L})tag(?!\p{L})|täglich|(?<!\p{L})day(?!\p{L})|daily|(?<!\p{L})jour(?!\p{L})"),
    ("WEEK", r"woche|wöchentlich|week|semaine"),
    ("MONTH", r"monat|mtl|month|mois|mensuel|maand"),
    ("YEAR", r"jahr|jährlich|year|annual|annum|p\.\s?a\.|(?<!\p{L})par an(?!\p{L})|/\s?an(?!\p{L})|jaar"),
)

_NUMBER = r"(\d{1,3}(?:[ .,'’]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?)"
_UNIT = r"(?<!\p{L})([kt]?)(" + "|".join(w.replace("$", r"\$").replace(".", r"\.") for w in sorted(CURRENCY_WORDS, key=len, reverse=True)) + r")(?!\p{L})"
_UPPER_ONLY = r"(?i)^\D*?(?<!\p{L})(bis|up to|max\.?|jusqu'à|höchstens)\s*\D{0,6}\d"

#: Width of a bin of log amounts, and the bins' range; together with currencies and periods they bound the histogram.
BIN, LOG_LOW, LOG_HIGH = 0.02, -10.0, 30.0


def _unit_of(word: Column) -> Column:
    """currency|size of a currency's spelling; null for other words."""
    words = F.create_map(*[x for w, v in CURRENCY_WORDS.items() for x in (F.lit(w), F.lit("|".join(v)))])
    return F.try_element_at(words, word)


def _with_number(df: DataFrame, text: str, thousands: Column, into: str) -> DataFrame:
    """Adds the first number of ``text`` as decimal, whatever separators it uses; null if there is none.

    Built in steps, each a column, so that no step is repeated inside the next.
    """
    df = df.withColumn("_raw", F.regexp_replace(F.regexp_extract(text, _NUMBER, 1), r"[ '’]", ""))
    df = df.withColumn("_tail", F.when(thousands, F.regexp_extract("_raw", r"[.,](\d+)$", 1)).otherwise(F.regexp_extract("_raw", r"[.,](\d{1,2}|\d{4,})$", 1)))
    cut = F.when(F.length("_tail") > 0, F.length("_tail") + 1).otherwise(0)
    whole = F.regexp_replace(F.substring(F.col("_raw"), F.lit(1), F.length("_raw") - cut), r"\D", "")
    return df.withColumn(into, F.concat_ws(".", whole, F.when(F.length("_tail") > 0, F.col("_tail"))).try_cast("decimal(18,6)")).drop("_raw", "_tail")


def stated_quantities(quotes: DataFrame, periods: list[str], amount: str = "amount_min", currency: str = "currency", period: str = "period", text: str = "raw_text") -> DataFrame:
    """``quotes`` with what their fields and text state: ``q_amount`` (whole currency units), ``q_currency``, ``q_period``.

    The text holds where it states an amount, that is a number beside a currency or a period; what it leaves out
    comes from the fields.  Empty and null writings give null, and so do unknown ones, which ``q_unknown`` tells: a currency or
    period is written there, but none that is known.  Nothing is guessed here.
    """
    t = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[   \t]", " "))
    out = quotes.withColumn("_t", t)
    out = out.withColumns({"_tk": F.regexp_extract("_t", _UNIT, 1), "_tc": F.regexp_extract("_t", _UNIT, 2)})
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PERIOD_PATTERNS):
        found = F.when(F.col("_t").rlike(pattern), F.lit(name)).otherwise(found)
    out = out.withColumn("_tp", found)
    out = _with_number(out, "_t", F.col("_tk") != "", "_tn")
    out = out.withColumn("_tn", F.when(((F.col("_tc") != "") | F.col("_tp").isNotNull()) & ~F.col("_t").rlike(_UPPER_ONLY), F.col("_tn")))
    field = F.lower(F.trim(F.coalesce(F.col(currency), F.lit(""))))
    unit = "^(?:" + _UNIT + ")$"
    out = out.withColumns({"_fk": F.regexp_extract(field, unit, 1), "_fc": F.regexp_extract(field, unit, 2)})
    in_field = F.upper(F.trim(F.col(period)))
    use = F.col("_tn").isNotNull()
    from_text = use & (F.col("_tc") != "")
    out = out.withColumns({"_w": F.when(from_text, F.col("_tc")).otherwise(F.col("_fc")), "_k": F.when(from_text, F.col("_tk")).otherwise(F.col("_fk"))})
    out = out.withColumn("_u", _unit_of(F.col("_w")))
    scale = F.coalesce(F.split_part("_u", F.lit("|"), F.lit(2)), F.lit("1")).cast("decimal(10,2)") * F.when(F.col("_k") != "", 1000).otherwise(1)
    known = F.when(in_field.isin(periods), in_field)
    named = F.when(use, F.coalesce("_tp", known)).otherwise(known)
    odd_period = named.isNull() & in_field.isNotNull() & ~in_field.isin("", "UNKNOWN")
    odd_currency = ~from_text & (field != "") & (F.col("_fc") == "")
    return out.withColumns({
        "q_unknown": odd_period | odd_currency,
        "q_amount": (F.when(use, F.col("_tn")).otherwise(F.col(amount).cast("decimal(18,6)")) * scale).cast("decimal(28,8)"),
        "q_currency": F.split_part("_u", F.lit("|"), F.lit(1)),
        "q_period": named,
    }).drop("_t", "_tk", "_tc", "_tp", "_tn", "_fk", "_fc", "_w", "_k", "_u")


def fit_unit_mixture(bins: pd.DataFrame, rates: dict[str, float], per_year: dict[str, float], rounds: int = 60) -> tuple[pd.DataFrame, dict]:
    """Posterior unit of each histogram bin, by EM on one log-normal whose copies are offset by the known factors.

    ``bins``: cur, per (either may be null), bin, n.  Every pair of currency and period is a component with the shared
    mean and width, shifted by the logarithm of its factor; stated units fix a bin's components, so rows with units
    anchor the fit.  A flat background, a component like the others whose weight is fitted, takes what fits none of them.
    No bins give no rows.
    """
    comps = [(c, p) for c in sorted(rates) for p in sorted(per_year)]
    off = np.array([math.log(rates[c] * per_year[p]) for c, p in comps])
    out = bins.reset_index(drop=True).copy()
    if out.empty:
        return out.assign(best_cur=pd.Series(dtype=str), best_per=pd.Series(dtype=str), posterior=pd.Series(dtype=float)), {}
    allowed = np.array([[(c is None or c == k) and (p is None or p == q) for k, q in comps] for c, p in zip(out.cur.where(out.cur.notna(), None), out.per.where(out.per.notna(), None))])
    y, n = out.bin.to_numpy() * BIN, out.n.to_numpy(float)
    z = y[:, None] + off[None, :]
    mu, sd, back = math.log(40_000), 0.8, 0.01
    pi = np.full(len(comps), (1 - back) / len(comps))
    for _ in range(rounds):
        like = np.where(allowed, pi * np.exp(-0.5 * ((z - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)), 0.0)
        flat = back / (LOG_HIGH - LOG_LOW)
        total = like.sum(1) + flat
        r = like / total[:, None]
        w = r * n[:, None]
        if w.sum() <= 0:
            break
        mu = float((w * z).sum() / w.sum())
        sd = max(0.05, math.sqrt(float((w * (z - mu) ** 2).sum() / w.sum())))
        back = min(0.2, max(1e-4, float((n * flat / total).sum() / n.sum())))
        pi = (w.sum(0) + 1e-3) / (w.sum() + 1e-3 * len(comps)) * (1 - back)
    best = r.argmax(1)
    out["best_cur"] = [comps[k][0] for k in best]
    out["best_per"] = [comps[k][1] for k in best]
    out["posterior"] = r[np.arange(len(best)), best]
    return out, {"mean": mu, "sd": sd, "background": back}


def normalise_quantities(quotes: DataFrame, fx: DataFrame, pay_periods: DataFrame, sure: float = 0.9, **columns: str) -> DataFrame:
    """Every quote in euros a year.

    Adds ``q_amount``, ``q_currency``, ``q_period``, ``q_unknown``, ``eur_year`` (exact decimal), ``unit_source`` (``stated``,
    ``inferred``, ``unknown unit`` or ``none``), ``posterior`` and ``uncertain``.  Stated units convert exactly.  Where an amount lacks its currency or
    period, a mixture on the log scale, fitted on the histogram of all amounts, assigns the likeliest unit; below ``sure``
    the row is flagged.  A unit that is written but not known is never replaced by another.  Quotes without a positive amount
    get ``none``.  Repeated rows stay, extra columns pass through,
    null fields count as not stated, an empty table gives an empty table.

    ``fx`` and ``pay_periods`` are configuration; at most 1000 rows each are accepted.
    """
    from ..io import cut

    spark = quotes.sparkSession
    rates = {r[0]: r[1] for r in fx.select("currency", "eur_per_unit").limit(1001).collect()}
    per_year = {r[0]: r[1] for r in pay_periods.select("period", "periods_per_year").limit(1001).collect()}
    if max(len(rates), len(per_year)) > 1000:
        raise ValueError("fx and pay_periods are configuration of at most 1000 rows")
    # read once, used for the histogram and for the rows
    q = cut(stated_quantities(quotes, list(per_year), **columns))
    rated = F.col("q_currency").isin(list(rates))
    q = q.withColumns({"q_unknown": F.col("q_unknown") | (F.col("q_currency").isNotNull() & ~rated), "q_currency": F.when(rated, F.col("q_currency"))})
    amount = F.col("q_amount") > 0
    usable = amount & ~F.col("q_unknown")
    q = q.withColumn("_bin", F.when(usable, F.round(F.least(F.greatest(F.ln(F.col("q_amount").cast("double")), F.lit(LOG_LOW)), F.lit(LOG_HIGH)) / BIN).cast("int")))
    bins = q.where(usable).groupBy(F.col("q_currency").alias("cur"), F.col("q_period").alias("per"), F.col("_bin").alias("bin")).agg(F.count("*").alias("n")).toPandas()
    fitted, _ = fit_unit_mixture(bins, {k: float(v) for k, v in rates.items()}, {k: float(v) for k, v in per_year.items()})
    fitted = fitted[fitted.cur.isna() | fitted.per.isna()] if len(fitted) else fitted
    rows = [(r.cur if isinstance(r.cur, str) else None, r.per if isinstance(r.per, str) else None, int(r.bin), r.best_cur, r.best_per, float(r.posterior)) for r in fitted.itertuples()]
    units = spark.createDataFrame(rows, "_cur string, _per string, _b int, _bc string, _bp string, _post double")
    q = q.join(F.broadcast(units), F.col("_bin").eqNullSafe(F.col("_b")) & F.col("q_currency").eqNullSafe(F.col("_cur")) & F.col("q_period").eqNullSafe(F.col("_per")), "left")
    stated = usable & F.col("q_currency").isNotNull() & F.col("q_period").isNotNull()
    cur, per = F.coalesce("q_currency", "_bc"), F.coalesce("q_period", "_bp")
    rate = F.try_element_at(F.from_json(F.lit(json.dumps({k: str(v) for k, v in rates.items()})), "map<string,string>"), cur).cast("decimal(10,4)")
    times = F.try_element_at(F.from_json(F.lit(json.dumps(per_year)), "map<string,int>"), per)
    q = q.withColumns({
        "eur_year": F.when(usable, F.col("q_amount") * rate * times),
        "unit_source": F.when(stated, "stated").when(usable & cur.isNotNull() & per.isNotNull(), "inferred").when(amount & F.col("q_unknown"), "unknown unit").otherwise("none"),
        "posterior": F.when(stated, F.lit(1.0)).otherwise(F.col("_post")),
    })
    q = q.withColumn("uncertain", ~F.col("unit_source").isin("stated", "inferred") | (F.coalesce("posterior", F.lit(0.0)) < sure))
    return q.withColumns({"q_currency": cur, "q_period": per}).drop("_bin", "_cur", "_per", "_b", "_bc", "_bp", "_post")


def against_facets(normalised: DataFrame, facets: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """``quote_id, min_eur_year, facet_state`` of every quote whose units are stated.

    The current facet row of a posting is that of the highest ``derive_version`` (of equal ones the latest
    ``derived_at``); no row counts as a null salary.
    """
    current = facets.groupBy("job_id").agg(F.max_by("salary_min_eur_year", F.struct("derive_version", "derived_at")).alias("claimed"))
    q = normalised.where(F.col("unit_source") == "stated").select("quote_id", "job_id", F.round("eur_year", 0).cast("bigint").alias("min_eur_year")).distinct()
    gap = F.abs(F.col("claimed") - F.col("min_eur_year")) > F.col("min_eur_year") * F.lit(tolerance).cast("decimal(6,4)")
    return q.join(current, "job_id", "left").select("quote_id", "min_eur_year", F.when(F.col("claimed").isNull(), "missing").when(gap, "wrong").otherwise("ok").alias("facet_state")).distinct()


def hidden_units(quotes: DataFrame, fx: DataFrame, pay_periods: DataFrame, sure: float = 0.9) -> DataFrame:
    """``hidden, n, right, flagged, sure_right``: how well the mixture assigns units it is not told.

    Of the quotes whose units are stated a quarter (by hash of ``quote_id``) has its period taken away and a quarter its
    currency; the rest anchors the fit.  ``right`` is the share assigned the true unit, ``flagged`` that flagged as uncertain,
    ``sure_right`` the share right among those not flagged.
    """
    told = normalise_quantities(quotes, fx, pay_periods, sure).where("unit_source = 'stated'")
    part = F.pmod(F.xxhash64(F.col("quote_id")), F.lit(4))
    known = told.select("quote_id", part.alias("part"), F.col("q_amount").cast("decimal(18,6)").alias("amount_min"), F.col("q_currency").alias("true_currency"), F.col("q_period").alias("true_period")).distinct()
    bare = known.select("quote_id", "part", "amount_min", "true_currency", "true_period", F.when(F.col("part") != 1, F.col("true_currency")).alias("currency"), F.when(F.col("part") != 0, F.col("true_period")).alias("period"), F.lit(None).cast("string").alias("raw_text"))
    got = normalise_quantities(bare, fx, pay_periods, sure).where("part < 2")
    right = (F.col("q_currency") == F.col("true_currency")) & (F.col("q_period") == F.col("true_period"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return got.groupBy(F.when(F.col("part") == 0, "period").otherwise("currency").alias("hidden")).agg(F.count("*").alias("n"), share(right).alias("right"), share(F.col("uncertain")).alias("flagged"), share(F.when(~F.col("uncertain"), right)).alias("sure_right"))
