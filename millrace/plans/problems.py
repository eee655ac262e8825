"""Queries of the general training-data problems (4, 5, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..operators.quantities import against_facets, hidden_units, normalise_quantities
from ..operators.snapshots import snapshot_changes
from ..operators.timestamps import posting_stamps, resolve_timestamps


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    q = normalise_quantities(table(spark, d, "salary_quote"), table(spark, d, "fx_rate"), table(spark, d, "pay_period"))
    return against_facets(q, table(spark, d, "job_facet"))


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    q = normalise_quantities(table(spark, d, "salary_quote"), table(spark, d, "fx_rate"), table(spark, d, "pay_period"))
    return q.select("quote_id", "q_currency", "q_period", q.eur_year.cast("double").alias("eur_year"), "unit_source", "posterior", "uncertain").distinct()


def p4_hidden(spark: SparkSession, d: str) -> DataFrame:
    """How well the mixture of p4_units assigns units that were taken away."""
    return hidden_units(table(spark, d, "salary_quote"), table(spark, d, "fx_rate"), table(spark, d, "pay_period"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "source_document"), table(spark, d, "source_sweep"), table(spark, d, "job"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    values = posting_stamps(table(spark, d, "job"), table(spark, d, "needles"))
    return resolve_timestamps(values, table(spark, d, "source_clock")).select("record_id", "field", "epoch_us")


def p6_hidden(spark: SparkSession, d: str) -> DataFrame:
    """How well the path alone finds the order of figures: sources' declared orders are taken away and compared with."""
    values, clock = posting_stamps(table(spark, d, "job"), table(spark, d, "needles")), table(spark, d, "source_clock")
    told = resolve_timestamps(values, clock).select("record_id", "field", F.col("epoch_us").alias("told"))
    alone = resolve_timestamps(values, clock.withColumn("date_order", F.lit(None).cast("string")))
    both = alone.join(told, ["record_id", "field"])
    same = F.col("told") == F.col("epoch_us")
    return both.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("readings") > 1).alias("ambiguous"), F.count_if((F.col("readings") > 1) & same).alias("same"), F.round(F.avg(same.cast("double")), 6).alias("share"))


# SQL for the same results; members of payloads are compared leaf by leaf.
_KEY = "lower(regexp_replace(external_id, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g'))"
_P5 = f"""WITH q AS (SELECT id AS sweep_id, source, scope, row_number() OVER w AS seq, count(*) OVER (PARTITION BY source, scope) AS last_seq FROM source_sweep WHERE complete AND scope IS NOT NULL WINDOW w AS (PARTITION BY source, scope ORDER BY started_at, id)),
r AS (SELECT q.source, q.scope, q.seq, {_KEY} AS ext, arg_max(d.id, (d.fetched_at, d.id)) AS id FROM source_document d JOIN q USING (sweep_id) WHERE d.kind = 'listing' AND d.external_id IS NOT NULL GROUP BY 1, 2, 3, 4),
t AS (SELECT r.id, string_agg(j.fullkey || '=' || CASE WHEN j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'n' || (j.atom::VARCHAR)::DOUBLE ELSE j.type || j.atom::VARCHAR END, chr(10) ORDER BY j.fullkey) AS content FROM r JOIN source_document d USING (id), json_tree(d.payload::JSON) j WHERE j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND coalesce(j.key, '') NOT IN ('postedOn', 'views', 'trace_id') GROUP BY 1),
s AS (SELECT r.*, t.content FROM r LEFT JOIN t USING (id)),
c AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.scope, b.scope) AS scope, coalesce(a.seq, b.seq + 1) AS seq, coalesce(a.ext, b.ext) AS ext, CASE WHEN b.ext IS NULL THEN 'added' WHEN a.ext IS NULL THEN 'removed' WHEN a.content IS DISTINCT FROM b.content THEN 'changed' END AS change FROM s a FULL JOIN s b ON a.source = b.source AND a.scope = b.scope AND a.ext = b.ext AND a.seq = b.seq + 1),
l AS (SELECT source, scope, ext, max(seq) AS seen FROM s GROUP BY 1, 2, 3)
SELECT q.sweep_id, c.ext AS external_id, c.change FROM c JOIN q USING (source, scope, seq) WHERE c.change IS NOT NULL AND c.seq > 1
UNION SELECT q.sweep_id, l.ext, 'closed_at_wrong' FROM l JOIN q ON q.source = l.source AND q.scope = l.scope AND q.seq = q.last_seq JOIN job j ON j.source = l.source AND j.scope = l.scope AND lower(trim(j.external_id)) = l.ext WHERE (l.seen = q.last_seq) = (j.closed_at IS NOT NULL)"""

_CUR = "eur-cent|eurocent|cents|cent|ct|euros|euro|eur|€|us\\$|usd|\\$|sfr\\.?|fr\\.|chf|gbp|£|pln|zł|sek|kr|czk|kč"
_UNIT = "(?:^|[^\\p{{L}}])([kt]?)({0})(?:[^\\p{{L}}]|$)".format(_CUR)
_P4 = f"""WITH q AS (SELECT DISTINCT quote_id, job_id, amount_min, lower(trim(coalesce(currency, ''))) AS f, upper(trim(period)) AS fp, lower(replace(coalesce(raw_text, ''), chr(160), ' ')) AS t FROM salary_quote),
p AS (SELECT *, regexp_extract(t, '{_UNIT}', 1) AS tk, regexp_extract(t, '{_UNIT}', 2) AS tc, regexp_extract(f, '{_UNIT}', 1) AS fk, regexp_extract(f, '{_UNIT}', 2) AS fc, regexp_replace(regexp_extract(t, '(\\d{{1,3}}(?:[ .,''’]\\d{{3}})+(?:[.,]\\d{{1,2}})?|\\d+(?:[.,]\\d+)?)', 1), '[ ''’]', '', 'g') AS raw,
 CASE WHEN regexp_matches(t, '/\\s?h(?:[^\\p{{L}}]|$)|stunde|(?:^|[^\\p{{L}}])std|hour') THEN 'HOUR' WHEN regexp_matches(t, 'tagessatz|(?:^|[^\\p{{L}}])tag(?:[^\\p{{L}}]|$)|(?:^|[^\\p{{L}}])day') THEN 'DAY' WHEN regexp_matches(t, 'woche|week') THEN 'WEEK' WHEN regexp_matches(t, 'monat|mtl|month|mois') THEN 'MONTH' WHEN regexp_matches(t, 'jahr|jährlich|year|annual|annum|p\\.a\\.|par an') THEN 'YEAR' END AS tp FROM q),
n AS (SELECT *, CASE WHEN raw = '' OR (tc = '' AND tp IS NULL) THEN NULL WHEN tk <> '' THEN try_cast(replace(raw, ',', '.') AS DECIMAL(18, 6)) WHEN regexp_matches(raw, '[.,]\\d{{1,2}}$') THEN try_cast(regexp_replace(regexp_replace(raw, '[.,](\\d{{1,2}})$', ''), '\\D', '', 'g') || '.' || regexp_extract(raw, '[.,](\\d{{1,2}})$', 1) AS DECIMAL(18, 6)) ELSE try_cast(regexp_replace(raw, '\\D', '', 'g') AS DECIMAL(18, 6)) END AS tn FROM p),
m AS (SELECT quote_id, job_id, coalesce(tn, amount_min) AS amount, CASE WHEN tn IS NOT NULL AND tc <> '' THEN tc ELSE fc END AS c, CASE WHEN tn IS NOT NULL AND tc <> '' THEN tk ELSE fk END AS k, CASE WHEN tn IS NOT NULL THEN coalesce(tp, fp) ELSE fp END AS period FROM n),
v AS (SELECT quote_id, job_id, amount * CASE WHEN k <> '' THEN 1000 WHEN c IN ('ct', 'cent', 'cents', 'eur-cent', 'eurocent') THEN 0.01 ELSE 1 END AS amount, period, CASE WHEN c IN ('ct', 'cent', 'cents', 'eur-cent', 'eurocent', 'eur', 'euro', 'euros', '€') THEN 'EUR' WHEN c IN ('us$', 'usd', '$') THEN 'USD' WHEN c IN ('sfr.', 'sfr', 'fr.', 'chf') THEN 'CHF' WHEN c IN ('gbp', '£') THEN 'GBP' WHEN c IN ('pln', 'zł') THEN 'PLN' WHEN c IN ('sek', 'kr') THEN 'SEK' WHEN c IN ('czk', 'kč') THEN 'CZK' END AS currency FROM m),
e AS (SELECT quote_id, job_id, round(amount::DECIMAL(20, 6) * eur_per_unit::DECIMAL(8, 4) * periods_per_year, 0)::BIGINT AS min_eur_year FROM v JOIN fx_rate USING (currency) JOIN pay_period USING (period) WHERE amount > 0),
f AS (SELECT job_id, arg_max({{'s': salary_min_eur_year}}, (derive_version, derived_at)).s AS s FROM job_facet GROUP BY 1)
SELECT DISTINCT quote_id, min_eur_year, CASE WHEN s IS NULL THEN 'missing' WHEN abs(s - min_eur_year) > min_eur_year * 0.01 THEN 'wrong' ELSE 'ok' END AS facet_state FROM e LEFT JOIN f USING (job_id)"""

QUERIES = {"p4_found": p4_found, "p4_units": p4_units, "p4_hidden": p4_hidden, "p5_found": p5_found, "p6_found": p6_found, "p6_hidden": p6_hidden}
ORACLE = {"p4_found": _P4, "p5_found": _P5}
