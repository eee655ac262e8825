"""Queries for reports, orders, archives and small parsers, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..io import table
from ..operators import archive, series, tables
from .reference import _CURRENT, _FOLD, _NORM, _PAIR, ORACLE, QUERIES, _arms, _facets, _lists, _WITH, query

__all__ = ["ORACLE", "QUERIES"]

# --- conditional counts and totals ------------------------------------------------------------------------------------

_LAST = "SELECT * FROM source_sweep QUALIFY row_number() OVER (PARTITION BY source, scope ORDER BY started_at DESC, id DESC) = 1"
_STATES = """CASE WHEN blocked THEN 'blocked' WHEN NOT coalesce(ok, false) THEN 'failing' WHEN complete THEN 'complete' ELSE 'partial' END"""


def _last_sweeps(spark, d):
    s = tables.latest_by(table(spark, d, "source_sweep"), ["source", "scope"], ["started_at", "id"])
    return s.withColumn("state", F.when(F.col("blocked"), "blocked").when(~F.coalesce("ok", F.lit(False)), "failing").when(F.col("complete"), "complete").otherwise("partial"))


@query(f"WITH l AS (SELECT *, {_STATES} AS state FROM ({_LAST})) SELECT source, count(*) AS boards, count(*) FILTER (WHERE state = 'complete') AS complete, count(*) FILTER (WHERE state = 'partial') AS partial, count(*) FILTER (WHERE state = 'failing') AS failing, count(*) FILTER (WHERE state = 'blocked') AS blocked FROM l GROUP BY 1")
def board_states(spark, d):
    """Each source's boards by the state their latest sweep left them in; the states divide them."""
    s = _last_sweeps(spark, d)
    n = lambda x: F.count_if(F.col("state") == x).alias(x)
    return s.groupBy("source").agg(F.count("*").alias("boards"), n("complete"), n("partial"), n("failing"), n("blocked"))


@query(f"WITH l AS (SELECT *, {_STATES} AS state FROM ({_LAST})) SELECT count(*) AS boards, count(DISTINCT source) AS sources, count(*) FILTER (WHERE state IN ('failing', 'blocked')) AS troubled, count(*) FILTER (WHERE scope IS NULL) AS feeds, epoch_us(min(started_at)) AS oldest_us FROM l")
def board_totals(spark, d):
    return _last_sweeps(spark, d).agg(F.count("*").alias("boards"), F.count_distinct("source").alias("sources"), F.count_if(F.col("state").isin("failing", "blocked")).alias("troubled"), F.count_if(F.col("scope").isNull()).alias("feeds"), F.unix_micros(F.min("started_at")).alias("oldest_us"))


@query("SELECT source, count(*) AS seen, count(agency_hint) AS judged, count(*) FILTER (WHERE agency_hint) AS held, round(count(*) FILTER (WHERE agency_hint)::DOUBLE / nullif(count(agency_hint), 0), 6) AS held_share FROM job WHERE first_seen_at > TIMESTAMPTZ '2026-03-20 00:00:00+00' GROUP BY 1")
def judged_by_source(spark, d):
    """Seen, judged and held of the last weeks; what could not be judged counts in neither share."""
    j = table(spark, d, "job").where(F.col("first_seen_at") > F.lit("2026-03-20 00:00:00").cast("timestamp"))
    return j.groupBy("source").agg(F.count("*").alias("seen"), F.count("agency_hint").alias("judged"), F.count_if("agency_hint").alias("held"), F.round(F.count_if("agency_hint") / F.nullif(F.count("agency_hint"), F.lit(0)), 6).alias("held_share"))


@query("""SELECT lower(trim(company)) AS key, min(trim(company)) AS company, min(url) AS link, count(*) AS postings, count(DISTINCT scope) AS boards, (sum(count(*)) OVER ())::BIGINT AS all_postings FROM job WHERE company IS NOT NULL GROUP BY 1 ORDER BY postings DESC, key LIMIT 15""")
def company_groups(spark, d):
    """Employers whatever their case, with a representative, and the total over all of them before the cut."""
    g = table(spark, d, "job").where("company IS NOT NULL").groupBy(F.lower(F.trim("company")).alias("key")).agg(F.min(F.trim("company")).alias("company"), F.min("url").alias("link"), F.count("*").alias("postings"), F.count_distinct("scope").alias("boards"))
    return g.orderBy(F.desc("postings"), "key").limit(15).crossJoin(F.broadcast(g.agg(F.sum("postings").alias("all_postings"))))


@query("""WITH b AS (SELECT source, coalesce(scope, '-') AS scope, count(*) AS documents, count(DISTINCT sweep_id) AS sweeps FROM source_document GROUP BY 1, 2), t AS (SELECT * FROM b ORDER BY documents DESC, source, scope LIMIT 10)
SELECT 1 AS part, * FROM t UNION ALL SELECT 2, 'all', NULL, sum(documents)::BIGINT, sum(sweeps)::BIGINT FROM b""")
def top_boards_and_total(spark, d):
    """The ten largest boards, and one row for all."""
    b = table(spark, d, "source_document").groupBy("source", F.coalesce("scope", F.lit("-")).alias("scope")).agg(F.count("*").alias("documents"), F.count_distinct("sweep_id").alias("sweeps"))
    top = b.orderBy(F.desc("documents"), "source", "scope").limit(10).withColumn("part", F.lit(1))
    return top.unionByName(b.agg(F.lit("all").alias("source"), F.lit(None).cast("string").alias("scope"), F.sum("documents").alias("documents"), F.sum("sweeps").alias("sweeps"), F.lit(2).alias("part")))


@query("SELECT s.source, round(count(d.id)::DOUBLE / nullif(count(DISTINCT d.sweep_id), 0), 6) AS documents_a_sweep FROM (SELECT DISTINCT source FROM source_sweep) s LEFT JOIN source_document d ON d.source = s.source AND d.kind = 'detail' GROUP BY 1")
def details_per_sweep(spark, d):
    """Null for a source without any."""
    docs = table(spark, d, "source_document").where("kind = 'detail'").groupBy("source").agg(F.round(F.count("*") / F.count_distinct("sweep_id"), 6).alias("documents_a_sweep"))
    return table(spark, d, "source_sweep").select("source").distinct().join(docs, "source", "left")


@query("""SELECT source, error, n FROM (SELECT source, trim(regexp_replace(replace(error, coalesce(scope, '~'), '…'), '[0-9]+', '#', 'g')) AS error, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, trim(regexp_replace(replace(error, coalesce(scope, '~'), '…'), '[0-9]+', '#', 'g'))) AS r FROM source_sweep WHERE error IS NOT NULL GROUP BY 1, 2) WHERE r = 1""")
def commonest_errors(spark, d):
    """Errors with the board's name and all figures blanked; the commonest of each source, ties by text."""
    text = F.trim(F.regexp_replace(F.replace("error", F.coalesce("scope", F.lit("~")), F.lit("…")), "[0-9]+", "#"))
    e = table(spark, d, "source_sweep").where("error IS NOT NULL").groupBy("source", text.alias("error")).agg(F.count("*").alias("n"))
    return e.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "error")).alias("t")).select("source", "t.error", (-F.col("t.m")).alias("n"))


@query("""WITH s AS (SELECT event_type, CASE WHEN value >= 75 THEN 'stuck' WHEN value >= 50 THEN 'working' ELSE 'waiting' END AS state, ts FROM events) SELECT event_type, count(*) FILTER (WHERE state = 'waiting') AS waiting, count(*) FILTER (WHERE state = 'working') AS working, count(*) FILTER (WHERE state = 'stuck') AS stuck, epoch_us(min(ts) FILTER (WHERE state = 'waiting')) AS oldest_us FROM s GROUP BY 1""")
def backlog_states(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    state = F.when(F.col("value") >= 75, "stuck").when(F.col("value") >= 50, "working").otherwise("waiting")
    n = lambda x: F.count_if(state == x).alias(x)
    return e.groupBy("event_type").agg(n("waiting"), n("working"), n("stuck"), F.unix_micros(F.min(F.when(state == "waiting", F.col("at")))).alias("oldest_us"))


@query("""SELECT strftime(derived_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, derive_version, count(*) AS rows FROM job_facet WHERE work_mode <> 'remote' GROUP BY 1, 2""")
def versions_by_day(spark, d):
    return table(spark, d, "job_facet").where("work_mode <> 'remote'").groupBy(F.date_format("derived_at", "yyyy-MM-dd").alias("day"), "derive_version").agg(F.count("*").alias("rows"))


@query("""SELECT event_type, key, sum(val)::BIGINT AS total, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key, CAST(json_extract(props, '$.' || unnest(json_keys(props))) AS BIGINT) AS val FROM events) GROUP BY 1, 2""")
def property_totals(spark, d):
    """Every member of a JSON object rolled up into totals."""
    e = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "val"))
    return e.groupBy("event_type", "key").agg(F.sum("val").alias("total"), F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT list_sort(coalesce(countries, [])) AS area, count(*) AS postings FROM ({_CURRENT}) GROUP BY 1) SELECT array_to_string(area, '+') AS area, postings FROM a""")
def distinct_areas(spark, d):
    """Sets of countries, whatever their order, with how many postings name them."""
    return _facets(spark, d).groupBy(F.array_join(F.array_sort(F.coalesce("countries", F.array().cast("array<string>"))), "+").alias("area")).agg(F.count("*").alias("postings"))


# --- days, nights, layouts --------------------------------------------------------------------------------------------

_BERLIN = "(({0} AT TIME ZONE 'Europe/Berlin'))"


@query(f"""WITH l AS (SELECT source, {_BERLIN.format('started_at')}::DATE AS day, started_at, id, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS secs FROM source_sweep), n AS (SELECT source, day, arg_max({{'s': secs}}, (started_at, id)).s AS secs FROM l GROUP BY 1, 2)
SELECT source, strftime(day, '%Y-%m-%d') AS day, round(secs, 6) AS secs, round(quantile_cont(secs, 0.5) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS usual FROM n""")
def nights_against_usual(spark, d):
    """The last sweep of each local day beside the median of the seven counted days before."""
    s = table(spark, d, "source_sweep").select("source", P.local_day("started_at", "Europe/Berlin").alias("day"), F.struct("started_at", "id").alias("o"), ((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6).alias("secs"))
    n = s.groupBy("source", "day").agg(F.max_by("secs", "o").alias("secs"))
    # a row a source and day
    usual = F.percentile("secs", 0.5).over(Window.partitionBy("source").orderBy("day").rowsBetween(-7, -1))
    return n.select("source", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("secs", 6).alias("secs"), F.round(usual, 6).alias("usual"))


@query("""WITH n AS (SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'purchase') AS found, count(*) AS needles FROM events GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, round((sum(found) OVER w)::DOUBLE / nullif(sum(needles) OVER w, 0), 6) AS share FROM n WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def share_over_last_nights(spark, d):
    n = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("found"), F.count("*").alias("needles"))
    w = Window.orderBy("day").rowsBetween(-6, 0)
    # one row a day, so one task is enough
    return n.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.sum("found").over(w) / F.nullif(F.sum("needles").over(w), F.lit(0)), 6).alias("share"))


@query(f"""WITH m AS (SELECT id, extract('hour' FROM {_BERLIN.format('started_at')}) * 60 + extract('minute' FROM {_BERLIN.format('started_at')}) AS a, (epoch_us(finished_at) - epoch_us(started_at)) / 60000000 AS len FROM source_sweep WHERE finished_at IS NOT NULL)
SELECT id, a::INT AS start_minute, (a // 15 * 15)::INT AS from_quarter, (ceil((a + len) / 15) * 15)::INT AS to_quarter, round(100.0 * a / 1440, 4)::DOUBLE AS left_percent FROM m""")
def timeline_layout(spark, d):
    """Where each sweep stands on a local day: minutes from midnight, quarters around it, and its left edge in percent."""
    s = table(spark, d, "source_sweep").where("finished_at IS NOT NULL")
    a = P.minutes_of_day("started_at", "Europe/Berlin")
    length = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 60_000_000
    return s.select("id", a.alias("start_minute"), (F.floor(a / 15) * 15).cast("int").alias("from_quarter"), (F.ceil((a + length) / 15) * 15).cast("int").alias("to_quarter"), F.round(100.0 * a / 1440, 4).alias("left_percent"))


@query("""WITH d AS (SELECT (first_seen_at AT TIME ZONE 'UTC')::DATE AS day, count(*) AS n FROM job WHERE batch_no > 0 GROUP BY 1), s AS (SELECT unnest(generate_series(DATE '2026-02-23', DATE '2026-05-03', INTERVAL 1 DAY))::DATE AS day), j AS (SELECT s.day, n, row_number() OVER (ORDER BY s.day) AS r FROM s LEFT JOIN d USING (day)),
g AS (SELECT day, n, r - row_number() OVER (ORDER BY day) AS g FROM j WHERE n IS NOT NULL) SELECT strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last, count(*) AS days, sum(n)::BIGINT AS postings FROM g GROUP BY g""")
def runs_of_nights(spark, d):
    """Runs of days in a row that have postings, on a spine of days."""
    j = table(spark, d, "job").where("batch_no > 0")
    s = series.daily_series(j, F.to_date("first_seen_at"), {"n": F.count("*")}, "2026-02-23", "2026-05-03")
    # one row a day
    r = s.withColumn("g", F.datediff("day", F.lit("2026-01-01")) - F.row_number().over(Window.partitionBy(F.col("n").isNotNull()).orderBy("day"))).where("n IS NOT NULL")
    return r.groupBy("g").agg(F.date_format(F.min("day"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last"), F.count("*").alias("days"), F.sum("n").alias("postings")).drop("g")


@query("""SELECT id, (TIMESTAMPTZ '2026-04-20 12:00:00+00' >= (date_trunc('day', TIMESTAMP '2026-04-20 14:00:00') + INTERVAL '5 hours 30 minutes') AT TIME ZONE 'Europe/Berlin') AND coalesce(finished_at < ((date_trunc('day', TIMESTAMP '2026-04-20 14:00:00') + INTERVAL '5 hours 30 minutes') AT TIME ZONE 'Europe/Berlin'), true) AS due FROM source_sweep""")
def sweeps_due(spark, d):
    """Whether the local slot of 5:30 has passed without a sweep that ended since."""
    now = F.lit("2026-04-20 12:00:00").cast("timestamp")
    return table(spark, d, "source_sweep").select("id", P.is_due(now, F.col("finished_at"), 5, 30, "Europe/Berlin").alias("due"))


@query("""WITH b AS (SELECT source, count(*) FILTER (WHERE blocked) AS n FROM source_sweep GROUP BY 1) SELECT source, n AS blocked, CASE WHEN n = 0 THEN 0 ELSE least(2 ** (n - 1), 7)::INT END AS pause_days FROM b""")
def block_pauses(spark, d):
    b = table(spark, d, "source_sweep").groupBy("source").agg(F.count_if("blocked").alias("blocked"))
    return b.select("source", "blocked", P.pause_days(F.col("blocked")).alias("pause_days"))


# --- orders and first rows --------------------------------------------------------------------------------------------


@query(f"""SELECT j.id, f.salary_min_eur_year::DOUBLE AS salary FROM job j JOIN ({_CURRENT}) f ON f.job_id = j.id WHERE j.closed_at IS NULL AND f.salary_min_eur_year IS NOT NULL ORDER BY f.salary_min_eur_year DESC, j.id LIMIT 25""")
def top_open(spark, d):
    j = table(spark, d, "job").where("closed_at IS NULL").select("id").join(_facets(spark, d).where("salary_min_eur_year IS NOT NULL").select(F.col("job_id").alias("id"), "salary_min_eur_year"), "id")
    return j.orderBy(F.desc("salary_min_eur_year"), "id").limit(25).select("id", F.col("salary_min_eur_year").cast("double").alias("salary"))


@query(f"""SELECT source, scope, started_us FROM (SELECT source, scope, epoch_us(max(started_at) FILTER (WHERE ok)) AS started_us, bool_or(complete) AS c FROM source_sweep WHERE scope IS NOT NULL GROUP BY 1, 2) ORDER BY started_us ASC NULLS FIRST, c, source, scope LIMIT 30""")
def boards_to_try(spark, d):
    """Never tried boards first, then the longest ago; those once seen whole last among equals."""
    b = table(spark, d, "source_sweep").where("scope IS NOT NULL").groupBy("source", "scope").agg(F.unix_micros(F.max(F.when(F.col("ok"), F.col("started_at")))).alias("started_us"), F.bool_or("complete").alias("c"))
    return b.orderBy(F.asc_nulls_first("started_us"), "c", "source", "scope").limit(30).select("source", "scope", "started_us")


@query(f"""SELECT pair, arg_min(id, (closed_at IS NOT NULL, coalesce(epoch_us(closed_at), 0), id)) AS id, count(*) AS copies FROM (SELECT id, closed_at, {_PAIR} AS pair FROM job) GROUP BY 1 HAVING count(*) > 1""")
def first_open_copy(spark, d):
    """Of copies an open one first, then the one closed longest ago, then the smallest id."""
    j = table(spark, d, "job").select("id", "closed_at", T.pairing_key("title", "company", "scope").alias("pair"))
    return j.groupBy("pair").agg(F.min_by("id", F.struct(F.col("closed_at").isNotNull(), F.coalesce(F.unix_micros("closed_at"), F.lit(0)), F.col("id"))).alias("id"), F.count("*").alias("copies")).where("copies > 1")


@query("""SELECT source, arg_max(id, (fetched_at, id)) AS id, arg_max(try_cast(json_extract_string(payload, '$.salary_from') AS DOUBLE), (fetched_at, id)) AS salary FROM source_document WHERE json_extract_string(payload, '$.salary_from') IS NOT NULL AND json_extract_string(payload, '$.language') IS NOT NULL GROUP BY 1""")
def latest_with_members(spark, d):
    """The latest document of each source that has two members, one of them read as a number."""
    s = table(spark, d, "source_document").select("source", "id", "fetched_at", F.get_json_object("payload", "$.salary_from").alias("s"), F.get_json_object("payload", "$.language").alias("l")).where("s IS NOT NULL AND l IS NOT NULL")
    return s.groupBy("source").agg(F.max_by(F.struct("id", F.col("s").try_cast("double").alias("salary")), F.struct("fetched_at", "id")).alias("r")).select("source", "r.id", "r.salary")


@query("""SELECT id, json_extract_string(payload, '$.location.name') AS place, json_extract_string(payload, '$.departments[0].name') AS department FROM source_document WHERE json_extract(payload, '$.location') IS NOT NULL AND fetched_at > TIMESTAMPTZ '2026-04-10 00:00:00+00'""")
def member_history(spark, d):
    s = table(spark, d, "source_document").where((F.col("fetched_at") > F.lit("2026-04-10 00:00:00").cast("timestamp")) & F.get_json_object("payload", "$.location").isNotNull())
    return s.select("id", F.get_json_object("payload", "$.location.name").alias("place"), F.get_json_object("payload", "$.departments[0].name").alias("department"))


@query("""SELECT source, id, strftime(first_seen_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM job WHERE description IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY first_seen_at DESC, id DESC) <= 3""")
def newest_described(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("first_seen_at"), F.desc("id"))
    return table(spark, d, "job").where("description IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "id", F.date_format("first_seen_at", "yyyy-MM-dd").alias("day"))


# --- archive pages ----------------------------------------------------------------------------------------------------


@query("""SELECT id, sha256(coalesce(payload, '')) AS digest FROM source_document WHERE fetched_at >= TIMESTAMPTZ '2026-04-06 00:00:00+00' AND fetched_at < TIMESTAMPTZ '2026-04-07 00:00:00+00' AND id > 10 ORDER BY id LIMIT 200""")
def archived_documents_page(spark, d):
    """A page of one day's payloads, after an id."""
    return archive.day_page(table(spark, d, "source_document"), "fetched_at", "2026-04-06", "id", 10, 200).select("id", F.sha2(F.coalesce("payload", F.lit("")), 256).alias("digest"))


@query(f"""SELECT j.id, j.source, f.salary_min_eur_year::DOUBLE AS salary, coalesce(len(f.skills), 0) AS skills FROM job j LEFT JOIN ({_CURRENT}) f ON f.job_id = j.id WHERE j.first_seen_at >= TIMESTAMPTZ '2026-03-09 00:00:00+00' AND j.first_seen_at < TIMESTAMPTZ '2026-03-10 00:00:00+00' ORDER BY j.id LIMIT 200""")
def archived_postings_page(spark, d):
    """A page of the postings first seen on a day, with facets beside those that have them, decimals as doubles."""
    page = archive.day_page(table(spark, d, "job"), "first_seen_at", "2026-03-09", "id", None, 200).select(F.col("id").alias("job_id"), "source")
    return page.join(_facets(spark, d).select("job_id", "salary_min_eur_year", "skills"), "job_id", "left").select(F.col("job_id").alias("id"), "source", F.col("salary_min_eur_year").cast("double").alias("salary"), F.greatest(F.coalesce(F.size("skills"), F.lit(0)), F.lit(0)).cast("bigint").alias("skills"))


@query("SELECT strftime(closed_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS rows, min(id) AS first_id FROM job WHERE closed_at IS NOT NULL GROUP BY 1")
def closures_by_day(spark, d):
    return table(spark, d, "job").where("closed_at IS NOT NULL").groupBy(F.date_format("closed_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"), F.min("id").alias("first_id"))


@query("""SELECT stream, strftime(day, '%Y-%m-%d') AS day, rows FROM (SELECT 'documents' AS stream, (fetched_at AT TIME ZONE 'UTC')::DATE AS day, count(*) AS rows, 0 AS lag FROM source_document GROUP BY ALL UNION ALL SELECT 'postings', (first_seen_at AT TIME ZONE 'UTC')::DATE, count(*), 3 FROM job GROUP BY ALL UNION ALL SELECT 'closures', (closed_at AT TIME ZONE 'UTC')::DATE, count(*), 0 FROM job WHERE closed_at IS NOT NULL GROUP BY ALL) WHERE day <= DATE '2026-04-14' - 1 - lag::INT""")
def archive_streams(spark, d):
    """The days of three streams that can change no more, each with its own lag."""
    docs, jobs = table(spark, d, "source_document"), table(spark, d, "job")
    parts = [archive.frozen_days(t, at, "2026-04-14", lag).withColumn("stream", F.lit(s)) for s, t, at, lag in (("documents", docs, "fetched_at", 0), ("postings", jobs, "first_seen_at", 3), ("closures", jobs, "closed_at", 0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("stream", F.date_format("day", "yyyy-MM-dd").alias("day"), "rows")


# --- small parsers ----------------------------------------------------------------------------------------------------


@query("""SELECT id, coalesce(CASE WHEN regexp_full_match(trim(posted_at), '-?[0-9]{1,15}') THEN CASE WHEN abs(try_cast(trim(posted_at) AS BIGINT)) >= 1000000000000 THEN try_cast(trim(posted_at) AS BIGINT) * 1000 ELSE try_cast(trim(posted_at) AS BIGINT) * 1000000 END END,
CASE WHEN regexp_full_match(trim(posted_at), '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?') THEN epoch_us(try_cast(CASE WHEN regexp_matches(trim(posted_at), '[T ][0-9]{2}:[0-9]{2}($|Z|[+-])') THEN regexp_replace(trim(posted_at), '([T ][0-9]{2}:[0-9]{2})', '\\1:00') ELSE trim(posted_at) END AS TIMESTAMPTZ)) END) AS us FROM job""")
def plain_instants(spark, d):
    """ISO texts and figures alone, naive ones as UTC; other writings are null here."""
    return table(spark, d, "job").select("id", P.instant("posted_at").alias("us"))


@query("""SELECT id, nullif(trim(regexp_replace(regexp_extract(location_text, '^([^,]*)', 1), '[\\s\\x{00a0}]+', ' ', 'g')), '') AS head, length(trim(company)) BETWEEN 1 AND 4 AND regexp_full_match(trim(company), '\\p{Lu}+') AS code, coalesce(regexp_full_match(scope, '[A-Za-z0-9][A-Za-z0-9._-]*') AND length(scope) <= 80, false) AS slug FROM job""")
def short_texts(spark, d):
    return table(spark, d, "job").select("id", P.before_comma("location_text").alias("head"), P.looks_like_code("company").alias("code"), P.is_slug("scope").alias("slug"))


@query("""WITH u AS (SELECT id, url || '?utm_source=a&b=%20c&UTM_Medium=x&ref=&d#f' AS u FROM job WHERE url IS NOT NULL) SELECT id, regexp_replace(u, '[?].*$', '') || '?b=%20c&d' AS link, regexp_extract(regexp_extract(lower(u), '^[a-z]+://([^/?#:]+)', 1), '([^.]+\\.[^.]+|[^.]+)$', 1) AS site FROM u""")
def links_without_tracking(spark, d):
    u = F.concat("url", F.lit("?utm_source=a&b=%20c&UTM_Medium=x&ref=&d#f"))
    return table(spark, d, "job").where("url IS NOT NULL").select("id", P.without_tracking(u).alias("link"), P.registrable(u).alias("site"))


@query("""SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:4], lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS text FROM embeddings""")
def vector_texts(spark, d):
    return table(spark, d, "embeddings").select("vec_id", P.vector_text(F.slice("embedding", 1, 4)).alias("text"))


@query("""WITH t AS (SELECT event_id, event_type || ' {"score": ' || (value * 1.3)::INT || ', "why": "{x}"} end' AS t FROM events), s AS (SELECT event_id, try_cast(json_extract_string(regexp_extract(t, '(?s)(\\{.*\\})', 1), '$.score') AS INT) AS n FROM t) SELECT event_id, CASE WHEN n BETWEEN 0 AND 100 THEN n END AS score FROM s""")
def scores_in_texts(spark, d):
    """A score inside a longer answer; what lies outside 0 to 100 is discarded, not clamped."""
    t = F.concat("event_type", F.lit(' {"score": '), F.bround(F.col("value") * 1.3).cast("int").cast("string"), F.lit(', "why": "{x}"} end'))
    return table(spark, d, "events").select("event_id", P.score_in(t).alias("score"))


@query(f"""WITH w AS (SELECT j.id, list_filter(string_split(j.title, ' '), lambda x: trim(x) <> '') || coalesce(f.skills, []) AS b FROM job j JOIN ({_CURRENT}) f ON f.job_id = j.id WHERE j.title IS NOT NULL)
SELECT id, array_to_string(list_filter(b, lambda x, i: trim(x) <> '' AND list_position(list_transform(b, lambda y: lower(trim(y))), lower(trim(x))) = i)[1:8], '|') AS words FROM w""")
def merged_query_words(spark, d):
    """A title's words, then its skills, each once whatever its case, at most eight."""
    f = _facets(spark, d).select("job_id", "skills")
    j = table(spark, d, "job").where("title IS NOT NULL").select(F.col("id").alias("job_id"), "title").join(f, "job_id")
    return j.select(F.col("job_id").alias("id"), F.array_join(P.merged_words(F.split("title", " "), F.col("skills")), "|").alias("words"))


@query(f"""SELECT j.id, CASE WHEN coalesce(j.title, '') = '' THEN 'no title' WHEN j.closed_at IS NOT NULL THEN 'closed' WHEN f.job_id IS NULL THEN 'not derived' WHEN NOT coalesce(len(f.place_ids) > 0, false) THEN 'not placed' WHEN e.job_id IS NULL THEN 'not embedded' ELSE 'ready' END AS stage FROM job j LEFT JOIN ({_CURRENT}) f ON f.job_id = j.id LEFT JOIN (SELECT DISTINCT job_id FROM job_embedding) e ON e.job_id = j.id""")
def first_stage_missing(spark, d):
    """The first stage a posting has not passed."""
    f = _facets(spark, d).select("job_id", F.size("place_ids").alias("n"), F.lit(True).alias("derived"))
    e = table(spark, d, "job_embedding").select("job_id").distinct().withColumn("embedded", F.lit(True))
    j = table(spark, d, "job").select(F.col("id").alias("job_id"), "title", "closed_at").join(f, "job_id", "left").join(e, "job_id", "left")
    stage = P.first_reason([("no title", F.col("title") != ""), ("closed", F.col("closed_at").isNull()), ("not derived", F.col("derived")), ("not placed", F.col("n") > 0), ("not embedded", F.col("embedded"))], "ready")
    return j.select(F.col("job_id").alias("id"), stage.alias("stage"))


# --- measures ---------------------------------------------------------------------------------------------------------


@query(f"""{_WITH}, j AS (SELECT f.q, f.id, f.pos AS a, h.pos AS b FROM fulls f LEFT JOIN heads h USING (q, id)) SELECT q, count(*) FILTER (WHERE b IS NULL) AS lost, count(*) FILTER (WHERE b - a > 5) AS slid, quantile_cont(b::DOUBLE, 0.5) AS median_place FROM j GROUP BY 1""")
def rank_slides(spark, d):
    """Of each query's list, what a second list lost, what slid by more than five places, and the median place there."""
    a, b = _arms(spark, d)
    j = a.withColumnRenamed("pos", "a").join(b.withColumnRenamed("pos", "b"), ["q", "id"], "left")
    return j.groupBy("q").agg(F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("b") - F.col("a") > 5).alias("slid"), F.percentile("b", 0.5).alias("median_place"))


@query(f"""WITH n AS (SELECT id, tier, {_NORM.format("json_extract_string(listing, '$.stellenangebotsTitel')")} AS t FROM needles), j AS (SELECT {_NORM.format('title')} AS t, count(*) AS n FROM job GROUP BY 1)
SELECT tier, count(*) AS items, count(j.n) AS found, coalesce(sum(j.n), 0)::BIGINT AS matches, round(count(j.n)::DOUBLE / count(*), 6) AS recall FROM n LEFT JOIN j USING (t) GROUP BY 1""")
def needles_by_tier(spark, d):
    """How many evaluation items of each tier find a posting of the same normalised title."""
    n = table(spark, d, "needles").select("tier", T.normalise(F.get_json_object("listing", "$.stellenangebotsTitel")).alias("t"))
    j = table(spark, d, "job").groupBy(T.normalise("title").alias("t")).agg(F.count("*").alias("n"))
    k = n.join(j, "t", "left")
    return k.groupBy("tier").agg(F.count("*").alias("items"), F.count("n").alias("found"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.round(F.count("n") / F.count("*"), 6).alias("recall"))


_SPELL = f"trim(regexp_replace({_FOLD.format('city')}, '[\\s\\x{{00a0}}]+', ' ', 'g'))".replace('{{', '{').replace('}}', '}')
_BARE = f"trim(regexp_replace(regexp_replace(regexp_replace({_SPELL}, '\\(.*?\\)|\\[.*?\\]', ' ', 'g'), '^[0-9]{{4,5}}\\s+|\\s+[0-9]{{1,2}}$', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT job_id, unnest(cities) AS city FROM ({_CURRENT})), v AS (SELECT DISTINCT job_id, city, unnest([1, 2, 3, 4]) AS n, unnest([{_SPELL}, {_BARE}, replace({_BARE}, ' ', '-'), trim(regexp_extract({_BARE}, '^([^/–-]*)', 1))]) AS s FROM c WHERE city IS NOT NULL),
p AS (SELECT {_FOLD.format('name')} AS s, id, population, row_number() OVER w AS r, lead(population) OVER w AS nxt FROM place WINDOW w AS (PARTITION BY {_FOLD.format('name')} ORDER BY population DESC, id)), k AS (SELECT s, id, nxt IS NULL OR population >= 10 * nxt AS sure FROM p WHERE r = 1),
h AS (SELECT v.job_id, v.city, arg_min({{'id': CASE WHEN k.sure THEN k.id END}}, v.n) AS f FROM v JOIN k USING (s) WHERE v.s <> '' GROUP BY 1, 2) SELECT job_id, city, f.id AS place_id FROM h""")
def resolved_towns(spark, d):
    """Towns as spelled, resolved by the first spelling that stands in the list; null where two places of the name are alike."""
    p = table(spark, d, "place").select(T.fold("name").alias("s"), "id", "population")
    w = Window.partitionBy("s").orderBy(F.desc("population"), "id")
    k = p.select("s", "id", "population", F.row_number().over(w).alias("r"), F.lead("population").over(w).alias("nxt")).where("r = 1").select("s", F.when(F.col("nxt").isNull() | (F.col("population") >= 10 * F.col("nxt")), F.col("id")).alias("id"))
    v = _facets(spark, d).select("job_id", F.explode("cities").alias("city")).where("city IS NOT NULL").select("job_id", "city", F.posexplode(P.place_spellings("city")).alias("n", "s")).distinct()
    return v.join(k, "s").groupBy("job_id", "city").agg(F.min_by(F.struct("id"), "n").alias("f")).select("job_id", "city", F.col("f.id").alias("place_id"))


@query("""SELECT id, country, CASE WHEN country IN ('DE', 'AT', 'CH') THEN population >= 1000 ELSE population >= 15000 END AND regexp_full_match(name, '[\\p{Latin}\\s.''’()/-]+') AS kept FROM place""")
def gazetteer_rows(spark, d):
    """What a list of places keeps: all towns of dense countries, larger ones elsewhere, Latin names only."""
    dense = F.col("country").isin("DE", "AT", "CH")
    return table(spark, d, "place").select("id", "country", (F.when(dense, F.col("population") >= 1000).otherwise(F.col("population") >= 15000) & F.col("name").rlike(r"^[\p{IsLatin}\s.'’()/-]+$")).alias("kept"))


@query("""SELECT source, count(*) AS payloads, count(*) FILTER (WHERE json_type(payload, '$.departments') IS NULL) AS missing, count(*) FILTER (WHERE json_type(payload, '$.departments') = 'ARRAY') AS lists, count(*) FILTER (WHERE json_type(payload, '$.departments') IS NOT NULL AND json_type(payload, '$.departments') <> 'ARRAY') AS not_lists FROM source_document WHERE kind = 'listing' GROUP BY 1""")
def payload_guards(spark, d):
    """Whether a member that should be a list is there, and is one."""
    m = F.get_json_object("payload", "$.departments")
    s = table(spark, d, "source_document").where("kind = 'listing'").select("source", m.alias("m"))
    return s.groupBy("source").agg(F.count("*").alias("payloads"), F.count_if(F.col("m").isNull()).alias("missing"), F.count_if(F.col("m").startswith("[")).alias("lists"), F.count_if(F.col("m").isNotNull() & ~F.col("m").startswith("[")).alias("not_lists"))


@query("""WITH c AS (SELECT vec_id AS id, label, unnest([1, 2, 3, 4]) AS n, unnest([embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]])::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS q, embedding[1:16]::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.q, c.id, max(round(list_cosine_similarity(q.v, c.v), 6)) AS sim FROM q, c WHERE q.q <> c.id GROUP BY 1, 2) SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS pos FROM s QUALIFY pos <= 5""")
def best_chunks(spark, d):
    """Rows by the nearest of their four chunks to a query's first."""
    from ..operators.retrieval import dense_topk

    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q"), F.slice("embedding", 1, 16).alias("vec"))
    chunks = e.select((F.col("vec_id")).alias("id"), F.explode(F.array(*[F.slice("embedding", 1 + 16 * i, 16) for i in range(4)])).alias("vec"))
    # a row's chunks may stand before one another: four times as many are fetched, then the best of each row counts
    near = dense_topk(q, chunks, 20)
    best = near.groupBy("q", "id").agg(F.min("pos").alias("p"))
    # equal similarities are ordered by id there, so the best place of a row keeps the order
    return best.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("p", "id"))).where("pos <= 5").select("q", "id", "pos")


@query("""WITH m AS (SELECT label AS q, list(embedding::DOUBLE[]) AS l FROM embeddings GROUP BY 1), c AS (SELECT q, list_transform(range(1, 65), lambda i: list_avg(list_transform(l, lambda e: e[i]))) AS v FROM m),
s AS (SELECT c.q, e.vec_id AS id, round(list_cosine_similarity(c.v, e.embedding::DOUBLE[]), 5) AS sim FROM c, embeddings e) SELECT q, count(*) FILTER (WHERE e.label = s.q) AS own FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS pos FROM s QUALIFY pos <= 10) s JOIN embeddings e ON e.vec_id = s.id GROUP BY 1""")
def mean_vector_neighbours(spark, d):
    """The mean of each label's vectors as a query: how many of the ten nearest rows have the label."""
    from ..operators.retrieval import dense_topk

    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    q = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select((-F.col("label") - 1).cast("bigint").alias("q"), F.transform("v", lambda r: r["x"]).alias("vec"))
    near = dense_topk(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")), 10, digits=5)
    j = near.select((-F.col("q") - 1).cast("int").alias("q"), "id").join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return j.groupBy("q").agg(F.count_if(F.col("label") == F.col("q")).alias("own"))


@query(f"""{_WITH}, g AS (SELECT arm, q, count(*) AS n, min(pos) AS best FROM l WHERE id % 2 = 0 GROUP BY 1, 2) SELECT arm, count(*) AS queries, sum(n)::BIGINT AS graded, max(best) AS worst_best FROM g GROUP BY 1""")
def grades_by_arm(spark, d):
    """Of each arm's lists how many judged rows there are, and the worst place the first of them has."""
    g = _lists(spark, d).where("id % 2 = 0").groupBy("arm", "q").agg(F.count("*").alias("n"), F.min("pos").alias("best"))
    return g.groupBy("arm").agg(F.count("*").alias("queries"), F.sum("n").alias("graded"), F.max("best").alias("worst_best"))
