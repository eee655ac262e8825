"""Further queries over whole tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from ..operators import derive, discovery, evaluation, retrieval, series
from .reference import _ALNUM, _FOLD, _NORM, ORACLE, QUERIES, _arms, _lists, _WITH, query

__all__ = ["ORACLE", "QUERIES"]


def _case(column: str, terms: tuple) -> str:
    t = f"(coalesce({_FOLD.format(column)}, '') || ' ')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({t}, {w!r})' for w in words)} THEN '{label}'" for label, words in terms) + " ELSE 'unknown' END"


@query(f"SELECT id, {_case('title', derive.SENIORITY)} AS seniority, {_case('location_text', derive.WORKPLACE)} AS workplace, {_case('employment_type_hint', derive.CONTRACT)} AS contract FROM job")
def title_terms(spark, d):
    """A null field gives unknown; the others are read all the same."""
    return table(spark, d, "job").select("id", derive.first_term("title", derive.SENIORITY).alias("seniority"), derive.first_term("location_text", derive.WORKPLACE).alias("workplace"), derive.first_term("employment_type_hint", derive.CONTRACT).alias("contract"))


@query("""SELECT id, place FROM (SELECT id, trim(regexp_replace(unnest(regexp_split_to_array(coalesce(location_text, ''), '(?i)[;|]|\\s+(?:or|oder)\\s+')), '[\\s\\x{00a0}]+', ' ', 'g')) AS place FROM job) WHERE place <> ''""")
def places_named(spark, d):
    return table(spark, d, "job").select("id", F.explode(derive.places_named("location_text")).alias("place"))


@query()
def plain_descriptions(spark, d):
    return table(spark, d, "job").select("id", derive.html_to_text(F.col("description")).alias("description"))


_TEXT = "concat_ws(chr(10), title, company, location_text, description)"


@query(f"""WITH k AS (SELECT id, md5({_TEXT}) AS k FROM job), r AS (SELECT id, list_transform(range(64), lambda i: ('0x' || substr(md5(k || '/' || i), 1, 8))::BIGINT / 2147483648.0 - 1) AS v FROM k)
SELECT id, i, round(v[i + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) + 0.0 AS x FROM r, (SELECT unnest(range(64)) AS i)""")
def hashed_embeddings(spark, d):
    """Every number of the vector of each posting's whole text."""
    j = table(spark, d, "job").select("id", F.concat_ws("\n", "title", "company", "location_text", "description").alias("text"))
    return j.select("id", F.posexplode(derive.hashed_vector("text")).alias("i", "x")).select("id", F.col("i").cast("bigint").alias("i"), (F.round("x", 5) + 0.0).alias("x"))


RULES = (("jobs.example", "board"), ("arbeitsagentur-feed.example", "agency"))


@query("""WITH h AS (SELECT id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS h FROM job),
r AS (SELECT id, h, CASE WHEN h = '' OR h IS NULL THEN 'no_url' WHEN h LIKE '%.jobs.example' THEN 'board' WHEN h = 'arbeitsagentur-feed.example' THEN 'agency' ELSE 'unknown_host' END AS k, (SELECT regexp_extract(j.url, '^[a-z]+://[^/]*/([^/?#]+)', 1) FROM job j WHERE j.id = h.id) AS p FROM h)
SELECT id, CASE WHEN k IN ('board', 'agency') THEN 'board' ELSE k END AS result, CASE WHEN k IN ('board', 'agency') THEN k END AS source, CASE k WHEN 'board' THEN regexp_extract(h, '([^.]+)\\.jobs\\.example$', 1) WHEN 'agency' THEN p END AS scope FROM r""")
def boards_of_links(spark, d):
    return table(spark, d, "job").select("id", discovery.resolve_board("url", RULES).alias("r")).select("id", "r.*")


@query("""WITH t AS (SELECT id, scope, unnest(list_distinct(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: length(x) BETWEEN 2 AND 80))) AS t FROM job WHERE url IS NOT NULL)
SELECT id, t AS token FROM t UNION SELECT id, scope || ':' || t FROM t WHERE scope IS NOT NULL""")
def link_tokens(spark, d):
    return table(spark, d, "job").where("url IS NOT NULL").select("id", F.explode(discovery.id_tokens("url", "scope")).alias("token"))


@query(f"""WITH p AS (SELECT id, {_NORM.format('title')} AS t, {_ALNUM.format('company')} AS c, unnest(regexp_split_to_array(coalesce(location_text, ''), '(?i)[;|]|\\s+(?:or|oder)\\s+')) AS place FROM job),
q AS (SELECT DISTINCT id, t, c, {_NORM.format("trim(regexp_replace(place, '[\\s\\x{{00a0}}]+', ' ', 'g'))").replace('{{', '{').replace('}}', '}')} AS p FROM p WHERE t <> '' AND c <> ''), r AS (SELECT * FROM q WHERE p <> ''),
m AS (SELECT t, c, p, min(id) AS m FROM r GROUP BY ALL), h AS (SELECT r.id, min(m.m) AS held FROM r JOIN m USING (t, c, p) GROUP BY 1)
SELECT j.id, coalesce(h.held, j.id) AS held FROM job j LEFT JOIN h USING (id)""")
def linked_copies(spark, d):
    return discovery.link_copies(table(spark, d, "job").select("id", "title", "company", derive.places_named("location_text").alias("places")))


@query("""WITH f AS (SELECT source, coalesce(scope, '-') AS scope, batch_no, count(*) AS n FROM job GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY source) AS s1, sum(n) OVER (PARTITION BY source, scope) AS s2 FROM f),
l AS (SELECT *, CASE WHEN s1 <= 40 THEN 1 WHEN s2 <= 40 THEN 2 ELSE 3 END AS level FROM s)
SELECT level, source, CASE WHEN level > 1 THEN scope END AS scope, CASE WHEN level > 2 THEN batch_no END AS batch_no, sum(n)::BIGINT AS rows FROM l GROUP BY ALL""")
def scan_plan(spark, d):
    return discovery.plan_scans(table(spark, d, "job").select("source", F.coalesce("scope", F.lit("-")).alias("scope"), "batch_no"), ["source", "scope", "batch_no"], 40)


@query("""SELECT lower(trim(external_id, E' \\t')) AS external_id, arg_max(id, (fetched_at, id)) AS id, epoch_us(max(fetched_at)) AS at_us FROM source_document WHERE scope IS NULL AND fetched_at > TIMESTAMPTZ '2026-04-13 00:00:00+00' GROUP BY 1""")
def feed_delta(spark, d):
    s = table(spark, d, "source_document").where("scope IS NULL").select(F.lower(F.trim(F.regexp_replace("external_id", r"\t", " "))).alias("external_id"), "fetched_at", "id")
    return discovery.delta_window(s, "external_id", "fetched_at", F.lit("2026-04-13 00:00:00").cast("timestamp"), "id").select("external_id", "id", F.unix_micros("fetched_at").alias("at_us"))


@query("""WITH n AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, n, quantile_cont(n::DOUBLE, 0.5) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS usual FROM n""")
def days_against_usual(spark, d):
    out = series.against_previous(table(spark, d, "events"), F.to_date("ts"), F.count("*"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH d AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events WHERE event_type = 'purchase'), k AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM d)), j AS (SELECT k, user_id FROM d JOIN k USING (day))
SELECT strftime(k.day, '%Y-%m-%d') AS day, (SELECT count(*) FROM j a WHERE a.k = k.k AND NOT EXISTS (SELECT 1 FROM j b WHERE b.k = k.k - 1 AND b.user_id = a.user_id)) AS added, (SELECT count(*) FROM j a WHERE a.k = k.k - 1 AND NOT EXISTS (SELECT 1 FROM j b WHERE b.k = k.k AND b.user_id = a.user_id)) AS removed FROM k WHERE k.k > 1""")
def buyers_changed(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    return series.set_changes(e, "day", "user_id")


@query("""WITH n AS (SELECT ts::DATE AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT strftime(day, '%Y-%m-%d') AS day, quantile_cont(n::DOUBLE, 0.5) AS median, sum(n)::BIGINT AS pooled FROM n GROUP BY 1""")
def daily_medians(spark, d):
    n = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("day").agg(F.percentile("n", 0.5).alias("median"), F.sum("n").alias("pooled"))


@query("""WITH s AS (SELECT user_id, event_type, (coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), epoch_us(TIMESTAMP '2024-02-01')) - epoch_us(ts)) / 1e6 AS s FROM events) SELECT event_type, count(*) AS n, round(sum(s), 3) AS seconds FROM s GROUP BY 1""")
def stage_seconds(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = series.spans(e, ["user_id"], "at", "event_id", "event_type", F.lit("2024-02-01").cast("timestamp"))
    return s.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


@query("""WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events), b AS (SELECT *, (place - 1) // 10 AS b FROM s), m AS (SELECT user_id, b, coalesce(quantile_cont(value, 0.5) < 50, true) AS w FROM b GROUP BY 1, 2),
r AS (SELECT *, sum(w::INT) OVER (PARTITION BY user_id ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS r FROM m), t AS (SELECT user_id, min(b) AS t FROM r WHERE r = 2 GROUP BY 1)
SELECT user_id, count(*) AS kept FROM b LEFT JOIN t USING (user_id) WHERE t IS NULL OR b <= t GROUP BY 1""")
def kept_until_weak(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "events").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return series.until_weak(s, ["user_id"], "place", "value", 10, 50.0).groupBy("user_id").agg(F.count("*").alias("kept"))


@query(f"{_WITH} SELECT DISTINCT q, id FROM l WHERE pos <= 10")
def judgement_pool(spark, d):
    return _lists(spark, d).where("pos <= 10").select("q", "id").distinct()


@query(f"{_WITH} SELECT b.label, count(*) AS found, round(avg(f.pos), 4) AS mean_place, round(stddev_pop(f.pos), 4) AS spread, max(f.pos) - min(f.pos) AS range FROM fulls f JOIN embeddings b ON b.vec_id = f.id GROUP BY 1")
def places_by_label(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return _arms(spark, d)[0].join(e, "id").groupBy("label").agg(F.count("*").alias("found"), F.round(F.avg("pos"), 4).alias("mean_place"), F.round(F.stddev_pop("pos"), 4).alias("spread"), (F.max("pos") - F.min("pos")).alias("range"))


@query("""SELECT count(*) AS postings, count(*) FILTER (WHERE closed_at IS NULL) AS open, count(DISTINCT source) AS sources, count(DISTINCT scope) AS boards, count(*) FILTER (WHERE description IS NULL) AS bare, (SELECT count(DISTINCT embedding_version) FROM job_embedding) AS spaces, (SELECT count(DISTINCT job_id) FROM job_embedding) AS embedded FROM job""")
def overview(spark, d):
    j = table(spark, d, "job").agg(F.count("*").alias("postings"), F.count_if(F.col("closed_at").isNull()).alias("open"), F.count_distinct("source").alias("sources"), F.count_distinct("scope").alias("boards"), F.count_if(F.col("description").isNull()).alias("bare"))
    e = table(spark, d, "job_embedding").agg(F.count_distinct("embedding_version").alias("spaces"), F.count_distinct("job_id").alias("embedded"))
    # one row beside one row
    return j.crossJoin(e)


@query("""SELECT json_extract_string(payload, '$.language') AS language, count(*) AS n FROM source_document WHERE kind = 'listing' GROUP BY 1""")
def payload_languages(spark, d):
    return table(spark, d, "source_document").where("kind = 'listing'").groupBy(F.get_json_object("payload", "$.language").alias("language")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT tier, source, count(*) AS n, count(*) FILTER (WHERE json_extract_string(detail, '$.stellenangebotsBeschreibung') IS NOT NULL) AS texts FROM needles GROUP BY GROUPING SETS ((tier), (source), ())) SELECT * FROM r""")
def needle_sets(spark, d):
    n = table(spark, d, "needles").withColumn("texts", F.get_json_object("detail", "$.stellenangebotsBeschreibung").isNotNull())
    return n.groupingSets([["tier"], ["source"], []], "tier", "source").agg(F.count("*").alias("n"), F.count_if("texts").alias("texts"))
