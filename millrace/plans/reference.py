"""Queries over whole tables for the engine's operators, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import wilson
from ..io import table
from ..operators import archive, evaluation, joins, retrieval, series, spatial, tables
from ..sources import payloads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- text, identity ---------------------------------------------------------------------------------------------------

_FOLD = "strip_accents(replace(lower({0}), 'ß', 'ss'))"
_NORM = "trim(regexp_replace(regexp_replace(strip_accents(replace(lower({0}), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), '\\s+', ' ', 'g'))"
_ALNUM = "regexp_replace(strip_accents(replace(lower({0}), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(f"SELECT id, {_FOLD.format('title')} AS folded, {_NORM.format('title')} AS normal FROM job")
def folded_titles(spark, d):
    return table(spark, d, "job").select("id", T.fold("title").alias("folded"), T.normalise("title").alias("normal"))


@query("SELECT id, nullif(trim(regexp_replace(title, '[\\s\\x{00a0}]+', ' ', 'g')), '') AS title FROM job")
def collapsed_titles(spark, d):
    return table(spark, d, "job").select("id", T.collapse("title").alias("title"))


_CONTENT = "sha256(concat_ws('|', '2', coalesce({0}, ''), coalesce({1}, ''), coalesce({2}, ''), coalesce({3}, '')))".format(*[_NORM.format(c) for c in ("title", "company", "location_text", "description")])


@query(f"SELECT {_CONTENT} AS digest, count(*) AS copies, min(id) AS first_id FROM job GROUP BY 1")
def content_digests(spark, d):
    j = table(spark, d, "job").select("id", T.content_digest(2, "title", "company", "location_text", "description").alias("digest"))
    return j.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))


_PAIR = "sha256(concat_ws('|', coalesce({0}, ''), coalesce({1}, '')))".format(_NORM.format("title"), _ALNUM.format("coalesce(scope, company)"))


@query(f"SELECT {_PAIR} AS pair, count(*) AS copies, count(DISTINCT source) AS sources FROM job GROUP BY 1 HAVING count(*) > 1")
def pairing_groups(spark, d):
    j = table(spark, d, "job").select("source", T.pairing_key("title", "company", "scope").alias("pair"))
    return j.groupBy("pair").agg(F.count("*").alias("copies"), F.count_distinct("source").alias("sources")).where("copies > 1")


@query(f"""WITH j AS (SELECT source, closed_at, {_PAIR} AS pair FROM job), g AS (SELECT pair, count(DISTINCT source) AS n FROM j GROUP BY 1)
SELECT source, count(*) AS postings, count(*) FILTER (WHERE closed_at IS NULL) AS open, count(*) FILTER (WHERE g.n = 1) AS only_source FROM j JOIN g USING (pair) GROUP BY 1""")
def coverage_by_source(spark, d):
    j = table(spark, d, "job").select("source", "closed_at", T.pairing_key("title", "company", "scope").alias("pair"))
    # one partial row for each pair and source; what is counted twice is never the whole table
    g = j.groupBy("pair", "source").agg(F.count("*").alias("n"), F.count_if(F.col("closed_at").isNull()).alias("o"))
    g = g.withColumn("sources", F.count("*").over(Window.partitionBy("pair")))
    return g.groupBy("source").agg(F.sum("n").alias("postings"), F.sum("o").alias("open"), F.sum(F.when(F.col("sources") == 1, F.col("n")).otherwise(0)).alias("only_source"))


@query("""SELECT id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '([^.]+\\.[^.]+|[^.]+)$', 1) AS site,
array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), ' ') AS path FROM job WHERE url IS NOT NULL""")
def url_parts(spark, d):
    return table(spark, d, "job").where("url IS NOT NULL").select("id", T.host("url").alias("host"), T.site("url").alias("site"), F.array_join(T.path_segments("url"), " ").alias("path"))


@query("""SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n FROM job WHERE url IS NOT NULL GROUP BY 1 ORDER BY n DESC, host LIMIT 10""")
def top_hosts(spark, d):
    return table(spark, d, "job").where("url IS NOT NULL").groupBy(T.host("url").alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query("""SELECT u AS url, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all('see ' || url || '. Or (' || url || ') and http://x.example/a, too', 'https?://[^\\s"''<>\\[\\](){}.,]+(?:[.,]+[^\\s"''<>\\[\\](){}.,]+)*'))) AS u FROM job WHERE url IS NOT NULL) GROUP BY 1""")
def urls_in_text(spark, d):
    t = F.concat(F.lit("see "), "url", F.lit(". Or ("), "url", F.lit(") and http://x.example/a, too"))
    return table(spark, d, "job").where("url IS NOT NULL").select(F.explode(T.urls_in(t)).alias("url")).groupBy("url").agg(F.count("*").alias("n"))


@query("""SELECT id, v || regexp_replace(url, '^https?://(www\\.)?(.*?)/*$', '\\2') || s AS variant FROM job, (VALUES ('http://'), ('http://www.'), ('https://'), ('https://www.')) a(v), (VALUES (''), ('/')) b(s) WHERE url IS NOT NULL""")
def url_spellings(spark, d):
    return table(spark, d, "job").where("url IS NOT NULL").select("id", F.explode(T.url_variants("url")).alias("variant"))


# --- sources ----------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT id, source, lower(trim(external_id, E' \\t')) AS external_id, payload::JSON AS j,
 CASE WHEN source = 'arbeitsagentur' THEN 'a' WHEN source IN ('personio', 'rippling', 'workday') THEN 's' ELSE 'b' END AS f FROM source_document WHERE kind = 'listing'),
q AS (SELECT id, source, CASE f WHEN 'a' THEN j->>'$.stellenangebotsTitel' WHEN 's' THEN j->>'$.name' ELSE j->>'$.title' END AS title,
 CASE f WHEN 'a' THEN j->>'$.firma' WHEN 's' THEN j->>'$.subcompany' ELSE j->>'$.company_name' END AS company,
 CASE f WHEN 'a' THEN j->>'$.stellenlokationen[0].adresse.ort' WHEN 's' THEN j->>'$.office' ELSE j->>'$.location.name' END AS place,
 CASE f WHEN 'a' THEN j->>'$.gehaltsspanneVon' WHEN 's' THEN j->>'$.salary' ELSE j->>'$.salary_from' END AS salary,
 CASE f WHEN 'a' THEN j->>'$.arbeitszeitVollzeit' WHEN 's' THEN j->>'$.schedule' ELSE j->>'$.full_time' END AS ft FROM p)
SELECT id, source, nullif(trim(regexp_replace(title, '[\\s\\x{00a0}]+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(company, '[\\s\\x{00a0}]+', ' ', 'g')), '') AS company, nullif(trim(regexp_replace(place, '[\\s\\x{00a0}]+', ' ', 'g')), '') AS place, try_cast(salary AS DOUBLE) AS salary_from, lower(ft) IN ('true', 'full-time') AS full_time FROM q""")
def listing_postings(spark, d):
    return payloads.read_listings(table(spark, d, "source_document")).select("id", "source", "title", "company", "place", "salary_from", "full_time")


@query("""WITH d AS (SELECT source, lower(trim(external_id, E' \\t')) AS external_id, payload::JSON->>'$.description' AS description, row_number() OVER (PARTITION BY source, lower(trim(external_id, E' \\t')) ORDER BY fetched_at DESC, id DESC) AS r FROM source_document WHERE kind = 'detail')
SELECT l.id, md5(d.description) AS digest FROM source_document l LEFT JOIN d ON d.source = l.source AND d.external_id = lower(trim(l.external_id, E' \\t')) AND d.r = 1 WHERE l.kind = 'listing'""")
def listing_details(spark, d):
    docs = table(spark, d, "source_document").withColumn("external_id", F.regexp_replace("external_id", r"\t", " "))
    return payloads.merge_details(payloads.read_listings(docs), docs).select("id", F.md5("description").alias("digest"))


_CANON = """WITH r AS (SELECT source, lower(trim(replace(replace(external_id, chr(9), ' '), chr(160), ' '))) AS external_id, kind, id, payload, fetched_at FROM source_document WHERE external_id IS NOT NULL),
l AS (SELECT source, external_id, arg_max({'id': id, 'p': payload}, (fetched_at, id)) AS r FROM r WHERE kind = 'listing' GROUP BY 1, 2), d AS (SELECT source, external_id, arg_max({'id': id, 'p': payload}, (fetched_at, id)) AS r FROM r WHERE kind = 'detail' GROUP BY 1, 2),
j AS (SELECT l.source, l.external_id, l.r.id AS listing_id, d.r.id AS detail_id, l.r.p::JSON AS a, d.r.p::JSON AS b, CASE WHEN l.source = 'arbeitsagentur' THEN 'a' WHEN l.source IN ('personio', 'rippling', 'workday') THEN 's' ELSE 'b' END AS f FROM l LEFT JOIN d USING (source, external_id)),
t AS (SELECT source, external_id, listing_id, detail_id, CASE f WHEN 'a' THEN a->>'$.stellenangebotsTitel' WHEN 's' THEN a->>'$.name' ELSE a->>'$.title' END AS title, CASE f WHEN 'a' THEN a->>'$.firma' WHEN 's' THEN a->>'$.subcompany' ELSE a->>'$.company_name' END AS company,
 CASE f WHEN 'a' THEN a->>'$.stellenlokationen[0].adresse.ort' WHEN 's' THEN a->>'$.office' ELSE a->>'$.location.name' END AS place, CASE f WHEN 's' THEN a->>'$.department' WHEN 'b' THEN a->>'$.departments[0].name' END AS department,
 CASE f WHEN 'a' THEN a->>'$.gehaltsspanneVon' WHEN 's' THEN a->>'$.salary' ELSE a->>'$.salary_from' END AS salary, CASE f WHEN 'a' THEN a->>'$.verguetungsangabe' END AS pay, CASE f WHEN 'a' THEN a->>'$.datumErsteVeroeffentlichung' WHEN 's' THEN a->>'$.createdAt' ELSE a->>'$.first_published' END AS posted_at, b->>'$.description' AS description FROM j)"""
_COLLAPSED = "nullif(trim(regexp_replace({0}, '[\\s\\x{{00a0}}]+', ' ', 'g')), '')"


@query(f"""{_CANON} SELECT source, external_id, listing_id, detail_id, {_COLLAPSED.format('title')} AS title, {_COLLAPSED.format('company')} AS company, {_COLLAPSED.format('department')} AS department, {_COLLAPSED.format('posted_at')} AS posted_at, try_cast(salary AS DOUBLE) AS salary_from,
CASE pay WHEN 'JAHRESGEHALT' THEN 'YEAR' WHEN 'MONATSGEHALT' THEN 'MONTH' WHEN 'STUNDENLOHN' THEN 'HOUR' END AS pay_period, md5({_COLLAPSED.format('description')}) AS description_digest,
list_filter(list_transform(regexp_split_to_array(coalesce({_COLLAPSED.format('place')}, ''), '(?i)[;|]|\\s+(?:or|oder)\\s+'), lambda p: trim(p)), lambda p: p <> '') AS locations FROM t""")
def canonical_postings(spark, d):
    """Every posting as its source last told it, the detail merged into the listing."""
    c = payloads.canonical_postings(table(spark, d, "source_document"))
    return c.select("source", "external_id", "listing_id", "detail_id", "title", "company", "department", "posted_at", "salary_from", "pay_period", F.md5("description").alias("description_digest"), "locations")


@query("SELECT source, lower(trim(external_id, E' \\t')) AS external_id, arg_max(id, (fetched_at, id)) AS id FROM source_document GROUP BY 1, 2")
def latest_documents(spark, d):
    docs = table(spark, d, "source_document").select("source", F.lower(F.trim(F.regexp_replace("external_id", r"\t", " "))).alias("external_id"), "fetched_at", "id")
    return tables.latest_by(docs, ["source", "external_id"], ["fetched_at", "id"]).select("source", "external_id", "id")


# --- retrieval and fusion ---------------------------------------------------------------------------------------------


def _arms(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.where(F.col("id") % 50 == 0).select(F.col("id").alias("q"), "vec")
    cut = lambda x: x.withColumn("vec", F.slice("vec", 1, 16))
    return retrieval.dense_topk(q, e, 20), retrieval.dense_topk(cut(q), cut(e), 20)


def _lists(spark, d):
    a, b = _arms(spark, d)
    return a.withColumns({"arm": F.lit("full"), "weight": F.lit(2.0)}).unionByName(b.withColumns({"arm": F.lit("head"), "weight": F.lit(1.0)}))


_COS = "list_cosine_similarity((a.embedding::DOUBLE[]){0}, (b.embedding::DOUBLE[]){0})"
_ARM = "SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(" + _COS + ", 6) DESC, b.vec_id) AS pos FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY pos <= 20"
_WITH = f"WITH fulls AS ({_ARM.format('')}), heads AS ({_ARM.format('[1:16]')}), l AS (SELECT *, 'full' AS arm, 2.0 AS weight FROM fulls UNION ALL SELECT *, 'head', 1.0 FROM heads)"
_RANK = "row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS pos"


@query(f"WITH f AS ({_ARM.format('')}) SELECT q, id, pos::INT AS pos FROM f")
def dense_neighbours(spark, d):
    return _arms(spark, d)[0]


@query(f"{_WITH}, s AS (SELECT q, id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score FROM l GROUP BY 1, 2) SELECT q, id, {_RANK} FROM s")
def rank_fusion(spark, d):
    return retrieval.fuse(_lists(spark, d)).select("q", "id", "pos")


@query(f"{_WITH}, s AS (SELECT q, id, round(sum(weight::DOUBLE * (1.0::DOUBLE / (60 + pos))), 9) AS score FROM l GROUP BY 1, 2) SELECT q, id, {_RANK} FROM s")
def rank_fusion_weighted(spark, d):
    return retrieval.fuse(_lists(spark, d), "weighted").select("q", "id", "pos")


@query(f"{_WITH}, m AS (SELECT q, arm, id, row_number() OVER (PARTITION BY q, arm ORDER BY pos, id) AS p FROM l), s AS (SELECT q, id, round(sum(1.0::DOUBLE / (60 + p)), 9) AS score FROM m GROUP BY 1, 2) SELECT q, id, {_RANK} FROM s")
def rank_fusion_arm_max(spark, d):
    return retrieval.fuse(_lists(spark, d), "arm_max").select("q", "id", "pos")


@query(f"{_WITH} SELECT q, id, min(pos) AS pos FROM l GROUP BY 1, 2")
def best_places(spark, d):
    return retrieval.best_ranks(_lists(spark, d))


@query("""WITH x AS (SELECT a.vec_id AS q, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM x WHERE id = q + 1), n AS (SELECT p.q, p.id, count(*) FILTER (WHERE x.id <> p.id AND x.dist < p.dist) AS n FROM p LEFT JOIN x ON x.q = p.q GROUP BY 1, 2)
SELECT q, id, CASE WHEN n < 200 THEN n + 1 END AS place FROM n""")
def counterfactual_places(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    q = e.where(F.col("id") % 50 == 0).select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # the stated queries against all rows, in broadcast blocks of at most about PASS
    n = max(1, -(-q.count() // retrieval.PASS))
    out = None
    for s in range(n):
        block = q.where(F.pmod(F.xxhash64("q"), F.lit(n)) == s) if n > 1 else q
        pool = e.join(F.broadcast(block), F.col("id") != F.col("q")).select("q", "id", F.round(1 - dot("vec", "qv") / F.sqrt(dot("vec", "vec") * dot("qv", "qv")), 6).alias("dist"))
        part = retrieval.counterfactual(pool, pool.where(F.col("id") == F.col("q") + 1), 200)
        out = part if out is None else out.unionByName(part)
    return out


_TOK = "list_filter(string_split(coalesce(" + _NORM + ", ''), ' '), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT id, unnest({_TOK.format('title')}) AS term, 10 AS w FROM job UNION ALL SELECT id, unnest({_TOK.format('description')}), 1 FROM job),
i AS (SELECT id, term, sum(w) AS weight FROM t GROUP BY 1, 2), q AS (SELECT DISTINCT id AS q, unnest({_TOK.format('title')}) AS term FROM job WHERE id % 50 = 0),
n AS (SELECT q, count(*) AS n FROM q GROUP BY 1), h AS (SELECT q.q, i.id, sum(i.weight) AS score, count(*) AS have FROM q JOIN i USING (term) GROUP BY 1, 2)
SELECT h.q, h.id, h.score::BIGINT AS score, row_number() OVER (PARTITION BY h.q ORDER BY score DESC, h.id) AS pos FROM h JOIN n ON n.q = h.q AND n.n = h.have QUALIFY pos <= 10""")
def lexical_matches(spark, d):
    j = table(spark, d, "job")
    return retrieval.lexical_topk(j.where(F.col("id") % 50 == 0).select(F.col("id").alias("q"), F.col("title").alias("text")), j, {"title": 10, "description": 1}, 10)


# --- measures ---------------------------------------------------------------------------------------------------------

_WANTED = "w AS (SELECT a.vec_id AS q, b.vec_id AS id, 1 + b.vec_id % 3 AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"


def _wanted(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q"), "label")
    return e.join(q, "label").where(F.col("vec_id") != F.col("q")).select("q", F.col("vec_id").alias("id"), (1 + F.col("vec_id") % 3).alias("grade"))


@query(f"{_WITH}, {_WANTED} SELECT w.q, count(*) AS wanted, round(count(*) FILTER (WHERE pos <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (WHERE pos <= 20) / count(*), 6) AS recall_20, round(sum(coalesce(1.0::DOUBLE / pos, 0)) / count(*), 6) AS mrr FROM w LEFT JOIN fulls f ON f.q = w.q AND f.id = w.id GROUP BY 1")
def recall_and_mrr(spark, d):
    return evaluation.recall_and_mrr(_arms(spark, d)[0], _wanted(spark, d), (5, 20))


_NDCG = "{0}, {1}, g AS (SELECT f.q, sum({2} / log2(f.pos + 1)) AS got FROM fulls f JOIN w ON w.q = f.q AND w.id = f.id WHERE f.pos <= 10 GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, id) AS r FROM w), i AS (SELECT q, sum({2} / log2(r + 1)) AS ideal FROM r WHERE r <= 10 GROUP BY 1) SELECT i.q, round(coalesce(g.got, 0) / i.ideal, 4) AS ndcg FROM i LEFT JOIN g ON g.q = i.q"


@query(_NDCG.format(_WITH, _WANTED, "grade::DOUBLE"))
def ndcg_linear(spark, d):
    return evaluation.ndcg(_arms(spark, d)[0], _wanted(spark, d), 10)


@query(_NDCG.format(_WITH, _WANTED, "(2.0::DOUBLE ** grade - 1)"))
def ndcg_exponential(spark, d):
    return evaluation.ndcg(_arms(spark, d)[0], _wanted(spark, d), 10, exponential=True)


@query(f"""{_WITH}, j AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY f.pos, id) - row_number() OVER (PARTITION BY q ORDER BY h.pos, id) AS d FROM fulls f JOIN heads h USING (q, id))
SELECT q, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN 1 - 6 * sum(d * d)::DOUBLE / (count(*) * (count(*) * count(*) - 1)) ELSE 0 END, 6) AS rho FROM j GROUP BY 1""")
def rank_correlation(spark, d):
    return evaluation.spearman(*_arms(spark, d))


@query(f"""{_WITH}, u AS (SELECT q, id, count(*) AS n FROM (SELECT q, id FROM fulls WHERE pos <= 10 UNION ALL SELECT q, id FROM heads WHERE pos <= 10) GROUP BY 1, 2)
SELECT q, round(count(*) FILTER (WHERE n = 2) / count(*), 6) AS jaccard FROM u GROUP BY 1""")
def top_overlap(spark, d):
    return evaluation.jaccard(*_arms(spark, d), 10)


@query(f"""{_WITH}, j AS (SELECT f.q, f.id, f.pos, a.label = b.label AS good FROM fulls f JOIN embeddings a ON a.vec_id = f.q JOIN embeddings b ON b.vec_id = f.id)
SELECT x.q, (SELECT count(*) FROM j b, j g WHERE b.q = x.q AND g.q = x.q AND NOT b.good AND g.good AND b.pos < g.pos) AS inversions, min(pos) FILTER (WHERE NOT good) - max(pos) FILTER (WHERE good) AS margin FROM j x GROUP BY 1""")
def rank_inversions(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    ranked = _arms(spark, d)[0]
    labels = ranked.select("q", "id").join(e.select(F.col("vec_id").alias("q"), F.col("label").alias("a")), "q").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id").select("q", "id", (F.col("a") == F.col("b")).alias("good"))
    return evaluation.inversions(ranked, labels)


@query("""WITH s AS (SELECT source, count(*) FILTER (WHERE complete) AS h, count(*)::DOUBLE AS n FROM source_sweep GROUP BY 1)
SELECT source, round(greatest(0, (h/n + 1.645*1.645/(2*n) - 1.645*sqrt(h/n*(1-h/n)/n + 1.645*1.645/(4*n*n))) / (1 + 1.645*1.645/n)), 6) AS low, round(least(1, (h/n + 1.645*1.645/(2*n) + 1.645*sqrt(h/n*(1-h/n)/n + 1.645*1.645/(4*n*n))) / (1 + 1.645*1.645/n)), 6) AS high FROM s""")
def complete_share(spark, d):
    s = table(spark, d, "source_sweep").groupBy("source").agg(F.count_if("complete").alias("h"), F.count("*").alias("n"))
    low, high = wilson(F.col("h"), F.col("n"))
    return s.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# --- series, streaks, latest rows -------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT source, not coalesce(ok, false) AS f, started_at, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS n FROM source_sweep)
SELECT source, coalesce(min(n) FILTER (WHERE NOT f), count(*) + 1) - 1 AS streak, count(*) FILTER (WHERE f) AS flagged, epoch_us(max(started_at) FILTER (WHERE f)) AS last_us FROM n GROUP BY 1""")
def failure_streaks(spark, d):
    return series.streaks(table(spark, d, "source_sweep"), ["source"], "started_at", "id", ~F.coalesce("ok", F.lit(False)))


@query("""WITH n AS (SELECT user_id, event_type = 'click' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM n WHERE f)
SELECT user_id, count(*) AS rows, min(n) AS first, max(n) AS last, row_number() OVER (PARTITION BY user_id ORDER BY min(n)) AS island FROM g GROUP BY user_id, g""")
def click_islands(spark, d):
    return series.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "click")


@query("""WITH d AS (SELECT (first_seen_at AT TIME ZONE 'UTC')::DATE AS day, count(*) AS postings, count(closed_at) AS closed FROM job GROUP BY 1), s AS (SELECT unnest(generate_series(DATE '2026-02-23', DATE '2026-05-03', INTERVAL 1 DAY))::DATE AS day)
SELECT strftime(s.day, '%Y-%m-%d') AS day, postings, closed, (sum(postings) OVER w)::BIGINT AS postings_trailing, (sum(closed) OVER w)::BIGINT AS closed_trailing FROM s LEFT JOIN d USING (day) WINDOW w AS (ORDER BY s.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def daily_postings(spark, d):
    out = series.daily_series(table(spark, d, "job"), F.to_date("first_seen_at"), {"postings": F.count("*"), "closed": F.count("closed_at")}, "2026-02-23", "2026-05-03")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH n AS (SELECT source, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS s, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS n FROM source_sweep WHERE ok)
SELECT source, round(quantile_cont(s, 0.5), 6) AS median FROM n WHERE n <= 5 GROUP BY 1""")
def median_sweep_seconds(spark, d):
    secs = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return series.median_of_last(table(spark, d, "source_sweep").where("ok"), ["source"], "started_at", "id", secs, 5).withColumn("median", F.round("median", 6))


@query("SELECT source, id, error FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS r FROM source_sweep) WHERE r = 1 AND NOT complete")
def latest_sweep_incomplete(spark, d):
    return tables.latest_by(table(spark, d, "source_sweep"), ["source"], ["started_at", "id"]).where("NOT complete").select("source", "id", "error")


@query("""SELECT source, scope, id, r AS place FROM (SELECT source, scope, id, row_number() OVER (PARTITION BY source, scope ORDER BY first_seen_at, id) AS r FROM job WHERE closed_at IS NULL) WHERE r <= 2 ORDER BY r, id LIMIT 50""")
def fair_round(spark, d):
    w = Window.partitionBy("source", "scope").orderBy("first_seen_at", "id")
    return table(spark, d, "job").where("closed_at IS NULL").withColumn("place", F.row_number().over(w)).where("place <= 2").orderBy("place", "id").limit(50).select("source", "scope", "id", "place")


@query("""WITH e AS (SELECT source, regexp_replace(error, '[0-9]+', '#', 'g') AS error, count(*) AS n FROM source_sweep WHERE error IS NOT NULL GROUP BY 1, 2)
SELECT source, sum(n)::BIGINT AS errors, arg_max(error, (n, -ascii(error), error)) AS top_error FROM e GROUP BY 1""")
def top_errors(spark, d):
    e = table(spark, d, "source_sweep").where("error IS NOT NULL").groupBy("source", F.regexp_replace("error", "[0-9]+", "#").alias("error")).agg(F.count("*").alias("n"))
    return e.groupBy("source").agg(F.sum("n").alias("errors"), F.max_by("error", F.struct("n", -F.ascii("error"), "error")).alias("top_error"))


@query("""SELECT lower(trim(company)) AS company, count(*) AS postings, (sum(count(*)) OVER ())::BIGINT AS all_postings, count(*) OVER () AS companies FROM job WHERE company IS NOT NULL GROUP BY 1 ORDER BY postings DESC, company LIMIT 20""")
def top_companies(spark, d):
    g = table(spark, d, "job").where("company IS NOT NULL").groupBy(F.lower(F.trim("company")).alias("company")).agg(F.count("*").alias("postings"))
    totals = g.agg(F.sum("postings").alias("all_postings"), F.count("*").alias("companies"))
    return g.orderBy(F.desc("postings"), "company").limit(20).crossJoin(F.broadcast(totals))


# --- facets -----------------------------------------------------------------------------------------------------------

_CURRENT = "SELECT * FROM job_facet QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY derive_version DESC, derived_at DESC) = 1"


def _facets(spark, d):
    return tables.latest_by(table(spark, d, "job_facet"), ["job_id"], ["derive_version", "derived_at"])


@query(f"SELECT c AS country, count(*) AS postings FROM (SELECT unnest(countries) AS c FROM ({_CURRENT})) GROUP BY 1")
def postings_by_country(spark, d):
    return _facets(spark, d).select(F.explode("countries").alias("country")).groupBy("country").agg(F.count("*").alias("postings"))


@query(f"SELECT c AS skill, count(*) AS postings FROM (SELECT unnest(skills) AS c FROM ({_CURRENT})) GROUP BY 1 ORDER BY postings DESC, skill LIMIT 25")
def top_skills(spark, d):
    return _facets(spark, d).select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("postings")).orderBy(F.desc("postings"), "skill").limit(25)


@query(f"SELECT job_id, list_has_any(countries, ['AT', 'CH']) OR list_has_any(unplaced_countries, ['AT', 'CH']) OR work_mode = 'remote' AS admitted, len(countries) = 0 AND len(unplaced_countries) = 0 AND len(place_ids) = 0 AS unplaced FROM ({_CURRENT})")
def area_overlap(spark, d):
    area = F.array(F.lit("AT"), F.lit("CH"))
    any_of = lambda c: F.coalesce(F.arrays_overlap(c, area), F.lit(False))
    empty = lambda c: F.size(c) == 0
    return _facets(spark, d).select("job_id", (any_of("countries") | any_of("unplaced_countries") | (F.col("work_mode") == "remote")).alias("admitted"), (empty("countries") & empty("unplaced_countries") & empty("place_ids")).alias("unplaced"))


@query(f"SELECT j.source, count(*) AS unplaced FROM job j JOIN ({_CURRENT}) f ON f.job_id = j.id WHERE len(f.countries) = 0 AND len(f.place_ids) = 0 GROUP BY 1")
def unplaced_by_source(spark, d):
    return table(spark, d, "job").select(F.col("id").alias("job_id"), "source").join(_facets(spark, d), "job_id").where((F.size("countries") == 0) & (F.size("place_ids") == 0)).groupBy("source").agg(F.count("*").alias("unplaced"))


@query("SELECT job_id, max(derive_version) AS have_version FROM job_facet GROUP BY 1 HAVING max(derive_version) <> 10 UNION ALL SELECT id, NULL FROM job WHERE id NOT IN (SELECT job_id FROM job_facet)")
def stale_facets(spark, d):
    return tables.stale(table(spark, d, "job").select(F.col("id").alias("job_id")), table(spark, d, "job_facet"), "job_id", "derive_version", 10)


@query(f"""WITH s AS (SELECT DISTINCT {_NORM.format('c')} AS skill FROM (SELECT unnest(skills) AS c FROM job_facet UNION ALL SELECT unnest(['Product Designer', 'Support Engineer', 'en el', 'no such skill'])) WHERE {_NORM.format('c')} <> ''), t AS (SELECT id, ' ' || {_NORM.format("concat_ws(' ', title, description)")} || ' ' AS t FROM job)
SELECT skill, count(*) AS postings FROM s JOIN t ON contains(t.t, ' ' || skill || ' ') GROUP BY 1""")
def skill_mentions(spark, d):
    """Postings that hold each skill as whole words, one or several."""
    skills = table(spark, d, "job_facet").select(F.explode("skills").alias("s")).unionByName(spark.createDataFrame([("Product Designer",), ("Support Engineer",), ("en el",), ("no such skill",)], "s string"))
    skills = skills.select(T.normalise("s").alias("skill")).where("skill <> ''").distinct().withColumn("n", F.size(F.split("skill", " ")))
    # runs of as many words as some skill has; counted before the join, so a frequent run is one row in it
    lengths = sorted(r[0] for r in skills.select("n").distinct().collect())
    words = table(spark, d, "job").select(T.tokens(F.concat_ws(" ", "title", "description")).alias("w"))
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    found = words.select(F.explode(F.array_distinct(F.concat(*[run(n) for n in lengths]))).alias("skill"))
    return found.groupBy("skill").agg(F.count("*").alias("postings")).join(skills.select("skill"), "skill")


# --- places -----------------------------------------------------------------------------------------------------------

_KM = "round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2)))), 3)"


@query(f"SELECT c.id AS centre, p.id, {_KM} AS km FROM place c, place p WHERE {_KM} <= 40")
def places_nearby(spark, d):
    """The places within 40 km of every place."""
    p = table(spark, d, "place")
    return spatial.nearby(p, p, 40)


@query(f"""WITH n AS (SELECT DISTINCT id, population, {_FOLD.format('n')} AS n FROM (SELECT id, population, unnest(list_append(coalesce(alternates, []), name)) AS n FROM place)), p AS (SELECT DISTINCT substr(name, 1, 3) AS prefix FROM place),
h AS (SELECT DISTINCT prefix, id, population FROM p JOIN n ON starts_with(n.n, {_FOLD.format('prefix')}))
SELECT prefix, id, row_number() OVER (PARTITION BY prefix ORDER BY population DESC, id) AS pos FROM h QUALIFY pos <= 10""")
def place_suggestions(spark, d):
    p = table(spark, d, "place")
    return spatial.suggest(p.select(F.substring("name", 1, 3).alias("prefix")).distinct(), p)


@query(f"""WITH n AS (SELECT {_FOLD.format('name')} AS name, id, population, row_number() OVER w AS r, lead(population) OVER w AS nxt FROM place WINDOW w AS (PARTITION BY {_FOLD.format('name')} ORDER BY population DESC, id)) SELECT name, id FROM n WHERE r = 1 AND (nxt IS NULL OR population >= 10 * nxt)""")
def dominant_places(spark, d):
    return spatial.dominant(table(spark, d, "place"))


# --- changes to tables ------------------------------------------------------------------------------------------------


def _halves(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_orderstatus": F.lit("N")})


@query("""WITH c AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), i AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(c.o_orderkey, i.o_orderkey) AS o_orderkey, round(CASE WHEN i.o_orderkey IS NOT NULL THEN i.o_totalprice + 1 ELSE c.o_totalprice END, 2) AS o_totalprice, coalesce(c.o_orderstatus, 'N') AS o_orderstatus FROM c FULL JOIN i ON c.o_orderkey = i.o_orderkey""")
def merged_orders(spark, d):
    return tables.upsert(*_halves(spark, d), ["o_orderkey"], keep=["o_orderstatus"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def inserted_orders(spark, d):
    return tables.insert_absent(*_halves(spark, d), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("""WITH s AS (SELECT source, scope, max(started_at) AS s FROM source_sweep WHERE complete AND scope IS NOT NULL GROUP BY 1, 2)
SELECT id, epoch_us(CASE WHEN closed_at IS NULL AND last_seen_at < s THEN s ELSE closed_at END) AS closed_us FROM job LEFT JOIN s USING (source, scope)""")
def closed_by_sweeps(spark, d):
    full = table(spark, d, "source_sweep").where("complete AND scope IS NOT NULL").groupBy("source", "scope").agg(F.max("started_at").alias("started_at"))
    return tables.close_unseen(table(spark, d, "job"), full).select("id", F.unix_micros("closed_at").alias("closed_us"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (200000.0, 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def page_after(spark, d):
    return tables.keyset_page(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 25, after=(200000.0, 0)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (200000.0, 0) ORDER BY o_totalprice, o_orderkey LIMIT 25")
def page_before(spark, d):
    return tables.keyset_page(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 25, before=(200000.0, 0)).select("o_orderkey", "o_totalprice")


# --- archive ----------------------------------------------------------------------------------------------------------


@query("SELECT strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS rows FROM source_document GROUP BY 1")
def archive_days(spark, d):
    return archive.day_counts(table(spark, d, "source_document"), "fetched_at").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT strftime(first_seen_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS rows FROM job WHERE (first_seen_at AT TIME ZONE 'UTC')::DATE <= DATE '2026-04-14' - 4 GROUP BY 1")
def archive_frozen(spark, d):
    return archive.frozen_days(table(spark, d, "job"), "first_seen_at", "2026-04-14", 3).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# --- joins, windows, groupings, sets ----------------------------------------------------------------------------------


@query("""SELECT p.event_id, arg_max(c.value, (c.ts, c.value)) AS value FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1""")
def last_click_before_purchase(spark, d):
    e = table(spark, d, "events")
    return joins.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", "value"), ["user_id"], "ts", "value").select("event_id", "value")


@query("""SELECT s.event_id AS error_id, count(*) AS within FROM events s JOIN events p ON epoch_us(p.ts) >= epoch_us(s.ts) AND epoch_us(p.ts) < epoch_us(s.ts) + 600000000 WHERE s.event_type = 'error' GROUP BY 1""")
def events_after_errors(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("us").alias("a"), (F.col("us") + 600_000_000).alias("b"))
    return joins.range_join(e.select("us"), spans, "us", "a", "b", 600_000_000).groupBy("error_id").agg(F.count("*").alias("within"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_property(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start"), "event_type", "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) - o * 900000000::BIGINT AS start, count(*) AS n FROM events, (VALUES (0), (1), (2), (3)) v(o) GROUP BY 1")
def sliding_counts(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def sessions(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_quantities(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT source, scope, count(*) AS n FROM job GROUP BY ROLLUP (source, scope)")
def rollup_boards(spark, d):
    return table(spark, d, "job").rollup("source", "scope").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def customers_without_large_orders(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def urgent_segments(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("""SELECT 'both' AS side, external_id FROM (SELECT lower(trim(external_id, E' \\t')) AS external_id FROM source_document WHERE kind = 'listing' INTERSECT SELECT lower(trim(external_id, E' \\t')) FROM source_document WHERE kind = 'detail')
UNION ALL SELECT 'listing', external_id FROM (SELECT lower(trim(external_id, E' \\t')) AS external_id FROM source_document WHERE kind = 'listing' EXCEPT SELECT lower(trim(external_id, E' \\t')) FROM source_document WHERE kind = 'detail')""")
def listings_against_details(spark, d):
    s = table(spark, d, "source_document").select("kind", F.lower(F.trim(F.regexp_replace("external_id", r"\t", " "))).alias("external_id"))
    a, b = s.where("kind = 'listing'").select("external_id"), s.where("kind = 'detail'").select("external_id")
    return a.intersect(b).select(F.lit("both").alias("side"), "external_id").unionByName(a.subtract(b).select(F.lit("listing").alias("side"), "external_id"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, 0 AS beyond_bound FROM events GROUP BY 1")
def approximate_users(spark, d):
    """Exact users, and for how many of the sketches, merged by day, the estimate lies beyond three standard errors of the exact count."""
    e = table(spark, d, "events")
    by_day = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", 14).alias("s"))
    merged = by_day.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("a"))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    bound = F.greatest(F.lit(1.0), 3 * 1.04 / 128 * F.col("users"))
    return exact.join(merged, "event_type").select("event_type", "users", (F.abs(F.col("a") - F.col("users")) > bound).cast("int").alias("beyond_bound"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def revenue_by_nation(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = li.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))
