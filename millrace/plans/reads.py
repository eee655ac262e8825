"""Queries for reads, links, change detection and hints, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..io import bounded, table
from ..operators import derive, discovery, evaluation, locations, retrieval, search, tables
from .derived import RULES, _case
from .market import _WORDS, _docs
from .reference import _COS, _CURRENT, _FOLD, _NORM, _PAIR, ORACLE, QUERIES, _facets, query

__all__ = ["ORACLE", "QUERIES"]

# --- vectors with their distances -------------------------------------------------------------------------------------


@query(f"SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format('')}, 6) DESC, b.vec_id) AS pos, round(1 - round({_COS.format('')}, 6), 6) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY pos <= 20")
def dense_distances(spark, d):
    """The nearest rows with their distances kept."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near = retrieval.dense_topk(e.where(F.col("id") % 50 == 0).select(F.col("id").alias("q"), "vec"), e, 20, with_sim=True)
    return near.select("q", "id", "pos", F.round(1 - F.col("sim"), 6).alias("dist"))


@query(f"""WITH s AS (SELECT a.label AS q, b.vec_id AS id, round({_COS.format('')}, 6) AS sim FROM (SELECT label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) a, embeddings b)
SELECT q, count(*) FILTER (WHERE 1 - sim < 0.5) AS nearer, count(*) AS rows FROM s GROUP BY 1""")
def rows_nearer_than(spark, d):
    """How many rows lie nearer to each label's first vector than a given distance."""
    e = table(spark, d, "embeddings")
    q, _ = bounded(e.groupBy("label").agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("qv")).withColumnRenamed("label", "q"), 4096)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # one stated vector a label against all rows
    s = e.select(F.col("embedding").cast("array<double>").alias("v")).crossJoin(q).withColumn("sim", F.round(dot("v", "qv") / F.sqrt(dot("v", "v") * dot("qv", "qv")), 6))
    return s.groupBy("q").agg(F.count_if(1 - F.col("sim") < 0.5).alias("nearer"), F.count("*").alias("rows"))


# --- rows by age, by id, beside others --------------------------------------------------------------------------------


@query("SELECT id, epoch_us(coalesce(ready_at, first_seen_at)) AS since_us FROM job WHERE closed_at IS NULL AND coalesce(ready_at, first_seen_at) > TIMESTAMPTZ '2026-03-25 00:00:00+00'")
def fresh_postings(spark, d):
    """Open postings newer than a cutoff, by the one date or, without it, the other."""
    since = F.coalesce("ready_at", "first_seen_at")
    return table(spark, d, "job").where(F.col("closed_at").isNull() & (since > F.lit("2026-03-25 00:00:00").cast("timestamp"))).select("id", F.unix_micros(since).alias("since_us"))


@query("SELECT d.id, j.id AS job_id, hex(j.content_hash) AS digest, j.normalize_version FROM source_document d LEFT JOIN job j ON j.source = d.source AND lower(trim(j.external_id)) = lower(trim(d.external_id, E' \\t')) WHERE d.kind = 'listing'")
def known_digests(spark, d):
    """Stored digests and versions beside listings as they arrive."""
    docs = table(spark, d, "source_document").where("kind = 'listing'").select("id", "source", F.lower(F.trim(F.regexp_replace("external_id", r"\t", " "))).alias("ext"))
    j = table(spark, d, "job").select("source", F.lower(F.trim("external_id")).alias("ext"), F.col("id").alias("job_id"), F.hex("content_hash").alias("digest"), "normalize_version")
    return docs.join(j, ["source", "ext"], "left").select("id", "job_id", "digest", "normalize_version")


@query("""WITH v AS (SELECT source, lower(trim(external_id, E' \\t')) AS ext, sweep_id, hex(payload_sha256) AS h, row_number() OVER (PARTITION BY source, lower(trim(external_id, E' \\t')) ORDER BY fetched_at, id) AS n FROM source_document WHERE kind = 'listing'), p AS (SELECT *, lag(h) OVER (PARTITION BY source, ext ORDER BY n) AS before FROM v),
t AS (SELECT source, count(*) FILTER (WHERE before IS NULL) AS new, count(*) FILTER (WHERE before = h) AS same, count(*) FILTER (WHERE before <> h) AS changed FROM p GROUP BY 1), dt AS (SELECT source, count(DISTINCT lower(trim(external_id, E' \\t'))) AS detailed FROM source_document WHERE kind = 'detail' GROUP BY 1)
SELECT t.*, coalesce(dt.detailed, 0) AS detailed FROM t LEFT JOIN dt USING (source)""")
def listing_changes(spark, d):
    """Of each source's listings in the order fetched: new ones, those delivered as before and those delivered otherwise; and how many have a detail."""
    s = table(spark, d, "source_document").withColumn("ext", F.lower(F.trim(F.regexp_replace("external_id", r"\t", " "))))
    before = F.lag("h").over(Window.partitionBy("source", "ext").orderBy("fetched_at", "id"))
    v = s.where("kind = 'listing'").select("source", "ext", "fetched_at", "id", F.hex("payload_sha256").alias("h")).withColumn("before", before)
    t = v.groupBy("source").agg(F.count_if(F.col("before").isNull()).alias("new"), F.count_if(F.col("before") == F.col("h")).alias("same"), F.count_if(F.col("before") != F.col("h")).alias("changed"))
    detailed = s.where("kind = 'detail'").groupBy("source").agg(F.count_distinct("ext").alias("detailed"))
    return t.join(detailed, "source", "left").withColumn("detailed", F.coalesce("detailed", F.lit(0)))


@query(f"""WITH v AS (SELECT job_id, max(derive_version) AS v FROM job_facet GROUP BY 1), e AS (SELECT job_id, arg_max(embedding_version, (embedded_at, embedding_version)) AS v FROM job_embedding GROUP BY 1)
SELECT 'derive' AS kind, j.id, CAST(v.v AS VARCHAR) AS have FROM job j LEFT JOIN v ON v.job_id = j.id WHERE v.v IS DISTINCT FROM 12 AND j.closed_at IS NULL UNION ALL SELECT 'embed', j.id, e.v FROM job j LEFT JOIN e ON e.job_id = j.id WHERE e.v IS DISTINCT FROM 'local:nordvec-2:768' AND j.closed_at IS NULL AND j.description IS NOT NULL""")
def lagging_versions(spark, d):
    """Open postings whose derived row or vector is missing or of another version than wanted."""
    j = table(spark, d, "job").where("closed_at IS NULL").select(F.col("id").alias("job_id"), "description")
    v = table(spark, d, "job_facet").groupBy("job_id").agg(F.max("derive_version").alias("v"))
    e = table(spark, d, "job_embedding").groupBy("job_id").agg(F.max_by("embedding_version", F.struct("embedded_at", "embedding_version")).alias("v"))
    derive_ = j.join(v, "job_id", "left").where(~F.col("v").eqNullSafe(F.lit(12))).select(F.lit("derive").alias("kind"), F.col("job_id").alias("id"), F.col("v").cast("string").alias("have"))
    embed_ = j.where("description IS NOT NULL").join(e, "job_id", "left").where(~F.col("v").eqNullSafe(F.lit("local:nordvec-2:768"))).select(F.lit("embed").alias("kind"), F.col("job_id").alias("id"), F.col("v").alias("have"))
    return derive_.unionByName(embed_)


@query(f"""SELECT j.id FROM job j WHERE j.closed_at IS NULL AND EXISTS (SELECT 1 FROM job_facet f WHERE f.job_id = j.id AND f.derive_version = 11) AND EXISTS (SELECT 1 FROM job_embedding e WHERE e.job_id = j.id) AND NOT EXISTS (SELECT 1 FROM source_document d WHERE d.source = j.source AND d.kind = 'listing' AND lower(trim(d.external_id, E' \\t')) = lower(trim(j.external_id)) AND d.fetched_at > j.last_seen_at)""")
def settled_postings(spark, d):
    """Open postings with a current derived row and a vector, of which no listing came in after they were last seen."""
    j = table(spark, d, "job").where("closed_at IS NULL").select("id", "source", F.lower(F.trim("external_id")).alias("ext"), "last_seen_at")
    f = table(spark, d, "job_facet").where("derive_version = 11").select(F.col("job_id").alias("id"))
    e = table(spark, d, "job_embedding").select(F.col("job_id").alias("id"))
    late = table(spark, d, "source_document").where("kind = 'listing'").groupBy(F.col("source").alias("s"), F.lower(F.trim(F.regexp_replace("external_id", r"\t", " "))).alias("x")).agg(F.max("fetched_at").alias("at"))
    open_ = j.join(f, "id", "left_semi").join(e, "id", "left_semi")
    return open_.join(late, (F.col("source") == F.col("s")) & (F.col("ext") == F.col("x")) & (F.col("at") > F.col("last_seen_at")), "left_anti").select("id")


@query(f"""WITH j AS (SELECT id, source, closed_at, {_PAIR} AS pair FROM job) SELECT a.id, EXISTS (SELECT 1 FROM j b WHERE b.pair = a.pair AND b.id <> a.id) AS has_copy, EXISTS (SELECT 1 FROM j b WHERE b.pair = a.pair AND b.id <> a.id AND b.closed_at IS NULL) AS has_open_copy, EXISTS (SELECT 1 FROM j b WHERE b.pair = a.pair AND b.source <> a.source) AS elsewhere FROM j a""")
def copies_of(spark, d):
    """Whether each posting has a copy, an open one, one at another source; counted by group, no pairs."""
    j = table(spark, d, "job").select("id", "source", F.col("closed_at").isNull().alias("open"), T.pairing_key("title", "company", "scope").alias("pair"))
    g = j.groupBy("pair").agg(F.count("*").alias("n"), F.count_if("open").alias("o"), F.min("source").alias("lo"), F.max("source").alias("hi"))
    k = j.join(g, "pair")
    return k.select("id", (F.col("n") > 1).alias("has_copy"), (F.col("o") - F.col("open").cast("int") > 0).alias("has_open_copy"), (F.col("lo") != F.col("hi")).alias("elsewhere"))


@query("""WITH c AS (SELECT source, scope, started_at, id, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS n FROM source_sweep) SELECT c.source, c.id, c.n, count(d.id) AS documents FROM c LEFT JOIN source_document d ON d.sweep_id = c.id WHERE c.n <= 5 GROUP BY 1, 2, 3""")
def sweeps_beside_documents(spark, d):
    """The latest sweeps of each source, also those that brought nothing, with what they brought."""
    w = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("id"))
    c = table(spark, d, "source_sweep").select("source", F.col("id").alias("sweep_id"), "started_at", "id").withColumn("n", F.row_number().over(w)).where("n <= 5").select("source", "sweep_id", "n")
    n = table(spark, d, "source_document").groupBy("sweep_id").agg(F.count("*").alias("documents"))
    return c.join(n, "sweep_id", "left").select("source", F.col("sweep_id").alias("id"), "n", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("""WITH n AS (SELECT *, lag(id) OVER w AS before, lag(ok) OVER w AS ok_before FROM source_sweep WINDOW w AS (PARTITION BY source, scope ORDER BY started_at, id)), d AS (SELECT sweep_id, count(*) AS docs FROM source_document GROUP BY 1)
SELECT n.id, CASE WHEN n.blocked THEN 'blocked' WHEN NOT coalesce(n.ok, false) THEN 'failed' WHEN n.scope IS NULL THEN 'feed' WHEN n.complete THEN 'closable' ELSE 'partial' END AS outcome, greatest(0, coalesce(b.docs, 0) - coalesce(a.docs, 0)) AS shortfall FROM n LEFT JOIN d a ON a.sweep_id = n.id LEFT JOIN d b ON b.sweep_id = n.before""")
def sweep_outcomes(spark, d):
    """What each sweep may close, and how many fewer documents it brought than the one before of its board."""
    s = table(spark, d, "source_sweep")
    w = Window.partitionBy("source", "scope").orderBy("started_at", "id")
    n = s.withColumn("before", F.lag("id").over(w))
    docs = table(spark, d, "source_document").groupBy("sweep_id").agg(F.count("*").alias("docs"))
    a, b = docs.select(F.col("sweep_id").alias("id"), F.col("docs").alias("now")), docs.select(F.col("sweep_id").alias("before"), F.col("docs").alias("then"))
    outcome = F.when(F.col("blocked"), "blocked").when(~F.coalesce("ok", F.lit(False)), "failed").when(F.col("scope").isNull(), "feed").when(F.col("complete"), "closable").otherwise("partial")
    return n.join(a, "id", "left").join(b, "before", "left").select("id", outcome.alias("outcome"), F.greatest(F.lit(0), F.coalesce("then", F.lit(0)) - F.coalesce("now", F.lit(0))).alias("shortfall"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events WHERE event_type <> 'purchase' QUALIFY place <= 25""")
def top_of_each_user(spark, d):
    """The 25 best rows of each user that were not taken yet."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").where("event_type <> 'purchase'").withColumn("place", F.row_number().over(w)).where("place <= 25").select("user_id", "event_id", "place")


# --- links ------------------------------------------------------------------------------------------------------------

#: Words in links that promise a posting.
JOB_WORDS = ("job", "career", "karriere", "stelle", "vacature", "vacanc", "emploi", "empleo", "lavoro", "recruit")
_JOBS = "|".join(JOB_WORDS)


@query(f"""WITH l AS (SELECT id, scope, unnest([url, 'https://other.jobs.example/' || id, 'https://haus.example/karriere/' || id, 'https://whatsapp.example/' || id, 'https://x.example/about']) AS u FROM job WHERE url IS NOT NULL),
r AS (SELECT id, u, scope, CASE WHEN regexp_extract(lower(u), '^[a-z]+://([^/?#:]+)', 1) LIKE '%.jobs.example' THEN regexp_extract(lower(u), '^[a-z]+://([^/?#:]+)[.]jobs[.]example', 1) END AS b, regexp_extract(lower(u), '^[a-z]+://([^/?#:]+)', 1) = 'arbeitsagentur-feed.example' AS f FROM l)
SELECT id, u AS link, b AS board FROM r WHERE (b IS NOT NULL AND b IS DISTINCT FROM scope) OR (b IS NULL AND NOT f AND regexp_matches(lower(u), '{_JOBS}'))""")
def leads_in_links(spark, d):
    """Links of a posting that lead to other boards, or to unknown hosts but with a word that promises a posting; not to its own board."""
    links = F.array("url", F.concat(F.lit("https://other.jobs.example/"), "id"), F.concat(F.lit("https://haus.example/karriere/"), "id"), F.concat(F.lit("https://whatsapp.example/"), "id"), F.lit("https://x.example/about"))
    l = table(spark, d, "job").where("url IS NOT NULL").select("id", "scope", F.explode(links).alias("link")).withColumn("r", discovery.resolve_board("link", RULES))
    board = F.when(F.col("r.source") == "board", F.lower("r.scope"))
    other = (F.col("r.result") == "board") & (F.col("r.source") == "board") & ~board.eqNullSafe(F.col("scope"))
    promising = (F.col("r.result") == "unknown_host") & F.lower("link").rlike(_JOBS)
    return l.where(other | promising).select("id", "link", board.alias("board"))


@query("""WITH w AS (SELECT id AS ask, CASE WHEN id % 2 = 0 THEN 'http://www.' || regexp_replace(url, '^https?://', '') || '/' ELSE 'https://x.example/v?id=' || external_id END AS u, scope FROM job WHERE id % 5 = 0 AND url IS NOT NULL AND scope IS NOT NULL),
byid AS (SELECT w.ask, min(j.id) AS id FROM w JOIN job j ON j.scope = w.scope AND (j.external_id = regexp_extract(w.u, 'id=(.*)$', 1)) WHERE w.u LIKE '%id=%' GROUP BY 1), byurl AS (SELECT w.ask, min(j.id) AS id FROM w JOIN job j ON regexp_replace(w.u, '^https?://(www\\.)?(.*?)/*$', '\\2') = regexp_replace(j.url, '^https?://(www\\.)?(.*?)/*$', '\\2') GROUP BY 1)
SELECT w.ask, coalesce(byid.id, byurl.id) AS id FROM w LEFT JOIN byid USING (ask) LEFT JOIN byurl USING (ask)""")
def postings_of_links(spark, d):
    """The posting a link means: by an id it holds, within the board, else by a spelling of its address."""
    j = table(spark, d, "job")
    made = F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://www."), F.regexp_replace("url", "^https?://", ""), F.lit("/"))).otherwise(F.concat(F.lit("https://x.example/v?id="), "external_id"))
    w = j.where((F.col("id") % 5 == 0) & F.col("url").isNotNull() & F.col("scope").isNotNull()).select(F.col("id").alias("ask"), made.alias("u"), "scope")
    ids = w.select("ask", "scope", F.explode(discovery.id_tokens("u", "scope")).alias("external_id")).join(j.select("scope", "external_id", "id"), ["scope", "external_id"]).groupBy("ask").agg(F.min("id").alias("by_id"))
    bare = lambda c: F.regexp_replace(c, r"^https?://(www\.)?(.*?)/*$", "$2")
    urls = w.select("ask", bare("u").alias("b")).join(j.where("url IS NOT NULL").select(bare("url").alias("b"), "id"), "b").groupBy("ask").agg(F.min("id").alias("by_url"))
    return w.select("ask").join(ids, "ask", "left").join(urls, "ask", "left").select("ask", F.coalesce("by_id", "by_url").alias("id"))


# --- hints and place texts --------------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT id, remote_hint, {_case("concat_ws(' ', title, location_text)", derive.WORKPLACE)} AS w, {_case('employment_type_hint', derive.CONTRACT)} AS hinted, {_case('title', derive.CONTRACT)} AS titled FROM job)
SELECT id, CASE WHEN remote_hint THEN 'remote' WHEN w <> 'unknown' THEN w WHEN NOT remote_hint THEN 'onsite' ELSE 'unknown' END AS work_mode, CASE WHEN hinted <> 'unknown' THEN hinted ELSE titled END AS employment_type FROM t""")
def hinted_facets(spark, d):
    """A hint that says remote first, then the words of title and place, then a hint that denies it; contracts by hint, then title."""
    w = derive.first_term(F.concat_ws(" ", "title", "location_text"), derive.WORKPLACE)
    mode = F.when(F.col("remote_hint"), "remote").when(w != "unknown", w).when(~F.col("remote_hint"), "onsite").otherwise("unknown")
    hinted, titled = derive.first_term("employment_type_hint", derive.CONTRACT), derive.first_term("title", derive.CONTRACT)
    return table(spark, d, "job").select("id", mode.alias("work_mode"), F.when(hinted != "unknown", hinted).otherwise(titled).alias("employment_type"))


_T = f"trim(regexp_replace({_FOLD.format('location_text')}, '[\\s\\x{{00a0}}]+', ' ', 'g'))".replace('{{', '{').replace('}}', '}')


@query(f"""WITH t AS (SELECT id, {_T} AS town FROM job WHERE location_text IS NOT NULL), p AS (SELECT {_FOLD.format('name')} AS town, country, population FROM place), m AS (SELECT town, list_sort(list(DISTINCT country)) AS countries, max(population) AS most, count(*) AS places FROM p GROUP BY 1),
s AS (SELECT p.town, max(p.population) AS second FROM p JOIN m USING (town) WHERE p.population < m.most GROUP BY 1)
SELECT t.id, m.countries, m.places = 1 OR m.most >= 10 * coalesce(s.second, m.most) AS sure FROM t JOIN m USING (town) LEFT JOIN s USING (town)""")
def possible_countries(spark, d):
    """Texts that are a town's name alone: all countries that have such a town, and whether one town stands out."""
    p = table(spark, d, "place").select(T.fold("name").alias("town"), "country", "population")
    m = p.groupBy("town").agg(F.array_sort(F.collect_set("country")).alias("countries"), F.max("population").alias("most"), F.count("*").alias("places"))
    s = p.join(m.select("town", "most"), "town").where(F.col("population") < F.col("most")).groupBy("town").agg(F.max("population").alias("second"))
    t = table(spark, d, "job").where("location_text IS NOT NULL").select("id", F.trim(F.regexp_replace(T.fold("location_text"), r"[\s\u00a0]+", " ")).alias("town"))
    return t.join(m, "town").join(s, "town", "left").select("id", "countries", ((F.col("places") == 1) | (F.col("most") >= 10 * F.coalesce("second", "most"))).alias("sure"))


@query(f"""WITH c AS (SELECT job_id, unnest(cities) AS city, countries FROM ({_CURRENT})), n AS (SELECT DISTINCT {_FOLD.format('name')} AS town, country FROM place)
SELECT job_id, city, EXISTS (SELECT 1 FROM n WHERE n.town = {_FOLD.format('c.city')}) AS known, EXISTS (SELECT 1 FROM n WHERE n.town = {_FOLD.format('c.city')} AND list_contains(c.countries, n.country)) AS known_there FROM c WHERE city IS NOT NULL GROUP BY job_id, city, countries""")
def known_towns(spark, d):
    """Whether a town as spelled is in the list of places, and in one of the posting's countries."""
    n = table(spark, d, "place").select(T.fold("name").alias("town"), "country").groupBy("town").agg(F.collect_set("country").alias("where"))
    c = _facets(spark, d).select("job_id", "countries", F.explode("cities").alias("city")).where("city IS NOT NULL").distinct()
    return c.withColumn("town", T.fold("city")).join(n, "town", "left").select("job_id", "city", F.col("where").isNotNull().alias("known"), F.coalesce(F.arrays_overlap("where", "countries"), F.lit(False)).alias("known_there"))


# --- planted items ----------------------------------------------------------------------------------------------------


@query(f"""WITH {_WORDS}, pl AS (SELECT q, id, pos FROM wp), t AS (SELECT id AS q, 'T' || (1 + id % 3) AS tier FROM job WHERE id % 50 = 0 AND title IS NOT NULL)
SELECT t.tier, count(*) AS planted, count(pl.pos) FILTER (WHERE pl.pos <= 10) AS in_10, count(pl.pos) AS found, round(sum(coalesce(1.0::DOUBLE / pl.pos, 0)) / count(*), 6) AS mrr, quantile_cont(pl.pos::DOUBLE, 0.5) AS median_place FROM t LEFT JOIN pl ON pl.q = t.q AND pl.id = t.q GROUP BY 1""")
def planted_recall_by_tier(spark, d):
    """Of each tier's planted items (a query's own posting) how many the word arm brings, how far in front."""
    j = table(spark, d, "job").where((F.col("id") % 50 == 0) & F.col("title").isNotNull())
    asked = j.select(F.col("id").alias("q"), F.regexp_replace("title", r"\s*[,/(–*].*$", "").alias("text"))
    docs = _docs(spark, d)
    ranked = search.newest_first(search.word_matches(asked, docs), docs)
    planted = j.select(F.col("id").alias("q"), F.col("id"), F.concat(F.lit("T"), (1 + F.col("id") % 3).cast("string")).alias("tier"))
    return evaluation.recall_by_tier(ranked, planted, 10)


@query(f"""WITH {_WORDS}, a AS (SELECT q % 3 AS tier, q, id, pos FROM wp WHERE pos <= 20), b AS (SELECT q % 3 AS tier, q, id, row_number() OVER (PARTITION BY q ORDER BY posted DESC NULLS LAST, id) AS pos FROM wp),
m AS (SELECT a.tier, a.pos AS before, b.pos AS after FROM a LEFT JOIN b ON b.q = a.q AND b.id = a.id) SELECT tier, count(*) FILTER (WHERE before <= 5) AS top_before, count(*) FILTER (WHERE after <= 5) AS top_after, count(*) FILTER (WHERE after - before > 20) AS slid, count(*) FILTER (WHERE after <= 5) < count(*) FILTER (WHERE before <= 5) AS dropped FROM m GROUP BY 1""")
def runs_compared(spark, d):
    """A run against a baseline by tier: how many stand in front in either, how many slid by more than twenty places, and whether the tier dropped."""
    from .market import _word_arm

    arm = _word_arm(spark, d).join(_docs(spark, d).select("id", "posted"), "id")
    later = arm.withColumn("after", F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("posted"), "id"))).where("pos <= 20")
    before, after = F.count_if(F.col("pos") <= 5), F.count_if(F.col("after") <= 5)
    return later.groupBy((F.col("q") % 3).alias("tier")).agg(before.alias("top_before"), after.alias("top_after"), F.count_if(F.col("after") - F.col("pos") > 20).alias("slid"), (after < before).alias("dropped"))


_EMPLOYER = f"trim(regexp_replace({_NORM.format('company')}, '(?:\\s(?:{T.LEGAL_FORMS}))+$', ''))"


@query(f"""WITH k AS (SELECT id, CASE WHEN {_EMPLOYER} <> '' THEN {_EMPLOYER} ELSE {_NORM.format('company')} END AS employer, trim(regexp_replace(regexp_replace(regexp_replace({_FOLD.format('title')}, '{T.GENDER_MARKS}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), '\\s+', ' ', 'g')) AS role FROM job)
SELECT employer, role, count(*) AS postings, min(id) AS held FROM k GROUP BY 1, 2""")
def linked_records(spark, d):
    """Postings by employer without its legal form and title without gender marks, with the smallest id of each."""
    j = table(spark, d, "job").select("id", T.employer_key("company").alias("employer"), T.role_key("title").alias("role"))
    return j.groupBy("employer", "role").agg(F.count("*").alias("postings"), F.min("id").alias("held"))
