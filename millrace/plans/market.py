"""Queries for search, areas, place texts and writes, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from ..operators import changes, locations, retrieval, search, tables
from .reference import _CURRENT, _FOLD, _NORM, _PAIR, ORACLE, QUERIES, _facets, query

__all__ = ["ORACLE", "QUERIES"]

# --- search -----------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in search.STOP)


def _stems(words: str) -> str:
    return f"list_transform(list_filter(string_split(coalesce({words}, ''), ' '), lambda x: x <> '' AND x NOT IN ({_STOP})), lambda x: regexp_replace(x, '{search.ENDINGS}', '\\1'))"


_FIELDS = (("title", 10), ("company", 4), ("location_text", 2), ("description", 1))
_INDEX = " UNION ALL ".join(f"SELECT id, unnest({_stems(_NORM.format(c))}) AS term, {w} AS w FROM job" for c, w in _FIELDS)
_SHORT = "regexp_replace(" + _FOLD.format("concat_ws(' ', title, company, location_text)") + ", '\\s+', ' ', 'g')"
#: Text of a query: a posting's title without what follows its first comma, dash or bracket.
_ASK = "regexp_replace(title, '\\s*[,/(–*].*$', '')"
_WORDS = f"""t0 AS ({_INDEX}), ix AS (SELECT id, term, sum(w) AS weight FROM t0 GROUP BY 1, 2), ask AS (SELECT id AS q, {_ASK} AS t FROM job WHERE id % 50 = 0 AND title IS NOT NULL),
pq AS (SELECT q, list_distinct({_stems(_NORM.format("regexp_replace(t, '(^|\\s)-\\S+', ' ', 'g')"))}) AS wanted, trim(regexp_replace({_FOLD.format("regexp_replace(t, '(^|\\s)-\\S+', ' ', 'g')")}, '\\s+', ' ', 'g')) AS folded FROM ask),
wt AS (SELECT q, unnest(wanted) AS term, len(wanted) AS n FROM pq WHERE folded <> ''),
wh AS (SELECT wt.q, ix.id, sum(ix.weight)::BIGINT AS rank FROM wt JOIN ix USING (term) GROUP BY wt.q, ix.id, wt.n HAVING count(*) = wt.n),
sb AS (SELECT pq.q, d.id, 0::BIGINT AS rank FROM pq JOIN (SELECT id, {_SHORT} AS s FROM job) d ON contains(d.s, pq.folded) WHERE pq.folded <> ''),
wm AS (SELECT q, id, max(rank) AS rank FROM (SELECT * FROM wh UNION ALL SELECT * FROM sb) GROUP BY 1, 2),
wp AS (SELECT wm.q, wm.id, wm.rank, j.first_seen_at AS posted, row_number() OVER (PARTITION BY wm.q ORDER BY wm.rank DESC, j.first_seen_at DESC NULLS LAST, wm.id) AS pos FROM wm JOIN job j USING (id))"""


def _docs(spark, d):
    return table(spark, d, "job").select("id", "title", "company", F.col("location_text").alias("location"), "description", F.col("first_seen_at").alias("posted"))


def _asked(spark, d):
    return table(spark, d, "job").where((F.col("id") % 50 == 0) & F.col("title").isNotNull()).select(F.col("id").alias("q"), F.regexp_replace("title", r"\s*[,/(–*].*$", "").alias("text"))


def _word_arm(spark, d, k=None):
    docs = _docs(spark, d)
    return search.newest_first(search.word_matches(_asked(spark, d), docs), docs, k=k)


@query(f"WITH {_WORDS} SELECT q, id, rank, pos FROM wp WHERE pos <= 50")
def word_ranks(spark, d):
    """Stemmed words with weighted fields or a substring, newest first among equals; titles of ids divisible by 50 as queries."""
    return _word_arm(spark, d, 50)


@query(f"WITH {_WORDS} SELECT q, count(*) AS matches, count(*) FILTER (WHERE rank > 0) AS by_words, max(rank) AS best FROM wm GROUP BY 1")
def word_match_counts(spark, d):
    m = search.word_matches(_asked(spark, d), _docs(spark, d))
    return m.groupBy("q").agg(F.count("*").alias("matches"), F.count_if(F.col("rank") > 0).alias("by_words"), F.max("rank").alias("best"))


_VEC = """ev AS (SELECT job_id AS id, r.v AS v, (r.e)::DOUBLE[] AS e FROM (SELECT job_id, arg_max({'v': embedding_version, 'e': embedding_768}, (embedded_at, embedding_768)) AS r FROM job_embedding GROUP BY 1) WHERE r.v LIKE '%base%' AND len(r.e) = 768 AND len(list_filter(r.e, lambda x: x IS NOT NULL AND isfinite(x))) = 768 AND len(list_filter(r.e, lambda x: x <> 0)) > 0),
vp AS (SELECT a.id AS q, b.id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.id) AS pos FROM ev a JOIN ev b ON a.id <> b.id WHERE a.id % 50 = 0 QUALIFY pos <= 50)"""
_MIXED = f"WITH {_WORDS}, {_VEC}, l AS (SELECT q, 'words' AS arm, id, pos, 2.0 AS weight FROM wp WHERE pos <= 50 UNION ALL SELECT q, 'vectors', id, pos, 1.0 FROM vp)"


def _vector_arm(spark, d):
    e = table(spark, d, "job_embedding").groupBy("job_id").agg(F.max_by(F.struct("embedding_version", "embedding_768"), F.struct("embedded_at", "embedding_768")).alias("r"))
    e = e.where(F.col("r.embedding_version").contains("base") & (F.size("r.embedding_768") == 768)).select(F.col("job_id").alias("id"), F.col("r.embedding_768").alias("vec"))
    return retrieval.dense_topk(e.where(F.col("id") % 50 == 0).select(F.col("id").alias("q"), "vec"), e, 50)


def _mixed(spark, d):
    words = _word_arm(spark, d, 50).select("q", "id", "pos").withColumns({"arm": F.lit("words"), "weight": F.lit(2.0)})
    return words.unionByName(_vector_arm(spark, d).withColumns({"arm": F.lit("vectors"), "weight": F.lit(1.0)}))


@query(f"{_MIXED}, s AS (SELECT q, id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score FROM l GROUP BY 1, 2) SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS pos FROM s QUALIFY pos <= 2000")
def word_vector_fusion(spark, d):
    """The word arm and the vector arm of the same postings fused by reciprocal ranks, cut at 2000."""
    return retrieval.fuse(_mixed(spark, d), depth=2000).select("q", "id", "pos")


@query(f"{_MIXED}, m AS (SELECT q, arm, id, weight, row_number() OVER (PARTITION BY q, arm ORDER BY pos, id) AS p FROM l), s AS (SELECT q, id, round(sum(weight::DOUBLE * (1.0::DOUBLE / (60 + p))), 9) AS score FROM m GROUP BY 1, 2) SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS pos FROM s")
def word_vector_arm_max_weighted(spark, d):
    return retrieval.fuse(_mixed(spark, d), "arm_max_weighted").select("q", "id", "pos")


@query(f"""{_MIXED}, r AS (SELECT q, id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS s1, round(sum(weight::DOUBLE * (1.0::DOUBLE / (60 + pos))), 9) AS s2 FROM l GROUP BY 1, 2),
g AS (SELECT 'rrf' AS rule, q, id, row_number() OVER (PARTITION BY q ORDER BY s1 DESC, id) AS pos FROM r UNION ALL SELECT 'weighted', q, id, row_number() OVER (PARTITION BY q ORDER BY s2 DESC, id) FROM r)
SELECT rule, count(DISTINCT q) AS queries, count(*) FILTER (WHERE id = q AND pos <= 10) AS own_in_10, count(*) FILTER (WHERE id = q) AS own_found FROM g GROUP BY 1""")
def fusion_rules_compared(spark, d):
    """What the rules make of the same lists: how often a query's own posting, which only its words can find, stands in front."""
    lists = _mixed(spark, d)
    both = None
    for rule in ("rrf", "weighted"):
        g = retrieval.fuse(lists, rule).withColumn("rule", F.lit(rule))
        both = g if both is None else both.unionByName(g)
    own = F.col("id") == F.col("q")
    return both.groupBy("rule").agg(F.count_distinct("q").alias("queries"), F.count_if(own & (F.col("pos") <= 10)).alias("own_in_10"), F.count_if(own).alias("own_found"))


@query(f"""WITH {_WORDS}, pb AS (SELECT q, id, rank, posted FROM wp WHERE pos % 7 = 3)
SELECT pb.q, pb.id, count(*) FILTER (WHERE w.id <> pb.id AND (w.rank > pb.rank OR (w.rank = pb.rank AND CASE WHEN pb.posted IS NULL THEN true WHEN w.posted IS NULL THEN false ELSE w.posted > pb.posted END))) AS before FROM pb LEFT JOIN wp w ON w.q = pb.q GROUP BY 1, 2""")
def lexical_places(spark, d):
    """Where some of a query's matches would stand if they were new: rows before them by rank and date."""
    arm = _word_arm(spark, d).join(_docs(spark, d).select("id", "posted"), "id")
    return search.lexical_place(arm, arm.where(F.col("pos") % 7 == 3))


@query(f"""WITH {_WORDS}, top AS (SELECT q, id, pos FROM wp WHERE pos <= 10), pb AS (SELECT q, id, pos - 1 AS before FROM wp WHERE pos IN (3, 9, 12)),
r AS (SELECT top.q, pb.id AS probe, pb.before, top.id, row_number() OVER (PARTITION BY top.q, pb.id ORDER BY top.pos, top.id) AS n FROM top JOIN pb USING (q) WHERE top.id <> pb.id),
m AS (SELECT q, probe, id, CASE WHEN n > before THEN n + 1 ELSE n END AS pos FROM r UNION ALL SELECT pb.q, pb.id, pb.id, least(pb.before + 1, coalesce((SELECT max(n) FROM r WHERE r.q = pb.q AND r.probe = pb.id), 0) + 1) FROM pb WHERE pb.before < 10)
SELECT q, probe, id, pos::BIGINT AS pos FROM m WHERE pos <= 10""")
def counterfactual_lists(spark, d):
    """Each query's first ten as they would be with a match taken out and put in at its own place."""
    arm = _word_arm(spark, d)
    probes = arm.where(F.col("pos").isin(3, 9, 12)).select("q", "id", (F.col("pos") - 1).alias("before"))
    return search.insert_at(arm.where("pos <= 10"), probes, 10).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""WITH {_WORDS}, {_VEC}, c AS (SELECT q, id, min(pos) FILTER (WHERE a = 'w') AS w, min(pos) FILTER (WHERE a = 'v') AS v FROM (SELECT q, id, pos, 'w' AS a FROM wp WHERE pos <= 50 UNION ALL SELECT q, id, pos, 'v' FROM vp) GROUP BY 1, 2),
f AS (SELECT q, id, w, v, row_number() OVER (PARTITION BY q ORDER BY round(coalesce(1.0::DOUBLE / (60 + w), 0) + coalesce(1.0::DOUBLE / (60 + v), 0), 9) DESC, id) AS pos FROM c),
k AS (SELECT DISTINCT j.batch_no AS night, a.q, a.id FROM wp a JOIN job j ON j.id = a.id WHERE a.pos BETWEEN 2 AND 6)
SELECT k.night, count(*) AS needles, count(f.pos) FILTER (WHERE f.pos <= 5) AS found, count(f.w) AS by_words, count(f.v) AS by_vectors, quantile_cont(f.pos::DOUBLE, 0.5) AS median_place FROM k LEFT JOIN f ON f.q = k.q AND f.id = k.id GROUP BY 1""")
def recall_nights(spark, d):
    """Of the postings kept each night (a batch), how many the fused list still brings among its first five, and through which arm."""
    lists = _mixed(spark, d)
    arms = lists.groupBy("q", "id").agg(F.min(F.when(F.col("arm") == "words", F.col("pos"))).alias("w"), F.min(F.when(F.col("arm") == "vectors", F.col("pos"))).alias("v"))
    fused = retrieval.fuse(lists).join(arms, ["q", "id"]).select("q", "id", "pos", "w", "v")
    kept = _word_arm(spark, d, 6).where("pos >= 2").join(table(spark, d, "job").select("id", F.col("batch_no").alias("night")), "id").select("night", "q", "id").distinct()
    j = kept.join(fused, ["q", "id"], "left")
    return j.groupBy("night").agg(F.count("*").alias("needles"), F.count_if(F.col("pos") <= 5).alias("found"), F.count("w").alias("by_words"), F.count("v").alias("by_vectors"), F.percentile("pos", 0.5).alias("median_place"))


_PAGE = f"contains({_SHORT}, 'senior')"


@query(f"""WITH f AS ({_CURRENT}), s AS (SELECT job_id, count(*) AS quotes FROM salary_quote GROUP BY 1),
h AS (SELECT j.id, j.source, f.work_mode, coalesce(s.quotes, 0) AS quotes, length(j.title) - length(replace(lower(j.title), 'senior', '')) AS rank, j.first_seen_at FROM job j LEFT JOIN f ON f.job_id = j.id LEFT JOIN s ON s.job_id = j.id WHERE j.closed_at IS NULL AND coalesce(f.work_mode, 'unknown') <> 'remote' AND {_PAGE})
SELECT id, source, work_mode, quotes, row_number() OVER (ORDER BY rank DESC, first_seen_at DESC NULLS LAST, id) AS place FROM h ORDER BY place LIMIT 20 OFFSET 5""")
def search_page(spark, d):
    """One page of a search over open postings, with facets and quotes beside those that have them; by relevance, then recency."""
    s = table(spark, d, "salary_quote").groupBy("job_id").agg(F.count("*").alias("quotes"))
    j = table(spark, d, "job").where(F.col("closed_at").isNull() & F.contains(F.regexp_replace(T.fold(F.concat_ws(" ", "title", "company", "location_text")), r"\s+", " "), F.lit("senior")))
    h = j.select(F.col("id").alias("job_id"), "source", "title", "first_seen_at").join(_facets(spark, d).select("job_id", "work_mode"), "job_id", "left").join(s, "job_id", "left").where(F.coalesce("work_mode", F.lit("unknown")) != "remote")
    h = h.withColumn("rank", F.length("title") - F.length(F.replace(F.lower("title"), F.lit("senior"), F.lit(""))))
    page = h.orderBy(F.desc_nulls_last("rank"), F.desc_nulls_last("first_seen_at"), "job_id").offset(5).limit(20)
    # the page alone is numbered, so one task is enough
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("rank"), F.desc_nulls_last("first_seen_at"), "job_id")) + 5
    return page.select(F.col("job_id").alias("id"), "source", "work_mode", F.coalesce("quotes", F.lit(0)).alias("quotes"), place.alias("place"))


# --- areas and place texts --------------------------------------------------------------------------------------------

_KM2 = "round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2)))), 3)"
_READERS = """rd AS (SELECT id AS area, id, country, lat, lon, row_number() OVER (ORDER BY population DESC, id) AS n FROM place QUALIFY n <= 12),
ar AS (SELECT area, n % 3 <> 0 AS remote, CASE WHEN n % 4 = 0 THEN [country] ELSE [] END AS countries FROM rd),
ai AS (SELECT c.area, list(DISTINCT p.id) AS ids, list(DISTINCT p.country) AS ctry FROM rd c JOIN place p ON """ + _KM2 + """ <= 60 GROUP BY 1),
aa AS (SELECT ar.*, ai.ids, ai.ctry FROM ar JOIN ai USING (area))"""
_ROWS = f"""rw AS (SELECT j.id, coalesce(trim(j.location_text), '') = '' AS blank, CASE WHEN j.company IS NOT NULL THEN {_PAIR} END AS grp, j.closed_at, j.first_seen_at, coalesce(f.countries, []) AS countries, coalesce(f.place_ids, []) AS place_ids, coalesce(f.unplaced_countries, []) AS unplaced, coalesce(f.work_mode = 'remote', false) AS rem FROM job j LEFT JOIN ({_CURRENT}) f ON f.job_id = j.id)"""
_ADMIT = f"""WITH {_READERS}, {_ROWS}, jj AS (SELECT rw.*, aa.area, aa.remote, list_has_any(rw.countries, aa.countries) OR list_has_any(rw.place_ids, aa.ids) OR list_has_any(rw.unplaced, aa.ctry) OR rw.rem AS admits, len(rw.countries) > 0 OR len(rw.unplaced) > 0 OR len(rw.place_ids) > 0 AS stated FROM rw, aa),
tw AS (SELECT grp, area, bool_or(closed_at IS NULL) AS open_any, bool_or(closed_at IS NULL AND admits) AS open_admits, max(closed_at) AS last_closed FROM jj WHERE NOT blank AND stated AND grp IS NOT NULL GROUP BY 1, 2),
kk AS (SELECT jj.area, jj.id, (jj.remote OR NOT jj.rem) AND CASE WHEN jj.blank AND coalesce(tw.open_any, false) THEN tw.open_admits ELSE jj.admits OR NOT jj.stated END AS kept, jj.blank AND NOT coalesce(tw.open_any, false) AND coalesce(tw.last_closed >= jj.first_seen_at, false) AS closed_at_origin FROM jj LEFT JOIN tw USING (grp, area))"""


def _readers(spark, d):
    p = table(spark, d, "place").orderBy(F.desc("population"), "id").limit(12).withColumn("n", F.row_number().over(Window.orderBy(F.desc("population"), "id")))
    return p.select(F.col("id").alias("area"), F.when(F.col("n") % 4 == 0, F.array("country")).otherwise(F.array().cast("array<string>")).alias("countries"), F.array("id").alias("city_ids"), F.lit(60).alias("radius_km"), (F.col("n") % 3 != 0).alias("remote"))


def _located(spark, d):
    j = table(spark, d, "job")
    group = F.when(F.col("company").isNotNull(), T.pairing_key("title", "company", "scope"))
    j = j.select(F.col("id").alias("job_id"), (F.trim(F.coalesce("location_text", F.lit(""))) == "").alias("blank"), group.alias("dedup_group"), "closed_at", "first_seen_at")
    return j.join(_facets(spark, d).select("job_id", "countries", "place_ids", "unplaced_countries", "work_mode"), "job_id", "left").withColumnRenamed("job_id", "id")


def _admitted(spark, d):
    return locations.admitted(_located(spark, d), locations.areas(_readers(spark, d), table(spark, d, "place")))


@query(f"{_ADMIT} SELECT area, id FROM kk WHERE kept AND NOT closed_at_origin")
def area_admitted(spark, d):
    """What twelve readers' areas (a town and 60 km around) admit of all postings, copies judged by their placed twins."""
    return _admitted(spark, d).where("kept AND NOT closed_at_origin").select("area", "id")


@query(f"{_ADMIT} SELECT area, count(*) AS postings, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE closed_at_origin) AS closed_at_origin FROM kk GROUP BY 1")
def area_counts(spark, d):
    return _admitted(spark, d).groupBy("area").agg(F.count("*").alias("postings"), F.count_if("kept").alias("kept"), F.count_if("closed_at_origin").alias("closed_at_origin"))


@query(f"WITH {_READERS} SELECT area, len(ids) AS places, list_sort(ctry) AS countries FROM aa")
def area_places(spark, d):
    a = locations.areas(_readers(spark, d), table(spark, d, "place"))
    return a.select("area", F.size("area_ids").cast("bigint").alias("places"), F.col("area_countries").alias("countries"))


@query(f"""{_ADMIT}, g AS (SELECT rw.id, rw.grp, j.source, rw.closed_at FROM rw JOIN job j USING (id)), x AS (SELECT kk.area, g.source, g.id, g.closed_at, g.grp FROM kk JOIN g USING (id) WHERE kk.kept),
y AS (SELECT area, grp, count(DISTINCT source) AS sources FROM x WHERE grp IS NOT NULL GROUP BY 1, 2)
SELECT x.area, x.source, count(*) AS postings, count(*) FILTER (WHERE x.closed_at IS NULL) AS open, count(*) FILTER (WHERE coalesce(y.sources, 1) = 1) AS only_source FROM x LEFT JOIN y USING (area, grp) GROUP BY 1, 2""")
def area_coverage(spark, d):
    """Per area and source what it holds, what is open, and what no other source of the same area has; a null group is its own."""
    facts = _located(spark, d).select("id", "dedup_group", "closed_at").join(table(spark, d, "job").select("id", "source"), "id")
    k = _admitted(spark, d).where("kept").select("area", "id").join(facts, "id")
    g = k.where("dedup_group IS NOT NULL").groupBy("area", "dedup_group").agg(F.count_distinct("source").alias("sources"))
    j = k.join(g, ["area", "dedup_group"], "left")
    return j.groupBy("area", "source").agg(F.count("*").alias("postings"), F.count_if(F.col("closed_at").isNull()).alias("open"), F.count_if(F.coalesce("sources", F.lit(1)) == 1).alias("only_source"))


_PARTS = "list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({0}, ''), '[,;|/()\\[\\]]|\\s[-–—]\\s'), lambda p: trim(regexp_replace(p, '[\\s\\x{{00a0}}]+', ' ', 'g'))), lambda p: p <> ''))".format(_FOLD.format("location_text"))
_CODES = "MAP {" + ", ".join(f"'{w}': {cs!r}" for w, cs in locations._codes().items()) + "}"
_KNOWN = ", ".join(f"'{w}'" for w in (*locations._codes(), *locations.REMOTE))
_REMOTE = ", ".join(f"'{w}'" for w in locations.REMOTE)


@query(f"""WITH c AS (SELECT {_CODES} AS m), p AS (SELECT id, {_PARTS} AS ps FROM job)
SELECT id, list_sort(list_distinct(flatten(list_transform(ps, lambda x: coalesce(m[x], []))))) AS countries, list_sort(list_filter(ps, lambda x: x NOT IN ({_KNOWN}))) AS towns, len(list_filter(ps, lambda x: x IN ({_REMOTE}))) > 0 AS remote FROM p, c""")
def place_text_facts(spark, d):
    """Countries, towns and remote words of every posting's place text."""
    return table(spark, d, "job").select("id", locations.countries_of("location_text").alias("countries"), F.array_sort(locations.towns_of("location_text")).alias("towns"), locations.names_remote("location_text").alias("remote"))


_TITLE_COUNTRIES = ", ".join(f"CASE WHEN {' OR '.join('contains(t, ' + repr(f' {w.replace(chr(45), chr(32))} ') + ')' for w in words if len(w) > 3)} THEN '{c}' END" for c, words in sorted(locations.COUNTRIES.items()))


@query(f"""WITH p AS (SELECT id, ' ' || regexp_replace(coalesce({_FOLD.format("title || ' ' || coalesce(location_text, '')")}, ''), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM job) SELECT id, list_filter([{_TITLE_COUNTRIES}], lambda x: x IS NOT NULL) AS countries FROM p""")
def countries_named(spark, d):
    """Countries whose full names stand in a title and place text, as whole words."""
    return table(spark, d, "job").select("id", locations.countries_in_title(F.concat("title", F.lit(" "), F.coalesce("location_text", F.lit("")))).alias("countries"))


# --- writes -----------------------------------------------------------------------------------------------------------

_EXT = "lower(trim(external_id, E' \\t'))"


def _fetched(spark, d):
    docs = table(spark, d, "source_document").where("kind = 'listing'").select("id", "source", F.lower(F.trim(F.regexp_replace("external_id", r"\t", " "))).alias("external_id"), "fetched_at", "payload_sha256", "sweep_id")
    return docs.withColumn("late", F.row_number().over(Window.partitionBy("source", "external_id").orderBy("fetched_at", "id")))


@query(f"""WITH f AS (SELECT id, source, {_EXT} AS external_id, fetched_at, sweep_id, row_number() OVER (PARTITION BY source, {_EXT} ORDER BY fetched_at, id) AS n FROM source_document WHERE kind = 'listing')
SELECT a.id, a.source, a.external_id, epoch_us(coalesce(b.fetched_at, a.fetched_at)) AS fetched_us, a.sweep_id FROM f a LEFT JOIN f b ON b.source = a.source AND b.external_id = a.external_id AND b.n = 2 WHERE a.n = 1""")
def refetched_documents(spark, d):
    """A document seen again is not stored again: only when it was fetched changes."""
    f = _fetched(spark, d)
    out = changes.merge(f.where("late = 1"), f.where("late = 2"), ["source", "external_id"], {"fetched_at": "incoming"})
    return out.select("id", "source", "external_id", F.unix_micros("fetched_at").alias("fetched_us"), "sweep_id")


@query("""WITH o AS (SELECT id, title, first_seen_at, last_seen_at, closed_at, description FROM job WHERE id % 3 <> 0), n AS (SELECT id, upper(title) AS title, CASE WHEN id % 4 = 0 THEN NULL ELSE description END AS description FROM job WHERE id % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(CASE WHEN n.id IS NOT NULL THEN n.description END, o.description) IS NOT NULL AS described, o.first_seen_at IS NOT NULL AS seen_before, CASE WHEN o.id IS NULL OR n.id IS NOT NULL THEN NULL ELSE epoch_us(o.closed_at) END AS closed_us FROM o FULL JOIN n ON o.id = n.id""")
def refreshed_postings(spark, d):
    """A posting seen again takes the new title, keeps when it was first seen and its description if none came, and is open."""
    j = table(spark, d, "job").select("id", "title", "first_seen_at", "last_seen_at", "closed_at", "description")
    new = j.where("id % 2 = 0").select("id", F.upper("title").alias("title"), F.when(F.col("id") % 4 != 0, F.col("description")).alias("description"))
    out = changes.merge(j.where("id % 3 <> 0"), new, ["id"], {"title": "incoming", "description": "prefer", "closed_at": "clear"})
    return out.select("id", "title", F.col("description").isNotNull().alias("described"), F.col("first_seen_at").isNotNull().alias("seen_before"), F.unix_micros("closed_at").alias("closed_us"))


@query("""SELECT o_custkey, sum(cents)::BIGINT AS cents, count(*) AS writes FROM (SELECT o_custkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders) GROUP BY 1""")
def added_totals(spark, d):
    """Totals kept by adding: two halves of the writes, each summed first, merged one into the other."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    part = lambda x: o.where(x).groupBy("o_custkey").agg(F.sum("cents").alias("cents"), F.count("*").alias("writes"))
    return changes.merge(part("o_orderkey % 2 = 0"), part("o_orderkey % 2 <> 0"), ["o_custkey"], {"cents": "add", "writes": "add"})


@query("""WITH l AS (SELECT id, source, coalesce(CASE WHEN id % 5 = 0 THEN '' ELSE regexp_replace(url, '[0-9]+$', '') END, '') AS url FROM job), o AS (SELECT * FROM l WHERE id % 3 = 0), n AS (SELECT * FROM l WHERE id % 3 <> 0)
SELECT id, source, url FROM o UNION ALL SELECT id, source, url FROM n WHERE url = '' UNION ALL SELECT min(id), source, url FROM n WHERE url <> '' AND NOT EXISTS (SELECT 1 FROM o WHERE o.source = n.source AND o.url = n.url) GROUP BY source, url""")
def unique_links(spark, d):
    """Links are unique where there is one: rows without a link are all added, others only if no row has the link yet."""
    l = table(spark, d, "job").select("id", "source", F.coalesce(F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.regexp_replace("url", "[0-9]+$", "")), F.lit("")).alias("url"))
    return changes.add_unless_held(l.where("id % 3 = 0"), l.where("id % 3 <> 0"), ["source", "url"], guarded=F.col("url") != "", order=["id"])


@query("""WITH b AS (SELECT DISTINCT source, scope FROM source_sweep WHERE scope IS NOT NULL), n AS (SELECT DISTINCT source, scope FROM job WHERE scope IS NOT NULL) SELECT source, scope, true AS enabled FROM b UNION ALL SELECT source, scope, false FROM n WHERE (source, scope) NOT IN (SELECT source, scope FROM b)""")
def promoted_boards(spark, d):
    """Boards found in postings are added, not enabled; boards that are there stay as they are."""
    held = table(spark, d, "source_sweep").where("scope IS NOT NULL").select("source", "scope").distinct().withColumn("enabled", F.lit(True))
    new = table(spark, d, "job").where("scope IS NOT NULL").select("source", "scope").distinct().withColumn("enabled", F.lit(False))
    return changes.add_unless_held(held, new, ["source", "scope"])


@query("SELECT title, company, count(*) AS rows FROM job GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_titles(spark, d):
    return changes.duplicates(table(spark, d, "job"), ["title", "company"])


@query("SELECT id, CASE WHEN closed_at IS NULL AND scope IS NULL AND last_seen_at < TIMESTAMPTZ '2026-04-01 00:00:00+00' - INTERVAL 10 DAY THEN epoch_us(TIMESTAMPTZ '2026-04-01 00:00:00+00') ELSE epoch_us(closed_at) END AS closed_us FROM job")
def closed_by_age(spark, d):
    """Postings of sources that are never seen in full close once they have not been seen for ten days."""
    now = F.lit("2026-04-01 00:00:00").cast("timestamp")
    j = table(spark, d, "job")
    out = changes.set_where(j, F.col("closed_at").isNull() & F.col("scope").isNull() & changes.aged_out(j, "last_seen_at", now, 10), {"closed_at": now})
    return out.select("id", F.unix_micros("closed_at").alias("closed_us"))


@query("""WITH n AS (SELECT source, scope, coalesce(ok, false) AS g, started_at, id FROM source_sweep), l AS (SELECT source, scope, max((started_at, id)) FILTER (WHERE g) AS k, max(started_at) FILTER (WHERE g) AS ok_at, max(started_at) FILTER (WHERE NOT g) AS bad_at, count(*) AS events FROM n GROUP BY 1, 2)
SELECT l.source, l.scope, l.events, (SELECT count(*) FROM n WHERE n.source = l.source AND n.scope IS NOT DISTINCT FROM l.scope AND NOT n.g AND (l.k IS NULL OR (n.started_at, n.id) > l.k)) AS failures, epoch_us(l.ok_at) AS last_ok_us, epoch_us(l.bad_at) AS last_error_us FROM l""")
def board_health(spark, d):
    """Failures in a row, last success and last failure of each board after all its sweeps."""
    s = table(spark, d, "source_sweep").withColumn("board", F.coalesce("scope", F.lit("\0")))
    h = changes.fold_health(s, ["source", "board"], "started_at", "id", F.col("ok"))
    return h.select("source", F.nullif("board", F.lit("\0")).alias("scope"), "events", "failures", F.unix_micros("last_ok").alias("last_ok_us"), F.unix_micros("last_error").alias("last_error_us"))


@query("""WITH a AS (SELECT job_id, coalesce(cities, []) AS cities, coalesce(place_ids, []) AS ids FROM (""" + _CURRENT + """)), i AS (SELECT job_id, unnest(generate_series(1, greatest(len(cities), len(ids)))) AS place, cities, ids FROM a) SELECT job_id, place, cities[place] AS city, ids[place] AS place_id FROM i""")
def zipped_places(spark, d):
    """Towns as spelled beside the places read, one row a place, numbered."""
    f = _facets(spark, d).select("job_id", F.coalesce("cities", F.array().cast("array<string>")).alias("city"), F.coalesce("place_ids", F.array().cast("array<int>")).alias("place_id"))
    z = f.select("job_id", F.posexplode(F.arrays_zip("city", "place_id")).alias("p", "r"))
    return z.select("job_id", (F.col("p") + 1).cast("bigint").alias("place"), "r.city", "r.place_id")


@query("""WITH e AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS attempts FROM events GROUP BY 1) SELECT user_id, attempts, CASE WHEN attempts >= 5 THEN 2592000 ELSE (60 * 2 ** attempts)::INT END AS wait_seconds, attempts >= 5 AS parked FROM e""")
def retry_waits(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("attempts"))
    return e.select("user_id", "attempts", changes.backoff_seconds(F.col("attempts")).alias("wait_seconds"), (F.col("attempts") >= 5).alias("parked"))


@query(f"""WITH v AS (SELECT job_id, max(derive_version) AS v FROM job_facet GROUP BY 1), s AS (SELECT j.id, v.v FROM job j LEFT JOIN v ON v.job_id = j.id WHERE v.v IS NULL OR v.v <> 12) SELECT id, v AS have_version, row_number() OVER (ORDER BY id) AS place FROM s WHERE id > 100 ORDER BY id LIMIT 500""")
def stale_page(spark, d):
    """A page of 500 postings whose derived row is missing or of another version than 12, after id 100."""
    s = tables.stale(table(spark, d, "job").select(F.col("id").alias("job_id")), table(spark, d, "job_facet"), "job_id", "derive_version", 12)
    page = s.where("job_id > 100").orderBy("job_id").limit(500)
    # the page alone is numbered
    return page.select(F.col("job_id").alias("id"), "have_version", F.row_number().over(Window.orderBy("job_id")).alias("place"))
