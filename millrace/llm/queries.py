"""Queries of the corpus problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from .languages import mislabelled, posting_languages
from .leaks import find_leaks, needle_texts
from .mixing import mix
from .neighbours import embedding_rows, nearest_neighbours, recall_against_exact
from .places import entries_within, map_to_places, posting_mentions
from .repeats import find_repeats
from .spans import shared_share, shared_spans


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found, labels = posting_languages(table(spark, d, "job"), table(spark, d, "job_facet"))
    return mislabelled(found, labels).select(F.col("key").alias("job_id"), "language").distinct()


def p1_passages(spark: SparkSession, d: str) -> DataFrame:
    found, _ = posting_languages(table(spark, d, "job"), table(spark, d, "job_facet"))
    return found.withColumnRenamed("key", "job_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    n = nearest_neighbours(embedding_rows(table(spark, d, "job_embedding")))
    return n.select(F.least("key", "other").alias("job_id_a"), F.greatest("key", "other").alias("job_id_b")).distinct()


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """What p2_found's operator finds of the exact answer, over the stated queries (ids divisible by 50) against all rows."""
    rows = embedding_rows(table(spark, d, "job_embedding"))
    return recall_against_exact(rows, nearest_neighbours(rows))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    mentions = posting_mentions(table(spark, d, "job"), table(spark, d, "job_facet"))
    return map_to_places(mentions, table(spark, d, "place")).select(F.col("key").alias("job_id"), "place_id").distinct()


def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    """All places near each distinct mention, before one is settled on."""
    mentions = posting_mentions(table(spark, d, "job"), table(spark, d, "job_facet"))
    return entries_within(mentions, table(spark, d, "place"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = find_repeats(table(spark, d, "job"))
    return pairs.select(F.col("a").alias("job_id_a"), F.col("b").alias("job_id_b"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    hits = find_leaks(table(spark, d, "documents"), needle_texts(table(spark, d, "needles")))
    return hits.select("doc_id", F.col("item_id").alias("needle_id")).distinct()


def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """As p8_found, for passages of 24 words of which up to two may be edited; none is missed."""
    hits = find_leaks(table(spark, d, "documents"), needle_texts(table(spark, d, "needles")), window=24, max_edits=2, target_recall=1.0)
    return hits.select("doc_id", F.col("item_id").alias("needle_id"), "edits")


def p8_sampled(spark: SparkSession, d: str) -> DataFrame:
    """As p8_edited, by the walks' samples alone, at a target recall of 0.98."""
    hits = find_leaks(table(spark, d, "documents"), needle_texts(table(spark, d, "needles")), window=24, max_edits=2, target_recall=0.98)
    return hits.select("doc_id", F.col("item_id").alias("needle_id"), "edits")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_share(shared_spans(table(spark, d, "documents")))


# SQL for the same results, by brute force.
_P2 = """WITH l AS (SELECT job_id, arg_max({'v': embedding_version, 'e': embedding_768}, (embedded_at, embedding_768)) AS r FROM job_embedding GROUP BY 1),
u AS (SELECT job_id, r.v AS v, (r.e)::DOUBLE[] AS e FROM l WHERE len(r.e) = 768 AND len(list_filter(r.e, lambda x: x IS NOT NULL AND isfinite(x))) = 768 AND len(list_filter(r.e, lambda x: x <> 0)) > 0),
p AS (SELECT a.job_id AS a, b.job_id AS b, row_number() OVER (PARTITION BY a.job_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.job_id) AS r FROM u a JOIN u b ON a.v = b.v AND a.job_id <> b.job_id)
SELECT DISTINCT least(a, b) AS job_id_a, greatest(a, b) AS job_id_b FROM p WHERE r <= 5"""

_CLEAN = "nfc_normalize(regexp_replace(regexp_replace({0}, '</?[A-Za-z][^<>]*>', ' ', 'g'), '[\\x{{00ad}}\\x{{200b}}-\\x{{200f}}\\x{{feff}}]', '', 'g'))"
_WORDS = "list_filter(regexp_split_to_array(strip_accents(replace({0}, 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_DECODED = "text"
for _n in (196, 214, 220, 223, 228, 246, 252, 233, 232):
    _DECODED = f"replace({_DECODED}, '&#{_n};', '{chr(_n)}')"
_TWO = "replace(replace(replace(t, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')"
_P8 = f"""WITH d0 AS (SELECT doc_id, lower({_CLEAN.format(_DECODED)}) AS t FROM documents WHERE text IS NOT NULL), n0 AS (SELECT id, lower({_CLEAN.format("json_extract_string(detail, '$.stellenangebotsBeschreibung')")}) AS t FROM needles WHERE detail IS NOT NULL),
d AS (SELECT doc_id, {_WORDS.format("t")} AS w FROM d0 UNION ALL SELECT doc_id, {_WORDS.format(_TWO)} FROM d0 WHERE {_TWO} <> t), n AS (SELECT id, {_WORDS.format("t")} AS w FROM n0 UNION ALL SELECT id, {_WORDS.format(_TWO)} FROM n0 WHERE {_TWO} <> t),
a AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 12), b AS (SELECT id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM n WHERE len(w) >= 12)
SELECT DISTINCT doc_id, id AS needle_id FROM (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS p FROM a) x JOIN (SELECT id, array_to_string(w[i:i + 11], ' ') AS p FROM b) y USING (p)"""

_P10 = """WITH d AS (SELECT doc_id, text, unnest(generate_series(1, length(text) - 599)) AS i FROM documents WHERE length(text) >= 600),
w AS (SELECT doc_id, i, md5(substr(text, i, 600)) AS h FROM d), s AS (SELECT h FROM w GROUP BY 1 HAVING min(doc_id) <> max(doc_id))
SELECT doc_id, sum(n)::BIGINT AS shared_chars FROM (SELECT doc_id, coalesce(least(600, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i)), 600) AS n FROM w SEMI JOIN s USING (h)) GROUP BY 1"""

QUERIES = {"p1_found": p1_found, "p1_passages": p1_passages, "p2_found": p2_found, "p2_recall": p2_recall, "p3_found": p3_found, "p3_entries": p3_entries, "p7_found": p7_found, "p8_found": p8_found, "p8_edited": p8_edited, "p8_sampled": p8_sampled, "p9_mix": p9_mix, "p9_report": p9_report, "p10_found": p10_found}
ORACLE = {"p2_found": _P2, "p8_found": _P8, "p10_found": _P10}
