"""Boards found from links, copies of postings linked across sources, scans planned by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alphanumeric, host, normalise, path_segments

# Path parts that name no board.
LOCALES = ("de", "en", "fr", "nl", "es", "it", "de-de", "en-us", "en-gb")


def resolve_board(url: Column | str, rules: tuple[tuple[str, str], ...]) -> Column:
    """``(result, source, scope)`` of a URL by ordered rules (host suffix, source).

    The board is the label before the suffix, or, if the host is the bare suffix, the first path part that is no locale.
    Unknown hosts give ``unknown_host``, texts that are no URL ``no_url``, hosts without a board ``no_board``.
    """
    h = host(url)
    parts = F.filter(path_segments(url), lambda p: ~F.lower(p).isin(*LOCALES))
    out = F.struct(F.lit("unknown_host").alias("result"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("scope"))
    for suffix, source in reversed(rules):
        label = F.regexp_extract(h, r"([^.]+)\." + suffix.replace(".", r"\.") + "$", 1)
        scope = F.when(h == suffix, F.get(parts, F.lit(0))).when(label != "www", F.nullif(label, F.lit("")))
        found = F.struct(F.when(scope.isNull(), "no_board").otherwise("board").alias("result"), F.lit(source).alias("source"), scope.alias("scope"))
        out = F.when((h == suffix) | h.endswith("." + suffix), found).otherwise(out)
    none = F.struct(F.lit("no_url").alias("result"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("scope"))
    return F.when(h.isNull(), none).otherwise(out)


def id_tokens(url: Column | str, scope: Column | str) -> Column:
    """Ids a URL may hold: path parts and query values of 2 to 80 characters, bare and after the scope."""
    u = F.col(url) if isinstance(url, str) else url
    s = F.col(scope) if isinstance(scope, str) else scope
    values = F.transform(F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: F.contains(p, F.lit("="))), lambda p: F.regexp_extract(p, "=(.*)$", 1))
    bare = F.array_distinct(F.filter(F.concat(path_segments(u), values), lambda t: F.length(t).between(2, 80)))
    return F.array_union(bare, F.when(s.isNotNull(), F.transform(bare, lambda t: F.concat(s, F.lit(":"), t))).otherwise(F.array().cast("array<string>")))


def link_copies(postings: DataFrame) -> DataFrame:
    """``id, held``: each posting and the smallest id of those of the same folded title, employer and a common place.

    ``postings``: id, title, company, places (array).  Postings without title, employer or place stand for themselves.
    A title and employer that many share is no pair list: the smallest id is taken for each key and place, then for each id.
    """
    key = postings.select("id", normalise("title").alias("t"), alphanumeric("company").alias("c"), "places")
    named = key.where((F.col("t") != "") & (F.col("c") != "")).select("id", "t", "c", F.explode(F.array_distinct(F.transform("places", lambda p: normalise(p)))).alias("p")).where("p <> ''")
    least = named.groupBy("t", "c", "p").agg(F.min("id").alias("m"))
    own = named.join(least, ["t", "c", "p"]).groupBy("id").agg(F.min("m").alias("held"))
    return postings.select("id").join(own, "id", "left").select("id", F.coalesce("held", "id").alias("held"))


def plan_scans(rows: DataFrame, levels: list[str], cap: int) -> DataFrame:
    """The coarsest parts of ``rows`` that hold at most ``cap``: ``level``, the levels' values and ``rows``.

    A part is divided by the next level only where it is too large; at the last level it stays, too large or not.  Counted
    once at the finest level and summed up from there.
    """
    fine = rows.groupBy(*levels).agg(F.count("*").alias("_rows"))
    for i in range(len(levels)):
        fine = fine.withColumn(f"_s{i}", F.sum("_rows").over(Window.partitionBy(*levels[: i + 1])))
    level = F.lit(len(levels))
    for i in range(len(levels) - 1, 0, -1):
        level = F.when(F.col(f"_s{i - 1}") <= cap, i).otherwise(level)
    fine = fine.withColumn("_level", level)
    keep = [F.when(F.col("_level") > i, F.col(c)).alias(c) for i, c in enumerate(levels)]
    return fine.select(F.col("_level").alias("level"), *keep, "_rows").groupBy("level", *levels).agg(F.sum("_rows").alias("rows"))


def delta_window(rows: DataFrame, key: str, at: str, cutoff: Column, tie: str) -> DataFrame:
    """Rows newer than ``cutoff``, the latest of each key; older ones are skipped, not ended at.  Rows without a time stay out."""
    return rows.where(F.col(at) > cutoff).groupBy(key).agg(F.max_by(tie, F.struct(at, tie)).alias(tie), F.max(at).alias(at))
