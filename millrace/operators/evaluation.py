"""Measures of ranked results against judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_and_mrr(ranked: DataFrame, wanted: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """``q, wanted, recall_<cut>..., mrr``: shares of a query's wanted ids within each cut, and the mean reciprocal rank.

    ``ranked``: q, id, pos; ``wanted``: q, id.  What is not ranked counts as missed, with reciprocal 0.
    """
    j = wanted.select("q", "id").distinct().join(ranked.select("q", "id", "pos"), ["q", "id"], "left")
    shares = [F.round(F.count_if(F.col("pos") <= c) / F.count("*"), 6).alias(f"recall_{c}") for c in cuts]
    return j.groupBy("q").agg(F.count("*").alias("wanted"), *shares, F.round(F.sum(F.coalesce(1.0 / F.col("pos"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"))


def ndcg(ranked: DataFrame, grades: DataFrame, k: int, exponential: bool = False) -> DataFrame:
    """``q, ndcg``: discounted gain of the first ``k`` against the best possible order; ungraded rows gain nothing.

    Gains are the grades, or 2^grade − 1.  A query without a positive grade has 0.
    """
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) if exponential else F.col("grade").cast("double")
    got = ranked.where(F.col("pos") <= k).join(grades, ["q", "id"]).groupBy("q").agg(F.sum(gain / F.log2(F.col("pos") + 1)).alias("got"))
    ideal = grades.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("grade"), "id"))).where(F.col("r") <= k).groupBy("q").agg(F.sum(gain / F.log2(F.col("r") + 1)).alias("ideal"))
    return ideal.join(got, "q", "left").select("q", F.round(F.when(F.col("ideal") > 0, F.coalesce("got", F.lit(0.0)) / F.col("ideal")).otherwise(0.0), 4).alias("ndcg"))


def spearman(left: DataFrame, right: DataFrame) -> DataFrame:
    """``q, n, rho``: rank correlation of two orders (q, id, pos) over the ids they share; 0 for fewer than three."""
    j = left.select("q", "id", F.col("pos").alias("a")).join(right.select("q", "id", F.col("pos").alias("b")), ["q", "id"])
    rank = lambda c: F.row_number().over(Window.partitionBy("q").orderBy(c, "id"))
    r = j.select("q", (rank("a") - rank("b")).alias("d"))
    n = F.count("*")
    return r.groupBy("q").agg(n.alias("n"), F.round(F.when(n >= 3, 1 - 6 * F.sum(F.col("d") * F.col("d")) / (n * (n * n - 1))).otherwise(0.0), 6).alias("rho"))


def jaccard(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """``q, jaccard``: overlap of the first ``k`` of two orders; queries in either count."""
    ids = lambda d, name: d.where(F.col("pos") <= k).groupBy("q").agg(F.collect_set("id").alias(name))
    j = ids(left, "a").join(ids(right, "b"), "q", "full_outer").select("q", F.coalesce("a", F.array().cast("array<bigint>")).alias("a"), F.coalesce("b", F.array().cast("array<bigint>")).alias("b"))
    return j.select("q", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


def inversions(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """``q, inversions, margin``: pairs of a bad row placed before a good one, and how far the worst good stands before the best bad.

    ``labels``: q, id, good (boolean).  Counted by running sums over the ranking, not by listing pairs.
    """
    j = ranked.join(labels, ["q", "id"])
    bad_before = F.sum(F.when(~F.col("good"), 1).otherwise(0)).over(Window.partitionBy("q").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, -1))
    w = j.withColumn("before", F.coalesce(bad_before, F.lit(0)))
    return w.groupBy("q").agg(F.coalesce(F.sum(F.when(F.col("good"), F.col("before"))), F.lit(0)).alias("inversions"), (F.min(F.when(~F.col("good"), F.col("pos"))) - F.max(F.when(F.col("good"), F.col("pos")))).alias("margin"))


def recall_by_tier(ranked: DataFrame, planted: DataFrame, cut: int) -> DataFrame:
    """``tier, planted, in_<cut>, found, mrr, median_place`` of planted items (q, id, tier) in ranked lists (q, id, pos).

    What is not ranked counts as missed, with reciprocal 0 and no place in the median.
    """
    j = planted.select("q", "id", "tier").join(ranked.select("q", "id", "pos"), ["q", "id"], "left")
    mrr = F.round(F.sum(F.coalesce(1.0 / F.col("pos"), F.lit(0.0))) / F.count("*"), 6)
    return j.groupBy("tier").agg(F.count("*").alias("planted"), F.count_if(F.col("pos") <= cut).alias(f"in_{cut}"), F.count("pos").alias("found"), mrr.alias("mrr"), F.percentile("pos", 0.5).alias("median_place"))
