"""Streaks, islands, spines and trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(events: DataFrame, keys: list[str], at: str, tie: str, flag: Column) -> DataFrame:
    """For each key how many of its newest events in a row have ``flag``, how many at all, and when the last was.

    The newest event without the flag is found by aggregation and those after it are counted, so no key is sorted in one task.
    Null keys are keys of their own.
    """
    e = events.select(*keys, F.struct(F.col(at).alias("a"), F.col(tie).alias("t")).alias("_o"), F.unix_micros(at).alias("_us"), F.coalesce(flag, F.lit(False)).alias("_f"))
    last = e.groupBy(*keys).agg(F.max(F.when(~F.col("_f"), F.col("_o"))).alias("_other"), F.count_if("_f").alias("flagged"), F.max(F.when(F.col("_f"), F.col("_us"))).alias("last_us"))
    right = last.select(*[F.col(k).alias(f"_{k}") for k in keys], "_other")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    newer = e.where("_f").join(right, same).where(F.col("_other").isNull() | (F.col("_o") > F.col("_other"))).groupBy(*keys).agg(F.count("*").alias("_n"))
    newer = newer.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n")
    return last.join(newer, same, "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("streak"), "flagged", "last_us")


def islands(events: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Runs of consecutive rows with ``flag``: key, island, rows, first and last place in the key's order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = events.withColumn("_n", F.row_number().over(w)).where(F.coalesce(flag, F.lit(False)))
    n = n.withColumn("_g", F.col("_n") - F.row_number().over(w))
    out = n.groupBy(*keys, "_g").agg(F.count("*").alias("rows"), F.min("_n").alias("first"), F.max("_n").alias("last"))
    return out.withColumn("island", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).drop("_g")


def daily_series(events: DataFrame, day: Column, measures: dict[str, Column], first: str, last: str, trailing: int = 7) -> DataFrame:
    """One row for each day from ``first`` to ``last``: the measures, null on days without events, and their trailing sums."""
    per_day = events.groupBy(day.alias("day")).agg(*[m.alias(n) for n, m in measures.items()])
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    w = Window.orderBy("day").rowsBetween(1 - trailing, 0)
    # the spine is as long as the calendar, so one task is enough
    out = spine.join(per_day, "day", "left")
    return out.select("day", *measures, *[F.sum(n).over(w).alias(f"{n}_trailing") for n in measures])


def median_of_last(events: DataFrame, keys: list[str], order: str, tie: str, value: Column, n: int) -> DataFrame:
    """The exact median of each key's last ``n`` values."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return events.withColumn("_v", value).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).groupBy(*keys).agg(F.percentile("_v", 0.5).alias("median"))


def against_previous(events: DataFrame, day: Column, value: Column, days: int = 7) -> DataFrame:
    """``day, n, usual``: a daily value beside the exact median of the ``days`` days before it; null without any."""
    w = Window.orderBy("day").rowsBetween(-days, -1)
    # one row a day, so one task is enough
    return events.groupBy(day.alias("day")).agg(value.alias("n")).withColumn("usual", F.percentile("n", 0.5).over(w))


def set_changes(members: DataFrame, day: str, item: str) -> DataFrame:
    """``day, added, removed``: how many items a day has that the day before in the data had not, and the reverse.

    Counted from each item's own days, so no day's set is gathered.
    """
    d = members.select(day, item).distinct()
    days = d.select(day).distinct().withColumn("_k", F.row_number().over(Window.orderBy(day)))
    k = d.join(days, day)
    w = Window.partitionBy(item).orderBy("_k")
    m = k.withColumn("_new", ~(F.lag("_k").over(w) == F.col("_k") - 1) | F.lag("_k").over(w).isNull()).withColumn("_gone", ~(F.lead("_k").over(w) == F.col("_k") + 1) | F.lead("_k").over(w).isNull())
    gone = m.where("_gone").groupBy((F.col("_k") + 1).alias("_k")).agg(F.count("*").alias("removed"))
    new = m.where("_new").groupBy("_k").agg(F.count("*").alias("added"))
    out = days.where("_k > 1").join(new, "_k", "left").join(gone, "_k", "left")
    return out.select(day, F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


def spans(events: DataFrame, keys: list[str], at: str, tie: str, name: str, end: Column) -> DataFrame:
    """Each event as a stage that lasts until the key's next one, the last until ``end``; ``seconds`` of each."""
    nxt = F.lead(F.unix_micros(at)).over(Window.partitionBy(*keys).orderBy(at, tie))
    return events.select(*keys, name, ((F.coalesce(nxt, F.unix_micros(end)) - F.unix_micros(at)) / 1e6).alias("seconds"))


def until_weak(scores: DataFrame, keys: list[str], place: str, score: str, block: int, least: float, weak: int = 2) -> DataFrame:
    """Rows of a ranking up to and with the block that ends ``weak`` blocks in a row whose median score is below ``least``.

    Blocks are runs of ``block`` places; a block without scores is weak.
    """
    b = scores.withColumn("_b", F.floor((F.col(place) - 1) / block))
    med = b.groupBy(*keys, "_b").agg(F.percentile(score, 0.5).alias("_m")).withColumn("_w", F.coalesce(F.col("_m") < least, F.lit(True)))
    w = Window.partitionBy(*keys).orderBy("_b")
    run = F.sum(F.col("_w").cast("int")).over(w.rowsBetween(1 - weak, 0))
    stop = med.withColumn("_r", run).where((F.col("_r") == weak)).groupBy(*keys).agg(F.min("_b").alias("_stop"))
    return b.join(stop, keys, "left").where(F.col("_stop").isNull() | (F.col("_b") <= F.col("_stop"))).drop("_b", "_stop")
