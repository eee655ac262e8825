"""Frozen days of append-only tables, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_counts(rows: DataFrame, at: str) -> DataFrame:
    """``day, rows``: rows for each UTC day; rows without a time are left out."""
    return rows.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("rows"))


def frozen_days(rows: DataFrame, at: str, today: str, lag: int, existing: DataFrame | None = None) -> DataFrame:
    """Days that can change no more (before ``today`` by more than ``lag`` days), without those already archived."""
    days = day_counts(rows, at).where(F.col("day") <= F.date_sub(F.to_date(F.lit(today)), 1 + lag))
    return days.join(existing.select("day"), "day", "left_anti") if existing is not None else days


def export_days(rows: DataFrame, at: str, days: DataFrame, path: str) -> None:
    """Append the given days to a table of one folder for each day, compressed; an empty day writes nothing."""
    rows.withColumn("day", F.to_date(at)).join(days.select("day"), "day", "left_semi").write.mode("append").partitionBy("day").option("compression", "zstd").parquet(path)


def day_page(rows: DataFrame, at: str, day: str, key: str, after: int | None, size: int) -> DataFrame:
    """A page of one UTC day's rows (from its midnight, the next one excluded) by ``key``, after a key if one is given."""
    start = F.to_timestamp(F.lit(day))
    page = rows.where((F.col(at) >= start) & (F.col(at) < start + F.make_dt_interval(F.lit(1))))
    return (page.where(F.col(key) > after) if after is not None else page).orderBy(key).limit(size)
