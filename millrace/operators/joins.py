"""Joins Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, slot: Column | None = None) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before ``at`` within the keys; null if there is none.

    Nothing is paired, and no key is gathered: a key's time is cut into slots (days, of numbers thousands, or ``slot``, which must
    grow with ``at``), each
    slot's last value is carried over the slots between, and within a slot both sides go through one sorted union with a
    running last value.  On equal times the right row counts as before; of several the larger value; null values do not count.
    """
    cols = left.columns
    if slot is None:
        slot = F.floor(F.col(at) / 1000) if isinstance(left.schema[at].dataType, NumericType) else F.date_trunc("day", at)
    kind = right.schema[value].dataType
    r = right.where(F.col(value).isNotNull()).select(*keys, at, F.col(value).alias("_v"), slot.alias("_slot"))
    # one row a key and slot: the value with which a slot begins
    ends = r.groupBy(*keys, "_slot").agg(F.max_by("_v", F.struct(at, "_v")).alias("_end"))
    slots = left.select(*keys, slot.alias("_slot")).unionByName(ends.select(*keys, "_slot")).distinct().join(ends, [*keys, "_slot"], "left")
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slots.select(*keys, "_slot", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    u = left.select(*cols, slot.alias("_slot"), F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_side")).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_slot").orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = u.withColumn("_last", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1").join(begins, [*keys, "_slot"], "left")
    return out.withColumn(value, F.coalesce("_last", "_begin")).select(*cols, value)


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points and the half-open spans they lie in, joined by buckets of ``width``; choose it near the usual span's length."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(s, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")
