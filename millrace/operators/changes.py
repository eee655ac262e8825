"""Writes to tables with a rule for each column, each a function from the current and the incoming rows to the new table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules by name: from the current value, the incoming one, and whether the row is there already.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "incoming": lambda old, new: new,
    "keep": lambda old, new: old,
    "fill": lambda old, new: F.coalesce(old, new),
    "prefer": lambda old, new: F.coalesce(new, old),
    "add": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
    "greatest": lambda old, new: F.greatest(old, new),
    "clear": lambda old, new: F.lit(None),
}


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, str | Column], insert: bool = True) -> DataFrame:
    """``current`` with the incoming rows written into it.

    A new key is inserted as it comes, unless ``insert`` is false; for a key in both each column follows its rule, by name or as
    an expression over ``c.`` (current) and ``i.`` (incoming) columns; columns without one stay.  Null keys match nothing and
    are kept.  Keys are unique within either side; columns the incoming rows lack are null in inserted ones.
    """
    cols = current.columns
    have = set(incoming.columns)
    new = incoming.select(*[c for c in cols if c in have], F.lit(True).alias("_new"))
    held = current.withColumn("_held", F.lit(True))
    j = held.alias("c").join(new.alias("i"), [F.col(f"c.{k}") == F.col(f"i.{k}") for k in keys], "full_outer" if insert else "left")
    both = F.col("c._held").isNotNull() & F.col("i._new").isNotNull()

    def value(c: str) -> Column:
        kind = current.schema[c].dataType
        old, arrived = F.col(f"c.{c}"), F.col(f"i.{c}") if c in have else F.lit(None).cast(kind)
        if c in keys:
            return F.coalesce(old, arrived)
        rule = rules.get(c, "keep")
        changed = RULES[rule](old, arrived) if isinstance(rule, str) else rule
        return F.when(both, changed.cast(kind)).when(F.col("c._held").isNotNull(), old).otherwise(arrived)

    return j.select(*[value(c).alias(c) for c in cols])


def add_unless_held(current: DataFrame, incoming: DataFrame, keys: list[str], guarded: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """``current`` and the incoming rows that break no uniqueness of ``keys``; of incoming rows alike the first by ``order``.

    With ``guarded`` only rows for which it holds must be unique (an index over part of a table): the others are all added.
    """
    g = F.coalesce(guarded, F.lit(False)) if guarded is not None else F.lit(True)
    w = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in (order or incoming.columns)])
    once = incoming.where(g).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    new = once.join(current.where(g).select(*keys), keys, "left_anti")
    out = current.unionByName(new.select(*current.columns))
    return out.unionByName(incoming.where(~g).select(*current.columns)) if guarded is not None else out


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row, and how often: what a unique index would refuse."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def set_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """``rows`` with columns set where the condition holds; an unknown condition changes nothing."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def zipped(arrays: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from arrays of equal length, with their place from 1; the shorter arrays are padded with nulls."""
    z = arrays.select(F.posexplode(F.arrays_zip(*columns)).alias("_p", "_r"))
    return z.select((F.col("_p") + 1).alias("place"), *[F.col(f"_r.{c}").alias(c) for c in columns])


def fold_health(events: DataFrame, keys: list[str], at: str, tie: str, ok: Column) -> DataFrame:
    """The state after all events of a key: ``failures`` in a row at the end, ``last_ok`` and ``last_error`` times.

    As an upsert after each event would leave it: a success sets the failures to 0, anything else adds one.  Each key's last
    success is found first and the newer events are counted, so no key is sorted whole.
    """
    good = F.coalesce(ok, F.lit(False))
    e = events.select(*keys, F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")).alias("_o"), good.alias("_ok"))
    last = e.groupBy(*keys).agg(F.max(F.when(F.col("_ok"), F.col("_o"))).alias("_last_ok"), F.max(F.when(~F.col("_ok"), F.col("_o"))).alias("_last_bad"), F.count("*").alias("events"))
    newer = e.where(~F.col("_ok")).join(last.select(*keys, "_last_ok"), keys).where(F.col("_last_ok").isNull() | (F.col("_o") > F.col("_last_ok"))).groupBy(*keys).agg(F.count("*").alias("failures"))
    return last.join(newer, keys, "left").select(*keys, "events", F.coalesce("failures", F.lit(0)).alias("failures"), F.col("_last_ok.at").alias("last_ok"), F.col("_last_bad.at").alias("last_error"))


def backoff_seconds(attempts: Column, base: int = 60, most_attempts: int = 5, parked: int = 30 * 86_400) -> Column:
    """How long a failed item waits: ``base`` times two to the attempts made, and ``parked`` once there are ``most_attempts``."""
    return F.when(attempts >= most_attempts, F.lit(parked)).otherwise((F.lit(base) * F.pow(F.lit(2), attempts)).cast("int"))


def aged_out(rows: DataFrame, at: str, now: Column, days: int) -> Column:
    """Whether a row's time lies more than ``days`` days before ``now``; a null time does not."""
    return F.coalesce(F.col(at) < now - F.make_dt_interval(F.lit(days)), F.lit(False))
