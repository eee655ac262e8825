"""Changes to immutable tables, each a function from the current and the incoming rows to the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order`` (nulls first); ties are settled by the later columns of ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of both; for keys in both the incoming row, but for the columns in ``keep``, which stay unless they were null.

    Null keys match nothing and are kept as they are.  Keys are unique within each side.
    """
    cols = current.columns
    j = current.alias("c").join(incoming.select(*cols, F.lit(True).alias("_new")).alias("i"), [F.col(f"c.{k}") == F.col(f"i.{k}") for k in keys], "full_outer")
    pick = lambda c: F.coalesce(f"c.{c}", f"i.{c}") if c in keys or c in keep else F.when(F.col("i._new"), F.col(f"i.{c}")).otherwise(F.col(f"c.{c}"))
    return j.select(*[pick(c).alias(c) for c in cols])


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and the incoming rows whose key it lacks, one for each key."""
    new = incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(new.select(*current.columns))


def close_unseen(rows: DataFrame, full_scopes: DataFrame, closed_at: str = "closed_at", last_seen: str = "last_seen_at") -> DataFrame:
    """``rows`` with those closed that a complete sweep of their scope did not see.

    ``full_scopes``: source, scope, started_at (one row each).  Rows already closed keep their time.
    """
    j = rows.join(full_scopes.select("source", "scope", F.col("started_at").alias("_s")), ["source", "scope"], "left")
    unseen = F.col(closed_at).isNull() & (F.col(last_seen) < F.col("_s"))
    return j.withColumn(closed_at, F.when(unseen, F.col("_s")).otherwise(F.col(closed_at))).drop("_s").select(*rows.columns)


def stale(rows: DataFrame, derived: DataFrame, key: str, version: str, current: int) -> DataFrame:
    """Keys whose derived row is missing or of another version than the current one."""
    have = derived.groupBy(key).agg(F.max(version).alias("_v"))
    return rows.select(key).distinct().join(have, key, "left").where(F.col("_v").isNull() | (F.col("_v") != current)).select(key, F.col("_v").alias("have_version"))


def keyset_page(rows: DataFrame, score: str, key: str, size: int, after: tuple | None = None, before: tuple | None = None) -> DataFrame:
    """One page of rows by ``score`` then ``key``, both descending, after or before a cursor; a page before comes in the same order."""
    pair = F.struct(F.col(score), F.col(key))
    at = lambda c: F.struct(*[F.lit(v).cast(rows.schema[n].dataType).alias(n) for n, v in zip((score, key), c)])
    if before is not None:
        part = rows.where(pair > at(before)).orderBy(F.asc_nulls_last(score), F.asc(key)).limit(size)
        return part.orderBy(F.desc_nulls_last(score), F.desc(key))
    if after is not None:
        rows = rows.where(pair < at(after))
    return rows.orderBy(F.desc_nulls_last(score), F.desc(key)).limit(size)
