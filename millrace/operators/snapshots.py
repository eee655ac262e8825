"""What changed between full snapshots of a board."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOLATILE = ("postedOn", "views", "trace_id")


def canonical_json(text: str, volatile: Iterable[str] = VOLATILE) -> str:
    """``text`` in one writing: members sorted, volatile and null ones left out, numbers by value.

    Text that is not JSON stands for itself, without outer blanks.
    """
    drop = frozenset(volatile)

    def number(s: str):
        d = Decimal(s)
        if not d.is_finite() or abs(d.adjusted()) > 400:
            return "\0n" + str(d)
        return int(d) if d == d.to_integral_value() else "\0n" + str(d.normalize())

    def members(pairs):
        return {k: v for k, v in dict(pairs).items() if v is not None and k not in drop}

    try:
        return json.dumps(json.loads(text, parse_float=number, parse_constant=lambda s: "\0n" + s, object_pairs_hook=members), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return "\0t" + text.strip()


def canonical_hash(payload: Column, volatile: Iterable[str] = VOLATILE) -> Column:
    """128 bits of the canonical writing; a null payload gives null."""
    drop = tuple(volatile)

    @F.pandas_udf("binary")
    def digest(col: pd.Series) -> pd.Series:
        return col.map(lambda t: None if t is None else hashlib.blake2b(canonical_json(t, drop).encode("utf-8", "surrogatepass"), digest_size=16).digest())

    return digest(payload)


def _key(col: str) -> Column:
    return F.lower(F.regexp_replace(F.col(col), r"^[\s ​﻿]+|[\s ​﻿]+$", ""))


def snapshot_sequence(sweeps: DataFrame) -> DataFrame:
    """The complete sweeps of each board in order: ``sweep_id, source, scope, seq`` from 1, and ``last_seq``."""
    board = Window.partitionBy("source", "scope")
    full = sweeps.where(F.coalesce("complete", F.lit(False)) & F.col("scope").isNotNull())
    return full.select(F.col("id").alias("sweep_id"), "source", "scope", F.row_number().over(board.orderBy("started_at", "id")).alias("seq"), F.count("*").over(board).cast("int").alias("last_seq"))


def snapshot_rows(documents: DataFrame, sequence: DataFrame) -> DataFrame:
    """One row per board, sequence number and posting: its ``hash``.

    Within a sweep the latest ``fetched_at`` holds (on a tie the larger ``id``).  Rows without a posting id are left out.
    Payloads are hashed before the shuffle, so no payload travels.
    """
    docs = documents.where(F.col("kind").eqNullSafe("listing") & F.col("external_id").isNotNull()).select("id", "sweep_id", "fetched_at", _key("external_id").alias("ext"), "payload")
    rows = docs.join(sequence, "sweep_id").select("source", "scope", "seq", "ext", "id", "fetched_at", canonical_hash(F.col("payload")).alias("h"))
    return rows.groupBy("source", "scope", "seq", "ext").agg(F.max_by(F.struct(F.coalesce("h", F.lit(b"")).alias("h")), F.struct("fetched_at", "id")).getField("h").alias("hash"))


def snapshot_changes(documents: DataFrame, sweeps: DataFrame, jobs: DataFrame) -> DataFrame:
    """``sweep_id, external_id, change``: added, removed or changed between consecutive complete sweeps of a board,
    and ``closed_at_wrong`` against the last one.

    A full outer join on (board, sequence, posting) compares canonical hashes; a board's rows spread by posting, so a
    large board is no hot key.  A complete sweep without rows removes everything; a board's first gives no changes.
    Sweep or document tables may be empty.
    """
    from ..io import cut

    sequence = snapshot_sequence(sweeps)
    # hashed once, read three times
    rows = cut(snapshot_rows(documents, sequence))
    cur = rows.where(F.col("seq") > 1).withColumnRenamed("hash", "now")
    prev = rows.withColumn("seq", F.col("seq") + 1).withColumnRenamed("hash", "before")
    both = cur.join(prev, ["source", "scope", "seq", "ext"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    # The last snapshot's rows, moved on by one, have no sweep and drop out here.
    changes = both.withColumn("change", change).where("change IS NOT NULL").join(sequence, ["source", "scope", "seq"]).select("sweep_id", F.col("ext").alias("external_id"), "change")
    seen = rows.groupBy("source", "scope", "ext").agg(F.max("seq").alias("seen_last"))
    closed = jobs.where("external_id IS NOT NULL").select("source", "scope", _key("external_id").alias("ext"), "closed_at")
    last = sequence.where("seq = last_seq")
    wrong = seen.join(closed, ["source", "scope", "ext"]).join(last, ["source", "scope"]).where((F.col("seen_last") == F.col("last_seq")) == F.col("closed_at").isNotNull())
    return changes.unionByName(wrong.select("sweep_id", F.col("ext").alias("external_id"), F.lit("closed_at_wrong").alias("change"))).distinct()
