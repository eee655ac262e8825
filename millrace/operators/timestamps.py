"""Timestamps in mixed writings and zones, resolved to one instant each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their minutes from UTC.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

# Beginnings of month names, as far as needed to tell them apart, in de, en, fr, nl, es and it.
MONTHS = {
    "jan": 1, "jän": 1, "ene": 1, "gen": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "mär": 3, "maa": 3, "mrt": 3, "apr": 4, "avr": 4, "abr": 4,
    "mai": 5, "may": 5, "mei": 5, "mag": 5, "jun": 6, "jui": 6, "giu": 6, "jul": 7, "lug": 7, "aug": 8, "aoû": 8, "aou": 8, "ago": 8,
    "sep": 9, "set": 9, "okt": 10, "oct": 10, "ott": 10, "nov": 11, "dez": 12, "dec": 12, "déc": 12, "dic": 12,
}

_ZONE = r"(Z|[+-]\d{2}:?\d{2}|[A-Za-z]{2,5})?"
_TIME = r"(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*([AaPp][Mm])?\s*(?:Uhr|h)?\s*" + _ZONE
EPOCH = r"^(\d{10}|\d{13}|\d{16})$"
ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?\s*" + _ZONE + "$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2}))?" + _ZONE + "$"
FIGURES = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})" + _TIME + "$"
DAY_MONTH = r"^(?:\p{L}{2,4}\.?,\s*)?(\d{1,2})\.?\s+(\p{L}{3,10})\.?\s+(\d{4})" + _TIME + "$"
MONTH_DAY = r"^(\p{L}{3,10})\.?\s+(\d{1,2}),?\s+(\d{4})" + _TIME + "$"

#: Kinds of interpretation; 3 and 4 read the same figures in the two orders.
KINDS = ("epoch", "iso", "compact", "dmy", "mdy", "day month", "month day")
#: Costs: reading against the source's declared order, switching between orders, switching between kinds, most for a jump back.
AGAINST, ORDER_SWITCH, KIND_SWITCH, BACK = 20.0, 1.0, 0.1, 2.0


def _micros(kind: Column, text: Column, clock_zone: Column) -> Column:
    """UTC microseconds of a writing laid out as y|mo|d|h|mi|s|frac|half|zone; null if there is no such date, time or zone.

    Without a zone the clock's holds: a wall time that occurs twice is the earlier instant, a skipped one moves on by the gap.
    """
    part = F.split(text, r"\|", -1)
    num = lambda c: F.coalesce(F.when(c != "", c).try_cast("int"), F.lit(0))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.coalesce(part[1].try_cast("int"), F.try_element_at(months, F.lower(F.substring(part[1], 1, 3))))
    half, h, zone = F.upper(part[7]), num(part[3]), F.upper(part[8])
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "PM", 12).otherwise(0))
    day = F.unix_date(F.try_make_timestamp_ntz(part[0].try_cast("int"), month, part[2].try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    frac = F.rpad(F.substring(part[6], 1, 6), 6, "0").try_cast("int")
    inside = hour.between(0, 23) & num(part[4]).between(0, 59) & num(part[5]).between(0, 59)
    wall = F.when(inside, (day.cast("bigint") * 86400 + hour * 3600 + num(part[4]) * 60 + num(part[5])) * 1_000_000 + F.coalesce(frac, F.lit(0)))
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    offset = F.when(zone.rlike(r"^[+-]"), sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")))
    offset = F.coalesce(offset, F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), zone))
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), clock_zone))
    digits = part[0].try_cast("bigint")
    epoch = F.when(F.length(part[0]) == 10, digits * 1_000_000).when(F.length(part[0]) == 13, digits * 1000).otherwise(digits)
    return F.when(kind == 0, epoch).when(zone == "", local).otherwise(wall - offset.cast("bigint") * 60_000_000)


def interpretations(value: Column, zone: Column, order: Column) -> Column:
    """All valid readings of ``value``: array of (kind, us, cost); empty for null, blank, relative or impossible values."""
    v = F.regexp_replace(value, r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    layouts = (
        (EPOCH, "$1||||||||"), (ISO, "$1|$2|$3|$4|$5|$6|$7||$8"), (COMPACT, "$1|$2|$3|$4|$5|$6|||$7"),
        (FIGURES, "$3|$2|$1|$4|$5|$6||$7|$8"), (FIGURES, "$3|$1|$2|$4|$5|$6||$7|$8"),
        (DAY_MONTH, "$3|$2|$1|$4|$5|$6||$7|$8"), (MONTH_DAY, "$3|$1|$2|$4|$5|$6||$7|$8"),
    )
    every = F.array(*[F.when(v.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_replace(v, p, to).alias("text"))) for k, (p, to) in enumerate(layouts)])
    against = lambda k: F.when(((k == 3) & (order == "mdy")) | ((k == 4) & (order == "dmy")), AGAINST).otherwise(0.0)
    read = F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), _micros(x["kind"], x["text"], zone).alias("us"), against(x["kind"]).alias("cost")))
    return F.filter(read, lambda x: x["us"].isNotNull())


def _step(kind_a, us_a, kind_b, us_b) -> float:
    cost = 0.0
    if kind_a != kind_b:
        cost = ORDER_SWITCH if {kind_a, kind_b} == {3, 4} else KIND_SWITCH
    if us_b < us_a:
        cost += min(BACK, 0.5 * math.log1p((us_a - us_b) / 2_592_000_000_000))
    return cost


def _runs(groups: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.array([], int)
    return list(zip(edge.tolist(), [*edge[1:].tolist(), len(groups)]))


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["grp", "seq", "record_id"], kind="stable", na_position="first", ignore_index=True)


def _matrix(kind: list, us: list, cost: list, lo: int, hi: int) -> np.ndarray:
    """Costs of the cheapest path from every reading of row ``lo`` to every one of row ``hi``, both included."""
    best = [[cost[lo][i] if i == j else math.inf for j in range(len(us[lo]))] for i in range(len(us[lo]))]
    for r in range(lo + 1, hi + 1):
        steps = [[_step(kind[r - 1][i], us[r - 1][i], kind[r][j], us[r][j]) + cost[r][j] for i in range(len(us[r - 1]))] for j in range(len(us[r]))]
        best = [[min(x + y for x, y in zip(row, s)) for s in steps] for row in best]
    return np.array(best)


def _summarise(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each run of a group in the block: the cheapest path from every reading of its first record to every one of its last.

    Every path passes through the single reading of a record that has one, so only what stands before the first and after
    the last such record is worked out; what is between them adds the same to all paths and is left out.
    """
    pdf, out = _sorted(pdf), []
    kind, us, cost = pdf.kind.tolist(), pdf.us.tolist(), pdf.cost.tolist()
    single = pdf.us.map(len).to_numpy() == 1
    for a, b in _runs(pdf.grp.to_numpy()):
        at = a + np.flatnonzero(single[a:b])
        best = _matrix(kind, us, cost, a, at[0]) + _matrix(kind, us, cost, at[-1], b - 1) if len(at) else _matrix(kind, us, cost, a, b - 1)
        out.append((int(pdf.block[a]), pdf.grp[a], [int(x) for x in kind[a]], [int(x) for x in us[a]], [int(x) for x in kind[b - 1]], [int(x) for x in us[b - 1]], [float(x) for x in best.ravel()]))
    return pd.DataFrame(out, columns=["block", "grp", "kind_a", "us_a", "kind_b", "us_b", "best"])


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """The best path over a group's runs: which readings each run begins and ends with."""
    runs = pdf.sort_values("block").to_dict("records")
    back, score = [], None
    for k, r in enumerate(runs):
        na, nb = len(r["us_a"]), len(r["us_b"])
        m = np.asarray(r["best"], float).reshape(na, nb)
        if score is None:
            enter, frm = np.zeros(na), [None] * na
        else:
            p = runs[k - 1]
            t = np.array([[score[i] + _step(p["kind_b"][i], p["us_b"][i], r["kind_a"][j], r["us_a"][j]) for i in range(len(score))] for j in range(na)])
            enter, frm = t.min(1), t.argmin(1).tolist()
        total = enter[:, None] + m
        score = total.min(0)
        back.append((frm, total.argmin(0).tolist()))
    out, last = [], int(np.argmin(score))
    for k in range(len(runs) - 1, -1, -1):
        frm, first_of = back[k]
        first = first_of[last]
        out.append((int(runs[k]["block"]), runs[k]["grp"], first, last))
        last = frm[first]
    return pd.DataFrame(out, columns=["block", "grp", "first", "last"])


def _path(kind: list, us: list, cost: list, lo: int, hi: int, first: int, last: int) -> list[int]:
    """The cheapest path from reading ``first`` of row ``lo`` to ``last`` of row ``hi``: the readings of the rows between."""
    score, back = [0.0 if i == first else math.inf for i in range(len(us[lo]))], []
    for r in range(lo + 1, hi + 1):
        nxt, frm = [], []
        for j in range(len(us[r])):
            s, i = min((score[i] + _step(kind[r - 1][i], us[r - 1][i], kind[r][j], us[r][j]) + cost[r][j], i) for i in range(len(score)))
            nxt.append(s)
            frm.append(i)
        score = nxt
        back.append(frm)
    at, picks = last, []
    for frm in reversed(back[1:]):
        at = frm[at]
        picks.append(at)
    # the first step back leads from row hi to row hi - 1
    return picks[::-1]


def _decode(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The path inside a block whose first and last readings are given; only records with several readings take part."""
    pdf = _sorted(pdf)
    kind, us, cost = pdf.kind.tolist(), pdf.us.tolist(), pdf.cost.tolist()
    fixed = {g: (f, l) for g, f, l in zip(ends.grp, ends["first"], ends["last"])}
    single = pdf.us.map(len).to_numpy() == 1
    pick = np.zeros(len(pdf), int)
    for a, b in _runs(pdf.grp.to_numpy()):
        first, last = fixed[pdf.grp[a]]
        pick[a], pick[b - 1] = first, last
        known = single[a:b].copy()
        known[[0, -1]] = True
        at = a + np.flatnonzero(known)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            if hi > lo + 1:
                pick[lo + 1 : hi] = _path(kind, us, cost, lo, hi, int(pick[lo]), int(pick[hi]))
    rows = range(len(pdf))
    return pd.DataFrame({"record_id": pdf.record_id, "field": pdf.field, "epoch_us": [int(us[r][pick[r]]) for r in rows], "reading": [KINDS[int(kind[r][pick[r]])] for r in rows], "readings": [len(us[r]) for r in rows]})


def resolve_timestamps(values: DataFrame, clock: DataFrame, blocks: int | None = None, block_rows: int = 200_000) -> DataFrame:
    """``record_id, field, epoch_us, reading, readings`` for every value that states an instant or a day.

    ``values``: source, field, record_id (text), seq (order within the source; nulls come first), value.  ``clock``: source,
    time_zone, date_order; a source without a row counts as UTC with no declared order.  All readings of a value are
    generated; of several, the cheapest path over the source's records is taken, where reading against the declared
    order, switching formats and jumping back in time cost.

    The path is found in blocks: a source's order is cut into ranges, each block gives the costs from its first to its
    last record's readings, the blocks' few rows are combined, and each block is decoded between fixed ends.  So no source
    is gathered in one task; blocks hold about ``block_rows`` records, and their number grows with the data.  Null, blank, relative and impossible values give no row.
    """
    from ..io import cut

    spark = values.sparkSession
    clock = clock.select("source", "time_zone", "date_order").dropDuplicates(["source"])
    v = values.join(clock, "source", "left")
    got = interpretations(F.col("value"), F.coalesce("time_zone", F.lit("UTC")), F.col("date_order"))
    v = v.select(F.concat_ws("/", F.coalesce("source", F.lit("")), "field").alias("grp"), "field", "record_id", F.col("seq").cast("bigint").alias("seq"), got.alias("c")).where(F.size("c") > 0)
    # read once: the ranges are found from a sample of what is written here
    v = cut(v.select("grp", "field", "record_id", "seq", F.col("c.kind").alias("kind"), F.col("c.us").alias("us"), F.col("c.cost").alias("cost")))
    n = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-v.count() // block_rows))
    v = cut(v.repartitionByRange(n, "grp", "seq", "record_id").withColumn("block", F.spark_partition_id()))
    runs = v.groupBy("block").applyInPandas(_summarise, "block int, grp string, kind_a array<int>, us_a array<bigint>, kind_b array<int>, us_b array<bigint>, best array<double>")
    ends = runs.groupBy("grp").applyInPandas(_combine, "block int, grp string, first int, last int")
    return v.groupBy("block").cogroup(ends.groupBy("block")).applyInPandas(_decode, "record_id string, field string, epoch_us bigint, reading string, readings int")


def posting_stamps(jobs: DataFrame, needles: DataFrame) -> DataFrame:
    """The stamps of postings and of evaluation items as ``values`` for :func:`resolve_timestamps`."""
    order = F.unix_micros("first_seen_at")
    of = lambda c: jobs.select("source", F.lit(c).alias("field"), F.col("id").cast("string").alias("record_id"), order.alias("seq"), F.col(c).alias("value"))
    items = needles.select("source", F.lit("needle_listing").alias("field"), F.col("id").alias("record_id"), F.lit(None).cast("bigint").alias("seq"), F.get_json_object("listing", "$.datumErsteVeroeffentlichung").alias("value"))
    return of("posted_at").unionByName(of("updated_at")).unionByName(items)
