from __future__ import annotations

import datetime as dt
import itertools
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from millrace.operators import timestamps as T
from millrace.operators.timestamps import resolve_timestamps

VALUES = "source string, field string, record_id string, seq long, value string"
CLOCK = "source string, time_zone string, date_order string"


def us(*args, zone="UTC", micro=0):
    d = dt.datetime(*args, tzinfo=ZoneInfo(zone)) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + micro


@pytest.fixture(scope="module")
def clock(spark):
    return spark.createDataFrame([("de", "Europe/Berlin", "dmy"), ("us", "America/New_York", "mdy"), ("open", "UTC", None)], CLOCK)


def read(spark, clock, rows, blocks=3):
    df = spark.createDataFrame([(s, "f", str(i), i, v) for i, (s, v) in enumerate(rows)], VALUES)
    return {int(r.record_id): r.epoch_us for r in resolve_timestamps(df, clock, blocks).collect()}


CASES = [
    ("de", "2026-03-08T12:00:00Z", us(2026, 3, 8, 12)),
    ("de", "2026-03-08 12:00", us(2026, 3, 8, 12, zone="Europe/Berlin")),
    ("us", "2026-03-08T12:00:00.5+02:00", us(2026, 3, 8, 10, micro=500_000)),
    ("us", "2026-02-28 11:01:50-0500", us(2026, 2, 28, 16, 1, 50)),
    ("de", "2026-01-09", us(2026, 1, 9, zone="Europe/Berlin")),
    ("us", "03/04/2026", us(2026, 3, 4, zone="America/New_York")),
    ("de", "03/04/2026 10:00", us(2026, 4, 3, 10, zone="Europe/Berlin")),
    ("us", "1/12/2026 12:05 AM", us(2026, 1, 12, 0, 5, zone="America/New_York")),
    ("us", "Dec 2, 2025 12:16 PM", us(2025, 12, 2, 12, 16, zone="America/New_York")),
    ("de", "5. März 2026 20:27", us(2026, 3, 5, 20, 27, zone="Europe/Berlin")),
    ("de", "03.03.2026, 02:32 Uhr", us(2026, 3, 3, 2, 32, zone="Europe/Berlin")),
    ("us", "Wed, 15 Oct 2025 23:10:09 -0400", us(2025, 10, 16, 3, 10, 9)),
    ("us", "2025-11-02 01:35:26 PDT", us(2025, 11, 2, 8, 35, 26)),
    ("de", "2026-07-01 12:00:00 MESZ", us(2026, 7, 1, 10)),
    ("de", "1768413531", 1768413531_000_000),
    ("de", "1768413531536", 1768413531_536_000),
    ("de", "1768413531536123", 1768413531_536_123),
    ("de", "20251203T160650Z", us(2025, 12, 3, 16, 6, 50)),
    # a wall time that occurs twice is the earlier instant, a skipped one moves on by the gap
    ("de", "2025-10-26 02:30:00", us(2025, 10, 26, 0, 30)),
    ("de", "2026-03-29 02:30:00", us(2026, 3, 29, 1, 30)),
]


def test_writings(spark, clock):
    got = read(spark, clock, [(s, v) for s, v, _ in CASES])
    assert {i: got.get(i) for i in range(len(CASES))} == {i: w for i, (_, _, w) in enumerate(CASES)}


def test_what_gives_no_row(spark, clock):
    rows = ["", " ", None, "heute", "Posted 3 Days Ago", "k. A.", "-", "0000-00-00", "2026-13-40", "31/02/2026", "2026-02-30", "25:61", "2026-01-01 25:00", "2026-01-01 10:00 XYZ", "x" * 100_000]
    assert read(spark, clock, [("de", v) for v in rows]) == {}


def test_empty_tables(spark, clock):
    df = spark.createDataFrame([], VALUES)
    assert resolve_timestamps(df, clock).count() == 0


def test_source_without_clock_is_utc(spark, clock):
    assert read(spark, clock, [("?", "2026-01-01 10:00")]) == {0: us(2026, 1, 1, 10)}


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_order_is_learnt_from_the_sequence_across_blocks(spark, clock, blocks):
    days = [dt.date(2026, 1, 9) + dt.timedelta(days=n) for n in range(60)]
    rows = [("open", d.strftime("%d/%m/%Y")) for d in days]
    got = read(spark, clock, rows, blocks)
    assert [got[i] for i in range(60)] == [us(d.year, d.month, d.day) for d in days]


def test_stretches_agree_with_a_whole_path():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 14))
        rows = []
        for i in range(n):
            k = 1 if rng.random() < 0.4 else 2
            base = 1_770_000_000_000_000 + int(rng.integers(0, 90)) * 86_400_000_000
            rows.append((0, "g", "f", str(i), i, [3, 4][:k] if k == 2 else [int(rng.integers(1, 5))], [base, base + int(rng.integers(1, 200)) * 86_400_000_000][:k], [0.0, float(rng.choice([0.0, 0.3]))][:k]))
        pdf = pd.DataFrame(rows, columns=["block", "grp", "field", "record_id", "seq", "kind", "us", "cost"])
        summary = T._summarise(pdf)
        got = T._decode(pdf, T._combine(summary))
        kind, us, cost = pdf.kind.tolist(), pdf.us.tolist(), pdf.cost.tolist()
        price = lambda p: sum(cost[i][x] + (T._step(kind[i - 1][p[i - 1]], us[i - 1][p[i - 1]], kind[i][x], us[i][x]) if i else 0) for i, x in enumerate(p))
        least = min(price(p) for p in itertools.product(*[range(len(u)) for u in us]))
        picked = [us[i].index(e) for i, e in enumerate(got.epoch_us)]
        assert price(picked) == pytest.approx(least)
