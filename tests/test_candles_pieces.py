"""Candles summed from pieces, held against one walk over each symbol's events."""

import random
from datetime import datetime, timedelta

import pytest

from tickloom.sources import candles


@pytest.fixture(scope="module")
def events(spark):
    draw = random.Random(8)
    rows = []
    for symbol in ("a", "b", None):
        for k in range(300):
            ts = datetime(2024, 1, 1) + timedelta(milliseconds=draw.choice([0, 1, 500, 1000, 60_000, 3_600_000]) + 1000 * draw.randrange(20_000))
            rows.append((len(rows), None if k % 60 == 1 else ts, symbol, None if k % 9 == 0 else draw.randrange(10_000) / 100))
    rows += [(len(rows) + k, datetime(2024, 1, 1, 0, 0, k), "late", None if k < 3 else 70.25) for k in range(6)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").cache()


def test_pieces_give_the_bars_of_one_walk(spark, events):
    events.createOrReplaceTempView("pieces_events")
    want = spark.sql("""with walk as (
        select event_type symbol, unix_date(to_date(ts)) * 24 + hour(ts) t, struct(ts, event_id) at,
        (5000000 + sum(cast(round(value * 100) - 5000 as long)) over (partition by event_type order by ts, event_id rows unbounded preceding)) / 100.0D p from pieces_events)
        select symbol, t, min_by(p, at) o, max(p) h, min(p) l, max_by(p, at) c, cast(count(*) as double) v from walk group by symbol, t""")
    got = candles.from_events(events).drop("i")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_window_over_raw_events_of_a_whole_symbol(events):
    plan = candles.from_events(events)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "step#" in x]
    assert windows and all(" t#" in x and " s#" in x for x in windows)
