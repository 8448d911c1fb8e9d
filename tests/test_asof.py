"""What was known at a bar: equal to the newest state of the bars up to it; and a sequence of four stages made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.plans import asof, backtest

BARS = "symbol string, i int, t long, o double, h double, l double, c double, v double"


def walk(symbol, n, seed):
    draw, c, rows = random.Random(seed), 100.0, []
    for i in range(n):
        o, c = c, round(c + draw.gauss(0, 1) * (0.2 + 0.3 * (i // 40 % 3)), 2)
        rows.append((symbol, i, 400_000 + i, o, round(max(o, c) + abs(draw.gauss(0, 0.3)), 2), round(min(o, c) - abs(draw.gauss(0, 0.3)), 2), c, float(draw.randint(1, 9))))
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk("a", 260, 1) + walk("b", 240, 2), BARS).cache()


def rounded(row):
    return {k: round(v, 6) if isinstance(v, float) else v for k, v in row.asDict().items()}


def test_equals_the_newest_state_of_each_prefix(spark, bars):
    moments = [3, 17, 60, 111, 150, 151, 152, 153, 210]
    got = {(r["symbol"], r["i"]): rounded(r) for r in asof.states(bars, lambda rows: rows.where(F.col("i").isin(moments))).collect()}
    assert len(got) == 2 * len(moments)
    prefixes = bars.join(spark.createDataFrame([(j,) for j in moments], "j int"), F.col("i") <= F.col("j")).withColumn("symbol", F.concat_ws("@", "symbol", "j")).drop("j")
    for r in asof.newest(prefixes).collect():
        symbol, j = r["symbol"].split("@")
        want, own = rounded(r) | {"symbol": symbol}, got[symbol, int(j)]
        assert {k: (own[k], v) for k, v in want.items() if own[k] != v} == {}, r["symbol"]


def quiet():
    """Swings that shrink bar by bar; then a small break upwards, a sweep, and a fall with a gap and more volume."""
    rows, c = [], 100.0
    for i in range(120):
        o, c = c, 100 + (0.2 + 0.8 * 0.97**i) * (0, 1, 0, -1)[i % 4]
        rows.append((o, max(o, c) + 0.02, min(o, c) - 0.02, c, 1.0))
    level = rows[117][1]
    brk = level + 0.05
    rows.append((c, brk + 0.01, c - 0.02, brk, 1.0))
    body = 0.07
    o = level + 0.02
    rows.append((o, o + 2 * body, level - 0.1, o - body, 1.0))
    rows.append((level - 0.1, level - 0.08, level - 0.3, level - 0.25, 1.0))
    rows.append((level - 0.55, level - 0.5, level - 1.0, level - 0.9, 2.0))
    return [("q", i, 400_000 + i, *r) for i, r in enumerate(rows)]


def test_four_stages(spark):
    rows = quiet()
    found = {r["i"]: r for r in asof.states(spark.createDataFrame(rows, BARS), lambda r: r.where("i >= 119")).collect()}
    assert [found[i]["cisd_signal"] for i in (119, 120, 121, 122)] == [0.0] * 4
    last = found[123]
    wick, loud = min(1, (2 - 1.5) / 2), min(1, (2 / (21 / 20) - 1.5) / 2)
    assert last["cisd_i"] == 123 and last["cisd_age"] == 0
    assert last["cisd_signal"] == pytest.approx(-(0.5 + 0.25 + 0.25 * (wick + loud) / 2))
    assert last["cisd_confidence"] == pytest.approx(0.45 + 0.25 + 0.15 * wick + 0.15 * loud)


def test_walk_needs_enough_bars(bars):
    made = backtest.walk_forward(bars, most=300, warmup=230, least=250).collect()
    assert {r["symbol"] for r in made} == {"a"} and sorted(r["i"] for r in made) == list(range(230, 259))
    assert all(r["hit"] == ((r["direction"], r["realized"]) in (("long", "up"), ("short", "down"))) for r in made)
