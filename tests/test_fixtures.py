"""Bars written out by hand, and series of a stepped generator, with what has to come out of them."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import indicators as I
from tickloom.operators import chart_patterns, ledger, structure, trendlines

BARS = "symbol string, i int, t long, o double, h double, l double, c double, v double"
PATTERNS = {
    "doji": ([(100, 102, 98, 100.05)], "doji", None),
    "no doji": ([(100, 102, 98, 101)], None, "doji"),
    "hammer": ([(99.5, 100.1, 95, 100)], "hammer", None),
    "engulfing": ([(101, 101.5, 99.5, 100), (99.5, 102, 99, 102)], "bullEngulf", "bearEngulf"),
    "harami": ([(102, 103, 99, 99), (100, 100.5, 99.5, 100.4)], "bullHarami", "bearHarami"),
    "morning": ([(105, 105.5, 99, 99.5), (99.5, 100, 98.5, 99.6), (99.7, 104, 99.6, 103)], "morningStar", None),
    "evening": ([(99, 105, 99, 105), (105, 105.5, 104.5, 105.1), (105, 105.2, 99, 100)], "eveningStar", None),
    "all": ([(101, 101.5, 99.5, 100), (99.5, 102, 99, 102), (102, 102.4, 100, 100.05)], "bullEngulf", None),
}


def series(symbol, n, seed, value):
    """n bars (o, h, l, c, v) by ``value`` of a bar's number and a generator that steps at every call."""
    rows = []

    def draw():
        nonlocal seed
        seed = (seed * 9301 + 49297) % 233280
        return seed / 233280

    for i in range(n):
        rows.append((symbol, i, i, *map(float, value(i, draw))))
    return rows


def drifting(i, r):
    c = 100 + 0.4 * min(i, 200 - i) + 3 * math.sin(i / 8) + (r() - 0.5) * 0.5
    h, low = c + 0.6 * r(), c - 0.6 * r()
    return c + (r() - 0.5) * 0.3, h, low, c, 1000 + 500 * r()


def waving(i, r):
    c = 100 + 6 * math.sin(i / 5) + (r() - 0.5) * 0.4
    return c - 0.05, c + 0.6 * r(), c - 0.6 * r(), c, 1000


def indicated(i, r):
    c = 100 + 5 * math.sin(i / 10) + 0.05 * i + (r() - 0.5) * 0.6
    return c, c + abs(r()) * 0.4, c - abs(r()) * 0.4, c, 1000 + 500 * r()


@pytest.fixture(scope="module")
def made(spark):
    rows = series("drift", 200, 7, drifting) + series("wave", 200, 13, waving) + series("line", 200, 1, indicated)
    return spark.createDataFrame(rows, BARS).cache()


def test_candles_by_hand(spark):
    rows = [(name, i, i, *map(float, bar), 1.0) for name, (bars, _, _) in PATTERNS.items() for i, bar in enumerate(bars)]
    found = {}
    for r in structure.candle_patterns(spark.createDataFrame(rows, BARS)).collect():
        found.setdefault(r["symbol"], set()).update(r["patterns"].split(","))
    for name, (_, wanted, unwanted) in PATTERNS.items():
        assert wanted is None or wanted in found[name], name
        assert unwanted is None or unwanted not in found.get(name, ()), name


def test_gap_is_found(spark):
    bars = [["g", i, 1000 + 60 * i, 100.0 + i, 100.2 + i, 99.8 + i, 100.0 + i, 1.0] for i in range(30)]
    found = structure.gaps(spark.createDataFrame(bars, BARS)).collect()
    assert len(found) == 28 and {r["dir"] for r in found} == {"bull"} and all(r["mitigated_at"] is None for r in found)


def test_pivots_trend_levels_and_zone(made):
    bars = made.where("symbol = 'drift'")
    points = structure.pivots(bars).collect()
    assert len(points) > 5 and {p["kind"] for p in points} == {"high", "low"}
    assert structure.trend(bars).first()["trend"] in ("up", "down", "range")
    strong = structure.strongest(structure.levels(bars)).orderBy("place").collect()
    assert [x["strength"] for x in strong] == sorted((x["strength"] for x in strong), reverse=True) and len(strong) <= 20
    assert structure.equal_levels(bars, bars.select("symbol", F.lit(0.0).alias("tolerance")).distinct()).collect() == []
    zone = structure.premium_discount(bars).first()
    assert zone["high"] > zone["low"] and zone["zone"] in ("discount", "equilibrium", "premium", "outside")


def test_line_through_three_points(spark):
    points = spark.createDataFrame([("l", k, "high", float(k)) for k in range(3)], "symbol string, i int, kind string, price double")
    line = trendlines.lines(points, spark.createDataFrame([("l", 0.1)], "symbol string, tolerance double")).first()
    assert line["slope"] == pytest.approx(1) and line["intercept"] == pytest.approx(0) and line["r2"] > 0.99 and line["touches"] == 3


def test_chart_patterns_measure_in_mean_ranges(made):
    """Heights and breaks follow the mean range given, and half a percent of the close only without one."""
    bars = I.recurrences(made.where("symbol = 'wave'"))
    found = {r["name"] for r in chart_patterns.chart_patterns(bars).collect()}
    wide = {(r["name"], r["broken"]) for r in chart_patterns.chart_patterns(bars.withColumn("atr14", F.lit(1e6))).collect()}
    none = {(r["name"], r["target"]) for r in chart_patterns.chart_patterns(bars.withColumn("atr14", F.lit(None).cast("double"))).collect()}
    half = {(r["name"], r["target"]) for r in chart_patterns.chart_patterns(bars.withColumn("atr14", 0.005 * F.last("c").over(structure.series().rowsBetween(0, 1 << 30)))).collect()}
    assert found and not any(broken for _, broken in wide) and none == half


def test_indicators_stay_in_their_ranges(made):
    bars = I.recurrences(made.where("symbol = 'line'")).withColumns({"sma20": I.sma(F.col("c"), 20), "k": I.stochastic_k(), "wr": I.williams_r(), "cmf": I.cmf()})
    rows = I.money_flow(I.obv(bars)).orderBy("i").collect()
    assert rows[18]["sma20"] is None and rows[19]["sma20"] is not None and rows[0]["obv"] == 0
    for r in rows[40:]:
        assert 0 <= r["rsi14"] <= 100 and 0 <= r["k"] <= 100 and 0 <= r["mfi"] <= 100 and -1 <= r["cmf"] <= 1 and -100 <= r["wr"] <= 0 and 0 <= r["adx14"] <= 100 and r["psar_side"] in (-1, 1)


def test_value_area_of_even_rows(spark):
    rows = spark.createDataFrame([("p", k, 10.0) for k in range(10)], "symbol string, bucket int, volume double")
    area = structure.value_area(rows).first()
    assert area["covered"] >= 70 and area["poc"] == 0


def test_letters(spark):
    numbers = [(0, "A"), (25, "Z"), (26, "AA"), (27, "AB"), (701, "ZZ"), (702, "AAA"), (18277, "ZZZ"), (18278, "AAAA"), (-1, "")]
    df = spark.createDataFrame([(n, s) for n, s in numbers], "n int, want string").withColumn("got", ledger.letters(F.col("n")))
    assert all(r["got"] == r["want"] for r in df.collect())
    tagged = df.where("n = 27").select(ledger.letters(F.col("n"), F.lit("London")).alias("x"), ledger.letters(F.col("n"), F.lit(None).cast("string")).alias("y")).first()
    assert tuple(tagged) == ("lAB", "AB")
