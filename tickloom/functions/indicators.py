"""Technical indicators. Rolling ones are window expressions over a symbol's bars (null while warming up);
recurrences run once over each symbol's bars in a grouped map."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..sources.candles import series


def rows(n: int):
    return series().rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, first: int = 0) -> Column:
    """value once n bars from bar ``first`` on are there."""
    return F.when(F.col("i") >= n - 1 + first, value)


def typical() -> Column:
    return (F.col("h") + F.col("l") + F.col("c")) / 3.0


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers have it: infinite or no number (NaN) where b is 0."""
    zero = F.when(F.isnan(a) | (a == 0), math.nan).when(a > 0, math.inf).when(a < 0, -math.inf)
    return F.when(b != 0, a / F.when(b != 0, b)).when(b == 0, zero)


def logarithm(x: Column) -> Column:
    """ln(x) as floating-point numbers have it: no number (NaN) under 0, where Spark has null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, -math.inf).when(x < 0, math.nan)


@F.pandas_udf(DoubleType())
def _log(x: pd.Series) -> pd.Series:
    return pd.Series([math.log(v) if v > 0 else math.nan for v in x], dtype=float)


def close_logarithm(x: Column) -> Column:
    """logarithm(x), but nearer: Spark's ln misses the last bit now and then, the C library's hardly ever."""
    return F.when((x > 0) & ~F.isnan(x), _log(x)).otherwise(logarithm(x))


def close_deviation(x: Column, n: int) -> Column:
    """Population deviation of the last n values by Welford's recurrence, squares from the distances to the mean before and
    after each value: Spark's own form of it misses the last bit more often. No number (NaN) if one of them is none."""
    first = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def taken(s: Column, v: Column) -> Column:
        k = s["k"] + 1
        mean = s["mean"] + (v - s["mean"]) / k
        return F.struct(k.alias("k"), mean.alias("mean"), (s["squares"] + (v - mean) * (v - s["mean"])).alias("squares"))

    return F.aggregate(F.collect_list(x).over(rows(n)), first, taken, lambda s: F.sqrt(s["squares"] / F.when(s["k"] > 0, s["k"])))


def sma(x: Column, n: int) -> Column:
    return full(F.avg(x).over(rows(n)), n)


def wma(x: Column, n: int) -> Column:
    return full(sum(F.lag(x, n - 1 - k).over(series()) * (k + 1) for k in range(n)) / (n * (n + 1) / 2), n)


def roc(x: Column, n: int) -> Column:
    base = F.lag(x, n).over(series())
    return F.when(base != 0, (x - base) / base * 100.0)


def bollinger(x: Column, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    mid, spread = F.avg(x).over(rows(n)), F.stddev_pop(x).over(rows(n)) * k
    return full(mid + spread, n), full(mid, n), full(mid - spread, n)


def highest(n: int) -> Column:
    return F.max("h").over(rows(n))


def lowest(n: int) -> Column:
    return F.min("l").over(rows(n))


def stochastic_k(n: int = 14) -> Column:
    top, low = highest(n), lowest(n)
    return full(F.when(top == low, 50.0).otherwise((F.col("c") - low) / (top - low) * 100.0), n)


def williams_r(n: int = 14) -> Column:
    top, low = highest(n), lowest(n)
    return full(F.when(top == low, -50.0).otherwise((top - F.col("c")) / (top - low) * -100.0), n)


def vwap(n: int = 20) -> Column:
    volume = F.sum("v").over(rows(n))
    return full(F.when(volume > 0, F.sum(typical() * F.col("v")).over(rows(n)) / volume), n)


def obv(candles: DataFrame) -> DataFrame:
    """candles with obv: volume summed with the sign of each close's change, from 0."""
    step = F.coalesce(F.signum(F.col("c") - F.lag("c").over(series())) * F.col("v"), F.lit(0.0))
    return candles.withColumn("step", step).withColumn("obv", F.sum("step").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def cmf(n: int = 20) -> Column:
    span = F.col("h") - F.col("l")
    flow = F.when(span == 0, 0.0).otherwise(((F.col("c") - F.col("l")) - (F.col("h") - F.col("c"))) / span) * F.col("v")
    volume = F.sum("v").over(rows(n))
    return full(F.when(volume > 0, F.sum(flow).over(rows(n)) / volume), n)


def midpoint(n: int) -> Column:
    return full((highest(n) + lowest(n)) / 2.0, n)


def ichimoku(candles: DataFrame, a: int = 9, b: int = 26, s: int = 52, shift: int = 26) -> DataFrame:
    lines = candles.withColumns({"tenkan": midpoint(a), "kijun": midpoint(b), "slow": midpoint(s)})
    return lines.withColumns({"senkou_a": F.lag((F.col("tenkan") + F.col("kijun")) / 2.0, shift).over(series()), "senkou_b": F.lag("slow", shift).over(series()), "chikou": F.lead("c", shift).over(series())}).drop("slow")


def money_flow(candles: DataFrame, n: int = 14) -> DataFrame:
    """candles with mfi: the share of positive money flow among the last n flows."""
    tp = candles.withColumn("tp", typical())
    before = F.lag("tp").over(series())
    flow = F.col("tp") * F.col("v")
    signed = tp.withColumns({"up": F.when(F.col("tp") > before, flow).otherwise(0.0), "down": F.when(F.col("tp") < before, flow).otherwise(0.0)})
    up, down = F.sum("up").over(rows(n)), F.sum("down").over(rows(n))
    return signed.withColumn("mfi", full(F.when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + up / F.when(down != 0, down))), n, 1)).drop("tp", "up", "down")


def commodity_channel(candles: DataFrame, n: int = 20, k: float = 0.015) -> DataFrame:
    tp = candles.withColumn("tp", typical())
    window = tp.withColumns({"mean": F.avg("tp").over(rows(n)), "all": F.collect_list("tp").over(rows(n))})
    deviation = F.aggregate("all", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("mean"))) / n
    return window.withColumn("md", deviation).withColumn("cci", full(F.when(F.col("md") == 0, 0.0).otherwise((F.col("tp") - F.col("mean")) / (k * F.when(F.col("md") != 0, F.col("md")))), n)).drop("tp", "mean", "all", "md")


def anchored_vwap(candles: DataFrame, hours: int = 24) -> DataFrame:
    """candles with vwap_day: volume-weighted typical price since the anchor began."""
    day = Window.partitionBy("symbol", "anchor").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    volume = F.sum("v").over(day)
    return candles.withColumn("anchor", F.floor(F.col("t") / hours)).withColumn("vwap_day", F.when(volume > 0, F.sum(typical() * F.col("v")).over(day) / volume)).drop("anchor")


def bull_share(n: int = 30) -> Column:
    """Share of the last n bars (fewer at the start) that closed above their open, in per cent."""
    return F.avg(F.when(F.col("c") > F.col("o"), 100.0).otherwise(0.0)).over(rows(n))


def volume_slope(candles: DataFrame, n: int = 20) -> DataFrame:
    """candles with volume_slope: change of mean volume against n bars before, within -1 and 1; 0 while too short."""
    mean = candles.withColumn("mean_v", F.avg("v").over(rows(n)))
    before = F.lag("mean_v", n).over(series())
    change = (F.col("mean_v") - before) / F.when(before > 0, before)
    return mean.withColumn("volume_slope", F.when((F.col("i") >= 2 * n - 1) & (before > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), change))).otherwise(0.0)).drop("mean_v")


def return_spread(candles: DataFrame, n: int = 20) -> DataFrame:
    """candles with return_std: population deviation of n log returns, in units of the close; NaN while closes of unlike signs
    follow one another within the n."""
    returns = candles.withColumn("before", F.lag("c").over(series())).withColumn("r", close_logarithm(quotient(F.col("c"), F.col("before"))))
    return returns.withColumn("return_std", full(close_deviation(F.col("r"), n) * F.col("c"), n, 1)).drop("r", "before")


def _seeded(x: np.ndarray, n: int, first: int, gain: float) -> np.ndarray:
    """Exponential average from bar ``first`` on: the mean of n values, then steps of ``gain``."""
    out = np.full(len(x), np.nan)
    if len(x) >= first + n:
        value = out[first + n - 1] = sum(x[first : first + n]) / n
        for i in range(first + n, len(x)):
            value = out[i] = (x[i] - value) * gain + value
    return out


def _directional(h: np.ndarray, low: np.ndarray, ranges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI and ADX; bars before any range leave them empty."""
    up, down = np.diff(h, prepend=h[:1]), -np.diff(low, prepend=low[:1])
    smooth = lambda x: _seeded(x, n, 1, 1 / n)
    span = smooth(ranges)
    with np.errstate(divide="ignore", invalid="ignore"):
        plus, minus = (np.where(span > 0, 100.0 * smooth(np.where((a > b) & (a > 0), a, 0.0)) / span, np.nan) for a, b in ((up, down), (down, up)))
        both = plus + minus
        dx = np.where(both > 0, 100.0 * np.abs(plus - minus) / both, 0.0)
    known, adx = span > 0, np.full(len(h), np.nan)
    adx[known] = _seeded(dx[known], n, 0, 1 / n)
    return plus, minus, adx


def _parabolic(h: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Stop and side (1 long, -1 short) at every bar. A short run is a long run of the mirrored prices."""
    stop, side = np.full(len(h), np.nan), np.zeros(len(h), int)
    if len(h) < 2:
        return stop, side
    s = 1 if h[1] >= h[0] else -1
    stop[0], side[0] = (low[0], 1) if s > 0 else (h[0], -1)
    at, extreme, pace = s * stop[0], h[0] if s > 0 else -low[0], step
    for i in range(1, len(h)):
        best, worst = (h[i], low[i]) if s > 0 else (-low[i], -h[i])
        bound = min((low if s > 0 else -h)[max(0, i - 2) : i])
        at = min(at + pace * (extreme - at), bound)
        if worst < at:
            s, at, extreme, pace = -s, -extreme, -worst, step
        elif best > extreme:
            extreme, pace = best, min(pace + step, most)
        stop[i], side[i] = s * at, s
    return stop, side


#: Columns that ``recurrences`` adds.
RECURRENT = ("ema20", "ema50", "ema200", "dema20", "tema20", "rsi14", "atr14", "plus_di", "minus_di", "adx14", "macd", "macd_signal", "macd_hist", "psar", "psar_side")


def recurrences(candles: DataFrame) -> DataFrame:
    """candles with the columns RECURRENT, null while warming up; a symbol's bars are read once."""

    def each(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("i")
        h, low, c = (bars[x].to_numpy(float) for x in "hlc")
        ema = lambda x, n: _seeded(np.nan_to_num(x), n, 0, 2.0 / (n + 1))
        one = ema(c, 20)
        two = ema(one, 20)
        three = ema(two, 20)
        step = np.diff(c, prepend=c[:1])
        gain, loss = _seeded(np.maximum(step, 0), 14, 1, 1 / 14), _seeded(np.maximum(-step, 0), 14, 1, 1 / 14)
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(np.isnan(loss), np.nan, np.where(loss == 0, 100.0, 100.0 - 100.0 / (1.0 + gain / loss)))
        before = np.concatenate([c[:1], c[:-1]])
        ranges = np.maximum(h - low, np.maximum(np.abs(h - before), np.abs(low - before)))
        plus, minus, adx = _directional(h, low, ranges, 14)
        macd = ema(c, 12) - ema(c, 26)
        signal = ema(macd, 9)
        signal[:33] = np.nan
        stop, side = _parabolic(h, low)
        made = (one, ema(c, 50), ema(c, 200), 2 * one - two, 3 * one - 3 * two + three, rsi, _seeded(ranges, 14, 1, 1 / 14), plus, minus, adx, macd, signal, macd - signal, stop, side.astype(float))
        return bars.assign(**dict(zip(RECURRENT, made, strict=True)))

    made = candles.groupBy("symbol").applyInPandas(each, ", ".join(f"{n} {t}" for n, t in candles.dtypes) + "".join(f", {n} double" for n in RECURRENT))
    return made.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in RECURRENT})


def keltner(recurrent: DataFrame, k: float = 2.0) -> DataFrame:
    """recurrent bars with kc_up, kc_mid, kc_low: ema20 and k mean ranges around it."""
    return recurrent.withColumns({"kc_up": F.col("ema20") + F.col("atr14") * k, "kc_mid": F.col("ema20"), "kc_low": F.col("ema20") - F.col("atr14") * k})
