"""Prices as ticks come in: each against the last closed bar's close, as a keyed state in a stream and by a window over a
table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

UPDATES = "symbol string, at timestamp, closed boolean, price double, change double, change_pct double, dir string"


def _told(price: Column, before: Column) -> dict[str, Column]:
    change = F.coalesce(price - before, F.lit(0.0))
    return {"change": change, "change_pct": F.coalesce(F.when(before != 0, change / F.when(before != 0, before) * 100), F.lit(0.0)), "dir": F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")}


def updates(ticks: DataFrame) -> DataFrame:
    """UPDATES for a table of ticks (symbol, at, c, closed): price against the close of the newest bar closed before; 0 and flat
    until one is. Of one bar's ticks the closing one comes last, others in order of price."""
    order = Window.partitionBy("symbol").orderBy("at", "closed", "c").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("closed"), F.col("c")), True).over(order)
    rows = ticks.withColumn("_before", before)
    return rows.select("symbol", "at", "closed", F.col("c").alias("price"), *(x.alias(k) for k, x in _told(F.col("c"), F.col("_before")).items()))


def streamed(ticks: DataFrame) -> DataFrame:
    """UPDATES for a stream of ticks; the state of a symbol is one number, the close of its newest closed bar."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "closed", "c"])  # a trigger's ticks of one symbol
        out = []
        for at, price, closed in zip(rows["at"], rows["c"], rows["closed"], strict=True):
            change = 0.0 if before is None else price - before
            share = change / before * 100 if before else 0.0
            out.append((key[0], at, closed, price, change, share, "up" if change > 0 else "down" if change < 0 else "flat"))
            before = price if closed else before
        if before is not None:
            state.update((before,))
        yield pd.DataFrame(out, columns=["symbol", "at", "closed", "price", "change", "change_pct", "dir"])

    return ticks.select("symbol", "at", "c", "closed").groupBy("symbol").applyInPandasWithState(each, UPDATES, "close double", "append", GroupStateTimeout.NoTimeout)
