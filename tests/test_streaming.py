"""The bar stream: repeated and open bars, and the same bars as the batch."""

import json

from pyspark.sql import functions as F

from tickloom.operators import ledger, validation
from tickloom.streaming import feed, monitor, ticks


#: A stream's watermark begins at 1970, so a bar at time 0 itself would count as late.
START = 1_700_006_400_000


def message(symbol, t, c, closed):
    return json.dumps({"symbol": symbol, "k": {"t": START + t, "o": "1.5", "h": "3", "l": "1", "c": str(c), "v": "10", "x": closed}})


def test_closed_bars_once(spark, tmp_path):
    hour = 3_600_000
    lines = [message("BTC/USDT", 0, 2, True), message("BTC/USDT", 0, 2, True), message("BTC/USDT", hour, 2.5, False), message("ethusdt", hour, 2.25, True), "not json"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    bars = feed.closed_bars(feed.file_stream(spark, str(tmp_path / "in")))
    query = bars.writeStream.format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.symbol, r.at.timestamp(), r.o, r.c, r.v) for r in spark.table("bars").collect())
    assert got == [("BTCUSDT", START / 1000, 1.5, 2.0, 10.0), ("ETHUSDT", START / 1000 + 3600, 1.5, 2.25, 10.0)]
    batch = feed.parsed(spark.read.text(str(tmp_path / "in"))).where("closed").dropDuplicates(["symbol", "at"])
    assert sorted((r.symbol, r.c) for r in batch.collect()) == [(g[0], g[3]) for g in got]


def test_ticks_against_the_last_closed_bar(spark, tmp_path):
    hour = 3_600_000
    lines = [message("a", 0, 2, False), message("a", 0, 2.5, True), message("a", hour, 2, False), message("a", hour, 3, True), message("b", 0, 1, False), message("a", 2 * hour, 3, False)]
    for k, part in enumerate((lines[:3], lines[3:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(part))
        query = ticks.streamed(feed.parsed(feed.file_stream(spark, str(tmp_path / "in")))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.symbol, r.at.timestamp(), r.closed, r.price, round(r.change, 6), round(r.change_pct, 6), r.dir) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = ticks.updates(feed.parsed(spark.read.text(str(tmp_path / "in"))))
    assert got == sorted((r.symbol, r.at.timestamp(), r.closed, r.price, round(r.change, 6), round(r.change_pct, 6), r.dir) for r in batch.collect())
    assert [g[3:] for g in got if g[0] == "A"] == [(2.0, 0.0, 0.0, "flat"), (2.5, 0.0, 0.0, "flat"), (2.0, -0.5, -20.0, "down"), (3.0, 0.5, 20.0, "up"), (3.0, 0.0, 0.0, "flat")]


def test_monitor_gives_each_verdict_once(spark, tmp_path):
    bars = spark.createDataFrame([("a", k, 10.0, 10.0 + (k % 3 - 1)) for k in range(8)], "symbol string, t long, o double, c double")
    rows = [("a", i, i, "direction", "up" if i != 4 else None, i + 1, False) for i in range(6)]
    calls = validation.sample_predictions(bars.withColumn("i", F.col("t").cast("int"))).limit(0)
    made = spark.createDataFrame(rows, "symbol string, i int, t long, kind string, dir string, close_at long, validated boolean")
    calls.unionByName(made, allowMissingColumns=True).write.parquet(str(tmp_path / "calls"))
    for part in ("t <= 2", "t > 2 and t <= 7"):
        bars.where(part).write.mode("append").parquet(str(tmp_path / "bars"))
        stream = spark.readStream.schema(monitor.BARS).parquet(str(tmp_path / "bars"))
        monitor.start(stream, str(tmp_path / "state"), str(tmp_path / "calls"), every=None).awaitTermination(200)
    found = sorted((r.i, r.hit) for r in monitor.verdicts(spark, str(tmp_path / "state")).collect())
    whole = ledger.drained(spark.read.parquet(str(tmp_path / "calls")), bars, 7).where("state = 'validated'")
    assert found == sorted((r.i, r.hit) for r in whole.collect()) and [i for i, _ in found] == [0, 1, 2, 3, 5]
    monitor.drain(spark, bars.where("t > 2"), 1, str(tmp_path / "state"), str(tmp_path / "calls"))  # a trigger that runs again
    assert sorted((r.i, r.hit) for r in monitor.verdicts(spark, str(tmp_path / "state")).collect()) == found
