"""The validation monitor: closed bars come in, due predictions get their verdicts, once.

Each trigger writes its bars and its verdicts into a folder of its own number, which a repeated trigger writes over, so nothing
is counted twice after a failure. A prediction is validated if any folder has its verdict; one whose bar is not there yet, or
whose verdict is not usable, stays pending and is tried again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ledger

BARS = "symbol string, t long, o double, c double"


def _others(spark: SparkSession, folder: str, schema: str, batch: int) -> DataFrame:
    """What triggers before this one have written."""
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/batch=-1")
    return spark.read.schema(schema + ", batch long").parquet(folder).where(F.col("batch") < batch).drop("batch")


def drain(spark: SparkSession, bars: DataFrame, batch: int, folder: str, predictions: str, key: tuple[str, ...] = ("symbol", "i")) -> DataFrame:
    """The verdicts of one trigger, written. predictions: a table's folder, which may grow meanwhile."""
    made = bars.select("symbol", "t", "o", "c").dropDuplicates(["symbol", "t"])
    made.write.mode("overwrite").parquet(f"{folder}/bars/batch={batch}")
    known = spark.read.schema(BARS + ", batch long").parquet(f"{folder}/bars").where(F.col("batch") <= batch).drop("batch").dropDuplicates(["symbol", "t"])
    rows = spark.read.parquet(predictions)
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in key) + ", kind string, hit boolean, covered boolean, abs_error double"
    done = _others(spark, f"{folder}/verdicts", schema, batch)
    now = known.agg(F.max("t")).first()[0]
    if now is None:
        return done.limit(0)
    open_rows = rows.join(done.select(*key), list(key), "left_anti")
    found = ledger.drained(open_rows, known, now).where("state = 'validated'").select(*key, "kind", "hit", "covered", "abs_error")
    found.write.mode("overwrite").parquet(f"{folder}/verdicts/batch={batch}")
    return spark.read.parquet(f"{folder}/verdicts/batch={batch}")


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """All verdicts so far."""
    return spark.read.parquet(f"{folder}/verdicts").drop("batch")


def start(bars: DataFrame, folder: str, predictions: str, every: str | None = "5 seconds") -> StreamingQuery:
    """A running monitor over a stream of closed bars (symbol, t, o, c). every: time between triggers; None drains what there is
    and ends."""
    writer = bars.writeStream.foreachBatch(lambda df, k: drain(df.sparkSession, df, k, folder, predictions)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
