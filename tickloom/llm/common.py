"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which on a join deals them to several tasks, whatever the table's size.
SPREAD_ROWS = 200
#: Slots for each shuffle partition in which such a join looks up how often a key is dealt, and all of them at most.
SLOTS = 16
MOST_SLOTS = 1 << 16
#: While a table is written: files of shuffles that nothing reads any more go, and Arrow batches have few rows, as texts may be long.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def full_text() -> Column:
    """The whole text; a null text is empty."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def content(text: Column | None = None) -> dict[str, Column]:
    """k1 and k2: 128 bits that tell whole texts apart, whatever ids their rows have."""
    text = full_text() if text is None else text
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text)}


def content_or_own() -> dict[str, Column]:
    """``content`` of rows with a text; rows without one get keys of their own, which no text has, so that a join with texts
    does not bring them all to one task."""
    row = F.monotonically_increasing_id()
    own = {"k1": F.xxhash64(row), "k2": F.xxhash64(F.lit("none"), row)}
    return {k: F.when(full_text() == "", own[k]).otherwise(c) for k, c in content().items()}


def doc_id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def sampled(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of df, or all if it has no more: those whose hash of doc_id (and text, where there is
    one) is smallest. Each partition keeps its own share, so nothing is shuffled."""
    n = df.count()
    drawn = F.pmod(F.xxhash64(*(c for c in ("doc_id", "text") if c in df.columns)), F.lit(1 << 40))
    return df if n <= rows else df.where(drawn < int((1 << 40) * rows / n))


def give_back() -> None:
    """Memory that is free goes back to the system: a Python worker lives on after its task, beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """f over each Arrow batch; f may give any number of batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
        batch = None
        give_back()

    return df.mapInArrow(each, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors and the driver share. Only a local session
    (tests) may go without one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"/tmp/tickloom-checkpoints-{uuid.uuid4().hex[:8]}")
    return context.getCheckpointDir()


class Scratch:
    """Tables of one operator's run, written once in the shared folder and read back: lineage ends there, and
    a lost executor costs no more than the stage at work. ``drop`` deletes a table that nothing reads any
    more; what the result itself reads stays for as long as the folder does."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths, self.written = spark, f"{shared_folder(spark)}/run-{uuid.uuid4().hex}", {}, 0

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        """df written (with Parquet's options, in small Arrow batches) and read back; the files that its shuffles left go as soon
        as it is written."""
        path = f"{self.folder}/table-{self.written}"
        self.written += 1
        before = {k: self.spark.conf.get(k) for k in _WRITING}
        try:
            for k, v in _WRITING.items():
                self.spark.conf.set(k, v)
            df.write.options(**options).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete every table of the run that is none of these."""
        read = {id(t) for t in tables}
        self.drop(*(kept for of, (_, kept) in self.paths.items() if of not in read))


def stored(df: DataFrame) -> DataFrame:
    """df as the only table of a run of its own."""
    return Scratch(df.sparkSession).keep(df)


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept as a checkpoint in the shared folder; for small tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """big joined with small (each key once) on ``on``, hot keys of big dealt to several tasks.

    Keys fall into SLOTS slots for each shuffle partition by hash. A slot whose largest key has more rows than a
    quarter of a mean partition (SPREAD_ROWS at least) is hot: its rows of big are dealt to shares, its rows of
    small repeated once for each. Both sides look the shares up in the same literal list, so nothing is marked by a
    join and the plan is one at every size. Only one row of each slot comes to the driver, and small grows by
    half at most on average. counts: ``on`` and n, the rows of big for each key (or more), where known. Keys are of one type
    on both sides; big is a table that has been read, so that its rows are numbered alike whenever a task runs again."""
    partitions = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = min(SLOTS * partitions, MOST_SLOTS)
    slot = F.pmod(F.xxhash64(*on), F.lit(slots)).cast("int")
    counts = big.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts
    found = counts.groupBy(slot.alias("slot")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).collect()
    limit = max(SPREAD_ROWS, sum(r["rows"] for r in found) // (4 * partitions))
    shares = [1] * slots
    for r in found:
        shares[r["slot"]] = max(1, -(-r["most"] // limit))
    dealt_to = F.get(F.expr(f"cast(split('{','.join(map(str, shares))}', ',') AS array<int>)"), slot)
    dealt = big.withColumn("_share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), dealt_to).cast("int"))
    copied = small.withColumn("_share", F.explode(F.sequence(F.lit(0), dealt_to - 1)))
    return dealt.join(copied, [*on, "_share"], how).drop("_share")
