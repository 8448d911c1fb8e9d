"""The volume profile's windows and their limits, by hand."""

from pyspark.sql import functions as F

from tickloom.operators import structure

BARS = "symbol string, i long, t long, o double, h double, l double, c double, v double"


def bars(spark, n, symbol="a"):
    return spark.createDataFrame([(symbol, i, 100 + i, 1.0 + i, 2.0 + i, 0.0 + i, 1.5 + i, 10.0) for i in range(n)], BARS)


def used(rows, **options):
    return {r["symbol"]: r["bars"] for r in structure.profile_summary(rows, **options).collect()}


def test_the_session_cuts_the_window_only_where_it_began_inside(spark):
    ten = bars(spark, 10)
    assert used(ten) == {"a": 10}
    assert used(ten, lookback=4) == {"a": 4} and used(ten, lookback=0) == {"a": 10}
    assert used(ten, session_start=F.lit(107)) == {"a": 3}
    assert used(ten, lookback=4, session_start=F.lit(101)) == {"a": 4}  # before the window
    assert used(ten, session_start=F.lit(500)) == {"a": 10}  # no bar since
    assert used(ten, session_start=F.lit(None).cast("long")) == {"a": 10}


def test_no_profile_of_one_bar_of_no_range_or_of_nothing(spark):
    assert used(bars(spark, 1)) == {} and used(bars(spark, 0)) == {}
    assert used(bars(spark, 5), session_start=F.lit(104)) == {}
    flat = spark.createDataFrame([("a", i, i, 1.0, 1.0, 1.0, 1.0, 5.0) for i in range(4)], BARS)
    assert used(flat) == {}


def test_buckets_are_held_to_their_limits_and_lost_volume_counts_as_none(spark):
    for asked, given in ((1, 4), (24, 24), (9999, 256)):
        assert structure.volume_profile(bars(spark, 3), asked).count() == given
    odd = bars(spark, 6).withColumn("v", F.when(F.col("i") == 1, None).when(F.col("i") == 2, -7.0).otherwise(F.col("v")))
    assert structure.volume_profile(odd).agg(F.sum("volume")).first()[0] == 40.0
    empty = structure.profile_summary(bars(spark, 6).withColumn("v", F.lit(0.0))).first()
    assert (empty["vapct"], empty["hvn"], empty["lvn"]) == (None, 0, 0)
