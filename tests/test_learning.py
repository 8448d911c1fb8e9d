"""Clusters against plain rounds, draws against the generator stepped one by one, and states of short series."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import learning


def test_clusters_equal_plain_rounds(spark):
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(m, 1.0, (40, 3)) for m in (0, 4, 9)])
    draw.shuffle(x)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, vector array<double>").repartition(5)
    centres = x[[i * len(x) // 4 for i in range(4)]].copy()
    for _ in range(30):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(4)])
    got = {r["vec_id"]: r["cluster"] for r in learning.clusters(df, 4).collect()}
    assert [got[i] for i in range(len(x))] == label.tolist()
    assert learning.clusters(df.limit(0), 4).collect() == []


def test_rounds_begin_at_evenly_spaced_rows_of_many_parts(spark):
    n, width, k = 6000, 64, 8
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.expr(f"transform(sequence(1, {width}), d -> sin(id * d))").alias("vector")).repartition(7)
    x = {r["vec_id"]: r["vector"] for r in df.collect()}
    begin = np.array([x[i * n // k] for i in range(k)])
    centres = begin.copy()
    points = np.array([x[i] for i in range(n)])
    for _ in range(2):
        label = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([points[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
    label = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    got = {r["vec_id"]: r["cluster"] for r in learning.clusters(df, k, rounds=2).select("vec_id", "cluster").collect()}
    assert [got[i] for i in range(n)] == label.tolist()


def test_draws_equal_the_stepped_generator(spark):
    def stepped(seed, n):
        s, mask = seed or 1, 0xFFFFFFFF
        for _ in range(n):
            s = (s + 0x6D2B79F5) & mask
            t = (s ^ (s >> 15)) * (s | 1) & mask
            t ^= (t + (t ^ (t >> 7)) * (t | 61)) & mask
            yield ((t ^ (t >> 14)) & mask) / 2**32

    rows = [(seed, k + 1, v) for seed in (0, 1, 42, 0xFFFFFFFF) for k, v in enumerate(stepped(seed, 50))]
    df = spark.createDataFrame(rows, "seed long, step long, want double").withColumn("got", learning.draw(F.col("seed"), F.col("step")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_states_wait_for_three(spark):
    keys = "a b b a b b b c c b c c c".split()
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate(keys)] + [("s", 99, None)], "symbol string, i int, key string")
    got = sorted((r["i"], r["state"], r["entered"]) for r in learning.committed(df).collect())
    assert "".join(s for _, s, _ in got) == "aaaaaabbbbbbc" and [i for i, _, e in got if e] == [0, 6, 12]
