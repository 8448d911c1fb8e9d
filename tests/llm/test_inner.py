"""Exact top-k inner products against all pairs in Python's own integers, and against SQL."""

import math

import duckdb
import numpy as np
import pytest

from tickloom.llm import inner
from tickloom.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, label int, length string, block string, row string, asked string"


def plain(rows, every=50, k=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = {}
    for q, a in kept:
        if q % every == 0:
            for c, b in kept:
                if c != q:
                    score = sum(x * y for x, y in zip(a, b))  # noqa: B905  the longer one's rest counts for nothing
                    best.setdefault(q, {})
                    best[q][c] = max(score, best[q].get(c, score))
    clipped = lambda s: max(-(1 << 63), min(s, (1 << 63) - 1))
    return sorted((q, r, c, s) for q, own in best.items() for r, (s, c) in enumerate(sorted(((clipped(s), c) for c, s in own.items()), key=lambda p: (-p[0], p[1]))[:k], 1))


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "a", "b", "c", "d") for i, v in rows], schema).repartition(3)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of 32 rows, groups of 4 queries and chunks of 8, so that a small table meets every bound."""
    monkeypatch.setattr(inner, "BLOCK_BITS", 5)
    monkeypatch.setattr(inner, "GROUP_BITS", 2)
    monkeypatch.setattr(inner, "CHUNK", 8)


def drawn(n, width, seed=3):
    draw = np.random.default_rng(seed)
    axes = draw.normal(size=(4, width))
    return [(k, (draw.normal(size=4) @ axes * draw.exponential() + 0.1 * draw.normal(size=width)).astype(np.float32).tolist()) for k in range(n)]


def test_equals_all_pairs(spark, small_blocks):
    rows = drawn(1200, 24)
    odd = [(None, rows[0][1]), (50, None), (3, [None] * 24), (4, [float("nan")] * 24), (5, [float("inf")] * 24), (100, [0.0] * 24), (150, []), (1300, [1.0] * 5), (1301, [9.0] * 40)]
    rows += [*odd, rows[7], rows[7], rows[100], (7, rows[9][1]), (200, rows[11][1])]
    rows += [(2000 + k, rows[20][1]) for k in range(70)]  # a group of copies, queries among them
    assert found(inner.nearest(frame(spark, rows))) == plain(rows)


def test_blocks_of_short_vectors_are_never_met(spark, small_blocks):
    """Long vectors first: with floors from them, pairs of blocks whose lengths cannot reach any floor do not arise."""
    rows = [(k, [(1 + k % 3) * 100.0 if k < 40 else 0.01, 1.0]) for k in range(1, 400)] + [(0, [5.0, 0.0])]
    met = []
    keep = inner.searched

    def counted(asked, candidates, *more):
        met.append(candidates.count())
        return keep(asked, candidates, *more)

    inner.searched = counted
    try:
        got = found(inner.nearest(frame(spark, rows), every=1000))
    finally:
        inner.searched = keep
    assert got == plain(rows, every=1000) and met[0] == 32 and met[1] <= 2 * 32


def test_large_numbers(spark):
    rows = [(0, [3e30, 1.0, -2e30]), (1, [3e30, 1.0, 1.0]), (2, [-3e30, 0.0, 0.0]), (3, [2.5e5, 2.5e5, 2.5e5]), (50, [3e5, 1e5, 7e5]), (51, [1e-30] * 3)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(inner.nearest(frame(spark, rows))) == plain(rows)


def test_few_rows(spark):
    assert inner.nearest(frame(spark, [])).collect() == []
    assert inner.nearest(frame(spark, [(1, [1.0])])).collect() == []
    assert inner.nearest(frame(spark, [(0, [1.0])])).collect() == []
    assert found(inner.nearest(frame(spark, [(0, []), (1, [])]))) == [(0, 1, 1, 0)]


def test_equals_sql(spark):
    db, data = duckdb.connect(), "/root/testdata/sf0.01"
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = db.sql(SQL["op12_inner"])
    got = QUERIES["op12_inner"](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
