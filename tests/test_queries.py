"""Every query with SQL, held against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tickloom.plans import asof, backtest
from tickloom.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in ("events", "embeddings"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def once():
    """What many queries begin with is computed once for each plan of bars: the newest states, all states, the walk."""
    patch, made = pytest.MonkeyPatch(), {}

    def shared(module, name):
        compute = getattr(module, name)

        def cached(bars, *more):
            key = (name, bars.semanticHash(), tuple(getattr(x, "__code__", x) for x in more))
            return made.setdefault(key, None) or made.__setitem__(key, compute(bars, *more).cache()) or made[key]

        patch.setattr(module, name, cached)

    for module, name in ((asof, "newest"), (asof, "states"), (asof, "regimes"), (backtest, "walk_forward")):
        shared(module, name)
    patch.setattr("tickloom.plans.snapshot.newest", asof.newest)
    patch.setattr("tickloom.plans.snapshot.regimes", asof.regimes)
    yield
    patch.undo()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(None if isinstance(v[k], float) and math.isnan(v[k]) else v[k] for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_recurrences_have_rows(spark):
    r = QUERIES["recurrences"](spark, DATA).where("i >= 40").limit(5).collect()
    assert all(0 <= x["rsi14"] <= 100 and x["atr14"] >= 0 for x in r)
