"""Queries against their SQL on walks that cross 0: closes of unlike signs, losses of more than all, closes of 0."""

import math

import duckdb
import pytest

from tickloom.registry import QUERIES, SQL

#: Steps of sf0.01's events are this much wider here.
WIDER = 60
#: Closes of one symbol more, hour by hour.
ZEROS = [50000, 100, 0, 100, 0, 0, -100, 0, 50, -50] + [20, -10, 0, 30, 40, -60, 10, -20, 30, 5] * 4 + [0, 30, -40, 60, 20]
NAMES = ["return_spread", "triple_barrier", "meta_labels", "uniqueness", "label_distribution", "macro_state", "backtest", "walk_forward_backtest", "regime", "regime_as_of", "regime_series", "meta_vector"]


@pytest.fixture(scope="module")
def crossing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("crossing")
    steps = ", ".join(f"({k}, {b - a}.0)" for k, (a, b) in enumerate(zip([50000, *ZEROS], ZEROS)))
    duckdb.sql(f"""COPY (SELECT event_id, ts, event_type, 50 + {WIDER} * (value - 50) AS value FROM '/root/testdata/sf0.01/events.parquet'
        UNION ALL SELECT 1000000 + k, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * k, 'zero', 50 + step FROM (VALUES {steps}) x(k, step)) TO '{folder}/events.parquet'""")
    return str(folder)


def plain(columns, values):
    """Rows in order, columns by name; NaN, which is no null, by that name."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple("NaN" if isinstance(v[k], float) and math.isnan(v[k]) else v[k] for k in order) for v in values), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_across_zero(spark, crossing, name):
    got = QUERIES[name](spark, crossing)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{crossing}/events.parquet'")
    want = db.sql(SQL[name])
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(want.columns, want.fetchall())
