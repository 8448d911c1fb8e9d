"""Labels that the last bits of the deviation decide: the next bar reaches both barriers, and the close before it is the label's own."""

import duckdb
import pytest

from tickloom.registry import QUERIES, SQL

#: Prices in cents, hour by hour (the last hour has three): bars 432 to 466 of click, sf0.1's events 60 times over.
CENTS = [7069100, 8519240, 7493060, 7820300, 6704420, 10489340, 12149720, 11972360, 10656920, 11466320, 10707320, 9937160, 11334380, 11499380, 11012480, 8733380, 12434780, 10805000]
CENTS += [8249360, 7840640, 8730560, 6800600, 5158160, 5800400, 4645220, 5156060, 5729780, 4591280, 6081500, 5772200, 4257260, 3261140, 1176980, 1053620, 1546100, 108140, 108140]


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tied")
    hours = [*range(len(CENTS) - 2), len(CENTS) - 3, len(CENTS) - 3]
    rows = ", ".join(f"({k}, {h}, {(b - a) / 100})" for k, (h, a, b) in enumerate(zip(hours, [5000000, *CENTS], CENTS)))
    duckdb.sql(f"COPY (SELECT k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * h AS ts, 'click' AS event_type, 50 + step::DOUBLE AS value FROM (VALUES {rows}) x(k, h, step)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["label_distribution", "meta_labels", "triple_barrier"])
def test_equals_sql_where_last_bits_decide(spark, tied, name):
    got = QUERIES[name](spark, tied)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tied}/events.parquet'")
    want = sorted(db.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


#: Closes in cents and the last bar's high and low: bars 206 to 241 and 1097 to 1133 of purchase, sf0.1's events 60 times over, each repetition an hour or a week after the one before.
WALKS = {
    "hourly": ([37893, 234319, 457884, 629034, 773433, 845146, 920310, 1019501, 1119270, 1220627, 1256454, 1321871, 1365437, 1439556, 1501830, 1534230, 1502632, 1502327, 1553562, 1601429, 1648623, 1708141, 1680724, 1682040, 1631245, 1482701, 1330058, 1231001, 1135915, 1044654, 935001, 838459, 740624, 590460, 433820, 248979], 509457, 228966),
    "weekly": ([613888, 640993, 655334, 633629, 631260, 573299, 597052, 542418, 560304, 561120, 543927, 642689, 680934, 579704, 619673, 632870, 686267, 612732, 486497, 482865, 470942, 397400, 335843, 337808, 414556, 331213, 277450, 302103, 358860, 288041, 261960, 255909, 286762, 158914, 24777, 21480, 27524], 42995, 682),
}


@pytest.fixture(scope="module")
def folded(tmp_path_factory):
    folder, rows = tmp_path_factory.mktemp("folded"), []
    for symbol, (closes, high, low) in WALKS.items():
        cents = [5000000, *closes[:-1], high, low, closes[-1]]
        hours = [min(k, len(closes) - 1) for k in range(len(cents) - 1)]
        rows += [f"('{symbol}', {h}, {(b - a) / 100})" for h, a, b in zip(hours, cents, cents[1:])]
    duckdb.sql(f"COPY (SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * h AS ts, symbol AS event_type, 50 + step::DOUBLE AS value FROM (VALUES {', '.join(rows)}) x(symbol, h, step)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["label_distribution", "meta_labels", "triple_barrier"])
def test_equals_sql_where_the_fold_of_the_deviation_decides(spark, folded, name):
    test_equals_sql_where_last_bits_decide(spark, folded, name)
