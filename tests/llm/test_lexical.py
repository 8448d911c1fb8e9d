"""Ranked search against plain scores, its stopping, the graph's cuts, and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tickloom.llm import bisection, lexical
from tickloom.llm.queries import QUERIES, SQL

TERM = re.compile(lexical.TERM)
LOWER = {k: k + 32 for k in range(65, 91)}
EXTRA = "n string, leaf string, terms string, shard string, item string, `rank` string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    held = [(d, Counter(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    documents, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * documents // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(i, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def made(n=900):
    draw = random.Random(6)
    topics = [[f"{c}{k}" for k in range(60)] for c in ("Alpha", "beta", "géa", "日本", "x")]
    common = ["the", "OF", "and", "Ü1"]
    word = lambda own: draw.choice(common) if draw.random() < 0.4 else draw.choice(own) if draw.random() < 0.9 else draw.choice(draw.choice(topics))
    text = lambda: (lambda own: "".join(word(own) + draw.choice([" ", "-", ", ", "\x00", "\n"]) for _ in range(draw.choice([3, 20, 60]))))(draw.choice(topics))
    docs = [(k, text()) for k in range(n)]
    docs += [(n + k, docs[5][1]) for k in range(300)]  # a group of copies
    docs += [(None, docs[5][1]), (None, docs[5][1]), (3, docs[9][1]), docs[7], docs[7], (5000, None), (5001, ""), (5002, " .,! "), (5003, "the " * 40_000)]
    items = [(k, text()) for k in range(25)] + [(3, "alpha1 beta2"), (None, "alpha1 the"), (None, "beta3"), (90, None), (91, "?"), (92, "nowhere at-all"), (93, docs[5][1])]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = made()
    extra = ["x"] * 6
    return docs, items, spark.createDataFrame([(*d, *extra) for d in docs], f"doc_id long, text string, {EXTRA}").repartition(3).cache(), spark.createDataFrame([(*i, *extra) for i in items], f"item_id int, text string, {EXTRA}")


def test_equals_plain_scores(tables, monkeypatch):
    docs, items, frame, asked = tables
    monkeypatch.setattr(lexical, "SHARD", 40)
    assert found(lexical.ranked(frame, asked)) == plain(docs, items)


def test_items_in_blocks(tables, monkeypatch):
    docs, items, frame, asked = tables
    monkeypatch.setattr(lexical, "TERMS", 150)
    few = [i for i in items if i[0] in (1, 2, 3, 4, None, 93)]
    assert found(lexical.ranked(frame, asked.where("item_id in (1, 2, 3, 4, 93) or item_id is null"), 4)) == plain(docs, few, 4)


def test_only_shards_over_the_floor_are_visited(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 20)
    docs = [(k, f"topic{k % 8} word{k % 8} word{k % 8} the " + "filler " * (k % 8 == 3)) for k in range(800)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(0, "topic3 word3 the"), (1, "topic5")], "item_id long, text string")
    visits = []
    run = lexical.visited

    def counted(shards, pairs, *more):
        visits.append((pairs.count(), shards.count()))
        return run(shards, pairs, *more)

    monkeypatch.setattr(lexical, "visited", counted)
    assert found(lexical.ranked(frame, asked)) == plain(docs, [(0, "topic3 word3 the"), (1, "topic5")])
    assert visits[0][0] <= 2 * lexical.FIRST
    assert sum(v for v, _ in visits) < 2 * visits[0][1] / 2  # far fewer than each item in each shard


def test_cuts_bring_topics_together():
    draw = np.random.default_rng(2)
    topic = draw.integers(0, 4, 600)
    pairs = sorted({(d, int(topic[d]) * 50 + int(t)) for d in range(600) for t in draw.integers(0, 50, 12)} | {(d, 200 + int(t)) for d in range(600) for t in draw.integers(0, 20, 3)})
    rows, terms_ = (np.array(x) for x in zip(*pairs, strict=True))
    leaf = bisection.bisect(rows, terms_, 600, 220, 2).leaves(rows, terms_, 600)
    purity = sum(np.bincount(topic[leaf == x]).max() for x in set(leaf.tolist())) / 600
    assert purity > 0.95 and np.bincount(leaf, minlength=4).max() < 250


def test_empty_tables(tables):
    _, _, frame, asked = tables
    assert lexical.ranked(frame.limit(0), asked).collect() == []
    assert lexical.ranked(frame, asked.limit(0)).collect() == []


def test_equals_sql(spark):
    db, data = duckdb.connect(), "/root/testdata/sf0.01"
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    want = db.sql(SQL["op13_lexical"])
    got = QUERIES["op13_lexical"](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
