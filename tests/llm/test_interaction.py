"""The filter audit against filters applied one after the other, document by document, and against its SQL."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tickloom.llm import interaction
from tickloom.llm.queries import QUERIES, SQL

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(rows):
    """The letters that each row fails."""
    ids = {}
    for d, t, _ in rows:
        if d is not None:
            ids[t or ""] = min(ids.get(t or "", d), d)
    for d, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= x <= "Z" for x in t) > 3 * len(t),
            "D": any(x in "#$%&*|" for x in t),
            "E": d is not None and d > ids[t],
        }
        yield {k for k, v in tests.items() if v}


def plain(rows, labels):
    good, toxic = ({d for d, *m in labels if d is not None and m[k] == 1} for k in (0, 1))
    found = {}
    fails = list(failing(rows))
    for part in {lang or "" for _, _, lang in rows}:
        own = [(d, f) for (d, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                kept, gone = [r for r in left if x not in r[1]], [r for r in left if x in r[1]]
                shapley[x] += len(gone)
                hits = sum(x in f for _, f in own)
                found[part, "".join(order), step] = [len(kept), len(gone), hits - len(gone), sum(f == {x} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                left = kept
        for (p, order, step), values in found.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in found.items())


def made():
    draw = random.Random(4)
    texts = [None, "", "one $ word", "X" * 40, "日本語 🙂 Ä É", "a\tb\x1cc\x0b d e"]
    for k in range(60):
        words = [draw.choice("abcdefgh") * draw.randint(1, 40) for _ in range(draw.choice([5, 150, 200, 260, 400]))]
        words += [draw.choice(["#", "Upper", "CAPS" * 20, "x|y", "fine"]) for _ in range(draw.randint(0, 3))]
        texts += [" ".join(words)] * draw.choice([1, 1, 2, 5])
    rows = [(k, t, draw.choice(["en", "de", "", None])) for k, t in enumerate(draw.sample(texts, len(texts)))]
    rows += [rows[3], rows[3], (None, rows[5][1], "en"), (None, None, None), (rows[7][0], "other text of that id", "fr")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in range(0, len(texts), 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = made()
    clashing = ["n", "salt", "own", "_words", "failed", "k1", "least"]
    docs = spark.createDataFrame([(*r, *clashing) for r in rows], "doc_id int, text string, lang string, " + ", ".join(f"`{c}` string" for c in clashing))
    return rows, labels, docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_filters_in_a_row(tables):
    rows, labels, docs, marks = tables
    got = sorted(tuple(r[c] for c in COLUMNS) for r in interaction.audit(docs, marks).collect())
    assert got == plain(rows, labels)


def test_lattice():
    assert len(set(interaction.edges(list("ABCDE")))) == 80
    assert len(interaction.steps(list("ABCDE"))) == 600
    assert {x[2:] for x in interaction.steps(list("ABCDE"))} == set(interaction.edges(list("ABCDE")))


def test_empty_tables(tables):
    _, _, docs, marks = tables
    assert interaction.audit(docs.limit(0), marks).collect() == []
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in interaction.audit(docs, marks.limit(0)).collect())


def test_equals_sql(spark):
    db, data = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    want = db.sql(SQL["op11_interaction"])
    got = QUERIES["op11_interaction"](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
