"""Near copies of every length, held against brute force."""

import random

import pytest

import corpus_pipeline
from tickloom.llm import neardup


def brute(rows, percent):
    """The smallest id that each row's id is linked with, in any number of steps."""
    sets = {}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    of, label = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            of.setdefault(x, []).append(d)
    links = {(a, b) for ds in of.values() for a in ds for b in ds if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def near_copies(percent, lengths):
    """Pairs of texts, the second with as many words more as leave it just linked, or with a word changed."""
    draw = random.Random(percent)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for n in lengths:
        base = [word() for _ in range(n)]
        k = n - 4
        more = [word() for _ in range(k * 100 // percent - k)]
        changed = [*base[:-1], word()]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((base, base + more, changed))]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_links_of_all_sizes(spark, percent):
    rows = near_copies(percent, [*range(5, 140), 204, 324, 404, 804])
    want = brute(rows, percent)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert sum(want[d] != d for d in want) > 130
    assert got == want


def test_pipeline_stage_drops_copies_from_80_percent_on(spark):
    rows = near_copies(80, range(5, 240))
    want = brute(rows, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d in want if want[d] == d)


@pytest.mark.parametrize("percent", [10, 50, 75, 80, 85, 90, 99])
def test_bands_miss_few(percent):
    rows, bands = neardup.bands_for(percent)
    assert rows * bands <= neardup.REGISTERS and (1 - (percent / 100) ** rows) ** bands <= 4e-6


def test_rows_without_own_id_are_linked_by_their_texts_only(spark):
    draw = random.Random(3)
    text = lambda: " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(30))
    a, b, c = text(), text(), text()
    # clean texts without id, a near copy of one of them, an id with two texts, a row twice, rows without words
    rows = [(None, a), (None, b), (5, b + " more"), (7, c), (7, text()), (9, text()), (None, ""), (None, None), (11, a), (None, text())]
    rows.append(rows[5])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(5, b + " more"), (7, c), rows[4], rows[5], (None, ""), (None, None), (11, a), rows[9]]
    assert sorted(map(str, (tuple(r) for r in neardup.dedup(docs).collect()))) == sorted(map(str, want))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()), key=str)
    none = [(None, 11, False), (None, 5, False), (None, None, True), (None, None, True), (None, None, True)]
    assert got == sorted([*none, (5, 5, True), (7, 7, True), (7, 7, True), (9, 9, True), (9, 9, True), (11, 11, True)], key=str)
