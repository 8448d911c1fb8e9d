"""Rows without an id, ids that unlike texts share, and columns whose names the operators use themselves, held
against brute force; control characters against the tokenizers library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tickloom.llm import fingerprints, neardup, packing, secrets, substrings, suffixes, toxicity
from tickloom.llm.queries import WORD_VOCABULARY

CLASHING = ["_id", "_mark", "places", "score", "component", "rid", "k1", "k2", "n", "row", "head", "left", "_share", "n_shingles"]
SCHEMA = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHING)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def made_texts(n=1500):
    draw = random.Random(21)
    vocabulary = ["".join(draw.choices("abcdefghiéñ日", k=draw.randint(2, 7))) for _ in range(900)]
    words = lambda k: " ".join(draw.choices(vocabulary, k=k))
    passage, other = words(80), words(45)
    out = []
    for k in range(n):
        if k % 5 == 0:
            out.append(f"{words(draw.randint(5, 40))} {passage} {words(draw.randint(5, 40))}")
        elif k % 11 == 0:
            out.append(f"{words(20)} {other} {other} {words(3)}")
        elif k % 7 == 0 and len(out) > 5:
            near = out[draw.randrange(len(out))].split()
            near[draw.randrange(len(near))] = "changed"
            out.append(" ".join(near))
        else:
            out.append(words(draw.randint(1, 60)))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = made_texts()
    ids = [None] * 900 + [k // 3 for k in range(600)]  # without id; then three texts to an id
    found = [(i, t) for i, t in zip(ids, texts, strict=True)]
    return [*found, found[3], found[3], found[1000], (7, None), (None, ""), (None, None), (7, texts[5])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = ["x"] * len(CLASHING)
    return spark.createDataFrame([(i, t, None if t is None else len(t), *extra) for i, t in rows], SCHEMA).repartition(6).cache()


def windows(units, n, rows):
    """Mask of each row's units under a window that stands twice."""
    counts = Counter(u[i : i + n] for u in map(units, rows) for i in range(len(u) - n + 1))
    masks = []
    for u in map(units, rows):
        mask = np.zeros(len(u), dtype=bool)
        for i in range(len(u) - n + 1):
            if counts[u[i : i + n]] > 1:
                mask[i : i + n] = True
        masks.append(mask)
    return masks


def as_bytes(row):
    return (row[1] or "").encode()


def byte_masks(rows):
    return windows(as_bytes, 200, rows)


def test_substrings(docs, rows):
    words = lambda r: tuple(as_bytes(r).split())
    want = []
    for r, mask in zip(rows, windows(words, 35, rows), strict=True):
        u = words(r)
        want.append((r[0], len(u), int(mask.sum()), sha(b" ".join(x for x, m in zip(u, mask, strict=True) if not m))))
    got = substrings.dedup_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want) and sum(w[2] for w in want) > 10_000


@pytest.mark.parametrize("limit", [suffixes.LIMIT, 3])  # 3: hot grams go by blocks, hot blocks by windows
def test_suffixes(docs, rows, limit):
    want = []
    for r, mask in zip(rows, byte_masks(rows), strict=True):
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        want.append((r[0], len(mask), int(mask.sum()), spans, sha(bytes(x for x, m in zip(as_bytes(r), mask, strict=True) if not m))))
    got = suffixes.dedup_bytes(docs, limit=limit).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_radix_gives_groups_of_equal_depth_in_order():
    draw = random.Random(5)
    data = np.array(draw.choices([97, 98], k=3000), dtype=np.uint8)
    at = np.arange(2900)
    for depth in (3, 8, 13, 16, 21):
        bucket = at % 2
        got = suffixes.radix(data, at, bucket, depth)
        key = lambda i: (bucket[i], data[i : i + depth].tobytes())
        counts = Counter(map(key, at))
        assert sorted(got) == [i for i in at if counts[key(i)] > 1]
        assert [key(i) for i in got] == sorted(key(i) for i in got)


def test_strip(docs, rows):
    want = []
    for r, mask in zip(rows, byte_masks(rows), strict=True):
        left = None if r[1] is None else bytes(x for x, m in zip(as_bytes(r), mask, strict=True) if not m).decode("utf-8", "ignore")
        want.append((r[0], left, None if left is None else len(left), *["x"] * len(CLASHING)))
    got = suffixes.strip(docs)
    assert got.schema == docs.schema and Counter(map(tuple, got.collect())) == Counter(want)


def kin(rows, percent):
    """Components of rows by their shingle sets; rows without words stand alone."""
    sets, of = [], {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").split()
        s = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
        sets.append(s)
        for x in s:
            of.setdefault(x, []).append(k)
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    seen = set()
    for ks in of.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        label[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(top(k), []).append(k)
    return sets, list(groups.values())


@pytest.fixture(scope="module")
def few(rows):
    # the passage makes most sets partners of most others, so brute force takes some of them only
    return [r for k, r in enumerate(rows) if k % 5 or k < 300]


@pytest.fixture(scope="module")
def few_docs(spark, few):
    return spark.createDataFrame([(i, t, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in few], SCHEMA).repartition(6).cache()


def test_near_duplicates(few_docs, few):
    sets, groups = kin(few, 85)
    want = []
    for group in groups:
        ids = [few[k][0] for k in group if few[k][0] is not None]
        name = min(ids, default=None)
        want += [(few[k][0], len(sets[k]), name) for k in group]
    got = neardup.near_duplicates(few_docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)
    for r in got:
        if r["component_id"] is not None:
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_dedup_keeps_one_row_of_each_component(few_docs, few):
    sets, groups = kin(few, 80)
    of = {few[k]: g for g, group in enumerate(groups) for k in group if sets[k]}
    got = neardup.dedup(few_docs, 80)
    assert got.schema == few_docs.schema
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    with_words = [r for r in kept if r[1] and r[1].split()]
    assert Counter(of[r] for r in with_words) == Counter(g for g, group in enumerate(groups) if sets[group[0]])
    assert Counter(r for r in kept if not (r[1] or "").split()) == Counter(r for r in few if not (r[1] or "").split())


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprints(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    # each distinct (id, text) is followed by another one, its head in place of the last third
    edited = Counter()
    by_id = {}
    for i, t in set((i, t or "") for i, t in rows):
        by_id.setdefault(i, set()).add(t)
    order = sorted((i for i in by_id if i is not None), reverse=True) + [None]
    for r in got:
        edited[r["doc_id"], r["edited_sha256"]] += 1
    for k, i in enumerate(order):
        following = by_id[order[(k + 1) % len(order)]]
        for t in by_id[i]:
            cut = len(t) // 3
            possible = {sha((t[: len(t) - cut] + u[:cut]).encode()) for u in following | by_id[i]}
            assert any(edited[i, p] for p in possible)


def test_stages_keep_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.withColumnRenamed("toxic", "label"))
    assert toxicity.accepted(docs, model).schema == docs.schema
    with pytest.raises(ValueError):
        toxicity.score(docs, model)
    assert secrets.redact(docs).schema == docs.schema
    assert packing.pack(docs, WORD_VOCABULARY).count() >= docs.count()


def test_redact_marks_the_finds_alone(spark):
    table = secrets.train(spark.createDataFrame([(1, "plain words of no import stand here in a row")], "doc_id long, text string"))
    key = "password = abcdefgh12345"
    rows = [(1, f"a {key} b", "x"), (None, None, "y"), (2, "nothing here", "z"), (2, "", "z")]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, row string"), table)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "a [secret] b", "x"), *rows[1:]]))


def test_ids_of_all_characters():
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(WORD_VOCABULARY), packing._ids(WORD_VOCABULARY)
    draw = random.Random(9)
    latin = [chr(c) for c in range(256)]
    wide = latin + [chr(draw.choice((draw.randrange(0x100, 0xD800), draw.randrange(0xE000, 0x110000)))) for _ in range(600)]
    texts = ["a\x02b", *latin, *("".join(draw.choices(latin, k=draw.randint(1, 30))) for _ in range(6000)), *("".join(draw.choices(wide, k=draw.randint(1, 30))) for _ in range(4000))]
    for text in texts:
        assert np.frombuffer(ids.of(text), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before it kept, held against brute force; extra columns stay."""
    texts = made_texts(300)
    rows = [(k, t, len(t), *["x"] * len(CLASHING)) for k, t in enumerate(texts)]
    rows += [(None, texts[1], 3, *["y"] * len(CLASHING)), (900, None, None, *["y"] * len(CLASHING)), (901, "see password = abcdefgh12345 now and here", 10, *["y"] * len(CLASHING))]
    rows += [(1000 + k, f"filthy brute {t[:200]}", 1, *["t"] * len(CLASHING)) for k, t in enumerate(texts[:60])]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], 5, int(r[0] >= 1000)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r) for r in at.collect()]
        assert name == "packing" or at.columns == docs.columns
    clean = [r for r in seen["toxicity"] if r[0] is None or r[0] < 1000]
    assert len(clean) == 303 and len(seen["toxicity"]) - len(clean) <= 6
    sets, groups = kin([r[:2] for r in seen["toxicity"]], 80)
    assert len(seen["near_dedup"]) == len(groups)
    masks = byte_masks(seen["near_dedup"])
    left = Counter(None if r[1] is None else bytes(x for x, m in zip(as_bytes(r), mask, strict=True) if not m).decode("utf-8", "ignore") for r, mask in zip(seen["near_dedup"], masks, strict=True))
    assert Counter(r[1] for r in seen["suffix_dedup"]) == left
    assert Counter(r[1] for r in seen["secrets"]) == Counter(t.replace("password = abcdefgh12345", "[secret]") if t else t for t in left.elements())
    assert Counter(r[0] for r in seen["packing"]) == Counter(r[0] for r in seen["secrets"])  # all shorter than a sequence
    run = Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    of = {n: k for k, n in enumerate(spark.read.parquet(f"{tmp_path}/packing").columns)}
    assert run == Counter((r[of["doc_id"]], r[of["length"]], r[of["ids_crc32"]]) for r in seen["packing"])


@pytest.mark.parametrize("f", [substrings.dedup_words, suffixes.strip, suffixes.dedup_bytes, neardup.near_duplicates, neardup.dedup])
def test_rows_without_text_meet_in_no_task(spark, f):
    """20,000 null or empty rows beside 4,000 others: no partition gets over twice the mean."""
    texts = made_texts(4000)
    rows = [(k, None if k % 2 else "") for k in range(20_000)] + [(20_000 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [n for (n,) in f(docs).rdd.mapPartitions(lambda p: [(sum(1 for _ in p),)]).collect() if n]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) >= 20_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)
