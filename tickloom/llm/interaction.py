"""Filter interaction audit: what each filter removes in every order, from aggregated lattice edges.

Filters that all look at the input alone commute, so what a filter does at a step depends on the set of filters
before it and not on their order. The subsets of k filters form a lattice with k * 2^(k-1) edges (already applied
subset, next filter): 80 for five. Documents are first counted by (part, set of failed filters), which combines
before any shuffle; these counts, 32 a part at most, contribute to the edges, and each of the k! orders is a path of k
edges, joined to the edges' sums.

Defined results: a null text is empty and a null part is the empty string; each repeated row counts as a document
of its own, and none of them is the other's smaller doc_id; a row without doc_id has no labels, is nobody's smaller
doc_id and has none itself; of several label rows for one doc_id any 1 counts; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content, doc_id, full_text

#: Characters that filter D rejects, and words.
WORD = r"[^\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
#: The name of the filter that rejects a text which a smaller doc_id has as well.
COPY = "E"
#: Salts for rows without doc_id in the join with labels, where they meet nothing.
SALTS = 4096


def failures() -> dict[str, Column]:
    """Failure conditions over the columns _text and _words, by the filters' letters."""
    text, words = F.col("_text"), F.col("_words")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(MARKS),
    }


def failed_sets(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """part, failed (bits in the order of conditions, then COPY), n, good, toxic: documents by what they fail."""
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())]
    rows = docs.select(doc_id(), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), full_text().alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", "part", reduce(Column.__add__, bits, F.lit(0)).alias("own"), *(c.alias(k) for k, c in content(F.col("_text")).items()))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), 1 + F.pmod("k1", F.lit(SALTS))).otherwise(0).cast("int"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(doc_id()).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "bad"))))
    known = rows.join(marks.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").fillna(False, ["good", "bad"])

    # copies: documents of one text, part and marks are counted together, apart from those of the smallest doc_id
    kind = ["k1", "k2", "own", "part", "good", "bad"]
    each = known.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    texts = each.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    )
    # a text has few such rows, whatever its copies: one for each part and pair of marks
    smallest = F.min("least").over(Window.partitionBy("k1", "k2"))
    first = F.when(F.col("least") == smallest, F.col("at_least")).otherwise(0) + F.col("unnamed")
    split = texts.select("part", "own", "good", "bad", "n", first.alias("first"))
    copy = 1 << len(conditions)
    outcomes = F.array(F.struct(F.col("own").alias("failed"), F.col("first").alias("n")), F.struct((F.col("own") + copy).alias("failed"), (F.col("n") - F.col("first")).alias("n")))
    found = split.select("part", "good", "bad", F.inline(outcomes)).where("n > 0")
    return found.groupBy("part", "failed").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(to) for c, to in (("good", "good"), ("bad", "toxic"))))


def edges(names: list[str]) -> list[tuple[int, int]]:
    """(already applied subset, bit of the next filter) for every edge of the lattice."""
    bits = [1 << k for k in range(len(names))]
    return [(sum(s), b) for b in bits for size in range(len(bits)) for s in combinations([x for x in bits if x != b], size)]


def steps(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, already applied subset, bit of the step's filter) for every step of every order."""
    bit = {x: 1 << k for k, x in enumerate(names)}
    return [("".join(order), k + 1, sum(bit[x] for x in order[:k]), bit[x]) for order in permutations(names) for k, x in enumerate(order)]


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    conditions = failures() if conditions is None else conditions
    names = [*conditions, COPY]
    counts = failed_sets(docs, labels, conditions)
    lattice = F.array(*(F.struct(F.lit(s).alias("subset"), F.lit(f).alias("filter")) for s, f in edges(names)))
    gone, fails = F.col("failed").bitwiseAND(F.col("subset")) != 0, F.col("failed").bitwiseAND(F.col("filter")) != 0

    def total(when: Column, what: str, name: str) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).alias(name)

    sums = (
        counts.select("*", F.inline(lattice)).groupBy("part", "subset", "filter")
        .agg(total(~gone & ~fails, "n", "kept"), total(~gone & fails, "n", "removed"), total(gone & fails, "n", "redundant"), total(F.col("failed") == F.col("filter"), "n", "unique_fails"), total(~gone & fails, "good", "good_lost"), total(~gone & fails, "toxic", "toxic_lost"))
    )
    # an edge lies on |subset|! * (k - 1 - |subset|)! of the orders
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names)))), F.bit_count("subset") + 1)
    worth = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    paths = docs.sparkSession.createDataFrame(steps(names), "filter_order string, step int, subset int, filter int")
    return (
        F.broadcast(paths).join(sums, ["subset", "filter"]).join(worth, ["part", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


#: The audit of the five filters, step by step from each document's failed letters.
SQL = r"""WITH d AS (
    SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w
    FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) bad FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, false) good, coalesce(bad, false) bad,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END fails
    FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id),
c AS (SELECT part, fails, count(*) n, count(*) FILTER (good) good, count(*) FILTER (bad) bad FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) x),
o AS (
    SELECT a.x || b.x || c.x || d.x || e.x filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[1:step - 1] before, filter_order[step] x FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)),
r AS (
    SELECT part, filter_order, step, x, n, good, bad, contains(fails, x) hit, fails = x sole,
        length(translate(fails, before, '')) < length(fails) gone
    FROM c, s),
q AS (
    SELECT part, filter_order, step, x,
        coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) removed,
        coalesce(sum(n) FILTER (gone AND hit), 0) redundant, coalesce(sum(n) FILTER (sole), 0) unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND hit), 0) good_lost, coalesce(sum(bad) FILTER (NOT gone AND hit), 0) toxic_lost
    FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) step, CAST(kept AS BIGINT) kept, CAST(removed AS BIGINT) removed,
    CAST(redundant AS BIGINT) redundant, CAST(unique_fails AS BIGINT) unique_fails, CAST(good_lost AS BIGINT) good_lost,
    CAST(toxic_lost AS BIGINT) toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) shapley
FROM q"""
