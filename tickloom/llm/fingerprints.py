"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words are hashed, every run of GRAM words gets a rolling polynomial hash modulo a Mersenne prime,
and of every WINDOW consecutive gram hashes the smallest is kept, the rightmost on ties, with its position.
Two texts that share a run of GRAM + WINDOW - 1 words therefore share a fingerprint.

Defined results: a null text is empty; an empty text has the empty fingerprint; a text of fewer than GRAM
words has one gram of all its words; one of fewer grams than WINDOW keeps its smallest gram. Other columns
of the input are not read. Documents are told apart by doc_id and 128 bits of their text: rows equal in both are
one place in the order of documents, unlike texts of one id (or of none) follow one another in an order of
their content; a null doc_id comes after all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import content, full_text, settle, spread_join

#: Stands for a null doc_id in join keys.
NO_ID = -(1 << 63)
#: What tells a document from every other: its id and 128 bits of its text.
OWN = ["_id", "k1", "k2"]
GRAM = 5
WINDOW = 12
_PRIME = (1 << 31) - 1
_BASE = 1_000_003
_POSITIONS = 1 << 31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body (or a lambda in it) uses it."""
    return F.transform(F.array(value), body)[0]


def _zip(a: Column, shift: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of each element and the one ``shift`` places later."""
    n = F.size(a) - shift
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + shift), n), f)


def _grams(h: Column, k: int) -> Column:
    """Polynomial hashes of every k consecutive word hashes, from those of halves."""

    def joined(a: Column, left: int, b: Column, right: int) -> Column:
        scale = F.lit(pow(_BASE, right, _PRIME)).cast("long")
        n = F.size(b) - left
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + left), n), lambda x, y: (x * scale + y) % F.lit(_PRIME))

    def build(n: int) -> Column:
        if n == 1:
            return h
        half = 1 << ((n - 1).bit_length() - 1)
        if n == 2 * half:
            return let(build(half), lambda a: joined(a, half, a, half))
        return joined(build(half), half, build(n - half), n - half)

    return build(k)


def _least(keys: Column, w: int) -> Column:
    """Minimum of every w consecutive keys, by doubling."""

    def step(a: Column, span: int) -> Column:
        if span == w:
            return a
        shift = min(span, w - span)
        return let(_zip(a, shift, lambda x, y: F.least(x, y)), lambda b: step(b, span + shift))

    return step(keys, 1)


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<bigint>: kept grams in order, each its 31-bit hash * 2**31 + (2**31 - 1 - position)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def kept(h: Column) -> Column:
        one = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * _BASE + x) % _PRIME))
        grams = F.when(F.size(h) < gram, one).otherwise(_grams(h, gram))

        def minima(keys: Column) -> Column:
            return F.when(F.size(keys) < window, F.array(F.array_min(keys))).otherwise(_least(keys, window))

        keys = F.transform(grams, lambda g, i: g * F.lit(_POSITIONS) + (F.lit(_POSITIONS - 1) - i))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(let(keys, minima)))

    return let(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(_PRIME))), kept)


def hashes(kept: Column) -> Column:
    """The distinct gram hashes of a fingerprint."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 31).cast("int")))


def as_string(kept: Column) -> Column:
    """hash:position of each kept gram, comma-joined."""
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.lower(F.hex(F.shiftright(x, 31))), (F.lit(_POSITIONS - 1) - (x % F.lit(_POSITIONS))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of gram hashes; two empty ones are alike."""
    def share(both: Column) -> Column:
        union = F.size(a) + F.size(b) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / union)

    return let(F.size(F.array_intersect(a, b)), share)


def keyed(docs: DataFrame) -> DataFrame:
    """OWN and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), full_text().alias("text")).withColumns(content(F.col("text")))


def neighbours(docs: DataFrame) -> DataFrame:
    """(_id, k1, k2, to, need, n): for each document the one that it follows, going down in doc_id (the largest
    follows the smallest), a third of that one's length, and how many rows are this document.

    Ids alone are range-partitioned; a row that begins a partition takes its forerunner from a table of
    one row for each partition. Nothing else meets in one place."""
    order = [F.col("_id").desc(), F.col("k1"), F.col("k2")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy(*OWN).agg(F.max(F.char_length("text")).alias("chars"), F.count("*").alias("n")).repartitionByRange(parts, *order)
    ids = settle(ids.withColumn("part", F.spark_partition_id()))
    me = F.struct(*OWN, "chars")
    before = F.lag(me).over(Window.partitionBy("part").orderBy(*order))
    edges = ids.groupBy("part").agg(F.max_by(me, F.struct(-F.col("_id").cast("decimal(20,0)"), F.col("k1"), F.col("k2"))).alias("last"))
    along = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", F.coalesce(F.lag("last").over(along), F.last("last").over(whole)).alias("edge"))
    found = ids.withColumn("before", before).join(F.broadcast(edges), "part").withColumn("before", F.coalesce("before", "edge"))
    return found.select(*OWN, F.struct("before._id", "before.k1", "before.k2").alias("to"), F.floor(F.col("before.chars") / 3).cast("int").alias("need"), "n")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third replaced by the head of the next
    document's text. One row for each document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    own = keyed(docs).withColumn("kept", winnow(F.col("text"), gram, window))
    order = neighbours(keyed(docs))
    repeats = not order.where("n > 1").isEmpty()
    # rows of one document more than once may be many, so they are dealt to several tasks
    joined = (lambda a, b: spread_join(a, b, OWN, order)) if repeats else (lambda a, b: a.join(b.hint("shuffle_hash"), OWN))
    heads = joined(own, order.select(*OWN, "to", "need"))
    heads = heads.select(F.col("to._id").alias("_id"), F.col("to.k1").alias("k1"), F.col("to.k2").alias("k2"), F.substring("text", F.lit(1), F.col("need")).alias("head"), hashes(F.col("kept")).alias("next_hashes"))
    if repeats:
        heads = heads.dropDuplicates(OWN)
    n = F.char_length("text")
    both = joined(own, heads).withColumn("n_chars", n.cast("long"))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("head")))
    both = both.select("_id", "n_chars", "kept", "next_hashes", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow(F.col("edited"), gram, window).alias("edited_kept"))
    both = both.withColumns({"own_hashes": hashes(F.col("kept")), "edited_hashes": hashes(F.col("edited_kept"))})
    return both.select(
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "n_chars", "edited_sha256", as_string(F.col("kept")).alias("fingerprint"), as_string(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
