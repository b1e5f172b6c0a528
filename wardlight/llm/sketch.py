"""Document fingerprints by threshold-scaled sketches.

A shingle is five neighbouring words (a text of fewer is one shingle); its hash is XXH64 over its words' XXH64.  The
sketch keeps every distinct hash below ``fraction`` of the hashes' range, and nothing else.  So the sketch of a union is
the union of sketches, a sketch of a larger fraction turns into one of a smaller by dropping hashes (below()), and the share of the
smaller sketch found in the larger estimates containment however unequal the documents are.  FRACTION is 1: the
estimate is exact but for clashes of 64-bit hashes.  With a smaller one a text of n shingles has no hash below the
threshold with chance (1 - fraction)^n, and then its containment can't be told and counts as 0.

Cases.  Null texts are empty.  Texts without words have an empty sketch; two of these are fully alike, one and a text
with words not at all.  Equal texts have equal sketches.  Repeated ids follow one another in an order fixed by a hash
of the text; null ids come last, in that order.  A single document is its own next one.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words

SHINGLE, FRACTION = 5, 1.0
FIRST = -(1 << 63)
#: Documents in a bucket when the table is put in order, and the most buckets.
BUCKET_ROWS, BUCKETS = 1500, 40_000


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes of a whole text (array<long>), those below ``fraction`` of their range."""
    return below(_distinct(F.transform(ascii_words(text), lambda w: F.xxhash64(w))), fraction)


def below(hashes: Column, fraction: float) -> Column:
    """The hashes below ``fraction`` of their range; hashes are signed, so that begins at -2^63."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    top = FIRST + int(fraction * (1 << 64))
    return hashes if fraction == 1 else F.filter(hashes, lambda h: h < F.lit(top))


def _distinct(hashes: Column) -> Column:
    # the words' hashes are bound once, as the only element of an array, so that they aren't computed again and again
    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return F.sort_array(F.array_distinct(F.get(F.transform(F.array(hashes), shingles), F.lit(0))))


# the shared hashes stand outside of any condition, so that both measures of a pair of sketches compute them once
def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that is in the other one."""
    least = F.least(F.size(a), F.size(b))
    return (F.size(F.array_intersect(a, b)) + _both_empty(a, b)) / F.greatest(least, F.lit(1))


def resemblance(a: Column, b: Column) -> Column:
    """Shared hashes among all hashes of two sketches."""
    shared = F.size(F.array_intersect(a, b))
    return (shared + _both_empty(a, b)) / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def _both_empty(a: Column, b: Column) -> Column:
    return ((F.size(a) == 0) & (F.size(b) == 0)).cast("int")


def as_hex(s: Column) -> Column:
    """The sketch as text: 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sketch)."""
    return df.select(F.col(doc_id).alias("doc_id"), sketch(F.col(text)).alias("sketch"))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below the key; looked up in blocks."""
    if not bounds:
        return F.lit(0)
    block = max(1, math.isqrt(len(bounds)))
    whole = [F.lit(b) for b in bounds]
    coarse = F.size(F.filter(F.array(*whole[block - 1 :: block]), lambda b: b < key))
    return coarse * block + F.size(F.filter(F.slice(F.array(*whole), coarse * block + 1, F.lit(block)), lambda b: b < key))


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): the next document by descending id; after the last comes the first.

    The table is put in order in buckets of neighbouring ids; a bucket also gets a copy of what follows its last
    document, so nothing but the documents themselves moves, once: sketches are made afterwards.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = docs.count()
    parts = min(BUCKETS, -(-n // BUCKET_ROWS))
    cuts = docs.select("key").approxQuantile("key", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    # a key that fills several buckets by itself (null ids, say) is cut further, by the hash of the text
    bounds, share = sorted({int(x) for x in cuts}), max((cuts.count(x) for x in cuts), default=1)
    order = [F.col("key").desc(), F.col("mark").desc()]
    finer = F.shiftright("mark", 32) + F.lit(1 << 31)
    dealt = docs.withColumn("mark", F.xxhash64("text")).withColumn("bucket", _bucket(F.col("key"), bounds))
    hot = F.col("key").isin([int(x) for x in {c for c in cuts if cuts.count(c) > 1}]) if share > 1 else F.lit(False)
    # keys between two bounds share a bucket with the upper one, which comes first: its part ends the bucket's
    dealt = dealt.withColumn("part", F.when(hot, F.floor(finer * share / float(1 << 32)).cast("int") + 1).otherwise(0))
    tops = dealt.groupBy("bucket", "part").agg(F.max(F.struct("key", "mark")).alias("top")).collect()  # as many as buckets
    tops = sorted((r.top.key, r.top.mark, r.bucket, r.part) for r in tops)
    follows = [(b, p, *tops[k - 1][:2]) for k, (_, _, b, p) in enumerate(tops)]
    spark = df.sparkSession
    ghosts = F.broadcast(spark.createDataFrame(follows, "bucket int, part int, key long, mark long"))
    full = dealt.select("doc_id", "key", "mark", "text", "bucket", "part", F.lit(0).alias("ghost"))
    copies = docs.withColumn("mark", F.xxhash64("text")).join(ghosts, ["key", "mark"]).select("doc_id", "key", "mark", "text", "bucket", "part", F.lit(1).alias("ghost"))
    both = full.unionByName(copies)
    by = Window.partitionBy("bucket", "part").orderBy("ghost", *order)
    followed = both.withColumn("next_text", F.lead("text").over(by)).where("ghost = 0")
    return followed.select("doc_id", "text", sketch(F.col("text")).alias("sketch"), "next_text", sketch(F.col("next_text")).alias("next_sketch"))


def against_edit(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, edited, sketch, edited_sketch, next_sketch): the edit replaces the last half by the next document's start."""
    pairs = with_next(df, doc_id, text)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    return pairs.withColumn("edited", edited).select("doc_id", "text", "edited", "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
