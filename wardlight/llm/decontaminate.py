"""Benchmark decontamination with a distributed positional inverted index.

Texts are cut into words once.  What is stored of a document is a code for the word at every position: XXH64 of a word that
the benchmark may have, zero for any other; so a shard of this table holds the positions of all test terms in its documents,
and nothing has to move for the lists of one document to meet.  Corpus counts of the test terms come from the table.
Each window of an item (a run of ``window`` words; an item of fewer is one window) is sought from its rarest term:
that term's postings are read, with the codes around them, and the lists of the window's other terms are intersected at
their offsets, rarest first.  What agrees everywhere is a phrase match.

A proximity match needs ``least`` different words of the window within ``slack`` words of where they would stand around
one of its rarest terms, in any order: so many of the rarest terms serve as anchors that every such place has one.

Test terms reach the scan as bitmaps of at most BITS bits, whatever the benchmark's size.  Windows are broadcast if they
have at most BROADCAST_CHARS characters; more are joined by a shuffle of the rare terms' postings alone.

Cases.  Null and empty texts have no words and no match; null and empty items have no window.  Repeated items count
once (by id), repeated rows of documents get equal answers; rows are told apart by id (null is one) and XXH64 of the
text.  A window with a word that the corpus doesn't have can't occur.  Equal counts go to the word that comes first in the
window.  Words are compared by 64 bits.  Empty tables give empty results or no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_CHARS, ascii_words, store

WINDOW, LEAST, SLACK = 10, 8, 2
#: Bits of a bitmap: 32 for each term, within these bounds.
LEAST_BITS, BITS = 1 << 12, 1 << 22


def _codes(text: Column) -> Column:
    return F.transform(ascii_words(text), lambda w: F.xxhash64(w))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, terms): the distinct windows of every item, as the codes of their words."""
    own = items.select(F.col(item_id).cast("string").alias("item"), _codes(F.col(text)).alias("c")).where("size(c) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("c") - window, F.lit(0)))
    return own.select("item", F.explode(F.transform(starts, lambda i: F.slice("c", i + 1, F.lit(window)))).alias("terms")).distinct()


def _member(terms: DataFrame):
    """A test whether a code may be among ``terms`` (column term); at most BITS / 64 numbers reach the driver."""
    bits = LEAST_BITS
    n = terms.count()
    while bits < min(BITS, 32 * n):
        bits *= 2
    cell = F.shiftright(F.col("term").bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("term").bitwiseAND(F.lit(63)).cast("int"))
    cells = [0] * (bits // 64)
    for r in terms.select(cell.alias("cell"), one.alias("one")).groupBy("cell").agg(F.bit_or("one").alias("set")).collect():
        cells[r.cell] = r.set
    bitmap = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")  # folded to one constant

    def test(code: Column) -> Column:
        place = F.get(bitmap, F.shiftright(code.bitwiseAND(F.lit(bits - 1)), 6).cast("int"))
        return F.call_function("shiftrightunsigned", place, code.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return test


def index(docs: DataFrame, parts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, codes), a row for each row of ``docs``, stored: a code for every word, zero if no window has it."""
    known = _member(parts.select(F.explode("terms").alias("term")).distinct())
    codes = F.transform(_codes(F.col(text)), lambda c: F.when(known(c), c).otherwise(F.lit(0).cast("long")))
    return store(docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("mark"), codes.alias("codes")))


def _small(parts: DataFrame) -> bool:
    return (parts.agg(F.sum(F.size("terms") * 8 + F.length("item"))).first()[0] or 0) <= BROADCAST_CHARS


def matches(stored: DataFrame, parts: DataFrame, window: int = WINDOW, least: int | None = None, slack: int = SLACK) -> DataFrame:
    """(id, mark, item, start, length, kind): where windows of ``parts`` occur in the documents of an index.

    kind is phrase; with ``least`` there are proximity matches as well, which needn't exclude phrases.
    """
    side = F.broadcast if _small(parts) else (lambda df: df)
    known = parts.select(F.explode("terms").alias("term")).distinct()
    # explode_outer: a plain explode would be given a filter on the array's size
    counts = stored.select(F.explode_outer("codes").alias("term")).join(side(known), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = parts.select("item", "terms", F.posexplode("terms").alias("offset", "term"))
    first = placed.groupBy("item", "terms", "term").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("times"))
    found = first.join(side(counts), "term").groupBy("item", "terms").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("rare"), F.sum("times").alias("have"))
    wanted = F.least(F.lit(least or window), F.size(F.array_distinct("terms")))
    anchors = F.lit(1) if least is None else F.greatest(F.size("rare") - wanted + 1, F.lit(0))
    whole = F.col("have") == F.size("terms")
    lists = found.where(whole) if least is None else found
    lists = lists.select("item", "terms", "rare", wanted.alias("wanted"), whole.alias("whole"), F.posexplode(F.slice("rare", F.lit(1), anchors)).alias("nth", "anchor"))
    lists = lists.select("item", "terms", "rare", "wanted", "whole", "nth", "anchor.offset", "anchor.term")
    rare = _member(lists.select("term").distinct())
    reach = window - 1 + (slack if least else 0)
    # positions of rare terms, with the codes around them: nothing else is moved
    hits = F.filter(F.transform("codes", lambda c, i: F.when(rare(c), i)), lambda i: i.isNotNull())
    near = F.transform(hits, lambda i: F.struct(F.get("codes", i).alias("term"), i.alias("position"), F.slice("codes", F.greatest(i - reach, F.lit(0)) + 1, reach + 1 + F.least(i, F.lit(reach))).alias("around")))
    postings = stored.select("id", "mark", F.explode_outer(near).alias("p")).select("id", "mark", "p.*")
    start = F.col("position") - F.col("offset")
    at = F.least(F.col("position"), F.lit(reach)) - F.col("offset")  # of the window's first word in around
    fits = F.forall("rare", lambda r: F.get("around", at + r["offset"]) == r["term"])
    # the lists of the different terms first, then repeated words
    phrase = F.col("whole") & (F.col("nth") == 0) & (at >= 0) & F.coalesce(fits, F.lit(False)) & (F.slice("around", F.greatest(at, F.lit(0)) + 1, F.size("terms")) == F.col("terms"))
    joined = postings.join(side(lists), "term")
    exact = joined.where(phrase).select("id", "mark", "item", start.alias("start"), F.size("terms").alias("length"), F.lit("phrase").alias("kind"))
    if least is None:
        return exact
    low = F.greatest(at - slack, F.lit(0))
    within = F.slice("around", low + 1, at + F.size("terms") + slack - low)
    close = F.size(F.array_intersect("terms", within)) >= F.col("wanted")
    loose = joined.where(phrase | close).select("id", "mark", "item", start.alias("start"), F.size("terms").alias("length"), F.when(phrase, "phrase").otherwise("proximity").alias("kind"))
    return loose


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, least: int | None = LEAST, slack: int = SLACK) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near), a row for each row of ``docs``: words inside phrase matches, the items of
    these, sorted, and the items of phrase or proximity matches, sorted."""
    parts = windows(items, item_id, item_text, window)
    stored = index(docs, parts, doc_id, text)
    found = matches(stored, parts, window, least, slack)
    exact = F.col("kind") == "phrase"
    spans = F.collect_set(F.when(exact, F.struct("start", "length")))
    marks = found.groupBy("id", "mark").agg(spans.alias("spans"), F.collect_set(F.when(exact, F.col("item"))).alias("items"), F.collect_set("item").alias("near"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach"))
    united = F.aggregate(
        F.sort_array("spans"),
        zero,
        lambda a, s: F.struct((a["hit"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], a["reach"]), F.lit(0))).cast("long").alias("hit"), F.greatest(a["reach"], s["start"] + s["length"]).alias("reach")),
    )["hit"]
    marks = marks.select(F.col("id").alias("of"), F.col("mark").alias("text_mark"), united.alias("n_hit"), F.sort_array("items").alias("items"), F.sort_array("near").alias("near"))
    rows = stored.select(F.col("id").alias("doc_id"), "mark", F.size("codes").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    # texts without words, however many, meet nobody
    met = rows.where("n_words > 0").join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("text_mark")), "left")
    met = met.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))
    return met.unionByName(rows.where("n_words = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), none.alias("near")))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    parts = windows(items, item_id, item_text, window)
    hit = matches(index(docs, parts, doc_id, text), parts, window).select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    own = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__mark"))
    return docs.join(hit, own, "left_anti")
