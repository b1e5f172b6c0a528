"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two halves of 32 bits.  If two fingerprints differ in at most 4 bits, one of their
halves differs in at most 2, so the balls of radius 1 around those halves meet.  Every distinct fingerprint
therefore enters the table under each key of its balls (33 a half); entries under one key are fetched by an
equi-join and the complete distance is verified inside that join.  Keys have 32 bits, so chance meetings stay
rare, and a set of distinct fingerprints within 4 bits of one another is bounded by the code, not by the data:
exact copies, and texts of one fingerprint, are a single entry.

Cases.  Null and empty texts have no word and fingerprint zero, linked like any other.  Fewer than four words
make one shingle.  Rows with the same fingerprint, repeated rows among them, share a component.  Null ids take
part in links; a component's id is the smallest id that isn't null, and null if there is none.  An empty table
gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

SHINGLE, SEED, LINK_BITS = 4, 42, 4
HALF, RADIUS = 32, 1
SALTS = 16


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = np.array([digest(line, SEED)], np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(line)]
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    # blocks, so that a very long text doesn't need a byte for each bit of all its hashes at once
    ones = sum(np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(hashes), 65536))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits): the fingerprint of every whole text, as a signed 64-bit number."""
    return _prints(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), shingle)


def _prints(df: DataFrame, shingle: int) -> DataFrame:
    """``df`` (doc_id, text, others) with bits instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values = np.fromiter((text_fingerprint(x.as_py(), shingle) for x in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64)), *part.columns[2:]], names=["doc_id", "bits", *part.schema.names[2:]])

    others = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[2:]]
    return df.mapInArrow(run, ", ".join(["doc_id long", "bits long", *others]))


def links(distinct_bits: DataFrame, within: int = LINK_BITS) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints (column bits) that differ in ``within`` bits or fewer.

    A pair comes once.  ``within`` can be at most 5: two balls of radius 1 cover no more.
    """
    if within > 2 * (2 * RADIUS + 1) - 1:
        raise ValueError("balls of radius 1 in two halves find up to 5 differing bits")
    flips = [0, *(1 << i for i in range(HALF))]
    ball = F.array(*[F.lit(x).cast("long") for x in flips])
    entries = distinct_bits.select(
        "bits",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("byte").alias("half"), F.col("bits").bitwiseAND(F.lit((1 << HALF) - 1)).alias("key")),
                F.struct(F.lit(1).cast("byte").alias("half"), F.shiftrightunsigned("bits", HALF).alias("key")),
            )
        ).alias("part"),
    ).select("bits", "part.half", "part.key", F.explode(ball).alias("flip")).select("bits", "half", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    a, b = entries.select("half", "key", F.col("bits").alias("a")), entries.select("half", "key", F.col("bits").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low, high = differ.bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned(differ, HALF)
    # two balls share several keys: of these the pair is fetched under one, in the first half that can show it
    in_low = F.bit_count(low) <= 2 * RADIUS
    part, own = F.when(in_low, low).otherwise(high), F.when(in_low, F.col("a").bitwiseAND(F.lit((1 << HALF) - 1))).otherwise(F.shiftrightunsigned("a", HALF))
    one_key = own.bitwiseXOR(F.when(F.bit_count(part) == 2, part.bitwiseAND(-part)).otherwise(F.lit(0).cast("long")))
    once = (a["half"] == F.when(in_low, 0).otherwise(1)) & (a["key"] == one_key)
    near = (a["half"] == b["half"]) & (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= within) & once
    return a.join(b, near).select("a", "b")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b: long, not null).

    Alternating star contractions; every round is checkpointed, and the number of rounds grows with the
    logarithm of the longest chain.  Only counts reach the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = (state.n, state.h)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(down.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        now = cut(small)
    raise RuntimeError("the star contraction did not settle")


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", within: int = LINK_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits, component_id), a row for each row of ``df``."""
    prints = cut(fingerprints(df, doc_id, text, shingle))
    classes = cut(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    linked = cut(_rooted(classes, within))
    # a large component is dealt over SALTS tasks; only linked classes have one to look up
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = linked.withColumn("salt", F.pmod(F.xxhash64("bits"), F.lit(SALTS)).cast("int")).join(ids, ["root", "salt"]).select(F.col("bits").alias("node"), "component_id")
    whole = classes.join(found, classes["bits"] == found["node"], "left").select("bits", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(whole, "bits").select("doc_id", "bits", "component_id")


def _rooted(classes: DataFrame, within: int) -> DataFrame:
    """Those of ``classes`` (bits, least; distinct bits) that are linked, with the root of their component."""
    roots = connected(links(classes.select("bits"), within))
    return classes.join(roots, classes["bits"] == roots["node"]).select("bits", "least", "root")


def fingerprint_hex(bits: str = "bits"):
    return F.lower(F.lpad(F.hex(F.col(bits)), 16, "0"))


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", within: int = LINK_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` that stay: one of each component, that with the smallest id.

    Rows are told apart by id and text (96 bits of its hashes), as an id can be null or stand in several components.
    Null ids come last, so a row without an id stays where all ids of its component are null.  Of unequal texts of
    one id, the one of the smallest hash stays.
    """
    own_id, own_text = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")
    marks = {"__null": own_id.isNull(), "__id": F.coalesce(own_id, F.lit(0)), "__mark": F.xxhash64(own_text), "__mark2": F.hash(own_text)}
    prints = cut(_prints(df.select(own_id.alias("doc_id"), own_text.alias("text"), *[m.alias(k) for k, m in marks.items()]), shingle))
    classes = cut(prints.groupBy("bits").agg(F.min(F.struct(*marks)).alias("least")))
    linked = cut(_rooted(classes, within))
    alone = classes.join(linked.select("bits"), "bits", "left_anti").select("least.*")
    stay = alone.unionByName(linked.groupBy("root").agg(F.min("least").alias("least")).select("least.*"))
    # repeated rows shrink within each slice before the shuffle; the join needs no other one
    rows = df.withColumns(marks).dropDuplicates(list(marks))
    return rows.join(stay, list(marks), "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
