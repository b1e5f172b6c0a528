"""Media columns in two tables: packs, a row a document, and chunks that several documents share.

A document's payload is kept as a medium, a binary greymap (PGM) of WIDTH samples of 8 bits a row.  Media are cut where a
rolling gear hash of the last 32 bytes has BITS leading zeros, so equal passages are cut alike wherever they stand.  A
pack holds its medium's ordered list of chunks (digest, size, whether its bytes stand in the pack) and the bytes of
chunks that no other place has.  Chunks that occur again are kept once, in the table of chunks.  Reading joins them by
digest, puts media together in the list's order and holds each against the digest of the whole.

Which digests occur again is told to the writers by a bitmap of 2^MARKS bits, whatever the size of the corpus: a digest that
shares its bit goes the way of repeated ones, which is longer but no less exact.  So texts are read three times, but
only what is shared moves between tasks, compressed.  Writing is deterministic: a task that is done again writes the same.

Cases.  A null text is empty; an empty payload is one row of filling.  Copies, and rows of equal ids, have a pack each
with no bytes of its own, and equal results.  Null ids are kept.  An empty table gives empty tables.  Texts are worked on
in slices, a very long one by itself.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store

WIDTH, FILLING, TAIL = 576, b"\xff", 32
#: Chunks have LEAST to MOST bytes, some 2^BITS on average beyond the least.
LEAST, MOST, BITS = 256, 16_384, 11
MARKS = 26
SLICE = 4_000_000
PACK = "n_bytes long, medium binary, n_media long, chunks array<struct<digest: binary, size: int, own: boolean>>, own_bytes binary"
CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("own", pa.bool_())]))


class Stored(NamedTuple):
    packs: DataFrame
    chunks: DataFrame


def payload(content: bytes) -> bytes:
    """The content, filled up to a positive multiple of WIDTH."""
    return content + FILLING * (max(1, -(-len(content) // WIDTH)) * WIDTH - len(content))


def encode(samples: bytes) -> bytes:
    """A greymap of WIDTH samples a row."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def decode(medium: bytes) -> bytes:
    """The samples of what encode() gives."""
    kind, size, depth, samples = medium.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("this is no greymap of 8 bits a sample")
    return samples


def _gear() -> np.ndarray:
    """A number of 32 bits for each byte: a multiplicative hash of it."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def candidates(data: bytes) -> np.ndarray:
    """Places after which data may be cut; each depends on the 32 bytes before it only."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 bytes' numbers, each shifted by its age
        older = h[:-s] << np.uint32(s)
        h = h.copy()
        h[s:] += older
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a medium."""
    may, ends, start = candidates(data).tolist(), [], 0
    while len(data) - start > LEAST:
        k = bisect.bisect_left(may, start + LEAST)
        start = min(may[k] if k < len(may) else len(data), start + MOST, len(data))
        ends.append(start)
    return [*ends, len(data)] if start < len(data) else ends


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunked(texts: pa.Array) -> Iterator[tuple[int, bytes, list[tuple[bytes, bytes]]]]:
    """(size of the content, medium, [(digest, chunk)]) of each text."""
    for text in texts.cast(pa.large_binary()).to_pylist():
        content = text or b""
        medium = encode(payload(content))
        ends = cuts(medium)
        own = [medium[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        yield len(content), medium, [(_digest(c), c) for c in own]


def _mark(digest: bytes, marks: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - marks)


def repeated(df: DataFrame, text: str = "text", marks: int = MARKS) -> np.ndarray:
    """A bitmap that has the bit of every digest that occurs more than once: 2^marks bits, put together in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            seen: dict[bytes, int] = {}
            for _, _, chunks in _chunked(part.column(0)):
                for d, _ in chunks:
                    seen[d] = seen.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([_mark(d, marks) for d in seen], pa.int64())], names=["digest", "n", "mark"])

    found = df.select(F.col(text).alias("text")).mapInArrow(run, "digest binary, n long, mark long")
    again = found.groupBy("digest", "mark").agg(F.sum("n").alias("n")).where("n > 1")
    words = again.groupBy(F.shiftright("mark", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(mark & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (marks - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def write(df: DataFrame, doc_id: str = "doc_id", text: str = "text", marks: int = MARKS) -> Stored:
    """Packs and chunks of all documents, in the shared folder; ``marks`` is 6 at least."""
    sent = df.sparkSession.sparkContext.broadcast(repeated(df, text, marks))
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def again(digest: bytes) -> bool:
        at = _mark(digest, marks)
        return bool(int(sent.value[at >> 6]) >> (at & 63) & 1)

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            rows: list[tuple] = []
            for n, medium, chunks in _chunked(part.column(1)):
                listed = [{"digest": d, "size": len(c), "own": not again(d)} for d, c in chunks]
                rows.append((n, hashlib.sha256(medium).digest(), len(medium), listed, b"".join(c for x, (_, c) in zip(listed, chunks, strict=True) if x["own"])))
            kinds = (pa.int64(), pa.binary(), pa.int64(), CHUNKS, pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *[f.split()[0] for f in ("n_bytes", "medium", "n_media", "chunks", "own_bytes")]])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for part in slices(batches, "text", SLICE):
            found = {d: c for _, _, chunks in _chunked(part.column(1)) for d, c in chunks if again(d)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([codec.compress(c, asbytes=True) for c in found.values()], pa.binary())], names=["digest", "packed"])

    return Stored(store(own.mapInArrow(packs, f"doc_id {kind}, {PACK}")), store(own.mapInArrow(shared, "digest binary, packed binary").dropDuplicates(["digest"])))


def _whole(chunks: list[dict], own: bytes, others: Callable[[int], bytes], medium: bytes) -> bytes:
    """A medium put together; its digest must be right."""
    parts, at = [], 0
    for k, c in enumerate(chunks):
        parts.append(own[at : at + c["size"]] if c["own"] else others(k))
        at += c["size"] if c["own"] else 0
    found = b"".join(parts)
    if hashlib.sha256(found).digest() != medium:
        raise ValueError(f"the chunks of medium {medium.hex()} don't make it up")
    return found


def read(stored: Stored, work: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """Packs (doc_id, n_bytes, medium, n_media) with what ``work`` makes of each medium's bytes: columns of ``schema``.

    A medium whose bytes all stand in its pack is put together where the pack is read.  Others are put together once
    each, by their digest, and their results are joined to the packs.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]
    complete = F.forall("chunks", lambda c: c["own"])
    kind = stored.packs.schema["doc_id"].dataType.simpleString()

    def made(results: list[tuple]) -> list[pa.Array]:
        return [pa.array(c) for c in zip(*results, strict=True)]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "own_bytes", SLICE):
            rows = zip(*(part.column(c).to_pylist() for c in ("chunks", "own_bytes", "medium")), strict=True)
            results = [work(_whole(chunks, own, lambda _: b"", medium)) for chunks, own, medium in rows]
            if results:
                kept = part.select(["doc_id", "n_bytes", "medium", "n_media"])
                yield pa.RecordBatch.from_arrays([*kept.columns, *made(results)], names=[*kept.schema.names, *names])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by medium and place: first the pack, then the chunks that it lacks."""
        codec, head, lacks = pa.Codec("zstd"), None, {}

        def result() -> tuple:
            return head["medium"], *work(_whole(head["chunks"], head["own_bytes"], lambda k: codec.decompress(lacks[k], head["chunks"][k]["size"], asbytes=True), head["medium"]))

        for part in slices(batches, "own_bytes", SLICE, 1024):
            done = []
            for row in part.to_pylist():
                if row["chunks"] is not None:
                    if head is not None:
                        done.append(result())
                    head, lacks = row, {}
                else:
                    lacks[row["place"]] = row["own_bytes"]
            if done:
                yield pa.RecordBatch.from_arrays(made(done), names=["medium", *names])
        if head is not None:
            yield pa.RecordBatch.from_arrays(made([result()]), names=["medium", *names])

    own = stored.packs.where(complete).mapInArrow(alone, f"doc_id {kind}, n_bytes long, medium binary, n_media long, {schema}")
    rest = stored.packs.where(~complete)
    # only copies of one medium have no bytes of their own: they are one from here on, before anything moves
    empty = F.octet_length("own_bytes") == 0
    bare = rest.where(empty).groupBy("medium").agg(F.min("chunks").alias("chunks")).withColumn("own_bytes", F.lit(b"").cast("binary"))
    heads = rest.where(~empty).select("medium", "chunks", "own_bytes").unionByName(bare)
    lists = rest.where(~empty).select("medium", "chunks").unionByName(bare.select("medium", "chunks"))
    asked = lists.select("medium", F.posexplode("chunks").alias("place", "c")).where("not c.own").select("medium", "place", F.col("c.digest").alias("digest"))
    parts = asked.join(stored.chunks, "digest").select("medium", "place", F.lit(None).cast(rest.schema["chunks"].dataType).alias("chunks"), F.col("packed").alias("own_bytes"))
    rows = heads.withColumn("place", F.lit(-1)).unionByName(parts)
    found = rows.repartition("medium").sortWithinPartitions("medium", "place").mapInArrow(together, f"medium binary, {schema}")
    return own.unionByName(rest.select("doc_id", "n_bytes", "medium", "n_media").join(found, "medium"))


def describe(medium: bytes) -> tuple:
    """(payload_bytes, payload_sha256, tail_crc32, feature) of a medium.

    The feature has a bit for each of 64 equal runs of samples, set if it is lighter than the whole, and the mean sample.
    """
    samples = decode(medium)
    runs = np.frombuffer(samples, np.uint8).reshape(64, -1).sum(1, dtype=np.int64)
    total = int(runs.sum())
    bits = "".join("1" if x else "0" for x in runs * 64 > total)
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), f"{int(bits, 2):016x}-{total // len(samples)}"


def features(stored: Stored) -> DataFrame:
    """(doc_id, n_bytes, medium, n_media, payload_bytes, payload_sha256, tail_crc32, feature) of all documents, from the stored bytes."""
    return read(stored, describe, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
