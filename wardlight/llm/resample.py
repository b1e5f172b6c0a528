"""Importance resampling of documents towards a target by hashed word features.

Features are all runs of one to ``most`` neighbouring words, repeats counted; a feature's bucket is the CRC-32 of its
UTF-8 bytes modulo ``buckets``.  A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus,
in thousandths, a document's weight the floored mean gain of its features, looked up in one constant array of
``buckets`` numbers.  Its score is the weight and a Gumbel draw from a hash of its id, so the highest scores are a sample
without replacement by weight.  The drawn documents are found without sorting the corpus: scores are whole numbers
of a range that doesn't grow with the corpus (LARGEST_GAIN and the 32 bits of the draw bound it), a histogram of them is
summed from the top, and only documents of a score that is drawn are numbered, each score by itself.

Cases.  A null text has no words, a null id is hashed as the empty text and comes first among equal scores.  Rows of one
id share its draw; rows alike in id, score and features are numbered one after the other.  Documents of fewer than ``least_words``
words are scored and never drawn.  Without target texts, gains compare the corpus with equal shares.  An empty corpus gives
an empty result.  Texts are read in slices, a very long one by itself.  Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, store

BUCKETS, LONGEST = 10_000, 2
LEAST_WORDS, PERCENT, SEED = 20, 25, "7"
#: Scores are summed by so many at a time.
BIN = 256


#: What a byte of UTF-8 becomes, and whether it belongs to a word; bytes beyond ASCII always do.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


STEPS = _steps()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return STEPS[(state ^ byte) & 0xFF] ^ (state >> 8)


def _advance(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 states after one word each, all words byte by byte at once."""
    order = np.argsort(-np.minimum(sizes, LONG_WORD + 1), kind="stable")
    out, first, size = state[order], starts[order], sizes[order]
    long = int((size > LONG_WORD).sum())
    for i in range(long):
        out[i] = zlib.crc32(buf[first[i] : first[i] + size[i]].data, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out, rest = out.copy(), slice(long, None)
    first, size, part = first[rest], size[rest], out[rest]
    for j in range(int(size[0]) if len(size) else 0):
        on = int(np.searchsorted(-size, -j, side="left"))  # words of more than j bytes come first
        part[:on] = _step(part[:on], buf[first[:on] + j])
    back = np.empty_like(out)
    back[order] = out
    return back


def feature_buckets(texts: pa.StringArray, buckets: int = BUCKETS, most: int = LONGEST) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(number of words of each text, [(text of each feature, its bucket) for runs of 1, 2, ... words])."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    data = whole.buffers()[2]
    buf = LOWER[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    on = IN_WORD[buf]
    firsts = ends[:-1][ends[:-1] < len(buf)]
    begins = on.copy()
    begins[1:] &= ~on[:-1]
    begins[firsts] = on[firsts]  # a text begins a word of its own
    after = np.zeros(len(buf), bool)
    after[:-1] = begins[1:] | ~on[1:]
    after[-1:] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(on & after) + 1
    sizes, owner = stops - starts, np.searchsorted(ends, starts, side="right") - 1
    n_words = np.bincount(owner, minlength=len(whole)).astype(np.int64)
    found, state = [], np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for n in range(most):
        if n:  # the run that begins at each word grows by a blank and the next word, within its text
            same = owner[n:] == owner[: len(owner) - n]
            state = _step(state[: len(same)], np.uint32(32))
            state = _advance(state, buf, starts[n:], sizes[n:])
        else:
            same = np.ones(len(starts), bool)
            state = _advance(state, buf, starts, sizes)
        found.append((owner[: len(same)][same], ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))[same]))
    return n_words, found


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = LONGEST) -> DataFrame:
    """(bucket, n): how many features of all texts a bucket holds, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            for _, own in feature_buckets(part.column(0), buckets, most)[1]:
                total += np.bincount(own, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = LONGEST) -> list[int]:
    """Every bucket's gain in thousandths, floored: as many numbers as buckets, whatever the tables hold."""
    s, t = ({r.bucket: r.n for r in bucket_counts(df, text, buckets, most).collect()} for df in (corpus, target))  # at most ``buckets`` rows each
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * all_s / ((s.get(b, 0) + 1) * all_t))) for b in range(buckets)]


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A Gumbel variate in thousandths, floored, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(df: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", most: int = LONGEST, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score)."""
    table, kind = np.array(gain, np.int64), df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n_words, found = feature_buckets(part.column(1), len(table), most)
            n, total = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
            for owner, own in found:
                n += np.bincount(owner, minlength=len(n))
                total += np.bincount(owner, table[own], len(n)).astype(np.int64)  # exact below 2^53
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)  # towards minus infinity
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (n_words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return own.withColumn("score", F.col("weight") + draw(F.col("doc_id"), seed))


def offsets(histogram: DataFrame) -> DataFrame:
    """(score, n, above): how many rows have a higher score; summed in bins, then within each bin."""
    binned = histogram.withColumn("bin", F.shiftright("score", BIN.bit_length() - 1))
    bins = binned.groupBy("bin").agg(F.sum("n").alias("all"))
    higher = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a few hundred bins
    bins = bins.select("bin", F.coalesce(F.sum("all").over(higher), F.lit(0)).alias("before"))
    within = Window.partitionBy("bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(F.broadcast(bins), "bin").select("score", "n", (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("above"))


def ranked(table: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``table`` (as scored() gives it, stored) with rank: 1, 2, 3... in order of score, then id; null if not drawn."""
    may = F.col("n_words") >= least_words
    # like rows are one from here on: a hot id is no hot score
    rows = table.where(may).groupBy("doc_id", "n_words", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("like"))
    histogram = table.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    wanted = percent * table.where(may).count() // 100
    cut = F.broadcast(offsets(histogram).where(F.col("above") < wanted).select("score", "above"))  # whole numbers of a fixed range
    held = rows.join(cut, "score", "left")
    before = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    drawn = held.where("above is not null").withColumn("first", F.col("above") + F.coalesce(F.sum("like").over(before), F.lit(0)) + 1)
    drawn = drawn.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("like") - 1)))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = drawn.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    none = F.lit(None).cast("long").alias("rank")
    rest = held.where("above is null").select(*columns, F.explode(F.array_repeat(none, F.col("like").cast("int"))).alias("rank"))
    return drawn.unionByName(rest).unionByName(table.where(~may).select(*columns, none))


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, most: int = LONGEST, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row for each row of ``df``."""
    table = store(scored(df, gains(df, target, text, buckets, most), doc_id, text, most, seed))
    return ranked(table, percent, least_words)
