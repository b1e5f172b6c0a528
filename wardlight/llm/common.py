"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word, once A-Z are lower-cased: a run of 0-9, a-z and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Sides of at most so many characters (or rows, where said) are broadcast; larger ones are shuffled.
BROADCAST_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty string."""
    text = F.coalesce(col, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def ascii_words(col: Column) -> Column:
    """The words (see WORD) of a whole text, in order; none for null.  Splitting is several times cheaper than matching."""
    return F.array_remove(F.split(ascii_lower(col), BETWEEN), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's spark.checkpoint.dir.

    Where that is unset a temporary folder serves in local mode; on a cluster this raises.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="wardlight-checkpoint-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder, so that lost executors lose no work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like cut(), but as a compressed table of columns: for what is read several times, a few columns at a time."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches dealt anew: of at most ``rows`` rows and about ``most`` bytes of ``column``, a longer text alone.

    Small batches that follow one another are joined, so that work done once a slice is well spread.
    """
    kept: list[pa.RecordBatch] = []
    held = n = 0

    def joined() -> pa.RecordBatch:
        return pa.concat_batches(kept) if len(kept) > 1 else kept[0]

    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        for i, size in enumerate(sizes.tolist()):
            if n and (held + size > most or n >= rows):
                if i > start:
                    kept.append(batch.slice(start, i - start))
                yield joined()
                kept, held, n, start = [], 0, 0, i
            held += size
            n += 1
        if len(sizes) > start:
            kept.append(batch.slice(start))
    if kept:
        yield joined()
    kept.clear()
    give_back()


def give_back() -> None:
    """Returns memory that was used to the system: workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def append_columns(df: DataFrame, text: str, new: str, work: Callable[[pa.StringArray], list[pa.Array]], most: int = 8_000_000) -> DataFrame:
    """``df`` with the columns ``new`` (a DDL schema) that ``work`` makes of a slice of whole texts.

    Columns of ``df`` that have the name of a new one give way to it.
    """
    fields = T._parse_datatype_string(new).fields
    kept = [c for c in df.columns if c not in {f.name for f in fields} or c == text]
    if any(f.name == text for f in fields):
        raise ValueError(f"the text column can't be named {text}")
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, *fields])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, most):
            made = work(part.column(at))
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *[f.name for f in fields]])

    return source.mapInArrow(run, schema)
