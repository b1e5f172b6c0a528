"""A training corpus from the table documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents (the last one
more); its result is written and read again as the next one's docs.  Rows that are null, empty, tied or repeated are
treated as the operators say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import decontaminate, langid, pieces, repeats, simhash
from wardlight.llm.common import store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction of less than this share of the likelihood is no language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no certain language, go."""
    model = langid.train(docs, langid.default_path())
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.representatives(docs.select(*COLUMNS)).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier place has are cut out; documents of which nothing is left go.

    Of a character that is cut in two nothing stays.
    """
    found = repeats.remove_repeats(docs.select(*COLUMNS), others=True)
    found = found.where("n_removed = 0 or n_removed < n_bytes").select("doc_id", F.col("kept_text").alias("text"), "others.lang", "others.source")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item (or a shorter item) go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as their pieces decode, with the number and digest of the ids."""
    found = pieces.round_trip(docs.select(*COLUMNS), langid.default_path(), with_text=True)
    return found.select("doc_id", F.col("decoded").alias("text"), "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", encoding),
]

#: Trained language models, fingerprints of 64 bits and merge rounds have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs)
    return docs
