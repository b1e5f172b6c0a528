"""The queries of this package over the standard tables, and SQL for those that SQL can express.

The queries fix the contract's parameters and derive digest columns from what the operators return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licences, media, pieces, prefixes, quality, repeats, resample, simhash, sketch, sql, urlfilter
from .common import table


def remainder(by: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").cast("long").alias("first_word"),
        F.array_max("base_places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, sf_dir, "pages"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), among=remainder(3, "i") != 1)
    found = quality.score(docs, model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), langid.default_path())
    return found.drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.against_edit(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.as_hex(F.col("sketch")).alias("fingerprint"),
        sketch.as_hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketch.containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("resemblance_edited"),
        sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("resemblance_next"),
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, langid.default_path(), among=remainder(5) != 0)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.features(media.write(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("n_media").alias("media_bytes"), F.lower(F.hex("medium")).alias("media_sha256"), "feature")


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefixes.trie(prefixes.shared_heads(prefixes.numbered(table(spark, sf_dir, "conversations"))))
    return found.drop("place", "stop")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OPERATORS = (op1_licences, op2_urlfilter, op3_chat, op4_quality, op5_decontaminate, op6_pieces, op7_simhash, op8_sketch, op9_langid, op10_repeats, op11_media, op12_prefixes, op13_resample)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licences": sql.licences(),
        "op2_urlfilter": sql.urlfilter(),
        "op3_chat": sql.CHAT,
        "op5_decontaminate": sql.DECONTAMINATE,
        "op11_media": sql.MEDIA,
        "op12_prefixes": sql.TRIE,
        "op13_resample": sql.resample(),
    }
