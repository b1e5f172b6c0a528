"""Chunks of text, their similarity to phrases, and the facts that follow.

Vectors are inputs.  The phrase table is a parameter: category, cat_ord, phrase_ord, phrase and vector.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import url as U
from ..functions.skew import look_up
from ..sources.shared import folder, keep

#: In the order in which chunks are made: a page's zone, and what its chunks are labelled.
ZONE_ORDER = {
    "title_text": "title",
    "iframe_text": "iframe",
    "heading_text": "heading",
    "paragraph_text": "paragraph",
    "button_text": "button",
    "link_text": "link",
    "label_text": "label",
    "placeholder_text": "placeholder",
    "footer_text": "footer",
    "image_alt_text": "imageAlt",
    "form_nearby_text": "formNearby",
}
CHUNK = "array<struct<text: string, zone: string>>"
#: Rows of phrases that are broadcast together, and scores that a task holds at once.
PHRASE_BLOCK, SCORES_AT_ONCE = 4096, 2_000_000


def windows(text: Column, size: int = 8, step: int = 4) -> Column:
    """Runs of ``size`` words, ``step`` apart; a short text is one, the last may be shorter; none for bad sizes."""
    if size < 1 or step < 1:
        return F.array().cast("array<string>")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i + (size - step) < F.size(w)))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " ")))

    return F.get(F.transform(F.array(words), cut), F.lit(0))


UNIT = "array<struct<at: bigint, zone: string, text: string>>"
#: A unit's place is its zone and its number there; a chunk's place is its unit's and its number in that.
PLACES = 29


def units(doc: Column) -> Column:
    """(at, zone, text) of the texts of a parsed page that are cut into chunks, in order: those of its zones, or its
    visible texts if all zones are empty."""
    zones, none = doc["text_zones"], F.array().cast("array<string>")
    of = lambda z: F.array_compact(F.array(zones[z])) if z == "title_text" else F.coalesce(zones[z], none)
    unit = lambda texts, nth, label: F.transform(texts, lambda t, i: F.struct((F.lit(nth << PLACES) + i).alias("at"), F.lit(label).alias("zone"), t.alias("text")))
    given = (F.coalesce(zones["title_text"], F.lit("")) != "") | F.coalesce(F.greatest(*[F.size(of(z)) for z in ZONE_ORDER if z != "title_text"]) > 0, F.lit(False))
    own = F.concat(*[unit(of(z), k, label) for k, (z, label) in enumerate(ZONE_ORDER.items())])
    return F.when(given, own).otherwise(unit(F.coalesce(doc["visible_text"], none), 0, "visibleText")).cast(UNIT)


def chunks(doc: Column, size: int = 8, step: int = 4) -> Column:
    """Chunks (text, zone) of a parsed page, unit by unit."""
    piece = lambda u: F.transform(windows(u["text"], size, step), lambda c: F.struct(c.alias("text"), u["zone"].alias("zone")))
    return F.flatten(F.transform(units(doc), piece)).cast(CHUNK)


def page_chunks(pages: DataFrame, translated: DataFrame | None = None, job_id: str = "job_id", doc: str = "doc", size: int = 8, step: int = 4) -> DataFrame:
    """(job_id, chunk_ord, zone, text) of all chunks of parsed pages; chunk_ord orders them within a page.

    ``translated``: (job_id, at, text), texts that take the place of units'.  Only texts move, not pages.
    """
    own = pages.select(F.col(job_id).alias("job_id"), F.explode(units(F.col(doc))).alias("u")).select("job_id", "u.at", "u.zone", "u.text")
    if translated is not None:
        new = translated.select(F.col("job_id").alias("__job"), F.col("at").alias("__at"), F.col("text").alias("__text"))
        own = own.join(new, (F.col("job_id") == F.col("__job")) & (F.col("at") == F.col("__at")), "left").withColumn("text", F.coalesce("__text", "text"))
    cut = own.select("job_id", "at", "zone", F.posexplode(windows(F.col("text"), size, step)).alias("nth", "text"))
    return cut.select("job_id", (F.shiftleft("at", PLACES) + F.col("nth")).alias("chunk_ord"), "zone", "text")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero if a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


class Library(NamedTuple):
    """Phrases with vectors of length one, stored in blocks."""

    path: str
    blocks: int


def _length_one(vector: Column) -> Column:
    """The vector by its length; zeros stay, and null is what holds a null or a number that isn't finite."""
    own = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.coalesce(sound, F.lit(False)), F.when(norm > 0, F.transform(own, lambda x: x / norm)).otherwise(own))


def store_library(phrases: DataFrame, path: str) -> Library:
    """Writes the phrases (category, cat_ord, phrase_ord, phrase, vector) to a folder that isn't there yet: a version.

    Vectors are brought to length one here and only here; a block is a partition of about PHRASE_BLOCK rows at most.
    """
    n = max(1, -(-phrases.count() // max(1, PHRASE_BLOCK // 2)))
    own = phrases.select("category", "cat_ord", "phrase_ord", "phrase", _length_one(F.col("vector")).alias("vector"))
    own = own.withColumn("block", F.pmod(F.xxhash64("category", "phrase_ord", "phrase"), F.lit(n)).cast("int"))
    own.repartition(n, "block").write.partitionBy("block").parquet(path)
    return Library(path, n)


def open_library(spark: SparkSession, path: str) -> Library:
    """A stored version; an error if it isn't whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        raise ValueError(f"there is no whole phrase library in {path}")
    found = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    return Library(path, max([int(x.split("=")[1]) + 1 for x in found if x.startswith("block=")], default=0))


LIBRARY = "category string, cat_ord int, phrase_ord int, phrase string, vector array<double>, block int"


def match(chunk_vectors: DataFrame, phrases: DataFrame | Library, threshold: float = fixed.LEVELS["medium"]) -> DataFrame:
    """For each job and category the best (phrase, score, chunk): the score is rounded to four places, then held against
    the threshold; of equal scores the earlier chunk, then the earlier phrase wins.

    ``chunk_vectors``: job_id, chunk_ord, zone, text, vector.  ``phrases`` is a stated query set, as a table or a stored
    library: a block of at most some ``PHRASE_BLOCK`` of its rows is broadcast at a time, and every chunk meets it as a
    product of matrices; with several blocks each one's hits are kept before the next is read.
    Vectors that are null, or hold a null or a number that isn't finite, match nothing, nor do those of unequal length;
    a vector of zeros has the score 0.  Without phrases nothing matches.
    """
    kept = _hits(chunk_vectors.select("job_id", "chunk_ord", "zone", "text", "vector"), phrases, threshold)
    return _best(kept)


def _best(kept: DataFrame) -> DataFrame:
    best = F.max(F.struct(F.col("score"), (-F.col("chunk_ord")).alias("c"), (-F.col("phrase_ord")).alias("p"), F.col("phrase"), F.col("text").alias("chunk"), F.col("zone")))
    out = kept.groupBy("job_id", "category", "cat_ord").agg(best.alias("b"))
    return out.select("job_id", "category", "cat_ord", F.col("b.score").alias("score"), F.col("b.phrase").alias("phrase"), F.col("b.chunk").alias("chunk"), F.col("b.zone").alias("zone"))


def match_texts(chunks_: DataFrame, vectors: DataFrame, phrases: DataFrame | Library, threshold: float = fixed.LEVELS["medium"]) -> DataFrame:
    """match() for chunks (job_id, chunk_ord, zone, text) whose vectors are looked up by what they say.

    ``vectors``: (text, vector); of several vectors of a text the smallest counts, a chunk without one matches nothing.
    A text that many pages have meets the phrases once; what it hits goes back to its places over split keys.
    """
    keyed = chunks_.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    known = vectors.groupBy(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")).agg(F.min("vector").alias("vector"))
    texts = known.join(keyed.select("key").distinct(), "key", "left_semi")
    hits = _hits(texts, phrases, threshold)
    found = hits.groupBy("key").agg(F.collect_list(F.struct("category", "cat_ord", "phrase_ord", "phrase", "score")).alias("hits"))  # one a category and block
    placed = look_up(keyed, found, "key", F.struct("job_id", "chunk_ord")).select("job_id", "chunk_ord", "zone", "text", F.explode("hits").alias("h"))
    return _best(placed.select("job_id", "chunk_ord", "zone", "text", "h.*"))


def _hits(rows: DataFrame, phrases: DataFrame | Library, threshold: float) -> DataFrame:
    """``rows`` (with a vector) by what each hits: a row for each category of a block whose best phrase reaches the threshold."""
    spark = rows.sparkSession
    if isinstance(phrases, DataFrame):
        first = phrases.select("category", "cat_ord", "phrase_ord", "phrase", "vector").limit(PHRASE_BLOCK + 1).toArrow()
        if first.num_rows <= PHRASE_BLOCK:
            return _block_hits(rows, first, threshold)[0]
        types = ", ".join(f"{c} {phrases.schema[c].dataType.simpleString()}" for c in ("category", "cat_ord", "phrase_ord", "phrase"))
        phrases, schema = store_library(phrases, f"{folder(spark)}/kept-library-{uuid.uuid4()}"), f"{types}, vector array<double>, block int"
    else:
        schema = LIBRARY
    table = spark.read.schema(schema).parquet(phrases.path)
    parts = []
    for k in range(phrases.blocks):
        found, sent = _block_hits(rows, table.where(F.col("block") == k).drop("block").toArrow(), threshold)
        if phrases.blocks > 1:
            found = keep(found)
            sent.destroy()
        parts.append(found)
    return reduce(DataFrame.unionAll, parts)


def _matrices(vectors: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors of length one or of zeros) for each length that a vector has."""
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False)
    values = whole.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        m = values[starts[rows][:, None] + np.arange(size)]
        sound = np.isfinite(m).all(1)
        rows, m = rows[sound], m[sound]
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        yield rows, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _block_hits(rows: DataFrame, block: pa.Table, threshold: float) -> tuple[DataFrame, object]:
    """A row for each of ``rows`` and category of the block whose best phrase reaches the threshold; and the broadcast."""
    block = block.sort_by([("category", "ascending"), ("cat_ord", "ascending"), ("phrase_ord", "ascending"), ("phrase", "descending")])
    sent = rows.sparkSession.sparkContext.broadcast(block)
    kept = [c for c in rows.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sent.value
        groups = list(zip(library["category"].to_pylist(), library["cat_ord"].to_pylist(), strict=True))
        sides = {m.shape[1]: (at, m) for at, m in _matrices(library["vector"])}
        step = max(1, SCORES_AT_ONCE // max(1, library.num_rows))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for own, m in _matrices(part.column("vector")):
                    if m.shape[1] not in sides or not len(own):
                        continue
                    of, n = sides[m.shape[1]]
                    scores = np.floor(m @ n.T * 1e4 + 0.5) / 1e4
                    ends = [i for i in range(1, len(of) + 1) if i == len(of) or groups[of[i]] != groups[of[i - 1]]]
                    for a, b in zip([0, *ends], ends, strict=False):
                        best = scores[:, a:b].argmax(1)
                        score = scores[np.arange(len(own)), a + best]
                        on = score >= threshold
                        if on.any():
                            left = part.select(kept).take(pa.array(own[on]))
                            right = library.select(["category", "cat_ord", "phrase_ord", "phrase"]).take(pa.array(of[a + best[on]])).combine_chunks()
                            columns = [*left.columns, *[c.chunk(0) for c in right.columns], pa.array(score[on])]
                            yield pa.RecordBatch.from_arrays(columns, names=[*left.schema.names, *right.schema.names, "score"])

    integer = {"int32": "int", "int64": "bigint", "int16": "smallint"}
    order = {c: integer.get(str(block.schema.field(c).type), "bigint") for c in ("cat_ord", "phrase_ord")}
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"category string, cat_ord {order['cat_ord']}, phrase_ord {order['phrase_ord']}, phrase string, score double"])
    return rows.select(*kept, "vector").mapInArrow(run, schema), sent


def derive(matches: DataFrame) -> DataFrame:
    """(job_id, scores, facts): scores by concept, and the facts that they give, in the rules' order."""
    scores = matches.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("scores"))
    reaches = lambda concepts, level: F.coalesce(F.greatest(*[F.coalesce(F.try_element_at("scores", F.lit(c)), F.lit(0.0)) for c in [*concepts, *concepts][: max(2, len(concepts))]]) >= fixed.LEVELS[level], F.lit(False))
    facts = F.array_compact(F.array(*[F.when(reaches(c, level), F.lit(name)) for name, c, level in fixed.CONCEPT_FACTS]))
    return scores.withColumn("facts", facts)


def evidence(derived: DataFrame, matches: DataFrame, rules: list[tuple[str, list[str], str]] | None = None) -> DataFrame:
    """(job_id, fact, concept, score, phrase, chunk, zone): for each fact the concept with the best score, earlier ones winning."""
    rules = rules if rules is not None else fixed.CONCEPT_FACTS
    table = derived.sparkSession.createDataFrame([(f, c, i) for f, concepts, _ in rules for i, c in enumerate(concepts)], "fact string, category string, concept_ord int")
    each = derived.select("job_id", F.explode("facts").alias("fact")).join(F.broadcast(table), "fact").join(matches, ["job_id", "category"])
    best = F.max_by(F.struct("category", "score", "phrase", "chunk", "zone"), F.struct(F.col("score"), -F.col("concept_ord"))).alias("b")
    return each.groupBy("job_id", "fact").agg(best).select("job_id", "fact", F.col("b.category").alias("concept"), "b.score", "b.phrase", "b.chunk", "b.zone")


# --- logo ------------------------------------------------------------------------------------------------------------

LOGO_CANDIDATES, LOGO_COSINE = 15, 0.8


def brand_tokens(names: Column) -> Column:
    """Names in letters, digits and blanks, their parts of two characters or more, and they without blanks, lower-cased."""
    plain = F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(F.lower(F.coalesce(n, F.lit(""))), r"[^a-z0-9]+", " "))), lambda n: n != "")
    parts = lambda n: F.filter(F.split(n, " "), lambda p: F.length(p) >= 2)
    compact = lambda n: F.filter(F.array(F.replace(n, F.lit(" "), F.lit(""))), lambda p: F.length(p) >= 2)
    return F.array_distinct(F.flatten(F.transform(plain, lambda n: F.concat(F.array(n), parts(n), compact(n)))))


def logo_rank(image: Column, tokens: Column, url: Column | None = None) -> Column:
    """0 icon, 1 brand or the word logo in the alternative text, 2 brand or logo in address, class or id, 3 shared image, 4 the rest.

    ``url``: the image's absolute address, of which the host doesn't count, but for "logo".
    """
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    mentions = lambda c: F.exists(tokens, lambda t: c.contains(t))
    word = lambda c: c.rlike(r"\blogo\b")
    address = F.coalesce(url, image["src"])
    path = F.regexp_replace(F.regexp_replace(text(address), r"^https?://[^/?#]*", ""), "#.*$", "")
    path = F.coalesce(F.lower(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))), path)
    named = text(F.concat_ws(" ", F.coalesce(image["class_name"], F.lit("")), F.coalesce(image["id"], F.lit(""))))
    icon = (image["kind"] == "icon") | text(image["rel"]).rlike(r"\bicon\b|apple-touch-icon")
    return (
        F.when(icon, 0)
        .when(word(text(image["alt"])) | mentions(text(image["alt"])), 1)
        .when(text(address).contains("logo") | mentions(path) | mentions(named) | word(named), 2)
        .when(image["kind"] == "og", 3)
        .otherwise(4)
    )


def is_svg(url: Column) -> Column:
    """An address of a vector image, which has to be drawn before it has a vector of its own."""
    low = F.lower(F.coalesce(url, F.lit("")))
    path = F.regexp_replace(F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return low.startswith("data:image/svg") | path.endswith(".svg")


def image_candidates(pages: DataFrame, job_id: str = "job_id", url: str = "url", images: str = "images", names: str = "brand_names", most: int = LOGO_CANDIDATES) -> DataFrame:
    """(job_id, url, kind, rank, place, svg): the ``most`` best images of each page, by rank and address.

    Addresses are absolute; of several images with one address the first counts.  Each task keeps no more than ``most`` rows of a
    page before any row moves, so no page's images are ever held together.
    """
    each = pages.select(F.col(job_id).alias("job_id"), F.col(url).alias("__base"), brand_tokens(F.col(names)).alias("__tokens"), F.posexplode(images).alias("__nth", "__image"))
    src = F.trim(F.coalesce("__image.src", F.lit("")))
    each = each.withColumn("url", F.when((src == "") | src.startswith("data:"), src).otherwise(F.coalesce(U.resolve(src, F.col("__base")), src))).where("url <> ''")
    ranked = each.select("job_id", "url", "__nth", F.col("__image.kind").alias("kind"), logo_rank(F.col("__image"), F.col("__tokens"), F.col("url")).alias("rank"))
    first = ranked.groupBy("job_id", "url").agg(F.min_by(F.struct("kind", "rank"), "__nth").alias("x")).select("job_id", "url", "x.kind", "x.rank")
    order = Window.partitionBy("job_id").orderBy("rank", F.collate("url", "UNICODE"), "url")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).withColumn("svg", is_svg(F.col("url")))


def find_logo(candidates: DataFrame, vectors: DataFrame, most: int = LOGO_CANDIDATES, least: float = LOGO_COSINE) -> DataFrame:
    """(job_id, detected, image, similarity, checked): the first of a job's best-ranked images that is like its logo.

    ``candidates``: job_id, url, rank, logo_vector; ``vectors``: url, vector; an image without one is passed over.
    The first ``most`` by rank and url (in Unicode order) are looked at, as that is what the operator does.  An image that very many
    pages have is looked up over several tasks; of several vectors of an image the smallest counts.
    """
    ranked = candidates.groupBy("job_id", "url").agg(F.min("rank").alias("rank"), F.min("logo_vector").alias("logo_vector"))
    order = Window.partitionBy("job_id").orderBy("rank", F.collate("url", "UNICODE"), "url")
    each = ranked.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most)
    known = vectors.groupBy("url").agg(F.min("vector").alias("vector"))
    scored = look_up(each, known, "url", F.col("job_id")).withColumn("similarity", F.round(cosine(F.col("logo_vector"), F.col("vector")), 4))
    good = F.col("similarity") >= least
    out = scored.groupBy("job_id").agg(F.min(F.when(good, F.struct("pos", "url", "similarity"))).alias("w"), F.count(F.lit(1)).alias("n"))
    return out.select("job_id", F.col("w").isNotNull().alias("detected"), F.col("w.url").alias("image"), F.col("w.similarity").alias("similarity"), F.coalesce(F.col("w.pos"), "n").cast("long").alias("checked"))
