"""Page language, and packing of texts for a translator.

The translator itself is a table: (lang, text, translated).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import look_up
from ..functions.text import bind
from ..sources.shared import keep
from .html import DOC
from .semantic import ZONE_ORDER, units

# Languages that the translator takes.
SUPPORTED = "zh zh-Hant en ja ko de fr es it pt ru th vi ar cs da fi hr hu id ms nb nl pl ro sv".split()
SLICE, SOLO, PACK_ITEMS, PACK_CHARS, MARK = 900, 80, 8, 900, 6
TEXTS = "array<string>"


def html_lang(html: Column) -> Column:
    """The page's declared language, lower-cased; "" without one."""
    h = F.coalesce(html, F.lit(""))
    quote = "[\"']?"
    patterns = (
        rf"(?i)<html\b[^>]*\blang\s*=\s*{quote}\s*([a-zA-Z-]+)",
        rf"(?i)\bxml:lang\s*=\s*{quote}\s*([a-zA-Z-]+)",
        rf"(?i)<meta\b[^>]*http-equiv\s*=\s*{quote}content-language{quote}[^>]*content\s*=\s*{quote}\s*([a-zA-Z-]+)",
        rf"(?i)<meta\b[^>]*content\s*=\s*{quote}\s*([a-zA-Z-]+){quote}[^>]*http-equiv\s*=\s*{quote}content-language",
    )
    return F.lower(F.coalesce(*[F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in patterns], F.lit("")))


def source_language(lang: Column) -> Column:
    """What to translate from; null for English and languages that aren't supported."""
    low = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    primary = F.split_part(low, F.lit("-"), F.lit(1))
    return F.when(low.isin("zh-tw", "zh-hk", "zh-mo") | low.startswith("zh-hant"), "zh-Hant").when((primary != "en") & primary.isin(*[s for s in SUPPORTED if s != "zh-Hant"]), primary)


def safe_piece(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\[(\d+)\]\]", "[[ $1 ]]")


def pack(batch: Column) -> Column:
    return F.array_join(F.transform(batch, lambda t, i: F.concat(F.lit("[["), i.cast("string"), F.lit("]]"), t)), "")


def unpack(text: Column, n: Column) -> Column:
    """The ``n`` pieces of a packed text, trimmed; null if a mark is missing.  Of equal marks the last counts."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(r"\[\[(\d+)\]\]"), F.lit(1))
    parts = F.slice(F.split(text, r"\[\[\d+\]\]"), 2, F.greatest(F.size(marks), F.lit(1)))
    pairs = F.reverse(F.zip_with(marks, parts, lambda m, t: F.struct(m.try_cast("int").alias("m"), F.trim(t).alias("t"))))
    piece = lambda i: F.get(F.transform(F.filter(pairs, lambda p: p["m"] == i), lambda p: p["t"]), F.lit(0))
    many = F.transform(F.sequence(F.lit(0), n - 1), piece)
    one = F.array(F.trim(F.regexp_replace(F.trim(text), r"^\[\[0\]\]", "")))
    return F.when(n == 1, one).when(~F.exists(many, lambda p: p.isNull()), many)


def batches(texts: Column) -> Column:
    """Texts in packs: longer than SLICE cut and alone, longer than SOLO alone, others up to PACK_ITEMS and PACK_CHARS."""
    kind = "struct<done: array<array<string>>, open: array<string>, size: int>"
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast(TEXTS).alias("open"), F.lit(0).alias("size")).cast(kind)

    def flushed(a: Column) -> Column:
        return F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])

    def state(done: Column, open_: Column, size: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), size.cast("int").alias("size")).cast(kind)

    def step(a: Column, raw: Column) -> Column:
        s = safe_piece(raw)
        n, none = F.length(s), F.array().cast(TEXTS)
        cuts = F.transform(F.sequence(F.lit(0), F.greatest((n - 1), F.lit(0)), F.lit(SLICE)), lambda i: F.array(F.substring(s, i + 1, F.lit(SLICE))))
        full = (F.size(a["open"]) > 0) & ((F.size(a["open"]) >= PACK_ITEMS) | (a["size"] + n + MARK > PACK_CHARS))
        return (
            F.when(n > SLICE, state(F.concat(flushed(a), cuts), none, F.lit(0)))
            .when(n > SOLO, state(F.concat(flushed(a), F.array(F.array(s))), none, F.lit(0)))
            .when(full, state(flushed(a), F.array(s), n + MARK))
            .otherwise(state(a["done"], F.concat(a["open"], F.array(s)), a["size"] + n + MARK))
        )

    return F.aggregate(texts, zero, step, flushed)


def flatten_texts(doc: Column) -> Column:
    """(kind, key, pos, text) of all of a parsed page's texts, in a fixed order."""
    item = lambda kind, key, pos, text: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), pos.cast("int").alias("pos"), text.alias("text"))
    one = lambda kind, text: F.array(F.when(F.trim(F.coalesce(text, F.lit(""))) != "", item(kind, "", F.lit(None), text)))
    many = lambda kind, key, texts: F.transform(F.coalesce(texts, F.array().cast(TEXTS)), lambda t, i: item(kind, key, i, t))
    zones = [F.array(F.when(doc["text_zones"]["title_text"].isNotNull(), item("zone", "title_text", F.lit(None), doc["text_zones"]["title_text"])))]
    zones += [many("zone", z, doc["text_zones"][z]) for z in ZONE_ORDER if z != "title_text"]
    return F.array_compact(F.concat(one("body_text", doc["body_text"]), one("analysis_text", doc["analysis_text"]), one("rendered_text", doc["rendered_text"]), many("visible_text", "", doc["visible_text"]), *zones))


def rebuild(doc: Column, flat: Column) -> Column:
    """A parsed page with its texts replaced by those of ``flat`` (as flatten_texts gives them)."""
    of = lambda kind, key="": F.transform(F.array_sort(F.filter(flat, lambda x: (x["kind"] == kind) & (x["key"] == key)), lambda a, b: F.coalesce(a["pos"], F.lit(0)) - F.coalesce(b["pos"], F.lit(0))), lambda x: x["text"])
    one = lambda kind, old, key="": F.coalesce(F.get(of(kind, key), F.lit(0)), old)
    zones = {z: one("zone", doc["text_zones"][z], z) if z == "title_text" else of("zone", z) for z in ZONE_ORDER}
    new = {kind: one(kind, doc[kind]) for kind in ("body_text", "analysis_text", "rendered_text")}
    new["visible_text"] = of("visible_text")
    order = [f.name for f in T._parse_datatype_string(DOC)["text_zones"].dataType]
    new["text_zones"] = F.struct(*[zones[z].alias(z) for z in order])
    return F.struct(*[new.get(f.name, doc[f.name]).alias(f.name) for f in T._parse_datatype_string(DOC)])


# --- what a translator answered --------------------------------------------------------------------------------------


def text_key(lang: Column, text: Column) -> Column:
    """What a text of a language is stored under: SHA-256 of both."""
    return F.unhex(F.sha2(F.concat(F.coalesce(lang, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))).cast("binary"), 256))


def answer_store(answers: DataFrame) -> DataFrame:
    """(key, translated), a row for each text of a language in ``answers`` (lang, text, translated).

    Of several answers the smallest counts, null ones don't: a text without an answer has no row.
    """
    keyed = answers.where("translated is not null").select(text_key(F.col("lang"), F.col("text")).alias("key"), "translated")
    return keyed.groupBy("key").agg(F.min("translated").alias("translated"))


def page_packs(pages: DataFrame, page: str = "page", lang: str = "lang", texts: str = "texts") -> DataFrame:
    """(page, lang, nth, pieces): each page's texts in packs; pages of no language to translate from have none."""
    return pages.where(F.col(lang).isNotNull()).select(F.col(page).alias("page"), F.col(lang).alias("lang"), F.posexplode(batches(F.col(texts))).alias("nth", "pieces"))


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def question(pieces: Column) -> Column:
    """What is asked for a pack first: its pieces between marks, a single piece as it is; null if all are blank."""
    return F.when(F.exists(pieces, lambda t: ~_blank(t)), F.when(F.size(pieces) == 1, F.get(pieces, F.lit(0))).otherwise(pack(pieces)))


def _first_pass(packs: DataFrame, store: DataFrame) -> DataFrame:
    """``packs`` with translated (an array, null where the marks are lost or nothing was answered) and why (an array)."""
    asked = packs.withColumn("__q", question(F.col("pieces"))).withColumn("__key", F.when(F.col("__q").isNotNull(), text_key(F.col("lang"), F.col("__q"))))
    found = look_up(asked, store.withColumnRenamed("key", "__key").withColumnRenamed("translated", "__a"), "__key", F.struct("page", "nth"))
    n, answer = F.size("pieces"), F.col("__a")
    whole = F.when(F.col("__q").isNull(), F.col("pieces")).when(n == 1, F.array(F.coalesce(answer, F.get("pieces", F.lit(0))))).otherwise(F.when(answer.isNotNull(), unpack(answer, n)))
    why = F.when(F.col("__q").isNull(), "blank").when(n > 1, "pack").when(answer.isNotNull(), "single").otherwise("kept")
    return found.withColumn("translated", whole).withColumn("why", F.transform("pieces", lambda t: why)).drop("__q", "__key", "__a")


def questions(packs: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(lang, text), each once: what to ask for ``packs``, or, once there are answers, the pieces of packs that failed.

    The protocol has two passes: packs are asked whole; the pieces of those whose answer is missing or has lost a mark
    are asked one by one.  A text that many packs have is asked once.
    """
    if answers is None:
        asked = packs.select("lang", question(F.col("pieces")).alias("text")).where("text is not null")
    else:
        asked = _first_pass(packs, answer_store(answers)).where("translated is null").select("lang", F.explode("pieces").alias("text")).where(~_blank(F.col("text")))
    return asked.distinct()


def translate_packs(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """``packs`` (page, lang, nth, pieces) with translated and why, an array each, of as many texts as pieces.

    ``packs`` is read twice.  ``answers``: (lang, text, translated), to what questions() asks in both passes.  why: "pack" for a text from a whole
    pack, "single" for one that was asked by itself, "kept" for one without an answer, which stays, "blank" for a pack of
    blanks or a blank among singles.
    """
    store = keep(answer_store(answers))
    first = keep(_first_pass(packs, store))
    failed = first.where("translated is null").select("page", "lang", "nth", F.posexplode("pieces").alias("pos", "piece"))
    failed = failed.withColumn("key", F.when(~_blank(F.col("piece")), text_key(F.col("lang"), F.col("piece"))))
    found = look_up(failed, store, "key", F.struct("page", "nth", "pos"))
    why = F.when(_blank(F.col("piece")), "blank").when(F.col("translated").isNotNull(), "single").otherwise("kept")
    each = F.struct("pos", "piece", F.coalesce("translated", "piece").alias("translated"), why.alias("why"))
    second = found.groupBy("page", "lang", "nth").agg(F.sort_array(F.collect_list(each)).alias("x"))  # eight at most
    of = lambda k: F.transform("x", lambda x: x[k]).alias(k)
    second = second.select("page", "lang", "nth", F.transform("x", lambda x: x["piece"]).alias("pieces"), of("translated"), of("why"))
    return first.where("translated is not null").select(second.columns).unionByName(second)


def translate_texts(pages: DataFrame, answers: DataFrame, page: str = "page", lang: str = "lang", texts: str = "texts") -> DataFrame:
    """``pages`` with translated: as many texts as they have, translated by packs; a text that was cut is joined again.

    Pages of no language to translate from keep their texts.
    """
    packs = translate_packs(keep(page_packs(pages, page, lang, texts)), answers)
    joined = packs.groupBy("page").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "translated"))), lambda x: x["translated"])).alias("__pieces"))
    size = lambda t: F.greatest(F.ceil(F.length(safe_piece(t)) / SLICE).cast("int"), F.lit(1))
    # each piece with the number of its text, then pieces of one text joined; texts that aren't cut are their piece
    owners = F.flatten(F.transform(texts, lambda t, i: F.array_repeat(i, size(t))))
    cut = F.exists(texts, lambda t: size(t) > 1)
    joined_texts = lambda p: F.transform(F.sequence(F.lit(1), F.size(texts)), lambda i: F.array_join(F.slice(p["pieces"], F.array_position(p["owners"], i - 1).cast("int"), size(F.get(texts, i - 1))), ""))
    whole = F.when(cut, bind(F.struct(F.col("__pieces").alias("pieces"), owners.alias("owners")), joined_texts)).otherwise(F.col("__pieces"))
    out = pages.join(joined.withColumnRenamed("page", "__page"), F.col(page) == F.col("__page"), "left")
    return out.withColumn("translated", F.when(F.col("__pieces").isNotNull(), whole).otherwise(F.col(texts))).drop("__pieces", "__page")


def translate(pages: DataFrame, table: DataFrame, page: str = "page", doc: str = "doc", lang: str = "source_lang") -> DataFrame:
    """``pages`` with their texts translated by ``table`` (lang, text, translated); what it lacks stays as it is.

    Texts are looked up by a digest, those that very many pages have over several tasks; they come back by position.
    """
    each = pages.where(F.col(lang).isNotNull()).select(F.col(page).alias("__page"), F.col(lang).alias("lang"), F.posexplode(flatten_texts(F.col(doc))).alias("__pos", "__t"))
    each = each.withColumn("key", text_key(F.col("lang"), F.col("__t.text")))
    found = look_up(each, answer_store(table), "key", F.struct("__page", "__pos"))
    row = F.struct("__pos", F.struct(F.col("__t.kind").alias("kind"), F.col("__t.key").alias("key"), F.col("__t.pos").alias("pos"), F.coalesce("translated", "__t.text").alias("text")).alias("x"))
    flat = found.groupBy("__page").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["x"]).alias("__flat"))
    out = pages.join(flat, F.col(page) == F.col("__page"), "left")
    return out.withColumn(doc, F.when(F.col("__flat").isNotNull(), rebuild(F.col(doc), F.col("__flat"))).otherwise(F.col(doc))).drop("__page", "__flat")


def translated_units(pages: DataFrame, answers: DataFrame, job_id: str = "job_id", html: str = "html", doc: str = "doc") -> DataFrame:
    """(job_id, at, text): translations of the texts of parsed pages that are cut into chunks, where they are known.

    Pages in English or in no language to translate from have none.  A text of more than SLICE characters is looked up in
    slices.  A text that a million pages have is one row of ``answers`` (lang, text, translated).
    """
    lang = source_language(html_lang(F.col(html)))
    own = pages.select(F.col(job_id).alias("job_id"), lang.alias("lang"), F.explode(units(F.col(doc))).alias("u")).where("lang IS NOT NULL")
    text = safe_piece(F.col("u.text"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(SLICE))
    cut = own.select("job_id", "lang", F.col("u.at").alias("at"), F.size(starts).alias("n"), F.posexplode(F.transform(starts, lambda i: F.substring(text, i, F.lit(SLICE)))).alias("nth", "piece"))
    cut = cut.withColumn("key", F.when(~_blank(F.col("piece")), text_key(F.col("lang"), F.col("piece"))))
    found = look_up(cut, answer_store(answers), "key", F.struct("job_id", "at", "nth"))
    one = found.where("n = 1 AND translated IS NOT NULL").select("job_id", "at", F.col("translated").alias("text"))
    many = found.where("n > 1").groupBy("job_id", "at").agg(F.sort_array(F.collect_list(F.struct("nth", F.coalesce("translated", "piece").alias("t")))).alias("x"))
    return one.unionByName(many.select("job_id", "at", F.array_join(F.transform("x", lambda x: x["t"]), "").alias("text")))


def reason(lang: Column, source: Column, n_texts: Column, changed: Column, failed: Column) -> Column:
    """Why a page was translated or not."""
    english = F.coalesce(lang, F.lit("")).rlike("^en(?:-|$)")
    return F.when(english, "html_lang_en").when(source.isNull(), "unsupported_lang").when(n_texts == 0, "non_en_no_text").when(failed, "translate_error").when(changed, "seed_translate").otherwise("translate_noop")
