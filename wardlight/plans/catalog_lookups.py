"""Queries over what pages are joined to: translations, vectors, images, brands, links, signals; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import brands as B
from ..operators import facts as X
from ..operators import links as L
from ..operators import reports as R
from ..operators import semantic as S
from ..operators import translation as T
from ..sources import shared, stores
from . import classify as C
from . import scoring
from .catalog import HOST_SQL, SIGNALS_SQL, SQL, join, query, signal_matrix, table

# --- translation -----------------------------------------------------------------------------------------------------


def packed_sql(source: str) -> str:
    """Common tables up to ``packs`` (id, pack, x): the texts (id, i, t) of ``source`` in packs, by a walk over pieces."""
    return rf"""src AS ({source}),
safe AS (SELECT id, i, regexp_replace(coalesce(t, ''), '\[\[(\d+)\]\]', '[[ \1 ]]', 'g') AS s FROM src),
cut AS (SELECT id, i, s, length(s) AS whole, unnest(CASE WHEN length(s) > {T.SLICE} THEN range(0, length(s), {T.SLICE}) ELSE [0] END) AS a FROM safe),
pieces AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, a) AS k, CASE WHEN whole > {T.SLICE} THEN substr(s, a + 1, {T.SLICE}) ELSE s END AS s, whole > {T.SOLO} AS solo FROM cut),
walk AS (SELECT id, k, s, 0 AS pack, CASE WHEN solo THEN 0 ELSE 1 END AS items, length(s) + {T.MARK} AS size FROM pieces WHERE k = 1
  UNION ALL SELECT p.id, p.k, p.s, CASE WHEN w.items > 0 AND NOT p.solo AND w.items < {T.PACK_ITEMS} AND w.size + length(p.s) + {T.MARK} <= {T.PACK_CHARS} THEN w.pack ELSE w.pack + 1 END,
    CASE WHEN p.solo THEN 0 WHEN w.items > 0 AND w.items < {T.PACK_ITEMS} AND w.size + length(p.s) + {T.MARK} <= {T.PACK_CHARS} THEN w.items + 1 ELSE 1 END,
    CASE WHEN w.items > 0 AND w.items < {T.PACK_ITEMS} AND w.size + length(p.s) + {T.MARK} <= {T.PACK_CHARS} THEN w.size ELSE 0 END + length(p.s) + {T.MARK}
  FROM walk w JOIN pieces p ON p.id = w.id AND p.k = w.k + 1),
packs AS MATERIALIZED (SELECT id, pack, list(s ORDER BY k) AS x FROM walk GROUP BY id, pack)"""


SQL["translation_batches"] = f"""WITH RECURSIVE {packed_sql("SELECT doc_id AS id, i, t[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")}
SELECT id AS doc_id, count(*)::BIGINT AS n_batches, max(len(x))::BIGINT AS most_items, sum(len(x))::BIGINT AS n_pieces FROM packs GROUP BY id"""

#: What the translator of the queries answers: nothing to a fifth of all questions, a mark lost in another fifth.
_ANSWER_SQL = "CASE length({0}) % 5 WHEN 1 THEN replace({0}, '[[1]]', '') ELSE replace({0}, 'e', 'E') END"
_SENTENCES_SQL = "SELECT conv_id AS id, i, t[i] AS t FROM (SELECT conv_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT conv_id, string_split(string_agg(coalesce(text, ''), '. ' ORDER BY turn), '. ') AS t FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id))"
_TRANSLATED_SQL = f"""{packed_sql(_SENTENCES_SQL)},
asked AS (SELECT *, len(x) AS n, len(list_filter(x, lambda s: trim(s) <> '')) = 0 AS blank, CASE WHEN len(x) = 1 THEN x[1] ELSE array_to_string([('[[' || (j - 1) || ']]' || x[j]) for j in range(1, len(x) + 1)], '') END AS q FROM packs),
told AS (SELECT *, length(q) % 5 AS d FROM asked),
done AS (SELECT id, pack, x, CASE WHEN blank THEN x WHEN n > 1 AND d > 1 THEN list_transform(x, lambda s: trim(replace(s, 'e', 'E')))
    ELSE list_transform(x, lambda s: CASE WHEN trim(s) = '' OR length(s) % 5 = 0 THEN s ELSE {_ANSWER_SQL.format("s")} END) END AS y,
  CASE WHEN blank THEN list_transform(x, lambda s: 'blank') WHEN n > 1 AND d > 1 THEN list_transform(x, lambda s: 'pack')
    ELSE list_transform(x, lambda s: CASE WHEN trim(s) = '' THEN 'blank' WHEN length(s) % 5 = 0 THEN 'kept' ELSE 'single' END) END AS why FROM told)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each conversation, as texts of a page in a language; a third of the pages is in none to translate from."""
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    own = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page")).agg(F.split(F.array_join(said, ". "), r"\. ").alias("texts"))
    return own.withColumn("lang", F.when(F.col("page") % 3 == 1, "de").when(F.col("page") % 3 == 2, "fr"))


def answered(asked: DataFrame) -> DataFrame:
    n, text = F.length("text") % 5, F.col("text")
    return asked.where(n != 0).withColumn("translated", F.when(n == 1, F.replace(text, F.lit("[[1]]"), F.lit(""))).otherwise(F.replace(text, F.lit("e"), F.lit("E"))))


def two_passes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packs, answers): both passes of asking."""
    packs = shared.keep(T.page_packs(pages))  # asked twice, then translated
    first = shared.keep(answered(T.questions(packs)))
    return packs, shared.keep(first.unionByName(answered(T.questions(packs, first))).distinct())


@query(f"WITH RECURSIVE {_TRANSLATED_SQL} SELECT id AS conv_id, pack::BIGINT AS nth, array_to_string(y, '|') AS translated, array_to_string(why, ',') AS why FROM done")
def translated_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs whose answers are missing or have lost a mark fall to a second pass of single texts."""
    found = T.translate_packs(*two_passes(sentences(spark, sf_dir)))
    return found.select(F.col("page").alias("conv_id"), F.col("nth").cast("long").alias("nth"), F.array_join("translated", "|").alias("translated"), F.array_join("why", ",").alias("why"))


@query(
    f"""WITH RECURSIVE {_TRANSLATED_SQL},
kept AS (SELECT id, k, pack, solo, i FROM (SELECT p.id, p.k, w.pack, p.solo FROM pieces p JOIN walk w USING (id, k)) JOIN (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, a) AS k, i FROM cut) USING (id, k)),
each AS (SELECT kept.id, i, kept.k, y[kept.k - (SELECT min(o.k) FROM kept o WHERE o.id = kept.id AND o.pack = kept.pack) + 1] AS y FROM kept JOIN done ON done.id = kept.id AND done.pack = kept.pack),
texts AS (SELECT id, i, string_agg(y, '' ORDER BY k) AS t FROM each GROUP BY id, i)
SELECT id AS conv_id, string_agg(t, '|' ORDER BY i) AS translated FROM texts GROUP BY id
UNION ALL SELECT conv_id, string_agg(coalesce(text, ''), '. ' ORDER BY turn).string_split('. ').array_to_string('|') FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id"""
)
def translated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of pages, put together again from the pieces of packs."""
    pages = sentences(spark, sf_dir)
    found = T.translate_texts(pages, two_passes(pages)[1])
    return found.select(F.col("page").alias("conv_id"), join(F.col("translated"), "|").alias("translated"))


# --- whole pages with translations, chunks and images ----------------------------------------------------------------

BRAND = "brand_id string, brand_names array<string>, official_domains array<string>, registrant_organizations array<string>, tls_subject_organizations array<string>, expected_country string, ord int"
#: What is added to a page, and its label: in a page that is translated, and in one that isn't.
CONTENTS = (
    ("", "Other_Site", "Other_Site"),
    ("<p>Nordbank sucht Personal, eine Gebuehr ist zu zahlen</p>", "Recruitment_Fraud", "Other_Site"),
    ("<p>Nordbank</p><p>verify your account at once</p><form action='https://collect.example/x'><input name='card-number'><input type=password name=p autocomplete=off></form>", "Phishing", "Phishing"),
    ("<p>Nordbank</p><img src='/img/nordbank-mark.png' alt='Nordbank'><input type=password name=p>", "Impersonation", "Impersonation"),
    ("<p>Our casino is open</p>", "Gambling", "Gambling"),
)
HIRING = "Nordbank is hiring, a fee has to be paid"


def content_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """The pages with something added in turn, and what they are looked up in."""
    k = F.col("page_id") % len(CONTENTS)
    added = F.lit("")
    for i, (html, _, _) in enumerate(CONTENTS):
        added = F.when(k == i, F.lit(html)).otherwise(added)
    url = F.concat(F.lit("https://"), F.when(k == 3, "nordbank-login.h").otherwise("h"), F.col("page_id").cast("string"), F.lit(".example/"))
    whole = F.regexp_replace("html", "(?is)</body>.*", "")
    jobs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("job_id"), url.alias("url"), F.concat(whole, added, F.lit("</body></html>")).alias("html"), F.lit("Nordbank").alias("user_input"))
    none = F.array().cast("array<string>")
    brands = spark.createDataFrame([("nordbank", ["Nordbank"], ["nordbank.example"], "Norway", 0)], "brand_id string, brand_names array<string>, official_domains array<string>, expected_country string, ord int")
    brands = brands.select("brand_id", "brand_names", "official_domains", none.alias("registrant_organizations"), none.alias("tls_subject_organizations"), "expected_country", "ord")
    axis = lambda *on: [1.0 if i in on else 0.0 for i in range(4)]
    phrases = spark.createDataFrame(
        [("recruitmentScore", 0, 0, "we are hiring", axis(0)), ("recruitmentFeeScore", 1, 0, "pay the fee", axis(1)), ("accountVerificationScore", 2, 0, "verify your account", axis(2)), ("urgencyScore", 3, 0, "at once", axis(3))],
        "category string, cat_ord int, phrase_ord int, phrase string, vector array<double>",
    )
    german = CONTENTS[1][0].removeprefix("<p>").removesuffix("</p>")
    translations = spark.createDataFrame([(lang, german, HIRING) for lang in ("de", "fr", "es")] + [("de", "unused", "nothing")], "lang string, text string, translated string")
    first, last = " ".join(HIRING.split()[:8]), " ".join(HIRING.split()[4:])
    vectors = spark.createDataFrame([(first, axis(0)), (last, axis(1)), ("verify your account at once", axis(2, 3)), (german, [0.0] * 4)], "text string, vector array<double>")
    logo_vectors = spark.createDataFrame([("nordbank", axis(0, 1))], "brand_id string, logo_vector array<double>")
    image_vectors = jobs.select(F.concat("url", F.lit("img/nordbank-mark.png")).alias("url"), F.array(*[F.lit(x) for x in axis(0, 1)]).alias("vector"))
    return jobs, {"brands": brands, "phrases": phrases, "translations": translations, "vectors": vectors, "logo_vectors": logo_vectors, "image_vectors": image_vectors}


_LANG_SQL = "lower(regexp_extract(html, '(?i)<html\\b[^>]*\\blang\\s*=\\s*[\"'']?\\s*([a-zA-Z]+)', 1)) IN ('de', 'fr', 'es')"


def _label_sql(label: str) -> str:
    """Pages of a casino, which their footers name, are about gambling unless something stronger is found."""
    return f"'{label}'" if label != "Other_Site" else "CASE WHEN regexp_matches(html, '(?i)&copy; [^<]*\\bcasino\\b') THEN 'Gambling' ELSE 'Other_Site' END"


@query(
    f"SELECT page_id AS job_id, CASE page_id % {len(CONTENTS)} "
    + " ".join(f"WHEN {i} THEN CASE WHEN {_LANG_SQL} THEN {_label_sql(a)} ELSE {_label_sql(b)} END" for i, (_, a, b) in enumerate(CONTENTS))
    + " END AS label FROM pages"
)
def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages: translated where they aren't in English, cut into chunks, matched, and their images held against a logo."""
    jobs, tables = content_tables(spark, sf_dir)
    return C.classify(jobs, **tables).select("job_id", "label")


# --- a store of brands -----------------------------------------------------------------------------------------------


@query(
    """WITH old AS (SELECT 'b' || c_custkey AS id, 'site' || c_custkey AS site, 'MY' AS country, c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'b' END || o_custkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_orderkey END AS site, CASE WHEN o_orderkey % 5 = 0 THEN 'K' || o_orderkey END AS country, o_custkey AS k, o_orderkey AS seq FROM orders),
n AS (SELECT k, arg_max(id, seq) AS id, arg_max(site, seq) FILTER (site IS NOT NULL) AS site, arg_max(country, seq) FILTER (country IS NOT NULL) AS country FROM new GROUP BY k)
SELECT coalesce(n.id, o.id) AS brand_id, coalesce(n.site, o.site) AS official_site, coalesce(n.country, o.country) AS expected_country, CASE WHEN o.id IS NOT NULL THEN 'old' ELSE 'now' END AS created_at,
  CASE WHEN n.id IS NOT NULL THEN 'now' ELSE 'old' END AS updated_at, 2::BIGINT AS version FROM old o FULL JOIN n ON o.k = n.k"""
)
def merged_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of all customers, merged with many changes by ids equal but for case; the second version of a stored table."""
    c, o, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("b"), "c_custkey").alias("brand_id"), F.concat(F.lit("site"), "c_custkey").alias("official_site"), F.lit("MY").alias("expected_country"), F.lit("old").alias("created_at"), F.lit("old").alias("updated_at"), F.col("c_custkey").alias("ord"))
    folder = f"{shared.folder(spark)}/kept-brands-{uuid.uuid4()}"
    seen = stores.write_version(first, folder)
    new = o.select(F.concat(F.when(k % 2 == 0, "B").otherwise("b"), "o_custkey").alias("brand_id"), F.when(k % 3 > 0, F.concat(F.lit("s"), k)).alias("official_site"), F.when(k % 5 == 0, F.concat(F.lit("K"), k)).alias("expected_country"), k.alias("seq"))
    number = stores.write_version(B.upsert(stores.read_version(spark, folder), new, F.lit("now")), folder, seen)
    return stores.read_version(spark, folder).drop("ord").withColumn("version", F.lit(number).cast("long"))


# --- links -----------------------------------------------------------------------------------------------------------

#: How a url of the queries answers, by its number; it is probed twice, the second time without an answer in some cases.
_PROBE_SQL = """probe AS (SELECT p, 'https://u.example/' || p AS url, CASE p % 5 WHEN 0 THEN 'alive' WHEN 1 THEN 'hard_dead' WHEN 2 THEN 'soft_dead' WHEN 3 THEN 'network_error' ELSE 'alive' END AS st FROM (SELECT DISTINCT p_partkey % 400 AS p FROM part))"""


def probe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p") % 5
    urls = table(spark, sf_dir, "part").select((F.col("p_partkey") % 400).alias("p")).distinct()
    answer = lambda status, body, error: F.struct(status.cast("int").alias("http_status"), body.cast("string").alias("body_excerpt"), error.cast("string").alias("error"))
    none = F.lit(None)
    first = F.when(p == 1, answer(F.lit(404), F.lit("gone"), none)).when(p == 2, answer(F.lit(200), F.lit("Page Not Found"), none)).when(p == 3, answer(none, none, F.lit("reset"))).otherwise(answer(F.lit(200), F.lit("fine"), none))
    second = F.when(p == 3, first).otherwise(answer(F.lit(599), F.lit("later"), none))
    return urls.select(F.concat(F.lit("https://u.example/"), "p").alias("url"), F.explode(F.array(first, second)).alias("a")).select("url", "a.*")


@query(
    f"""WITH {_PROBE_SQL},
a AS (SELECT l_orderkey // 20 AS page, ((l_orderkey % 20) * 8 + l_linenumber) * 400 + l_partkey % 400 AS pos, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 7 THEN NULL ELSE l_partkey % 400 END AS p FROM lineitem),
c AS (SELECT page, p, count(*) AS n, min(pos) AS first FROM a GROUP BY page, p),
k AS (SELECT c.*, url, CASE WHEN c.p IS NULL THEN 'placeholder' ELSE coalesce(st, 'network_error') END AS st, row_number() OVER (PARTITION BY page, coalesce(st, CASE WHEN c.p IS NULL THEN 'placeholder' ELSE 'network_error' END) ORDER BY first) AS nth
  FROM c LEFT JOIN probe ON probe.p = c.p)
SELECT page, sum(n)::BIGINT AS evaluable_count, count(p)::BIGINT AS unique_count, (sum(n) - coalesce(sum(n) FILTER (st = 'alive'), 0))::BIGINT AS broken_count, arg_max(url, (n, -first)) FILTER (p IS NOT NULL) AS dominant_url,
  coalesce(string_agg(url, ' ' ORDER BY first) FILTER (st = 'hard_dead' AND nth <= 5), '') AS hard_dead_samples, coalesce(string_agg(url, ' ' ORDER BY first) FILTER (st = 'soft_dead' AND nth <= 5), '') AS soft_dead_samples,
  coalesce(string_agg(url, ' ' ORDER BY first) FILTER (st = 'network_error' AND nth <= 5), '') AS network_error_samples FROM k GROUP BY page"""
)
def link_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages with one url that all of them have; every url was probed twice."""
    line, part = F.col("l_linenumber"), F.col("l_partkey") % 400
    p = F.when(line == 1, F.lit(0).cast(table(spark, sf_dir, "lineitem").schema["l_partkey"].dataType)).when(line != 7, part)
    anchors = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 20").alias("page"), (((F.col("l_orderkey") % 20) * 8 + line) * 400 + part).alias("pos"), F.concat(F.lit("https://u.example/"), p).alias("url"))
    found = L.health(anchors, probe_table(spark, sf_dir))
    return found.select("page", "evaluable_count", "unique_count", "broken_count", "dominant_url", *[join(F.col(f"{k}_samples"), " ").alias(f"{k}_samples") for k in ("hard_dead", "soft_dead", "network_error")])


# --- remembered signals ----------------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT l_orderkey AS job, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS pos, 's' || l_partkey % 4 AS s, (l_suppkey % 8) * 0.2::DOUBLE - 0.1::DOUBLE AS strength, 'v' || l_linenumber AS v, [l_returnflag, 'e' || l_suppkey % 8] AS e FROM lineitem),
g AS (SELECT job, s, min(pos) AS first, list({'strength': strength, 'v': v, 'e': e} ORDER BY pos, e) AS x FROM a GROUP BY job, s),
f AS (SELECT job, s, first, list_reduce(x, lambda m, y: CASE WHEN y.strength > least(1.0::DOUBLE, greatest(0.0::DOUBLE, m.strength)) THEN y ELSE m END) AS y FROM g),
h AS (SELECT job, s, first, least(1.0::DOUBLE, greatest(0.0::DOUBLE, y.strength)) AS strength, y.v || '/' || array_to_string(y.e, '+') AS t FROM f)
SELECT job, string_agg(s || '=' || t, ',' ORDER BY first) AS asserted, string_agg(s, ',' ORDER BY strength DESC, first) AS by_strength, max(strength) AS strongest, max(t) FILTER (s = 's1') AS s1 FROM h GROUP BY job"""
)
def signal_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals asserted again and again: the stronger ones stay, with all their evidence."""
    li, power = table(spark, sf_dir, "lineitem"), (F.col("l_suppkey") % 8) * F.lit(0.2) - F.lit(0.1)
    one = F.struct(F.concat(F.lit("s"), F.col("l_partkey") % 4).alias("signal"), F.lit("g").alias("grp"), power.alias("strength"), F.concat(F.lit("v"), "l_linenumber").alias("value"), F.array("l_returnflag", F.concat(F.lit("e"), F.col("l_suppkey") % 8)).alias("evidence"))
    own = li.groupBy(F.col("l_orderkey").alias("job")).agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("pos"), one.alias("x")))), lambda e: e["x"]).alias("a"))
    own = own.select("job", X.assert_signals(F.col("a")).alias("m"))
    told = lambda x: F.concat(x["value"], F.lit("/"), F.array_join(x["evidence"], "+"))
    ranked = X.by_strength(F.col("m"))
    return own.select("job", F.array_join(F.transform("m", lambda x: F.concat(x["signal"], F.lit("="), told(x))), ",").alias("asserted"), F.array_join(F.map_keys(ranked), ",").alias("by_strength"), F.get(F.map_values(ranked), F.lit(0))["strength"].alias("strongest"), told(X.get_signal(F.col("m"), "s1")).alias("s1"))


# --- images ----------------------------------------------------------------------------------------------------------


@query(
    r"""WITH e AS (SELECT vec_id // 40 AS job, vec_id % 40 AS i, vec_id FROM embeddings),
x AS (SELECT job, i, CASE i % 8 WHEN 0 THEN '/icons/' || i // 2 || '.png' WHEN 1 THEN 'https://cdn.example/acme-' || i || '.png' WHEN 2 THEN '/img/' || i || '.SVG?x=1' WHEN 3 THEN '/logo/' || i WHEN 4 THEN '//acme.example/' || i WHEN 5 THEN '' WHEN 6 THEN '/a/' || i ELSE 'data:image/svg+xml,' || i END AS src FROM e),
u AS (SELECT job, i, CASE WHEN src LIKE 'data:%' OR src LIKE 'https:%' THEN src WHEN src LIKE '//%' THEN 'https:' || src ELSE 'https://h.example' || src END AS url, CASE i % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 3 ELSE 4 END AS rank, i % 8 IN (2, 7) AS svg FROM x WHERE src <> ''),
f AS (SELECT job, url, min(i) AS i, arg_min(rank, i) AS rank, any_value(svg) AS svg FROM u GROUP BY job, url),
r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY rank, CASE WHEN url LIKE 'data:%' THEN 'a' ELSE 'b' END, CASE WHEN rank = 0 THEN lpad(regexp_extract(url, '(\d+)\.png', 1), 3, '0') WHEN rank = 2 AND url LIKE '%cdn%' THEN 'a' || i // 10 || '.' || i ELSE 'b' || i // 10 || '.' || i END) AS nth FROM f)
SELECT job AS job_id, count(*)::BIGINT AS n, sum(rank)::BIGINT AS ranks, count(*) FILTER (svg)::BIGINT AS n_svg, max(rank)::BIGINT AS worst FROM r WHERE nth <= 15 GROUP BY job"""
)
def image_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen best of each page's images, made absolute, without repeats, by rank and address."""
    i = F.col("vec_id") % 40
    kind = i % 8
    src = F.when(kind == 0, F.concat(F.lit("/icons/"), F.floor(i / 2), F.lit(".png"))).when(kind == 1, F.concat(F.lit("https://cdn.example/acme-"), i, F.lit(".png"))).when(kind == 2, F.concat(F.lit("/img/"), i, F.lit(".SVG?x=1")))
    src = src.when(kind == 3, F.concat(F.lit("/logo/"), i)).when(kind == 4, F.concat(F.lit("//acme.example/"), i)).when(kind == 5, "").when(kind == 6, F.concat(F.lit("/a/"), i)).otherwise(F.concat(F.lit("data:image/svg+xml,"), i))
    text = lambda c: F.coalesce(c, F.lit("")).cast("string")
    image = F.struct(src.alias("src"), text(F.when(kind == 2, "The ACME brand")).alias("alt"), F.when(kind == 6, "og").otherwise("img").alias("kind"), text(F.when(kind == 0, "shortcut icon")).alias("rel"), F.lit("").alias("class_name"), F.lit("").alias("id"))
    pages = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 40").alias("job_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", image.alias("x")))), lambda e: e["x"]).alias("images"))
    pages = pages.select("job_id", F.lit("https://h.example/p").alias("url"), "images", F.array(F.lit("Acme!"), F.lit(None).cast("string")).alias("brand_names"))
    best = S.image_candidates(pages)
    return best.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").cast("long").alias("ranks"), F.count_if("svg").alias("n_svg"), F.max("rank").cast("long").alias("worst"))


# --- what follows from rules, records and early exits ----------------------------------------------------------------


@query(scoring.contributions_sql(SIGNALS_SQL, "job"))
def rule_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a score: which rule added how much to which label because of which signal, in order."""
    many = {n: F.array_contains("signal_names", n) for n in ("adult_strong_many", "gambling_strong_many")}
    found = scoring.score(signal_matrix(spark, sf_dir), many=many)
    line = lambda c: F.concat(c["label"], F.lit("+"), F.round(c["delta"] * 100).cast("int").cast("string"), F.lit(" "), c["signal"], F.lit(" "), c["rule"])
    return found.select("job", F.array_join(F.transform("contributions", line), "; ").alias("contributions"))


@query(
    f"""WITH h AS (SELECT page_id, url, {HOST_SQL} AS host, page_id % 4 AS k, CASE page_id % 3 WHEN 0 THEN 403 WHEN 1 THEN 451 ELSE 200 END AS status FROM pages)
SELECT page_id, CASE k WHEN 0 THEN CASE WHEN status = 200 THEN 'dns_sinkhole' ELSE 'http_status_' || status END WHEN 1 THEN 'There is no profile of the brand Nosuch' WHEN 2 THEN 'There is no HTML to analyse' END AS summary,
  CASE WHEN k < 3 THEN coalesce(nullif(host, ''), url) END AS domain,
  CASE k WHEN 0 THEN CASE WHEN status = 200 THEN 'Addresses of sinkholes: 0.0.0.0' ELSE 'The page answered with HTTP status ' || status END WHEN 1 THEN 'There is no profile of the brand Nosuch' WHEN 2 THEN 'The HTML is empty or missing' END AS findings FROM h"""
)
def exit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of jobs that end before their content is judged."""
    k = F.col("page_id") % 4
    path = F.when(k == 0, "access_denied").when(k == 1, "brand_unresolved").when(k == 2, "empty_html").otherwise("kbs")
    status = F.when(F.col("page_id") % 3 == 0, 403).when(F.col("page_id") % 3 == 1, 451).otherwise(200)
    found = R.exit_report(path, F.col("url"), status, F.array(F.lit("8.8.8.8"), F.lit(" 0.0.0.0 ")), F.lit("Nosuch"))
    own = table(spark, sf_dir, "pages").select("page_id", found.alias("r"))
    short = F.regexp_replace("r.summary", r"^The page couldn't be read \((.*)\)$", "$1")
    return own.select("page_id", short.alias("summary"), F.get("r.domains", F.lit(0)).alias("domain"), F.array_join("r.findings", "; ").alias("findings"))


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS ov, c_custkey % 4 = 0 AS own_tls, c_custkey % 5 = 0 AS own_whois, c_custkey % 7 = 0 AS no_brand, CASE c_custkey % 6 WHEN 0 THEN 403 WHEN 1 THEN 404 ELSE 200 END AS status, c_custkey % 2 = 0 AS plain, c_custkey % 8 AS f FROM customer),
s AS (SELECT k, list_filter([CASE WHEN NOT no_brand AND ov AND own_tls THEN 'brand_tls_org_match=ACME Holdings, Inc.' END, CASE WHEN NOT no_brand AND own_whois THEN 'brand_registrant_org_match=The Acme Holdings' END,
    CASE WHEN NOT no_brand AND (ov AND own_tls OR own_whois) THEN 'brand_org_identity_match=true' END, CASE WHEN status = 403 THEN 'http_access_denied_status=403' END,
    'hostname=' || CASE WHEN plain THEN 'a.b.example' ELSE 'site' || k || '.example' END, CASE WHEN plain THEN 'no_https=true' END, CASE WHEN plain THEN 'is_subdomain=true' END,
    CASE WHEN f IN (1, 2) THEN 'external_form_action=["collect.example"]' END, CASE WHEN f IN (2, 3) THEN 'autocomplete_off_on_password=true' END], lambda x: x IS NOT NULL) AS s FROM c)
SELECT k, array_to_string(s, ' | ') AS facts FROM s"""
)
def identity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their values: a brand's organisations, a page's status, address and forms."""
    k, kinds = F.col("c_custkey"), C.OPTIONAL
    none = F.lit(None).cast("string")
    texts = F.array().cast("array<string>")
    tls = F.struct(F.lit(True).alias("uses_https"), F.lit(True).alias("authorized"), none.alias("error"), none.alias("subject_cn"), F.when(k % 4 == 0, "ACME Holdings, Inc.").otherwise("Other").alias("subject_org"), none.alias("issuer_org"), F.when(k % 3 == 0, "OV").otherwise("DV").alias("issuer_level"), none.alias("valid_to"), F.lit(False).alias("is_expired"), F.lit(False).alias("hostname_mismatch")).cast(kinds["tls"])
    whois = F.struct(F.lit(None).cast("int").alias("age_in_days"), none.alias("created_date"), none.alias("expires_date"), none.alias("registrar"), F.when(k % 5 == 0, "The Acme Holdings").otherwise("No One").alias("registrant_org"), texts.alias("domain_status")).cast(kinds["whois"])
    brand = F.when(k % 7 != 0, F.struct(F.lit("acme").alias("brand_id"), F.array(F.lit("zz")).alias("brand_names"), texts.alias("official_domains"), F.array(F.lit("acme holdings")).alias("registrant_organizations"), F.array(F.lit("Acme Holdings")).alias("tls_subject_organizations"), none.alias("expected_country")).cast(kinds["brand"]))
    status = F.when(k % 6 == 0, 403).when(k % 6 == 1, 404).otherwise(200)
    url = F.when(k % 2 == 0, "http://a.b.example/x").otherwise(F.concat(F.lit("https://site"), k, F.lit(".example/")))
    field = lambda off: F.struct(F.lit("password").alias("type"), F.lit("p").alias("name"), F.lit("").alias("id"), F.when(off, "off").otherwise("on").alias("autocomplete"))
    form = F.struct(F.when((k % 8).isin(1, 2), "https://collect.example/go").otherwise("/own").alias("action"), F.array(field((k % 8).isin(2, 3))).alias("inputs"))
    facts = F.concat(X.brand_identity_facts(F.col("tls"), F.col("whois"), F.col("brand")), X.status_facts(F.col("status")), X.url_facts(F.col("url")), X.form_facts(F.col("forms"), F.col("url")))
    own = table(spark, sf_dir, "customer").select(k.alias("k"), tls.alias("tls"), whois.alias("whois"), brand.alias("brand"), status.alias("status"), url.alias("url"), F.array(form).alias("forms"))
    return own.select("k", F.array_join(F.transform(facts, lambda f: F.concat(f["signal"], F.lit("="), f["value"])), " | ").alias("facts"))
