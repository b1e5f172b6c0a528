"""Brand profiles: look-up by priority, registration from domain intelligence, and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.text import bind, contains_brand, first_wins, slug

TEXTS = "array<string>"


def is_empty(value: Column) -> Column:
    text = F.trim(F.coalesce(value, F.lit("")))
    return (text == "") | (F.lower(text) == "null")


def keys(brands: DataFrame) -> DataFrame:
    """(kind, key, ord, brand): ids and names (ids count as names) that a brand is found by; ord is the store's order."""
    own = brands.select(F.struct("*").alias("brand"), F.col("ord"), F.lower("brand_id").alias("id"), F.transform("brand_names", lambda n: F.lower(F.trim(n))).alias("names"))
    by_id = own.select(F.lit("id").alias("kind"), F.col("id").alias("key"), "ord", "brand")
    by_name = own.select(F.lit("name").alias("kind"), F.explode(F.array_distinct(F.concat(F.array("id"), F.coalesce("names", F.array().cast(TEXTS))))).alias("key"), "ord", "brand")
    both = by_id.unionByName(by_name).where("key is not null")
    # one brand a key: the first in the store
    return both.groupBy("kind", "key").agg(F.min_by("brand", "ord").alias("brand"))


def resolve(jobs: DataFrame, brands: DataFrame, job_id: str = "job_id", brand_id: str = "brand_id", hint: str = "user_input") -> DataFrame:
    """``jobs`` with the struct brand, null if none is found.

    In this order: the given id; the hint as a name; the hint's letters and digits as an id; each word of the hint, as
    an id and then as a name.  ``brands`` needs a column ord, the order of the store.
    """
    text = F.trim(F.coalesce(F.col(hint), F.lit("")))
    low = F.lower(text)
    given = F.col(brand_id)
    probe = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")
    tries = F.concat(
        F.array(F.when(~is_empty(given), probe("id", F.lower(given))), F.when(text != "", probe("name", low)), F.when(slug(text) != "", probe("id", slug(text)))),
        F.flatten(F.transform(words, lambda w: F.array(probe("id", w), probe("name", w)))),
    )
    asked = jobs.select(F.col(job_id).alias("__job"), F.posexplode(tries).alias("__rank", "__try")).where("__try is not null")
    asked = asked.select("__job", "__rank", F.col("__try.kind").alias("kind"), F.col("__try.key").alias("key"))
    found = asked.join(keys(brands), ["kind", "key"]).groupBy("__job").agg(F.min_by("brand", "__rank").alias("brand"))
    return jobs.join(found, F.col(job_id) == F.col("__job"), "left").drop("__job")


def named_in(docs: DataFrame, brands: DataFrame, doc_id: str = "doc_id", text: str = "text", brand: str = "brand") -> DataFrame:
    """(doc_id, brand): which brands, of one word or several, a text has as tokens, each once.

    Texts are cut into tokens once (what is next to a letter, digit, underscore or dot belongs to the token) and meet the
    brands by their first token, so the work grows with the texts and not with the number of brands; a brand of several
    tokens is then sought in the texts that have its first one.
    """
    tokens = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9_.]+"), lambda t: t != "")
    # of a brand that holds other characters the first token decides where it is sought, the pattern whether it is there
    asked = brands.select(F.trim(brand).alias("brand")).where("brand <> ''").distinct().withColumn("first", F.get(tokens(F.col("brand")), F.lit(0)))
    asked = asked.withColumn("plain", F.lower("brand") == F.col("first")).where("first IS NOT NULL")
    said = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("first"))
    found = said.join(asked, "first").select("doc_id", "brand", "plain")
    whole = found.where(~F.col("plain")).join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "doc_id").where(contains_brand(F.col("__text"), F.col("brand"))).select("doc_id", "brand")
    return found.where("plain").select("doc_id", "brand").unionByName(whole).distinct()


def mode_first(values: Column) -> Column:
    """The most frequent value of an array; of equally frequent ones the first."""

    def counted(all_: Column) -> Column:
        return F.array_max(F.transform(F.array_distinct(all_), lambda v, i: F.struct(F.size(F.filter(all_, lambda x: x == v)).alias("n"), (-i).alias("back"), v.alias("v"))))

    return bind(values, counted)["v"]


def distinct_texts(values: Column) -> Column:
    """Trimmed, without empty ones, the first of those equal but for case."""
    own = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return first_wins(own)


def register(requests: DataFrame, intel: DataFrame) -> DataFrame:
    """Brand rows of ``requests`` (brand_name, official_site, whitelist_domains, brand_names, logo_path).

    ``intel``: host and structs tls, whois and geo; a domain without a row has none.
    """
    bare = lambda c: U.bare_host(F.trim(F.lower(c)))
    texts = lambda c: F.coalesce(F.col(c), F.array().cast(TEXTS))
    own = requests.select(
        slug(F.trim("brand_name")).alias("brand_id"),
        distinct_texts(F.concat(F.array("brand_name"), texts("brand_names"), F.array(slug(F.trim("brand_name"))))).alias("brand_names"),
        "official_site",
        distinct_texts(F.transform(F.concat(F.array("official_site"), texts("whitelist_domains")), bare)).alias("official_domains"),
        F.when(F.col("logo_path") != "", F.col("logo_path")).alias("logo_path"),
    ).where("brand_id <> '' and size(official_domains) > 0")
    each = own.select("*", F.posexplode("official_domains").alias("pos", "host")).join(intel, "host", "left")
    row = F.struct("pos", F.col("host").alias("domain"), "whois", "tls", F.col("geo.country").alias("country"))
    gathered = each.groupBy("brand_id").agg(
        F.first("brand_names").alias("brand_names"), F.first("official_site").alias("official_site"), F.first("official_domains").alias("official_domains"), F.first("logo_path").alias("logo_path"), F.sort_array(F.collect_list(row)).alias("rows")
    )
    of = lambda f: F.filter(F.transform("rows", f), lambda v: v.isNotNull())
    return gathered.select(
        "brand_id",
        "brand_names",
        "official_site",
        "official_domains",
        distinct_texts(of(lambda r: r["whois"]["registrant_org"])).alias("registrant_organizations"),
        distinct_texts(of(lambda r: r["country"])).alias("registrant_countries"),
        distinct_texts(of(lambda r: r["whois"]["registrar"])).alias("registrar_names"),
        F.lit(365).alias("min_registration_age_days"),
        mode_first(of(lambda r: r["country"])).alias("expected_country"),
        "logo_path",
        F.transform("rows", lambda r: F.struct(r["domain"].alias("domain"), r["tls"].alias("tls"), r["country"].alias("geo_country"))).alias("domain_intel"),
    )


def upsert(store: DataFrame, new: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """The store with new brands over old ones of the same id but for case, one after the other by ``order``.

    A new brand's fields that aren't null win, later ones over earlier; created_at stays, updated_at is now, the id is
    spelled as the last one has it.  Old brands keep their place (ord), new ones follow by the order of their first row.  Rows
    without an id aren't brands.  Rows of one id are put together in each task first, and no window spans the store.
    """
    fields = [c for c in store.columns if c not in ("created_at", "updated_at", "ord", "brand_id")]
    last = (store.agg(F.max("ord")).first() or [None])[0]
    top = -1 if last is None else int(last)
    own = [F.col(c) if c in new.columns else F.lit(None).cast(store.schema[c].dataType).alias(c) for c in fields]
    old = store.select("brand_id", *fields, F.lit(None).cast("long").alias("__seq"), "created_at", "updated_at", F.col("ord").cast("long").alias("ord"))
    none = F.lit(None).cast("string")
    added = new.select("brand_id", *own, F.col(order).cast("long").alias("__seq"), none.alias("created_at"), none.alias("updated_at"), (F.col(order).cast("long") + top + 1).alias("ord"))
    at = F.struct(F.col("__seq").isNotNull(), "__seq")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    was = F.max(F.col("__seq").isNull())
    merged = old.unionByName(added).where("brand_id IS NOT NULL AND brand_id <> ''").groupBy(F.lower("brand_id").alias("__id")).agg(
        newest("brand_id"),
        *[newest(c) for c in fields],
        F.coalesce(F.max("created_at"), now).alias("created_at"),
        F.when(F.max(F.col("__seq").isNotNull()), now).otherwise(F.max("updated_at")).alias("updated_at"),
        F.when(was, F.min(F.when(F.col("__seq").isNull(), F.col("ord")))).otherwise(F.min("ord")).alias("ord"),
    )
    return merged.drop("__id").select("brand_id", *fields, "created_at", "updated_at", "ord")
