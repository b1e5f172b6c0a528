"""Pages to one explained label each.

``classify_rows`` is a projection of a row (one hop to Python for the HTML tree, no shuffle), so it works on streams as
well.  ``classify`` joins brands, domain intelligence and probes to the jobs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, prices
from ..functions import url as U
from ..functions.skew import look_up
from ..functions.text import contains_brand, strip_tags
from ..operators import brands as B
from ..operators import detectors as D
from ..operators import dictionaries as words
from ..operators import facts as X
from ..operators import html as H
from ..operators import links as L
from ..operators import semantic, translation, trust
from ..sources.shared import keep
from . import scoring

#: Columns that a row may have besides job_id, url and html, and their types where it hasn't.
OPTIONAL = {
    "rendered_text": "string",
    "http_status": "int",
    "brand": "struct<brand_id: string, brand_names: array<string>, official_domains: array<string>, registrant_organizations: array<string>, tls_subject_organizations: array<string>, expected_country: string>",
    "brand_resolved": "boolean",
    "tls": "struct<uses_https: boolean, authorized: boolean, error: string, subject_cn: string, subject_org: string, issuer_org: string, issuer_level: string, valid_to: string, is_expired: boolean, hostname_mismatch: boolean>",
    "whois": "struct<age_in_days: int, created_date: string, expires_date: string, registrar: string, registrant_org: string, domain_status: array<string>>",
    "dns": "struct<a_records: array<string>, mx_records: array<struct<exchange: string, priority: int>>, has_mx: boolean, ns_records: array<string>, txt_records: array<array<string>>>",
    "geo": "struct<ip: string, country: string, city: string, isp: string, asn: string, is_bulletproof: boolean>",
    "trust_status": "string",
    "derived_facts": "array<string>",
    "brand_image_detected": "boolean",
    "link_health": "struct<broken_ratio: double, broken_count: bigint, evaluable_count: bigint, placeholder_count: bigint, dominant_url: string, dominant_share: double, destination_dead: boolean>",
    "navigation_status": "string",
    "redirects": "struct<was_redirected: boolean, is_cross_domain: boolean, types: array<string>, targets: array<string>>",
    "skip_trust_scoring": "boolean",
}


def with_optional(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in df.columns})


def early_path() -> Column:
    """Which way a job goes; the first reason counts.  Only "kbs" is judged by its content."""
    scored = ~F.coalesce("skip_trust_scoring", F.lit(False))
    denied = F.col("http_status").isin(*fixed.DENIED_STATUSES)
    listed = F.exists(F.coalesce(F.col("brand.official_domains"), F.array().cast("array<string>")), lambda d: U.is_official(F.col("url"), d))
    sunk = F.size(X.sinkhole_ips(F.col("dns.a_records"))) > 0
    return (
        F.when(~F.coalesce("brand_resolved", F.lit(True)), "brand_unresolved")
        .when(denied, "access_denied")
        .when(scored & listed, "trust")
        .when(scored & sunk, "access_denied")
        .when(F.trim(F.coalesce("html", F.lit(""))) == "", "empty_html")
        .otherwise("kbs")
    )


def findings(df: DataFrame) -> DataFrame:
    """``df`` (with url, html, doc and the optional columns) with what the page shows, as columns f_*.  Null and empty: absent."""
    html, url = F.col("html"), F.col("url")
    name = F.get(F.col("brand.brand_names"), F.lit(0))
    text = F.coalesce(F.nullif(F.trim("doc.analysis_text"), F.lit("")), F.nullif(F.trim("doc.body_text"), F.lit("")), F.lit(""))
    inputs = D.sensitive_inputs(html)
    domain = L.official_domain(url, F.col("brand.official_domains"))
    out = df.withColumn("__text", text).withColumns(
        {f"f_has_{k}": c for k, c in inputs.items()}
        | {
            "f_brand_name_present": contains_brand(strip_tags(html), name),
            "f_brand_in_markup": F.exists("doc.brand_attributes", lambda a: contains_brand(a, name)),
            "f_brand_image_detected": F.col("brand_image_detected"),
            "f_has_file_upload": D.has_file_upload(html),
            "f_is_official_subdomain": F.exists(F.col("brand.official_domains"), lambda d: U.is_official(url, d)),
            "f_form_actions": D.form_actions(html, domain),
            "f_redirects": F.col("redirects"),
            "f_link_health": F.col("link_health"),
            "f_has_copyright": D.copyright_text(F.col("doc.footer_text")) | D.copyright_text(F.col("doc.page_text")),
            "f_ecommerce_schema": D.has_microdata(html) | D.has_product_json(html),
            "f_has_pricing_patterns": prices.has_prices(html),
            "f_suspicious_shop_tld": D.shop_tld(url),
            "f_free_webmail": D.free_webmail(html),
            "f_offplatform_chat": D.offplatform_chat(html),
            "f_adult_tld": D.adult_tld(url),
            "f_dense_gallery": D.dense_gallery(F.transform("doc.images", lambda i: i["kind"]), html),
            "__navigation": L.trust_navigation(F.col("doc.trust_items")),
        }
    )
    out = words.gambling(out, "__text", "f_gambling")
    out = words.adult(out, "__text", "f_adult")
    clue = words.parking_clue(F.col("__text"))
    out = out.withColumns(
        {
            "f_missing_copyright": ~F.col("f_has_copyright") & (F.coalesce(html, F.lit("")) != ""),
            "f_unrealistic_discount": (F.col("f_ecommerce_schema") | F.col("f_has_pricing_patterns")) & prices.unrealistic_discount(F.col("doc.price_pairs")),
            "f_adult_age_gate": F.size(words.age_gate(F.col("__text"))) > 0,
            "f_parking_clue": clue,
        }
    )
    gate = F.col("f_parking_clue").isNotNull()
    out = out.withColumns({"f_parked_name_servers": F.when(gate, D.parking_name_servers(F.col("dns.ns_records"))), "f_parked_ips": F.when(gate, D.parking_ips(F.col("dns.a_records")))})
    parked = (F.coalesce(F.size("f_parked_name_servers"), F.lit(0)) > 0) | (F.coalesce(F.size("f_parked_ips"), F.lit(0)) > 0)
    nav = F.col("__navigation")
    # without probes a page with candidates is neither missing nor broken
    unprobed = F.when((F.size(nav["candidates"]) == 0) & (F.size(nav["non_functional"]) == 0), "missing").when(F.size(nav["candidates"]) == 0, "broken").otherwise("unprobed")
    return out.withColumns({"f_no_email": gate & ~parked & D.no_email(F.col("dns.mx_records"), F.col("dns.txt_records")), "f_navigation_status": F.coalesce("navigation_status", unprobed)}).drop("__text", "__navigation")


def signals(df: DataFrame) -> DataFrame:
    """``df`` (with findings) with the array of structs signals."""
    found = {c.removeprefix("f_"): F.col(c) for c in df.columns if c.startswith("f_")}
    sources = [
        X.trusted_facts(F.col("trust_status")),
        X.status_facts(F.col("http_status")),
        X.url_facts(F.col("url")),
        X.form_facts(F.col("doc.forms"), F.col("url")),
        X.page_facts(found),
        X.trust_navigation_facts(F.col("f_navigation_status")),
        X.semantic_facts(F.col("derived_facts")),
        X.tls_facts(F.col("tls")),
        X.whois_facts(F.col("whois")),
        X.dns_facts(F.col("dns")),
        X.geo_facts(F.col("geo"), F.col("brand.expected_country")),
        X.brand_identity_facts(F.col("tls"), F.col("whois"), F.col("brand")),
    ]
    out = df.withColumn("__raw", F.concat(*sources))
    return out.withColumn("__raw", X.first_of_each(F.col("__raw"))).withColumn("signals", X.with_tls_risk(F.col("__raw"))).drop("__raw")


def parsed_jobs(df: DataFrame) -> DataFrame:
    """``df`` with path and doc; pages that are decided already aren't parsed."""
    jobs = with_optional(df).withColumn("path", early_path())
    jobs = jobs.withColumn("html", F.when(F.col("path") == "kbs", F.col("html")))
    return H.with_document(jobs, "html", "rendered_text")


def classify_rows(df: DataFrame) -> DataFrame:
    """(job_id, path, label, confidence, classified_as, scores, fired_rules, signals), a row for each row of ``df``."""
    return label_parsed(parsed_jobs(df))


def label_parsed(parsed: DataFrame) -> DataFrame:
    """classify_rows() of jobs that went through parsed_jobs()."""
    own = signals(findings(parsed)).select("job_id", "path", "signals", F.col("f_gambling_strong").alias("__g"), F.col("f_adult_strong").alias("__a"))
    own = own.withColumn("signal_names", X.names(F.col("signals")))
    scored = scoring.score(own, many={"gambling_strong_many": F.size("__g") >= 2, "adult_strong_many": F.size("__a") >= 2})
    path = F.col("path")
    label = F.when(path == "kbs", F.col("label")).when(path == "access_denied", "Access_Denied").when(path == "trust", "Official").otherwise("Unresolved")
    confidence = F.when(path == "kbs", F.col("confidence")).when(path.isin("access_denied", "trust"), "high").otherwise("low")
    shown = F.when(path.isin("brand_unresolved", "empty_html"), "unresolved").otherwise(path)
    judged = lambda c: F.when(path == "kbs", F.col(c)).alias(c)
    return scored.select("job_id", shown.alias("path"), label.alias("label"), confidence.alias("confidence"), judged("classified_as"), judged("scores"), judged("fired_rules"), judged("signals"))


def classify(
    jobs: DataFrame,
    brands: DataFrame | None = None,
    intel: dict[str, DataFrame] | None = None,
    probes: DataFrame | None = None,
    chains: DataFrame | None = None,
    chunk_vectors: DataFrame | None = None,
    phrases: DataFrame | semantic.Library | None = None,
    logos: DataFrame | None = None,
    translations: DataFrame | None = None,
    vectors: DataFrame | None = None,
    logo_vectors: DataFrame | None = None,
    image_vectors: DataFrame | None = None,
) -> DataFrame:
    """Jobs (job_id, url, html and optional columns) with everything that is known about them joined on, then classified.

    job_id is unique.  Look-ups move narrow rows; the pages themselves are joined to what they gave once, by job_id, and
    parsed once.

    brands: to resolve brand_id and user_input against.  intel: tables tls, whois, dns and geo by host.  probes: (url,
    http_status, body_excerpt, error).  chains: (page_url, hops, final_html, error).

    Semantic facts need phrases, a table or a stored library, and vectors (text, vector): pages are parsed, their texts
    translated by translations (lang, text, translated) where those are given, cut into chunks and looked up by what they say.
    chunk_vectors are ready-made chunks in their place.  Logos need logo_vectors (brand_id, logo_vector) and image_vectors (url,
    vector): the images that a page shows are ranked and looked up; logos are ready-made results, as find_logo gives them.
    Tables that are missing leave their signals absent.
    """
    pages = [c for c in ("html", "rendered_text") if c in jobs.columns]
    semantic_pages = vectors is not None and phrases is not None
    logo_pages = logo_vectors is not None and image_vectors is not None
    looked_up = any(x is not None for x in (brands, intel, chunk_vectors, logos, chains))
    rows = jobs.drop(*pages) if looked_up else jobs
    if brands is not None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("brand_id", "user_input") if c not in rows.columns})
        rows = B.resolve(rows, brands).withColumn("brand_resolved", F.col("brand").isNotNull())
    if intel is not None:
        rows = trust.gather(rows, **intel)
    if chunk_vectors is not None and phrases is not None and not semantic_pages:
        rows = rows.join(derived(semantic.match(chunk_vectors, phrases)), "job_id", "left")
    if logos is not None and not logo_pages:
        rows = rows.join(logos.select("job_id", F.col("detected").alias("brand_image_detected")), "job_id", "left")
    if chains is not None:
        domain = L.official_domain(F.col("url"), with_optional(rows)["brand.official_domains"]) if "brand" in rows.columns else L.official_domain(F.col("url"), F.lit(None).cast("array<string>"))
        rows = rows.join(chains.withColumnRenamed("page_url", "url"), "url", "left").withColumn("redirects", L.redirects(F.col("hops"), F.col("final_html"), F.col("url"), domain, F.col("error"))).drop("hops", "final_html", "error")
    if looked_up:
        rows = rows.join(jobs.select("job_id", *pages), "job_id")
    if probes is None and not semantic_pages and not logo_pages:
        return classify_rows(rows)
    parsed = keep(parsed_jobs(rows))  # read several times, parsed once
    found: dict[str, DataFrame] = {}
    if semantic_pages:
        texts = translation.translated_units(parsed, translations) if translations is not None else None
        chunks = keep(semantic.page_chunks(parsed, texts))  # looked up, counted and placed
        found["derived_facts"] = derived(semantic.match_texts(chunks, vectors, phrases))
    if logo_pages:
        found["brand_image_detected"] = logo_found(parsed, logo_vectors, image_vectors)
    if probes is not None:
        found["link_health"], found["navigation_status"] = probed(parsed, probes)
    for column, df in found.items():
        parsed = parsed.drop(column).join(keep(df) if len(found) > 1 else df, "job_id", "left")
    return label_parsed(parsed)


def derived(matches: DataFrame) -> DataFrame:
    """(job_id, derived_facts)."""
    return semantic.derive(matches).select("job_id", F.col("facts").alias("derived_facts"))


def logo_found(parsed: DataFrame, logo_vectors: DataFrame, image_vectors: DataFrame) -> DataFrame:
    """(job_id, brand_image_detected) of parsed pages with images and a brand that has a logo."""
    shown = parsed.select("job_id", "url", F.col("doc.images").alias("images"), F.col("brand.brand_names").alias("brand_names"), F.lower("brand.brand_id").alias("brand_key")).where("size(images) > 0 AND size(brand_names) > 0")
    known = logo_vectors.groupBy(F.lower("brand_id").alias("brand_key")).agg(F.min("logo_vector").alias("logo_vector"))
    logo = look_up(shown.select("job_id", "brand_key"), known, "brand_key", F.col("job_id")).where("logo_vector IS NOT NULL").drop("brand_key")
    candidates = semantic.image_candidates(shown).join(logo, "job_id").select("job_id", "url", "rank", "logo_vector")
    return semantic.find_logo(candidates, image_vectors).select("job_id", F.col("detected").alias("brand_image_detected"))


def probed(parsed: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job_id, link_health) of pages with too many dead links, and (job_id, navigation_status), of parsed pages."""
    target = L.targets(F.col("doc.anchor_targets"), F.col("url"))
    pages = parsed.select(F.col("job_id").alias("page"), "url", L.trust_navigation(F.col("doc.trust_items")).alias("navigation"), target.alias("t"))
    urls = F.concat(F.col("t.urls"), F.array_repeat(F.lit(None).cast("string"), F.col("t.placeholders")))
    state = L.health(pages.select("page", F.posexplode(urls).alias("pos", "url")), probes).where("exceeds_threshold")
    fields = [c.split(":")[0].strip() for c in OPTIONAL["link_health"][7:-1].split(",")]
    state = state.select(F.col("page").alias("job_id"), F.struct(*fields).cast(OPTIONAL["link_health"]).alias("link_health"))
    return state, L.trust_status(pages.drop("t"), probes).select(F.col("page").alias("job_id"), F.col("trust_status").alias("navigation_status"))


def batch(jobs: DataFrame, index: str = "index", **tables) -> DataFrame:
    """Results in the jobs' order, with an error where a job has no url; other jobs aren't touched by it."""
    bad = F.trim(F.coalesce("url", F.lit(""))) == ""
    own = jobs.withColumn("job_id", F.col(index))
    good = classify(own.where(~bad), **tables).select(F.col("job_id").alias(index), "label", "confidence", "path", F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    return good.unionByName(own.where(bad).select(index, none.alias("label"), none.alias("confidence"), none.alias("path"), F.lit("url is required").alias("error"))).orderBy(index)
