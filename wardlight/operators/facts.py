"""Signals: named positive evidence, as an array of structs in a fixed order.

A condition that is null counts as false.  Of several signals of one name the first stays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import url as U
from ..functions.text import bind, first_wins
from .detectors import contains_any

SIGNAL = "array<struct<signal: string, grp: string, strength: double, value: string, evidence: string>>"
TRUE = "true"


def signal(when: Column, name: str, grp: str, strength: float | Column, value=TRUE, evidence="") -> Column:
    """A signal if the condition holds.  What is constant goes to the engine as one piece of SQL: building plans costs by the call."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = {"signal": name, "grp": grp, "strength": strength, "value": value, "evidence": evidence}
    if not any(isinstance(x, Column) for x in parts.values()):
        sql = ", ".join(f"'{k}', {quoted(v) if isinstance(v, str) else f'{float(v)!r}D'}" for k, v in parts.items())
        return F.when(when, F.expr(f"named_struct({sql})"))
    as_col = lambda k, x: (x.cast("double" if k == "strength" else "string") if isinstance(x, Column) else F.expr(quoted(x) if isinstance(x, str) else f"{float(x)!r}D")).alias(k)
    return F.when(when, F.struct(*[as_col(k, x) for k, x in parts.items()]))


def signals(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast(SIGNAL)


def first_of_each(facts: Column) -> Column:
    return first_wins(facts, lambda f: f["signal"])


MEMORY = "array<struct<signal: string, grp: string, strength: double, value: string, evidence: array<string>>>"


def assert_signals(asserted: Column) -> Column:
    """What is remembered of ``asserted`` (as MEMORY, in order of assertion): an entry a signal, in order of first assertion.

    A later assertion of a signal takes the place of an earlier one only if it is stronger, with its value and all its
    evidence; strengths are kept within 0 and 1, so one above 1 takes the place of one that was cut to 1.
    """

    def strongest(own: Column) -> Column:
        kept = lambda x: F.struct(x["signal"].alias("signal"), x["grp"].alias("grp"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x["strength"])).alias("strength"), x["value"].alias("value"), x["evidence"].alias("evidence"))
        rest = F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0)))
        return F.aggregate(rest, kept(F.get(own, F.lit(0))), lambda a, x: F.when(x["strength"] > a["strength"], kept(x)).otherwise(a))

    def each(all_: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(all_, lambda x: x["signal"])), lambda n: strongest(F.filter(all_, lambda x: x["signal"] == n)))

    return bind(F.filter(asserted.cast(MEMORY), lambda x: x["signal"].isNotNull()), each).cast(MEMORY)


def by_strength(memory: Column) -> Column:
    """The remembered signals as a map by name, the strongest first, equally strong ones in order of first assertion."""
    indexed = F.transform(memory, lambda x, i: F.struct((-x["strength"]).alias("s"), i.alias("i"), x.alias("x")))
    return F.map_from_entries(F.transform(F.array_sort(indexed), lambda e: F.struct(e["x"]["signal"].alias("key"), e["x"].alias("value"))))


def get_signal(memory: Column, name: Column | str) -> Column:
    """A remembered signal, null if there is none."""
    wanted = F.lit(name) if isinstance(name, str) else name
    return F.get(F.filter(memory, lambda x: x["signal"] == wanted), F.lit(0))


def names(facts: Column) -> Column:
    return F.transform(facts, lambda f: f["signal"])


def org_matches(candidate: Column, known: Column) -> Column:
    """Letters and digits of one are in the other's; both at least three."""
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    own = key(candidate)
    return F.coalesce((F.length(own) >= 3) & F.exists(F.transform(known, key), lambda k: (F.length(k) >= 3) & (own.contains(k) | k.contains(own))), F.lit(False))


def days_between(a: Column, b: Column) -> Column:
    day = lambda c: F.unix_millis(F.try_to_timestamp(c))
    return F.floor((day(b) - day(a)) / 86_400_000).cast("int")


def tls_facts(tls: Column) -> Column:
    secure = F.coalesce(tls["uses_https"] & tls["authorized"] & ~F.coalesce(tls["is_expired"], F.lit(False)), F.lit(False))
    have = tls.isNotNull()
    issuer = F.lower(tls["issuer_org"])
    why = F.when(~F.coalesce(tls["uses_https"], F.lit(False)), "HTTP (no TLS)").when(tls["is_expired"], F.concat(F.lit("certificate expired on "), F.coalesce(tls["valid_to"], F.lit("?")))).otherwise(F.concat(F.lit("untrusted cert: "), F.coalesce(tls["error"], F.lit("unknown error"))))
    return signals(
        signal(have & secure, "has_secure_connection", "identity", 0.9, TRUE, "Connection is encrypted and certificate chain is trusted"),
        signal(have & ~secure, "insecure_connection", "identity", 1.0, TRUE, why),
        signal(tls["hostname_mismatch"], "tls_identity_mismatch", "identity", 1.0, TRUE, "TLS certificate subject does not match hostname"),
        signal(tls["is_expired"], "tls_is_expired", "identity", 1.0, TRUE, F.concat(F.lit("TLS certificate expired on "), F.coalesce(tls["valid_to"], F.lit("?")))),
        signal(contains_any(issuer, fixed.FREE_CAS), "is_free_or_automated_tls", "identity", 0.5, tls["issuer_org"], F.concat(F.lit("Certificate issued by free/automated CA: "), tls["issuer_org"])),
        signal(tls["issuer_level"].isin("OV", "EV"), "has_enterprise_tls", "identity", 0.9, tls["issuer_level"], F.concat(F.lit("Certificate carries validation of level "), tls["issuer_level"])),
    )


def whois_facts(whois: Column) -> Column:
    age = whois["age_in_days"]
    span = days_between(whois["created_date"], whois["expires_date"])
    inactive = F.filter(whois["domain_status"], lambda s: contains_any(F.lower(s), fixed.INACTIVE_STATUSES))
    org = F.lower(whois["registrant_org"])
    return signals(
        signal(age < 30, "is_newly_registered", "lifecycle", 1.0, age, F.concat(F.lit("Days since registration: "), age)),
        signal((age >= 30) & (age < 180), "young_domain", "lifecycle", F.round(1 - age / 180.0, 2), age, F.concat(F.lit("Days since registration: "), age)),
        signal(age > 1825, "established_domain", "lifecycle", 1.0, age, F.concat(F.lit("Days since registration: "), age)),
        signal(span < 400, "is_short_term_registration", "lifecycle", 0.7, span, F.concat(F.lit("Days registered for: "), span)),
        signal(contains_any(org, fixed.PRIVACY_WORDS), "has_hidden_registrant", "identity", 0.4, whois["registrant_org"], F.concat(F.lit("Registrant is privacy-shielded: "), whois["registrant_org"])),
        signal(F.size(inactive) > 0, "is_inactive_domain_status", "lifecycle", 0.9, F.to_json(inactive), F.concat(F.lit("Domain status: "), F.get(inactive, F.lit(0)))),
    )


def sinkhole_ips(records: Column) -> Column:
    return F.filter(F.transform(records, lambda ip: F.lower(F.trim(ip))), lambda ip: ip.isin(*fixed.SINKHOLES))


def dns_facts(dns: Column) -> Column:
    sunk = sinkhole_ips(dns["a_records"])
    mx = F.coalesce(dns["has_mx"], F.lit(False))
    return signals(
        signal(F.size(sunk) > 0, "dns_sinkhole_detected", "infrastructure", 1, F.to_json(sunk), F.concat(F.lit("DNS A records point to sinkholes: "), F.array_join(sunk, ", "))),
        signal(dns.isNotNull() & mx, "has_email_capability", "infrastructure", 0.8, TRUE, "MX records present"),
        signal(dns.isNotNull() & ~mx, "no_email_capability", "infrastructure", 0.9, TRUE, "No MX records"),
    )


def provider_category(isp: Column, asn: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(isp, F.lit("")), F.coalesce(asn, F.lit(""))))
    out = F.lit("Unknown")
    for name, words in reversed(list(fixed.PROVIDERS.items())):
        out = F.when(contains_any(text, words), name).otherwise(out)
    return out


def geo_facts(geo: Column, expected_country: Column) -> Column:
    country = F.when(F.coalesce(geo["country"], F.lit("")) != "", geo["country"])
    wanted = F.when(F.coalesce(expected_country, F.lit("")) != "", expected_country)
    same = F.lower(country) == F.lower(wanted)
    category = provider_category(geo["isp"], geo["asn"])
    return signals(
        signal(geo["is_bulletproof"], "is_hosted_on_bulletproof", "infrastructure", 0.95, geo["isp"], F.concat(F.lit("Bulletproof hosting provider: "), F.coalesce(geo["isp"], F.lit("")))),
        signal(geo.isNotNull(), "hosting_provider_category", "infrastructure", 0.7, category, F.concat(F.lit("Hosted on provider of kind "), category)),
        signal(country.isNotNull(), "hosting_country", "infrastructure", 1.0, country, F.concat(F.lit("Hosted in "), country)),
        signal(same, "country_matches_target", "infrastructure", 0.8, TRUE, F.concat(F.lit("Hosting country matches: "), country)),
        signal(~same, "country_mismatch", "infrastructure", 0.85, TRUE, F.concat(F.lit("Hosted in "), country, F.lit(" but brand targets "), wanted)),
    )


def brand_identity_facts(tls: Column, whois: Column, brand: Column) -> Column:
    """Organisations of certificate and registration against the brand's own."""
    known = lambda field: F.concat(F.coalesce(brand[field], F.array().cast("array<string>")), F.coalesce(brand["brand_names"], F.array().cast("array<string>")))
    by_tls = F.coalesce(brand.isNotNull() & tls["issuer_level"].isin("OV", "EV") & org_matches(tls["subject_org"], known("tls_subject_organizations")), F.lit(False))
    by_whois = F.coalesce(brand.isNotNull() & org_matches(whois["registrant_org"], known("registrant_organizations")), F.lit(False))
    return signals(
        signal(by_tls, "brand_tls_org_match", "identity", 1, tls["subject_org"], "TLS subject organization matches the brand"),
        signal(by_whois, "brand_registrant_org_match", "identity", 1, whois["registrant_org"], "WHOIS registrant organization matches the brand"),
        signal(by_tls | by_whois, "brand_org_identity_match", "identity", 1, TRUE, "Organization identity matches the brand profile"),
    )


def status_facts(status: Column) -> Column:
    return signals(signal(status.isin(*fixed.DENIED_STATUSES), "http_access_denied_status", "structural", 1, status, F.concat(F.lit("Main-document HTTP status "), status)))


def url_facts(url: Column) -> Column:
    parsed = U.host(url)
    host = F.coalesce(parsed, url, F.lit(""))
    return signals(
        signal(F.lit(True), "hostname", "structural", 1, host, F.concat(F.lit("Hostname: "), host)),
        signal(parsed.isNotNull() & (U.scheme(url) != "https"), "no_https", "identity", 1, TRUE, "Page is served over HTTP"),
        signal(F.size(U.labels(host)) > 2, "is_subdomain", "identity", 1, TRUE, F.concat(F.lit("Labels in hostname: "), F.size(U.labels(host)))),
    )


def form_facts(forms: Column, url: Column) -> Column:
    own = F.coalesce(U.host(url), F.lit(""))
    hosts = F.filter(F.transform(forms, lambda f: U.host(f["action"])), lambda h: (h != "") & (h != own))
    off = F.exists(forms, lambda f: F.exists(f["inputs"], lambda i: (i["type"] == "password") & (i["autocomplete"] == "off")))
    return signals(
        signal(F.size(hosts) > 0, "external_form_action", "phishing", 1, F.to_json(hosts), F.concat(F.lit("Form submits to external host: "), F.array_join(hosts, ", "))),
        signal(off, "autocomplete_off_on_password", "phishing", 1, TRUE, "Password field has autocomplete='off'"),
    )


def page_facts(f: dict[str, Column]) -> Column:
    """From page findings; a finding that is missing from ``f`` counts as absent."""
    none = F.lit(None)
    get = lambda k, kind: f.get(k, none.cast(kind))
    flag = lambda k: get(k, "boolean")
    texts = lambda k: get(k, "array<string>")
    actions = get("form_actions", "array<struct<action: string, reason: string>>")
    redirects = get("redirects", "struct<was_redirected: boolean, is_cross_domain: boolean, types: array<string>, targets: array<string>>")
    links = get("link_health", "struct<broken_ratio: double, broken_count: bigint, evaluable_count: bigint, placeholder_count: bigint, dominant_url: string, dominant_share: double, destination_dead: boolean>")
    reasons = F.array_join(F.transform(actions, lambda a: a["reason"]), "; ")
    words = lambda k: F.array_join(F.slice(texts(k), 1, 8), ", ")
    some = lambda k: F.size(texts(k)) > 0
    kinds = [("password", "phishing"), ("username", "phishing"), ("otp", "phishing"), ("financial", "scam"), ("identity", "scam")]
    return signals(
        signal(flag("brand_name_present"), "brand_name_present", "identity", 1, TRUE, "Brand name detected in page text"),
        signal(flag("brand_image_detected"), "brand_image_detected", "identity", 1, TRUE, "Brand image detected on the page"),
        signal(flag("brand_in_markup"), "brand_in_markup", "identity", 1, TRUE, "Brand name detected in markup"),
        *[signal(flag(f"has_{k}"), f"has_{k}_input", g, 1, TRUE, f"Input field of kind {k}") for k, g in kinds],
        signal(flag("has_file_upload"), "has_file_upload", "phishing", 1, TRUE, "File upload input detected"),
        signal(flag("is_official_subdomain"), "is_official_subdomain", "structural", 1, TRUE, "Host is an official domain or below one"),
        signal(F.size(actions) > 0, "external_form_action", "phishing", 1, F.to_json(actions), reasons),
        signal(redirects["is_cross_domain"], "cross_domain_redirect", "structural", 0.9, F.to_json(redirects["targets"]), "Page redirects cross-domain"),
        signal(F.array_contains(redirects["types"], "http") & redirects["was_redirected"], "http_redirect", "structural", 0.6, F.to_json(redirects["targets"]), "HTTP redirect in the chain"),
        signal(F.array_contains(redirects["types"], "meta"), "meta_redirect", "structural", 0.7, F.to_json(redirects["targets"]), "Meta refresh redirect on the page"),
        signal(links.isNotNull(), "excessive_dead_links", "structural", 0.85, F.to_json(links), F.concat(links["broken_count"], F.lit("/"), links["evaluable_count"], F.lit(" anchors broken"))),
        signal(links["destination_dead"], "conversion_destination_dead", "structural", 0.9, links["dominant_url"], F.concat(F.lit("Primary destination is unreachable: "), links["dominant_url"])),
        signal(flag("has_copyright"), "has_copyright", "structural", 0.5, TRUE, "Copyright notice found"),
        signal(flag("missing_copyright"), "missing_copyright", "structural", 0.7, TRUE, "No copyright notice found"),
        signal(flag("ecommerce_schema"), "ecommerce_schema_present", "fake_shop", 1, TRUE, "Product or offer schema detected"),
        signal(flag("has_pricing_patterns"), "pricing_patterns_present", "fake_shop", 1, TRUE, "Currency and price patterns detected"),
        signal(flag("unrealistic_discount"), "unrealistic_discount_detected", "fake_shop", 1, TRUE, "A high share of extreme discounts"),
        signal(get("suspicious_shop_tld", "string").isNotNull(), "suspicious_shop_tld", "fake_shop", 0.8, get("suspicious_shop_tld", "string"), "Hostname uses a high-risk shop TLD"),
        signal(some("free_webmail"), "free_webmail_contact", "fake_shop", 0.75, F.to_json(F.slice(texts("free_webmail"), 1, 3)), words("free_webmail")),
        signal(some("offplatform_chat"), "offplatform_chat_contact", "scam", 0.85, F.to_json(F.slice(texts("offplatform_chat"), 1, 3)), words("offplatform_chat")),
        *[signal(some(f"{k}_{tier}"), f"{tier}_{k}_language", "content", power, F.size(texts(f"{k}_{tier}")), words(f"{k}_{tier}")) for k in ("gambling", "adult") for tier, power in (("definitive", 1), ("strong", 0.9), ("weak", 0.5))],
        signal(flag("adult_age_gate"), "adult_age_gate_detected", "content", 0.85, TRUE, "Age gate phrases"),
        signal(get("adult_tld", "string").isNotNull(), "adult_tld_detected", "content", 0.9, get("adult_tld", "string"), "Adult TLD"),
        signal(flag("dense_gallery"), "dense_media_gallery", "content", 0.75, TRUE, "Dense media gallery"),
        signal(get("parking_clue", "string").isNotNull(), "parking_keywords_present", "structural", 1, TRUE, get("parking_clue", "string")),
        signal(some("parked_name_servers"), "parked_nameservers_detected", "structural", 0.9, F.to_json(texts("parked_name_servers")), words("parked_name_servers")),
        signal(some("parked_ips"), "parked_ip_detected", "structural", 0.95, F.to_json(texts("parked_ips")), words("parked_ips")),
        signal(flag("no_email"), "no_email_infrastructure", "structural", 0.7, TRUE, "Null MX or an SPF record without senders"),
    )


def trust_navigation_facts(status: Column) -> Column:
    return signals(
        signal(status == "missing", "missing_trust_navigation", "trust", 0.8, TRUE, "No trust navigation found"),
        signal(status == "broken", "error_trust_navigation", "trust", 0.75, TRUE, "Trust navigation doesn't work"),
    )


def semantic_facts(derived: Column) -> Column:
    return F.transform(F.coalesce(derived, F.array().cast("array<string>")), lambda n: F.struct(n.alias("signal"), F.lit("semantic").alias("grp"), F.lit(1.0).alias("strength"), F.lit(TRUE).alias("value"), n.alias("evidence"))).cast(SIGNAL)


def trusted_facts(status: Column) -> Column:
    return signals(signal(status == "TRUSTED_INFRA", "trusted_infra", "identity", 1, TRUE, "Structural trust of the host"))


#: What makes a connection risky, in the order in which reasons are given.
TLS_RISKS = {
    "no_https": "Page served over HTTP",
    "insecure_connection": "No trusted secure connection",
    "tls_is_expired": "TLS certificate is expired",
    "tls_identity_mismatch": "TLS certificate identity mismatch",
    "invalid_cert": "TLS certificate is invalid or expired",
}


def with_tls_risk(facts: Column) -> Column:
    """The facts, and one more if any of them makes the connection risky."""
    reasons = lambda known: F.array_compact(F.array(*[F.when(F.array_contains(known, k), v) for k, v in TLS_RISKS.items()]))
    risk = lambda why: signals(signal(F.size(why) > 0, "tls_risk", "identity", 1, TRUE, F.array_join(why, "; ")))
    return bind(facts, lambda own: F.concat(own, bind(bind(names(own), reasons), risk)))


def input_facts(*sources: Column) -> Column:
    """All sources in order, the first of each name, then what follows from them."""
    return with_tls_risk(first_of_each(F.concat(*sources)))


