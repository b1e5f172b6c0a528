"""Detectors over raw HTML, hosts and DNS records, as Column expressions.

Presence only: a detector that finds nothing gives false, null or an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import url as U
from ..functions.text import bind, escape, first_wins, strip_tags

EMPTY = "array<string>"


def _html(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lists_any(items: Column, words: list[str]) -> Column:
    """Some item contains some of the words."""
    return F.exists(items, lambda x: contains_any(x, words))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


# --- inputs and forms ------------------------------------------------------------------------------------------------

def sensitive_inputs(html: Column) -> dict[str, Column]:
    """For each kind, whether some input tag asks for it."""
    tags = F.transform(all_matches(_html(html), fixed.INPUT_TAG), lambda t: F.lower(t))
    out = {k: F.exists(tags, _named(names)) for k, names in fixed.INPUT_NAMES.items()}
    out["password"] = out["password"] | F.exists(tags, lambda t: t.rlike(r"type\s*=\s*['\"]?password"))
    return out


def _named(names: str):
    return lambda t: t.rlike(rf"(?:name|id|autocomplete)\s*=\s*['\"]?(?:{names})")


def has_file_upload(html: Column) -> Column:
    return _html(html).rlike(fixed.FILE_TAG)


ACTION_REASONS = {
    "cross": "what is entered goes to another domain",
    "ip": "what is entered goes to a bare IP address",
    "script": "the action is a script",
}


def form_actions(html: Column, domain: Column) -> Column:
    """Suspicious (action, reason) of forms, in order; empty without an expected domain."""
    own = F.regexp_replace(F.lower(domain), "^www\\.", "")
    actions = F.transform(all_matches(_html(html), fixed.FORM_TAG), lambda f: F.trim(F.regexp_extract(f, fixed.FORM_ACTION, 1)))

    def judged(a: Column) -> Column:
        there = F.regexp_replace(U.host(a), "^www\\.", "")
        reason = lambda k: F.struct(a.alias("action"), F.lit(ACTION_REASONS[k]).alias("reason"))
        parsed = there.isNotNull()
        # a script's address parses as one without host, which is not the expected one
        cross = F.when(parsed & ~((there == own) | F.endswith(there, F.concat(F.lit("."), own))), reason("cross"))
        ip = F.when(parsed & there.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), reason("ip"))
        script = F.when(~parsed & F.lower(a).startswith("javascript:"), reason("script"))
        return F.array_compact(F.array(cross, ip, script))

    local = lambda a: a.rlike(r"^(?:$|[/?#])")
    found = F.flatten(F.transform(F.filter(actions, lambda a: ~local(a)), judged))
    return F.when(F.coalesce(domain, F.lit("")) != "", found).otherwise(F.array().cast("array<struct<action: string, reason: string>>"))


def is_likely_phishing(actions: Column) -> Column:
    """Some form goes to another domain or a bare address; script actions alone don't count."""
    return F.exists(actions, lambda a: a["reason"].isin(ACTION_REASONS["cross"], ACTION_REASONS["ip"]))


# --- redirects -------------------------------------------------------------------------------------------------------

def client_redirects(html: Column, base: Column) -> Column:
    """(url, type) of meta refreshes, then script assignments, then script calls; absolute where that is possible."""
    kinds = ((fixed.META, "meta"), (fixed.ASSIGN, "javascript"), (fixed.METHOD, "javascript"))
    return F.concat(*[F.transform(all_matches(_html(html), p, 1), _redirect(k, base)) for p, k in kinds])


def _redirect(kind: str, base: Column):
    return lambda u: F.struct(F.coalesce(U.resolve(F.trim(u), base), F.trim(u)).alias("url"), F.lit(kind).alias("type"))


def meta_refresh(html: Column) -> Column:
    """(delay, target) of the first meta refresh that has both, else null."""
    tag = F.regexp_extract(_html(html), fixed.REFRESH_TAG, 0)
    content = r"(?i)content\s*=\s*['\"]?([0-9]+)\s*;\s*url\s*=\s*([^'\"]+)['\"]?"
    return F.when(tag.rlike(content), F.struct(F.regexp_extract(tag, content, 1).try_cast("int").alias("delay"), F.trim(F.regexp_extract(tag, content, 2)).alias("target")))


# --- shop, contact, gallery ------------------------------------------------------------------------------------------


def has_microdata(html: Column) -> Column:
    return _html(html).rlike(r"(?i)itemtype\s*=\s*['\"]https?://schema\.org/(?:Product|Offer)['\"]") | _html(html).rlike(r"(?i)itemprop\s*=\s*['\"]price['\"]")


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks of a page, as text."""
    return all_matches(_html(html), r"(?is)<script[^>]*type\s*=\s*['\"]application/ld\+json['\"][^>]*>(.*?)</script>", 1)


def has_product_json(html: Column) -> Column:
    """A top-level object (or one of a top-level list) whose @type is, or lists, Product or Offer."""
    kinds = ("Product", "Offer")

    def is_product(v: Column) -> Column:
        one = F.try_variant_get(v, "$['@type']", "string").isin(*kinds)
        many = F.exists(F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array().cast(EMPTY)), lambda t: t.isin(*kinds))
        return F.coalesce(one, F.lit(False)) | many

    def block(text: Column) -> Column:
        v = F.try_parse_json(text)
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        return F.coalesce(F.exists(items, is_product), F.lit(False))

    return F.exists(json_ld(html), block)


def free_webmail(html: Column) -> Column:
    """Lower-cased addresses at free mail hosts: all of mailto links, then of the text's first 200,000 characters until there are five."""
    mailto = F.filter(F.transform(all_matches(_html(html), r"(?i)mailto:([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})", 1), F.lower), lambda m: m.rlike(f"@(?:{fixed.WEBMAIL})\\."))
    plain = F.substring(F.regexp_replace(_html(html), r"(?is)<script.*?</script>", " "), 1, 200_000)
    text = F.array_distinct(F.transform(all_matches(plain, rf"(?i)\b([a-z0-9._%+-]+@(?:{fixed.WEBMAIL})\.[a-z]{{2,}})\b", 1), F.lower))
    # a new address is always added before the number is looked at
    return bind(F.array_distinct(mailto), lambda links: F.concat(links, F.slice(F.array_except(text, links), 1, F.greatest(F.lit(1), F.lit(5) - F.size(links)))))


def offplatform_chat(html: Column) -> Column:
    """The first five addresses at chat hosts, distinct but for case.  Hosts aren't anchored."""
    hosts = "|".join(escape(h) for h in fixed.CHAT_HOSTS)
    found = all_matches(_html(html), rf"(?i)(?:https?://)?(?:{hosts})(?:/[^\s\"'<>]*)?")
    return F.slice(first_wins(found), 1, 5)


def copyright_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + fixed.COPYRIGHT)


def dense_gallery(kinds: Column, html: Column) -> Column:
    """Twenty images (icons and shared ones aside), or twelve and a video."""
    n = F.size(F.filter(kinds, lambda k: ~k.isin("icon", "og")))
    video = F.exists(kinds, lambda k: k == "poster") | _html(html).rlike(r"(?i)<video\b")
    return (n >= 20) | ((n >= 12) & video)


def shop_tld(host: Column) -> Column:
    """The host's last label if it is one that disposable shops use."""
    own = U.tld(host)
    return F.when(own.isin(*fixed.SHOP_TLDS), own)


def adult_tld(host: Column) -> Column:
    own = U.tld(host)
    return F.when(own.isin(*fixed.ADULT_TLDS), own)


# --- brand -----------------------------------------------------------------------------------------------------------


def brand_in_host(host: Column, brand: Column) -> Column:
    """A word of the brand, or all its letters together, is a label of the host or part of one between - and _."""
    low = F.lower(F.coalesce(brand, F.lit("")))
    tokens = F.filter(F.array_distinct(F.concat(F.split(low, "[^a-z0-9]+"), F.array(F.regexp_replace(low, "[^a-z0-9]+", "")))), lambda t: F.length(t) >= 2)
    own = F.split(F.lower(F.coalesce(host, F.lit(""))), "\\.")
    parts = F.flatten(F.transform(own, lambda p: F.split(p, "[-_]")))
    return F.arrays_overlap(tokens, F.concat(own, parts))


# --- DNS -------------------------------------------------------------------------------------------------------------


def parking_name_servers(records: Column) -> Column:
    return F.filter(records, lambda n: contains_any(F.regexp_replace(F.lower(n), "\\.$", ""), fixed.PARKING_NAME_SERVERS))


def parking_ips(records: Column) -> Column:
    def parked(ip: Column) -> Column:
        out = ip.isin(*fixed.PARKING_IPS)
        for s in fixed.PARKING_SUBNETS:
            out = out | ip.startswith(s)
        return out

    return F.filter(records, parked)


def parking_flag(records: Column) -> Column:
    return F.when(records.isNull(), "UNRESOLVED").when(F.size(parking_ips(records)) > 0, "PARKED_INFRASTRUCTURE").otherwise("CLEAN")


def no_email(mx: Column, txt: Column) -> Column:
    """A null MX record, or an SPF record that allows no sender."""
    null_mx = (F.size(mx) == 1) & (F.get(mx, F.lit(0))["priority"] == 0) & F.get(mx, F.lit(0))["exchange"].isin(".", "")
    spf = F.exists(txt, lambda t: F.trim(F.regexp_replace(F.lower(F.array_join(t, "")), r"\s+", " ")) == "v=spf1 -all")
    return F.coalesce(null_mx, F.lit(False)) | F.coalesce(spf, F.lit(False))


def visible_text(html: Column) -> Column:
    """Text between tags without scripts and styles, for pages that aren't parsed."""
    plain = F.regexp_replace(_html(html), r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(strip_tags(plain), r"\s+", " "))
