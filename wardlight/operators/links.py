"""Links of a page against the outcomes of probing them: health, trust navigation, redirects.

Probes are a table (url, http_status, body_excerpt, error); a url without a row counts as a network error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import url as U
from ..functions.skew import look_up
from ..functions.text import bind, first_wins
from .detectors import client_redirects, contains_any


def probe_status(status: Column, body: Column, error: Column) -> Column:
    """A page that says it isn't there is soft_dead whatever its status; from 400 hard_dead; else alive."""
    missing = error.isNotNull() | status.isNull()
    return F.when(missing, "network_error").when(contains_any(F.lower(F.coalesce(body, F.lit(""))), fixed.SOFT_404), "soft_dead").when(status >= 400, "hard_dead").otherwise("alive")


def targets(raw: Column, page_url: Column) -> Column:
    """Struct (placeholders, urls) of the targets of a page's anchors."""
    own = F.filter(F.transform(raw, lambda h: F.trim(h)), lambda h: h != "")
    placeholder = lambda h: (h == "#") | F.lower(h).contains("javascript:void")
    skipped = lambda h: F.lower(h).rlike("^(?:" + "|".join(fixed.SKIPPED) + ")")
    urls = F.transform(F.filter(own, lambda h: ~placeholder(h) & ~skipped(h)), lambda h: U.resolve(h, page_url))
    return F.struct(F.size(F.filter(own, placeholder)).alias("placeholders"), F.filter(urls, lambda u: u.rlike("(?i)^https?://")).alias("urls"))


def one_probe(probes: DataFrame) -> DataFrame:
    """(url, probe): of several probes of a url the least by status, body and error, nulls first, as one struct."""
    return probes.groupBy("url").agg(F.min(F.struct("http_status", "body_excerpt", "error")).alias("probe"))


def health(anchors: DataFrame, probes: DataFrame, threshold: float = fixed.DEAD_RATIO, dominant: float = fixed.DOMINANT_SHARE) -> DataFrame:
    """A row for each page of ``anchors`` (page, pos, url; a null url is a placeholder) with the state of its links.

    Occurrences are counted before the probes are looked up, so a url is looked up once a page, and one that very many pages
    have over several tasks.  Samples are the first five of a kind on the page; no more are held.  Tests use the exact
    ratio and share; what is returned is rounded to three places.
    """
    state = one_probe(probes).select("url", probe_status(F.col("probe.http_status"), F.col("probe.body_excerpt"), F.col("probe.error")).alias("status"))
    counts = anchors.groupBy("page", "url").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    known = look_up(counts, state, "url", F.col("page")).withColumn("status", F.when(F.col("url").isNull(), "placeholder").otherwise(F.coalesce("status", F.lit("network_error"))))
    of_page = Window.partitionBy("page")
    nth = F.row_number().over(of_page.orderBy("status", "first", "url")) - F.rank().over(of_page.orderBy("status")) + 1
    known = known.withColumn("nth", nth)
    of = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("n"))), F.lit(0))
    sample = lambda s: F.transform(F.array_sort(F.collect_list(F.when((F.col("status") == s) & (F.col("nth") <= fixed.SAMPLES), F.struct("first", "url")))), lambda x: x["url"])
    real = F.col("status") != "placeholder"
    top = F.max_by(F.when(real, F.struct("url", "n", "status")), F.when(real, F.struct(F.col("n"), -F.col("first"))))
    out = known.groupBy("page").agg(
        F.sum("n").alias("evaluable_count"),
        of("placeholder").alias("placeholder_count"),
        F.count(F.when(real, 1)).alias("unique_count"),
        of("alive").alias("alive_count"),
        of("hard_dead").alias("hard_dead_count"),
        of("soft_dead").alias("soft_dead_count"),
        of("network_error").alias("network_error_count"),
        top.alias("top"),
        sample("hard_dead").alias("hard_dead_samples"),
        sample("soft_dead").alias("soft_dead_samples"),
        sample("network_error").alias("network_error_samples"),
    )
    out = out.withColumn("broken_count", F.col("evaluable_count") - F.col("alive_count"))
    ratio, share = F.col("broken_count") / F.col("evaluable_count"), F.coalesce(F.col("top.n") / F.col("evaluable_count"), F.lit(0.0))
    dead = F.coalesce((share >= dominant) & (F.col("top.status") != "alive"), F.lit(False))
    return out.select(
        "page", "evaluable_count", "placeholder_count", "unique_count", "alive_count", "hard_dead_count", "soft_dead_count", "network_error_count", "broken_count",
        F.round(ratio, 3).alias("broken_ratio"), F.col("top.url").alias("dominant_url"), F.round(share, 3).alias("dominant_share"), dead.alias("destination_dead"),
        ((ratio >= threshold) | dead).alias("exceeds_threshold"), "hard_dead_samples", "soft_dead_samples", "network_error_samples",
    )


# --- trust navigation ------------------------------------------------------------------------------------------------


def trust_category(text: Column, href: Column) -> Column:
    corpus = F.concat_ws(" ", text, href)
    return F.coalesce(*[F.when(corpus.rlike("(?i)" + p), F.lit(k)) for k, p in fixed.TRUST_CATEGORIES.items()])


def is_inert(href: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    return (low == "") | (low == "#") | low.startswith("javascript:")


def trust_navigation(items: Column) -> Column:
    """Struct (candidates, non_functional) of a page's anchors, buttons and elements with their role, in this order.

    Of candidates with one address, but for case, the first counts, and the others aren't reported at all.  What has
    no usable address is non-functional, the first of equal category, reason and text.
    """
    own = F.transform(items, lambda t: F.struct(t["text"].alias("text"), F.trim(t["href"]).alias("href"), trust_category(t["text"], t["href_attr"]).alias("category"), t["source"].alias("source")))
    return bind(own, _trust_parts)


def _trust_parts(own: Column) -> Column:
    named = F.filter(own, lambda t: t["category"].isNotNull())
    good = first_wins(F.filter(named, lambda t: ~is_inert(t["href"])), lambda t: F.lower(t["href"]))
    candidates = F.transform(good, lambda t: F.struct(t["text"].alias("text"), t["href"].alias("href"), t["category"].alias("category")))
    reason = lambda t: F.when((t["source"] == "anchor") | (t["href"] != ""), "inert_href").otherwise("non_navigable_control")
    bad = F.transform(F.filter(named, lambda t: is_inert(t["href"])), lambda t: F.struct(t["text"].alias("text"), t["category"].alias("category"), reason(t).alias("reason")))
    bad = first_wins(bad, lambda t: F.concat_ws("|", t["category"], t["reason"], F.lower(t["text"])))
    label = lambda t: F.struct(F.when(t["text"] != "", t["text"]).otherwise(t["category"]).alias("text"), t["category"].alias("category"), t["reason"].alias("reason"))
    return F.struct(candidates.alias("candidates"), F.transform(bad, label).alias("non_functional"))


def trust_status(pages: DataFrame, probes: DataFrame, page: str = "page", url: str = "url", navigation: str = "navigation") -> DataFrame:
    """``pages`` with trust_status (missing, broken or ok), working_url and failures.

    Candidates count in order up to the first that answers with 2xx; those before it are failures.
    """
    nav = F.col(navigation)
    resolved = F.transform(nav["candidates"], lambda c: F.coalesce(U.resolve(c["href"], F.col(url)), F.lit("")))
    each = pages.select(F.col(page).alias("__page"), F.posexplode(F.array_distinct(resolved)).alias("__pos", "__url"))
    answers = one_probe(probes).select(F.col("url").alias("__url"), F.col("probe.http_status").alias("__status"), F.col("probe.error").alias("__error"))
    tried = look_up(each, answers, "__url", F.col("__page"))
    works = (F.col("__status") >= 200) & (F.col("__status") < 300) & F.col("__error").isNull()
    why = F.concat(F.col("__url"), F.lit(" ("), F.coalesce("__error", F.concat(F.lit("HTTP "), F.col("__status")), F.lit("request failed")), F.lit(")"))
    found = tried.groupBy("__page").agg(
        F.min(F.when(works, F.struct("__pos", "__url"))).alias("__winner"), F.array_sort(F.collect_list(F.when(F.coalesce(~works, F.lit(True)), F.struct("__pos", why.alias("why"))))).alias("__failed")
    )
    out = pages.join(found, F.col(page) == F.col("__page"), "left")
    dead = F.transform(nav["non_functional"], lambda t: F.concat(F.lit('"'), t["text"], F.lit('" ('), t["category"], F.lit(", "), t["reason"], F.lit(")")))
    before = F.transform(F.filter("__failed", lambda f: F.col("__winner").isNull() | (f["__pos"] < F.col("__winner.__pos"))), lambda f: f["why"])
    none = (F.size(nav["candidates"]) == 0) & (F.size(nav["non_functional"]) == 0)
    status = F.when(none, "missing").when(F.col("__winner").isNotNull(), "ok").otherwise("broken")
    failures = F.concat(dead, F.when(F.col("__winner").isNull(), F.coalesce(before, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], status.alias("trust_status"), F.col("__winner.__url").alias("working_url"), failures.alias("failures"))


# --- redirects -------------------------------------------------------------------------------------------------------


def redirects(hops: Column, final_html: Column, page_url: Column, domain: Column, error: Column) -> Column:
    """Struct (was_redirected, is_cross_domain, types, targets); null after an error without any hop.

    ``hops``: the targets of HTTP redirects in order; those of the last page's own redirects follow.
    """
    hops = F.coalesce(hops, F.array().cast("array<string>"))
    last = F.when(F.size(hops) > 0, F.element_at(hops, -1)).otherwise(page_url)
    own = client_redirects(final_html, last)
    all_targets = F.concat(hops, F.transform(own, lambda r: r["url"]))
    kinds = F.array_distinct(F.concat(F.transform(hops, lambda h: F.lit("http")), F.transform(own, lambda r: r["type"])))
    crossed = F.exists(all_targets, lambda t: ~U.is_official(t, domain))
    result = F.struct((F.size(all_targets) > 0).alias("was_redirected"), crossed.alias("is_cross_domain"), kinds.alias("types"), all_targets.alias("targets"))
    return F.when(error.isNull() | (F.size(hops) > 0), result)


def official_domain(url: Column, domains: Column) -> Column:
    """The first official domain, else the page's host without www."""
    host = F.regexp_replace(U.host(url), "^www\\.", "")
    return F.coalesce(F.get(domains, F.lit(0)), F.when(host != "", host))
