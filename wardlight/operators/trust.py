"""Trust scoring of hosts from TLS, registration, DNS and hosting records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

RESULT = "struct<score: int, status: string, reason: string, flags: array<string>>"


def _result(score, status: str, reason, flags) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(score).cast("int").alias("score"), as_col(status).alias("status"), as_col(reason).alias("reason"), flags.alias("flags")).cast(RESULT)


def trust_score(tls: Column, whois: Column, dns: Column, geo: Column) -> Column:
    """Five reasons to reject, in order; else 100 with deductions and additions, clamped once at the end."""
    no = lambda c: F.coalesce(c, F.lit(False))
    age, level = whois["age_in_days"], tls["issuer_level"]
    reject = lambda flag, reason: _result(0, "REJECTED", reason, F.array(F.lit(flag)))
    # condition, change, flag; in the order of flags
    terms = [
        (level == "DV", -30, "tls_cert_dv"),
        (whois.isNull(), -10, "whois_unavailable"),
        (dns.isNull(), -15, "dns_unavailable"),
        (dns.isNotNull() & ~no(dns["has_mx"]), -20, "no_mx_records"),
        (geo.isNull(), -5, "geo_unavailable"),
        (no(geo["is_bulletproof"]), -25, "bulletproof_hosting"),
        (level == "OV", 20, "tls_cert_ov"),
        (level == "EV", 20, "tls_cert_ev"),
        (age > 1825, 10, "established_domain"),
    ]
    total = F.lit(100)
    for cond, change, _ in terms:
        total = total + F.when(no(cond), change).otherwise(0)
    total = F.greatest(F.lit(0), F.least(F.lit(100), total))
    flags = F.array_compact(F.array(*[F.when(no(c), F.lit(f)) for c, _, f in terms]))
    return (
        F.when(tls.isNull() | ~no(tls["uses_https"]), reject("no_https", "URL does not use HTTPS"))
        .when(no(tls["is_expired"]), reject("cert_expired", F.concat(F.lit("TLS certificate expired on "), F.coalesce(tls["valid_to"], F.lit("null")))))
        .when(~no(tls["authorized"]), reject("tls_invalid_cert", F.concat(F.lit("TLS certificate is invalid: "), F.coalesce(tls["error"], F.lit("unknown error")))))
        .when(no(tls["hostname_mismatch"]), reject("hostname_mismatch", "TLS cert subject does not match hostname"))
        .when(no(age < 14), reject("domain_too_young", F.concat(F.lit("Domain is only "), age, F.lit(" day(s) old"))))
        .when(total >= 60, _result(total, "TRUSTED_INFRA", "Passed structural trust scoring", flags))
        .otherwise(_result(total, "FLAGGED_SUSPICIOUS", "Trust score below threshold", flags))
    )


def evaluate(url: Column, official_domains: Column, tls: Column, whois: Column, dns: Column, geo: Column) -> Column:
    """An official domain, or a host below one, is official at once; else the trust score."""
    listed = F.exists(F.coalesce(official_domains, F.array().cast("array<string>")), lambda d: U.is_official(url, d))
    official = _result(100, "OFFICIAL_SITE", "Host is an official domain or below one", F.array(F.lit("whitelist_match")))
    return F.when(listed, official).otherwise(trust_score(tls, whois, dns, geo))


def certificate(peer: Column, host: Column, now: Column) -> Column:
    """TLS facts of a probed certificate: struct (uses_https, authorized, error, subject struct, issuer_org, san, valid_to).

    Alternative names decide if there are any, with a wildcard for any depth below it; else the common name.
    """
    s = peer["subject"]
    level = F.when(s["business_category"].isNotNull() | s["jurisdiction"].isNotNull(), "EV").when(s["organization"].isNotNull(), "OV").otherwise("DV")

    def fits(name: Column) -> Column:
        low = F.lower(name)
        return (low == host) | (low.startswith("*.") & F.endswith(host, F.substring(low, F.lit(2), F.length(low))))

    matches = F.when(F.size(peer["san"]) > 0, F.exists(peer["san"], fits)).otherwise(F.coalesce(fits(s["common_name"]), F.lit(False)))
    return F.struct(
        peer["uses_https"].alias("uses_https"),
        peer["authorized"].alias("authorized"),
        peer["error"].alias("error"),
        s["common_name"].alias("subject_cn"),
        s["organization"].alias("subject_org"),
        peer["issuer_org"].alias("issuer_org"),
        level.alias("issuer_level"),
        peer["valid_to"].alias("valid_to"),
        (F.try_to_timestamp(peer["valid_to"]) < now).alias("is_expired"),
        (~matches).alias("hostname_mismatch"),
    )


def registration(rdap: Column, now: Column) -> Column:
    """Registration facts of an RDAP answer: struct (events [action, date], registrar, registrant_org, status)."""
    event = lambda kind: F.get(F.transform(F.filter(rdap["events"], lambda e: e["action"] == kind), lambda e: e["date"]), F.lit(0))
    created = event("registration")
    age = F.floor((F.unix_millis(now) - F.unix_millis(F.try_to_timestamp(created))) / 86_400_000).cast("int")
    return F.struct(created.alias("created_date"), event("expiration").alias("expires_date"), rdap["registrar"].alias("registrar"), rdap["registrant_org"].alias("registrant_org"), rdap["status"].alias("domain_status"), age.alias("age_in_days"))


BULLETPROOF_WORDS = ("bulletproof", "offshore", "anonymous-host", "sh3lls")


def is_bulletproof(isp: Column) -> Column:
    from .detectors import contains_any

    return F.coalesce(contains_any(F.lower(isp), list(BULLETPROOF_WORDS)), F.lit(False))


def gather(jobs: DataFrame, url: str = "url", **intel: DataFrame) -> DataFrame:
    """``jobs`` with structs tls, whois, dns and geo, null where the table has no row for the url's host.

    Each table is keyed by host; of several rows of a host the least is taken.  The host is what rows are shuffled by
    once; urls without one, however many, meet nobody.
    """
    every = jobs.withColumn("host", F.nullif(F.coalesce(U.host(F.col(url)), F.lit("")), F.lit("")))
    out, bare = every.where("host is not null"), every.where("host is null")
    for name in ("tls", "whois", "dns", "geo"):
        t = intel.get(name)
        if t is None:
            raise ValueError(f"the table {name} is missing")
        row = t.select("host", F.struct(*[F.col(c) for c in t.columns if c != "host"]).alias(name)).groupBy("host").agg(F.min(name).alias(name))
        out = out.join(row, "host", "left")
        bare = bare.withColumn(name, F.lit(None).cast(row.schema[name].dataType))
    return out.unionByName(bare).withColumn("host", F.coalesce("host", F.lit("")))
