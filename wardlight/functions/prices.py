"""Prices written the American or the European way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CURRENCIES
from .text import strip_tags

NUMBER = r"\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?"


def parse_price(text: Column) -> Column:
    """A price as double; null without digits, or if negative.

    With both separators the last is the decimal one; a lone one is if one or two digits follow it.
    """
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d.,\-]", "")
    comma, dot = F.length(s) - F.locate(",", F.reverse(s)), F.length(s) - F.locate(".", F.reverse(s))
    has_comma, has_dot = s.contains(","), s.contains(".")
    point = F.regexp_replace(s, "^([^,]*),", "$1.")  # the first comma only
    plain = F.regexp_replace(s, ",", "")
    cleaned = (
        F.when(has_comma & has_dot, F.when(comma > dot, F.regexp_replace(F.regexp_replace(s, r"\.", ""), "^([^,]*),", "$1.")).otherwise(plain))
        .when(has_comma, F.when(s.rlike(r",\d{1,2}$"), point).otherwise(plain))
        .when(has_dot, F.when(s.rlike(r"\.\d{1,2}$"), s).otherwise(F.regexp_replace(s, r"\.", "")))
        .otherwise(s)
    )
    number = F.expr("null").cast("double")
    prefix = F.regexp_extract(cleaned, r"^(-?(?:\d+\.?\d*|\.\d+))", 1)
    value = F.when(prefix != "", prefix.try_cast("double")).otherwise(number)
    return F.when(s.rlike(r"\d") & (value >= 0), value)


def has_prices(html: Column) -> Column:
    """A currency before or behind a number in the text between tags."""
    text = strip_tags(html)
    return text.rlike(f"(?i)(?:{CURRENCIES})\\s*{NUMBER}") | text.rlike(f"(?i){NUMBER}\\s*(?:{CURRENCIES})")


def extreme_share(pairs: Column, discount: float = 0.7) -> Column:
    """Of the pairs (original, sale) whose prices are both above zero, the share with at least this discount; null without any."""
    valid = F.filter(F.transform(pairs, lambda p: F.struct(parse_price(p["original"]).alias("o"), parse_price(p["sale"]).alias("s"))), lambda p: (p["o"] > 0) & (p["s"] > 0))
    extreme = F.filter(valid, lambda p: (p["o"] - p["s"]) / p["o"] >= discount)
    return F.when(F.size(valid) > 0, F.size(extreme) / F.size(valid))


def unrealistic_discount(pairs: Column, discount: float = 0.7, density: float = 0.5) -> Column:
    return F.coalesce(extreme_share(pairs, discount) >= density, F.lit(False))
