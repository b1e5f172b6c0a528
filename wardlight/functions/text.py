"""Text predicates as Column expressions.

Word boundaries are ASCII ones and white space is Unicode's, whatever the regex engine's defaults are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for use inside a character class.
BLANKS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
NOT_AFTER_WORD, NOT_BEFORE_WORD = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def collapse(text: Column) -> Column:
    """White space runs become one blank; none at the ends.  Null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " "))


def escape(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", text)


def phrase_pattern(phrase: str) -> str:
    """A phrase as a case-insensitive pattern: bounded by non-words, any white space between its words."""
    phrase = phrase.strip()
    if phrase.upper() == "RTP":
        return f"(?i){_begins('RTP')}(?:[{BLANKS}]*%(?=[A-Za-z0-9_])|[{BLANKS}]*\\d{NOT_BEFORE_WORD}|{NOT_BEFORE_WORD})"
    body = f"[{BLANKS}]+".join(escape(p) for p in phrase.split())
    return f"(?i){_begins(body)}{'' if phrase.endswith('+') else NOT_BEFORE_WORD}"


def _begins(body: str) -> str:
    """The pattern, not after a word; its first character is looked at before what is before it, as that seldom fits."""
    return f"{body[0]}(?<![A-Za-z0-9_]{body[0]}){body[1:]}" if body[:1].isalnum() else NOT_AFTER_WORD + body


def contains_brand(text: Column, brand: Column | str) -> Column:
    """The brand as a token: not next to a letter, digit, underscore or dot."""
    if isinstance(brand, str):
        own = brand.strip()
        return F.coalesce(text.rlike(f"(?i)(?<![A-Za-z0-9_.]){escape(own)}(?![A-Za-z0-9_.])"), F.lit(False)) if own else F.lit(False)
    own = F.trim(brand)
    quoted = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_.])\Q"), own, F.lit(r"\E(?![A-Za-z0-9_.])"))
    return F.coalesce((F.length(own) > 0) & F.regexp_like(text, quoted), F.lit(False))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>?", " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is read: also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_wins(items: Column, key=None) -> Column:
    """Distinct items, the first of equal keys (lower-cased by default), in order."""
    key = key or (lambda x: F.lower(x))

    def distinct(pairs: Column) -> Column:
        keys = pairs["keys"]
        return F.filter(pairs["items"], lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)

    return bind(items, lambda own: bind(F.struct(own.alias("items"), F.transform(own, lambda x: key(x)).alias("keys")), distinct))
