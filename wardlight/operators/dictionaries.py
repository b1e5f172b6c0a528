"""Tiered dictionaries: phrases of a later tier are sought in what the earlier ones leave.

A text is split into words once, and these are intersected with the words of all phrases, which decides most texts.  A
phrase's pattern is only tried on texts that have all its words, and have them in a row.  The phrases are one constant
array, whatever their number.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import bind, phrase_pattern

PHRASE = "array<struct<nth: int, phrase: string, words: array<string>, row: string, pattern: string>>"


def distinct_phrases(phrases: list[str]) -> list[str]:
    return list({p.lower(): p for p in reversed(phrases)}.values())[::-1]


def words_in(phrase: str) -> list[str]:
    """The words of a phrase, lower-cased, that a text must have; none for RTP, which digits may follow at once."""
    return [] if phrase.strip().upper() == "RTP" else [w for w in re.split("[^a-z0-9_]+", phrase.lower()) if w]


def listed(phrases: list[str], text: Column, present: Column) -> Column:
    """Those distinct phrases whose first word is present: a constant map of first words gives them.

    A phrase without words of its own is there if the text contains it in any way.
    """
    by_word: dict[str, list[dict]] = {}
    for nth, p in enumerate(distinct_phrases(phrases)):
        words = words_in(p)
        by_word.setdefault(words[0] if words else "", []).append({"nth": nth, "phrase": p, "words": words, "row": f" {' '.join(words)} " if words else " ", "pattern": phrase_pattern(p)})
    known, none = F.from_json(F.lit(json.dumps(by_word)), f"map<string, {PHRASE}>"), F.array().cast(PHRASE)
    found = F.flatten(F.transform(present, lambda w: F.coalesce(F.try_element_at(known, w), none)))
    for p in by_word.get("", []):
        own = F.filter(F.try_element_at(known, F.lit("")), lambda x: x["phrase"] == p["phrase"])  # noqa: B023
        found = F.concat(found, F.when(F.lower(text).contains(p["phrase"].strip().lower()), own).otherwise(none))
    return found


def prepared(text: Column, phrases: list[str]) -> Column:
    """Struct (text, present, row) of a text: those words of the phrases that it has, and all its words in a row."""
    known = F.split(F.lit(" ".join(sorted({w for p in phrases for w in words_in(p)}))), " ")
    words = F.split(F.lower(text), "[^a-z0-9_]+")
    return bind(words, lambda w: F.struct(text.alias("text"), F.array_intersect(w, known).alias("present"), in_a_row(w).alias("row")))


def in_a_row(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def hits(state: Column, phrases: list[str]) -> Column:
    """The phrases found in a prepared text, in the list's order; those whose words don't follow one another aren't tried."""
    found = F.filter(listed(phrases, state["text"], state["present"]), lambda p: F.contains(state["row"], p["row"]) & F.regexp_like(state["text"], p["pattern"]))
    return F.sort_array(found)


def masked(state: Column, found: Column) -> Column:
    """The prepared text with the found phrases blanked, one after the other; its words are put in a row again."""
    blanked = F.aggregate(found, state["text"], lambda t, p: F.regexp_replace(t, p["pattern"], F.lit(" ")))
    anew = bind(blanked, lambda t: F.struct(t.alias("text"), state["present"].alias("present"), in_a_row(F.split(F.lower(t), "[^a-z0-9_]+")).alias("row")))  # blanking makes no new words
    return F.when(F.size(found) > 0, anew).otherwise(state)


def without(state: Column, vetoes: list[str]) -> Column:
    """The prepared text without the vetoes; one of them can come about by blanking another, so words alone decide."""
    return masked(state, F.sort_array(F.filter(listed(vetoes, state["text"], state["present"]), lambda p: F.size(F.array_except(p["words"], state["present"])) == 0)))


def names(found: Column) -> Column:
    return F.transform(found, lambda p: p["phrase"])


def tiers(df: DataFrame, text: str, definitive: list[str], strong: list[str], weak: list[str], vetoes: list[str], prefix: str) -> DataFrame:
    """``df`` with <prefix>_definitive, _strong and _weak (arrays of phrases).  Null and blank texts have none."""
    given = prepared(F.coalesce(F.col(text), F.lit("")), [*definitive, *strong, *weak, *vetoes])

    def first(state: Column) -> Column:
        return F.struct(state.alias("state"), hits(state, definitive).alias("definitive"))

    def second(x: Column) -> Column:
        return bind(masked(x["state"], x["definitive"]), lambda state: F.struct(state.alias("state"), x["definitive"].alias("definitive"), hits(state, strong).alias("strong")))

    def third(x: Column) -> Column:
        return bind(masked(x["state"], x["strong"]), lambda state: F.struct(names(x["definitive"]).alias("definitive"), names(x["strong"]).alias("strong"), names(hits(state, weak)).alias("weak")))

    cleared = bind(given, lambda state: without(state, vetoes))
    out = df.withColumn(f"__{prefix}", bind(bind(bind(cleared, first), second), third))
    return out.withColumns({f"{prefix}_{t}": F.col(f"__{prefix}.{t}") for t in ("definitive", "strong", "weak")}).drop(f"__{prefix}")


def gambling(df: DataFrame, text: str, prefix: str = "gambling") -> DataFrame:
    return tiers(df, text, fixed.GAMBLING_DEFINITIVE, fixed.GAMBLING_STRONG, fixed.GAMBLING_WEAK, fixed.GAMBLING_VETOES, prefix)


def adult(df: DataFrame, text: str, prefix: str = "adult") -> DataFrame:
    return tiers(df, text, fixed.ADULT_DEFINITIVE, fixed.ADULT_STRONG, fixed.ADULT_WEAK, fixed.ADULT_VETOES, prefix)


def age_gate(text: Column) -> Column:
    return bind(prepared(F.coalesce(text, F.lit("")), fixed.ADULT_AGE_GATE), lambda state: names(hits(state, fixed.ADULT_AGE_GATE)))


def parking_clue(text: Column) -> Column:
    """"domain name", else "domain", else null."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(low.rlike(phrase_pattern("domain name")), "domain name").when(low.rlike(phrase_pattern("domain")), "domain")
