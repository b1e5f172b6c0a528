"""The rule base compiled to Columns (and, for the check against another engine, to SQL).

Conditions only ever read what is settled before them, so the rules need no fixpoint: names are defined level by
level, each level one projection.  Scores are left folds in rule order, as binary doubles don't add up alike in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import FALLBACK, HELPERS, RULES, THRESHOLDS, Rule

WORD = re.compile(r"[a-z_]\w*")
NOT_NAMES = {"and", "or", "not", "true", "false"}


def names(sql: str) -> set[str]:
    return set(WORD.findall(sql)) - NOT_NAMES


ASSERTED = list(dict.fromkeys(r.asserts for r in RULES if r.asserts))


def definitions() -> dict[str, str]:
    """SQL for every name that isn't an input signal."""
    out = dict(HELPERS)
    out["in_access_denied"] = "true"
    out["denied"] = "http_access_denied_status or dns_sinkhole_detected"
    out["in_official"] = "not denied and trusted_infra"
    fold = " + ".join(["0.0D", *[f"(case when {r.condition} then {g.delta}D else 0.0D end)" for r in RULES if r.phase == "official" for g in r.gains]])
    out["officially_promoted"] = f"in_official and least(1.0D, {fold}) >= {THRESHOLDS['Official']}D"
    out["in_brand_independent"] = "not denied and not officially_promoted"
    out["in_brand_dependent"] = "in_brand_independent and not trusted_infra"
    for a in ASSERTED:
        out[a] = " or ".join(f"(in_{r.phase} and ({r.condition}))" for r in RULES if r.asserts == a)
    return out


DEFINED = definitions()
INPUTS = sorted({n for sql in [*DEFINED.values(), *[r.condition for r in RULES], *[g.guard for r in RULES for g in r.gains]] for n in names(re.sub(r"\b(case|when|then|else|end|least)\b|\d+\.\d+D", " ", sql))} - set(DEFINED))


def levels() -> list[list[str]]:
    """The defined names in an order in which each reads earlier ones and inputs only."""
    done, left, out = set(INPUTS), dict(DEFINED), []
    reads = {k: names(re.sub(r"\b(case|when|then|else|end|least)\b|\d+\.\d+D", " ", v)) for k, v in left.items()}
    while left:
        ready = [k for k in left if reads[k] <= done]
        if not ready:
            raise ValueError(f"rules read one another: {sorted(left)}")
        out.append(ready)
        done |= set(ready)
        for k in ready:
            del left[k]
    return out


def forward_references() -> list[str]:
    """Rules that read, through helpers too, a signal that they themselves or later rules assert."""

    def all_names(sql: str) -> set[str]:
        found = names(sql)
        return found | {n for h in found & set(HELPERS) for n in all_names(HELPERS[h])}

    out = []
    for k, r in enumerate(RULES):
        later = {x.asserts for x in RULES[k:] if x.asserts}
        out += [f"{r.id}: {n}" for n in all_names(r.condition) & later]
    return out


def fired(r: Rule) -> str:
    return f"in_{r.phase} and ({r.condition})"


def _gains() -> list[tuple[int, Rule, object, str]]:
    return [(seq, r, g, f"{fired(r)} and ({g.guard})") for seq, r in enumerate(RULES, 1) for g in r.gains]


def score(df: DataFrame, signals: str = "signal_names", many: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with label, confidence, classified_as, scores, fired_rules and contributions.

    ``signals``: an array of the names of signals that are present.  ``many``: columns adult_strong_many and
    gambling_strong_many, whether there are two strong words or more.
    """
    # SQL text all along: building a plan of Columns costs by the call, and these are thousands
    own = [f"`{c}`" for c in df.columns]
    given = df.withColumns({f"__{n}": F.coalesce(c, F.lit(False)) for n, c in (many or {}).items()})
    wide = given.selectExpr("*", *[f"coalesce(array_contains(`{signals}`, '{n}'), false) AS `__{n}`" for n in INPUTS if n not in (many or {})])
    mine = lambda sql: WORD.sub(lambda m: m[0] if m[0] not in DEFINED and m[0] not in INPUTS else f"`__{m[0]}`", sql)
    for level in levels():
        wide = wide.selectExpr("*", *[f"({mine(DEFINED[k])}) AS `__{k}`" for k in level])
    parts = []
    for seq, r, g, cond in _gains():
        *first, last = g.signal.split("|")
        signal = f"CASE {' '.join(f'WHEN {mine(x)} THEN {chr(39)}{x}{chr(39)}' for x in first)} ELSE '{last}' END" if first else f"'{last}'"
        parts.append(f"CASE WHEN {mine(cond)} THEN named_struct('seq', {seq}, 'label', '{g.label}', 'delta', {float(g.delta)!r}D, 'signal', {signal}, 'rule', '{r.id}') END")
    rules = [f"CASE WHEN {mine(fired(r))} THEN '{r.id}' END" for r in RULES]
    out = wide.selectExpr(*own, f"array_compact(array({', '.join(parts)})) AS contributions", f"array_compact(array({', '.join(rules)})) AS fired_rules")

    def ledger(label: str, threshold: float) -> str:
        """The sum of a label's gains, and which gain brought it over the threshold first (0: none)."""
        added = f"named_struct('sum', a.sum + c.delta, 'at', IF(a.at = 0 AND least(1.0D, a.sum + c.delta) >= {threshold!r}D, c.seq, a.at))"
        return f"aggregate(filter(contributions, c -> c.label = '{label}'), named_struct('sum', 0.0D, 'at', 0), (a, c) -> {added})"

    out = out.selectExpr("*", *[f"{ledger(k, float(t))} AS `__{k}`" for k, t in THRESHOLDS.items()])
    out = out.selectExpr("*", " AND ".join(f"`__{k}`.at = 0" for k in THRESHOLDS) + " AS `__rest`")
    label, gain, _ = FALLBACK
    capped = {k: f"least(1.0D, `__{k}`.sum)" for k in THRESHOLDS}
    capped[label] = f"IF(`__rest`, {float(gain)!r}D, {capped[label]})"
    promoted = ", ".join(f"IF(`__{k}`.at > 0, named_struct('at', `__{k}`.at, 'order', {i}, 'label', '{k}', 'score', {capped[k]}), NULL)" for i, k in enumerate(THRESHOLDS))
    rest = f"array(named_struct('at', 0, 'order', 0, 'label', '{label}', 'score', {float(gain)!r}D))"
    out = out.selectExpr("*", f"IF(`__rest`, {rest}, array_sort(array_compact(array({promoted})))) AS `__promoted`")
    out = out.selectExpr("*", "array_max(transform(`__promoted`, p -> named_struct('score', p.score, 'a', -p.at, 'o', -p.order, 'label', p.label))) AS `__best`")
    return out.selectExpr(
        *own,
        "`__best`.label AS label",
        "CASE WHEN `__best`.score >= 0.7D THEN 'high' WHEN `__best`.score >= 0.45D THEN 'medium' ELSE 'low' END AS confidence",
        "transform(`__promoted`, p -> p.label) AS classified_as",
        f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {capped[k]}' for k in THRESHOLDS)}) AS scores",
        "fired_rules",
        "contributions",
    )


def sql(source: str, key: str) -> str:
    """DuckDB SQL for label, confidence, classified_as, fired_rules and the scores of a table with a boolean column a signal."""
    number = re.compile(r"(\d+\.\d+)D")
    cast = lambda s: number.sub(r"\1::DOUBLE", s)
    steps, last = [], source
    for i, level in enumerate(levels()):
        steps.append(f"l{i} AS (SELECT *, {', '.join(f'({cast(DEFINED[k])}) AS {k}' for k in level)} FROM {last})")
        last = f"l{i}"
    rows = ", ".join(f"CASE WHEN {cond} THEN {{'seq': {seq}, 'label': '{g.label}', 'delta': {g.delta}::DOUBLE}} END" for seq, _, g, cond in _gains())
    rules = ", ".join(f"CASE WHEN {fired(r)} THEN '{r.id}' END" for r in RULES)
    sums, ats = [], []
    for k, t in THRESHOLDS.items():
        fold = "list_reduce(list_prepend(0.0::DOUBLE, {}), lambda a, x: a + x)"
        mine = f"list_filter(contributions, lambda c: c.label = '{k}')"
        deltas = f"list_transform({mine}, lambda c: c.delta)"
        sums.append(f"least(1.0, {fold.format(deltas)}) AS s_{k}")
        ats.append(f"coalesce(list_min(list_transform(list_filter(range(1, len({mine}) + 1), lambda i: least(1.0, {fold.format(f'{deltas}[1:i]')}) >= {t}), lambda i: {mine}[i].seq)), 0) AS a_{k}")
    items = ", ".join(f"CASE WHEN a_{k} > 0 THEN {{'at': a_{k}, 'o': {i}, 'label': '{k}', 'score': s_{k}}} END" for i, k in enumerate(THRESHOLDS))
    scores = ", ".join(f"CASE WHEN '{k}' = 'Other_Site' AND len(p) = 0 THEN 1.0 ELSE s_{k} END::DOUBLE AS score_{k.lower()}" for k in THRESHOLDS)
    return f"""
WITH {", ".join(steps)},
c AS (SELECT {key}, list_filter([{rows}], lambda x: x IS NOT NULL) AS contributions, list_filter([{rules}], lambda x: x IS NOT NULL) AS fired FROM {last}),
s AS (SELECT {key}, fired, {", ".join(sums)}, {", ".join(ats)} FROM c),
q AS (SELECT *, list_sort(list_filter([{items}], lambda x: x IS NOT NULL)) AS p FROM s),
b AS (SELECT *, list_max(list_transform(p, lambda x: {{'score': x.score, 'a': -x.at, 'o': -x.o, 'label': x.label}})) AS best FROM q)
SELECT {key}, coalesce(best.label, 'Other_Site') AS label,
  CASE WHEN best IS NULL OR best.score >= 0.7 THEN 'high' WHEN best.score >= 0.45 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN len(p) = 0 THEN 'Other_Site' ELSE array_to_string(list_transform(p, lambda x: x.label), ',') END AS classified_as,
  array_to_string(fired, ',') AS fired_rules, {scores}
FROM b"""


def contributions_sql(source: str, key: str) -> str:
    """DuckDB SQL for which rule added how much to which label because of which signal, in order."""
    number = re.compile(r"(\d+\.\d+)D")
    cast = lambda s: number.sub(r"\1::DOUBLE", s)
    steps, last = [], source
    for i, level in enumerate(levels()):
        steps.append(f"l{i} AS (SELECT *, {', '.join(f'({cast(DEFINED[k])}) AS {k}' for k in level)} FROM {last})")
        last = f"l{i}"

    def signal(g) -> str:
        *first, final = g.signal.split("|")
        return f"CASE {' '.join(f'WHEN {x} THEN {chr(39)}{x}{chr(39)}' for x in first)} ELSE '{final}' END" if first else f"'{final}'"

    rows = ", ".join(f"CASE WHEN {cond} THEN '{g.label}+{round(float(g.delta) * 100)} ' || {signal(g)} || ' {r.id}' END" for _, r, g, cond in _gains())
    return f"WITH {', '.join(steps)} SELECT {key}, array_to_string(list_filter([{rows}], lambda x: x IS NOT NULL), '; ') AS contributions FROM {last}"
