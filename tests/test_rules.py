import random
import re

from pyspark.sql import functions as F

from wardlight.plans import scoring
from wardlight.plans.rules import FALLBACK, HELPERS, RULES, THRESHOLDS


def test_table_is_sound():
    assert len(RULES) == 74
    assert len({r.id for r in RULES}) == 74
    assert scoring.forward_references() == []
    assert {g.label for r in RULES for g in r.gains} <= set(THRESHOLDS)
    assert sorted({r.phase: k for k, r in enumerate(RULES)}.values()) == [1, 6, 23, 73]


def interpret(present: set[str]) -> tuple:
    """The rules run one by one to a fixpoint, as an engine with working memory does."""
    memory, fired, sums, promoted = set(present), [], dict.fromkeys(THRESHOLDS, 0.0), []

    def holds(sql: str) -> bool:
        def value(m):
            w = m[0]
            return w if w in ("and", "or", "not", "true", "false") else str(holds(HELPERS[w]) if w in HELPERS else w in memory)

        return bool(eval(re.sub(r"[a-z_]\w*", value, sql).replace("true", "True").replace("false", "False")))

    def look():
        promoted.extend(k for k, t in THRESHOLDS.items() if k not in promoted and min(1.0, sums[k]) >= t)

    def run(phase):
        again = True
        while again:
            again = False
            for r in RULES:
                if r.phase == phase and r.id not in fired and holds(r.condition):
                    fired.append(r.id)
                    again = True
                    if r.asserts:
                        memory.add(r.asserts)
                    for g in r.gains:
                        if holds(g.guard):
                            sums[g.label] += g.delta
                    look()

    run("access_denied")
    stop = "Access_Denied" in promoted
    if not stop and "trusted_infra" in memory:
        run("official")
        stop = "Official" in promoted
    if not stop:
        run("brand_independent")
        if "trusted_infra" not in memory:
            run("brand_dependent")
    if not stop and not promoted:
        sums[FALLBACK[0]] += FALLBACK[1]
        look()
    best = promoted[0]
    for k in promoted:
        if min(1.0, sums[k]) > min(1.0, sums[best]):
            best = k
    score = min(1.0, sums[best])
    return best, "high" if score >= 0.7 else "medium" if score >= 0.45 else "low", promoted, sorted(fired), {k: min(1.0, v) for k, v in sums.items()}


def test_columns_agree_with_the_interpreter(spark):
    rng = random.Random(5)
    cases = [[], ["brand_name_present", "semantic_account_verification_language_detected"], ["trusted_infra", "brand_tls_org_match", "has_enterprise_tls"]]
    cases += [rng.sample(scoring.INPUTS, rng.randint(0, 30)) for _ in range(150)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "job int, signal_names array<string>")
    many = {n: F.array_contains("signal_names", n) for n in ("adult_strong_many", "gambling_strong_many")}
    for r in scoring.score(df, many=many).collect():
        label, confidence, promoted, fired, scores = interpret(set(cases[r.job]))
        assert (r.label, r.confidence, r.classified_as, sorted(r.fired_rules)) == (label, confidence, promoted, fired)
        assert r.scores.asDict() == scores
