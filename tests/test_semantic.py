"""Chunks matched with phrases, against a plain loop."""

import math

import pytest

from wardlight.operators import semantic as S

CHUNKS = "job_id string, chunk_ord int, zone string, text string, vector array<float>"
PHRASES = "category string, cat_ord int, phrase_ord int, phrase string, vector array<double>"


def plain(chunks, phrases, threshold):
    best = {}
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    for job, ord_, zone, text, v in chunks:
        for cat, cat_ord, p_ord, phrase, w in phrases:
            if not (sound(v) and sound(w) and v and len(v) == len(w)):
                continue
            size = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))
            score = math.floor((sum(x * y for x, y in zip(v, w, strict=True)) / size if size else 0.0) * 1e4 + 0.5) / 1e4
            if score >= threshold:
                key, found = (job, cat, cat_ord), (score, -ord_, -p_ord, phrase, text, zone)
                best[key] = max(best.get(key, found), found)
    return sorted((job or "", cat, cat_ord, b[0], b[3], b[4], b[5]) for (job, cat, cat_ord), b in best.items())


def rows():
    chunks = [(f"j{i % 5}", i // 5, "z", f"t{i}", [float((i * k * 7 + 3 * k + i) % 11 - 5) for k in range(1, 5)]) for i in range(60)]
    chunks += [("j0", 90, "z", "null", None), ("j0", 91, "z", "empty", []), ("j0", 92, "z", "zero", [0.0] * 4), ("j0", 93, "z", "short", [1.0, 2.0]), ("j0", 94, "z", "hole", [1.0, None, 1.0, 1.0]), ("j0", 95, "z", "nan", [1.0, float("nan"), 1.0, 1.0]), (None, 0, None, None, [1.0, 2.0, 3.0, 4.0])]
    phrases = [(f"c{i % 3}", i % 3, i // 3, f"p{i}", [float((i * k * 5 + k) % 7 - 3) for k in range(1, 5)]) for i in range(30)]
    phrases += [("c0", 0, 50, "null", None), ("c0", 0, 51, "hole", [None, 1.0, 1.0, 1.0]), ("c1", 1, 52, "short", [1.0, 2.0]), ("c2", 2, 53, "zero", [0.0] * 4)]
    return chunks + chunks[:7], phrases + phrases[:4]


@pytest.mark.parametrize(("block", "at_once"), [(4096, 2_000_000), (8, 60)])
def test_match(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(S, "PHRASE_BLOCK", block)
    monkeypatch.setattr(S, "SCORES_AT_ONCE", at_once)
    chunks, phrases = rows()
    found = S.match(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(phrases, PHRASES), 0.3)
    got = sorted((r.job_id or "", r.category, r.cat_ord, r.score, r.phrase, r.chunk, r.zone) for r in found.collect())
    assert got == plain(chunks, phrases, 0.3)


def test_match_of_nothing(spark):
    chunks, phrases = rows()
    assert S.match(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame([], PHRASES)).count() == 0
    assert S.match(spark.createDataFrame([], CHUNKS), spark.createDataFrame(phrases, PHRASES)).count() == 0
