"""Each stage of the corpus pipeline, and all of them, against brute force on a small table with nulls, ties and repeats."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from wardlight.llm import langid, simhash

RNG = random.Random(4)
SAID = {
    "en": "the house of the king and that which was there for all of them to see in his own time".split(),
    "de": "das haus der und die nicht mit eine straße für alle sehen in dem auch wir haben ein kind".split(),
}


def text(lang, n):
    return " ".join(RNG.choices(SAID[lang], k=n))


PASSAGE = text("en", 60)
LEAK = " ".join(f"{w}{i}" for i, w in enumerate(SAID["en"]))
ROWS = [(i, text(RNG.choice(list(SAID)), RNG.randint(20, 60))) for i in range(40)]
COPY = ROWS[3][1]
ROWS += [(50, COPY), (51, COPY), (51, COPY), (None, COPY), (None, "das kind und das haus nicht mit der straße " * 3), (None, None), (60, None), (61, ""), (62, "123 456 !!!")]
ROWS += [(70, PASSAGE + " " + text("en", 30)), (71, text("en", 30) + " a�ü " + PASSAGE), (72, text("en", 12) + " " + LEAK + " " + text("en", 12)), (73, "über � die straße " + text("de", 40))]


def words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def near_brute(rows):
    """One row of each component: the least id, nulls last; rows as (id, text)."""
    bits = [simhash.text_fingerprint(t) for _, t in rows]
    left, kept = set(range(len(rows))), []
    while left:
        group, todo = set(), {next(iter(left))}
        while todo:
            group |= todo
            todo = {j for i in todo for j in left if (bits[i] ^ bits[j]).bit_count() <= 4} - group
        left -= group
        kept.append(min((rows[i][0] is None, rows[i][0] or 0) for i in group))
    return sorted(kept)


def repeats_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw, gone = t.encode(), set()
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone |= set(range(s, s + 100))
            seen.add(raw[s : s + 100])
        kept, at = [], 0
        for c in t:
            size = len(c.encode())
            kept += [c] * gone.isdisjoint(range(at, at + size))
            at += size
        if not gone or len(gone) < len(raw):
            out[i] = "".join(kept)
    return out


def leaks(t, items):
    w = words(t)
    wins = {tuple(x[k : k + 10]) for x in map(words, items) for k in range(max(1, len(x) - 9) if x else 0)}
    return any(tuple(w[k : k + len(x)]) == x for x in wins for k in range(len(w) - len(x) + 1))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "de" if t and "das" in t else "en", "s", len(t or ""), "clash", 1) for i, t in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, row int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.default_path())
    docs, stages = pipeline.table(spark, sf_dir, "documents"), dict(pipeline.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    docs = pipeline.store(stages["language ID"](spark, docs, sf_dir))
    assert docs.columns == list(pipeline.COLUMNS)
    assert sorted(rows(docs), key=repr) == sorted([r for r in ROWS if r[1] and any(c.isalpha() for c in r[1])], key=repr)
    before = rows(docs)
    docs = pipeline.store(stages["SimHash near-dedup"](spark, docs, sf_dir))
    assert sorted((i is None, i or 0) for i, _ in rows(docs)) == near_brute(before) and set(rows(docs)) <= set(before)
    before = rows(docs)
    assert [i for i, _ in before].count(None) == 1  # the one that resembles nothing else
    docs = pipeline.store(stages["suffix-array dedup"](spark, docs, sf_dir))
    want = repeats_brute([(10**9 if i is None else i, t) for i, t in before])
    got = {10**9 if i is None else i: t for i, t in rows(docs)}
    assert got == want and "�" in got[71] and PASSAGE not in got[71]
    before = rows(docs)
    docs = pipeline.store(stages["benchmark decontamination"](spark, docs, sf_dir))
    assert sorted(rows(docs), key=repr) == sorted([r for r in before if not leaks(r[1], [LEAK])], key=repr)
    before = dict(rows(docs))
    last = stages["SentencePiece encoding and decoding"](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in last} == set(before)
    for r in last:
        ids = [1, *model.encode(before[r.doc_id]), 2]
        assert (r.n_tokens, r.text) == (len(ids), model.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    whole = pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(map(tuple, last), key=repr)


def test_stages_of_an_empty_table(spark, sf_dir):
    empty = pipeline.table(spark, sf_dir, "documents").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
