"""Each operator against brute force on small tables with nulls, empty and odd texts, ties, repeats and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardlight.llm import chat, decontaminate, langid, licences, pieces, quality, repeats, simhash, sketch, urlfilter

RNG = random.Random(11)
WORDS = ["the", "of", "Alpha", "beta", "gamma", "delta", "é", "x1", "Under", "MIT", "license"]


def line(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = line(60)
TEXTS = [None, "", "   ", "\n\t", "one", "Under the MIT License", "under the mit license " * 3, "CC-BY-NC; Apache License, version 2", BASE, BASE, BASE + " tail", "head " + BASE, "漢字 かな 😀", "aé�ü" * 40 + "漢字" * 30, "é" + "漢字" * 40 + "� end", "a" * 400, "ab" * 300, line(300)]
TEXTS += ["Copyright 2020 x\n" + licences.MIT, licences.APACHE[40:] + licences.BSD_2, licences.GPL.replace("free", "FREE") + " all rights " + licences.LGPL[:150], "license version 2 apache license version 2 0 the mit license"]
TEXTS += [line(RNG.randint(1, 80)) for _ in range(30)] + [BASE.replace("beta", "BETA", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "clash", 0.5) for i, t in enumerate(TEXTS)]
    rows += [rows[8], (None, "alone without id", "en", "s", 1, "c", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, row string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_simhash(docs, empty):
    def brute(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = simhash.components(docs).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()
    texts = dict(enumerate(TEXTS)) | {None: "alone without id"}
    bits = {i: brute(t) for i, t in texts.items()}
    reach = {i: {j for j in bits if (bits[i] ^ bits[j]).bit_count() <= 4} for i in bits}
    for r in rows:
        seen, todo = set(), {r.doc_id}
        while todo:
            seen |= todo
            todo = set().union(*(reach[i] for i in todo)) - seen
        ids = [i for i in seen if i is not None]
        assert int(r.f, 16) == bits[r.doc_id]
        assert r.component_id == (min(ids) if ids else None)
    assert len(rows) == len(TEXTS) + 2
    assert simhash.components(empty).count() == 0
    kept = [r.doc_id for r in simhash.representatives(docs).collect()]
    assert len(kept) == len(set(kept)) and 8 in kept and 9 not in kept and None in kept


def test_representatives_are_chosen_by_row(spark):
    word = lambda k, n=30: " ".join(f"{k}x{i}" for i in range(n))
    rows = [(None, word("a")), (None, word("b")), (None, word("c")), (None, word("c"))]  # no id, three texts
    rows += [(7, word("d")), (None, word("d"))]  # a row without id is a copy of one with an id
    rows += [(8, word("e")), (8, word("f")), (3, word("f")), (8, word("e"))]  # an id with two texts, one a copy of another id's
    rows += [(9, word("g")), (9, word("h")), (0, word("i")), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, bits string").repartition(5)
    kept = [(r.doc_id, r.text or "") for r in simhash.representatives(df).collect()]
    want = [(None, word("a")), (None, word("b")), (None, word("c")), (7, word("d")), (8, word("e")), (3, word("f")), (9, word("g")), (9, word("h")), (0, word("i")), (None, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)
    bits = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            x = np.uint64(b & (2**64 - 1))
            for k in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= np.uint64(1) << np.uint64(k)
            bits.add(int(x.astype(np.int64)))
    bits = sorted(bits)
    want = {(a, b) for i, a in enumerate(bits) for b in bits[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(b,) for b in bits], "bits long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_repeats(docs, empty, monkeypatch):
    order = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    seen, want = set(), {}
    for i, raw in sorted(order.items()):
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        want[i] = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
    for runs in (4000, 2):
        monkeypatch.setattr(repeats, "SHARD_RUNS", runs)
        rows = repeats.remove_repeats(docs, others=True).collect()
        assert len(rows) == len(TEXTS) + 2
        assert all(bytes(r.kept) == want[r.doc_id] for r in rows if r.doc_id is not None)
        assert all(r.kept_text == bytes(r.kept).decode() for r in rows if not r.n_removed)
        for r in rows:
            if r.n_removed and r.doc_id is not None:
                raw, gone = order[r.doc_id], {k for s in r.spans for k in range(s.start, s.end)}
                at, chars = 0, []
                for c in raw.decode():
                    size = len(c.encode())
                    chars += [c] * gone.isdisjoint(range(at, at + size))
                    at += size
                assert r.kept_text == "".join(chars)
        assert all(r.n_removed == sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept) for r in rows)
        assert {r.others.row for r in rows} == {"clash", "c"}
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_rows_without_id(spark):
    word = " ".join(f"w{i}" for i in range(60))
    rows = [(None, word + " one"), (None, word + " two"), (None, word + " one"), (2**63 - 1, word + " three"), (5, word[:120])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = repeats.remove_repeats(df).collect()
    assert sorted(r.n_removed > 0 for r in found if r.doc_id is None) in ([False, False, True], [True, True, True])
    gone = {bytes(r.kept).decode() for r in found if r.doc_id is None and r.n_removed}
    assert len(gone) <= 2 and next(r for r in found if r.doc_id == 5).n_removed == 0


def test_suffix_array():
    for raw in (b"banana", b"a" * 50, bytes(RNG.choice(b"ab\0") for _ in range(300)), b"\0\0\0", b"x"):
        a = np.frombuffer(raw, np.uint8)
        order, rank = repeats.suffix_array(a)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert order.tolist() == want and rank[order].tolist() == list(range(len(raw)))
        shared = [0] + [next((k for k in range(100) if max(i, j) + k >= len(raw) or raw[i + k] != raw[j + k]), 100) for i, j in zip(want, want[1:], strict=False)]
        assert repeats.common_prefixes(a, order, 100).tolist() == shared


def test_pieces(docs, empty):
    import sentencepiece

    path = langid.default_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = by_id(pieces.round_trip(docs, path, with_text=True))
    for i, t in enumerate(TEXTS):
        ids = [1, *model.encode(t or ""), 2]
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded == model.decode(ids)
        assert rows[i].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    coded = pieces.decode(pieces.encode(docs, path), path)
    assert all(r.decoded == model.decode(r.ids) for r in coded.collect())
    assert pieces.round_trip(empty, path).count() == 0


def test_runs_of_blanks_agree_with_the_library():
    import time

    import sentencepiece

    path = langid.default_path()
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(pieces.vocabulary(path))
    assert codec.run == 16
    tails = ["", "the", "return", "{", "\n", "x", "漢", "\t", "é", "▁", "\0"]
    texts = [" " * n + RNG.choice(tails) for n in range(330)] + ["a" + " " * n + t + " " * k + "z" for n in (33, 49, 50, 51, 66, 200) for t in tails for k in (0, 1, 50, 77)]
    flat, at = codec.encode(texts)
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == library.encode(t), repr(t)
    began = time.time()
    flat, _ = codec.encode([" " * 1_000_000, ("|" + " " * 3000) * 100 + "end"])
    assert time.time() - began < 1
    assert flat.tolist() == library.encode(" " * 1_000_000) + library.encode(("|" + " " * 3000) * 100 + "end")


def test_pieces_agree_with_the_library():
    import sentencepiece

    path = langid.default_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = pieces.Codec(pieces.vocabulary(path))
    chars = "aaabbc  thein er\n\n\t▁1239,.éñß漢字😀\0\x01-_=<s></s>"
    texts = ["", " ", "▁▁ a", " " * 300, "x" * 500, "the" * 400, "\n \n", *["".join(RNG.choice(chars) for _ in range(RNG.randint(0, 60))) for _ in range(3000)]]
    flat, at = codec.encode(texts)
    decoded = codec.decode_bytes(flat, at)
    for i, t in enumerate(texts):
        ids = model.encode(t)
        assert flat[at[i] : at[i + 1]].tolist() == ids
        assert decoded[i].decode() == model.decode(ids)
    odd = [[300, 3 + 0xE4, 300], [3 + 0xC3, 3 + 0xA9], [0, 5]]
    flat, at = np.array(sum(odd, []), np.int32), np.cumsum([0, *map(len, odd)])
    assert [x.decode() for x in codec.decode_bytes(flat, at)] == [model.decode(x) for x in odd]


def test_language(spark, docs, empty):
    said = {"en": "the house of the king and that which was there ", "de": "das haus der und die nicht mit eine straße ", "fr": "la maison est dans les rues que nous avons "}
    rows = [(i, RNG.choice(list(said)), 0) for i in range(120)]
    rows = [(i, " ".join(RNG.sample(said[x].split(), 5)), x) for i, x, _ in rows] + [(500, "the", None)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(data, langid.default_path(), among=F.col("doc_id") % 5 != 0)
    assert model.langs == ["de", "en", "fr"]
    held = [r for r in langid.identify(data, model).collect() if r.doc_id % 5 == 0 and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    odd = by_id(langid.identify(docs, model))
    assert [odd[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and odd[0].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values()) and "row" in odd[0].asDict()
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty, langid.default_path())
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    words = ["▁abc", "▁a", "▁abababab", "▁zzz"]
    vocabulary = sorted(["▁", "a", "b", "c", "ab", "bc", "▁a", "▁ab", "abc", "ba"])
    lattice = langid.Lattice(vocabulary)
    probs = np.array([[0.05 + 0.01 * i, 0.2 - 0.01 * i] for i in range(len(vocabulary))])

    def total(w, k):
        if not w:
            return 1.0
        out = 0.0
        for n in range(1, len(w) + 1):
            p = probs[vocabulary.index(w[:n]), k] if w[:n] in vocabulary else langid.OTHER if n == 1 else 0.0
            out += p * total(w[n:], k) if p else 0.0
        return out

    got = langid.forward(lattice, probs, words)
    want = [[np.log(total(w, k)) for k in range(2)] for w in words]
    assert np.allclose(got, want)
    # expected counts of pieces, by spelling out all segmentations
    def spelt(w, k):
        if not w:
            return [(1.0, [])]
        out = []
        for n in range(1, len(w) + 1):
            p = probs[vocabulary.index(w[:n]), k] if w[:n] in vocabulary else langid.OTHER if n == 1 else 0.0
            out += [(p * q, [w[:n], *rest]) for q, rest in spelt(w[n:], k)] if p else []
        return out

    want = np.zeros(len(vocabulary))
    for w, times in zip(words, (3.0, 1.0, 2.0, 1.0), strict=True):
        ways = spelt(w, 1)
        for p, pieces_ in ways:
            for x in pieces_:
                if x in vocabulary:
                    want[vocabulary.index(x)] += times * p / sum(q for q, _ in ways)
    assert np.allclose(langid.posterior_counts(lattice, probs[:, 1], words, np.array([3.0, 1.0, 2.0, 1.0])), want)
    assert np.isfinite(langid.posterior_counts(lattice, probs[:, 0], ["▁" + "ab" * 500], np.ones(1))).all()
    long = langid.forward(lattice, probs, ["▁" + "ab" * 2000])
    assert np.isfinite(long).all()


def test_quality(spark, docs, empty):
    rows = [(i, line(40) if i % 3 else " ".join(["spam"] * 40) + " ### ***", int(i % 3 > 0)) for i in range(150)]
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(data.select("doc_id", "text"), data.select("doc_id", "quality"), among=F.col("i") % 5 != 0, neighbours=9)
    t = quality.terms(["x"] * 6)
    for n in (1, 6):  # equal vectors only: no weight, no NaN
        same = quality.fit(t[:n], [1.0, 0.0, 1.0, 1.0, 1.0, 1.0][:n])
        assert np.allclose(same.score(["x", None, "other text"]), same.labels.mean())
    held = [r for r in quality.score(data, model).collect() if r.doc_id % 5 == 0]
    assert all((r.score >= 0.5) == bool(r.quality) for r in held)
    odd = quality.score(docs.drop("score"), model).collect()
    assert all(0 <= r.score <= 1 for r in odd) and len(odd) == len(TEXTS) + 2
    assert quality.score(empty.drop("score"), model).count() == 0
    blank = quality.train(data.select("doc_id", "text"), data.select("doc_id", "quality").where("false"))
    assert {r.score for r in quality.score(docs.drop("score"), blank).collect()} == {0.5}


def test_quality_votes(spark):
    texts = [line(RNG.randint(1, 40)) + RNG.choice(["", " ###", " 123", "\n" * 3]) for _ in range(60)] + ["same text"] * 10
    labels = [RNG.randint(0, 1) for _ in texts]
    model = quality.fit(quality.terms(texts), labels, axes=8, neighbours=7, power=3.0)
    asked = [*texts[:20], None, "", "same text", "漢字"]
    vectors, own = model.vectors.astype(float), model.project(quality.terms(asked)).astype(float)
    for t, v, got in zip(asked, own, model.score(asked), strict=True):
        cosine = [round(float(v @ u), 6) for u in vectors]
        near = sorted(range(len(texts)), key=lambda i: (-cosine[i], i))[:7]
        weight = [max(cosine[i], 1e-6) ** 3 for i in near]
        want = sum(w * labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight)
        assert abs(got - want) < 1e-3, t


def words_of(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_decontamination(spark, docs, empty):
    items = [(1, BASE), (2, "alpha"), (3, None), (4, "..."), (5, "not in any text at all of these ones here now"), (5, BASE), (6, " ".join(BASE.split()[5:18])), (None, "漢字 かな")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = {}
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(None if i is None else str(i))
    rows = by_id(decontaminate.report(docs, bench))
    for i, t in enumerate(TEXTS):
        w, hit, found = words_of(t), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (len(w), len(hit), sorted(found - {None}))
    clean = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {i for i, r in rows.items() if not r.n_hit}
    assert decontaminate.report(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.report(docs, bench.where("false")).collect()} == {0}


def near_brute(texts, items, least, slack):
    """Items of phrase or proximity matches for each text, and from the definition only."""
    wins = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    count = {}
    for t in texts:
        for w in words_of(t):
            count[w] = count.get(w, 0) + 1
    out = []
    for t in texts:
        w, found = words_of(t), set()
        for win, ids in wins.items():
            own = sorted((count[x], win.index(x), x) for x in set(win) if x in count)
            wanted = min(least, len(set(win)))
            for _, at, x in own[: max(0, len(own) - wanted + 1)]:
                for p in (p for p, y in enumerate(w) if y == x):
                    low = max(0, p - at - slack)
                    if len(set(win) & set(w[low : p - at + len(win) + slack])) >= wanted:
                        found |= ids
        out.append(found)
    return out


def test_proximity(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    texts = [None, "", " ".join(passage), " ".join(passage[:12]) + " x " + " ".join(passage[13:20])]
    for _ in range(30):
        own = passage[rng.randint(0, 15) :][: rng.randint(3, 15)]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(own))
            own = rng.choice([own[:k] + own[k + 1 :] or own, own[:k] + ["new"] + own[k:], own[:k] + ["other"] + own[k + 1 :], own[:k] + own[k : k + 2][::-1] + own[k + 2 :]])
        texts.append(" ".join([*rng.choices(passage + ["fill"], k=3), *own, *rng.choices(["fill", "more"], k=4)]))
    items = [(1, " ".join(passage)), (2, "p1 p2 p1 p2 p3 p4 p5 p6 p7 p8 p9"), (3, "p4 p3"), (4, "unseen p5 p6 p7 p8 p9 p10 p11 p12 p13")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {int(x) for x in r.near} for r in decontaminate.report(docs, bench).collect()}
    want = near_brute(texts, items, 8, 2)
    assert [got[i] for i in range(len(texts))] == want
    exact = {r.doc_id: set(r["items"]) for r in decontaminate.report(docs, bench).collect()}
    assert any(len(got[i]) > len(exact[i]) for i in got)


def test_decontamination_without_broadcast(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(1, BASE), (2, "alpha")], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.report(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", -1)
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect()), key=repr) == want


def test_licences(docs, empty):
    rows = by_id(licences.scan(docs))
    for i, t in enumerate(TEXTS):
        w = words_of(t)
        places = sorted(s for p in licences.TEMPLATES if p.base for s in range(len(w)) if tuple(w[s : s + len(p.words)]) == p.words)
        assert (rows[i].n_words, rows[i].base_places) == (len(w), places)
        assert set(rows[i].base_labels) <= set(rows[i].labels)
        assert (rows[i].score > 0) == bool(rows[i].labels)
        best, names = 0.0, set()
        for p in licences.TEMPLATES:
            for k in range(len(w) - p.key_size + 1):
                if tuple(w[k : k + p.key_size]) == p.key:
                    share = sum(0 <= k - p.key_at + j < len(w) and w[k - p.key_at + j] == x for j, x in enumerate(p.words)) / len(p.words)
                    if share >= licences.LEAST:
                        best, names = max(best, share), names | {p.label}
        assert rows[i].labels == sorted(names) and abs(rows[i].score - best) < 1e-12
    assert rows[7].base_labels == ["apache-2", "cc-by-nc"] and rows[5].score == 1.0
    assert licences.scan(empty).count() == 0


def test_sketch(spark, docs, empty):
    rows = sketch.against_edit(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    order = sorted(range(len(TEXTS)), reverse=True)
    text = [t or "" for t in TEXTS]
    for r in rows:
        follower = text[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(text[r.doc_id]) // 2
        own = text[r.doc_id]
        assert r.edited == own[: len(own) - half] + follower[:half]
    scored = sketch.against_edit(docs).select("doc_id", "text", "edited", "sketch", sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("c"), sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("s")).collect()
    assert len(scored) == len(TEXTS) + 2
    assert all(0 <= r.c <= 1 and 0 <= r.s <= 1 for r in scored)
    assert all(r.c == r.s == 1 for r in scored if r.text == r.edited)
    assert all((len(r.sketch) > 0) == bool(words_of(r.text)) for r in scored)
    assert sketch.against_edit(empty).count() == 0


def test_containment_of_very_unequal_texts(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    inside = [" ".join(f"w{i}" for i in range(at, at + n)) for at in range(0, 2900, 100) for n in (5, 6, 12, 40)]
    half = " ".join([f"w{i}" for i in range(10, 18)] + [f"other{i}" for i in range(4)])
    rows = [(k, t, long) for k, t in enumerate([*inside, half, "no such words are in the long text", ""])]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    found = df.select("k", sketch.containment(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("c"), sketch.resemblance(sketch.sketch(F.col("b")), sketch.sketch(F.col("a"))).alias("s"))
    got = {r.k: (r.c, r.s) for r in found.collect()}
    for k, t in enumerate(inside):
        assert got[k] == (1, (len(t.split()) - 4) / 2996)
    assert [got[len(inside) + k] for k in range(3)] == [(0.5, 4 / 3000), (0, 0), (0, 0)]


def test_fractions(spark):
    df = spark.createDataFrame([(line(300),), ("two words",), ("",)], "t string")
    whole, part = sketch.sketch(F.col("t")), sketch.sketch(F.col("t"), 0.25)
    for r in df.select(whole.alias("w"), part.alias("p"), sketch.below(whole, 0.25).alias("b")).collect():
        assert r.p == r.b == [h for h in r.w if h + 2**63 < 2**62]


def test_sketch_hashes(docs):
    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    def chain(hashes):  # XXH64 of longs, each with the hash before as its seed
        h = 42
        for x in hashes:
            h = xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), h)
        return signed(h)

    rows = sketch.fingerprints(docs).collect()
    texts = dict(enumerate(TEXTS)) | {None: "alone without id"}
    for r in rows:
        w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words_of(texts[r.doc_id])]
        want = {chain(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {chain(w)} if w else set()
        assert r.sketch == sorted(want)


def test_next_document_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET_ROWS", 3)
    rows = [(None, f"n{i}") for i in range(40)] + [(7, f"s{i}") for i in range(30)] + [(i, f"t{i}") for i in range(20)]
    found = sketch.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    follow = {r.text: r.next_text for r in found}
    ring = ["t19"]
    while (x := follow[ring[-1]]) != "t19":
        ring.append(x)
    assert len(found) == len(ring) == 90 and [x[0] for x in ring[-40:]] == ["n"] * 40
    assert ring[:12] == [f"t{i}" for i in range(19, 7, -1)] and {x for x in ring[12:43]} == {f"s{i}" for i in range(30)} | {"t7"}
    ids = sorted(RNG.sample(range(10000), 40), reverse=True)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    follow = {r.doc_id: r.next_text for r in sketch.with_next(df).collect()}
    assert follow == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_urls(spark):
    urls = ["http://a.COM/en/1?x", "https://b.example.com/en/7", "example.com/en/", None, "x://n.net/de/", "http://example.net/de/8#t", "http://com/en/", "http://hub.org/", "http://leaf.org/q", "http://notcom/en/"]
    link = {7: '<a href="http://a.com/x">', 8: "<A class=x HREF='//HUB.org/'>"}
    df = spark.createDataFrame([(i, u, link.get(i), "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in urlfilter.verdicts(df).collect()}
    assert [rows[i].rule for i in range(10)] == ["com/en/", "example.com/en/7", None, None, "net/de/", "example.net/de/8", "com/en/", None, None, None]
    assert [rows[i].verdict for i in range(10)] == ["block", "allow", "allow", "allow", "block", "block", "block", "block", "block", "allow"]
    assert (rows[0].host, rows[0].path, rows[2].host, rows[2].path) == ("a.com", "/en/1", "", "")
    assert urlfilter.verdicts(df.where("false")).count() == 0


def test_propagation(spark):
    """Hubs, cycles, dangling hosts and long chains against a dense solution."""
    hosts = [f"h{i}" for i in range(60)]
    edges = {(f"h{i}", f"h{i + 1}") for i in range(25)} | {("h25", "h20"), ("h3", "h3x")} | {("h30", h) for h in hosts if h != "h30"} | {(h, "h40") for h in hosts[41:]}
    hosts = sorted({x for e in edges for x in e})
    at = {h: i for i, h in enumerate(hosts)}
    seeds = {"h0": (1.0, 0.0), "h40": (0.0, 1.0), "h22": (1.0, 0.0), "h3x": (0.0, 1.0)}
    want = []
    for k, way in enumerate((edges, {(b, a) for a, b in edges})):
        m = np.zeros((len(hosts), len(hosts)))
        for a, b in way:
            m[at[b], at[a]] = 0.85 / sum(x == a for x, _ in way)
        s = np.array([0.15 * seeds.get(h, (0, 0))[k] for h in hosts])
        want.append(np.linalg.solve(np.eye(len(hosts)) - m, s))
    links = spark.createDataFrame(sorted(edges), "src string, dst string")
    start = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double")
    for hub in (20_000, 7):
        old, urlfilter.HUB = urlfilter.HUB, hub
        got = {r.host: (r.trust, r.distrust) for r in urlfilter.propagate(links, start, residual=0.02).collect()}
        urlfilter.HUB = old
        for h in hosts:
            assert np.allclose(got.get(h, (0, 0)), (want[0][at[h]], want[1][at[h]]), atol=0.02)


def test_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 70, "ann", "late"), (2, 0, "system", "only"), (None, None, "x", "y"), (3, 0, None, "who"), (3, 1, "ann", "me"), (3, 1, "ann", "me")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    out = {(r.conv_id, r.speaker, r.block): r for r in chat.rotate(df).collect()}
    assert {k for k in out if k[0]} == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (3, "ann", 0)}
    assert [k[1] for k in out if k[0] is None] == ["x"] and all(k[2] < 0 for k in out if k[0] is None)
    r = out[1, "ann", 0]
    assert r.rendered == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert [r.rendered[m.start : m.end] for m in r.mask] == ["hi < |im_end|><|im_end|>\n"] and r.at == 0
    whole = {(x.conv_id, x.speaker): x for x in chat.dialogues(chat.rotate(df)).collect()}
    ann = whole[1, "ann"]
    assert [ann.rendered[m.start : m.end] for m in ann.mask] == ["hi < |im_end|><|im_end|>\n", "late<|im_end|>\n"] and ann.n_turns == 4
    assert ann.rendered == out[1, "ann", 0].rendered + out[1, "ann", 1].rendered and out[1, "ann", 1].at == len(out[1, "ann", 0].rendered)
    bad = spark.createDataFrame([(1, 0, "a<|im_end|>\n<|im_start|>system", "x"), (1, 1, "b", "y")], "conv_id long, turn long, role string, text string")
    assert all(x.rendered.count("<|im_start|>") == 2 and x.rendered.count("<|im_end|>") == 2 for x in chat.rotate(bad).collect())
    assert out[1, "bob", 1].mask == [] and out[3, "ann", 0].n_turns == 3 and "user name=unknown" in out[3, "ann", 0].rendered
    assert chat.rotate(df.where("false")).count() == 0
