"""Media columns, the prefix trie and importance resampling against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlight.llm import media, prefixes, registry, resample, sql

RNG = random.Random(5)
PASSAGE = bytes(RNG.randrange(32, 127) for _ in range(9000)).decode()


def prose(n):
    return " ".join(RNG.choice(["the", "Alpha", "béta", "x1", "漢字", "gamma;", "delta"]) for _ in range(n))


TEXTS = [None, "", "   ", "one", "a" * 100_000, prose(3000), PASSAGE, "head " + PASSAGE, prose(900) + PASSAGE + prose(50), PASSAGE + PASSAGE, "😀é" * 300, "x" * 576, "x" * 577, "w" * 70 + " " + "v" * 300 + " tail"]
TEXTS += [TEXTS[5]] * 3 + [prose(RNG.randint(1, 60)) for _ in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, prose(25), "c", 2), (None, None, "c", 2), (7, prose(30), "c", 3), (7, TEXTS[7], "c", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, medium string, rank int").repartition(3)


# --- media -----------------------------------------------------------------------------------------------------------


def gear(data, at):
    return sum(int(media.GEAR[data[at - k]]) << k for k in range(32)) & 0xFFFFFFFF


def test_cuts():
    data = PASSAGE.encode() + b"z" * 40_000
    may = {i + 1 for i in range(31, len(data)) if gear(data, i) >> (32 - media.BITS) == 0}
    ends = media.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    for a, b in zip([0, *ends], ends, strict=False):
        inner = [x for x in may if a + media.LEAST <= x < min(b, a + media.MOST)]
        assert not inner and b - a <= media.MOST
        assert b in may or b - a == media.MOST or b == len(data)
    shifted = media.cuts(b"head " + data)
    assert {x - 5 for x in shifted[2:]} & set(ends)  # cuts come back behind an insertion


def test_media_code():
    for n in (1, 5):
        samples = bytes(range(64)) * 9 * n
        assert media.decode(media.encode(samples)) == samples
    with pytest.raises(ValueError):
        media.decode(b"P5\n576 2\n255\n" + b"x" * 576)


@pytest.mark.parametrize("marks", [26, 6])
def test_media(docs, marks):
    stored = media.write(docs, marks=marks)  # with 64 bits nearly every chunk counts as repeated
    rows = media.features(stored).collect()
    texts = sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=str)
    assert len(rows) == len(texts)
    want = []
    for i, content in texts:
        samples = content + b"\xff" * (-len(content) % 576 if content else 576)
        medium = b"P5\n576 %d\n255\n" % (len(samples) // 576) + samples
        runs = np.frombuffer(samples, np.uint8).reshape(64, -1).astype(int).sum(1)
        bits = int("".join("01"[int(r * 64 > runs.sum())] for r in runs), 2)
        want.append((i, len(content), hashlib.sha256(medium).hexdigest(), len(medium), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), f"{bits:016x}-{runs.sum() // len(samples)}"))
    assert sorted(((r.doc_id, r.n_bytes, r.medium.hex(), r.n_media, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in rows), key=str) == sorted(want, key=str)
    kept = stored.chunks.collect()
    assert len({bytes(r.digest) for r in kept}) == len(kept)
    if marks == 26:  # a chunk is kept once, wherever it stands
        inside = sum(c.size for r in stored.packs.collect() for c in r.chunks if c.own)
        once = {hashlib.blake2b(medium[a:b], digest_size=16).digest(): b - a for medium in (media.encode(media.payload(c)) for _, c in texts) for a, b in zip([0, *media.cuts(medium)], media.cuts(medium), strict=False)}
        assert inside + sum(once[bytes(r.digest)] for r in kept) == sum(once.values())


def test_media_that_is_damaged_is_found(docs):
    stored = media.write(docs.where("doc_id in (6, 7)"))
    broken = media.Stored(stored.packs, stored.chunks.withColumn("digest", F.reverse("digest")))
    with pytest.raises(Exception, match="KeyError"):
        media.features(broken).collect()
    wrong = media.Stored(stored.packs.withColumn("medium", F.lit(b"x" * 32)), stored.chunks)
    with pytest.raises(Exception, match="don't make it up"):
        media.features(wrong).collect()


def test_media_of_nothing(docs):
    assert media.features(media.write(docs.where("false"))).count() == 0


# --- prefixes --------------------------------------------------------------------------------------------------------


def trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t, r or "", x or ""))
    digest = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest()
    for c in conv:
        conv[c] = [(r, x) for _, r, x in sorted(conv[c], key=lambda t: (t[0] is not None, t[0] or 0, digest(*t[1:])))]
    members, kids, out = defaultdict(list), defaultdict(list), {}
    length = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        said = tuple(conv.get(c - c % 20, [])[:h] + own[h:])
        length[c] = len(said)
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        m, own = members[n], kids[n]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = ",".join(map(str, sorted(c for c in m if length[c] == len(n))))
        out[n] = (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(own), sum(out[k][5] for k in own) if own else 1, (len(m) - 1) * words + sum(out[k][6] for k in own), hashlib.sha256(ends.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [4096, 4])
def test_trie(spark, block, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", block)  # four levels of sums
    rows = [(RNG.choice([None, *range(70)]), RNG.choice([None, 0, 1, 2, 3]), RNG.choice([None, "u", "a"]), RNG.choice([None, "", "x y", "x  z", "hi"])) for _ in range(200)]
    rows += [(5, 9, "u", "z")] * 3 + [(20, None, None, None)] + [(100 + i, 0, "u", "same") for i in range(40)]  # repeats, a hot first turn
    rows += [(1000 + i, k, "u", f"t {k}") for i in range(20) for k in range(4)] + [(2000, k, "a", "very long") for k in range(300)]
    rows += [(80, 1, "u", "alone")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, node string").repartition(3)
    got = prefixes.trie(prefixes.shared_heads(prefixes.numbered(df))).collect()
    want = trie(rows)
    assert sorted(tuple(r[:8]) for r in got if r.depth) == sorted(v for v in want.values() if v[1])
    assert [tuple(r[:8]) for r in got if not r.depth] == [v for v in want.values() if not v[1]]
    inside = sorted((r.place, r.stop, r.depth) for r in got)
    assert [p for p, _, _ in inside] == list(range(len(got)))
    for p, stop, depth in inside:  # a subtree is an interval of places
        assert all(d > depth for _, _, d in inside[p + 1 : stop]) and (stop == len(inside) or inside[stop][2] <= depth)


def test_end_digests(spark):
    rows = [(b"a", i - 50) for i in range(500)] + [(b"b", 7), (b"c", 1), (b"c", 10), (b"c", 9)]
    got = {bytes(r.node): r.ends_sha256 for r in prefixes.end_digests(spark.createDataFrame(rows, "node binary, conv_id long").repartition(5), 3).collect()}
    assert got == {n: hashlib.sha256(",".join(str(c) for m, c in sorted(rows) if m == n).encode()).hexdigest() for n in (b"a", b"b", b"c")}


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert prefixes.trie(prefixes.shared_heads(prefixes.numbered(df))).count() == 0
    alone = spark.createDataFrame([(3, None, None, None)], "conv_id long, turn long, role string, text string")
    found = prefixes.trie(prefixes.with_roots(prefixes.numbered(alone), alone)).collect()
    assert [(r.conv_id, r.depth, r.n_leaves, r.saved_tokens) for r in sorted(found, key=lambda r: r.depth)] == [(3, 0, 1, 0), (3, 1, 1, 0)]


# --- resampling ------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text, most=2):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, most + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_feature_buckets(most):
    texts = [*TEXTS, "A", "a b", "\x00zz\x7f", "é"]
    n_words, found = resample.feature_buckets(pa.array(texts), most=most)
    own = defaultdict(list)
    for owner, bucket in found:
        for o, b in zip(owner.tolist(), bucket.tolist(), strict=True):
            own[o].append(b)
    for i, t in enumerate(texts):
        assert (n_words[i], own[i]) == buckets(t, most)
    part = pa.array(texts).slice(5, 4)
    assert resample.feature_buckets(part, most=most)[0].tolist() == n_words[5:9].tolist()


def test_resample(spark, docs):
    target = spark.createDataFrame([("the alpha gamma delta",), (None,), ("béta",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    s, t = [0] * 10_000, [0] * 10_000
    for table, texts in ((s, [x for _, x in rows]), (t, [r.text for r in target.collect()])):
        for x in texts:
            for b in buckets(x)[1]:
                table[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    want = []
    for i, x in rows:
        n, own = buckets(x)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[2], r[3]))
    for k, r in enumerate(may[: 25 * len(may) // 100]):
        r[5] = k + 1
    got = [list(r) for r in resample.resample(docs, target).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ranks_of_equal_scores(spark):
    rows = [(i % 7, 30, 5, w, w) for i, w in enumerate([3] * 50 + [9] * 3 + [-400] * 40)] + [(None, 30, 5, 3, 3)] * 6 + [(1, 2, 3, 99, 99)]
    table = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(4)
    for percent in (0, 1, 25, 100):
        got = resample.ranked(table, percent).collect()
        may = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
        drawn = sorted((r.rank, r.score, r.doc_id) for r in got if r.rank is not None)
        assert drawn == [(k + 1, r[4], r[0]) for k, r in enumerate(may[: percent * len(may) // 100])]
        assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, rows))


def test_resample_of_nothing(docs):
    none = docs.where("false")
    assert resample.resample(none, docs).count() == 0
    assert resample.resample(docs, none).count() == docs.count()


# --- registered queries ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_media", "op12_prefixes", "op13_resample"])
def test_query(spark, docs, tmp_path, name):
    turns = [(i, k, "u", f"t {k * (i % 3)}") for i in range(45) for k in range(i % 6)] + [(60, None, None, "x")]
    tables = {
        "documents": docs.withColumn("lang", F.lit("en")),
        "benchmark": spark.createDataFrame([(1, "the alpha gamma")], "item_id long, text string"),
        "conversations": spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
    }
    duck = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    ours = registry.queries()[name](spark, str(tmp_path))
    theirs = duck.sql(registry.oracle_sql()[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    rows = sorted(tuple(r[c] for c in order) for r in [{k: str(v) for k, v in x.asDict().items()} for x in ours.collect()])
    assert rows == sorted(tuple(str(r[theirs.columns.index(c)]) for c in order) for r in theirs.fetchall())


def test_crc_in_sql():
    words = ["", "a", "漢字 x", "0" * 50]
    found = duckdb.sql(f"WITH {sql.STEPS} SELECT w, {sql.crc32(sql.byte_list('encode(w)'))} FROM (SELECT unnest({words}) AS w), steps").fetchall()
    assert dict(found) == {w: zlib.crc32(w.encode()) for w in words}


def test_turns_are_shuffled_above_the_union(spark):
    """Parts of a union that are each dealt by the conversation don't count as dealt together: adaptive execution may coalesce each in its own way."""
    df = spark.createDataFrame([(i, k, "u", "x") for i in range(50) for k in range(3)], "conv_id long, turn long, role string, text string")
    plan = prefixes.steps(prefixes.shared_heads(prefixes.numbered(df)))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Union")]
    assert "Exchange hashpartitioning(xxhash64(conv_id" in above and "Sort [conv_id" in above
