"""Removal of long repeated byte strings with suffix arrays.

Every byte covered by a ``span``-byte string that also starts earlier (smaller id, or the same document and an
earlier start) is removed.  Suffix arrays of all text in arbitrary shards would have to be merged pair by pair, or
every suffix sent with its first ``span`` bytes; so the shards are cut by content:

1. Every window of ``span`` bytes has a minimiser, its least hash of GRAM bytes, at a place that depends on the
   window's bytes alone.  Neighbouring windows with one minimiser are a run; equal windows lie in runs of equal
   minimisers.  A run is sent as a few numbers: hashes of its minimiser and of all its bytes, its place and size.
   Within a slice only the first of equal runs is sent on; the others are marked there.
2. Runs meet sorted by minimiser.  The first of equal runs keeps its windows, later ones are marked as they stream
   by.  Where one minimiser has unequal runs, their first ones are left over.
3. Only for those the bytes are fetched.  They are dealt in shards by minimiser, frequent minimisers salted into
   several shards.  A shard's suffix array is built by Larsson-Sadakane refinement and its common prefixes are
   computed along it; suffixes that share ``span`` bytes are equal windows, and all but the first are marked.
   First windows of salted shards are merged across shards by binary search in the sorted keys.
4. A document's marks are united, and its other bytes are kept.

No step holds more than a slice, a shard, or one document; equal runs are never expanded into pairs.

Cases.  Null texts are empty.  Texts shorter than ``span`` bytes stay whole.  Rows that repeat an id and a text are
copies of one document and don't remove each other; other texts of one id, null among the ids, are documents of
their own, in the order of a hash.  Null ids come last.  Very long texts are cut for step 1 only,
with an overlap; what that splits is settled in step 3.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices

SPAN, GRAM = 100, 32
SLICE, SEGMENT = 3_000_000, 2_000_000
#: Runs of one minimiser in a shard, and bytes of a shard.
SHARD_RUNS, SHARD_BYTES = 4000, 2_000_000
#: Tasks over which the runs of a frequent minimiser are dealt when they are told their number of shards; there is one
#: such minimiser in SHARD_RUNS runs at most, so these copies are few.
PARTS = 64
LAST = (1 << 63) - 1
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
S29, S32 = np.uint64(29), np.uint64(32)
PLACE = np.uint64((1 << 23) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> S32
    x *= C1
    x ^= x >> S29
    return x


def _grams(raw: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 8, 32 and 64 bytes that start at each place."""
    n = len(raw)
    eight = np.ndarray((n - 7,), "<u8", raw.tobytes() + b"", strides=(1,)).copy()
    out = {8: _mixed(eight * C3)}
    for m in (8, 16, 32):
        h = out[m]
        out[2 * m] = _mixed((h[:-m] * C2) ^ (h[m:] + C3))
        if m == 16:
            del out[16]
    return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = len(keys)
    blocks = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(raw: np.ndarray, ends: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(gram, whole, start, windows, lead) of every run in texts laid end to end; ``ends`` are the texts' ends.

    gram, whole: hashes of the minimiser and of the run's bytes; lead: from its start to the minimiser.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < span:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h = _grams(raw)
    width = span - GRAM + 1
    least = _least((h[GRAM] & ~PLACE) | np.arange(len(h[GRAM]), dtype=np.uint64), width)
    place = (least & PLACE).astype(np.int64)  # of the minimiser of the window at each start
    text = np.searchsorted(ends, np.arange(len(place)), side="right")
    inside = np.arange(len(place)) + span <= ends[text]
    head = inside.copy()
    head[1:] &= (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    start = np.flatnonzero(head)
    stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~head[1:], False))
    windows, at = stop - start + 1, place[start]
    size, lead = windows + span - 1, at - start
    whole = (h[64][start] * C1) ^ (h[64][start + size - 64] * C2)
    long = size > 128
    whole[long] ^= h[64][start[long] + 52] * C3
    whole = _mixed(whole ^ _mixed((size * 256 + lead).astype(np.uint64) * C2))
    return h[GRAM][at], whole, start, windows, lead


def suffix_array(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each), refined by doubling: only groups that are not yet sorted are sorted again."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    # padding can't tell an end from zero bytes: of equal keys the shorter suffix comes first, in a group of its own
    order = n - 1 - np.argsort(key[::-1], kind="stable")
    left = np.minimum(n - order, 8)
    new = np.append(True, (key[order[1:]] != key[order[:-1]]) | (left[1:] != left[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = head
    rank[n] = -1
    depth = 8
    open_ = np.flatnonzero(np.append(head[1:] == head[:-1], False) | np.append(False, head[1:] == head[:-1])) if n else np.zeros(0, np.int64)
    while len(open_) and depth < 2 * n + 16:
        at = order[open_]
        first, second = rank[at], rank[np.minimum(at + depth, n)]
        by = np.lexsort((at, second, first)) if depth >= n else np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[open_] = at
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        head = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = head
        same = head[1:] == head[:-1]
        open_ = open_[np.append(same, False) | np.append(False, same)]
        depth *= 2
    return order, rank[:n]


def common_prefixes(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to ``most``.

    As in Kasai's method they are computed in text order, and a suffix shares at least one byte less than its
    predecessor in the text does; a pass compares eight bytes of all suffixes that are still equal.
    """
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.ndarray((n,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for k in range(0, most, 8):
        a, b = live + k, before[live] + k
        fits = np.maximum(a, b) + 8 <= n
        equal = np.zeros(len(live), bool)
        equal[fits] = words[a[fits]] == words[b[fits]]
        for i in np.flatnonzero(~fits).tolist():  # the last few bytes
            x, y = int(a[i]), int(b[i])
            j = 0
            while j < 8 and max(x, y) + j < n and raw[x + j] == raw[y + j]:
                j += 1
            shared[live[i]] = k + j
        off = live[fits & ~equal]
        if len(off):
            x = words[off + k] ^ words[before[off] + k]
            low = x & (~x + np.uint64(1))
            shared[off] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[equal]
        shared[live] = k + 8
    out = np.minimum(shared, most)[order]
    out[:1] = 0
    return out


def equal_windows(raw: np.ndarray, starts: np.ndarray, span: int = SPAN) -> np.ndarray:
    """A class for each window start: equal windows have equal classes."""
    order, rank = suffix_array(raw)
    shared = common_prefixes(raw, order, span)
    return np.cumsum(shared < span)[rank[starts]]


def _owners(doc: np.ndarray, row: np.ndarray, start: np.ndarray, key: list[np.ndarray]) -> np.ndarray:
    """Which rows are the first of their key, by (doc, row, start); rows that aren't sorted by row yet are for null ids only."""
    order = np.lexsort((start, row, doc, *key))
    new = np.zeros(len(doc), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[order][1:] != k[order][:-1]
    # rows at the very place of the first one are the same document, repeated
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    same = (doc[order] == doc[order][head]) & (row[order] == row[order][head]) & (start[order] == start[order][head])
    out = np.zeros(len(doc), bool)
    out[order] = same
    return out


#: place: start, number of windows (8 bits) and kind (1 bit), so that a run is five numbers and sorts by its start.
_RUN = "gram long, whole long, doc long, row long, place long"
_MET = "gram long, row long, place long"


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])


def _scan(span: int):
    """Texts to runs: of kind 1 if the first of its slice, else of kind 0, a mark already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            doc, row = part.column(0).to_numpy(), part.column(1).to_numpy()
            texts = [(x.as_py() or "").encode() for x in part.column(2)]
            cuts = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t) - span + 1, SEGMENT)]
            i = 0
            while i < len(cuts):
                j, held = i, 0
                pieces = []
                while j < len(cuts) and (not pieces or held < SLICE):
                    k, at = cuts[j]
                    pieces.append(texts[k][at : at + SEGMENT + span - 1])
                    held += len(pieces[-1])
                    j += 1
                ends = np.cumsum([len(p) for p in pieces])
                gram, whole, start, windows, lead = runs(np.frombuffer(b"".join(pieces), np.uint8), ends, span)
                owner = np.searchsorted(ends, start, side="right")
                of = np.array([k for k, _ in cuts[i:j]])
                shift = np.array([at for _, at in cuts[i:j]]) - np.concatenate([[0], ends[:-1]])
                start = start + shift[owner]
                d, r = doc[of[owner]], row[of[owner]]
                first = _owners(d, r, start, [whole, gram])
                yield _batch(_RUN, gram.view(np.int64), whole.view(np.int64), d, r, start << 9 | windows << 1 | first)
                i = j

    return run


def _stream(span: int):
    """Runs sorted by (gram, whole, doc, row, place) to marks (kind 0) and runs that are left over (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None  # of the last run: gram, whole, its group's first doc and start
        waiting: list[np.ndarray] | None = None  # the first run of the last gram, while that has one group
        prior = 0  # groups of the last gram
        for b in batches:
            c = [b.column(k).to_numpy() for k in range(5)]
            ready = (c[4] & 1) == 0
            if ready.any():
                yield _batch(_MET, c[0][ready], c[3][ready], c[4][ready])
            gram, whole, doc, row, place = [x[~ready] for x in c]
            start = place >> 9
            n = len(gram)
            if not n:
                continue
            goes_on = tail is not None and gram[0] == tail[0]
            new_gram = np.append(not goes_on, gram[1:] != gram[:-1])
            new = new_gram | np.append(not goes_on or whole[0] != tail[1], whole[1:] != whole[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first_doc = np.where(head >= 0, doc[head], tail[2] if goes_on else 0)
            first_row = np.where(head >= 0, row[head], tail[4] if goes_on else 0)
            first_start = np.where(head >= 0, start[head], tail[3] if goes_on else 0)
            mark = ~new & ((doc != first_doc) | (row != first_row) | (start != first_start))
            g = np.cumsum(new_gram)
            g -= g[0]
            groups = np.bincount(g, new).astype(int)
            groups[0] += prior if goes_on else 0
            if goes_on and waiting is not None and groups[0] > 1:
                yield _batch(_MET, *waiting)
            if not goes_on or groups[0] > 1:
                waiting = None
            left = new & (groups[g] > 1)
            out = mark | left
            if out.any():
                yield _batch(_MET, gram[out], row[out], np.where(left, place, place & ~1)[out])
            prior = int(groups[-1])
            own = np.flatnonzero(new & (g == g[-1]))
            if prior > 1:
                waiting = None
            elif len(own):
                waiting = [x[own[:1]] for x in (gram, row, place)]
            tail = (gram[-1], whole[-1], first_doc[-1], first_start[-1], first_row[-1])

    return run


def _shards(span: int):
    """Left-over runs with their bytes, sorted by (gram, salt), to marks (salted null) and first windows of salted shards."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, salt, salted, doc, row, start, raw = zip(*rows, strict=True)
        text = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(x) for x in raw])
        windows = sizes - span + 1
        of = np.repeat(np.arange(len(raw)), windows)
        within = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = (np.cumsum(sizes) - sizes)[of] + within
        classes = equal_windows(text, at, span)
        d, r, s = (np.array(x, np.int64)[of] for x in (doc, row, start))
        s = s + within
        first = _owners(d, r, s, [classes])
        hidden = ~first
        yield _batch(_WINDOW, np.zeros(hidden.sum(), np.int8), np.zeros(hidden.sum(), np.int64), np.zeros(hidden.sum(), np.int64), d[hidden], r[hidden], s[hidden])
        open_ = first & np.array(salted, bool)[of]
        if open_.any():
            h = _grams(text)[64]
            a = at[open_]
            one = _mixed((h[a] * C1) ^ (h[a + span - 64] * C2))
            two = _mixed((h[a] * C2) + _mixed(h[a + span - 64] ^ C3))
            yield _batch(_WINDOW, np.ones(len(a), np.int8), one.view(np.int64), two.view(np.int64), d[open_], r[open_], s[open_])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for x in zip(*[b.column(k).to_pylist() for k in range(7)], strict=True):
                if rows and held > SHARD_BYTES and x[:2] != rows[-1][:2]:
                    yield from settle(rows)
                    rows, held = [], 0
                rows.append(x)
                held += len(x[6])
        if rows:
            yield from settle(rows)

    return run


_WINDOW = "kind byte, one long, two long, doc long, row long, start long"


def _merge():
    """Windows sorted by (one, two, doc, row, start): each is looked up by binary search among the distinct keys of its
    batch; the first of a key stays, later ones are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            kind, one, two, doc, row, start = (b.column(k).to_numpy() for k in range(6))
            n = len(one)
            if not n:
                continue
            heads = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            head = heads[np.searchsorted(heads, np.arange(n), side="right") - 1]
            d, r, s = doc[head].copy(), row[head].copy(), start[head].copy()
            if last is not None and (one[0], two[0]) == last[:2]:
                d[head == 0], r[head == 0], s[head == 0] = last[2:]
            mark = (doc != d) | (row != r) | (start != s)
            yield _batch(_WINDOW, kind[mark], one[mark], two[mark], doc[mark], row[mark], start[mark])
            last = (one[-1], two[-1], d[-1], r[-1], s[-1])

    return run


def _bytes_of(span: int):
    """Texts with their left-over runs to a row a run, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            out: list[list] = [[] for _ in range(6)]
            for doc, row, text, todo in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                raw = (text or "").encode()
                for x in todo:
                    for o, v in zip(out, (x["gram"], x["salts"], doc, row, x["start"], raw[x["start"] : x["start"] + x["windows"] + span - 1]), strict=True):
                        o.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["gram", "salts", "doc", "row", "start", "raw"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their marks to what is kept."""
    for b in slices(batches, "text", SLICE):
        ids = b.column(0)
        n, gone, kept, spans, texts = [], [], [], [], []
        for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = (text or "").encode()
            if marks:
                at = np.array([(m["start"], m["start"] + m["bytes"]) for m in marks], np.int64)
                at = at[np.argsort(at[:, 0], kind="stable")]
                reach = np.maximum.accumulate(at[:, 1])
                new = np.append(True, at[1:, 0] > reach[:-1])
                lows, highs = at[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
                own = list(zip(lows.tolist(), highs.tolist(), strict=True))
                parts, done = [], 0
                for a, z in own:
                    parts.append(raw[done:a])
                    done = z
                kept.append(b"".join([*parts, raw[done:]]))
            else:
                own = []
                kept.append(raw)
            texts.append(_whole_characters(raw, own))
            n.append(len(raw))
            gone.append(len(raw) - len(kept[-1]))
            spans.append([{"start": a, "end": z} for a, z in own])
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([ids, *made, *b.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_text", *b.schema.names[3:]])


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, and without the rest of any character that a span cuts in two."""
    parts, done = [], 0
    for a, z in spans:
        while a > done and raw[a] & 0xC0 == 0x80:
            a -= 1
        while z < len(raw) and raw[z] & 0xC0 == 0x80:
            z += 1
        parts.append(raw[done:a])
        done = z
    return b"".join([*parts, raw[done:]]).decode()


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, others: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, kept_text), a row for each row of ``df``.

    kept is binary, as bytes are removed; kept_text lacks the rest of characters that were cut in two.
    ``span`` from 96 to 128.  With ``others`` a struct of that name holds the other columns of ``df``.
    """
    if not 96 <= span <= 128:
        raise ValueError("span must be from 96 to 128 bytes")
    docs_of = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    rest = [F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (doc_id, text)]).alias("others")] if others else []
    whole = df.select(*docs_of, F.xxhash64(docs_of[0], docs_of[1]).alias("row"), *rest)
    docs = whole.select("doc_id", "text", "row")
    shuffled = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    doc = F.coalesce("doc_id", F.lit(LAST)).alias("doc")
    scanned = docs.select(doc, "row", "text").mapInArrow(_scan(span), _RUN)
    # runs marked already meet nobody: they are dealt by their row, or those of a common passage would fill one task
    meets = F.when(F.col("place") % 2 == 1, F.col("gram")).otherwise(F.col("row"))
    met = scanned.repartition(shuffled, meets).sortWithinPartitions("gram", "whole", "doc", "row", "place").mapInArrow(_stream(span), _MET)
    place = F.col("place")
    met = cut(met.select((place % 2).alias("kind"), "gram", "row", F.shiftright(place, 9).alias("start"), (F.shiftright(place, 1) % 256).cast("int").alias("windows")))
    left = met.where("kind = 1")
    # only frequent minimisers have more than one shard; their runs meet that number in several parts
    salts = left.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / SHARD_RUNS).cast("int").alias("salts")).where("salts > 1")
    salts = salts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    parted = left.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(PARTS)).cast("int")).join(salts, ["gram", "part"], "left")
    todo = parted.groupBy("row").agg(F.collect_list(F.struct("gram", F.coalesce("salts", F.lit(1)).alias("salts"), "start", "windows")).alias("todo"))
    fetched = docs.select(doc, "row", "text").join(todo, "row").select("doc", "row", "text", "todo").mapInArrow(_bytes_of(span), "gram long, salts int, doc long, row long, start long, raw binary")
    salt = F.pmod(F.xxhash64("row", "start"), F.col("salts")).cast("int")
    dealt = fetched.select("gram", salt.alias("salt"), (F.col("salts") > 1).alias("salted"), "doc", "row", "start", "raw").repartition(shuffled, "gram", "salt").sortWithinPartitions("gram", "salt")
    settled = cut(dealt.mapInArrow(_shards(span), _WINDOW))
    merged = settled.where("kind = 1").repartition(shuffled, "one", "two").sortWithinPartitions("one", "two", "doc", "row", "start").mapInArrow(_merge(), _WINDOW)
    ones = settled.where("kind = 0").select("row", "start").unionByName(merged.select("row", "start"))
    marks = (
        met.where("kind = 0").select("row", "start", (F.col("windows") + (span - 1)).cast("long").alias("bytes"))
        .unionByName(ones.select("row", "start", F.lit(span).cast("long").alias("bytes")))
        .distinct().groupBy("row").agg(F.collect_list(F.struct("start", "bytes")).alias("marks"))
    )
    judged = whole.join(marks, "row", "left").select("doc_id", "text", "marks", *(["others"] if others else []))
    new = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary, kept_text string")
    return judged.mapInArrow(_apply, T.StructType([*new.fields, *judged.schema.fields[3:]]))
