"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of such a vocabulary holds the space symbol after another character, so a text is a sequence of units
(space symbols, then other characters) that are encoded apart; so are the two sides of any two neighbouring characters
that no piece has next to one another.  A slice of documents is cut into units, the distinct units are encoded
together, and the documents' ids are gathered from them.  Symbols lie in one flat array; a round looks up the rank of
every neighbouring pair, takes the least rank of each word, merges its pairs of that rank from the left in all words at
once, and compacts; words without a pair leave, and rounds go on until no pair remains.  The library's queue merges
one pair after another: best score first, the leftmost of equal ones.  Merging all of a word's pairs of one rank at
once is the same as long as no pair with the piece they make ranks better than it does; the vocabulary's ranks where that
doesn't hold are known, and of those only the leftmost pair of a word is merged in a round.  Long runs of blanks, which
would take a round for each blank then, are cut from the left into units of the longest piece of blanks, where the
vocabulary is found to encode them so.

Cases.  Null and empty texts have no piece: only the begin and end ids.  Characters outside the vocabulary become
byte pieces.  Repeated rows are encoded alike.  The vocabulary's file is read on the driver only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import append_columns

SPACE = "▁"
#: Bytes of text that are encoded together; a longer text alone.
SLICE = 2_000_000
NONE = np.iinfo(np.int32).max
#: Symbols of characters outside the vocabulary are numbered from here by code point.
OUTSIDE = 1 << 20
UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class Vocabulary:
    """Pieces, scores and kinds of a model, as plain lists that can be sent to executors."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.bytes = [model.is_byte(i) for i in range(n)]
        self.special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        normal = [p for p, b, s in zip(self.pieces, self.bytes, self.special, strict=True) if not b and not s]
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in normal):
            raise ValueError("a piece spans words or lines; units can't be encoded apart")


class Codec:
    """Tables for encoding and decoding, built once a worker from a Vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v, n = v, len(v.pieces)
        normal = [i for i in range(n) if not v.bytes[i] and not v.special[i]]
        symbol = {v.pieces[i]: i for i in normal}
        for i in normal:  # single characters of pieces that aren't pieces themselves still take part in merges
            for c in v.pieces[i]:
                symbol.setdefault(c, n + len(symbol))
        order = sorted({v.scores[i] for i in normal}, reverse=True)
        rank_of = {s: k for k, s in enumerate(order)}
        self.size = max(symbol.values()) + 1
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i in normal:
            p = v.pieces[i]
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    rows.setdefault(a, []).append((b, rank_of[v.scores[i]], i))
        # row displacement: entry (a, b) lies at shift[a] + b, and no two entries share a place; the table is
        # sparse, so that a random shift soon fits, and the longest rows are placed first
        rank = np.full(n, NONE, np.int32)
        for i in normal:
            rank[i] = rank_of[v.scores[i]]
        self.rank_of = rank
        room = 12 * sum(map(len, rows.values()))
        draw, at = np.random.default_rng(0).integers(0, room, 1 << 16).tolist(), 0
        self.shift = np.zeros(self.size + 1, np.int32)
        owner = [-1] * (room + self.size + 1)
        made = [0] * len(owner)
        for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
            while any(owner[draw[at] + b] >= 0 for b, _, _ in row):
                at = (at + 1) % len(draw)
            self.shift[a] = draw[at]
            for b, _, i in row:
                owner[draw[at] + b], made[draw[at] + b] = a, i
        self.owner, self.made = np.array(owner, np.int32), np.array(made, np.int32)
        # ranks that can be merged at once: a pair with a piece of theirs never ranks as well
        self.at_once = np.ones(len(order), bool)
        for a, row in rows.items():
            for b, r, _ in row:
                for x in (a, b):
                    if x < n and r <= rank[x]:
                        self.at_once[rank[x]] = False
        self.of_char = np.arange(0x110000, dtype=np.int32) + OUTSIDE
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.next_to = np.zeros(1 << 22, bool)
        for i in normal:
            c = self.of_char[np.frombuffer(v.pieces[i].encode("utf-32-le"), np.uint32)]
            self.next_to[self._bigrams(c[:-1], c[1:])] = True
        self.char_of = {i: p for p, i in symbol.items() if i >= n}
        self.run, self.least_run = self._blank_run()
        self.byte_id = [0] * 256
        for i in range(n):
            if v.bytes[i]:
                self.byte_id[int(v.pieces[i][3:5], 16)] = i
        text = [b"" if v.special[i] else bytes([int(v.pieces[i][3:5], 16)]) if v.bytes[i] else v.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        text[v.unknown] = " ⁇ ".encode()
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_n = np.array([len(x) for x in text], np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(self.text_n)[:-1]])

    def _blank_run(self) -> tuple[int, int]:
        """(size of the longest piece of blanks, blanks from which on a run begins with it); a size of 0: that doesn't hold.

        Blanks are merged last and from the left, so what is behind a run changes no more of it than the blanks that a piece
        with other characters begins with.  A run is tried at all lengths of one period; longer ones repeat it.
        """
        blanks = {len(p): i for i, p in enumerate(self.v.pieces) if p and not p.strip(SPACE)}
        led = max((len(p) - len(p.lstrip(SPACE)) for p in self.v.pieces if p.strip(SPACE)), default=0)
        size = max(blanks, default=0)
        least = 2 * size + led + 1
        if size < 2 or not all(self.rank_of[i] == self.rank_of.max(where=self.rank_of < NONE, initial=-1) for n, i in blanks.items() if n > 1):
            return 0, 0
        runs = [SPACE * n for n in range(least, least + 2 * size)]
        flat, unit = self.merged(runs)
        ids = [flat[unit == k].tolist() for k in range(len(runs))]
        holds = all(ids[k + size] == [blanks[size], *ids[k]] and ids[k][0] == blanks[size] for k in range(size)) and self.merged([SPACE * size])[0].tolist() == [blanks[size]]
        return (size, least) if holds else (0, 0)

    def cut(self, unit: str) -> list[str]:
        """A unit, or the pieces of blanks that it begins with and what is left, when it begins with a long run."""
        n = len(unit) - len(unit.lstrip(SPACE))
        if not self.run or n < self.least_run + self.run:
            return [unit]
        times = (n - self.least_run) // self.run
        return [SPACE * self.run] * times + [unit[times * self.run :]]

    def _bigrams(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs of characters in a table; different pairs can share one."""
        return ((left.astype(np.int64) * 0x9E3779B1 + right) * 0x85EBCA6B >> 9) & ((1 << 22) - 1)

    def merged(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of all units after all merges, and the unit of each."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        flat = self.of_char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        unit = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
        if not len(flat):
            return flat, unit
        # the words that are merged apart, and the unit of each
        new = np.append(True, (unit[1:] != unit[:-1]) | ~self.next_to[self._bigrams(flat[:-1], flat[1:])])
        unit_of, word = unit[new], (np.cumsum(new) - 1).astype(np.int32)
        done_s, done_w = [], []
        while len(flat):
            left = np.minimum(flat[:-1], self.size)
            place = self.shift[left] + np.minimum(flat[1:], self.size)
            same = (self.owner[place] == left) & (word[:-1] == word[1:])
            rank = np.full(len(flat), NONE, np.int32)
            rank[:-1][same] = self.rank_of[self.made[place[same]]]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(first, len(flat)))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = least == NONE
            if over.any():
                done_s.append(flat[over])
                done_w.append(word[over])
            hits = np.flatnonzero((rank == least) & ~over)
            if len(hits):
                # of overlapping pairs every other one, from the left
                k = np.arange(len(hits))
                head = np.maximum.accumulate(np.where(np.append(True, hits[1:] != hits[:-1] + 1), k, 0))
                leftmost = np.append(True, word[hits[1:]] != word[hits[:-1]])
                hits = hits[leftmost | (self.at_once[rank[hits]] & ((k - head) % 2 == 0))]
            flat[hits] = self.made[place[hits]]
            stay = ~over
            stay[hits + 1] = False
            flat, word = flat[stay], word[stay]
        flat, word = np.concatenate(done_s), np.concatenate(done_w)
        by = np.argsort(word, kind="stable")
        return flat[by], unit_of[word[by]]

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all units, and the number of ids of each."""
        flat, unit = self.merged(units)
        odd = np.flatnonzero(flat >= len(self.v.pieces))
        if len(odd):
            spelt = [[self.byte_id[b] for b in (self.char_of.get(s) or chr(s - OUTSIDE)).encode("utf-8", "replace")] for s in flat[odd].tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = [len(x) for x in spelt]
            starts = np.concatenate([[0], np.cumsum(times)[:-1]])
            flat, unit = np.repeat(flat, times), np.repeat(unit, times)
            for x, ids in zip(starts[odd].tolist(), spelt, strict=True):
                flat[x : x + len(ids)] = ids
        return flat, np.bincount(unit, minlength=len(units))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of whole texts, without begin and end, and where each text's ids start (one place more)."""
        # a token stands for its unit: after "\0" as it is, else with the space symbol before it
        lists = pc.split_pattern(pa.array([_tokens(t or "", self.cut) for t in texts], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        units = [t[1:] if t[:1] == "\0" else SPACE + t for t in coded.dictionary.to_pylist()]
        ids, counts = self.units(units)
        at, index = np.concatenate([[0], np.cumsum(counts)]), coded.indices.to_numpy()
        n = counts[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(at[index] - ends[:-1], n) + np.arange(ends[-1])].astype(np.int32)
        return flat, ends[lists.offsets.to_numpy()]

    def decode_bytes(self, flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each list of ids; byte pieces that aren't UTF-8 become U+FFFD, one for each byte."""
        n = self.text_n[flat]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = self.text[np.repeat(self.text_at[flat] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets].tolist()
        out = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            led = b > a and raw[a] == 32
            if led:  # a blank that encoding put first; not one of the unknown piece
                i = offsets[k] + int(np.argmax(n[offsets[k] : offsets[k + 1]] > 0))
                led = flat[i] != self.v.unknown
            part = raw[a + led : b]
            try:
                part.decode()
            except UnicodeDecodeError:
                part = part.decode("utf-8", "spell_out").encode()
            out.append(part)
        return out


def _spell_out(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


def _tokens(text: str, cut: Callable[[str], list[str]]) -> str:
    import codecs

    codecs.register_error("spell_out", _spell_out)
    if not text:
        return "\0"
    if "  " in text or text[0] == " " or SPACE in text or "\0" in text:
        return " ".join("\0" + x for u in UNITS.findall((SPACE + text).replace(" ", SPACE)) for x in cut(u))
    return text.replace("\n", " \0\n \0") if "\n" in text else text


_codecs: dict[int, Codec] = {}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def codec(sent) -> Codec:
    """The worker's tables for a broadcast Vocabulary."""
    if sent.id not in _codecs:
        _codecs.clear()
        _codecs[sent.id] = Codec(sent.value)
    return _codecs[sent.id]


class _Sent:
    """A broadcast with a name that workers can keep their tables under."""

    def __init__(self, spark, v: Vocabulary):
        self.id, self.broadcast = hashlib.sha256("\0".join(v.pieces).encode()).hexdigest(), spark.sparkContext.broadcast(v)

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def send(df: DataFrame, path: str) -> _Sent:
    return _Sent(df.sparkSession, vocabulary(path))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", bounds: bool = True) -> DataFrame:
    """``df`` with the ids of every whole text (array<int>), begin and end ids included if ``bounds``."""
    sent = send(df, path)

    def work(texts: pa.StringArray) -> list[pa.Array]:
        c = codec(sent)
        flat, at = c.encode(texts.to_pylist())
        if bounds:
            at2 = at + 2 * np.arange(len(at))
            full = np.empty(len(flat) + 2 * (len(at) - 1), np.int32)
            full[at2[:-1]], full[at2[1:] - 1] = c.v.begin, c.v.end
            inner = np.ones(len(full), bool)
            inner[at2[:-1]] = inner[at2[1:] - 1] = False
            full[inner] = flat
            flat, at = full, at2
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))]

    return append_columns(df, text, f"{ids} array<int>", work, SLICE)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of every list of ids; a null list gives an empty text."""
    sent = send(df, path)
    from pyspark.sql import types as T

    kept = df.select(*[f"`{c}`" for c in df.columns if c != text])
    at = kept.columns.index(ids)

    def run(batches):
        for b in batches:
            rows = [x or [] for x in b.column(at).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])
            flat = np.fromiter((i for x in rows for i in x), np.int64, int(offsets[-1]))
            out = codec(sent).decode_bytes(flat, offsets)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.decode() for x in out], pa.string())], names=[*b.schema.names, text])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(df: DataFrame, path: str, text: str = "text", with_text: bool = False) -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of every whole text, and the decoded text if asked for.

    Encoding and decoding happen where the text is, so the ids needn't leave the worker.
    """
    sent = send(df, path)
    new = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * with_text

    def work(texts: pa.StringArray) -> list[pa.Array]:
        c = codec(sent)
        flat, at = c.encode(texts.to_pylist())
        begin, end = (np.uint32(x).tobytes() for x in (c.v.begin, c.v.end))
        raw, cuts = flat.astype("<u4").tobytes(), (4 * at).tolist()
        digests = [hashlib.sha256(b"".join((begin, raw[a:b], end))).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
        decoded = c.decode_bytes(flat, at)
        made = [pa.array(np.diff(at) + 2, pa.int64()), pa.array(digests), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
        return made + [pa.array([x.decode() for x in decoded], pa.string())] * with_text

    return append_columns(df, text, new, work, SLICE)
