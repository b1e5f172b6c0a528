"""Language identification with unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary.  The probability of a word is the
sum over all its segmentations into pieces, computed by the forward algorithm; a text's is the product over its
words.  Words are the runs of letters of the lower-cased text, with a space symbol in front.  Training is
expectation-maximisation (forward-backward over the distinct words, all of them, in tasks) on a bounded sample: at most
about ``per_lang`` labelled documents a language, chosen by a hash of id and text.  Only expected counts reach the driver:
a number for each language and piece.

Cases.  Texts that are null, empty or without a letter are "und" with score 0.  Rows without a language aren't
learned from.  Repeated rows get equal answers.  Letters that no piece has cost a fixed small probability in every
language.  Equal likelihoods go to the language that comes first in order.  With no labelled row every text is "und"; more
than ``most_langs`` languages raise an error, as the model is as wide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, cut, slices

SPACE = "▁"
OTHER = 1e-7
#: Bytes of text that are scored together; a longer text alone.
SLICE = 2_000_000
NOT_LETTERS = r"[^\pL\pM]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    probs: np.ndarray  # a row a piece, a column a language

    @property
    def name(self) -> str:
        return hashlib.sha256(repr(self.langs).encode() + self.probs.tobytes()).hexdigest()


def vocabulary(path: str) -> list[str]:
    """Pieces of letters (a space symbol may lead), lower-cased and distinct."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    all_pieces = {m.id_to_piece(i).lower() for i in range(m.get_piece_size()) if not m.is_byte(i) and not m.is_control(i) and not m.is_unknown(i)}
    return sorted(p for p in all_pieces if (p.lstrip(SPACE).isalpha() or p == SPACE) and SPACE not in p[1:])


class Lattice:
    """Finds the pieces that start at a place of many words at once, by hashes of pieces and of their beginnings."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        made: dict[int, int] = {}  # hash of a piece: its number; of a beginning only: -2
        mix, whole = int(MIX), (1 << 64) - 1
        for i, p in enumerate(pieces):
            h = 0
            for k, c in enumerate(p):
                h = ((h ^ ord(c)) * mix) & whole
                if k == len(p) - 1:
                    made[h] = i
                else:
                    made.setdefault(h, -2)
        bits = 20
        while 1 << bits < 8 * len(made):
            bits += 1
        size = 1 << bits
        self.slot, self.key = np.full(size, -1, np.int32), np.zeros(size, np.uint64)
        self.bits, self.probes = np.uint64(64 - bits), 1
        for h in sorted(made):
            at, probe = h >> (64 - bits), 1
            while self.slot[at] != -1:
                at, probe = (at + 1) % size, probe + 1
            self.slot[at], self.key[at] = made[h], h
            self.probes = max(self.probes, probe)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash, -2 for the beginning of one, -1 for neither."""
        at = (hashes >> self.bits).astype(np.int64)
        found = np.where(self.key[at] == hashes, self.slot[at], -1)
        for k in range(1, self.probes):
            near = (at + k) % len(self.slot)
            found = np.where((found == -1) & (self.key[near] == hashes), self.slot[near], found)
        return found

    def starting(self, chars: np.ndarray, i: int):
        """(length, rows, pieces) of the pieces from place ``i`` on, and (1, rows, -1) for rows whose letter is none.

        chars: a row a word, all of one length.
        """
        rows, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for k in range(i, chars.shape[1]):
            h = (h ^ chars[rows, k].astype(np.uint64)) * MIX
            found = self.find(h)
            if k == i:
                yield 1, rows, np.maximum(found, -1)
            else:
                on = found >= 0
                if on.any():
                    yield k - i + 1, rows[on], found[on]
            on = found != -1
            rows, h = rows[on], h[on]
            if not len(rows):
                return


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def _by_length(words: list[str], most: int = 8_000):
    """(indices, chars) of words of one length, in blocks."""
    chars, lengths = _code_points(words)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if len(group) and lengths[group[0]]:
            width = int(lengths[group[0]])
            step = max(1, most * 12 // max(12, width))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                yield part, chars[starts[part][:, None] + np.arange(width)]


def forward(lattice: Lattice, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language, over all segmentations.  Scaled on the way."""
    padded = np.vstack([probs, np.full((1, probs.shape[1]), OTHER)])  # the last row is no piece
    out = np.zeros((len(words), probs.shape[1]))
    for part, chars in _by_length(words):
        rows, width = chars.shape
        scale, alpha = np.zeros((rows, probs.shape[1])), np.ones((rows, probs.shape[1]))
        ahead: dict[int, np.ndarray] = {}
        for i in range(width):
            for n, own, found in lattice.starting(chars, i):
                if n == 1:
                    step = alpha * padded[found]
                    ahead[i + 1] = ahead[i + 1] + step if i + 1 in ahead else step
                else:
                    if i + n not in ahead:
                        ahead[i + n] = np.zeros_like(alpha)
                    ahead[i + n][own] += alpha[own] * padded[found]
            alpha = ahead.pop(i + 1)
            # what is kept of the next places is scaled together, so that long words don't underflow
            if i % 4 == 3 or i == width - 1:
                low = np.maximum(alpha, 1e-300)
                scale += np.log(low)
                alpha = alpha / low
                ahead = {k: v / low for k, v in ahead.items()}
        out[part] = scale
    return out


def posterior_counts(lattice: Lattice, probs: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected number of each piece, weighted by a word's count; ``probs`` and ``weights`` of one language."""
    counts = np.zeros(lattice.n)
    logs = np.log(np.append(np.maximum(probs, 1e-300), OTHER))
    for part, chars in _by_length(words):
        rows, width = chars.shape
        arcs = [list(lattice.starting(chars, i)) for i in range(width)]
        alpha, beta = np.full((width + 1, rows), -np.inf), np.full((width + 1, rows), -np.inf)
        alpha[0] = beta[width] = 0
        for i in range(width):
            for n, own, found in arcs[i]:
                alpha[i + n][own] = np.logaddexp(alpha[i + n][own], alpha[i][own] + logs[found])
        for i in reversed(range(width)):
            for n, own, found in arcs[i]:
                beta[i][own] = np.logaddexp(beta[i][own], beta[i + n][own] + logs[found])
        for i in range(width):
            for n, own, found in arcs[i]:
                on = found >= 0
                own, found = own[on], found[on]
                share = np.exp(alpha[i][own] + logs[found] + beta[i + n][own] - alpha[width][own])
                counts += np.bincount(found, share * weights[part[own]], lattice.n)
    return counts


def words_of(texts: pa.Array) -> pa.ListArray:
    """The letter runs of each text, lower-cased; an empty list where there is none."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NOT_LETTERS, " "), " ")
    return pc.split_pattern(plain, " ")


def train(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", among: Column | None = None, per_lang: int = 600, rounds: int = 2, most_langs: int = 1000) -> Model:
    """Learns from whole texts of the rows ``among`` that have a language: about ``per_lang`` documents of each.

    The sample is what a hash of id and text puts below per_lang / n of the language's n rows, so its expected size
    has that bound whatever the input's size.
    """
    rows = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(F.col(lang).isNotNull() & (F.lit(True) if among is None else among))
    n = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(most_langs + 1).collect()}
    if len(n) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not n:
        return Model([], [], np.zeros((0, 0)))
    langs, pieces = sorted(n), vocabulary(path)
    share = F.get(F.array(*[F.lit(per_lang / n[x]) for x in langs]), F.array_position(F.array(*map(F.lit, langs)), F.col("l")).cast("int") - 1)
    draw = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) / float(1 << 30)
    spark = df.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = rows.where(draw < share).select("l", "t").mapInArrow(_counted, "l string, w string, n long")
    seen = cut(seen.groupBy("l", "w").agg(F.sum("n").alias("n")).repartition(parts, "w"))
    probs = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((langs, pieces, probs))
        counts = np.zeros_like(probs)
        found = seen.mapInArrow(_expected(sent), "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts[found["piece"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
        probs = (counts + 0.05) / (counts + 0.05).sum(0)
        sent.destroy()
    return Model(langs, pieces, probs)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Languages and texts to the number of each word, a slice at a time."""
    for part in slices(batches, "t", SLICE):
        lists = words_of(part.column(1))
        lang = part.column(0).take(pc.list_parent_indices(lists))
        found = pa.table({"l": lang, "w": lists.flatten()}).group_by(["l", "w"]).aggregate([([], "count_all")])
        found = found.filter(pc.not_equal(found["w"], "")).combine_chunks()
        yield from found.select(["l", "w", "count_all"]).rename_columns(["l", "w", "n"]).cast(pa.schema([("l", pa.string()), ("w", pa.string()), ("n", pa.int64())])).to_batches()


def _expected(sent):
    """Counted words to expected numbers of pieces under the probabilities sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, probs = sent.value
        lattice, total = None, np.zeros_like(probs)
        for b in batches:
            lattice = lattice or Lattice(pieces)
            own, words, n = np.array(b.column(0).to_pylist(), object), np.array(b.column(1).to_pylist(), object), b.column(2).to_numpy()
            for k, x in enumerate(langs):
                at = np.flatnonzero(own == x)
                if len(at):
                    total[:, k] += posterior_counts(lattice, probs[:, k], [SPACE + w for w in words[at]], n[at].astype(float))
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, k])], names=["k", "piece", "n"])

    return run


_lattices: dict[str, Lattice] = {}


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (the language's share of the likelihood, by letter-weighted evidence)."""
    sent, name = df.sparkSession.sparkContext.broadcast(model), model.name

    def work(texts: pa.StringArray) -> list[pa.Array]:
        m = sent.value
        lists = words_of(texts)
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if not m.langs:
            return [pa.array(["und"] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]
        if name not in _lattices:
            _lattices.clear()
            _lattices[name] = Lattice(m.pieces)
        of_word = forward(_lattices[name], m.probs, [SPACE + w if w else "" for w in words])
        has = np.array([bool(w) and any(c.isalpha() for c in w) for w in words], bool)
        index, at = coded.indices.to_numpy(), lists.offsets.to_numpy()
        n_words = np.diff(at)
        doc = np.repeat(np.arange(len(texts)), n_words)
        logs = np.stack([np.bincount(doc, of_word[index, k], len(texts)) for k in range(len(m.langs))], 1)
        letters = np.bincount(doc, has[index], len(texts)) > 0
        best = logs.argmax(1)
        share = np.exp(np.minimum(logs - logs.max(1, keepdims=True), 0))
        score = 1 / share.sum(1)
        pred = [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return [pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0))]

    return append_columns(df, text, "lang_pred string, score double", work, SLICE)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
