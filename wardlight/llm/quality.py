"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are pairs of neighbouring character classes (letters, capitals, digits, blanks, line ends, and each
mark by itself) and a few classes of how much its words and lines repeat.  Terms are weighted by their rarity and
projected on the leading singular vectors of a bounded sample of labelled documents.  The sample's vectors are
broadcast; a block of documents is multiplied with all of them, and the most similar vote with the power of their
cosine.  The search is exact.

Cases.  Null and empty texts have the terms of an empty text and a score like any other.  Rows whose label is null
aren't learned from; several labels of a document count as their mean.  Without any labelled row the score is 0.5.
Of several texts of one id the least is learned from.
Repeated rows get equal scores.  Ties among neighbours (cosines equal to six places) go to the earlier of the sample,
which is ordered by a hash of the id.  Where no neighbour resembles a text its score is the neighbours' mean label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, slices

_CLASS = np.zeros(256, np.int32)
_CLASS[128:] = 1
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 13]] = 5
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_MARKS] = np.arange(6, 6 + len(_MARKS))
CLASSES = 6 + len(_MARKS)
STEPS = 16
#: Terms on repetition: words that are new in the text, neighbours that are equal, lines that are new, words a line.
SHARES = 5
TERMS = CLASSES * CLASSES + SHARES * STEPS


def terms(texts: list[str | None]) -> np.ndarray:
    """A row a text, a column a term."""
    out = np.zeros((len(texts), TERMS), np.float32)
    pairs = CLASSES * CLASSES
    for row, text in zip(out, texts, strict=True):
        raw = (text or "").encode("utf-8", "replace")
        c = _CLASS[np.frombuffer(raw, np.uint8)]
        if len(c) > 1:
            row[:pairs] = np.sqrt(np.bincount(c[:-1] * CLASSES + c[1:], minlength=pairs) / (len(c) - 1))
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        n = max(1, len(words))
        new = len(set(words))
        shares = (
            new / n,
            math.log1p(new) / math.log1p(n),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            len(set(lines)) / max(1, len(lines)),
            min(1.0, math.log1p(n) / 10),
        )
        for k, x in enumerate(shares):
            at = x * (STEPS - 1)
            low = int(at)
            row[pairs + k * STEPS + low] = 0.5 * (1 - (at - low))
            if low + 1 < STEPS:
                row[pairs + k * STEPS + low + 1] = 0.5 * (at - low)
    return out


@dataclass
class Model:
    rarity: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray  # unit rows
    labels: np.ndarray
    neighbours: int
    power: float

    def project(self, t: np.ndarray) -> np.ndarray:
        v = (t * self.rarity - self.mean) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        for i in range(0, len(texts), block):
            cosine = np.round(self.project(terms(texts[i : i + block])) @ self.vectors.T, 6).astype(np.float64)
            last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k, None]
            above, equal = cosine > last, cosine == last
            spare = k - above.sum(1, keepdims=True)
            near = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= spare)))[1].reshape(-1, k)
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** self.power
            out[i : i + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def fit(t: np.ndarray, labels: list[float], axes: int = 48, neighbours: int = 25, power: float = 8.0) -> Model:
    """A model of the rows of ``t`` (as terms() gives them) and their labels."""
    if not len(t):
        z = np.zeros((0, axes), np.float32)
        return Model(np.ones(TERMS, np.float32), np.zeros(TERMS, np.float32), np.zeros((TERMS, axes), np.float32), z, np.zeros(0), neighbours, power)
    rarity = np.log((1 + len(t)) / (1 + (t > 0).sum(0))).astype(np.float32) + 1
    t = t * rarity
    mean = t.mean(0)
    t -= mean
    _, vectors = np.linalg.eigh(t.T @ t)  # right singular vectors of the centred terms
    kept = np.ascontiguousarray(vectors[:, ::-1][:, :axes])
    v = t @ kept
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return Model(rarity, mean, kept, v, np.asarray(labels, float), neighbours, power)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", among: Column | None = None, sample: int = 5000, **how) -> Model:
    """Fits on about ``sample`` labelled rows at most, those with the least hash of their id; only their terms, a fixed
    number of bytes a row, reach the driver."""
    own = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("double").alias("y")).where(F.col(label).isNotNull())
    own = own.where(F.lit(True) if among is None else among).groupBy("i").agg(F.avg("y").alias("y"))
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    n = own.count()
    drawn = own.where(draw < sample / max(1, n)).select("i", "y", draw.alias("draw"))  # so its size has a bound
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(drawn), "i").groupBy("i", "y", "draw").agg(F.min("t").alias("t"))
    found = rows.select("draw", F.xxhash64("i").alias("mark"), "y", "t").mapInArrow(_terms, "draw double, mark long, y double, v binary").toArrow().sort_by([("draw", "ascending"), ("mark", "ascending")])
    t = np.frombuffer(b"".join(found["v"].to_pylist()), np.float32).reshape(-1, TERMS)
    return fit(t, found["y"].to_pylist(), **how)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "t", rows=256):
        made = pa.array([row.tobytes() for row in terms(part.column(3).to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*part.columns[:3], made], names=["draw", "mark", "y", "v"])


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the score of every whole text: 0 to 1, higher if label 1 is likelier."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return append_columns(df, text, f"{name} double", lambda texts: [pa.array(sent.value.score(texts.to_pylist()))])
