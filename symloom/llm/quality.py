"""Bradley-Terry quality classifier.

A document's score is a linear utility of features of its whole text: ratios (lengths, character classes, repetition, lines), and two blocks of
hashed counts, of one- to three-byte stretches and of words, each log-scaled and of unit length. The weights are learned from preference pairs (a
document labelled 1 is preferred to one labelled 0) by the logistic loss on feature differences. The threshold is the
quantile of the training utilities at the share of label 0; the utility there is given the probability 0.7, and the
slope comes from the same labels.

The labelled rows that are read for the fit are a sample of at most ``most`` rows, chosen by a hash of doc_id and alike on every run;
everything else covers all rows. A sampled row comes to the driver as its feature vector, whatever the length of its text. Nulls and empty texts have a defined feature vector (all zero but one flag). Repeated
labels of a document all count; rows with a null label or doc_id are not learned from. If only one label occurs (or none), every score is 0.5.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import map_rows, small, worker_words

THRESHOLD = 0.7
NAMES = ("empty", "log_words", "word_length", "upper", "digits", "marks", "odd_marks", "repeats", "runs", "line_repeats", "packed", "short_lines", "shouted", "ends", "open_words")
WIDTH = 512
SIZE = len(NAMES) + 2 * WIDTH
_KIND = np.zeros(256, np.uint8)  # of the bytes of UTF-8: 1 lower, 2 upper, 3 digit, 4 common mark, 5 other mark, 6 blank
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 6 if _c.isspace() else 4 if _c in ".,;:'\"-()?" else 5


def ratios(text: str, raw: bytes, words: list[str]) -> list[float]:
    """The values of NAMES; ``words`` is not empty."""
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    return [
        0.0,
        float(np.log1p(n)) / 10,
        min(2.0, len(text) / n / 10),
        kinds[2] * 5,
        kinds[3] * 5,
        kinds[4] * 5,
        kinds[5] * 5,
        1 - (len(set(zip(words, words[1:], strict=False))) + 1) / n if n > 1 else 0.0,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        min(1.5, len(zlib.compress(raw, 1)) / len(raw)),
        len(lines) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / len(lines),
        len(set(words)) / n,
    ]


def block(buckets: np.ndarray) -> np.ndarray:
    v = np.log1p(np.bincount(buckets, minlength=WIDTH)).astype(np.float32)
    return v / np.linalg.norm(v)


def features(text: str | None) -> np.ndarray:
    """SIZE numbers."""
    out = np.zeros(SIZE, np.float32)
    words = (text or "").split()
    if not words:
        out[0] = 1
        return out
    raw = text.encode("utf-8", "replace")
    one = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = one[:-1] * np.uint32(257) + one[1:]
    three = two[:-1] * np.uint32(263) + one[2:]
    grams = np.concatenate((one * np.uint32(0x9E3779B1), two * np.uint32(0x85EBCA77), three * np.uint32(0xC2B2AE3D))) >> np.uint32(23)
    hashes = np.fromiter(map(worker_words().__getitem__, words), np.uint64, len(words)) >> np.uint64(55)
    at = len(NAMES)
    out[:at] = ratios(text, raw, words)
    out[at : at + WIDTH] = block(grams)
    out[at + WIDTH :] = block(hashes.astype(np.int64))
    return out


@dataclass(frozen=True)
class Model:
    """A model without a slope has learned nothing."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        utility = ((x - self.mean) / self.scale).astype(np.float64) @ self.weights.astype(np.float64)
        z = np.clip(self.slope * (utility - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)
        return 1 / (1 + np.exp(-z))

    def of(self, texts: list[str | None]) -> np.ndarray:
        return self.scores(np.array([features(t) for t in texts], np.float32).reshape(len(texts), SIZE))


UNLEARNED = Model(np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32), np.zeros(SIZE), 0.0, 0.0)


def bradley_terry(x: np.ndarray, label: np.ndarray, *, pairs: int = 20_000, batch: int = 1000, steps: int = 400, decay: float = 1e-3, spread: float = 3.0, seed: int = 7) -> Model:
    """``spread``: how far below the ratios a hashed count stands. ``x`` is used up: it is standardised where it stands."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return UNLEARNED
    mean, scale = x.mean(0), x.std(0) + np.float32(1e-6)
    hashed = slice(len(NAMES), None)
    scale[hashed] = spread * np.sqrt((scale[hashed] ** 2).mean())  # a rare bucket is not blown up
    x -= mean
    x /= scale
    z = x
    rng = np.random.default_rng(seed)
    left, right = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        at = (t - 1) * batch % pairs
        diff = z[left[at : at + batch]] - z[right[at : at + batch]]
        grad = np.float32(decay) * w - (1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))) @ diff / np.float32(len(diff))
        m, v = np.float32(0.9) * m + np.float32(0.1) * grad, np.float32(0.999) * v + np.float32(0.001) * grad**2
        w -= np.float32(0.05 if t < 0.7 * steps else 0.01) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    utility = np.concatenate([z[k : k + 512].astype(np.float64) @ w.astype(np.float64) for k in range(0, len(z), 512)])
    at = float(np.quantile(utility, len(bad) / len(label)))
    apart = max(1e-6, float(np.median(utility[good]) - np.median(utility[bad])))
    return Model(mean, scale, w, at, 8 / apart)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, *, most: int = 8000) -> Model:
    """Learns from labelled documents outside the held-out fold. ``most`` bounds the labelled rows that are used."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(fold_of(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = known.count()
    share = min(1.0, 1.3 * most / max(n, 1))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(unit < share).orderBy(unit, "doc_id", "quality").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``most`` rows of two numbers

    def run(batch: pa.RecordBatch) -> dict:
        return {"quality": batch.column(0), "x": [features(t).tobytes() for t in batch.column(1).to_pylist()]}

    got = map_rows(rows.select("quality", "text"), run, "quality int, x binary", pa.schema([("quality", pa.int32()), ("x", pa.binary())])).toArrow()
    return learned(got)


def learned(got: pa.Table) -> Model:
    """The model of (quality, x) rows in any order. The vectors are held twice at most, and never as an object each: what the driver has freed of small objects does not go back to the system."""
    if not got.num_rows:
        return UNLEARNED
    order = pc.sort_indices(got, [("x", "ascending"), ("quality", "ascending")]).to_numpy()  # the fit does not depend on the order of rows
    place, x, at = np.argsort(order), np.empty((got.num_rows, SIZE), np.float32), 0
    for c in got["x"].cast(pa.binary()).chunks:
        if len(c):
            first, last = np.frombuffer(c.buffers()[1], np.int32)[[c.offset, c.offset + len(c)]]
            x[place[at : at + len(c)]] = np.frombuffer(c.buffers()[2], np.uint8)[first:last].view(np.float32).reshape(len(c), SIZE)
            at += len(c)
    label = got["quality"].to_numpy()[order]
    del got, c
    return bradley_terry(x, label)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, for every row; one scan, no shuffle."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": model.of(batch.column(1).to_pylist())}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, score double", pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the columns they had; all rows where nothing was learned."""
    fields = docs.schema
    at = docs.columns.index("text")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in small(batches):
            yield batch.filter(pa.array(model.of(batch.column(at).to_pylist()) >= threshold)) if model.slope else batch

    return docs.mapInArrow(run, fields)
