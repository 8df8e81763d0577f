"""Hierarchical language identification.

A text is a vector of hashed character one- to three-grams over its lower-cased letters (runs of anything else are one
blank), log-scaled and of unit length. A softmax classifier first names the language family; within a family, one linear
support vector machine for each pair of languages votes, margins break ties. Families are a fixed table of ISO codes;
a language that is not in it is a family of its own.

Learning reads at most ``most`` documents of each language, chosen by a hash of doc_id and alike on every run. Prediction
reads only the text, whole. Null texts and texts without a letter get ``und`` and score 0. Repeated rows get the same
answer; with no labelled rows all texts get ``und``. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import map_rows
from symloom.llm.quality import fold_of

# Language families by ISO 639-1 code.
FAMILIES = {
    "romance": "fr es it pt ro ca gl",
    "germanic": "en de nl sv da no nb nn is af",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "indic": "hi mr ne bn pa gu ur",
    "turkic": "tr az kk uz ky tt",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "semitic": "ar he mt am",
    "sinitic": "zh",
    "iranian": "fa ps ku",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
WIDTH = 1 << 14
_LETTER = np.zeros(0x110000, bool)
_LOWER = np.arange(0x110000, dtype=np.uint32)


def _tables() -> None:
    if not _LETTER[ord("a")]:
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            if ch.isalpha():
                _LETTER[c] = True
                low = ch.lower()
                if len(low) == 1:
                    _LOWER[c] = ord(low)


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, whether a text has a letter)."""
    _tables()
    out = np.zeros((len(texts), WIDTH), np.float32)
    has = np.zeros(len(texts), bool)
    for k, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        letter = _LETTER[codes]
        if not letter.any():
            continue
        has[k] = True
        c = np.where(letter, _LOWER[codes], np.uint32(32))
        c = c[np.concatenate(([True], letter[1:] | letter[:-1]))]  # runs of non-letters are one blank
        c = np.concatenate(([32], c, [32])).astype(np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
        grams = np.concatenate((c * np.uint32(0xC2B2AE3D), two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)))
        counts = np.bincount(grams >> np.uint32(18), minlength=WIDTH).astype(np.float32)
        v = np.log1p(counts)
        out[k] = v / np.linalg.norm(v)
    return out, has


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    family_w: np.ndarray | None = None
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def members(self, family: str) -> list[str]:
        return [x for x in self.langs if FAMILY_OF.get(x, x) == family]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        x, has = vectors(texts)
        z = x @ self.family_w[:-1] + self.family_w[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for f, family in enumerate(self.families):
            rows = np.flatnonzero((best == f) & has)
            own = self.members(family)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(own)))
            margin = np.zeros((len(rows), len(own)))
            for i, a in enumerate(own):
                for j in range(i + 1, len(own)):
                    w = self.pairs[a, own[j]]
                    m = x[rows] @ w[:-1] + w[-1]
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    margin[:, i] += m
                    margin[:, j] -= m
            pick = (votes + 1e-3 * np.tanh(margin)).argmax(1)
            lang[rows] = np.array(own, object)[pick]
            sure = 1 / (1 + np.exp(-4 * margin[np.arange(len(rows)), pick] / max(1, len(own) - 1))) if len(own) > 1 else np.ones(len(rows))
            score[rows] = p[rows, f] * sure
        return lang.tolist(), np.clip(score, 0, 1)


def svm(x: np.ndarray, y: np.ndarray, *, c: float = 1e-4, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Linear SVM (hinge loss, L2) by averaged stochastic subgradients in small batches; y is 1 or -1."""
    rng = np.random.default_rng(seed)
    w, mean, t = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32), 0
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            k = order[at : at + 32]
            t += 1
            xk = x[k]
            bad = (y[k] * (xk @ w[:-1] + w[-1]) < 1) * weight[k] * y[k]
            rate = np.float32(4 / (1 + 0.02 * t))
            w[:-1] += rate * (bad @ xk / np.float32(len(k)) - np.float32(c) * w[:-1])
            w[-1] += np.float32(0.1) * rate * bad.mean()
            mean += (w - mean) / np.float32(t)
    return mean


def softmax(x: np.ndarray, y: np.ndarray, n: int, *, epochs: int = 15, seed: int = 5) -> np.ndarray:
    """Multinomial logistic regression by small batches; every class weighs the same."""
    rng = np.random.default_rng(seed)
    w = np.zeros((x.shape[1] + 1, n), np.float32)
    one = np.eye(n, dtype=np.float32)[y]
    weight = (len(y) / n / np.maximum(1, np.bincount(y, minlength=n)))[y].astype(np.float32)
    for e in range(epochs if n > 1 else 0):
        order = rng.permutation(len(y))
        rate = np.float32(20 / (1 + e))
        for at in range(0, len(y), 64):
            k = order[at : at + 64]
            xk = x[k]
            z = xk @ w[:-1] + w[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - one[k]) * weight[k][:, None] / np.float32(len(k))
            w[:-1] -= rate * (xk.T @ g)
            w[-1] -= np.float32(0.1) * rate * g.sum(0)
    return w


def fit(docs: DataFrame, *, most: int = 500) -> Model:
    """Learns from rows outside the held-out fold. ``most`` bounds the documents read for each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), 5) != 0))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return Model([], [])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * most / n))])[F.col("lang")], F.lit(0.0))
    near = known.select("doc_id", "lang", "text", unit.alias("unit")).filter(F.col("unit") < share)
    first = Window.partitionBy("lang").orderBy("unit", "doc_id")  # at most about 1.5 ``most`` rows of a language
    rows = near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most).select("doc_id", "lang", "text")
    got = rows.toPandas().sort_values(["lang", "doc_id"])
    return learn(got["lang"].tolist(), got["text"].tolist())


def learn(langs: list[str], texts: list[str | None]) -> Model:
    x, has = vectors(texts)
    x, langs = x[has], [a for a, h in zip(langs, has, strict=True) if h]
    if not langs:
        return Model([], [])
    names = sorted(set(langs))
    families = sorted({FAMILY_OF.get(a, a) for a in names})
    of = np.array([families.index(FAMILY_OF.get(a, a)) for a in langs])
    model = Model(names, families, softmax(x, of, len(families)))
    lang = np.array(langs)
    for family in families:
        own = model.members(family)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                k = np.flatnonzero((lang == a) | (lang == b))
                model.pairs[a, b] = svm(x[k], np.where(lang[k] == a, 1.0, -1.0))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, for every row; one scan, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors of WIDTH numbers

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        lang, score = [], []
        for at in range(0, len(texts), 256):
            a, b = sent.value.predict(texts[at : at + 256])
            lang += a
            score += b.tolist()
        return {"doc_id": batch.column(0), "lang_pred": lang, "score": score}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double", pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]))
