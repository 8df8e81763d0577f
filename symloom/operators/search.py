"""Embedding rows and brute-force similarity search (JVM higher-order functions; one pass, a top-k, no shuffle but the last merge)."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.text import FUNCTION_FIELDS, TYPE_FIELDS, embedding_text, type_text
from symloom.operators.predicates import topk

#: Vector widths by model; any other model is refused.
WIDTHS = {"hosted": 1536, "local": 384}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def embed_one(text: str, width: int) -> np.ndarray:
    """Characters and words into buckets by code points, weights falling with place, a wave of the text's bytes, unit length."""
    v = np.zeros(width)
    for i, ch in enumerate(text):
        v[ord(ch) % width] += 1 / (i + 1)
    for i, word in enumerate(text.split()):
        v[sum(map(ord, word)) % width] += 0.5 / (i + 1)
    n = len(text.encode())
    v += 0.1 * np.sin(n * np.arange(1, width + 1))
    size = math.sqrt(float(v @ v))
    return v / size if size else v


def embedded(rows: DataFrame, text: str = "text", *, model: str = "local", width: int | None = None) -> DataFrame:
    if width is None and model not in WIDTHS:
        raise ValueError(f"unknown model {model!r}; known are {', '.join(WIDTHS)}")
    n = width or WIDTHS[model]

    @F.pandas_udf("array<double>")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: embed_one(x or "", n))

    return rows.withColumn("embedding", run(text))


def function_rows(functions: DataFrame, fields: Iterable[str] = FUNCTION_FIELDS) -> DataFrame:
    """id, kind, crate, and the text that is embedded, of the configured ``fields``; columns that the table does not have are unknown parts."""
    has = lambda c: F.col(c) if c in functions.columns else None
    types = F.transform("parameters", lambda p: p["type"]) if "parameters" in functions.columns else None
    text = embedding_text(F.col("crate"), F.col("name"), F.col("module"), has("doc"), types, has("return_type"), fields)
    return functions.select("id", F.lit("function").alias("kind"), "crate", text.alias("text"))


def type_rows(types: DataFrame, fields: Iterable[str] = TYPE_FIELDS) -> DataFrame:
    """id, kind, crate, and the text that is embedded, of types."""
    text = type_text(*map(F.col, ("crate", "name", "kind", "module", "doc", "fields", "variants")), fields)
    return types.select("id", F.lit("type").alias("kind"), "crate", text.alias("text"))


def search(rows: DataFrame, query: list[float], *, key: str = "id", k: int = 10, crate: str | None = None) -> DataFrame:
    """The k most similar rows to a query vector, which is one literal."""
    if crate is not None:
        rows = rows.filter(F.col("crate") == crate)
    q = F.array(*[F.lit(float(x)) for x in query])
    return topk(rows.select(key, cosine(F.col("embedding"), q).alias("similarity")), [F.desc("similarity")], [key], k)


def search_text(rows: DataFrame, text: str, *, width: int, k: int = 10, crate: str | None = None) -> DataFrame:
    return search(rows, embed_one(text, width).tolist(), k=k, crate=crate)


def similar(rows: DataFrame, target, *, key: str = "id", k: int = 10) -> DataFrame:  # noqa: ANN001
    """The k rows most similar to one row, itself left out."""
    one = rows.filter(F.col(key) == F.lit(target)).select(F.col("embedding").alias("_q")).limit(1)
    rest = rows.filter(F.col(key) != F.lit(target)).crossJoin(F.broadcast(one))  # one row
    return topk(rest.select(key, cosine(F.col("embedding"), F.col("_q")).alias("similarity")), [F.desc("similarity")], [key], k)
