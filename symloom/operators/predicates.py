"""Row predicates with the graph's three-valued rules, and deterministic top-k."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def false_or_null(c: str) -> Column:
    """False or unknown counts as false."""
    return ~F.coalesce(F.col(c), F.lit(False))


def known_false(c: str) -> Column:
    """Unknown is dropped."""
    return F.col(c) == F.lit(False)


def named(target: str, name: str = "name", qualified: str = "qualified_name") -> Column:
    """The bare name, or any part of the qualified name."""
    return (F.col(name) == target) | F.col(qualified).contains(target)


def in_file(paths: Iterable[str], file: str = "file") -> Column:
    """The file ends with one of the paths; a leading slash does not count."""
    hit = F.lit(False)
    for p in paths:
        hit = hit | F.col(file).endswith(p.lstrip("/"))
    return hit


def not_public(c: str = "visibility") -> Column:
    return (F.col(c) != "pub") & ~F.col(c).startswith("pub(")


def narrowed(df: DataFrame, *, crate: str | None = None, exclude_public: bool = False, exclude_tests: bool = False) -> DataFrame:
    """The optional filters that reports share."""
    if crate is not None:
        df = df.filter(F.col("crate") == crate)
    if exclude_public:
        df = df.filter(F.col("visibility") != "pub")
    if exclude_tests:
        df = df.filter(known_false("is_test"))
    return df


def topk(df: DataFrame, order: list[Column], unique: list[str], k: int | None) -> DataFrame:
    """Ordered, with a unique key as the last tiebreak, so the cut is the same on every run."""
    ordered = df.orderBy(*order, *[F.col(u) for u in unique])
    return ordered if k is None else ordered.limit(k)
