"""Substring search in names by an inverted index of three-letter pieces with their places.

A posting is (gram, at, id): the up to three characters of a qualified name from ``at`` on, and with ``at`` = 0 the whole bare name. Pieces that cover a target stand at fixed
distances where the name holds the target and nowhere else, so places decide without reading a name. A target of one or two characters is the beginning of a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.resolve import grown
from symloom.sources import clustered

GRAM = 3


def postings(functions: DataFrame) -> DataFrame:
    """(gram, at, id) of the functions' names; unknown names have none."""
    q = F.col("qualified_name")
    parts = functions.filter(F.length(q) > 0).select("id", q.alias("q"), F.explode(F.sequence(F.lit(1), F.length(q))).alias("at"))
    whole = functions.filter("name is not null").select(F.col("name").alias("gram"), F.lit(0).alias("at"), "id")
    return parts.select(F.substr("q", "at", F.lit(GRAM)).alias("gram"), "at", "id").unionByName(whole)


def cover(target: str) -> list[tuple[str, int]]:
    """The pieces, with their places, that lie end to end over a target of three characters or more."""
    last = len(target) - GRAM
    return [(target[k : k + GRAM], k) for k in sorted({*range(0, last + 1, GRAM), last})]


def write_index(functions: DataFrame, path: str, *, files: int = 64) -> None:
    """Postings in ranges of pieces; a common piece's postings lie in several files, by id."""
    clustered.write(postings(functions), path, "gram", "id", files=files)


def find(spark: SparkSession, path: str, target: str) -> DataFrame:
    """id of the functions whose name is the target or whose qualified name holds it; only the target's postings are read. Every function of a known name has the empty target."""
    if not target:
        return spark.read.parquet(path).select("id").distinct()
    if len(target) < GRAM:
        rows = clustered.read(spark, path, "gram", [target], prefixes=(target,))
        return rows.filter((F.col("at") > 0) | (F.col("gram") == target)).select("id").distinct()
    pieces = cover(target)
    rows = clustered.read(spark, path, "gram", [target, *{g for g, _ in pieces}])
    places = F.filter(F.array(*[F.when(F.col("gram") == g, F.lit(k)) for g, k in pieces]), lambda k: k.isNotNull())
    held = rows.filter("at > 0").select("id", "at", F.explode(places).alias("k")).groupBy("id", F.col("at") - F.col("k")).agg(F.count("*").alias("n")).filter(F.col("n") == len(pieces))
    return held.select("id").union(rows.filter((F.col("at") == 0) & (F.col("gram") == target)).select("id")).distinct()


def find_all(index: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id) for a table of targets, by joins with the postings; targets that are null or empty are left out."""
    t = targets.select("target").filter(F.length("target") > 0).distinct()
    long, last = t.filter(F.length("target") >= GRAM), F.length("target") - GRAM
    steps = long.select("target", F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(GRAM)), F.array(last))).alias("ks"))
    pieces = steps.select("target", F.size("ks").alias("all"), F.explode("ks").alias("k")).withColumn("gram", F.substr("target", F.col("k") + 1, F.lit(GRAM)))
    held = index.filter("at > 0").join(grown(pieces), "gram").groupBy("target", "all", "id", (F.col("at") - F.col("k")).alias("start")).agg(F.count("*").alias("n")).filter("n = all").select("target", "id")
    out = held.union(index.filter("at = 0").join(grown(t), F.col("gram") == F.col("target")).select("target", "id"))
    for n in range(1, GRAM):
        short = index.filter((F.col("at") > 0) & (F.length("gram") >= n)).withColumn("target", F.left("gram", F.lit(n)))
        out = out.union(short.join(grown(t.filter(F.length("target") == n)), "target").select("target", "id"))
    return out.distinct()
