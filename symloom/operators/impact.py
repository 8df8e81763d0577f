"""Transitive change impact with edge-unique paths, and its batch, file and diff forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.text import diff_files, diff_functions
from symloom.operators.predicates import in_file, topk
from symloom.sources.tables import scratch


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` from a table in the shared folder, written now: several steps read it."""
    at = scratch(df.sparkSession, kind)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def representative(paths: DataFrame, length: int, more: int) -> DataFrame:
    """Some paths (of ``length`` edges) of each (target, at) that stand for all of them: whatever ``more`` edges are to come, if one path holds none of
    them, so does one that is kept.

    The least of all paths is kept; for each of its edges, the least path without it; for each edge of that, the least path without both;
    and so on, ``more`` times. If a path holds none of the edges to come, then so does one found on the way, because each step bans one
    of them. Sets of banned edges are rows, each set once in whatever order it came about, so at most length ^ more paths are kept, however many there are; the least
    path of a set is an aggregate with a partial one before the shuffle, so a hub sends one path a set from each task.
    """
    key = ["target", "at"]
    kept = got = paths.groupBy(*key).agg(F.min("path").alias("path")).withColumn("banned", F.slice("path", 1, 0))
    for step in range(1, more + 1):
        bans = got.select(*key, "banned", F.explode("path").alias("_edge")).select(*key, F.array_sort(F.array_append("banned", F.col("_edge"))).alias("banned")).distinct()
        got = paths.join(bans, key).filter(~F.arrays_overlap("path", "banned")).groupBy(*key, "banned").agg(F.min("path").alias("path"))
        if more > 2 and step < more:
            got = written(got, "bans")
        kept = kept.unionByName(got)
    return kept.select(*key, "path").distinct()


def expand(calls: DataFrame, targets: DataFrame, depth: int, edge: tuple[str, ...] = ("order_key", "seq")) -> DataFrame:
    """(target, id, distance): every caller that reaches a target by a path of at most ``depth`` edges, no edge twice.

    ``targets`` has one column ``target``. Each level is one equi-join on the callee; parallel edges between two functions are
    edges of their own, so a path carries the hashes of its edges (64 bits, compared within a path alone). Of the paths to a function only some that stand for all go on, so a hub's callers do not
    multiply from level to level; the last level needs no path. The paths of every other level are written to the shared folder, so an expansion is planned and
    computed level by level, each level once.
    """
    edges = calls.select(F.xxhash64("src", "dst", *edge).alias("edge"), "src", "dst")
    front = targets.distinct().select("target", F.col("target").alias("at"), F.array().cast("array<bigint>").alias("path"))
    out = None
    for level in range(1, depth + 1):
        step = front.join(edges, front["at"] == edges["dst"]).filter(~F.array_contains("path", F.col("edge")))
        if level < depth:
            # paths that differ in order alone hold the same edges
            longer = written(step.select("target", F.col("src").alias("at"), F.array_sort(F.array_append("path", F.col("edge"))).alias("path")).distinct(), "paths")
            found = longer.select("target", F.col("at").alias("id"))
            front = representative(longer, level, depth - level)
        else:
            found = step.select("target", F.col("src").alias("id"))
        found = found.distinct().withColumn("distance", F.lit(level))
        out = found if out is None else out.unionByName(found)
    return out


def batch_impact(functions: DataFrame, calls: DataFrame, targets: DataFrame, *, depth: int = 3, edge: tuple[str, ...] = ("order_key", "seq")) -> DataFrame:
    """Distinct affected functions of each target, tests marked."""
    cols = functions.select("id", "crate", "name", "qualified_name", "is_test", "line_start")
    return expand(calls, targets, depth, edge).join(cols, "id").select("target", "id", "crate", "name", "qualified_name", "is_test", "line_start", "distance")


def impact(functions: DataFrame, calls: DataFrame, qualified_name: str, *, depth: int = 3, limit: int | None = 50, edge: tuple[str, ...] = ("order_key", "seq")) -> DataFrame:
    target = functions.filter(F.col("qualified_name") == qualified_name).select(F.col("id").alias("target"))
    return topk(batch_impact(functions, calls, target, depth=depth, edge=edge).drop("target"), [F.col("distance"), F.col("crate")], ["id"], limit)


def batch_summary(functions: DataFrame, calls: DataFrame, targets: DataFrame, *, depth: int = 3, edge: tuple[str, ...] = ("order_key", "seq")) -> DataFrame:
    """For each target: affected functions and tests, counted once whatever their distances. Targets that do not exist are marked."""
    hit = batch_impact(functions, calls, targets, depth=depth, edge=edge).groupBy("target").agg(
        F.countDistinct("id").alias("affected"), F.countDistinct(F.when(F.col("is_test"), F.col("id"))).alias("tests"), F.max("distance").cast("int").alias("farthest")
    )
    known = functions.select(F.col("id").alias("target"), F.lit(True).alias("found"))
    return targets.distinct().join(known, "target", "left").join(hit, "target", "left").select("target", F.coalesce("found", F.lit(False)).alias("found"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("affected", "tests", "farthest")])


def file_impact(functions: DataFrame, calls: DataFrame, files: list[str], *, depth: int = 2) -> DataFrame:
    changed = functions.filter(in_file(files)).select(F.col("id").alias("target"))
    return batch_summary(functions, calls, changed, depth=depth)


def diff_lookup(spark: SparkSession, functions: DataFrame, diff: str) -> DataFrame:
    """Functions that a diff names on changed lines; those in changed files come first."""
    names = diff_functions(spark, diff)
    files = diff_files(spark, diff)
    here = functions.join(F.broadcast(files), functions["file"].endswith(files["path"]), "left_semi").select("id").withColumn("in_changed_file", F.lit(True))  # as many files as the diff has
    rows = functions.join(F.broadcast(names), "name").join(here, "id", "left")
    return rows.select("id", "name", "qualified_name", F.coalesce("in_changed_file", F.lit(False)).alias("in_changed_file"))


def diff_impact(spark: SparkSession, functions: DataFrame, calls: DataFrame, diff: str, *, depth: int = 2) -> DataFrame:
    return batch_summary(functions, calls, diff_lookup(spark, functions, diff).select(F.col("id").alias("target")), depth=depth)
