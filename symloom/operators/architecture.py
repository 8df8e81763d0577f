"""Layer rules, dependency direction, private access, cycles, and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.text import health_score, health_status
from symloom.operators.predicates import not_public, topk
from symloom.operators.strong import strong_components

VIOLATION = ("kind", "source", "target", "from_layer", "to_layer", "from_crate", "to_crate", "severity")


def layer_of(crates: DataFrame, layers: DataFrame) -> DataFrame:
    """(name, layer): the first layer, in order, one of whose patterns is the crate's name or, with a last ``*``, its beginning.

    ``layers`` (ordinal, layer, pattern) comes from a configuration file and is broadcast.
    """
    starts = F.col("pattern").endswith("*") & F.col("name").startswith(F.regexp_replace("pattern", r"\*$", ""))
    hit = crates.select("name").join(F.broadcast(layers), starts | (F.col("name") == F.col("pattern")))
    first = hit.groupBy("name").agg(F.min_by("layer", "ordinal").alias("layer_name"), F.min("ordinal").alias("layer"))
    return crates.select("name").join(first, "name", "left")


def upward(caller: Column, callee: Column) -> Column:
    """A lower layer (smaller ordinal) may not call a higher one."""
    return caller < callee


def ends(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls with both functions' columns, prefixed a_ and b_."""
    cols = [c for c in ("id", "name", "qualified_name", "crate", "visibility") if c in functions.columns]
    of = lambda p, key: functions.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in cols if c != "id"])
    return calls.join(of("a", "src"), "src").join(of("b", "dst"), "dst")


def _violation(kind: str, severity: str, source: str, target: str, crates: tuple[str, str], layers: tuple[Column, Column]) -> list[Column]:
    text = lambda c: c.cast("string")
    return [F.lit(kind).alias("kind"), F.col(source).alias("source"), F.col(target).alias("target"), text(layers[0]).alias("from_layer"), text(layers[1]).alias("to_layer"), F.col(crates[0]).alias("from_crate"), F.col(crates[1]).alias("to_crate"), F.lit(severity).alias("severity")]


def layer_violations(functions: DataFrame, calls: DataFrame, crates: DataFrame) -> DataFrame:
    """One row for each call from a lower to a higher layer. Crates come from manifests and are broadcast if AQE finds them small."""
    of = lambda a, b: crates.filter("layer is not null").select(F.col("name").alias(a), F.col("layer").alias(b))
    rows = ends(functions, calls).join(of("a_crate", "a_layer"), "a_crate").join(of("b_crate", "b_layer"), "b_crate")
    return rows.filter(upward(F.col("a_layer"), F.col("b_layer"))).select(*_violation("layer_violation", "Error", "a_qualified_name", "b_qualified_name", ("a_crate", "b_crate"), (F.col("a_layer"), F.col("b_layer"))))


def reverse_dependencies(crates: DataFrame, depends_on: DataFrame) -> DataFrame:
    of = lambda a, b: crates.filter("layer is not null").select(F.col("name").alias(a), F.col("layer").alias(b))
    rows = depends_on.join(of("src", "a_layer"), "src").join(of("dst", "b_layer"), "dst").filter(upward(F.col("a_layer"), F.col("b_layer")))
    return rows.select(*_violation("reverse_dependency", "Error", "src", "dst", ("src", "dst"), (F.col("a_layer"), F.col("b_layer"))))


def private_access(functions: DataFrame, calls: DataFrame) -> DataFrame:
    rows = ends(functions, calls).filter((F.col("a_crate") != F.col("b_crate")) & not_public("b_visibility"))
    none = F.lit("unknown")
    return rows.select(*_violation("private_api_access", "Warning", "a_qualified_name", "b_qualified_name", ("a_crate", "b_crate"), (none, none)))


def cycles(depends_on: DataFrame, *, only_longer: bool = False) -> DataFrame:
    """(crate1, crate2): the first reaches the second by a walk of two edges or more, and the second reaches the first.

    These are the pairs within a strongly connected component, and that is how they are found; the pairs are as many as the component's size
    squared, so a caller that needs the rings alone takes ``strong_components``. ``only_longer`` leaves out pairs whose crates only form two-cycles. Walks may repeat an edge where trails may not; the two differ only on pairs that
    need an edge twice.
    """
    part = strong_components(depends_on)
    rows = part.select("component", F.col("node").alias("crate1")).join(part.select("component", F.col("node").alias("crate2")), "component").select("crate1", "crate2")
    if not only_longer:
        return rows
    mutual = mutual_references(depends_on)
    twos = mutual.select(F.col("a").alias("crate1"), F.col("b").alias("crate2")).union(mutual.select("b", "a"))
    larger = rows.filter("crate1 <> crate2").join(twos, ["crate1", "crate2"], "left_anti").select(F.col("crate1").alias("c")).distinct()
    return rows.join(larger, rows["crate1"] == larger["c"], "left_semi")


def mutual_references(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs that refer to one another."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    return e.groupBy("a", "b").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down")).filter("up and down").select("a", "b")


def all_violations(functions: DataFrame, calls: DataFrame, crates: DataFrame, depends_on: DataFrame, *, severity: str | None = None) -> DataFrame:
    none = F.lit("unknown")
    rings = cycles(depends_on).select(*_violation("circular_dependency", "Error", "crate1", "crate2", ("crate1", "crate2"), (none, none)))
    out = layer_violations(functions, calls, crates).unionByName(rings).unionByName(reverse_dependencies(crates, depends_on)).unionByName(private_access(functions, calls))
    return out if severity is None else out.filter(F.lower("severity") == severity.lower())


def summary(violations: DataFrame) -> DataFrame:
    """(section, name, n): counts by severity and by layer pair."""
    by_severity = violations.groupBy(F.col("severity").alias("name")).agg(F.count("*").alias("n")).select(F.lit("severity").alias("section"), "name", "n")
    by_layer = violations.filter("kind = 'layer_violation'").groupBy(F.concat_ws(" -> ", "from_layer", "to_layer").alias("name")).agg(F.count("*").alias("n")).select(F.lit("layers").alias("section"), "name", "n")
    return by_severity.unionByName(by_layer)


def worst_crates(violations: DataFrame, k: int = 5) -> DataFrame:
    return topk(violations.groupBy("from_crate").agg(F.count("*").alias("n")), [F.desc("n")], ["from_crate"], k)


def layer_health(violations: DataFrame, crates: DataFrame) -> DataFrame:
    """Score and status of each layer from the layer violations that start in it."""
    n = violations.filter("kind = 'layer_violation'").groupBy(F.col("from_layer").alias("layer")).agg(F.count("*").alias("v"))
    layers = crates.filter("layer is not null").select(F.col("layer").cast("string").alias("layer")).distinct()
    rows = layers.join(n, "layer", "left").select("layer", F.coalesce("v", F.lit(0)).alias("violations"))
    score = health_score(F.col("violations"))
    return rows.select("layer", "violations", F.round(score, 6).alias("score"), health_status(score).alias("status"))


def layer_jumps(crates: DataFrame, depends_on: DataFrame, *, more_than: int = 1) -> DataFrame:
    of = lambda a, b: crates.filter("layer is not null").select(F.col("name").alias(a), F.col("layer").alias(b))
    gap = F.abs(F.col("a") - F.col("b"))
    return depends_on.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter(gap > more_than).select("src", "dst", gap.alias("gap"))


def deep_imports(imports: DataFrame, *, more_than: int = 2) -> DataFrame:
    """Imports of more path separators than allowed, not through a prelude."""
    depth = F.size(F.split("module_path", "::")) - 1
    return imports.filter((depth > more_than) & ~F.col("module_path").contains("prelude")).select("crate", "file", "line", "module_path", depth.alias("depth"))


def by_function(violations: DataFrame, qualified_name: str) -> DataFrame:
    return violations.filter((F.col("source") == qualified_name) | (F.col("target") == qualified_name))


def marked(functions: DataFrame, violations: DataFrame) -> DataFrame:
    """Functions with a flag: some violation starts at them."""
    bad = violations.select(F.col("source").alias("qualified_name")).distinct().withColumn("violates_architecture", F.lit(True))
    return functions.join(bad, "qualified_name", "left").withColumn("violates_architecture", F.coalesce("violates_architecture", F.lit(False)))


def rank_in_crate(functions: DataFrame) -> DataFrame:
    w = Window.partitionBy("crate").orderBy("line_start", "id")
    return functions.withColumn("place", F.row_number().over(w))
