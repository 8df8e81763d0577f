"""Counts, overviews and schema discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions.text import impact_level
from symloom.model import Graph
from symloom.operators.predicates import named, topk


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, n) of each table; plain counts come from the files' footers."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "n") for k, df in tables.items()])


def nodes(g: Graph) -> dict[str, DataFrame]:
    return {"Function": g.functions, "Crate": g.crates, "Actor": g.actors, "MessageType": g.sends.select("message_type").union(g.handles.select("message_type")).distinct()}


def edges(g: Graph) -> dict[str, DataFrame]:
    return {"CALLS": g.calls, "DEPENDS_ON": g.depends_on, "SENDS": g.sends, "HANDLES": g.handles, "SPAWNS": g.spawns}


def graph_statistics(g: Graph) -> DataFrame:
    return counted({**nodes(g), **edges(g)})


def metrics(g: Graph) -> DataFrame:
    """The statistics as one map."""
    got = graph_statistics(g)
    return got.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("metrics"))


def patterns(g: Graph) -> DataFrame:
    """(from, type, to, n) of every edge kind: the schema as the data have it."""
    shape = {"CALLS": ("Function", "Function"), "DEPENDS_ON": ("Crate", "Crate"), "SENDS": ("Actor", "Actor"), "HANDLES": ("Actor", "MessageType"), "SPAWNS": ("Actor", "Actor")}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(shape[k][0]).alias("from_label"), F.lit(k).alias("edge"), F.lit(shape[k][1]).alias("to_label"), "n") for k, df in edges(g).items()]
    return reduce(DataFrame.unionByName, rows)


def properties(g: Graph) -> DataFrame:
    """(label, property, type, n): the nodes' properties and how many nodes have a value; one aggregate a label."""
    out = []
    for label, df in nodes(g).items():
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        rows = F.array(*[F.struct(F.lit(f.name).alias("property"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("n")) for f in df.schema])
        out.append(counts.select(F.lit(label).alias("label"), F.inline(rows)))
    return reduce(DataFrame.unionByName, out)


def call_dump(functions: DataFrame, calls: DataFrame) -> DataFrame:
    of = lambda k, p: functions.select(F.col("id").alias(k), F.col("qualified_name").alias(f"{p}_name"), F.col("crate").alias(f"{p}_crate"))
    return calls.join(of("src", "caller"), "src").join(of("dst", "callee"), "dst").select("caller_name", "callee_name", (F.col("caller_crate") != F.col("callee_crate")).alias("cross_crate"), "line")


def crate_traffic(functions: DataFrame, calls: DataFrame) -> DataFrame:
    of = lambda k, p: functions.select(F.col("id").alias(k), F.col("crate").alias(p))
    return calls.join(of("src", "a"), "src").join(of("dst", "b"), "dst").groupBy("a", "b").agg(F.count("*").alias("n"))


def crate_overview(functions: DataFrame, calls: DataFrame, depends_on: DataFrame, crate: str | None = None) -> DataFrame:
    """Functions, tests, dependencies and cross-crate calls (from or to) of each crate."""
    f = functions.groupBy("crate").agg(F.count("*").alias("functions"), F.count_if("is_test").alias("tests"))
    d = depends_on.groupBy(F.col("src").alias("crate")).agg(F.count("*").alias("dependencies"))
    cross = crate_traffic(functions, calls).filter("a <> b")
    x = cross.select(F.explode(F.array("a", "b")).alias("crate"), "n").groupBy("crate").agg(F.sum("n").alias("cross_calls"))
    out = f.join(d, "crate", "left").join(x, "crate", "left").select("crate", "functions", "tests", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dependencies", "cross_calls")])
    return out if crate is None else out.filter(F.col("crate") == crate)


def crate_samples(functions: DataFrame, crate: str, k: int = 5) -> DataFrame:
    return topk(functions.filter(F.col("crate") == crate).select("id", "qualified_name"), [F.col("qualified_name")], ["id"], k)


def workspace_overview(functions: DataFrame, calls: DataFrame, crates: DataFrame) -> DataFrame:
    """One row for each layer with its crates; counts of all functions and cross-crate calls beside."""
    layers = crates.groupBy("layer").agg(F.count("*").alias("n_crates"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("crates"))
    totals = functions.agg(F.count("*").alias("functions")).crossJoin(crate_traffic(functions, calls).filter("a <> b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cross_calls")))
    return layers.crossJoin(F.broadcast(totals))  # one row


def symbol_impact(functions: DataFrame, calls: DataFrame, symbol: str, found: DataFrame | None = None) -> DataFrame:
    """Matches of a symbol, call edges into them, and the impact level. ``found``: the matches' ids, where an index of names gives them."""
    hit = (functions.filter(named(symbol)) if found is None else found).select(F.col("id").alias("dst"))
    used = calls.join(hit, "dst", "left_semi").agg(F.count("*").alias("usages"), F.countDistinct("src").alias("callers"))
    return hit.agg(F.count("*").alias("matches")).crossJoin(used).withColumn("level", impact_level(F.col("usages")))


def module_summary(functions: DataFrame) -> DataFrame:
    return functions.groupBy("crate").agg(F.countDistinct("module").alias("modules"), F.count("*").alias("functions"), F.countDistinct("name").alias("names"))


def index_statistics(functions: DataFrame) -> DataFrame:
    return functions.agg(F.count("*").alias("functions"), F.countDistinct("name").alias("unique_names"), F.countDistinct("crate").alias("crates"), F.count_if(F.col("visibility") == "pub").alias("exports"))


def name_index(functions: DataFrame) -> DataFrame:
    """name -> how many, and the first by (crate, line, id)."""
    first = F.min(F.struct("crate", "line_start", "id"))
    return functions.groupBy("name").agg(F.count("*").alias("n"), first["id"].alias("first_id"))


def exports(functions: DataFrame) -> DataFrame:
    return functions.filter(F.col("visibility") == "pub").groupBy("crate").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def function_details(functions: DataFrame, calls: DataFrame, target: str, found: DataFrame | None = None) -> DataFrame:
    """Functions of a name with their in- and out-degree. ``found``: their ids, where an index of names gives them."""
    hit = functions.filter(named(target)) if found is None else functions.join(found, "id", "left_semi")
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    return hit.join(into, "id", "left").join(out, "id", "left").select("id", "qualified_name", "visibility", "is_test", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "callees")])
