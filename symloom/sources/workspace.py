"""Workspace discovery from manifests, configuration, and JSON reports.

Manifests are read where the data are (Spark's text reader) and parsed on executors with ``tomllib``; each manifest is one row. What a manifest leaves to
others is joined: a package's workspace is the deepest folder above it whose manifest has a workspace table that does not exclude it (or the one it names),
members are what the globs match and what members reach by paths, and versions and dependencies that are inherited come from the workspace's row.
The depth-bounded expansion is a few joins.
"""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.text import FUNCTION_FIELDS
from symloom.sources.tables import discard, scratch

MOST_DEPTH = 3


@dataclass(frozen=True)
class Config:
    """``layers``: (name, crate patterns), lowest first. ``fields``: the parts of embedded texts. ``roots``: folders of workspaces, the first one first."""

    layers: tuple[tuple[str, tuple[str, ...]], ...] = ()
    include_dev: bool = False
    include_build: bool = False
    exclude: tuple[str, ...] = ()
    members_only: bool = False
    extra: dict = field(default_factory=dict)
    fields: tuple[str, ...] = FUNCTION_FIELDS
    roots: tuple[str, ...] = ()
    recursive: bool = True

    @staticmethod
    def loads(text: str) -> Config:
        t = tomllib.loads(text)
        a, w, e, r = t.get("architecture", {}), t.get("analysis", t.get("workspace", {})), t.get("embeddings", {}), t.get("workspace", {})
        layers = tuple((x["name"], tuple(x.get("crates", ()))) for x in a.get("layers", ()))
        roots = (*((r["root"],) if "root" in r else ()), *r.get("additional_roots", ()))
        return Config(
            layers, bool(w.get("include_dev_deps", False)), bool(w.get("include_build_deps", False)), tuple(w.get("exclude_crates", ())), bool(w.get("workspace_members_only", False)), t,
            tuple(e.get("include_in_embedding", FUNCTION_FIELDS)), roots, bool(w.get("recursive_scan", True)),
        )

    def layer_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, name, p) for k, (name, ps) in enumerate(self.layers) for p in ps], "ordinal int, layer string, pattern string")


DEPENDENCY = "name string, kind string, target string, path string"
#: A manifest as it stands: ``members`` are patterns of whole paths, ``named`` the members' own paths, ``shared`` what packages may inherit.
MANIFEST = (
    "path string, name string, version string, inherits_version boolean, pinned string, dependencies array<struct<key:string,inherited:boolean,name:string,kind:string,target:string,path:string>>, "
    "workspace struct<members:array<string>,named:array<string>,excluded:array<string>,version:string,shared:array<struct<key:string,name:string,path:string>>>"
)
KINDS = {"normal": ("dependencies",), "dev": ("dev-dependencies", "dev_dependencies"), "build": ("build-dependencies", "build_dependencies")}


def folder(uri: str) -> str:
    """The folder of a file; of a local one the plain path."""
    return re.sub(r"^file:/+", "/", uri).rpartition("/")[0] or "/"


def below(base: str, path: str) -> str:
    """``path`` as seen from ``base``, without dots; a scheme and host stay as they are."""
    host, base = re.fullmatch(r"([A-Za-z][\w+.-]*://[^/]*)?(.*)", base, re.DOTALL).groups(default="")
    return host + posixpath.normpath(posixpath.join(base or "/", path))


def path_pattern(glob: str) -> str:
    """A regular expression of the paths that a glob with ``*``, ``**``, ``?`` and classes matches; ``*`` stays within one part."""
    out = []
    for part in re.findall(r"/\*\*(?=/|$)|\*+|\?|\[!?\]?[^\]]*\]|[^*?\[/]+|.", glob, re.DOTALL):
        if part == "/**":
            out.append("(?:/[^/]+)*")
        elif part[0] == "*":
            out.append("[^/]*")
        elif part == "?":
            out.append("[^/]")
        elif part[0] == "[" and len(part) > 2:
            negated = part[1] == "!"
            out.append("[" + "^/" * negated + re.sub(r"([\\\[\]^&])", r"\\\1", part[1 + negated : -1]) + "]")
        else:
            out.append(re.escape(part))
    return "".join(out)


def _read(path: str, text: str) -> dict | None:
    """One manifest, or None where it is not one."""
    try:
        t = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return None
    at, table = folder(path), lambda x: x if isinstance(x, dict) else {}
    package, ws = table(t.get("package", t.get("project"))), t.get("workspace")
    if not isinstance(package.get("name"), str) and not isinstance(ws, dict):
        return None

    def one(key: str, d: object) -> dict:
        d = table(d)
        return {"key": key, "name": d.get("package", key), "path": below(at, d["path"]) if isinstance(d.get("path"), str) else None}

    deps = []
    for target, holder in ((None, t), *((k, table(v)) for k, v in table(t.get("target")).items())):
        for kind, names in KINDS.items():
            for name in names:
                deps += [{**one(k, d), "kind": kind, "target": target, "inherited": table(d).get("workspace") is True} for k, d in table(holder.get(name)).items()]
    version, shared = package.get("version"), None
    if isinstance(ws, dict):
        members = [below(at, m) for m in ws.get("members", ())]
        shared = {
            "members": [re.escape(at) + path_pattern(m[len(at) :]) if m.startswith(at) else path_pattern(m) for m in members], "named": members, "excluded": [below(at, x) for x in ws.get("exclude", ())],
            "version": table(ws.get("package")).get("version"), "shared": [one(k, d) for k, d in table(ws.get("dependencies")).items()],
        }
    return {
        "path": at, "name": package.get("name"), "version": version if isinstance(version, str) else None, "inherits_version": table(version).get("workspace") is True,
        "pinned": below(at, package["workspace"]) if isinstance(package.get("workspace"), str) else None, "dependencies": deps, "workspace": shared,
    }


def parsed(texts: DataFrame) -> DataFrame:
    """A row of ``MANIFEST`` for each (path, text) that is a manifest with a package or a workspace; others are left out."""
    dependency = pa.struct([("key", pa.string()), ("inherited", pa.bool_()), *((n, pa.string()) for n in ("name", "kind", "target", "path"))])
    shared = pa.struct([(n, pa.string()) for n in ("key", "name", "path")])
    lists = [(n, pa.list_(pa.string())) for n in ("members", "named", "excluded")]
    schema = pa.schema([
        ("path", pa.string()), ("name", pa.string()), ("version", pa.string()), ("inherits_version", pa.bool_()), ("pinned", pa.string()), ("dependencies", pa.list_(dependency)),
        ("workspace", pa.struct([*lists, ("version", pa.string()), ("shared", pa.list_(shared))])),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (_read(p, t or "") for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_pylist([r for r in rows if r], schema=schema)

    return texts.select("path", "text").mapInArrow(run, MANIFEST)


def _under(path: Column, top: Column) -> Column:
    return (path == top) | path.startswith(F.concat(F.rtrim(top, F.lit("/")), F.lit("/")))


def _ancestors(path: Column) -> Column:
    """The folder and all above it, by its cuts at slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.coalesce(F.nullif(F.concat_ws("/", F.slice(parts, F.lit(1), k)), F.lit("")), F.lit("/")))


def resolved(rows: DataFrame) -> DataFrame:
    """(path, name, version, dependencies: ``DEPENDENCY``, root, is_member) of every package in ``rows`` (of ``parsed``, read several times: a written table).

    ``root`` is the folder of the package's workspace, its own where it has none. Inherited versions and dependencies are the root's; a dependency by path
    has the name of the package there. Members grow by paths until none is new: one join a step, each step's new members written once.
    """
    spark = rows.sparkSession
    packages = rows.filter("name is not null").drop("workspace")
    roots = rows.filter("workspace is not null").select(F.col("path").alias("root"), "workspace")
    up = packages.select("path", "pinned", F.explode(F.when(F.col("pinned").isNotNull(), F.array("pinned")).otherwise(_ancestors(F.col("path")))).alias("root")).join(roots, "root")
    out = F.exists("workspace.excluded", lambda x: _under(F.col("path"), x)) & ~F.exists("workspace.named", lambda x: _under(F.col("path"), x))
    of = up.filter(~out | F.col("pinned").isNotNull() | (F.col("path") == F.col("root"))).groupBy("path").agg(F.max_by("root", F.length("root")).alias("root")).join(roots, "root", "left")
    placed = packages.join(of, "path", "left")
    alone, listed = F.col("root").isNull() | (F.col("root") == F.col("path")), F.exists("workspace.members", lambda p: F.rlike(F.col("path"), F.concat(F.lit("^(?:"), p, F.lit(")$"))))

    d = F.col("d")
    known = F.when(d["inherited"], F.try_element_at(F.filter("workspace.shared", lambda x: x["key"] == d["key"]), F.lit(1)))
    deps = placed.select("path", F.posexplode("dependencies").alias("at", "d"), "workspace").withColumn("known", known)
    deps = deps.select("path", "at", F.coalesce("known.name", "d.name").alias("name"), "d.kind", "d.target", F.coalesce("known.path", "d.path").alias("to"))
    there = packages.select(F.col("path").alias("to"), F.col("name").alias("real"))
    deps = deps.join(there, "to", "left").select("path", "at", F.coalesce("real", "name").alias("name"), "kind", "target", "to")

    at = scratch(spark, "manifests")
    placed.select("path", F.coalesce("root", "path").alias("root"), (alone | F.coalesce(listed, F.lit(False))).alias("is_member")).write.parquet(f"{at}/placed")
    deps.write.parquet(f"{at}/deps")
    spots, deps = spark.read.parquet(f"{at}/placed"), spark.read.parquet(f"{at}/deps")
    steps = deps.filter("`to` is not null").select("path", "to").distinct().join(spots.select("path", "root"), "path").join(spots.filter("not is_member").select(F.col("path").alias("to"), "root"), ["to", "root"]).select("path", "to")
    schema, step = "path string", 0
    spots.filter("is_member").select("path").write.parquet(f"{at}/members/step=0")
    while True:
        front, step = spark.read.schema(schema).parquet(f"{at}/members/step={step}"), step + 1
        old = spark.read.schema(schema).parquet(f"{at}/members")
        fresh = steps.join(front, "path", "left_semi").select(F.col("to").alias("path")).distinct().join(old, "path", "left_anti")
        fresh.write.parquet(f"{at}/members/step={step}")
        if spark.read.schema(schema).parquet(f"{at}/members/step={step}").isEmpty():
            break
    members = spark.read.schema(schema).parquet(f"{at}/members").select("path", F.lit(True).alias("is_member"))
    lists = deps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "name", "kind", "target", F.col("to").alias("path")))).alias("l"))
    lists = lists.select("path", F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["target"].alias("target"), x["path"].alias("path"))).alias("dependencies"))
    out = placed.select("path", "name", F.when(F.col("inherits_version"), F.col("workspace.version")).otherwise(F.col("version")).alias("version"), F.coalesce("root", "path").alias("root"))
    out = out.join(lists, "path", "left").join(members, "path", "left")
    none = F.array().cast("array<struct<name:string,kind:string,target:string,path:string>>")
    out.select("path", "name", "version", F.coalesce("dependencies", none).alias("dependencies"), "root", F.coalesce("is_member", F.lit(False)).alias("is_member")).write.parquet(f"{at}/packages")
    for part in ("placed", "deps", "members"):
        discard(spark, f"{at}/{part}")
    return spark.read.parquet(f"{at}/packages")


def packages(texts: DataFrame) -> DataFrame:
    """The packages of (path, text) manifests, with what they inherit; see ``resolved``."""
    spark, at = texts.sparkSession, scratch(texts.sparkSession, "manifests")
    parsed(texts).write.parquet(at)
    out = resolved(spark.read.parquet(at))
    discard(spark, at)
    return out


def manifests(spark: SparkSession, *roots: str) -> DataFrame:
    """The packages of every ``Cargo.toml`` below the folders; see ``resolved``."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "Cargo.toml").text(list(roots), wholetext=True)
    return packages(raw.select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def package_id(c: Column) -> tuple[Column, Column, Column]:
    """(path, name, version) of ``path+file:///dir#name@version``; nulls for ids of other sources."""
    part = lambda n: F.nullif(F.regexp_extract(c, r"^path\+file://([^#]+)#(?:([^@]+)@)?([^@]+)$", n), F.lit(""))
    return part(1), F.coalesce(part(2), F.element_at(F.split(part(1), "/"), -1)), part(3)


def kept_dependency(kind: Column, config: Config) -> Column:
    return (kind == "normal") | ((kind == "dev") & F.lit(config.include_dev)) | ((kind == "build") & F.lit(config.include_build))


def excluded(name: Column, patterns: tuple[str, ...]) -> Column:
    """The name holds a pattern, less its last ``*``."""
    return reduce(lambda a, p: a | name.contains(p.rstrip("*")), patterns, F.lit(False))


def discover(found: DataFrame, config: Config, roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(crates with depth, depends_on). Breadth-first from ``roots`` (all manifests where none are given), at most ``MOST_DEPTH`` levels, none beyond the
    start where the configuration is not recursive. Of packages of one name a member counts, then the first path. Where ``found`` has no ``is_member``, all found are members."""
    found = found if "is_member" in found.columns else found.withColumn("is_member", F.lit(True))
    row = F.struct("version", "path", "is_member", "dependencies")
    known = found.filter(~excluded(F.col("name"), config.exclude)).groupBy("name").agg(F.min_by(row, F.struct(~F.col("is_member"), "path")).alias("r")).select("name", "r.*")
    edges = known.select(F.col("name").alias("src"), F.explode("dependencies").alias("d")).filter(kept_dependency(F.col("d.kind"), config)).select("src", F.col("d.name").alias("dst"), F.col("d.kind").alias("kind")).distinct()
    start = known.select("name") if roots is None else known.filter(F.col("name").isin(*roots)).select("name")
    levels = start.withColumn("depth", F.lit(0))
    front = levels
    for depth in range(1, MOST_DEPTH + 1 if config.recursive else 1):
        front = edges.join(front, edges["src"] == front["name"]).select(F.col("dst").alias("name")).distinct().withColumn("depth", F.lit(depth))
        levels = levels.unionByName(front)
    near = levels.groupBy("name").agg(F.min("depth").alias("depth"))
    crates = near.join(known.select("name", "path", "version", "is_member"), "name", "left")
    member = F.coalesce("is_member", F.lit(False))
    crates = crates.select("name", "version", "path", "depth", member.alias("is_workspace_member"), (F.col("path").isNull() | (F.col("depth") > 0) & ~member).alias("is_external"))
    if config.members_only:
        crates = crates.filter("is_workspace_member")
    return crates, edges.join(crates.select(F.col("name").alias("src")), "src", "left_semi")


def report(functions: DataFrame, types: DataFrame, calls: DataFrame, crates: DataFrame) -> DataFrame:
    """One row of counts, for a JSON sink."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(crates, "crates").crossJoin(n(functions, "functions")).crossJoin(n(types, "types")).crossJoin(n(calls, "calls"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> str:
    """A report of a few rows as text."""
    return json.dumps([json.loads(x) for x in df.toJSON().collect()])
