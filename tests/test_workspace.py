"""Workspaces: member globs, exclusion, inheritance, dependencies by path and for targets."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from symloom.operators import search as V
from symloom.sources import workspace

ROOT = """
[workspace]
members = ["crates/*", "tools/[ab]?", "deep/**/leaf", "here", "gone/kept"]
exclude = ["crates/out", "gone"]
[workspace.package]
version = "3.1.4"
[workspace.dependencies]
serde = "1"
short = { package = "long-name", version = "2" }
local = { path = "lib/local", version = "0.1" }
[package]
name = "top"
version = { workspace = true }
[dev-dependencies]
byside = { path = "lib/byside" }
"""
TREE = {
    "": ROOT,
    "crates/one": '[package]\nname = "one"\nversion.workspace = true\n[dependencies]\nserde.workspace = true\nshort = { workspace = true, features = ["x"] }\nlocal = { workspace = true }\nunknown = { workspace = true }\n[build_dependencies]\ncc = "1"\n',
    "crates/two": '[package]\nname = "two"\nversion = "0.2.0"\n[target."cfg(unix)".dependencies]\nlibc = "0.2"\n[target.wasm32.dev-dependencies]\nwasm = { package = "wasm-test", version = "1" }\n[dependencies]\nalias = { package = "one", path = "../one/../one" }\n',
    "crates/out": '[package]\nname = "out"\nversion = "9.0.0"\n',
    "crates/two/inner": '[package]\nname = "inner"\nversion = "1.0.0"\n',
    "tools/a1": '[package]\nname = "a1"\n',
    "tools/c1": '[package]\nname = "c1"\n',
    "deep/x/y/leaf": '[package]\nname = "leaf1"\n',
    "deep/leaf": '[package]\nname = "leaf0"\n',
    "here": '[package]\nname = "here"\n[dependencies]\nfar = { path = "../../elsewhere/far" }\n',
    "gone/kept": '[package]\nname = "kept"\n',
    "gone/lost": '[package]\nname = "lost"\n',
    "lib/local": '[package]\nname = "local"\nversion = "0.1.0"\n[dependencies]\nnext = { path = "../next" }\n',
    "lib/next": '[package]\nname = "next-real"\nversion = "0.1.0"\n[dependencies]\nlocal = { path = "../local" }\nout = { path = "../../crates/out" }\n',
    "lib/byside": '[package]\nname = "byside"\n',
    "lib/never": '[package]\nname = "never"\n',
    "other": '[workspace]\nmembers = ["m"]\n',
    "other/m": '[package]\nname = "m"\nversion = { workspace = true }\n',
    "pinned": '[package]\nname = "pin"\nworkspace = "../other"\n',
    "broken": "[package\nname = ",
    "empty": "",
    "odd": 'package = 3\ndependencies = "x"\n',
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("ws") / "a [b] c"
    for at, text in TREE.items():
        (top / "w" / at).mkdir(parents=True, exist_ok=True)
        (top / "w" / at / "Cargo.toml").write_text(text)
    far = top / "elsewhere" / "far"
    far.mkdir(parents=True)
    (far / "Cargo.toml").write_text('[package]\nname = "far"\n')
    texts = [(f"{top}/w/{at}/Cargo.toml".replace("//", "/"), text) for at, text in TREE.items()] + [(f"{far}/Cargo.toml", '[package]\nname = "far"\n')]
    rows = workspace.packages(spark.createDataFrame(texts, "path string, text string")).collect()
    read = workspace.manifests(spark, str(tmp_path_factory.getbasetemp()))
    assert {r["name"] for r in read.collect()} >= {r["name"] for r in rows}
    return {r["name"]: r for r in rows}, str(top)


def test_membership(found):
    rows, top = found
    member = {n for n, r in rows.items() if r["is_member"] and r["root"] == f"{top}/w"}
    assert member == {"top", "one", "two", "a1", "leaf0", "leaf1", "here", "kept", "local", "next-real", "byside"}
    alone = {n for n, r in rows.items() if r["is_member"] and r["root"] == r["path"]} - {"top"}
    assert alone == {"out", "lost", "far"}  # excluded or below no workspace: their own
    assert {n for n, r in rows.items() if not r["is_member"]} == {"inner", "c1", "never", "pin"}
    assert rows["m"]["root"] == rows["pin"]["root"] == f"{top}/w/other" and rows["m"]["is_member"]


def test_inherited(found):
    rows, top = found
    assert rows["one"]["version"] == rows["top"]["version"] == "3.1.4" and rows["two"]["version"] == "0.2.0" and rows["m"]["version"] is None
    deps = {(d["name"], d["kind"], d["target"], d["path"] and d["path"].removeprefix(top)) for d in rows["one"]["dependencies"]}
    assert deps == {("serde", "normal", None, None), ("long-name", "normal", None, None), ("local", "normal", None, "/w/lib/local"), ("unknown", "normal", None, None), ("cc", "build", None, None)}
    deps = {(d["name"], d["kind"], d["target"], d["path"] and d["path"].removeprefix(top)) for d in rows["two"]["dependencies"]}
    assert deps == {("one", "normal", None, "/w/crates/one"), ("libc", "normal", "cfg(unix)", None), ("wasm-test", "dev", "wasm32", None)}
    assert [(d["name"]) for d in rows["local"]["dependencies"]] == ["next-real"]


def test_discovered(spark, found):
    rows, _ = found
    df = spark.createDataFrame(list(rows.values()), "path string, name string, version string, dependencies array<struct<name:string,kind:string,target:string,path:string>>, root string, is_member boolean")
    crates, deps = workspace.discover(df, workspace.Config(include_dev=True), ["two"])
    got = {r["name"]: (r["depth"], r["is_workspace_member"], r["is_external"]) for r in crates.collect()}
    assert got["two"] == (0, True, False) and got["one"] == (1, True, False) and got["libc"] == (1, False, True) and got["next-real"] == (3, True, False)
    assert ("two", "one") in {(r["src"], r["dst"]) for r in deps.collect()}
    flat = workspace.Config.loads('[workspace]\nroot = "/a"\nadditional_roots = ["/b"]\n[analysis]\nrecursive_scan = false\n[embeddings]\ninclude_in_embedding = ["return_type"]\n')
    assert (flat.roots, flat.recursive, flat.fields) == (("/a", "/b"), False, ("return_type",))
    assert [r["name"] for r in workspace.discover(df, flat, ["two"])[0].collect()] == ["two"]
    twice = df.filter("name = 'one'").withColumn("path", F.lit("/0")).withColumn("is_member", F.lit(False)).union(df.filter("name = 'one'"))
    assert workspace.discover(twice, workspace.Config())[0].filter("name = 'one'").first()["path"] == rows["one"]["path"]


def test_nothing(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert workspace.packages(none).count() == 0
    odd = spark.createDataFrame([("/x/Cargo.toml", None), ("/y/Cargo.toml", "")], "path string, text string")
    assert workspace.packages(odd).count() == 0


@pytest.mark.parametrize(("glob", "hits", "misses"), [("/a/*", ["/a/b", "/a/.b"], ["/a/b/c", "/a", "/ab"]), ("/a/**/z", ["/a/z", "/a/b/c/z"], ["/a/bz"]), ("/a/[!xy]1", ["/a/b1"], ["/a/x1", "/a//1"]), ("/a/b?.c", ["/a/bb.c"], ["/a/b.c", "/a/bbxc"]), ("/a/[a-c]^", ["/a/b^"], ["/a/d^"])])
def test_globs(spark, glob, hits, misses):
    p = workspace.path_pattern(glob)
    rows = spark.createDataFrame([(x,) for x in hits + misses], "p string").withColumn("hit", F.col("p").rlike(f"^(?:{p})$")).collect()
    assert {r["p"] for r in rows if r["hit"]} == set(hits) == {x for x in hits + misses if re.fullmatch(p, x)}


def test_texts_by_configuration(spark):
    schema = "id int, crate string, name string, module string, doc string, parameters array<struct<name:string,type:string>>, return_type string"
    df = spark.createDataFrame([(1, "c", "f", "m", "what it does", [("a", "u8"), ("b", "&str")], "bool"), (2, "c", "g", "m", None, [], None), (3, "c", "h", "", None, None, "")], schema)
    texts = lambda *fields: [r["text"] for r in V.function_rows(df, *([fields] if fields else [])).orderBy("id").collect()]
    assert texts() == ["crate: c | function: f | module: m | docs: what it does | params: u8, &str | returns: bool", "crate: c | function: g | module: m", "crate: c | function: h"]
    assert texts("return_type", "nothing", "function_name") == ["crate: c | returns: bool | function: f", "crate: c | function: g", "crate: c | function: h"]
    kinds = spark.createDataFrame([(1, "c", "T", "Struct", "m", "d", ["a: u8", "b"], ["V"])], "id int, crate string, name string, kind string, module string, doc string, fields array<string>, variants array<string>")
    assert V.type_rows(kinds, ("variants", "fields")).first()["text"] == "crate: c | type: T | kind: Struct | variants: V | fields: a, b"
    assert V.type_rows(kinds, ("function_name", "doc_comments")).first()["text"] == "crate: c | type: T | kind: Struct | docs: d"
