"""Hand-made graphs for three-valued logic, trails, multigraph counts, layers, containment and resolution."""

from __future__ import annotations

import pytest

from symloom.functions import text as T
from symloom.operators import actors as A
from symloom.operators import architecture as R
from symloom.operators import coverage as C
from symloom.operators import impact as I
from symloom.operators import resolve as N
from symloom.operators import search as V
from symloom.operators.predicates import not_public

FN = "id string, name string, qualified_name string, crate string, module string, file string, visibility string, is_test boolean, line_start long"


def fns(spark, **tests):
    return spark.createDataFrame([(n, n, f"k::{n}", "k", "m", "f.rs", "pub", t, i) for i, (n, t) in enumerate(tests.items())], FN)


def calls(spark, *pairs):
    return spark.createDataFrame([(a, b, i + 1) for i, (a, b) in enumerate(pairs)], "src string, dst string, line long")


def ids(df):
    return {r["id"] for r in df.collect()}


def test_trails(spark):
    e = spark.createDataFrame([(10, 1, 2), (11, 2, 3), (12, 3, 1), (13, 1, 1)], "eid int, src int, dst int")
    got = I.expand(e, spark.createDataFrame([(1,)], "target int"), 3, ("eid",))
    assert {(r["id"], r["distance"]) for r in got.collect()} == {(1, 1), (3, 1), (2, 2), (3, 2), (1, 3), (2, 3)}


def trails(edges, target, depth):
    """(id, distance) of all callers, by walking every path without a repeated edge."""
    out = set()

    def walk(at, used):
        for e, a, b in edges:
            if b == at and e not in used:
                out.add((a, len(used) + 1))
                if len(used) + 1 < depth:
                    walk(a, used | {e})

    walk(target, frozenset())
    return out


@pytest.mark.parametrize(("seed", "depth"), [(0, 3), (1, 3), (2, 4), (3, 5)])
def test_kept_paths_stand_for_all(spark, seed, depth):
    """Random graphs with loops, two-cycles and parallel edges."""
    import random

    rng = random.Random(seed)
    n = 4 if depth > 3 else 6
    edges = [(k, rng.randrange(n), rng.randrange(n)) for k in range(12 if depth > 3 else 22)] + [(100, 0, 0), (101, 0, 1), (102, 1, 0)]
    e = spark.createDataFrame(edges, "eid int, src int, dst int")
    got = {(r["target"], r["id"], r["distance"]) for r in I.expand(e, spark.createDataFrame([(t,) for t in range(3)], "target int"), depth, ("eid",)).collect()}
    assert got == {(t, i, d) for t in range(3) for i, d in trails(edges, t, depth)}


def test_few_paths_of_a_hub_go_on(spark):
    """100 callers of a target, all called by one function: three paths of it go on, not 100."""
    pairs = spark.createDataFrame([(0, 9, [(k,)]) for k in range(100)], "target int, at int, path array<struct<e:int>>")
    assert I.representative(pairs, 1, 2).count() == 3


def test_impact_grows_with_depth(spark):
    e = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4)], "eid int, src int, dst int")
    t = spark.createDataFrame([(4,)], "target int")
    sets = [{(r["id"], r["distance"]) for r in I.expand(e, t, d, ("eid",)).collect()} for d in (1, 2, 3)]
    assert sets[0] < sets[1] < sets[2]


def test_three_valued(spark):
    f = fns(spark, a=False, b=True, c=None, d=False)
    c = calls(spark, ("b", "a"), ("c", "d"))
    assert ids(C.test_only(f, c)) == {"a"}
    assert ids(C.without_tests(f, c)) == {"c", "d"}
    assert ids(C.unreferenced(f, c)) == set()
    assert ids(C.with_tests(f, c)) == {"a"}


def test_multigraph_and_two_stages(spark):
    f = fns(spark, x=False, y=False, t=True)
    c = calls(spark, ("x", "y"), ("x", "y"), ("t", "y"))
    assert {r["id"]: r["reference_count"] for r in C.most_referenced(f, c).collect()} == {"y": 3}
    assert ids(C.most_referenced_without_tests(f, c)) == set()
    assert {r["id"]: r["test_count"] for r in C.with_tests(f, c).collect()} == {"y": 1}


def test_layers_and_visibility(spark):
    f = spark.createDataFrame([("1", "a", "core::a", "core", "m", "f", "pub", False, 1), ("2", "b", "app::b", "app", "m", "f", "private", False, 1), ("3", "c", "app::c", "app", "m", "f", "pub(crate)", False, 1)], FN)
    crates = spark.createDataFrame([("core", 0), ("app", 2)], "name string, layer int")
    c = calls(spark, ("1", "2"), ("2", "1"), ("2", "3"), ("1", "3"))
    assert {(r["source"], r["target"]) for r in R.layer_violations(f, c, crates).collect()} == {("core::a", "app::b"), ("core::a", "app::c")}
    assert [(r["source"], r["target"]) for r in R.private_access(f, c).collect()] == [("core::a", "app::b")]
    assert f.filter(not_public()).count() == 1


def test_health(spark):
    got = spark.createDataFrame([(0,), (1,), (4,), (5,)], "v int")
    rows = got.select(T.health_score(got["v"]).alias("s"), T.health_status(T.health_score(got["v"])).alias("t")).collect()
    assert [r["t"] for r in rows] == ["healthy", "healthy", "warning", "critical"]
    assert rows[1]["s"] == pytest.approx(100 / 1.1)


def test_cycles(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("a", "z")], "src string, dst string")
    got = {(r[0], r[1]) for r in R.cycles(d).collect()}
    assert {("a", "c"), ("a", "b"), ("x", "x")} <= got and not any("z" in p for p in got)
    longer = {(r["crate1"], r["crate2"]) for r in R.cycles(d, only_longer=True).collect()}
    assert ("a", "b") in longer and not any(set(p) & {"x", "y"} for p in longer)
    assert {(r["a"], r["b"]) for r in R.mutual_references(d).collect()} == {("x", "y")}


def test_layer_patterns(spark):
    crates = spark.createDataFrame([("core",), ("core-x",), ("other",)], "name string")
    layers = spark.createDataFrame([(0, "base", "core"), (1, "rest", "core*")], "ordinal int, layer string, pattern string")
    assert {r["name"]: r["layer_name"] for r in R.layer_of(crates, layers).collect()} == {"core": "base", "core-x": "rest", "other": None}


def test_containment(spark):
    f = spark.createDataFrame([("out", "f.rs", 1, 20), ("in", "f.rs", 5, 10), ("far", "g.rs", 1, 99)], "id string, file string, line_start long, line_end long")
    p = spark.createDataFrame([("f.rs", 7), ("f.rs", 15), ("f.rs", 30)], "file string, line long")
    assert {(r["line"], r["function_id"]) for r in N.containing(p, f).collect()} == {(7, "in"), (15, "out")}


def test_resolution(spark):
    f = spark.createDataFrame([("1", "f", "k::m::f", "k", "m", "a.rs", "pub", False, 1), ("2", "f", "z::q::f", "z", "q", "b.rs", "pub", False, 2), ("3", "g", "z::q::g", "z", "q", "b.rs", "pub", False, 9)], FN)
    raw = spark.createDataFrame([(1, "k::m::f", "f", "k", "m", "a.rs", 1), (2, "y::h", "f", "y", "w", "y.rs", 1), (3, "y::h", "alias", "y", "w", "y.rs", 2), (4, "y::h", "gone", "y", "w", "y.rs", 3), (5, "z::q::g", "crate::q::f", "z", "q", "b.rs", 4)], "call_id long, caller string, callee_name string, crate string, module string, file string, line long")
    imports = spark.createDataFrame([("y", "y.rs", "z::q", "Simple", [("g", "alias")])], "crate string, file string, module_path string, import_type string, items array<struct<name:string,alias:string>>")
    got = {r["call_id"]: (r["callee_id"], r["cross_crate"]) for r in N.resolve(raw, f, N.import_table(imports)).collect()}
    assert got == {1: ("1", False), 2: ("2", True), 3: ("3", True), 4: (None, False), 5: ("2", False)}


def test_synthetic_edges_create_what_is_missing(spark):
    f = spark.createDataFrame([("1", "new", "k::A::new", "k")], "id string, name string, qualified_name string, crate string")
    syn = spark.createDataFrame([("s", "k::A::new"), ("s", "A::new"), ("s", "lost::B::new")], "src string, target string")
    edges, created = N.synthetic_edges(syn, f)
    assert {r["target"]: r["how"] for r in edges.collect()} == {"k::A::new": "exact", "A::new": "suffix", "lost::B::new": "created"}
    assert [r["name"] for r in created.collect()] == ["new"]


def test_upsert_and_actor_creation(spark):
    a = spark.createDataFrame([("1", "x", "k", False, False)], "id string, name string, crate string, is_distributed boolean, is_test boolean")
    h = spark.createDataFrame([("1", "M"), ("2", "M")], "actor string, message_type string")
    edges, created = A.handle_edges(a, h)
    assert edges.count() == 2 and [r["id"] for r in created.collect()] == ["2"]


def test_text(spark):
    one = spark.range(1)
    from pyspark.sql import functions as F

    got = one.select(
        T.snake(F.lit("FooBarBaz")).alias("a"), T.pascal(F.lit("foo_bar__baz")).alias("b"), T.module_of_file(F.lit("/w/my-k/src/a/mod.rs"), F.lit("my-k")).alias("c"), T.module_of_file(F.lit("/w/k/src/lib.rs"), F.lit("k")).alias("d"),
        T.method_of_pattern(F.lit("[<$x>]::new(")).alias("e"), T.type_of_variable(F.lit("price_feed_actor")).alias("f"), T.macro_kind(F.lit("warn")).alias("g"), T.visibility(F.lit("pub(super) fn x")).alias("h"), T.is_test_file(F.lit("/k/src/a_test.rs")).alias("i"),
    ).first()
    assert tuple(got) == ("foo_bar_baz", "FooBarBaz", "my_k::a", "k", "new", "PriceFeedActor", "logging", "pub(super)", True)


def test_cosine(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, 0.0])], "id int, embedding array<double>")
    got = {r["id"]: r["similarity"] for r in V.search(rows, [1.0, 0.0]).collect()}
    assert got == {1: 1.0, 5: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert V.embed_one("abc", 16) @ V.embed_one("abc", 16) == pytest.approx(1)


def test_patterns_are_checked():
    assert N.checked_pattern("a+") == "a+"
    with pytest.raises(ValueError):
        N.checked_pattern("a" * 1001)
    with pytest.raises(ValueError):
        N.checked_pattern("(?R)")


def test_invariants(spark, sf):
    from symloom.sources import star

    g = star.graph(spark, sf)
    plain = ids(g.functions.filter("not is_test"))
    with_t, without = ids(C.with_tests(g.functions, g.calls)), ids(C.without_tests(g.functions, g.calls))
    assert with_t | without == plain and not with_t & without
    every, untested = ids(C.most_referenced(g.functions, g.calls, limit=None)), ids(C.most_referenced_without_tests(g.functions, g.calls, limit=None))
    assert untested <= every and not ids(C.unreferenced(g.functions, g.calls)) & every
