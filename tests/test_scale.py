"""Plans and readers whose work must grow with the input and be dealt over tasks; answers are held against SQL in test_oracle."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from symloom import queries as Q
from symloom.model import SCHEMAS
from symloom.operators import actors as A
from symloom.operators import resolve as N
from symloom.plans import ingest
from symloom.sources import rust
from symloom.streaming import incremental
from symloom.streaming.incremental import Store
from symloom.streaming.links import TABLES, Links


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["J1_call_edges", "J2_unresolved_by_name", "J16_containing", "F2_targets"])
def test_functions_are_not_broadcast(name, spark, sf):
    assert "Broadcast" not in plan(Q.QUERIES[name](spark, sf))


@pytest.mark.parametrize(("name", "ends"), [("J2_unresolved_by_name", r"hashpartitioning\(src#\d+L?, dst#"), ("J17_constructor_calls", r"hashpartitioning\(macro_id#\d+, dst#")])
def test_repeats_go_before_names_are_matched(name, ends, spark, sf):
    """Edges are as many as a name's calls times its functions: they are not shuffled to find repeats."""
    assert re.search(ends, plan(Q.QUERIES[name](spark, sf))) is None


def test_edges_of_a_name_and_of_a_call_come_once(spark):
    f = spark.createDataFrame([(1, "a", "k::a", "k"), (2, "b", "k::b", "k"), (3, "b", "k::m::b", "k"), (4, "b", "o::b", "o")], "id long, name string, qualified_name string, crate string")
    calls = [("k::a", "b", "k", 7, None), ("k::a", "b", "k", 7, None), ("k::a", "k::b", "k", 7, 2), ("k::a", "b", "k", 8, 4), ("k::a", "k::b", "k", 9, 2), ("k::a", None, "k", 9, None), ("k::a", "b", None, 9, None), ("k::a", "x", "k", 9, 99), ("k::a", "b", "k", None, None), ("k::a", "k::b", "k", None, 2)]
    raw = spark.createDataFrame(calls, "caller string, callee_name string, crate string, line long, callee_id long")
    got = [tuple(r) for r in N.call_edges(raw, f).select("src", "dst", "line").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(1, 2, 7), (1, 3, 7), (1, 4, 8), (1, 2, 9), (1, 99, 9), (1, 2, None), (1, 3, None)}


def test_a_file_for_each_function_is_parsed_in_several_tasks(spark, sf):
    g = Q.star.graph(spark, sf)
    assert Q.items(g).rdd.getNumPartitions() >= 4
    per = Q.read_items(g, "macros").selectExpr("spark_partition_id() as p").distinct().count()
    assert per >= 4


def test_a_scan_gives_only_the_tables_that_are_asked_for(spark):
    rows = spark.createDataFrame([("/ws/k/src/a.rs", "k", "struct S; fn f() { g(); }"), (None, None, None)], "path string, crate string, text string")
    assert {r["table"] for r in rust.scan(rows, "types").collect()} == {"types"}
    assert {r["table"] for r in rust.scan(rows).collect()} == {"types", "functions", "raw_calls"}


def test_a_version_of_files_is_one_batch(spark, sf, monkeypatch):
    """As many batches as versions, not as files that the tasks wrote."""
    whole = Q.versions
    monkeypatch.setattr(Q, "versions", lambda *a: tuple(df.repartition(5, "path") for df in whole(*a)))
    rows = Q.QUERIES["I2_stream_once"](spark, sf)
    batches = {re.search(r"/batch=(\d+)/", f)[1] for f in rows.inputFiles()}
    assert batches == {"0", "1", "2"} or batches == {"0", "2"}  # a batch without rows may leave no file


def test_a_scan_hands_on_a_file_in_parts():
    """The rows of a large file are never held together."""
    source = "".join(f"fn f{k}() {{ a::b{k}(); }}\n" for k in range(3_000))
    most = total = 0
    for rows in rust.read(source, "/ws/k/src/a.rs", "k"):
        most, total = max(most, len(rows["raw_calls"])), total + len(rows["raw_calls"])
        for got in rows.values():
            got.clear()
    assert (most, total) == (1, 3_000)


@pytest.mark.parametrize("times", [1, 3])
def test_no_file_grows_with_the_tables(times, spark, sf):
    """Larger tables make more files of a module, not longer ones."""
    g = Q.star.graph(spark, sf)
    more = lambda df, *c: df.selectExpr("*", f"explode(sequence(0L, {times - 1}L)) as copy").withColumns({x: F.col(x) + F.col("copy") * Q.SPAN for x in c}).drop("copy")
    large = replace(g, functions=more(g.functions, "id"), calls=more(g.calls, "src", "dst"))
    longest = lambda g: Q.sources(g).selectExpr("max(length(text) - length(replace(text, 'fn f', 'n f')))").first()[0]
    assert longest(large) == longest(g)
    assert Q.sources(large).count() == times * Q.sources(g).count() == Q.sources(large).select("path").distinct().count()


def test_a_refresh_shuffles_texts_and_not_their_rows(spark, tmp_path):
    files = spark.createDataFrame([("/ws/k/src/a.rs", "k", "fn f() { g(); }")], "path string, crate string, text string")
    store = Store(spark, str(tmp_path))
    above, below = plan(store._scanned(files)).split("MapInArrow", 1)
    assert "Exchange" not in above and "Exchange" in below


def test_a_bucket_is_not_read_from_ever_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "FILES", 6)
    store = Store(spark, str(tmp_path), buckets=1)
    text = lambda k, n: (f"/ws/k/src/m{n}.rs", "k", f"fn f{k}() {{ g(); }}", datetime(2024, 1, 1))
    for k in range(5):
        store.refresh(spark.createDataFrame([text(k, n) for n in range(k, k + 9)], "path string, crate string, text string, mtime timestamp"), whole=False)
        assert len(store.symbols().inputFiles()) <= 6 + 2 * incremental.SPLIT + 4
    assert rust.tables(store.symbols())["functions"].count() == 13


def test_an_update_leaves_only_its_tables(spark, tmp_path):
    links = Links(spark, str(tmp_path), buckets=2)
    none = {t: spark.createDataFrame([], SCHEMAS[t]) for t in ("functions", "raw_calls", "imports")}
    one = none | {"functions": spark.createDataFrame([{"id": "f", "name": "f", "qualified_name": "k::f", "crate": "k", "file": "a", "line_start": 1, "is_trait_impl": False}], SCHEMAS["functions"])}
    links.apply(0, 1, spark.createDataFrame([("a",)], "path string"), none, one)
    assert {p.name for p in tmp_path.iterdir()} <= {*TABLES, "manifest", "notes"}
    assert not [p for p in tmp_path.glob("notes/**/*") if p.is_file()]


@pytest.mark.parametrize("n", [0, 1, 5_000])
def test_lines_of_a_diagram_meet_as_strings(n, spark):
    """The one row is made of the strings of ranges: no list of all lines is sorted in its task."""
    lines = [f"    a{k * 7919 % 5_003}{'é#'[k % 2]} --> b" for k in range(n)] + ["    A --> B"] * min(n, 2)
    got = A._diagram(spark.createDataFrame([(x,) for x in lines], "line string"), "graph TD")
    assert "flatten" not in plan(got) and "rangepartitioning(line" in plan(got)
    assert tuple(got.first()) == ("graph TD\n" + "\n".join(sorted(lines)), len(lines))


SOURCE = "use o::g as h; mod m { pub fn f() { self::k(); super::a(); g(); n::z(); } pub fn k() {} } pub fn a() { h(); h(); f(); m::k(); crate::m::f(); x.g(); lost(); }"


def test_calls_are_resolved_once(spark):
    """The edges' plan reads what calls were answered, not the calls again for each kind of answer."""
    built, _ = ingest.build(spark.createDataFrame([("/ws/k/src/lib.rs", "k", SOURCE)], "path string, crate string, text string"), width=8)
    assert "raw_calls" not in built.calls._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("scope", ["workspace", "crate"])
def test_edges_alone_are_those_of_the_resolved_calls(scope, spark):
    files = [("/ws/k/src/lib.rs", "k", SOURCE), ("/ws/o/src/lib.rs", "o", "pub fn g() { k::m::f(); a(); } pub fn f() { g() }"), ("/ws/o/src/n.rs", "o", "pub fn z() { f(); z(); lost(); } pub fn lost() {}")]
    t = rust.tables(rust.scan(spark.createDataFrame(files, "path string, crate string, text string")))
    functions, imports = ingest.definitions(t), N.import_table(t["imports"])
    whole = N.call_edges(ingest.scoped(N.resolve(ingest.named_calls(t["raw_calls"]), functions, imports), scope), functions)
    alone = N.named_edges(ingest.written_calls(t["raw_calls"]), functions, imports, scope)
    want = {tuple(r) for r in whole.select("src", "dst", "line").collect()}
    assert len(want) > 5 and {tuple(r) for r in alone.select("src", "dst", "line").collect()} == want


@pytest.mark.parametrize("same_crate", [True, False])
def test_actors_of_one_name_and_crate_are_one_end_of_a_route(same_crate, spark):
    actors = spark.range(60).selectExpr("id", "concat('a', id % 30) as name", "concat('k', id % 3) as crate")
    rows = lambda c: spark.range(60).selectExpr(f"id as {c}", "'Ping' as message_type")
    got = A.routes(actors, rows("sender"), rows("actor"), same_crate=same_crate)
    assert got.count() == got.distinct().count() == (300 if same_crate else 900)
