"""Rust sources, manifests, ingest, the incremental store and the facade."""

from __future__ import annotations

import pytest

from symloom.model import Graph
from symloom.operators import resolve as N
from symloom.plans import ingest
from symloom.plans.engine import BAD_PARAMETERS, UNKNOWN_METHOD, Engine, explained
from symloom.sources import rust, workspace
from symloom.streaming.incremental import Store

LIB = '''
use crate::util::{helper as aid, Other};
/// Runs.
pub async fn run<T>(a: i64, items: Vec<(u8, u8)>) -> Result<i64, String> { aid(a); let s = "fn fake() {"; items.push(1); println!("x"); Worker::make(); Ok(1) }
pub struct Worker { pub a: u8 }
impl Worker { pub fn make() -> Self { Self::inner(); Worker { a: 1 } } fn inner() {} }
impl Actor for Worker { async fn on_start(&mut self) { let c = ChildActor::spawn(ChildActor::new()); child_ref.tell(PingMessage { x: 1 }).await; tokio::spawn(async {}); } }
impl Message<PingAsk> for Worker { type Reply = u32; async fn handle(&mut self, m: PingAsk) -> u32 { 1 } }
#[cfg(test)] mod tests { #[test] fn checks() { super::run(1, vec![]); } }
'''
UTIL = "pub fn helper(a: i64) { deep::down(); }\npub mod deep { pub fn down() {} }\nenum Kind { A, B(u8), C { x: i32 } }\ntrait Shape { fn area(&self) -> f64; }\n"


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "ws" / "my_crate" / "src"
    src.mkdir(parents=True)
    (src / "lib.rs").write_text(LIB)
    (src / "util.rs").write_text(UTIL)
    (tmp_path / "ws" / "my_crate" / "Cargo.toml").write_text('[package]\nname = "my_crate"\nversion = "1.2.0"\n[dependencies]\nserde = "1"\nother = { package = "other_crate", path = "../o" }\n[dev-dependencies]\ntempdir = "1"\n')
    return tmp_path / "ws"


def test_parse():
    r = rust.parse(LIB, "/ws/my_crate/src/lib.rs", "my_crate")
    f = {x["name"]: x for x in r["functions"]}
    assert set(f) == {"run", "make", "inner", "on_start", "handle", "checks"}
    assert f["run"]["is_async"] and f["run"]["is_generic"] and f["run"]["doc"] == "Runs." and f["run"]["return_type"] == "Result<i64, String>"
    assert [p["name"] for p in f["run"]["parameters"]] == ["a", "items"] and f["checks"]["is_test"] and f["make"]["qualified_name"] == "my_crate::Worker::make"
    c = {(x["callee_name"], x["call_type"]) for x in r["raw_calls"]}
    assert {("aid", "Direct"), ("push", "Method"), ("Worker::make", "Associated"), ("println!", "Macro"), ("Worker::inner", "Associated")} <= c and not any("fake" in x for x, _ in c)
    assert [(x["parent"], x["child"], x["context"]) for x in r["spawns"]] == [("Worker", "ChildActor", "on_start:on_start")]
    assert [(x["message_type"], x["method"], x["receiver"]) for x in r["sends"]] == [("PingMessage", "Tell", "Child")]
    assert [(x["actor"], x["message_type"], x["reply_type"]) for x in r["handles"]] == [("Worker", "PingAsk", "u32")]
    assert {(i["name"], i["alias"]) for x in r["imports"] for i in x["items"]} == {("helper", "aid"), ("Other", None)}


def test_types_and_traits():
    r = rust.parse(UTIL, "/ws/k/src/util.rs", "k")
    t = {x["name"]: x for x in r["types"]}
    assert t["Kind"]["variants"] == ["A", "B", "C"] and t["Shape"]["kind"] == "Trait" and t["Shape"]["methods"] == ["area"]
    assert {x["qualified_name"] for x in r["functions"]} == {"k::util::helper", "k::util::deep::down", "k::util::Shape::area"}


@pytest.mark.parametrize("source", ["", "fn", "fn f(", "impl {", "use ;", "}}}", "struct S", "fn f() { x!( }", '"open', "#[", "pub", "mod m {", "'", "r#\"", "enum E { A("])
def test_broken_sources_end(source):
    rust.parse(source, "x.rs", "k")


def test_populate_and_engine(spark, tree, tmp_path):
    g = ingest.populate(spark, str(tree), str(tmp_path / "out"))
    assert isinstance(g, Graph)
    name = {r["id"]: r["qualified_name"] for r in g.functions.collect()}
    edges = {(name[r["src"]], name[r["dst"]]) for r in g.calls.collect()}
    assert {("my_crate::run", "my_crate::util::helper"), ("my_crate::util::helper", "my_crate::util::deep::down"), ("my_crate::run", "my_crate::Worker::make"), ("my_crate::Worker::make", "my_crate::Worker::inner")} <= edges
    e = Engine(g)
    hit = {r["qualified_name"]: r["distance"] for r in e.call("analyze_change_impact", {"function": "my_crate::util::deep::down"}).collect()}
    assert hit["my_crate::util::helper"] == 1 and hit["my_crate::run"] == 2
    assert e.respond({"id": 1, "method": "nope"})["error"]["code"] == UNKNOWN_METHOD
    assert e.respond({"id": 1, "method": "list_functions", "params": {"x": 1}})["error"]["code"] == BAD_PARAMETERS
    assert e.respond({"id": 2, "method": "get_function_details", "params": {"function": "helper"}})["result"][0]["callers"] == 1
    for m in ("initialize", "workspace_context", "find_unreferenced_functions", "generate_actor_spawn_diagram", "generate_actor_message_diagram", "get_layer_health", "list_functions", "check_architecture_violations"):
        assert "result" in e.respond({"id": 3, "method": m}), m
    assert "Scan" in explained(g.functions)


def test_workspace(spark, tree):
    found = workspace.manifests(spark, str(tree))
    c = workspace.Config.loads('[analysis]\ninclude_dev_deps = true\nexclude_crates = ["ser*"]\n[architecture]\nlayers = [{name = "base", crates = ["my*"]}]\n')
    crates, deps = workspace.discover(found, c)
    assert {r["name"]: r["is_external"] for r in crates.collect()} == {"my_crate": False, "serde": True, "other_crate": True, "tempdir": True}
    assert {(r["dst"], r["kind"]) for r in deps.collect()} == {("serde", "normal"), ("other_crate", "normal"), ("tempdir", "dev")}
    assert [r["pattern"] for r in c.layer_rows(spark).collect()] == ["my*"]
    members = workspace.Config.loads("[analysis]\nworkspace_members_only = true\n")
    assert members.members_only and [r["name"] for r in workspace.discover(found, members)[0].collect()] == ["my_crate"]
    row = spark.range(1).select(*[x.alias(n) for x, n in zip(workspace.package_id(__import__("pyspark").sql.functions.lit("path+file:///a/b#k@1.0")), ("p", "n", "v"), strict=True)]).first()
    assert tuple(row) == ("/a/b", "k", "1.0")


SPAWN = """
use kameo::Actor;
async fn main() {{ {} }}
"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("let a = PriceActor::spawn(PriceActor::new());", [("PriceActor", "DirectType")]),
        ("MySupervisor::spawn_link(&parent, args).await;", [("MySupervisor", "DirectType")]),
        ("FeedAgent::spawn_with_storage(x); OrderManagerRef::spawn_in_thread(y);", [("FeedAgent", "DirectType"), ("OrderManagerRef", "DirectType")]),
        ("Actor::spawn(PriceActor::new());", [("PriceActor", "TraitMethod")]),
        ("Actor::spawn(price_feed_actor);", [("PriceFeedActor", "TraitMethod")]),
        ("kameo::actor::spawn(PriceActor::default()); kameo::actor::spawn_with_mailbox(FeedWorker::create(1), m);", [("PriceActor", "ModuleFunction"), ("FeedWorker", "ModuleFunction")]),
        ("bastion::any::spawn(feed_worker); riker::actor::spawn(PriceActor::new());", [("FeedWorker", "ModuleFunction"), ("PriceActor", "ModuleFunction")]),
        ("tokio::spawn(async {}); std::thread::spawn(f); tokio::task::spawn_blocking(f); rayon::spawn(f); smol::spawn(f); executor::spawn(f); async_std::task::spawn(f);", []),
        ("Handle::spawn(x); Actor::spawn(thing); Message::spawn(x); Handler::spawn(x); PriceActor::start(x); lower_actor::spawn(x);", []),
    ],
)
def test_spawns(body, want):
    r = rust.parse(SPAWN.format(body), "/ws/k/src/main.rs", "k")
    assert [(x["child"], x["pattern"]) for x in r["spawns"]] == want and all(x["context"] == "main_function:main" for x in r["spawns"])
    assert rust.parse(SPAWN.format(body), "/ws/k/src/feed_test.rs", "k")["spawns"] == rust.parse(SPAWN.format(body).replace("main", "setup_it"), "/ws/k/src/a.rs", "k")["spawns"] == []


ACTORS = """
pub struct A { b: ActorRef<B>, far_ref: Option<kameo::actor::ActorRef<Far<u8>>> }
impl Actor for A { async fn on_start(&mut self, me: ActorRef<Self>) { let msg: Tick = make(); let next = Tock { at: 1 }; let c = C::spawn(C::new());
  self.b.tell(Ping).await; b_actor.tell(Pong { x: 1 }).await; self.far.tell(msg).await; self.far_ref.ask(next).await; c.ask(Query::new(1)).await; ctx.tell(Own).await; my_ctx.clone().tell(Own2).await; who.tell(Lost).await; } }
impl Actor for B {}
impl Message<Ping> for B { type Reply = (); async fn handle(&mut self, p: Ping) {} }
impl Actor for C {}
"""


def test_receivers():
    """A field, a name, a declared variable, a spawned one, the actor's own context, and one that nothing tells."""
    r = rust.parse(ACTORS, "/ws/k/src/lib.rs", "k")
    got = {x["message_type"]: (x["sender"], x["receiver"], x["method"]) for x in r["sends"]}
    assert got == {"Ping": ("A", "B", "Tell"), "Pong": ("A", "B", "Tell"), "Tick": ("A", "Far", "Tell"), "Tock": ("A", "Far", "Ask"), "Query": ("A", "C", "Ask"), "Own": ("A", "A", "Tell"), "Own2": ("A", "A", "Tell"), "Lost": ("A", "Unknown", "Tell")}


def test_diagrams_of_sources(spark):
    sources = spark.createDataFrame([("/ws/k/src/lib.rs", "k", ACTORS)], "path string, crate string, text string")
    g, _ = ingest.build(sources, width=8)
    e = Engine(g, width=8)
    row = e.call("generate_actor_message_diagram").first()
    assert row["n_lines"] == 5 and "    A -->|Ping tell:1 ask:0| B" in row["diagram"] and "    A -->|Own tell:1 ask:0| A" in row["diagram"]
    d = e.call("get_actor_details", {"name": "A"}).first()
    assert (d["methods"], d["fields"], d["implements"], d["sends_to"], d["receives_from"]) == ("on_start", "b,far_ref", "Actor", "k:A,k:B,k:C,k:Far,k:Unknown", "k:A")


GENERATED = """
pub struct Alma { a: u8 }
impl Alma { pub fn new(a: u8) -> Self { Alma { a } } pub fn from_ohlcv() {} pub fn lonely() {} }
impl Default for Alma { fn default() -> Self { Alma::new(1) } }
impl fmt::Display for Alma { fn fmt(&self, f: &mut F) {} }
impl WebSocketActor for Alma { fn connect(&self) {} fn event_stream(&self) {} fn odd(&self) {} }
impl Life for Alma { fn started(&self) {} }
macro_rules! all { ($i:ident) => { paste! { [<$i Input>]::from_ohlcv(1) } } }
pub fn calculate() { paste! { [<$x>]::new(inner::deep(1)) } paste! { [<$x Input>]::from_ohlcv(2) } }
pub fn deep() {} fn go() { x.start(); }
"""


def test_generated_calls_are_callers(spark):
    """What macros, traits and frameworks call is not unreferenced; what nothing calls is."""
    sources = spark.createDataFrame([("/ws/k/src/ind.rs", "k", GENERATED), ("/ws/other/src/lib.rs", "other", "pub struct Alma; impl Alma { pub fn new() {} pub fn fmt() {} }")], "path string, crate string, text string")
    g, _ = ingest.build(sources, width=8)
    e = Engine(g, width=8)
    loose = {r["qualified_name"] for r in e.call("find_unreferenced_functions").collect()}
    assert loose == {"k::ind::Alma::lonely", "k::ind::Alma::odd", "k::ind::calculate", "k::ind::deep", "k::ind::go", "other::Alma::new", "other::Alma::fmt"}
    name = {r["id"]: r["qualified_name"] for r in g.functions.collect()}
    made = {(name[r["src"]], name[r["dst"]]) for r in g.calls.filter("is_synthetic").collect()}
    assert {("k::ind::calculate", "k::ind::Alma::new"), ("k::ind::calculate", "k::ind::Alma::from_ohlcv"), ("trait_caller::Default::default", "k::ind::Alma::default"), ("trait_caller::Display::fmt", "k::ind::Alma::fmt"), ("websocket_framework::websocket_dispatch", "k::ind::Alma::event_stream"), ("actix_framework::lifecycle_dispatch", "k::ind::Alma::started")} <= made
    assert ("trait_caller::WebSocketActor::subscribe", "Alma::subscribe") in made  # a target that no source defines is made
    plain, _ = ingest.build(sources, synthetic=False, width=8)
    assert plain.calls.filter("is_synthetic").count() == 0 and "k::ind::Alma::default" in {r["qualified_name"] for r in Engine(plain).call("find_unreferenced_functions").collect()}
    inside = {r["function_id"] for r in g.macros.filter("name = 'paste' and line = 9").collect()}
    assert inside == {"k:k::ind::calculate:9"}


def test_types_and_embeddings_are_loaded(spark, tree, tmp_path):
    e = Engine(ingest.populate(spark, str(tree), str(tmp_path / "out"), width=16), width=16)
    assert e.call("get_type_details", {"type_name": "Kind"}).first()["variants"] == ["A", "B", "C"]
    hits = e.call("semantic_search", {"query": "crate: my_crate | type: Shape | kind: Trait | module: util", "limit": 2}).collect()
    assert "Shape" in hits[0]["id"]


def test_comments_nest():
    got = rust.parse("/* x /* y */ hidden(); */ fn f() { /** inner /* a */ b() */ seen(); } /* open /* */ fn g() {}", "a.rs", "k")
    assert [r["name"] for r in got["functions"]] == ["f"] and [r["callee_name"] for r in got["raw_calls"]] == ["seen"]
    assert rust.parse("/** Doc /* in */ it. */ pub struct S;", "a.rs", "k")["types"][0]["doc"].startswith("Doc")


def test_a_bad_file_does_not_stop_the_others(spark):
    """Files of every broken kind beside a good one: its symbols come, and the file that could not be read to its end has a row."""
    deep = "fn first() {} " + "mod m { " * 1500 + "fn low() {}" + " }" * 1500
    bad = [("deep.rs", deep), ("open.rs", "fn a( {"), ("quote.rs", 'fn b() { "'), ("comment.rs", "fn c() {} /* "), ("none.rs", None), ("odd.rs", "\x00\uffff }}}} fn d() {} )))")]
    df = spark.createDataFrame([("good.rs", "k", "fn good() { first(); }"), *[(p, "k", t) for p, t in bad]], "path string, crate string, text string")
    got = rust.tables(rust.scan(df))
    names = {(r["file"], r["name"]) for r in got["functions"].collect()}
    assert {("good.rs", "good"), ("deep.rs", "first"), ("comment.rs", "c")} <= names
    assert [r["file"] for r in got["errors"].collect()] == ["deep.rs"]


def test_merged_definitions(spark):
    rows = [("k::f", line, line == 14) for line in (10, 14, 16, 20)] + [("k::g", 1, False)]
    got = {(r["qualified_name"], r["line_start"]): (r["merged"], r["is_trait_impl"]) for r in N.consolidated(spark.createDataFrame(rows, "qualified_name string, line_start long, is_trait_impl boolean")).collect()}
    assert got == {("k::f", 10): (2, True), ("k::f", 16): (2, False), ("k::g", 1): (1, False)}


LISTING = "path string, crate string, text string, mtime timestamp"


def test_store(spark, tmp_path):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    s = Store(spark, str(tmp_path / "store"))
    names = lambda: {r["name"] for r in rust.tables(s.symbols())["functions"].collect()}
    s.refresh(spark.createDataFrame([("a.rs", "k", "fn one() {}", t), ("b.rs", "k", "fn two() {}", t)], LISTING))
    assert names() == {"one", "two"}
    s.refresh(spark.createDataFrame([("a.rs", "k", "fn one() {}", t), ("c.rs", "k", "fn three() {}", t)], LISTING))
    assert names() == {"one", "three"} and s.state().count() == 2
    one = spark.createDataFrame([("a.rs", "k", "fn uno() {}", t)], LISTING)
    v = s.refresh(one, whole=False, batch="feed#0")
    assert names() == {"uno", "three"}
    assert Store(spark, s.root).refresh(one, whole=False, batch="feed#0") == v  # after a restart
    assert Store(spark, s.root).refresh(one, whole=False, batch="feed#1") == v + 1 and names() == {"uno", "three"}


def test_a_refresh_writes_the_touched_buckets_only(spark, tmp_path):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = [(f"{k}.rs", "k", f"fn f{k}() {{}}", t) for k in range(40)]
    s = Store(spark, str(tmp_path / "store"), buckets=8)
    s.refresh(spark.createDataFrame(rows, LISTING))
    s.refresh(spark.createDataFrame([("3.rs", "k", "fn g() {}", t)], LISTING), whole=False)
    assert len(list((tmp_path / "store" / "symbols" / "v1").glob("bucket=*"))) == 8 and len(list((tmp_path / "store" / "symbols" / "v2").glob("bucket=*"))) == 1
    assert {r["name"] for r in rust.tables(s.symbols())["functions"].collect()} == {f"f{k}" for k in range(40) if k != 3} | {"g"}
    s.refresh(spark.createDataFrame([], LISTING))
    assert s.symbols().count() == 0 and s.state().count() == 0


def test_stream_equals_batch(spark, tree, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.watch(str(tree), str(tmp_path / "ckpt")).awaitTermination()
    batch = {r["id"] for r in rust.tables(rust.scan(rust.files(spark, str(tree))))["functions"].collect()}
    assert {r["id"] for r in rust.tables(s.symbols())["functions"].collect()} == batch


def test_engine_over_a_store(spark, tree, tmp_path):
    import io
    import json

    from symloom.plans.engine import serve

    g = ingest.populate(spark, str(tree), str(tmp_path / "out"))
    e = Engine(g, store=Store(spark, str(tmp_path / "store")))
    first = e.call("incremental_update", {"folder": str(tree)}).first()
    assert first["files"] == 2 and first["symbols"] == g.functions.filter("not is_synthetic").count()
    (tree / "my_crate" / "src" / "util.rs").write_text("pub fn helper(a: i64) {}\n")
    report = {r["path"].rpartition("/")[2]: (r["before"], r["after"]) for r in e.call("incremental_file_analysis", {"folder": str(tree)}).collect()}
    assert report == {"util.rs": (3, 1)}
    hit = e.call("incremental_file_analysis", {"folder": str(tree), "with_impact": True}).collect()
    assert len(hit) == 3 and max(r["affected"] for r in hit) >= 2
    out = io.StringIO()
    serve(e, ['{"id": 1, "method": "get_function_details", "params": {"function": "helper"}}', "no json", '{"id": 2, "method": "incremental_update"}'], out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert answers[0]["result"] and answers[1]["error"]["code"] == BAD_PARAMETERS


def test_cached_tables(spark, tmp_path):
    from symloom.sources.tables import cached, content_key

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    made = []

    def make():
        made.append(1)
        return rows

    key = content_key(rows, "k", "v")
    assert key == content_key(rows.orderBy("v", ascending=False), "k", "v") != content_key(rows.filter("k = 1"), "k", "v")
    assert [cached(spark, str(tmp_path), key, make).count() for _ in range(2)] == [2, 2] and made == [1]


def test_command_line(spark, tree, tmp_path, capfd):
    from symloom.__main__ import main

    out = str(tmp_path / "out")
    assert main(["analyze", str(tree), out]) == 0
    assert main(["impact", f"{out}/graph", "my_crate::util::deep::down"]) == 0
    assert main(["health", f"{out}/graph"]) == 0
    assert "my_crate::util::helper" in capfd.readouterr().out
