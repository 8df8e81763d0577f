"""Method-name facade: ``Engine.call(method, params)`` gives a DataFrame; ``respond`` wraps it in a JSON-RPC envelope.

Parameters are typed values, never spliced into query text. Unknown methods, bad parameters and failed runs have the codes -32601, -32602
and -32603.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.model import Graph
from symloom.operators import actors as A
from symloom.operators import architecture as R
from symloom.operators import coverage as C
from symloom.operators import impact as I
from symloom.operators import names as X
from symloom.operators import resolve as N
from symloom.operators import search as V
from symloom.operators import stats as S
from symloom.operators.predicates import in_file, named
from symloom.plans import ingest
from symloom.sources import rust
from symloom.sources.tables import scratch, stored
from symloom.streaming.incremental import Store, content_hash, file_report, outdated, statistics

UNKNOWN_METHOD, BAD_PARAMETERS, FAILED = -32601, -32602, -32603


class CallError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Engine:
    """``edge``: the columns that name a call edge. ``types`` and ``embeddings`` (id, embedding, crate) are optional tables. ``at``: where the graph
    was written; an index of its names there then answers for names until another graph is used."""

    def __init__(self, graph: Graph, *, types: DataFrame | None = None, embeddings: DataFrame | None = None, width: int = 384, edge: tuple[str, ...] = ("src", "dst", "line"), store: Store | None = None, at: str | None = None):
        self.width, self.edge, self.store = width, edge, store
        self.use(graph, types, embeddings)
        self.spark = graph.functions.sparkSession
        if at is not None and stored(self.spark, f"{at}/names.files"):
            self.names = f"{at}/names"
        self.methods: dict[str, Callable[..., DataFrame]] = {n.removeprefix("do_"): getattr(self, n) for n in dir(self) if n.startswith("do_")}

    def use(self, graph: Graph, types: DataFrame | None = None, embeddings: DataFrame | None = None) -> None:
        """Answer from ``graph`` from now on."""
        self.g, self.names = graph, None
        self.types = types if types is not None else graph.types
        self.embeddings = embeddings if embeddings is not None else graph.embeddings
        #: Functions of sources; those that were made up as callers or targets are called by nothing.
        self.written = graph.functions.filter(~F.coalesce("is_synthetic", F.lit(False))) if "is_synthetic" in graph.functions.columns else graph.functions

    def call(self, method: str, params: dict | None = None) -> DataFrame:
        f = self.methods.get(method)
        if f is None:
            raise CallError(UNKNOWN_METHOD, f"unknown method: {method}")
        try:
            bound = inspect.signature(f).bind(**(params or {}))
        except TypeError as e:
            raise CallError(BAD_PARAMETERS, str(e)) from e
        return f(*bound.args, **bound.kwargs)

    def respond(self, request: dict, most: int = 1000) -> dict:
        """A request's envelope with at most ``most`` rows; ``truncated`` tells whether there are more."""
        try:
            rows = self.call(request.get("method", ""), request.get("params")).limit(most + 1).toJSON().collect()
            return {"jsonrpc": "2.0", "id": request.get("id"), "result": [json.loads(x) for x in rows[:most]], "truncated": len(rows) > most}
        except CallError as e:
            return {"jsonrpc": "2.0", "id": request.get("id"), "error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # noqa: BLE001
            return {"jsonrpc": "2.0", "id": request.get("id"), "error": {"code": FAILED, "message": str(e)[:500]}}

    def matches(self, name: str) -> DataFrame:
        """id of the functions of a name, bare or part of the qualified one; by the index where there is one."""
        return X.find(self.spark, self.names, name) if self.names else self.g.functions.filter(named(name)).select("id")

    def _targets(self, name: str) -> DataFrame:
        return self.g.functions.filter(F.col("qualified_name") == name).select(F.col("id").alias("target"))

    def do_initialize(self) -> DataFrame:
        return S.graph_statistics(self.g)

    def do_workspace_context(self) -> DataFrame:
        return S.workspace_overview(self.g.functions, self.g.calls, self.g.crates)

    def do_analyze_change_impact(self, function: str, depth: int = 3, limit: int = 50) -> DataFrame:
        return I.impact(self.g.functions, self.g.calls, function, depth=depth, limit=limit, edge=self.edge)

    def do_analyze_batch_change_impact(self, functions: list, depth: int = 3, separate: bool = False) -> DataFrame:
        wanted = self.g.functions.filter(F.col("qualified_name").isin(*functions)).select(F.col("id").alias("target"))
        rows = I.batch_impact(self.g.functions, self.g.calls, wanted, depth=depth, edge=self.edge)
        return rows if separate else rows.drop("target").groupBy("id", "crate", "name", "qualified_name", "is_test", "line_start").agg(F.min("distance").alias("distance"))

    def do_analyze_file_changes(self, files: list, depth: int = 2) -> DataFrame:
        changed = self.g.functions.filter(in_file(files)).select(F.col("id").alias("target"))
        return I.batch_impact(self.g.functions, self.g.calls, changed, depth=depth, edge=self.edge)

    def do_discover_functions_from_diff(self, diff: str, with_impact: bool = False, depth: int = 2) -> DataFrame:
        found = I.diff_lookup(self.spark, self.g.functions, diff)
        return I.batch_impact(self.g.functions, self.g.calls, found.select(F.col("id").alias("target")), depth=depth, edge=self.edge) if with_impact else found.orderBy(F.desc("in_changed_file"), "id")

    def do_find_unreferenced_functions(self, exclude_public: bool = False, exclude_tests: bool = True, crate: str | None = None) -> DataFrame:
        return C.unreferenced(self.written, self.g.calls, exclude_public=exclude_public, exclude_tests=exclude_tests, crate=crate).orderBy("crate", "name", "id")

    def do_find_test_only_functions(self, include_public: bool = True, crate: str | None = None) -> DataFrame:
        return C.test_only(self.g.functions, self.g.calls, include_public=include_public, crate=crate)

    def do_find_functions_without_tests(self, crate: str | None = None, limit: int = 100) -> DataFrame:
        return C.without_tests(self.g.functions, self.g.calls, crate=crate, limit=limit)

    def do_find_functions_with_tests(self, crate: str | None = None, limit: int = 100) -> DataFrame:
        return C.with_tests(self.g.functions, self.g.calls, crate=crate, limit=limit)

    def do_find_most_referenced_functions(self, crate: str | None = None, limit: int = 10) -> DataFrame:
        return C.most_referenced(self.g.functions, self.g.calls, crate=crate, limit=limit)

    def do_find_most_referenced_without_tests(self, crate: str | None = None, limit: int = 10) -> DataFrame:
        return C.most_referenced_without_tests(self.g.functions, self.g.calls, crate=crate, limit=limit)

    def do_generate_actor_spawn_diagram(self) -> DataFrame:
        return A.spawn_diagram(self.g.actors, self.g.spawns)

    def do_generate_actor_message_diagram(self, method: str | None = None) -> DataFrame:
        return A.message_diagram(self.g.actors, self.g.sends, method=method)

    def do_generate_distributed_actor_message_flow(self) -> DataFrame:
        return A.flow_diagram(self.g.actors, self.g.sends)

    def do_get_actor_details(self, name: str) -> DataFrame:
        actors = self.g.actors.filter(F.col("name") == name)
        of = actors.select("id", "crate", F.col("name").alias("type_name"))
        more = {}
        if self.g.impls is not None:
            more["methods"] = N.methods_of(self.written, self.g.impls).join(of.withColumnRenamed("id", "actor"), ["crate", "type_name"]).select(F.col("actor").alias("id"), F.col("method").alias("name"))
            more["implements"] = self.g.impls.filter("trait_name is not null").join(of, ["crate", "type_name"]).select("id", F.col("trait_name").alias("name"))
        if self.types is not None:
            declared = self.types.select("crate", F.col("name").alias("type_name"), F.explode("fields").alias("field"))
            more["fields"] = declared.join(of, ["crate", "type_name"]).select("id", F.trim(F.split("field", ":")[0]).alias("name"))
        return A.details(actors, self.g.sends, self.g.handles, self.g.spawns, **more)

    def do_get_distributed_actors(self, crate: str | None = None, exclude_tests: bool = False, limit: int = 50) -> DataFrame:
        return A.distributed(self.g.actors, crate=crate, exclude_tests=exclude_tests, limit=limit)

    def do_debug_call_relationships(self) -> DataFrame:
        return S.call_dump(self.g.functions, self.g.calls)

    def do_analyze_symbol_impact(self, symbol: str) -> DataFrame:
        return S.symbol_impact(self.g.functions, self.g.calls, symbol, self.matches(symbol))

    def do_check_architecture_violations(self, severity: str | None = None, limit: int = 100) -> DataFrame:
        """The first ``limit`` violations, each with the number that there are."""
        rows = R.all_violations(self.g.functions, self.g.calls, self.g.crates, self.g.depends_on, severity=severity)
        shown = rows.orderBy("severity", "kind", "source", "target").limit(limit)
        return shown.crossJoin(F.broadcast(rows.agg(F.count("*").alias("of"))))  # one row

    def do_get_layer_health(self) -> DataFrame:
        return R.layer_health(R.layer_violations(self.g.functions, self.g.calls, self.g.crates), self.g.crates)

    def do_semantic_search(self, query: str, limit: int = 10, crate_filter: str | None = None) -> DataFrame:
        if self.embeddings is None:
            raise CallError(BAD_PARAMETERS, "no embeddings are loaded")
        return V.search_text(self.embeddings, query, width=self.width, k=limit, crate=crate_filter)

    def _listing(self, folder: str) -> tuple[Store, DataFrame]:
        if self.store is None:
            raise CallError(BAD_PARAMETERS, "no store is open")
        return self.store, rust.files(self.spark, folder).withColumn("mtime", F.current_timestamp())

    def do_incremental_update(self, folder: str) -> DataFrame:
        """Bring the store up to the files below a folder; counts of what it holds then. From a store with links, the graph that the other methods
        read is brought up too, over the edges that the store keeps."""
        store, listing = self._listing(folder)
        version = store.refresh(listing)
        if store.links is not None:
            # the dependencies of manifests stay; without any, those of the calls are taken
            kept = self.g.depends_on if "kind" in self.g.depends_on.columns else store.links.depends_on(version).select("src", "dst")
            graph, _ = ingest.link(rust.tables(store.symbols()), self.g.crates, kept, scope=store.links.scope, sources=listing, real=store.links.calls(version), width=self.width)
            at = scratch(self.spark, "graph")
            graph.write(at)
            self.use(Graph.read(self.spark, at))
        return statistics(rust.tables(store.symbols())["functions"], store.state())

    def do_incremental_file_analysis(self, folder: str, with_impact: bool = False, depth: int = 2) -> DataFrame:
        """Functions of each changed file, before and now; the store stays as it is. ``with_impact``: what the changed files' functions affect instead."""
        store, listing = self._listing(folder)
        stale = outdated(store.state(), content_hash(listing))
        if with_impact:
            changed = self.written.join(stale.withColumnRenamed("path", "file"), "file", "left_semi").select(F.col("id").alias("target"))
            return I.batch_summary(self.g.functions, self.g.calls, changed, depth=depth, edge=self.edge)
        now = listing.join(stale, "path", "left_semi")
        old = rust.tables(store.symbols())["functions"]
        return file_report(old.join(stale.withColumnRenamed("path", "file"), "file", "left_semi"), rust.tables(rust.scan(now))["functions"])

    def do_get_function_details(self, function: str) -> DataFrame:
        return S.function_details(self.g.functions, self.g.calls, function, self.matches(function) if self.names else None)

    def do_get_type_details(self, type_name: str) -> DataFrame:
        if self.types is None:
            raise CallError(BAD_PARAMETERS, "no types are loaded")
        return self.types.filter(named(type_name))

    def do_get_crate_overview(self, crate: str) -> DataFrame:
        return S.crate_overview(self.g.functions, self.g.calls, self.g.depends_on, crate)

    def do_list_functions(self, crate: str | None = None, limit: int = 20) -> DataFrame:
        return C.list_functions(self.g.functions, crate=crate, limit=limit)

    def do_debug_graph(self) -> DataFrame:
        return S.graph_statistics(self.g)

    def do_module_summary(self) -> DataFrame:
        return S.module_summary(self.g.functions)

    def do_check_dependency_issues(self) -> DataFrame:
        return R.cycles(self.g.depends_on)

    def do_analyze_test_coverage(self, examples: bool = False) -> DataFrame:
        """By crate; ``examples``: the most referenced functions that no test names, and that one does."""
        return C.coverage_examples(self.written, self.g.calls) if examples else C.coverage_by_crate(self.written)

    def do_analyze_actor_spawns(self, by: str = "parent") -> DataFrame:
        return A.spawn_groups(self.g.actors, self.g.spawns, by)


def serve(engine: Engine, lines: Iterable[str], out: TextIO) -> None:
    """One JSON request a line, one JSON answer a line; lines that are no JSON object are skipped."""
    for line in lines:
        try:
            request = json.loads(line)
        except ValueError:
            continue
        if isinstance(request, dict):
            out.write(json.dumps(engine.respond(request), default=str) + "\n")
            out.flush()


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
