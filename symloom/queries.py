"""Operator queries over the star projection, each with the same question in another engine's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions import text as T
from symloom.model import SCHEMAS, Graph
from symloom.operators import actors as A
from symloom.operators import architecture as R
from symloom.operators import coverage as C
from symloom.operators import impact as I
from symloom.operators import names as X
from symloom.operators import resolve as N
from symloom.operators import search as V
from symloom.operators import stats as S
from symloom.operators.predicates import in_file, named, topk
from symloom.plans import ingest
from symloom.sources import clustered, rust, star, workspace
from symloom.sources.tables import discard, release, scratch
from symloom.streaming import feed as Y
from symloom.streaming import incremental as W
from symloom.streaming.links import Links

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, star_sql: bool = True) -> Callable:
    """Registers a function of (graph, spark, sf_dir); ``sql`` follows the projection's common tables."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(star.graph(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            ORACLES[name] = (star.SQL + sql) if star_sql else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return star.table(spark, sf_dir, name)


# -- coverage

@query("A1_unreferenced", "SELECT id, crate, name, qualified_name, line_start, visibility FROM functions f WHERE NOT is_test AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst = f.id)")
def _(g: Graph, *_):
    return C.unreferenced(g.functions, g.calls)


@query("A1_unreferenced_not_public", "SELECT id, crate, name, qualified_name, line_start, visibility FROM functions f WHERE visibility <> 'pub' AND crate = 'Brand#7' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst = f.id)")
def _(g: Graph, *_):
    return C.unreferenced(g.functions, g.calls, exclude_public=True, exclude_tests=False, crate="Brand#7")


@query("A2_unused_public", "SELECT id, crate || '::' || name AS function FROM functions f WHERE visibility = 'pub' AND name NOT IN ('main', 'test') AND NOT is_test AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst = f.id)")
def _(g: Graph, *_):
    return C.unused_public(g.functions, g.calls)


@query("A3_test_only", "SELECT f.id, f.crate, f.name, f.qualified_name, f.line_start, count(*) AS caller_count FROM functions f JOIN calls c ON c.dst = f.id JOIN functions s ON s.id = c.src GROUP BY ALL HAVING bool_and(s.is_test)")
def _(g: Graph, *_):
    return C.test_only(g.functions, g.calls)


@query("A4_without_tests", "SELECT id, crate, name, qualified_name, line_start FROM functions f WHERE NOT is_test AND NOT EXISTS (SELECT 1 FROM calls c JOIN functions s ON s.id = c.src WHERE c.dst = f.id AND s.is_test)")
def _(g: Graph, *_):
    return C.without_tests(g.functions, g.calls)


@query("A4_without_tests_top", "SELECT id, crate, name, qualified_name, line_start FROM functions f WHERE NOT is_test AND NOT EXISTS (SELECT 1 FROM calls c JOIN functions s ON s.id = c.src WHERE c.dst = f.id AND s.is_test) ORDER BY qualified_name, id LIMIT 100")
def _(g: Graph, *_):
    return C.without_tests(g.functions, g.calls, limit=100)


@query("A5_with_tests", "SELECT f.id, f.crate, f.name, f.qualified_name, f.line_start, count(*) AS test_count FROM functions f JOIN calls c ON c.dst = f.id JOIN functions s ON s.id = c.src WHERE s.is_test AND NOT f.is_test GROUP BY ALL")
def _(g: Graph, *_):
    return C.with_tests(g.functions, g.calls)


@query("A6_most_referenced", "SELECT f.id, f.crate, f.name, f.qualified_name, f.line_start, count(*) AS reference_count FROM functions f JOIN calls c ON c.dst = f.id GROUP BY ALL ORDER BY reference_count DESC, id LIMIT 10")
def _(g: Graph, *_):
    return C.most_referenced(g.functions, g.calls)


@query("A7_most_referenced_without_tests", "SELECT f.id, f.crate, f.name, f.qualified_name, f.line_start, count(*) AS reference_count FROM functions f JOIN calls c ON c.dst = f.id WHERE NOT f.is_test AND NOT EXISTS (SELECT 1 FROM calls x JOIN functions s ON s.id = x.src WHERE x.dst = f.id AND s.is_test) GROUP BY ALL ORDER BY reference_count DESC, id LIMIT 10")
def _(g: Graph, *_):
    return C.most_referenced_without_tests(g.functions, g.calls)


@query("A16_coverage_by_crate", """, tested AS (
  SELECT DISTINCT f.crate, f.name FROM functions f JOIN functions t ON t.crate = f.crate AND t.is_test AND contains('test_' || t.name, f.name) WHERE NOT f.is_test)
SELECT f.crate, count(*) AS total, count(t.name) AS tested, CAST(floor(100 * count(t.name) / count(*)) AS BIGINT) AS percent
FROM functions f LEFT JOIN tested t ON t.crate = f.crate AND t.name = f.name WHERE NOT f.is_test GROUP BY f.crate""")
def _(g: Graph, *_):
    return C.coverage_by_crate(g.functions)


@query("T6_coverage_examples", """, tested AS (
  SELECT DISTINCT f.crate, f.name FROM functions f JOIN functions t ON t.crate = f.crate AND t.is_test AND contains('test_' || t.name, f.name) WHERE NOT f.is_test),
r AS (SELECT f.id, f.crate, f.name, f.qualified_name, f.line_start, count(*) AS reference_count, (f.crate, f.name) IN (SELECT (crate, name) FROM tested) AS t FROM functions f JOIN calls c ON c.dst = f.id WHERE NOT f.is_test GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY reference_count DESC, id) AS k FROM r)
SELECT id, crate, name, qualified_name, line_start, reference_count, CASE WHEN t THEN 'well_tested' ELSE 'priority_untested' END AS kind FROM k WHERE k <= CASE WHEN t THEN 10 ELSE 15 END""")
def _(g: Graph, *_):
    return C.coverage_examples(g.functions, g.calls)


@query("A19_sample_per_crate", "SELECT crate, k, id, qualified_name FROM (SELECT *, CAST(row_number() OVER (PARTITION BY crate ORDER BY qualified_name, id) AS INT) AS k FROM functions) WHERE k <= 5")
def _(g: Graph, *_):
    return C.sample_per_crate(g.functions, per_crate=5)


@query("A20_high_coupling", "SELECT f.id, f.qualified_name, count(DISTINCT c.src) AS callers FROM functions f JOIN calls c ON c.dst = f.id GROUP BY ALL HAVING count(DISTINCT c.src) > 3")
def _(g: Graph, *_):
    return C.high_coupling(g.functions, g.calls, more_than=3)


@query("J9_direct_tests", "SELECT DISTINCT f.id, f.crate, f.name, f.qualified_name, f.line_start FROM calls c JOIN functions f ON f.id = c.src WHERE f.is_test AND c.dst = 7")
def _(g: Graph, *_):
    return C.direct_tests(g.functions, g.calls, 7)


@query("T7_list_functions", "SELECT id, crate, name, qualified_name, line_start, (SELECT count(*) FROM functions) AS total, (SELECT count(*) FROM functions WHERE crate = 'Brand#7') AS filtered FROM functions WHERE crate = 'Brand#7' ORDER BY qualified_name, id LIMIT 20")
def _(g: Graph, *_):
    return C.list_functions(g.functions, crate="Brand#7")


@query("J7_callers_optional", "SELECT f.id, c.src FROM functions f LEFT JOIN calls c ON c.dst = f.id")
def _(g: Graph, *_):
    return g.functions.join(g.calls.select(F.col("dst").alias("id"), "src"), "id", "left").select("id", "src")


@query("J8_test_callers_optional", "SELECT f.id, count(s.id) AS tests FROM functions f LEFT JOIN calls c ON c.dst = f.id LEFT JOIN functions s ON s.id = c.src AND s.is_test GROUP BY f.id")
def _(g: Graph, *_):
    return g.functions.select("id").join(C.tests_of(g.functions, g.calls), "id", "left").select("id", F.coalesce("test_count", F.lit(0)).alias("tests"))


@query("F2_named", "SELECT id, name, qualified_name FROM functions WHERE name = 'red widget' OR contains(qualified_name, '::12')")
def _(g: Graph, *_):
    return g.functions.filter(named("red widget") | F.col("qualified_name").contains("::12")).select("id", "name", "qualified_name")


@query("F3_in_file", "SELECT id, file FROM functions WHERE file LIKE '%Brand#7/src/small.rs' OR file LIKE '%src/economy.rs'")
def _(g: Graph, *_):
    return g.functions.filter(in_file(["/Brand#7/src/small.rs", "src/economy.rs"])).select("id", "file")


# -- impact

IMPACT = """, paths AS (
  SELECT t.id AS target, c.src AS id, 1 AS distance, [(c.order_key, c.seq)] AS path FROM ({targets}) t JOIN calls c ON c.dst = t.id
  UNION ALL
  SELECT p.target, c.src, p.distance + 1, list_append(p.path, (c.order_key, c.seq)) FROM paths p JOIN calls c ON c.dst = p.id
  WHERE p.distance < {depth} AND NOT list_contains(p.path, (c.order_key, c.seq)))"""
HOT = "SELECT dst AS id FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1"


def hottest(g: Graph, k: int = 1) -> DataFrame:
    return g.calls.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(k).select(F.col("dst").alias("target"))


@query("G1_impact_d3", IMPACT.format(targets=HOT, depth=3) + " SELECT DISTINCT p.target, f.id, f.crate, f.name, f.qualified_name, f.is_test, f.line_start, p.distance FROM paths p JOIN functions f ON f.id = p.id")
def _(g: Graph, *_):
    return I.batch_impact(g.functions, g.calls, hottest(g))


@query("G2_batch_impact", IMPACT.format(targets="SELECT dst AS id FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5", depth=3) + """ SELECT t.target, true AS found, count(DISTINCT p.id) AS affected, count(DISTINCT CASE WHEN f.is_test THEN p.id END) AS tests, max(p.distance) AS farthest
  FROM (SELECT dst AS target FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5) t JOIN paths p ON p.target = t.target JOIN functions f ON f.id = p.id GROUP BY t.target""")
def _(g: Graph, *_):
    return I.batch_summary(g.functions, g.calls, hottest(g, 5))


@query("G3_separate_impact", IMPACT.format(targets="SELECT dst AS id FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 3", depth=2) + " SELECT DISTINCT p.target, f.id, f.crate, f.name, f.qualified_name, f.is_test, f.line_start, p.distance FROM paths p JOIN functions f ON f.id = p.id")
def _(g: Graph, *_):
    return I.batch_impact(g.functions, g.calls, hottest(g, 3), depth=2)


@query("G4_file_impact", IMPACT.format(targets="SELECT id FROM functions WHERE file LIKE '%Brand#7/src/small.rs'", depth=2) + """ SELECT t.id AS target, true AS found, count(DISTINCT p.id) AS affected, count(DISTINCT CASE WHEN f.is_test THEN p.id END) AS tests, coalesce(max(p.distance), 0) AS farthest
  FROM functions t LEFT JOIN paths p ON p.target = t.id LEFT JOIN functions f ON f.id = p.id WHERE t.file LIKE '%Brand#7/src/small.rs' GROUP BY t.id""")
def _(g: Graph, *_):
    return I.file_impact(g.functions, g.calls, ["Brand#7/src/small.rs"])


DIFF = """diff --git a/ws/Brand#7/src/small.rs b/ws/Brand#7/src/small.rs
--- a/ws/Brand#7/src/small.rs
+++ b/ws/Brand#7/src/small.rs
@@ -1,2 +1,2 @@
-fn red(a: u8) {
+fn ring<T>(a: u8) {
 fn unchanged() {
"""


@query("J23_diff_lookup", "SELECT id, w AS name, qualified_name, file LIKE '%ws/Brand#7/src/small.rs' AS in_changed_file FROM (SELECT *, split_part(name, ' ', 2) AS w FROM functions) WHERE w IN ('red', 'ring')")
def _(g: Graph, spark: SparkSession, _d):
    return I.diff_lookup(spark, g.functions.withColumn("name", T.segment(F.col("name"), 2, " ")), DIFF)


@query("G5_diff_impact", ", named AS (SELECT id FROM functions WHERE split_part(name, ' ', 2) IN ('red', 'ring'))" + IMPACT.format(targets="SELECT id FROM named", depth=2) + """ SELECT t.id AS target, true AS found, count(DISTINCT p.id) AS affected, count(DISTINCT CASE WHEN f.is_test THEN p.id END) AS tests, coalesce(max(p.distance), 0) AS farthest
  FROM named t LEFT JOIN paths p ON p.target = t.id LEFT JOIN functions f ON f.id = p.id GROUP BY t.id""")
def _(g: Graph, spark: SparkSession, _d):
    return I.diff_impact(spark, g.functions.withColumn("name", T.segment(F.col("name"), 2, " ")), g.calls, DIFF)


# -- architecture

VIOLATIONS = """, closure AS (SELECT src, dst FROM depends_on UNION SELECT c.src, d.dst FROM closure c JOIN depends_on d ON d.src = c.dst),
rings AS (SELECT DISTINCT a.src AS crate1, b.dst AS crate2 FROM depends_on a JOIN closure b ON b.src = a.dst JOIN closure k ON k.src = b.dst AND k.dst = a.src),
layer_v AS (
  SELECT 'layer_violation' AS kind, f.qualified_name AS source, t.qualified_name AS target, CAST(x.layer AS VARCHAR) AS from_layer, CAST(y.layer AS VARCHAR) AS to_layer, f.crate AS from_crate, t.crate AS to_crate, 'Error' AS severity
  FROM calls c JOIN functions f ON f.id = c.src JOIN functions t ON t.id = c.dst JOIN crates x ON x.name = f.crate JOIN crates y ON y.name = t.crate WHERE x.layer < y.layer),
reverse_v AS (
  SELECT 'reverse_dependency' AS kind, d.src AS source, d.dst AS target, CAST(x.layer AS VARCHAR) AS from_layer, CAST(y.layer AS VARCHAR) AS to_layer, d.src AS from_crate, d.dst AS to_crate, 'Error' AS severity
  FROM depends_on d JOIN crates x ON x.name = d.src JOIN crates y ON y.name = d.dst WHERE x.layer < y.layer),
private_v AS (
  SELECT 'private_api_access' AS kind, f.qualified_name AS source, t.qualified_name AS target, 'unknown' AS from_layer, 'unknown' AS to_layer, f.crate AS from_crate, t.crate AS to_crate, 'Warning' AS severity
  FROM calls c JOIN functions f ON f.id = c.src JOIN functions t ON t.id = c.dst WHERE f.crate <> t.crate AND t.visibility <> 'pub' AND t.visibility NOT LIKE 'pub(%'),
all_v AS (SELECT * FROM layer_v UNION ALL SELECT 'circular_dependency', crate1, crate2, 'unknown', 'unknown', crate1, crate2, 'Error' FROM rings UNION ALL SELECT * FROM reverse_v UNION ALL SELECT * FROM private_v)
"""


def violations(g: Graph) -> DataFrame:
    return R.all_violations(g.functions, g.calls, g.crates, g.depends_on)


@query("J4_layer_violations", VIOLATIONS + "SELECT * FROM layer_v")
def _(g: Graph, *_):
    return R.layer_violations(g.functions, g.calls, g.crates)


@query("J5_reverse_dependencies", VIOLATIONS + "SELECT * FROM reverse_v")
def _(g: Graph, *_):
    return R.reverse_dependencies(g.crates, g.depends_on)


@query("J6_private_access", VIOLATIONS + "SELECT * FROM private_v")
def _(g: Graph, *_):
    return R.private_access(g.functions, g.calls)


@query("G6_crate_cycles", VIOLATIONS + "SELECT * FROM rings")
def _(g: Graph, *_):
    return R.cycles(g.depends_on)


@query("G7_mutual_references", "SELECT DISTINCT a.src AS a, a.dst AS b FROM calls a JOIN calls b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst")
def _(g: Graph, *_):
    return R.mutual_references(g.calls)


@query("G7_mutual_crates", "SELECT DISTINCT a.src AS a, a.dst AS b FROM depends_on a JOIN depends_on b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst")
def _(g: Graph, *_):
    return R.mutual_references(g.depends_on)


@query("T4_violations", VIOLATIONS + "SELECT * FROM all_v WHERE severity = 'Error'")
def _(g: Graph, *_):
    return R.all_violations(g.functions, g.calls, g.crates, g.depends_on, severity="error")


@query("A11_summary", VIOLATIONS + "SELECT 'severity' AS section, severity AS name, count(*) AS n FROM all_v GROUP BY severity UNION ALL SELECT 'layers', from_layer || ' -> ' || to_layer, count(*) FROM layer_v GROUP BY ALL")
def _(g: Graph, *_):
    return R.summary(violations(g))


@query("T5_worst_crates", VIOLATIONS + "SELECT from_crate, count(*) AS n FROM all_v GROUP BY from_crate ORDER BY n DESC, from_crate LIMIT 5")
def _(g: Graph, *_):
    return R.worst_crates(violations(g))


@query("A12_layer_health", VIOLATIONS + """, h AS (SELECT l.layer, (SELECT count(*) FROM layer_v v WHERE v.from_layer = l.layer) AS violations FROM (SELECT DISTINCT CAST(layer AS VARCHAR) AS layer FROM crates) l),
s AS (SELECT *, CASE WHEN violations = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE / (1 + violations / 10.0::DOUBLE) END AS x FROM h)
SELECT layer, violations, round(x, 6) AS score, CASE WHEN x >= 90 THEN 'healthy' WHEN x >= 70 THEN 'warning' ELSE 'critical' END AS status FROM s""")
def _(g: Graph, *_):
    return R.layer_health(R.layer_violations(g.functions, g.calls, g.crates), g.crates)


@query("X18_layer_jumps", "SELECT d.src, d.dst, abs(x.layer - y.layer) AS gap FROM depends_on d JOIN crates x ON x.name = d.src JOIN crates y ON y.name = d.dst WHERE abs(x.layer - y.layer) > 1")
def _(g: Graph, *_):
    return R.layer_jumps(g.crates, g.depends_on)


@query("X19_layer_of_crate", "SELECT name, CASE WHEN name LIKE 'Brand#1%' THEN 'core' WHEN name = 'Brand#2' THEN 'exact' WHEN name LIKE 'Brand#2%' THEN 'domain' WHEN name LIKE 'Brand#%' AND name LIKE '%' THEN 'app' END AS layer_name, CASE WHEN name LIKE 'Brand#1%' THEN 0 WHEN name = 'Brand#2' THEN 1 WHEN name LIKE 'Brand#2%' THEN 2 ELSE 3 END AS layer FROM crates")
def _(g: Graph, spark: SparkSession, _d):
    layers = spark.createDataFrame([(0, "core", "Brand#1*"), (1, "exact", "Brand#2"), (2, "domain", "Brand#2*"), (3, "app", "Brand#*")], "ordinal int, layer string, pattern string")
    return R.layer_of(g.crates, layers)


@query("A_marked_functions", VIOLATIONS + "SELECT id, EXISTS (SELECT 1 FROM layer_v v WHERE v.source = f.qualified_name) AS violates_architecture FROM functions f")
def _(g: Graph, *_):
    return R.marked(g.functions, R.layer_violations(g.functions, g.calls, g.crates)).select("id", "violates_architecture")


# -- statistics

COUNTS = "SELECT 'Function' AS label, count(*) AS n FROM functions UNION ALL SELECT 'Crate', count(*) FROM crates UNION ALL SELECT 'Actor', count(*) FROM actors UNION ALL SELECT 'MessageType', count(*) FROM (SELECT message_type FROM sends UNION SELECT message_type FROM handles) UNION ALL SELECT 'CALLS', count(*) FROM calls UNION ALL SELECT 'DEPENDS_ON', count(*) FROM depends_on UNION ALL SELECT 'SENDS', count(*) FROM sends UNION ALL SELECT 'HANDLES', count(*) FROM handles UNION ALL SELECT 'SPAWNS', count(*) FROM spawns"


@query("A8_graph_statistics", COUNTS)
def _(g: Graph, *_):
    return S.graph_statistics(g)


@query("A9_node_counts", "SELECT * FROM (" + COUNTS + ") WHERE label IN ('Function', 'Crate', 'Actor', 'MessageType')")
def _(g: Graph, *_):
    return S.counted(S.nodes(g))


@query("A10_call_dump", "SELECT f.qualified_name AS caller_name, t.qualified_name AS callee_name, f.crate <> t.crate AS cross_crate, c.line FROM calls c JOIN functions f ON f.id = c.src JOIN functions t ON t.id = c.dst")
def _(g: Graph, *_):
    return S.call_dump(g.functions, g.calls)


@query("A13_workspace_overview", "SELECT layer, count(*) AS n_crates, string_agg(name, ',' ORDER BY name) AS crates, (SELECT count(*) FROM functions) AS functions, (SELECT count(*) FROM calls c JOIN functions f ON f.id = c.src JOIN functions t ON t.id = c.dst WHERE f.crate <> t.crate) AS cross_calls FROM crates GROUP BY layer")
def _(g: Graph, *_):
    return S.workspace_overview(g.functions, g.calls, g.crates)


@query("A14_crate_overview", """, x AS (SELECT f.crate AS a, t.crate AS b FROM calls c JOIN functions f ON f.id = c.src JOIN functions t ON t.id = c.dst WHERE f.crate <> t.crate)
SELECT f.crate, count(*) AS functions, count(*) FILTER (WHERE is_test) AS tests, (SELECT count(*) FROM depends_on d WHERE d.src = f.crate) AS dependencies, CAST((SELECT count(*) FROM x WHERE a = f.crate OR b = f.crate) AS BIGINT) AS cross_calls FROM functions f GROUP BY f.crate""")
def _(g: Graph, *_):
    return S.crate_overview(g.functions, g.calls, g.depends_on)


@query("A14_crate_samples", "SELECT id, qualified_name FROM functions WHERE crate = 'Brand#7' ORDER BY qualified_name, id LIMIT 5")
def _(g: Graph, *_):
    return S.crate_samples(g.functions, "Brand#7")


@query("A15_symbol_impact", """, hit AS (SELECT id FROM functions WHERE name = 'SMALL::12' OR contains(qualified_name, 'SMALL::12'))
SELECT (SELECT count(*) FROM hit) AS matches, count(*) AS usages, count(DISTINCT src) AS callers, CASE WHEN count(*) = 0 THEN 'LOW' WHEN count(*) < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM calls WHERE dst IN (SELECT id FROM hit)""")
def _(g: Graph, *_):
    return S.symbol_impact(g.functions, g.calls, "SMALL::12")


@query("A15_symbol_index", """, hit AS (SELECT id FROM functions WHERE name = 'SMALL::12' OR contains(qualified_name, 'SMALL::12'))
SELECT (SELECT count(*) FROM hit) AS matches, count(*) AS usages, count(DISTINCT src) AS callers, CASE WHEN count(*) = 0 THEN 'LOW' WHEN count(*) < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM calls WHERE dst IN (SELECT id FROM hit)""")
def _(g: Graph, spark: SparkSession, _d):
    """The same through the index of names: only postings of the symbol's pieces are read."""
    at = scratch(spark, "names")
    X.write_index(g.functions, at)
    return S.symbol_impact(g.functions, g.calls, "SMALL::12", X.find(spark, at, "SMALL::12"))


NAME_TARGETS = "SELECT DISTINCT module || '::' || id % 10 AS target FROM functions UNION SELECT DISTINCT name FROM functions UNION SELECT DISTINCT substr(crate, 6, 1 + id % 3) FROM functions"


@query("F2_targets", f", t AS ({NAME_TARGETS}) SELECT target, count(*) AS n, min(id) AS first_id FROM t JOIN functions f ON f.name = target OR contains(f.qualified_name, target) GROUP BY target")
def _(g: Graph, *_):
    """Every (module, digit), every bare name and pieces of one to three characters of the crates' names, looked for in all names."""
    f, digit = g.functions, (F.col("id") % 10).cast("string")
    targets = f.select(F.concat_ws("::", "module", digit).alias("target")).union(f.select("name")).union(f.select(F.substr("crate", F.lit(6), (1 + F.col("id") % 3).cast("int"))))
    return X.find_all(X.postings(f), targets).groupBy("target").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("S13_lookup", "SELECT dst, src, line FROM calls WHERE dst IN (12, 77, 100)")
def _(g: Graph, spark: SparkSession, _d):
    """Call edges in files by ranges of the callee, looked up by a few callees."""
    at = scratch(spark, "calls")
    clustered.write(g.calls.select("dst", "src", "line"), at, "dst", "src", blooms=("src",))
    return clustered.read(spark, at, "dst", [12, 77, 100])


@query("A18_module_summary", "SELECT crate, count(DISTINCT module) AS modules, count(*) AS functions, count(DISTINCT name) AS names FROM functions GROUP BY crate")
def _(g: Graph, *_):
    return S.module_summary(g.functions)


@query("A22_index_statistics", "SELECT count(*) AS functions, count(DISTINCT name) AS unique_names, count(DISTINCT crate) AS crates, count(*) FILTER (WHERE visibility = 'pub') AS exports FROM functions")
def _(g: Graph, *_):
    return S.index_statistics(g.functions)


@query("A27_metrics", ", k AS (" + COUNTS + ") SELECT string_agg(label || '=' || n, ',' ORDER BY label) AS metrics FROM k")
def _(g: Graph, *_):
    return S.metrics(g).select(F.array_join(F.transform(F.map_entries("metrics"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("metrics"))


@query("G9_patterns", "SELECT 'Function' AS from_label, 'CALLS' AS edge, 'Function' AS to_label, count(*) AS n FROM calls UNION ALL SELECT 'Crate', 'DEPENDS_ON', 'Crate', count(*) FROM depends_on UNION ALL SELECT 'Actor', 'SENDS', 'Actor', count(*) FROM sends UNION ALL SELECT 'Actor', 'HANDLES', 'MessageType', count(*) FROM handles UNION ALL SELECT 'Actor', 'SPAWNS', 'Actor', count(*) FROM spawns")
def _(g: Graph, *_):
    return S.patterns(g)


PROPERTIES = " UNION ALL ".join(
    f"SELECT '{label}' AS label, '{name}' AS property, '{kind}' AS type, count({name}) AS n FROM {rows}"
    for label, rows, columns in (
        ("Function", "functions", "id bigint, name string, qualified_name string, crate string, module string, file string, visibility string, is_test boolean, line_start bigint"),
        ("Crate", "crates", "name string, num int, layer int"),
        ("Actor", "actors", "id bigint, name string, crate string, is_distributed boolean, is_test boolean"),
        ("MessageType", "(SELECT message_type FROM sends UNION SELECT message_type FROM handles)", "message_type string"),
    )
    for name, kind in (c.split() for c in columns.split(", "))
)


@query("G9_properties", PROPERTIES)
def _(g: Graph, *_):
    return S.properties(g)


@query("R10_name_index", "SELECT name, count(*) AS n, (SELECT id FROM functions x WHERE x.name = f.name ORDER BY crate, line_start, id LIMIT 1) AS first_id FROM functions f GROUP BY name")
def _(g: Graph, *_):
    return S.name_index(g.functions)


@query("R14_exports", "SELECT crate, count(*) AS n, count(DISTINCT name) AS names FROM functions WHERE visibility = 'pub' GROUP BY crate")
def _(g: Graph, *_):
    return S.exports(g.functions)


@query("API_function_details", "SELECT id, qualified_name, visibility, is_test, (SELECT count(*) FROM calls c WHERE c.dst = f.id) AS callers, (SELECT count(*) FROM calls c WHERE c.src = f.id) AS callees FROM functions f WHERE name = 'red widget' OR contains(qualified_name, 'red widget')")
def _(g: Graph, *_):
    return S.function_details(g.functions, g.calls, "red widget")


# -- actors

@query("J11_spawn_edges", "SELECT p.name AS parent_name, p.crate AS parent_crate, c.name AS child_name, c.crate AS child_crate, s.order_key, s.line FROM spawns s JOIN actors p ON p.id = s.parent JOIN actors c ON c.id = s.child")
def _(g: Graph, *_):
    return A.spawn_edges(g.actors, g.spawns).select("parent_name", "parent_crate", "child_name", "child_crate", "order_key", "line")


@query("J12_handle_edges", "SELECT h.actor, h.message_type, CASE WHEN a.id % 4 = 0 THEN 'actor-' || h.actor ELSE a.name END AS name, CASE WHEN a.id % 4 = 0 THEN 'unknown' ELSE a.crate END AS crate FROM handles h JOIN actors a ON a.id = h.actor")
def _(g: Graph, *_):
    return A.handle_edges(g.actors.filter("id % 4 <> 0"), g.handles)[0].select("actor", "message_type", "name", "crate")


@query("J13_send_edges", "SELECT event_id, sender, message_type, CASE WHEN sender % 2 = 0 THEN a.name ELSE f.name END AS sender_name FROM sends s JOIN actors a ON a.id = s.sender JOIN functions f ON f.id = s.sender")
def _(g: Graph, *_):
    return A.send_edges(g.actors.filter("id % 2 = 0"), g.functions, g.sends).select("event_id", "sender", "message_type", "sender_name")


@query("J14_distributed_edges", "SELECT s.event_id, a.name AS sender_name, b.name AS receiver_name, s.message_type, s.method FROM sends s JOIN actors a ON a.id = s.sender JOIN actors b ON b.id = s.receiver WHERE b.is_distributed")
def _(g: Graph, *_):
    return A.distributed_edges(g.actors, g.sends).select("event_id", "sender_name", "receiver_name", "message_type", "method")


@query("J18_routes", """, s AS (SELECT DISTINCT a.name, a.crate, x.message_type FROM sends x JOIN actors a ON a.id = x.sender), h AS (SELECT DISTINCT a.name, a.crate, x.message_type FROM handles x JOIN actors a ON a.id = x.actor)
SELECT s.name AS sender, s.crate AS sender_crate, s.message_type, h.name AS receiver, h.crate AS receiver_crate FROM s JOIN h ON h.message_type = s.message_type AND h.crate = s.crate""")
def _(g: Graph, *_):
    return A.routes(g.actors, g.sends, g.handles)


@query("J19_potential_communications", "SELECT t.message_type, (SELECT count(DISTINCT sender) FROM sends s WHERE s.message_type = t.message_type) AS senders, (SELECT count(DISTINCT actor) FROM handles h WHERE h.message_type = t.message_type) AS receivers FROM (SELECT message_type FROM sends UNION SELECT message_type FROM handles) t")
def _(g: Graph, *_):
    return A.potential_communications(g.sends, g.handles)


@query("J19_message_links", "SELECT DISTINCT sender AS actor, message_type, 'SENDS' AS kind FROM sends UNION ALL SELECT DISTINCT actor, message_type, 'HANDLES' FROM handles")
def _(g: Graph, *_):
    return A.message_links(g.sends, g.handles)


@query("J10_actor_details", """SELECT a.id, a.name, a.crate, a.is_distributed,
  coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT child AS x FROM spawns WHERE parent = a.id)), '') AS spawns,
  coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT parent AS x FROM spawns WHERE child = a.id)), '') AS spawned_by,
  coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT message_type AS x FROM sends WHERE sender = a.id)), '') AS sends,
  coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT message_type AS x FROM handles WHERE actor = a.id)), '') AS handles,
  coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT receiver AS x FROM sends WHERE sender = a.id)), '') AS sends_to,
  coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT sender AS x FROM sends WHERE receiver = a.id)), '') AS receives_from,
  coalesce((SELECT string_agg(x, ',' ORDER BY x COLLATE C) FROM (SELECT DISTINCT name AS x FROM functions f WHERE f.id % 40 + 1 = a.id)), '') AS methods,
  coalesce((SELECT string_agg(x, ',' ORDER BY x COLLATE C) FROM (SELECT DISTINCT module AS x FROM functions f WHERE f.id % 40 + 1 = a.id)), '') AS fields,
  coalesce((SELECT string_agg(x, ',' ORDER BY x COLLATE C) FROM (SELECT DISTINCT visibility AS x FROM functions f WHERE f.id % 40 + 1 = a.id)), '') AS implements FROM actors a""")
def _(g: Graph, *_):
    of = lambda c: g.functions.select((F.col("id") % 40 + 1).alias("id"), F.col(c).alias("name"))
    return A.details(g.actors, g.sends, g.handles, g.spawns, of("name"), of("module"), of("visibility"))


@query("G13_distributed_actors", "SELECT id, name, crate FROM actors WHERE is_distributed AND NOT is_test ORDER BY name, id LIMIT 50")
def _(g: Graph, *_):
    return A.distributed(g.actors, exclude_tests=True)


CLEAN = "replace({}, '#', '_')"


@query("G10_spawn_diagram", f""", e AS (SELECT DISTINCT p.name AS a, c.name AS b FROM spawns s JOIN actors p ON p.id = s.parent JOIN actors c ON c.id = s.child)
SELECT 'graph TD' || chr(10) || string_agg(l, chr(10) ORDER BY l COLLATE C) AS diagram, count(*) AS n_lines FROM (SELECT '    ' || {CLEAN.format('a')} || ' --> ' || {CLEAN.format('b')} AS l FROM e)""")
def _(g: Graph, *_):
    return A.spawn_diagram(g.actors, g.spawns)


@query("G11_message_diagram", f""", e AS (SELECT p.name AS a, c.name AS b, message_type, count(*) FILTER (WHERE method = 'Tell') AS t, count(*) FILTER (WHERE method = 'Ask') AS k FROM sends s JOIN actors p ON p.id = s.sender JOIN actors c ON c.id = s.receiver GROUP BY ALL)
SELECT 'graph LR' || chr(10) || string_agg(l, chr(10) ORDER BY l COLLATE C) AS diagram, count(*) AS n_lines FROM (SELECT '    ' || {CLEAN.format('a')} || ' -->|' || message_type || ' tell:' || t || ' ask:' || k || '| ' || {CLEAN.format('b')} AS l FROM e)""")
def _(g: Graph, *_):
    return A.message_diagram(g.actors, g.sends)


@query("G12_flow_diagram", f""", e AS (SELECT DISTINCT a.name AS a, b.name AS b, message_type FROM sends s JOIN actors a ON a.id = s.sender JOIN actors b ON b.id = s.receiver WHERE b.is_distributed),
l AS (SELECT '    ' || {CLEAN.format('a')} AS l FROM e UNION SELECT '    ' || {CLEAN.format('b')} FROM e UNION ALL SELECT '    ' || {CLEAN.format('a')} || ' -->|' || message_type || '| ' || {CLEAN.format('b')} FROM e)
SELECT 'graph LR' || chr(10) || string_agg(l, chr(10) ORDER BY l COLLATE C) AS diagram, count(*) AS n_lines FROM l""")
def _(g: Graph, *_):
    return A.flow_diagram(g.actors, g.sends)


@query("A17_spawn_groups", "SELECT parent, count(*) AS n, count(DISTINCT child) AS distinct_others, CASE WHEN count(*) > 20 THEN 'consider a pool' WHEN count(DISTINCT child) = 1 THEN 'single kind' ELSE 'ok' END AS advice FROM spawns GROUP BY parent")
def _(g: Graph, *_):
    return A.spawn_groups(g.actors, g.spawns)


@query("A23_actors_by_test_status", "SELECT crate, count(*) AS total, count(*) FILTER (WHERE is_test) AS test_actors, count(*) FILTER (WHERE NOT is_test) AS production, count(*) FILTER (WHERE is_distributed AND NOT is_test) AS distributed_production FROM actors GROUP BY crate")
def _(g: Graph, *_):
    return A.by_test_status(g.actors)


@query("A24_handled_messages", "SELECT a.id, a.name, string_agg(h.message_type, ',' ORDER BY h.message_type) AS messages, count(*) AS n FROM actors a JOIN handles h ON h.actor = a.id GROUP BY ALL")
def _(g: Graph, *_):
    return A.handled_messages(g.actors, g.handles)


@query("A25_out_degree", "SELECT id, name, (SELECT count(*) FROM sends WHERE sender = a.id) + (SELECT count(*) FROM handles WHERE actor = a.id) + (SELECT count(*) FROM spawns WHERE parent = a.id) AS n FROM actors a")
def _(g: Graph, *_):
    return A.out_degree(g.actors, g.sends, g.handles, g.spawns)


@query("A26_local_and_distributed", "SELECT (SELECT count(*) FROM actors WHERE NOT is_distributed) AS local_actors, (SELECT count(*) FROM actors WHERE is_distributed) AS distributed_actors, (SELECT count(*) FROM sends s JOIN actors a ON a.id = s.receiver WHERE NOT is_distributed) AS local_flows, (SELECT count(*) FROM sends s JOIN actors a ON a.id = s.receiver WHERE is_distributed) AS distributed_flows")
def _(g: Graph, *_):
    return A.local_and_distributed(g.actors, g.sends)


@query("J20_merge_actor_types", "SELECT coalesce(t.name, a.name) AS name, coalesce(t.crate, a.crate) AS crate, t.name IS NOT NULL AS has_type, a.name IS NOT NULL AS is_actor, coalesce(a.is_distributed, false) AS is_distributed FROM (SELECT * FROM actors WHERE id % 3 <> 1) t FULL JOIN (SELECT * FROM actors WHERE id % 4 <> 1) a ON a.name = t.name AND a.crate = t.crate WHERE t.id IS NOT NULL OR a.id IS NOT NULL")
def _(g: Graph, *_):
    return A.merge_actor_types(g.actors.filter("id % 3 <> 1"), g.actors.filter("id % 4 <> 1"))


@query("J20_migrated_edges", "SELECT DISTINCT coalesce(t.id + 1000000, s.sender) AS sender, s.receiver, s.message_type FROM sends s LEFT JOIN (SELECT * FROM actors WHERE id % 3 <> 1) t ON t.id = s.sender")
def _(g: Graph, *_):
    types = g.actors.filter("id % 3 <> 1").select((F.col("id") + 1_000_000).alias("id"), "name", "crate")
    return A.migrate(types, g.actors, {"sends": (g.sends.select("sender", "receiver", "message_type"), ["sender"])})[1]["sends"]


@query("J21_upsert", "SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, o.crate FROM (SELECT * FROM actors WHERE id % 2 = 0) o FULL JOIN (SELECT id, 'new' || id AS name FROM actors WHERE id % 3 = 0) n ON n.id = o.id")
def _(g: Graph, *_):
    new = g.actors.filter("id % 3 = 0").select("id", F.concat(F.lit("new"), F.col("id").cast("string")).alias("name"))
    return A.upsert(g.actors.filter("id % 2 = 0").select("id", "name", "crate"), new, ["id"])


@query("J21_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    return A.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# -- resolution

RAW = """, raw AS (SELECT order_key * 100 + seq AS call_id, f.qualified_name AS caller, CASE seq % 4 WHEN 0 THEN t.qualified_name WHEN 1 THEN t.name WHEN 2 THEN t.module || '::' || t.id ELSE 'gone::' || t.id END AS callee_name, f.crate, f.module, f.file, c.line
  FROM calls c JOIN functions f ON f.id = c.src JOIN functions t ON t.id = c.dst),
last_named AS (SELECT name, arg_max(id, (crate, file, line_start, id)) AS id FROM functions GROUP BY name),
resolved AS (SELECT r.*, coalesce(q.id, k.id, l.id) AS callee_id FROM raw r LEFT JOIN functions q ON q.qualified_name = r.callee_name LEFT JOIN functions k ON k.qualified_name = r.crate || '::' || r.callee_name LEFT JOIN last_named l ON l.name = r.callee_name)
"""


def raw_calls(g: Graph) -> DataFrame:
    of = lambda p, k: g.functions.select(F.col("id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("name", "qualified_name", "crate", "module", "file")])
    rows = g.calls.join(N.grown(of("f", "src")), "src").join(N.grown(of("t", "dst")), "dst")
    form = F.col("seq") % 4
    callee = F.when(form == 0, F.col("t_qualified_name")).when(form == 1, F.col("t_name")).when(form == 2, F.concat_ws("::", "t_module", F.col("dst").cast("string"))).otherwise(F.concat_ws("::", F.lit("gone"), F.col("dst").cast("string")))
    return rows.select((F.col("order_key") * 100 + F.col("seq")).alias("call_id"), F.col("f_qualified_name").alias("caller"), callee.alias("callee_name"), F.col("f_crate").alias("crate"), F.col("f_module").alias("module"), F.col("f_file").alias("file"), "line")


@query("R3_symbol_table", ", keys AS (SELECT name AS key, * FROM functions UNION ALL SELECT qualified_name, * FROM functions UNION ALL SELECT 'crate::' || module || '::' || id || '@' || crate, * FROM functions) SELECT key, arg_max(id, (crate, file, line_start, id)) AS id FROM keys GROUP BY key")
def _(g: Graph, *_):
    return N.symbol_table(g.functions).select("key", "id")


@query("R4_resolve", RAW + "SELECT call_id, callee_id, coalesce(t.crate <> r.crate, false) AS cross_crate FROM resolved r LEFT JOIN functions t ON t.id = r.callee_id")
def _(g: Graph, *_):
    return N.resolve(raw_calls(g), g.functions).select("call_id", "callee_id", "cross_crate")


@query("J1_call_edges", RAW + "SELECT DISTINCT f.id AS src, r.callee_id AS dst, r.line FROM resolved r JOIN functions f ON f.qualified_name = r.caller WHERE callee_id IS NOT NULL")
def _(g: Graph, *_):
    return N.call_edges(N.resolve(raw_calls(g), g.functions), g.functions)


@query("J2_unresolved_by_name", """, raw AS (SELECT c.order_key, c.seq, f.id AS src, t.name AS callee_name, f.crate, c.line FROM calls c JOIN functions f ON f.id = c.src JOIN functions t ON t.id = c.dst)
SELECT DISTINCT r.src, t.id AS dst, r.line FROM raw r JOIN functions t ON t.name = r.callee_name AND t.crate = r.crate""")
def _(g: Graph, *_):
    f = g.functions
    raw = g.calls.join(N.grown(f.select(F.col("id").alias("src"), F.col("qualified_name").alias("caller"), "crate")), "src").join(N.grown(f.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"))), "dst")
    return N.call_edges(raw.select("caller", "callee_name", "crate", "line", F.lit(None).cast("long").alias("callee_id")), f)


SUFFIX = ", sx AS (SELECT id, unnest([split_part(qualified_name, '::', 3), split_part(qualified_name, '::', 2) || '::' || split_part(qualified_name, '::', 3), qualified_name]) AS suffix FROM functions)"


@query("R5_suffixes", SUFFIX + " SELECT id, suffix FROM sx")
def _(g: Graph, *_):
    return N.suffixes(g.functions).select("id", "suffix")


SYNTHETIC = """, syn AS (SELECT c.src, CASE c.seq % 3 WHEN 0 THEN t.qualified_name WHEN 1 THEN t.module || '::' || t.id ELSE 'new' || c.dst % 10 || '::made' END AS target FROM calls c JOIN functions t ON t.id = c.dst)"""


@query("J3_synthetic_edges", SUFFIX + SYNTHETIC + """ SELECT src, target, coalesce(q.id, s.id) AS dst, CASE WHEN q.id IS NOT NULL THEN 'exact' WHEN s.id IS NOT NULL THEN 'suffix' ELSE 'created' END AS how
FROM syn LEFT JOIN functions q ON q.qualified_name = syn.target LEFT JOIN (SELECT suffix, min(id) AS id FROM sx GROUP BY suffix) s ON s.suffix = syn.target""")
def _(g: Graph, *_):
    t = g.functions.select(F.col("id").alias("dst"), "qualified_name", "module")
    form = F.col("seq") % 3
    target = F.when(form == 0, F.col("qualified_name")).when(form == 1, F.concat_ws("::", "module", F.col("dst").cast("string"))).otherwise(F.concat(F.lit("new"), (F.col("dst") % 10).cast("string"), F.lit("::made")))
    return N.synthetic_edges(g.calls.join(t, "dst").select("src", target.alias("target")), g.functions)[0]


@query("J16_containing", """, f2 AS (SELECT id, file, line_start, line_start + id % 40 AS line_end FROM functions), pts AS (SELECT DISTINCT file, line_start + 3 AS line FROM functions)
SELECT file, line, arg_min(id, (line_end - line_start, id)) AS function_id FROM pts JOIN f2 USING (file) WHERE line BETWEEN line_start AND line_end GROUP BY file, line""")
def _(g: Graph, *_):
    f = g.functions.withColumn("line_end", F.col("line_start") + F.col("id") % 40)
    return N.containing(g.functions.select("file", (F.col("line_start") + 3).alias("line")).distinct(), f)


@query("R17_consolidated", """, f2 AS (SELECT crate || '::' || (id % 7) AS q, CAST(row_number() OVER (PARTITION BY crate, id % 7 ORDER BY id) * 2 + id % 3 AS BIGINT) AS line, is_test FROM functions),
s AS (SELECT q, unnest(list_reduce(list_transform(list_sort(list(line)), lambda x: [x]), lambda s, x: CASE WHEN x[1] - s[len(s)] > 5 THEN list_concat(s, x) ELSE s END)) AS start FROM f2 GROUP BY q)
SELECT s.q AS qualified_name, s.start AS line_start, CAST(count(*) AS INT) AS merged, bool_or(is_test) AS is_trait_impl FROM s JOIN f2 ON f2.q = s.q AND f2.line BETWEEN s.start AND s.start + 5 GROUP BY s.q, s.start""")
def _(g: Graph, *_):
    w = Window.partitionBy("crate", F.col("id") % 7).orderBy("id")
    f = g.functions.select(F.concat_ws("::", "crate", (F.col("id") % 7).cast("string")).alias("qualified_name"), (F.row_number().over(w) * 2 + F.col("id") % 3).alias("line_start"), F.col("is_test").alias("is_trait_impl"))
    return N.consolidated(f)


@query("R1_first_of", "SELECT name, crate, id FROM (SELECT *, row_number() OVER (PARTITION BY name, crate ORDER BY line_start, id) AS k FROM functions) WHERE k = 1")
def _(g: Graph, *_):
    return N.first_of(g.functions, ["name", "crate"], ["line_start", "id"]).select("name", "crate", "id")


@query("R8_pattern_links", ", m AS (SELECT DISTINCT crate, 'X::' || split_part(name, ' ', 2) AS pattern, split_part(name, ' ', 2) AS w FROM functions) SELECT m.pattern || '@' || m.crate AS macro_id, m.crate, f.id AS dst, CAST(0.9 AS DOUBLE) AS confidence FROM m JOIN functions f ON f.crate = m.crate AND split_part(f.name, ' ', 2) = m.w")
def _(g: Graph, *_):
    word = T.segment(F.col("name"), 2, " ")
    m = g.functions.select("crate", F.concat(F.lit("X::"), word).alias("p")).distinct().select("crate", F.concat_ws("@", "p", "crate").alias("macro_id"), F.concat("p", F.lit("(")).alias("pattern"))
    return N.pattern_links(m, g.functions.withColumn("name", word))


@query("R11_associated", RAW + "SELECT call_id, f.crate AS to_crate, f.id AS callee_id FROM raw r LEFT JOIN functions f ON r.callee_name = f.qualified_name OR r.callee_name = f.module || '::' || f.id WHERE contains(callee_name, '::')")
def _(g: Graph, *_):
    types = g.functions.select(F.col("module").alias("name"), "crate").distinct()
    return N.associated(raw_calls(g), types, g.functions.withColumn("name", F.col("id").cast("string")))


@query("R2_import_table", ", i AS (SELECT crate, file, 'dep::' || lower(module) AS module_path, name, id FROM functions) SELECT crate, file, CASE WHEN id % 2 = 0 THEN 'x' || id ELSE name END AS local_name, module_path || '::' || name AS target, 'dep' AS to_crate FROM i")
def _(g: Graph, *_):
    rows = g.functions
    alias = F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), F.col("id").cast("string")))
    item = F.array(F.struct(F.col("name").alias("name"), alias.alias("alias")))
    return N.import_table(rows.select("crate", "file", F.concat(F.lit("dep::"), F.lower("module")).alias("module_path"), F.lit("Simple").alias("import_type"), item.alias("items")))


# -- search

@query("V2_search", """SELECT vec_id, round(similarity, 9) AS similarity FROM (SELECT e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) AS similarity
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q) ORDER BY similarity DESC, vec_id LIMIT 10""", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 3").select("embedding").first()[0]
    return V.search(e, q, key="vec_id").select("vec_id", F.round("similarity", 9).alias("similarity"))


@query("V3_similar", """SELECT vec_id, round(similarity, 9) AS similarity FROM (SELECT e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) AS similarity
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE e.vec_id <> 5) ORDER BY similarity DESC, vec_id LIMIT 10""", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    return V.similar(table(spark, d, "embeddings"), 5, key="vec_id").select("vec_id", F.round("similarity", 9).alias("similarity"))


@query("V1_embedding_rows", "SELECT id, 'function' AS kind, crate, 'crate: ' || crate || ' | function: ' || name || ' | module: ' || module AS text FROM functions")
def _(g: Graph, *_):
    return V.function_rows(g.functions)


@query("X13_embedding_vectors", """, t AS (SELECT id, 'crate: ' || crate || ' | function: ' || name || ' | module: ' || module AS s FROM functions), x AS (SELECT id, s, strlen(s) AS n, string_split(s, ' ') AS w FROM t),
c AS (SELECT id, ord(s[i]) % 64 AS b, 1.0::DOUBLE / i AS v FROM x, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS i) UNION ALL SELECT id, list_sum(list_transform(range(1, length(w[i]) + 1), lambda k: ord(w[i][k]))) % 64, 0.5::DOUBLE / i FROM x, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
g AS (SELECT id, b, sum(v) AS v FROM c GROUP BY ALL), v AS (SELECT x.id, k, coalesce(g.v, 0) + 0.1 * sin(n * (k + 1)) AS v FROM x CROSS JOIN (SELECT unnest(range(0, 64)) AS k) LEFT JOIN g ON g.id = x.id AND g.b = k)
SELECT id, list_transform(list(v ORDER BY k), lambda y: round(y / sqrt(list_sum(list_transform(list(v), lambda z: z * z))), 6)) AS embedding FROM v GROUP BY id""")
def _(g: Graph, *_):
    return V.embedded(V.function_rows(g.functions), width=64).select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


# -- text

@query("X2_segments", "SELECT id, split_part(qualified_name, '::', 1) AS first, split_part(qualified_name, '::', 3) AS last, replace(name, ' ', '_') AS snake FROM functions")
def _(g: Graph, *_):
    q = F.col("qualified_name")
    return g.functions.select("id", T.segment(q, 1).alias("first"), T.segment(q, -1).alias("last"), F.replace("name", F.lit(" "), F.lit("_")).alias("snake"))


@query("X5_case", "SELECT id, upper(substr(split_part(name, ' ', 1), 1, 1)) || substr(split_part(name, ' ', 1), 2) || upper(substr(split_part(name, ' ', 2), 1, 1)) || substr(split_part(name, ' ', 2), 2) AS pascal, replace(name, ' ', '_') AS back FROM functions")
def _(g: Graph, *_):
    p = T.pascal(F.replace("name", F.lit(" "), F.lit("_")))
    return g.functions.select("id", p.alias("pascal"), T.snake(p).alias("back"))


@query("X11_paths", """SELECT id, crate AS crate_of, replace(crate, '-', '_') || '::' || lower(module) AS module_of, line_start % 9 IN (0, 1, 2, 4, 5, 6, 7) AS is_test_file FROM functions""")
def _(g: Graph, *_):
    names = ("tests/a.rs", "examples/b/c.rs", "benches/a.rs", "src/attests.rs", "src/a_test.rs", "src/a_tests.rs", "src/test.rs", "src/b/tests.rs", "src/testing/a.rs")
    path = F.concat(F.lit("/ws/k/"), F.element_at(F.array(*map(F.lit, names)), (F.col("line_start") % 9 + 1).cast("int")))
    return g.functions.select("id", T.crate_of_path(F.col("file")).alias("crate_of"), T.module_of_file(F.col("file"), F.col("crate")).alias("module_of"), T.is_test_file(path).alias("is_test_file"))


NAMED = ("println", "thread_local", "info", "dec", "select", "generate_builder", "paste", "join", "my_macro")


@query("P12_macro_kinds", "SELECT id, ['builtin', 'builtin', 'logging', 'decimal', 'async', 'custom', 'paste', 'declarative', 'declarative'][CAST(id % 9 + 1 AS INT)] AS kind FROM functions")
def _(g: Graph, *_):
    return g.functions.select("id", T.macro_kind(F.element_at(F.array(*map(F.lit, NAMED)), (F.col("id") % 9 + 1).cast("int"))).alias("kind"))


@query("P24_spawn_contexts", """SELECT id, ['on_start:on_start', 'on_stop:on_stop', 'message_handler:reply', 'message_handler:handle_it', 'lifecycle_handler:on_it', 'spawn_function:do_spawn', 'main_function:main', 'run_function:run', 'regular_function:handle', 'module_level'][CAST(id % 10 + 1 AS INT)] AS context FROM functions""")
def _(g: Graph, *_):
    names = ("on_start", "on_stop", "reply", "handle_it", "on_it", "do_spawn", "main", "run", "handle", None)
    return g.functions.select("id", T.spawn_context(F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 10 + 1).cast("int"))).alias("context"))


@query("P25_likely_actors", "SELECT id, id % 9 IN (0, 1, 2, 3) AS likely FROM functions")
def _(g: Graph, *_):
    names = ("PriceActor", "ActorPool", "MyAgent", "ManagerOfAll", "Actor", "Handler", "tokio", "price_actor", "Widget")
    return g.functions.select("id", T.likely_actor(F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 9 + 1).cast("int"))).alias("likely"))


@query("P33_paste_patterns", """SELECT file, k AS kind, CASE k WHEN 0 THEN 'define_indicator_enums!(' WHEN 2 THEN '[<$' || m || '>]::new(' WHEN 1 THEN 'paste! {' || chr(10) || ' [<$' || m || '>]::new(' ELSE '[<$' || m || ' Input>]::from(' END AS pattern
  FROM (SELECT DISTINCT file, lower(module) AS m FROM functions), (VALUES (0), (1), (2), (4)) t(k)""")
def _(g: Graph, *_):
    m = F.lower("module")
    text = F.concat(F.lit("define_indicator_enums!(A);\nfn f() { paste! {\n [<$"), m, F.lit(">]::new(1) } }\n[<$"), m, F.lit(" Input>]::from(2)"))
    return N.paste_patterns(g.functions.select("file", text.alias("text")).distinct())


@query("P32_pattern_names", """SELECT file, s AS source, n AS name FROM (SELECT DISTINCT file, module AS m FROM functions), LATERAL (VALUES ('macro', 'alma'), ('macro', lower(m)), ('enum', m), ('enum', 'Tail(u8)'), ('loop', 'ITEMS'), ('loop', lower(m))) t(s, n)""")
def _(g: Graph, *_):
    m = F.col("module")
    text = F.concat(F.lit("define_indicator_enums!(alma: 'x y', "), F.lower(m), F.lit(");\npub enum K {\n    "), m, F.lit(",\n    lower,\n    Tail(u8),\n}\nfor x in ITEMS.iter() {\n  for y in "), F.lower(m), F.lit(" {"))
    return N.pattern_names(g.functions.select("file", text.alias("text")).distinct())


@query("R13_methods_of_types", "SELECT crate, module AS type_name, name AS method, id, CASE WHEN id % 3 = 0 THEN 'Own' END AS trait_name FROM functions WHERE id % 3 < 2")
def _(g: Graph, *_):
    context = F.when(F.col("id") % 3 == 0, "TraitImpl").when(F.col("id") % 3 == 1, "RegularImpl").otherwise("Free")
    f = g.functions.withColumn("qualified_name", F.concat_ws("::", "crate", "module", "name")).withColumn("context", context).withColumn("file", F.concat("file", F.col("id").cast("string")))
    blocks = f.filter("id % 3 < 2").select("crate", "file", F.col("module").alias("type_name"), F.when(F.col("id") % 3 == 0, "Own").alias("trait_name"), F.array("name").alias("methods"))
    return N.methods_of(f, blocks)


@query("X21_visibility", "SELECT visibility, CASE visibility WHEN 'pub' THEN 'Public' WHEN 'pub(crate)' THEN 'Crate' ELSE 'Private' END AS kind, count(*) AS n FROM functions GROUP BY ALL")
def _(g: Graph, *_):
    return g.functions.groupBy("visibility", T.visibility_kind(F.col("visibility")).alias("kind")).agg(F.count("*").alias("n"))


@query("X15_complexity", "SELECT id, line_start % 4 + 2 * CAST(id % 2 = 0 AS INT) + CAST(is_test AS INT) + CAST(id % 3 = 0 AS INT) + 1 AS complexity FROM functions")
def _(g: Graph, *_):
    c = T.signature_complexity(F.col("line_start") % 4, F.col("id") % 2 == 0, F.col("is_test"), F.col("id") % 3 == 0, F.lit(True))
    return g.functions.select("id", c.alias("complexity"))


@query("P26_message_kinds", "SELECT event_type || CASE event_id % 4 WHEN 0 THEN 'Tell' WHEN 1 THEN 'Ask' WHEN 2 THEN 'Query' ELSE 'Event' END AS name, CASE event_id % 4 WHEN 0 THEN 'Tell' WHEN 1 THEN 'Ask' WHEN 2 THEN 'Query' END AS kind, count(*) AS n FROM events GROUP BY ALL", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    name = F.concat("event_type", F.element_at(F.array(*map(F.lit, ("Tell", "Ask", "Query", "Event"))), (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, d, "events").select(name.alias("name")).groupBy("name", T.message_kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


# -- incremental

STATE_SQL = "s AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 1), l AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 3)"


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    old = W.content_hash(docs.filter("doc_id % 10 <> 1"))
    return old, W.content_hash(docs.filter("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))


@query("I2_changes", f"WITH {STATE_SQL} SELECT coalesce(s.path, l.path) AS path, CASE WHEN s.path IS NULL THEN 'Created' WHEN l.path IS NULL THEN 'Deleted' ELSE 'Modified' END AS change FROM s FULL JOIN l ON l.path = s.path WHERE s.hash IS DISTINCT FROM l.hash", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    return W.changes(*versions(spark, d))


@query("I6_outdated", f"WITH {STATE_SQL} SELECT l.path FROM l LEFT JOIN s ON l.path = s.path WHERE s.hash IS DISTINCT FROM l.hash", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    return W.outdated(*versions(spark, d))


@query("I3_replace_files", "SELECT id, file, CASE WHEN crate = 'Brand#7' THEN name || '!' ELSE name END AS name FROM functions WHERE NOT (crate = 'Brand#9')")
def _(g: Graph, *_):
    f = g.functions.select("id", "file", "name", "crate")
    changed = f.filter("crate in ('Brand#7', 'Brand#9')").select(F.col("file").alias("path")).distinct()
    new = f.filter("crate = 'Brand#7'").withColumn("name", F.concat("name", F.lit("!")))
    return W.replace_files(f, changed, new).select("id", "file", "name")


@query("I5_affected_crates", "SELECT DISTINCT crate FROM functions WHERE file LIKE '%src/small.rs' AND id % 7 = 0")
def _(g: Graph, *_):
    changed = g.functions.filter((F.col("id") % 7 == 0) & F.col("file").endswith("src/small.rs")).select(F.col("file").alias("path")).distinct()
    return W.affected_crates(changed, g.functions)


@query("I8_file_report", "SELECT file AS path, count(*) FILTER (WHERE id % 2 = 0) AS before, count(*) FILTER (WHERE id % 3 = 0) AS after FROM functions WHERE id % 2 = 0 OR id % 3 = 0 GROUP BY file")
def _(g: Graph, *_):
    return W.file_report(g.functions.filter("id % 2 = 0"), g.functions.filter("id % 3 = 0"))


@query("I10_crate_of_file", "SELECT DISTINCT file AS path, crate FROM functions")
def _(g: Graph, *_):
    crates = g.crates.select("name", F.concat(F.lit("/ws/"), "name").alias("path")).union(g.crates.sparkSession.createDataFrame([("root", "/ws")], "name string, path string"))
    return W.crate_of_file(g.functions.select(F.col("file").alias("path")).distinct(), crates)


@query("A21_incremental_statistics", "SELECT (SELECT count(*) FROM events) AS files, (SELECT max(ts) FROM events) AS last_analyzed, count(*) AS symbols, count(DISTINCT crate) AS crates FROM functions")
def _(g: Graph, spark: SparkSession, d: str):
    return W.statistics(g.functions, table(spark, d, "events").select(F.col("ts").alias("mtime")))


# -- ingest: the projection written as Rust source, parsed and resolved again

#: Of a module, a file holds the functions of so many consecutive ids.
SPAN = 10_000


def sources(g: Graph) -> DataFrame:
    """(path, crate, text): files of a crate and module, one for each stretch of ids, so that no file grows with the tables; a function for each part, whose body calls its callees by path."""
    target = g.functions.select(F.col("id").alias("dst"), F.concat(F.lit("crate_"), F.col("crate").substr(7, 9), F.lit("::"), F.lower("module"), F.lit("::f"), F.col("id").cast("string")).alias("path"))
    bodies = g.calls.select("src", "dst").repartition("dst").distinct().join(target, "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit("();")))), " ").alias("body"))
    vis = F.when(F.col("visibility") == "private", "").otherwise(F.concat("visibility", F.lit(" ")))
    text = F.concat(F.when(F.col("is_test"), "#[test]\n").otherwise(""), vis, F.lit("fn f"), F.col("id").cast("string"), F.lit("() { "), F.coalesce("body", F.lit("")), F.lit(" }\n"))
    f = g.functions.join(bodies, "id", "left").select(F.concat(F.lit("crate_"), F.col("crate").substr(7, 9)).alias("crate"), F.lower("module").alias("module"), F.expr(f"concat('part', id div {SPAN})").alias("folder"), F.struct("id", text.alias("text")).alias("s"))
    files = f.groupBy("crate", "folder", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), "").alias("text"))
    return files.select(F.concat_ws("/", F.lit("/ws"), "crate", "folder", F.lit("src"), F.concat("module", F.lit(".rs"))).alias("path"), "crate", "text")


RUST = ", r AS (SELECT id, 'crate_' || substr(crate, 7) AS c, lower(module) AS m, 'crate_' || substr(crate, 7) || '::' || lower(module) || '::f' || id AS q, visibility, is_test FROM functions)"


@query("S1_scan_functions", RUST + " SELECT q AS qualified_name, c AS crate, visibility, is_test FROM r")
def _(g: Graph, *_):
    return rust.tables(rust.scan(sources(g), "functions"))["functions"].select("qualified_name", "crate", "visibility", "is_test")


@query("P10_scan_calls", RUST + " SELECT DISTINCT a.q AS caller, b.q AS callee_name, 'Associated' AS call_type FROM calls c JOIN r a ON a.id = c.src JOIN r b ON b.id = c.dst")
def _(g: Graph, *_):
    return rust.tables(rust.scan(sources(g), "raw_calls"))["raw_calls"].select("caller", "callee_name", "call_type")


@query("S10_ingest_edges", RUST + " SELECT DISTINCT a.q AS src, b.q AS dst FROM calls c JOIN r a ON a.id = c.src JOIN r b ON b.id = c.dst")
def _(g: Graph, spark: SparkSession, _d):
    at = scratch(spark, "sources")  # a scan reads them, and the search for framework entry points
    sources(g).write.option("compression", "zstd").parquet(at)
    release(spark)
    built, _ = ingest.build(spark.read.parquet(at))
    of = lambda k: built.functions.select(F.col("id").alias(k), F.col("qualified_name").alias(f"{k}_name"))
    return built.calls.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))


ITEMS = """/// Doc {id}.
/** More. */
pub struct S{id} {{ a: u8, pub b: ActorRef<T{id}Actor> }}
enum E{id} {{ A, B(u8), C {{ x: i32 }} }}
pub(crate) trait Q{id} {{ fn area(&self) -> u8; }}
impl Q{id} for S{id} {{ fn area(&self) -> u8 {{ vec![1, 2]; 1 }} }}
impl Actor for S{id} {{ async fn on_start(&mut self) {{ T{id}Actor::spawn(T{id}Actor::new()); tokio::spawn(x); self.b.tell(PingMessage {{}}); ctx.ask(OwnAsk); }} }}
impl Message<Ping{id}Ask> for S{id} {{ type Reply = u32; async fn handle(&mut self) {{}} }}
#[distributed_actor] pub struct D{id} {{ x: u8 }}
mod inner {{ pub unsafe fn deep<T>(n: &T) {{}} }}
use a{id}::{{b as c, d}};
type L{id} = u8;
"""


def items(g: Graph) -> DataFrame:
    """(path, crate, text): one file for each function, with items of every kind. Ids are dealt out before texts are made: thousands of files come from a row group that one task
    reads, and what a task has to parse shows in no size that Spark deals by."""
    crate = F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))
    text = F.lit(ITEMS.replace("{{", "{").replace("}}", "}").replace("{id}", "@"))
    ids = g.functions.select("id").repartition(4 * g.functions.sparkSession.sparkContext.defaultParallelism, "id")
    f = ids.select(F.concat(F.lit("/ws/"), crate, F.lit("/src/m"), F.col("id").cast("string"), F.lit(".rs")).alias("path"), crate.alias("crate"), F.replace(text, F.lit("@"), F.col("id").cast("string")).alias("text"))
    return f


def read_items(g: Graph, table: str) -> DataFrame:
    return rust.tables(rust.scan(items(g), table))[table]


FILES = ", i AS (SELECT CAST(id AS VARCHAR) AS n, 'k' || id % 7 AS c, 'k' || id % 7 || '::m' || id AS q FROM functions)"


@query("P3_contexts", FILES + """ SELECT i.q || t.a AS qualified_name, t.b AS context, t.c AS is_trait_impl, t.d AS is_method, t.e AS is_async, t.f AS is_unsafe, t.g AS is_generic, t.h AS return_type, t.l AS line_start, t.m AS module FROM i,
 LATERAL (VALUES ('::Q' || n || '::area', 'TraitDeclaration', false, true, false, false, false, 'u8', 5, 'm' || n), ('::S' || n || '::area', 'TraitImpl', true, true, false, false, false, 'u8', 6, 'm' || n), ('::S' || n || '::on_start', 'TraitImpl', true, true, true, false, false, NULL, 7, 'm' || n),
 ('::S' || n || '::handle', 'TraitImpl', true, true, true, false, false, NULL, 8, 'm' || n), ('::inner::deep', 'Free', false, false, false, true, true, NULL, 10, 'm' || n || '::inner')) t(a, b, c, d, e, f, g, h, l, m)""")
def _(g: Graph, *_):
    return read_items(g, "functions").select("qualified_name", "context", "is_trait_impl", "is_method", "is_async", "is_unsafe", "is_generic", "return_type", "line_start", "module")


@query("P6_types", FILES + """ SELECT i.q || t.a AS qualified_name, t.b AS kind, t.c AS visibility, t.d AS doc, t.e AS fields, t.f AS variants, t.g AS methods FROM i, LATERAL (VALUES
 ('::S' || n, 'Struct', 'pub', 'Doc ' || n || '. More.', 'a:u8|b:ActorRef<T' || n || 'Actor>', '', ''), ('::E' || n, 'Enum', 'private', NULL, '', 'A|B|C', ''), ('::Q' || n, 'Trait', 'pub(crate)', NULL, '', '', 'area'), ('::D' || n, 'Struct', 'pub', NULL, 'x:u8', '', ''), ('::L' || n, 'TypeAlias', 'private', NULL, '', '', ''), ('::S' || n || '::Reply', 'TypeAlias', 'private', NULL, '', '', '')) t(a, b, c, d, e, f, g)""")
def _(g: Graph, *_):
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.replace(x, F.lit(" "), F.lit(""))), "|").alias(c)
    return read_items(g, "types").select("qualified_name", "kind", "visibility", "doc", listed("fields"), listed("variants"), listed("methods"))


@query("P11_macros", FILES + " SELECT q || '::S' || n || '::area' AS containing, 'vec' AS name, 'builtin' AS kind, CAST(6 AS BIGINT) AS line FROM i")
def _(g: Graph, *_):
    return read_items(g, "macros").select("containing", "name", "kind", "line")


@query("P16_imports", FILES + " SELECT 'a' || n AS module_path, 'Grouped' AS import_type, 'b>c|d>' AS items FROM i")
def _(g: Graph, *_):
    shown = F.array_join(F.transform("items", lambda x: F.concat(x["name"], F.lit(">"), F.coalesce(x["alias"], F.lit("")))), "|")
    return read_items(g, "imports").select("module_path", "import_type", shown.alias("items"))


@query("P18_actors", FILES + " SELECT c || ':' || t.a AS id, t.b AS actor_type FROM i, LATERAL (VALUES ('S' || n, 'Local'), ('D' || n, 'Distributed')) t(a, b)")
def _(g: Graph, *_):
    return read_items(g, "actors").select("id", "actor_type")


@query("P23_spawns", FILES + " SELECT 'S' || n AS parent, 'T' || n || 'Actor' AS child, 'DirectType' AS pattern, 'on_start:on_start' AS context FROM i")
def _(g: Graph, *_):
    return read_items(g, "spawns").select("parent", "child", "pattern", "context")


@query("P27_handles", FILES + " SELECT 'S' || n AS actor, 'Ping' || n || 'Ask' AS message_type, 'u32' AS reply_type, true AS is_async FROM i")
def _(g: Graph, *_):
    return read_items(g, "handles").select("actor", "message_type", "reply_type", "is_async")


@query("P30_sends", FILES + " SELECT 'S' || n AS sender, t.a AS receiver, t.b AS message_type, t.c AS method FROM i, LATERAL (VALUES ('T' || n || 'Actor', 'PingMessage', 'Tell'), ('S' || n, 'OwnAsk', 'Ask')) t(a, b, c)")
def _(g: Graph, *_):
    return read_items(g, "sends").select("sender", "receiver", "message_type", "method")


@query("V1_type_rows", "SELECT id, 'type' AS kind, crate, 'crate: ' || crate || ' | type: ' || name || ' | kind: Struct | module: ' || module || CASE WHEN is_test THEN ' | docs: D' ELSE '' END || ' | fields: a, b' AS text FROM functions")
def _(g: Graph, *_):
    fields = F.array(F.lit("a: u8"), F.lit("b"))
    return V.type_rows(g.functions.select("id", "crate", "name", "module", F.lit("Struct").alias("kind"), F.when(F.col("is_test"), "D").alias("doc"), fields.alias("fields"), F.array().cast("array<string>").alias("variants")))


@query("S16_report", "SELECT (SELECT count(*) FROM crates) AS crates, (SELECT count(*) FROM functions) AS functions, (SELECT count(*) FROM actors) AS types, (SELECT count(*) FROM calls) AS calls")
def _(g: Graph, *_):
    return workspace.report(g.functions, g.actors, g.calls, g.crates)


@query("S5_package_ids", "SELECT CASE WHEN p_partkey % 3 > 0 THEN '/ws/' || p_brand END AS path, CASE WHEN p_partkey % 3 > 0 THEN 'p' || p_partkey END AS name, CASE WHEN p_partkey % 3 > 0 THEN '1.' || p_size END AS version FROM part", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    part = table(spark, d, "part")
    tail = F.concat(F.lit("@1."), F.col("p_size").cast("string"))
    brand = F.replace("p_brand", F.lit("#"), F.lit("%"))
    pid = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("registry+https://x#p"), F.col("p_partkey").cast("string"), tail)).otherwise(F.concat(F.lit("path+file:///ws/"), brand, F.lit("#p"), F.col("p_partkey").cast("string"), tail))
    path, name, version = workspace.package_id(pid)
    return part.select(F.replace(path, F.lit("%"), F.lit("#")).alias("path"), name.alias("name"), version.alias("version"))


@query("S6_kept_dependencies", ", d AS (SELECT src, dst, CASE CAST(substr(src, 7) AS INT) % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'dev' ELSE 'build' END AS kind FROM depends_on) SELECT src, dst, kind FROM d WHERE kind IN ('normal', 'dev')")
def _(g: Graph, *_):
    kind = F.element_at(F.array(*map(F.lit, ("normal", "dev", "build"))), F.substring("src", 7, 9).cast("int") % 3 + 1)
    return g.depends_on.withColumn("kind", kind).filter(workspace.kept_dependency(F.col("kind"), workspace.Config(include_dev=True)))


@query("S7_excluded", "SELECT name FROM crates WHERE NOT contains(name, '#1') AND NOT contains(name, '22')")
def _(g: Graph, *_):
    return g.crates.filter(~workspace.excluded(F.col("name"), ("#1*", "22"))).select("name")


@query("S4_discover", """, RECURSIVE_START AS (SELECT name, 0 AS depth FROM crates WHERE name = 'Brand#7'),
l1 AS (SELECT DISTINCT d.dst AS name FROM depends_on d JOIN RECURSIVE_START s ON s.name = d.src), l2 AS (SELECT DISTINCT d.dst AS name FROM depends_on d JOIN l1 ON l1.name = d.src), l3 AS (SELECT DISTINCT d.dst AS name FROM depends_on d JOIN l2 ON l2.name = d.src)
SELECT name, CAST(min(depth) AS INT) AS depth FROM (SELECT * FROM RECURSIVE_START UNION ALL SELECT name, 1 FROM l1 UNION ALL SELECT name, 2 FROM l2 UNION ALL SELECT name, 3 FROM l3) GROUP BY name""")
def _(g: Graph, *_):
    deps = g.depends_on.groupBy(F.col("src").alias("name")).agg(F.collect_list(F.struct(F.col("dst").alias("name"), F.lit("normal").alias("kind"))).alias("dependencies"))
    none = F.array().cast("array<struct<name:string,kind:string>>")
    found = g.crates.join(deps, "name", "left").select(F.concat(F.lit("/ws/"), "name").alias("path"), "name", F.lit("1").alias("version"), F.coalesce("dependencies", none).alias("dependencies"))
    return workspace.discover(found, workspace.Config(), ["Brand#7"])[0].select("name", "depth")


@query("S4_workspaces", """, p AS (SELECT id, line_start % 50 AS n, id // 50 AS bin, id % 5 AS k, module FROM functions), q AS (
  SELECT p.*, '/ws/b' || bin || CASE k WHEN 2 THEN '/skip/' WHEN 1 THEN '/other/' WHEN 4 THEN '/other/' ELSE '/m/' END || 'p' || id AS path FROM p)
SELECT 'p' || q.id AS name, q.path, CASE k WHEN 0 THEN '2.' || bin WHEN 2 THEN NULL WHEN 4 THEN '0' ELSE '1.' || n END AS version, CASE WHEN k = 2 THEN q.path ELSE '/ws/b' || bin END AS root,
  k IN (0, 2, 3) OR k = 1 AND EXISTS (SELECT 1 FROM functions f WHERE f.id = q.id - 1 AND f.id % 10 = 0) OR k = 4 AND EXISTS (SELECT 1 FROM functions f JOIN functions g ON g.id = f.id - 1 WHERE f.id = q.id - 3 AND g.id % 10 = 0) AS is_member,
  CASE WHEN k = 0 AND q.id % 10 = 0 THEN 'real' || bin % 7 || ' normal;' || CASE WHEN EXISTS (SELECT 1 FROM functions f WHERE f.id = q.id + 1) THEN 'p' || (q.id + 1) ELSE 'x' END || ' normal'
    WHEN k = 0 THEN 'real' || bin % 7 || ' normal' WHEN k = 1 AND EXISTS (SELECT 1 FROM functions f WHERE f.id = q.id + 3) THEN 'p' || (q.id + 3) || ' normal' WHEN k = 1 THEN 'y normal' WHEN k = 2 THEN 'dep normal' WHEN k = 3 THEN 't dev cfg(unix)' ELSE '' END AS dependencies
FROM q""")
def _(g: Graph, *_):
    """A package for each function, fifty to a workspace: members by a glob and by paths, excluded ones, inherited versions and dependencies, dependencies for a target."""
    number, bin_, n = F.col("id").cast("string"), F.expr("string(id div 50)"), F.expr("string(line_start % 50)")
    kind = lambda *texts: F.element_at(F.array(*texts), (F.col("id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/ws/b"), bin_, kind(*map(F.lit, ("/m/p", "/other/p", "/skip/p", "/m/p", "/other/p"))), number, F.lit("/Cargo.toml"))
    inherits, own = F.lit("version.workspace = true\n[dependencies]\ndep = { workspace = true }\n"), F.concat(F.lit('version = "1.'), n, F.lit('"\n'))
    to = lambda key, at, step: F.concat(F.lit(f'{key} = {{ path = "../{at}p'), (F.col("id") + step).cast("string"), F.lit('" }\n'))
    body = kind(
        F.concat(inherits, F.when(F.col("id") % 10 == 0, to("x", "../other/", 1)).otherwise("")),
        F.concat(own, F.lit("[dependencies]\n"), to("y", "", 3)),
        inherits,
        F.concat(own, F.lit('[target."cfg(unix)".dev-dependencies]\nt = "1"\n')),
        F.lit('version = "0"\n'),
    )
    crates = g.functions.select(path.alias("path"), F.concat(F.lit('[package]\nname = "p'), number, F.lit('"\n'), body).alias("text"))
    top = F.concat(F.lit('[workspace]\nmembers = ["m/*"]\nexclude = ["skip"]\n[workspace.package]\nversion = "2.'), bin_, F.lit('"\n[workspace.dependencies]\ndep = { package = "real'), F.expr("string(id div 50 % 7)"), F.lit('", version = "1" }\n'))
    tops = g.functions.select(F.concat(F.lit("/ws/b"), bin_, F.lit("/Cargo.toml")).alias("path"), top.alias("text")).distinct()
    rows = workspace.packages(crates.union(tops))
    deps = F.array_join(F.transform("dependencies", lambda d: F.concat_ws(" ", d["name"], d["kind"], d["target"])), ";")
    return rows.select("name", "path", "version", "root", "is_member", deps.alias("dependencies"))


@query("S10_write_and_read", "SELECT crate, count(*) AS n FROM functions GROUP BY crate")
def _(g: Graph, spark: SparkSession, _d):
    at = scratch(spark, "graph")
    g.write(at)
    return Graph.read(spark, at).functions.groupBy("crate").agg(F.count("*").alias("n"))


@query("I1_stream_state", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    at = scratch(spark, "stream")
    feed = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parque*").select(F.col("doc_id").cast("string").alias("path"), "text")
    W.content_hash(feed).select("path", "hash").writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/state")


def passed(rows: DataFrame, at: str) -> DataFrame:
    """A stream's rows, run to its end; each batch is a folder of its own, so that one that runs again overwrites it."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/out").select(rows.columns)


@query("I2_stream_once", f"WITH {STATE_SQL} SELECT path, 'Created' AS change, hash FROM s UNION ALL SELECT l.path, CASE WHEN s.path IS NULL THEN 'Created' ELSE 'Modified' END, l.hash FROM l LEFT JOIN s ON l.path = s.path WHERE s.hash IS DISTINCT FROM l.hash", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    """Two versions of all files, the older fed twice: what goes through the stream's state."""
    at, own = scratch(spark, "stream"), Y.stateful(spark)
    old, new = versions(spark, d)
    files = lambda df, day: df.select("path", F.lit("").alias("crate"), F.lit("Created").alias("change"), "text", F.lit(f"2024-01-0{day}").cast("timestamp").alias("mtime"))
    for rows in (files(old, 1), files(old, 2), files(new, 3)):  # each version is a batch, however many files it has
        rows.write.mode("append").parquet(f"{at}/in")
        out = passed(Y.once(own.readStream.schema(Y.CHANGES).parquet(f"{at}/in")).select("path", "change", "hash"), at)
    return out


@query("I1_feed_changes", """, b AS (SELECT id // 50 AS bin, string_agg(id || chr(10), '' ORDER BY id) AS one, string_agg(id || '!' || chr(10), '' ORDER BY id) AS two FROM functions GROUP BY ALL)
SELECT 1 AS step, 'Created' AS change, bin, sha256(one) AS hash FROM b WHERE bin % 5 <> 1 UNION ALL SELECT 2, 'Deleted', bin, NULL FROM b WHERE bin % 5 IN (2, 3)
UNION ALL SELECT 2, 'Created', bin, sha256(CASE bin % 5 WHEN 3 THEN two ELSE one END) FROM b WHERE bin % 5 IN (1, 3)""")
def _(g: Graph, spark: SparkSession, _d):
    """A tree of files of 50 functions each; then some go, some are written anew under other names and some come."""
    at = scratch(spark, "feed")
    lines = lambda f, mark: f.select(F.concat(F.col("id").cast("string"), F.lit(mark)).alias("value"), F.expr("id div 50").alias("bin"), "id")
    put = lambda rows: rows.repartition("bin").sortWithinPartitions("bin", "id").select("value", "bin").write.mode("append").partitionBy("bin").text(f"{at}/tree")
    kind = F.expr("(id div 50) % 5")
    run = lambda: passed(Y.changes(spark, f"{at}/tree", f"{at}/snapshots", ".txt"), f"{at}/feed")
    put(lines(g.functions.filter(kind != 1), ""))
    run()
    for b in g.functions.filter(kind.isin(2, 3)).select(F.expr("id div 50").alias("bin")).distinct().toLocalIterator():
        discard(spark, f"{at}/tree/bin={b['bin']}")
    put(lines(g.functions.filter(kind == 1), "").union(lines(g.functions.filter(kind == 3), "!")))
    run()
    rows = spark.read.schema(f"{Y.CHANGES}, batch int").parquet(f"{at}/feed/out")
    return rows.select((F.col("batch") + 1).alias("step"), "change", F.regexp_extract("path", r"bin=(\d+)", 1).cast("long").alias("bin"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("I9_refresh", ", r AS (SELECT 'crate_' || substr(crate, 7) AS c, lower(module) AS m, id FROM functions) SELECT c AS crate, count(*) AS n FROM r WHERE m <> 'small' GROUP BY c")
def _(g: Graph, spark: SparkSession, _d):
    store = W.Store(spark, scratch(spark, "store"))
    at = scratch(spark, "listing")  # a refresh reads it several times
    sources(g).withColumn("mtime", F.lit("2024-01-01").cast("timestamp")).write.option("compression", "zstd").parquet(at)
    listing = spark.read.parquet(at)
    store.refresh(listing)
    store.refresh(listing.filter("path not like '%/small.rs'"))
    return rust.tables(store.symbols())["functions"].groupBy("crate").agg(F.count("*").alias("n"))


@query("I5_affected_calls", RAW + "SELECT call_id FROM raw WHERE string_split(callee_name, '::')[-1] IN (SELECT CAST(id AS VARCHAR) FROM functions WHERE id % 9 = 0 OR id % 9 = 4)")
def _(g: Graph, *_):
    names = g.functions.select(F.col("id").cast("string").alias("name"), "id")
    return W.affected_calls(raw_calls(g), names.filter("id % 9 = 0"), names.filter("id % 9 = 4")).select("call_id")


@query("I5_maintained_edges", RAW + "SELECT DISTINCT CAST(f.id AS VARCHAR) AS src, CAST(r.callee_id AS VARCHAR) AS dst, r.line FROM resolved r JOIN functions f ON f.qualified_name = r.caller WHERE callee_id IS NOT NULL")
def _(g: Graph, spark: SparkSession, _d):
    """The projection reached by an edit: at first a module's functions have other names and a crate is missing."""
    text = lambda df, *c: df.withColumns({x: F.col(x).cast("string") for x in c})
    functions = text(g.functions, "id").withColumn("is_trait_impl", F.lit(False))
    calls = raw_calls(g).withColumns({"call_type": F.col("call_id").cast("string"), "is_synthetic": F.lit(False)})
    imports = spark.createDataFrame([], SCHEMAS["imports"])
    missing, renamed = F.col("file").contains("/Brand#7/"), F.col("file").endswith("/small.rs")
    other = lambda df, c: df.withColumn(c, F.when(renamed, F.concat(c, F.lit("_old"))).otherwise(F.col(c)))
    tables = lambda f, c: {"functions": f, "raw_calls": c, "imports": imports}
    first = tables(other(other(functions, "qualified_name"), "name").filter(~missing), other(calls, "caller").filter(~missing))
    changed = lambda df: df.filter(missing | renamed)
    links = Links(spark, scratch(spark, "links"), buckets=8)
    files = functions.select(F.col("file").alias("path")).distinct()
    links.apply(0, 1, files, tables(functions.filter("false"), calls.filter("false")), first)
    links.apply(1, 2, files.filter(F.col("path").contains("/Brand#7/") | F.col("path").endswith("/small.rs")), tables(changed(first["functions"]), changed(first["raw_calls"])), tables(changed(functions), changed(calls)))
    return links.calls(2)


# -- more of resolution

IMPLS = ", i AS (SELECT crate, file, line_start AS line, 'T' || id AS type_name, CASE id % 4 WHEN 0 THEN 'Clone' WHEN 1 THEN 'Display' WHEN 2 THEN 'Own' END AS trait_name FROM functions)"


def impls(g: Graph) -> DataFrame:
    trait = F.when(F.col("id") % 4 == 0, "Clone").when(F.col("id") % 4 == 1, "Display").when(F.col("id") % 4 == 2, "Own")
    return g.functions.select("crate", "file", F.col("line_start").alias("line"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("type_name"), trait.alias("trait_name"))


@query("R7_trait_dispatch", IMPLS + " SELECT crate, line, crate || '::' || type_name || '::' || m AS target, CAST(0.8 AS DOUBLE) AS confidence FROM i JOIN (VALUES ('Clone', 'clone'), ('Display', 'fmt')) t(n, m) ON n = trait_name")
def _(g: Graph, *_):
    return N.trait_dispatch(impls(g)).select("crate", "line", "target", "confidence")


@query("J15_implements", IMPLS + " SELECT DISTINCT i.type_name AS src, i.trait_name AS dst FROM i WHERE trait_name IN ('Own', 'Clone')")
def _(g: Graph, spark: SparkSession, _d):
    types = impls(g).select(F.col("type_name").alias("name"), F.col("type_name").alias("id"), F.lit("Struct").alias("kind"))
    traits = spark.createDataFrame([("Own", "Own", "Trait"), ("Clone", "Clone", "Trait")], "name string, id string, kind string")
    return N.implements(impls(g), types.union(traits))


@query("P17_best_impls", IMPLS + ", d AS (SELECT crate, file, line, type_name, trait_name FROM i UNION ALL SELECT crate, file, line, type_name, NULL FROM i) SELECT file, line, type_name, max(trait_name) AS trait_name FROM d GROUP BY ALL")
def _(g: Graph, *_):
    d = impls(g)
    return N.best_impls(d.unionByName(d.withColumn("trait_name", F.lit(None).cast("string")))).select("file", "line", "type_name", "trait_name")


@query("R13_method_lookup", "SELECT crate AS type_name, name AS method, coalesce(min(id) FILTER (WHERE id % 2 = 0), min(id)) AS id, count(*) FILTER (WHERE id % 2 = 0) = 0 AS by_trait FROM functions GROUP BY ALL")
def _(g: Graph, *_):
    rows = g.functions.select(F.col("crate").alias("type_name"), F.col("name").alias("method"), "id")
    return N.method_lookup(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"))


@query("V1_embedding_texts", """, t AS (SELECT *, CASE WHEN is_test THEN NULL ELSE 'About ' || name END AS doc, list_transform(range(0, id % 3), lambda k: 'T' || (id + k)) AS types, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'R' || id END AS ret FROM functions)
SELECT id, 'crate: ' || crate || ' | function: ' || name || ' | module: ' || module || coalesce(' | docs: ' || doc, '') || CASE WHEN len(types) > 0 THEN ' | params: ' || array_to_string(types, ', ') ELSE '' END || CASE WHEN ret <> '' THEN ' | returns: ' || ret ELSE '' END AS text,
  'crate: ' || crate || CASE WHEN ret <> '' THEN ' | returns: ' || ret ELSE '' END || ' | function: ' || name AS chosen FROM t""")
def _(g: Graph, *_):
    number = F.col("id").cast("string")
    types = F.transform(F.filter(F.array(*[F.when(F.col("id") % 3 > k, F.concat(F.lit("T"), (F.col("id") + k).cast("string"))) for k in range(2)]), lambda t: t.isNotNull()), lambda t: F.struct(F.lit("p").alias("name"), t.alias("type")))
    returns = F.when(F.col("id") % 4 == 1, "").when(F.col("id") % 4 > 1, F.concat(F.lit("R"), number))
    rows = g.functions.withColumns({"doc": F.when(~F.col("is_test"), F.concat(F.lit("About "), "name")), "parameters": types, "return_type": returns})
    chosen = T.embedding_text(F.col("crate"), F.col("name"), F.col("module"), returns=F.col("return_type"), fields=("return_type", "function_name"))
    return V.function_rows(rows).select("id", "text").join(rows.select("id", chosen.alias("chosen")), "id")


@query("R9_dispatched", "SELECT id, qualified_name, CAST(CASE WHEN name = 'red widget' THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence FROM functions WHERE name IN ('red widget', 'blue bolt') AND module = CASE WHEN name = 'red widget' THEN 'SMALL' ELSE 'ECONOMY' END")
def _(g: Graph, spark: SparkSession, _d):
    files = g.functions.select("file", F.concat(F.lit("use "), F.lower("module"), F.lit(";")).alias("text")).distinct()
    rules = spark.createDataFrame([("use small", "red widget", 0.95), ("use economy", "blue bolt", 0.9)], "marker string, method string, confidence double")
    return N.dispatched(g.functions, files, rules)


@query("R15_matched_patterns", "SELECT CAST(doc_id AS VARCHAR) AS file, 'a' AS family, 'word' AS name FROM documents WHERE regexp_matches(text, 'the [a-z]+') UNION ALL SELECT CAST(doc_id AS VARCHAR), 'b', 'digits' FROM documents WHERE regexp_matches(text, '[0-9]{8}')", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    p = spark.createDataFrame([("a", "word", N.checked_pattern("the [a-z]+")), ("b", "digits", N.checked_pattern("[0-9]{8}"))], "family string, name string, regex string")
    return N.matched_patterns(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"), p)


@query("R15_many_patterns", """WITH w AS (SELECT doc_id, regexp_extract(text, '[a-z]{5,}') AS w, doc_id % 4 AS k FROM documents), p AS (
  SELECT DISTINCT CASE k WHEN 0 THEN w || '[a-z]+' WHEN 1 THEN '[0-9]+ ' || w WHEN 2 THEN '(?:' || w || '){1,2}[.,]' ELSE '[A-Z]' || w || '|' || w || ' [0-9]' END AS regex FROM w WHERE w <> '')
SELECT regex AS name, count(*) AS n FROM documents JOIN p ON regexp_matches(text, regex) GROUP BY regex""", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    """Patterns of every document's first longer word, looked for in all documents; a document meets only those whose literal pieces it holds."""
    docs = table(spark, d, "documents")
    word, k = F.regexp_extract("text", "[a-z]{5,}", 0), F.col("doc_id") % 4
    regex = F.when(k == 0, F.concat("w", F.lit("[a-z]+"))).when(k == 1, F.concat(F.lit("[0-9]+ "), "w")).when(k == 2, F.concat(F.lit("(?:"), "w", F.lit("){1,2}[.,]"))).otherwise(F.concat(F.lit("[A-Z]"), "w", F.lit("|"), "w", F.lit(" [0-9]")))
    patterns = docs.select("doc_id", word.alias("w")).filter("w <> ''").select(F.lit("w").alias("family"), regex.alias("regex")).distinct().withColumn("name", F.col("regex"))
    files = docs.select(F.col("doc_id").cast("string").alias("file"), "text").repartition(spark.sparkContext.defaultParallelism, "file")  # one small file would be one task
    return N.matched_patterns(files, patterns).groupBy("name").agg(F.count("*").alias("n"))


MACROS = ", m AS (SELECT 'm' || id AS macro_id, crate, 'x, ' || upper(substr(name, 1, 1)) || substr(split_part(name, ' ', 1), 2) || ', y' AS arguments, upper(substr(name, 1, 1)) || substr(split_part(name, ' ', 1), 2) AS n FROM functions)"


def macros(g: Graph) -> DataFrame:
    return g.functions.select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("macro_id"), "crate", F.concat(F.lit("x, "), T.pascal(T.segment(F.col("name"), 1, " ")), F.lit(", y")).alias("arguments"))


@query("P32_indicator_names", MACROS + " SELECT DISTINCT crate, n AS name FROM m")
def _(g: Graph, *_):
    return N.indicator_names(macros(g))


@query("P34_generated_calls", MACROS + ", n AS (SELECT DISTINCT crate, n FROM m) SELECT crate, n || '::new' AS target, CAST(0.95 AS DOUBLE) AS confidence FROM n UNION ALL SELECT crate, 'make' || n, CAST(0.7 AS DOUBLE) FROM n")
def _(g: Graph, *_):
    crates = g.functions.select("crate").distinct()
    return N.generated_calls(crates.select("crate", F.explode(F.array(F.lit("{}::new"), F.lit("make{}"))).alias("pattern")), N.indicator_names(macros(g)))


@query("J17_constructor_calls", MACROS + " SELECT DISTINCT m.macro_id, f.id AS dst FROM m JOIN functions f ON f.crate = m.crate AND f.name = 'red widget' AND f.module LIKE 'S%'")
def _(g: Graph, *_):
    return N.constructor_calls(macros(g), g.functions, module_like="^S", name="red widget")


@query("P14_import_depth", "SELECT crate, line_start AS line, CAST(id % 5 AS INT) AS depth FROM functions WHERE id % 5 > 2 AND id % 7 <> 0")
def _(g: Graph, *_):
    path = F.concat(F.lit("a"), F.expr("repeat('::b', cast(id % 5 as int))"), F.when(F.col("id") % 7 == 0, "prelude").otherwise(""))
    return R.deep_imports(g.functions.select("crate", "file", F.col("line_start").alias("line"), path.alias("module_path"))).select("crate", "line", "depth")


@query("X10_methods", "SELECT id, replace(name, ' ', '_') AS method FROM functions")
def _(g: Graph, *_):
    return g.functions.select("id", T.method_of_pattern(F.concat(F.lit("[<X>]::a::"), F.replace("name", F.lit(" "), F.lit("_")), F.lit("(1)"))).alias("method"))


@query("X14_cosine_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""", star_sql=False)
def _(_g: Graph, spark: SparkSession, d: str):
    e = table(spark, d, "embeddings")
    b = e.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("eb"))
    return e.select(F.col("vec_id").alias("a"), "embedding").join(b, "a").select("a", "b", F.round(V.cosine(F.col("embedding"), F.col("eb")), 9).alias("similarity"))


@query("X16_type_complexity", "SELECT id, id % 3 + id % 4 + 2 * CAST(is_test AS INT) AS complexity FROM functions")
def _(g: Graph, *_):
    n = lambda k: F.array_repeat(F.lit("x"), (F.col("id") % k).cast("int"))
    return g.functions.select("id", T.type_complexity(n(3), n(4), F.lit(None).cast("array<string>"), F.col("is_test")).cast("long").alias("complexity"))


@query("T3_top_similar_crates", "SELECT crate, count(*) AS n FROM functions GROUP BY crate ORDER BY n DESC, crate LIMIT 7")
def _(g: Graph, *_):
    return topk(g.functions.groupBy("crate").agg(F.count("*").alias("n")), [F.desc("n")], ["crate"], 7)


@query("A19_budgeted_sample", "SELECT crate, k, id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY crate ORDER BY qualified_name, id) AS INT) AS k FROM functions) WHERE k <= greatest(1, 100 // (SELECT count(*) FROM crates))")
def _(g: Graph, *_):
    return C.sample_per_crate(g.functions, per_crate=max(1, 100 // g.crates.count())).select("crate", "k", "id")
