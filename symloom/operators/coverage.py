"""Reference counts and test coverage of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.operators.predicates import false_or_null, known_false, narrowed, topk

REPORT = ("crate", "name", "qualified_name", "line_start")


def unreferenced(functions: DataFrame, calls: DataFrame, *, exclude_public: bool = False, exclude_tests: bool = True, crate: str | None = None) -> DataFrame:
    """Functions that no call reaches. Rows with an unknown report column are left out."""
    rows = narrowed(functions, crate=crate, exclude_public=exclude_public, exclude_tests=exclude_tests)
    return rows.join(calls.select(F.col("dst").alias("id")), "id", "left_anti").select("id", *REPORT, "visibility").dropna()


def unused_public(functions: DataFrame, calls: DataFrame, *, entry_points: tuple[str, ...] = ("main", "test")) -> DataFrame:
    rows = functions.filter((F.col("visibility") == "pub") & ~F.col("name").isin(*entry_points) & false_or_null("is_test"))
    if "is_synthetic" in functions.columns:
        rows = rows.filter(false_or_null("is_synthetic"))
    return rows.join(calls.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.concat_ws("::", "crate", "name").alias("function"))


def _callers_tests(functions: DataFrame, calls: DataFrame) -> DataFrame:
    return calls.join(functions.select(F.col("id").alias("src"), F.coalesce("is_test", F.lit(False)).alias("by_test")), "src")


def test_only(functions: DataFrame, calls: DataFrame, *, include_public: bool = True, crate: str | None = None) -> DataFrame:
    """Functions with callers, all of which are tests."""
    callers = _callers_tests(functions, calls).groupBy(F.col("dst").alias("id")).agg(F.bool_and("by_test").alias("only"), F.count("*").alias("caller_count")).filter("only")
    rows = narrowed(functions, crate=crate, exclude_public=not include_public)
    return rows.join(callers, "id").select("id", *REPORT, "caller_count")


def tests_of(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """id, test_count: call edges from tests."""
    return _callers_tests(functions, calls).filter("by_test").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("test_count"))


def without_tests(functions: DataFrame, calls: DataFrame, *, crate: str | None = None, limit: int | None = None) -> DataFrame:
    rows = narrowed(functions, crate=crate).filter(false_or_null("is_test")).join(tests_of(functions, calls), "id", "left_anti").select("id", *REPORT)
    return rows if limit is None else topk(rows, [F.col("qualified_name")], ["id"], limit)


def with_tests(functions: DataFrame, calls: DataFrame, *, crate: str | None = None, limit: int | None = None) -> DataFrame:
    rows = narrowed(functions, crate=crate).filter(false_or_null("is_test")).join(tests_of(functions, calls), "id").select("id", *REPORT, "test_count")
    return rows if limit is None else topk(rows, [F.desc("test_count"), F.col("qualified_name")], ["id"], limit)


def reference_counts(calls: DataFrame) -> DataFrame:
    """id, reference_count: call edges, not distinct callers."""
    return calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("reference_count"))


def most_referenced(functions: DataFrame, calls: DataFrame, *, crate: str | None = None, limit: int | None = 10) -> DataFrame:
    rows = narrowed(functions, crate=crate).join(reference_counts(calls), "id").select("id", *REPORT, "reference_count")
    return topk(rows, [F.desc("reference_count")], ["id"], limit)


def most_referenced_without_tests(functions: DataFrame, calls: DataFrame, *, crate: str | None = None, limit: int | None = 10) -> DataFrame:
    """References are counted before the tested functions are left out, so the two aggregates cannot multiply."""
    rows = narrowed(functions, crate=crate).filter(false_or_null("is_test")).join(reference_counts(calls), "id").join(tests_of(functions, calls), "id", "left_anti")
    return topk(rows.select("id", *REPORT, "reference_count"), [F.desc("reference_count")], ["id"], limit)


def direct_tests(functions: DataFrame, calls: DataFrame, target) -> DataFrame:  # noqa: ANN001
    """Tests that call the target itself."""
    hit = calls.filter(F.col("dst") == F.lit(target)).select(F.col("src").alias("id")).distinct()
    return functions.filter("is_test").join(hit, "id", "left_semi").select("id", *REPORT)


def high_coupling(functions: DataFrame, calls: DataFrame, *, more_than: int = 10) -> DataFrame:
    callers = calls.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers")).filter(F.col("callers") > more_than)
    return functions.join(callers, "id").select("id", "qualified_name", "callers")


def coverage_by_crate(functions: DataFrame, *, test_name: str = "test") -> DataFrame:
    """Share of each crate's plain functions that some test in the crate names: a test's name holds the function's name; see ``tested_names``."""
    tested = tested_names(functions, test_name).withColumn("tested", F.lit(1))
    plain = functions.filter(known_false("is_test")).join(tested, ["crate", "name"], "left")
    out = plain.groupBy("crate").agg(F.count("*").alias("total"), F.count("tested").alias("tested"))
    return out.select("crate", "total", "tested", F.floor(100 * F.col("tested") / F.col("total")).alias("percent"))


#: Rolling fingerprints of names: the base, and the prime below 2^31 that they are taken by, so that products fit a long.
BASE, PRIME = 1_000_003, 2_147_483_647
#: Characters that a fingerprint spans: longer names are found by their first ones.
SPAN = 64


def _sums(text: Column) -> Column:
    """Polynomial sums of all beginnings of a text, the empty one first."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    none = F.array(F.lit(0).cast("long"))
    return F.aggregate(chars, none, lambda s, c: F.concat(s, F.array((F.element_at(s, -1) * BASE + F.ascii(c)) % PRIME)))


def _powers() -> Column:
    """The base's powers up to the span."""
    out = [1]
    for _ in range(SPAN):
        out.append(out[-1] * BASE % PRIME)
    return F.array(*[F.lit(p).cast("long") for p in out])


def name_lengths(names: DataFrame) -> DataFrame:
    """(crate, lengths): the lengths, at most ``SPAN``, that the names (crate, name) of a crate have. Lists of at most ``SPAN`` numbers."""
    return names.filter("name <> ''").select("crate", F.least(F.length("name"), F.lit(SPAN)).alias("n")).groupBy("crate").agg(F.sort_array(F.collect_set("n")).alias("lengths"))


def fingerprints(tests: DataFrame, lengths: DataFrame) -> DataFrame:
    """(crate, test, n, h): fingerprints of the stretches of each test's name that have a length of the crate's names, at most length x lengths rows a test."""
    rows = tests.join(lengths, "crate").withColumn("sums", _sums(F.col("test"))).withColumn("powers", _powers())
    rows = rows.select("crate", "test", "sums", "powers", F.explode("lengths").alias("n")).filter(F.col("n") < F.size("sums"))
    ends = F.sequence(F.col("n") + 1, F.size("sums"))
    power = F.element_at("powers", F.col("n") + 1)
    parts = F.transform(ends, lambda k: F.pmod(F.element_at("sums", k) - F.element_at("sums", k - F.col("n")) * power % PRIME, F.lit(PRIME)))
    return rows.select("crate", "test", "n", F.explode(F.array_distinct(parts)).alias("h"))


def tested_names(functions: DataFrame, test_name: str = "test") -> DataFrame:
    """(crate, name) of plain functions that a test of their crate names.

    Rolling fingerprints of a test's name are made for those lengths alone that the crate's function names have, and joined with the names' own by equality; a pair that
    agrees is held against the texts.
    """
    names = functions.filter(known_false("is_test")).select("crate", "name").distinct()
    tests = functions.filter("is_test").select("crate", F.concat(F.lit(f"{test_name}_"), "name").alias("test")).distinct()
    own = names.filter("name <> ''").withColumn("n", F.least(F.length("name"), F.lit(SPAN))).withColumn("h", F.element_at(_sums(F.left("name", F.lit(SPAN))), -1))
    hit = own.join(fingerprints(tests, name_lengths(names)), ["crate", "n", "h"]).filter(F.col("test").contains(F.col("name"))).select("crate", "name").distinct()
    held = names.filter("name = ''").join(tests.select("crate").distinct(), "crate", "left_semi").select("crate", "name")  # every text holds the empty one
    return hit.unionByName(held)


def coverage_examples(functions: DataFrame, calls: DataFrame, *, untested: int = 15, tested: int = 10) -> DataFrame:
    """The most referenced functions that no test names, and the most referenced that one does."""
    known = tested_names(functions)
    plain = functions.filter(known_false("is_test")).join(reference_counts(calls), "id")
    top = lambda rows, k, kind: topk(rows.select("id", *REPORT, "reference_count"), [F.desc("reference_count")], ["id"], k).withColumn("kind", F.lit(kind))
    return top(plain.join(known, ["crate", "name"], "left_anti"), untested, "priority_untested").unionByName(top(plain.join(known, ["crate", "name"], "left_semi"), tested, "well_tested"))


def sample_per_crate(functions: DataFrame, *, per_crate: int) -> DataFrame:
    w = Window.partitionBy("crate").orderBy("qualified_name", "id")
    return functions.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_crate).select("crate", "k", "id", "qualified_name")


def list_functions(functions: DataFrame, *, crate: str | None = None, limit: int = 20) -> DataFrame:
    """Sorted before the cut, with the counts of all and of the filtered functions."""
    total = functions.agg(F.count("*").alias("total"))
    rows = narrowed(functions, crate=crate)
    shown = topk(rows, [F.col("qualified_name")], ["id"], limit).select("id", *REPORT)
    return shown.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(rows.agg(F.count("*").alias("filtered"))))  # two one-row tables
