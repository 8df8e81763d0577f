"""Strong components, line ranges, merged definitions and paths that stand for all, against plain versions and on shapes that are hard at scale."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from symloom.operators import architecture as R
from symloom.operators import impact as I
from symloom.operators import resolve as N
from symloom.operators.strong import strong_components


def reach(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    got = {}
    for s in {x for e in edges for x in e}:
        seen, todo = set(), [s]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        got[s] = seen
    return got


def ring(names):
    return list(zip(names, [*names[1:], names[0]], strict=True))


@pytest.mark.parametrize("seed", range(2))
def test_components_are_mutual_reach(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range((25, 45)[seed])]
    edges += ring([40 + k for k in range(9)]) + [(48 + k, 49 + k) for k in range(9)] + [(57, 40)] * (seed == 1) + [(70, 70), (70, 71), (71, 72)] + ring([80, 81]) + [(81, 82), (82, 83), (83, 81)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 3), (4, None)], "src long, dst long")
    far = reach(edges)
    want = {(a, b) for a in far for b in far[a] if a in far.get(b, ())}
    part = {r["node"]: r["component"] for r in strong_components(df).collect()}
    assert {(a, b) for a in part for b in part if part[a] == part[b]} == want
    assert set(map(tuple, R.cycles(df).collect())) == want
    assert strong_components(df.filter("false")).count() == 0


def test_a_long_chain_with_a_ring(spark):
    """Chains shrink by a share each round: few rounds, and only the ring is a component."""
    n, low, high = 1_200, 500, 640
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = chain.union(spark.createDataFrame([(high, low)], "src long, dst long"))
    got = strong_components(edges)
    assert got.agg(F.count("*"), F.min("node"), F.max("node"), F.countDistinct("component")).first() == (high - low + 1, low, high, 1)


def test_ranges_meet_one_bin_a_level(spark):
    """A file of 50,000 functions: a point asks a bin of each level, whatever the number of functions over it."""
    rng = random.Random(2)
    rows = [("a", f"a{k}", s := rng.randrange(3000), s + rng.randrange(0, 400)) for k in range(3000)] + [("b", "none", 9, 3), ("b", "one", 5, 5), ("b", "all", 0, (1 << 30) + 1), (None, "x", 1, 2), ("c", "y", None, 4)]
    f = spark.createDataFrame(rows, "file string, id string, line_start long, line_end long")
    points = [("a", k) for k in range(0, 3500, 7)] + [("b", 5), ("b", 1 << 30), ("b", (1 << 30) + 2), ("c", 4), ("d", 1), (None, 1), ("a", None)]
    got = {(r["file"], r["line"]): r["function_id"] for r in N.containing(spark.createDataFrame(points, "file string, line long"), f).collect()}
    want = {}
    for p, line in points:
        own = [(e - s, i) for q, i, s, e in rows if q == p and None not in (p, line, s) and s <= line <= e]
        if own:
            want[p, line] = min(own)[1]
    assert got == want
    many = spark.range(50_000).select(F.lit("m").alias("file"), F.col("id").cast("string").alias("id"), (F.col("id") % 100).alias("line_start"), (F.lit(200_000) - F.col("id")).alias("line_end"))  # all nested about one line
    bins = N.line_bins(many)
    assert bins.groupBy("file", "level", "bin").count().filter("count > 1").count() == 0
    assert [tuple(r) for r in N.containing(spark.createDataFrame([("m", 120_000)], "file string, line long"), many).collect()] == [("m", 120_000, "49999")]


def test_merged_definitions_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"q{k % 7}", rng.randrange(200), rng.random() < 0.3) for k in range(300)] + [("q0", 5, None)]
    want, lines = {}, defaultdict(list)
    for q, line, t in rows:
        lines[q].append((line, bool(t)))
    for q, own in lines.items():
        start = None
        for line, t in sorted(own):
            if start is None or line - start > 5:
                start = line
                want[q, start] = [0, False]
            want[q, start] = [want[q, start][0] + 1, want[q, start][1] or t]
    got = N.consolidated(spark.createDataFrame(rows, "qualified_name string, line_start long, is_trait_impl boolean"))
    assert {(r["qualified_name"], r["line_start"]): [r["merged"], r["is_trait_impl"]] for r in got.collect()} == want


def trails(edges, target, depth):
    """{(function, distance)} by every path that uses no edge twice."""
    into = defaultdict(list)
    for k, (a, b) in enumerate(edges):
        into[b].append((k, a))
    found, front = set(), [(target, frozenset())]
    for d in range(1, depth + 1):
        front = [(a, used | {k}) for at, used in front for k, a in into[at] if k not in used]
        found |= {(a, d) for a, _ in front}
        front = list(set(front))
    return found


@pytest.mark.parametrize("seed", range(2))
def test_impact_of_multigraphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(5), rng.randrange(5)) for _ in range(11)]
    calls = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(edges)], "src long, dst long, line long")
    got = I.expand(calls, spark.createDataFrame([(0,), (1,)], "target long"), 5, ("line",))
    assert {tuple(r) for r in got.collect()} == {(t, a, d) for t in (0, 1) for a, d in trails(edges, t, 5)}


def test_a_deep_impact_has_a_small_plan(spark):
    """Eight levels: no window, and families that are bounded whatever order the paths come in."""
    rows = [(k, k + 1, j) for k in range(12) for j in range(3)] + [(12, 0, 0)]
    calls = spark.createDataFrame(rows, "src long, dst long, line long")
    got = I.expand(calls, spark.createDataFrame([(12,)], "target long"), 8, ("line",))
    assert "Window" not in got._jdf.queryExecution().toString()
    assert {tuple(r)[1:] for r in got.collect()} == {(12 - d, d) for d in range(1, 9)}


def test_kept_paths_are_few_and_stand_for_all(spark):
    rng = random.Random(1)
    for length, more in ((1, 3), (2, 2)):
        paths = sorted({tuple(sorted(rng.sample(range(8), length))) for _ in range(25)})
        df = spark.createDataFrame([(0, k % 2, list(p)) for k, p in enumerate(paths)], "target long, at long, path array<bigint>")
        kept = [(r["at"], tuple(r["path"])) for r in I.representative(df, length, more).collect()]
        for at in (0, 1):
            own, few = [set(p) for p in paths[at::2]], [set(p) for a, p in kept if a == at]
            assert all(p in own for p in few) and len(few) <= sum(length**k for k in range(more + 1))
            for ban in itertools.combinations(range(8), more):
                assert any(not p & set(ban) for p in own) == any(not p & set(ban) for p in few)
