"""Clustered tables open few files, and the index of names finds what a scan finds from few postings."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from symloom.model import Graph, empty
from symloom.operators import coverage as C
from symloom.operators import names as X
from symloom.operators import resolve as N
from symloom.operators import stats as S
from symloom.plans.engine import Engine, explained
from symloom.sources import clustered


def scanned(df) -> tuple[int, int]:
    """(files, rows) that the scans of a frame's last run read."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    of = lambda k: sum(leaves.apply(i).metrics().apply(k).value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains(k))
    return of("numFiles"), of("numOutputRows")


@pytest.fixture(scope="module")
def many(spark):
    rows = spark.range(200_000).select(F.concat_ws("::", F.concat(F.lit("crate"), F.expr("string(id % 50)")), F.lit("part"), F.format_string("fn_%06d", "id")).alias("qualified_name"), "id")
    return rows.select(F.col("id").cast("string").alias("id"), F.substring_index("qualified_name", "::", -1).alias("name"), "qualified_name")


def test_a_lookup_opens_few_files(spark, many, tmp_path):
    at = str(tmp_path / "a b%20c")
    clustered.write(many, at, "id", files=64, blooms=("name",))
    assert spark.read.parquet(f"{at}.files").count() == 64
    got = clustered.read(spark, at, "id", ["77777"])
    assert [tuple(r) for r in got.collect()] == [("77777", "fn_077777", "crate27::part::fn_077777")]
    files, rows = scanned(got)
    assert files <= 2 and rows <= 2 * clustered.PAGE
    assert clustered.read(spark, at, "id", ["zzz"]).count() == clustered.read(spark, at, "id", []).count() == 0
    assert clustered.read(spark, at, "id", ["5"], prefixes=("1999",)).count() == 1 + 111


def test_a_hot_key_lies_in_several_files(spark, tmp_path):
    at = str(tmp_path / "hot")
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    clustered.write(rows, at, "k", "id", files=16)
    assert clustered.read(spark, at, "k", ["hot"]).count() == 20_000
    assert spark.read.parquet(f"{at}.files").agg(F.max("n")).first()[0] < 8_000


def test_nothing_and_nulls(spark, tmp_path):
    at = str(tmp_path / "none")
    clustered.write(spark.createDataFrame([], "k string, v int"), at, "k")
    assert clustered.read(spark, at, "k", ["x"]).count() == 0
    clustered.write(spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int"), at, "k")
    assert [r["v"] for r in clustered.read(spark, at, "k", ["x"]).collect()] == [2]


def test_symbols_equal_a_scan(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab:é😀") for _ in range(rng.randrange(0, 12)))
    rows = [(i, rng.choice([None, word(), "ab"]), rng.choice([None, word(), word(), "ababababab"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, qualified_name string")
    targets = {word() for _ in range(25)} | {"a", "ab", "é😀", "ababab", "bab", "ababababab", "none at all"}
    want = {(t, i) for t in targets if t for i, n, q in rows if n == t or (q is not None and t in q)}
    got = X.find_all(X.postings(df), spark.createDataFrame([(t,) for t in [*targets, None, ""]], "target string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    at = str(tmp_path / "names")
    X.write_index(df, at, files=4)
    for t in sorted(targets - {""})[:8] + ["a", "ab", "bab"]:
        ids = [r["id"] for r in X.find(spark, at, t).collect()]
        assert len(ids) == len(set(ids)) and set(ids) == {i for u, i in want if u == t}, t


def test_only_the_targets_postings_are_read(spark, many, tmp_path):
    at = str(tmp_path / "index")
    X.write_index(many, at, files=64)
    target = "fn_01234"
    total = spark.read.parquet(at).count()
    pieces = [target, *{g for g, _ in X.cover(target)}]
    rows = clustered.read(spark, at, "gram", pieces)
    matching = rows.count()
    read = clustered.read(spark, at, "gram", pieces)
    read.collect()
    files, n = scanned(read)
    assert n <= matching + 2 * clustered.PAGE * files and n < total / 4
    assert X.find(spark, at, target).count() == 10 == many.filter(F.col("qualified_name").contains(target)).count()


def test_a_stored_graph_is_served_by_its_index(spark, tmp_path):
    f = spark.createDataFrame([("a", "run", "k::run", "k"), ("b", "runner", "k::m::runner", "k"), ("c", "other", "k::other", "k")], "id string, name string, qualified_name string, crate string")
    calls = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), ("a", "b", 3)], "src string, dst string, line long")
    g = Graph(f, calls, *[empty(spark, t) for t in ("crates", "depends_on", "actors", "sends", "handles", "spawns")])
    at = str(tmp_path / "graph")
    g.write(at, files=4)
    back = Graph.read(spark, at)
    assert back.functions.count() == 3 and back.calls.count() == 3
    want = S.symbol_impact(f, calls, "run").collect()
    assert S.symbol_impact(back.functions, back.calls, "run", X.find(spark, f"{at}/names", "run")).collect() == want
    assert Engine(back, at=at).matches("run").collect() == Engine(back).matches("run").collect()
    g.write(at)  # without ranges: what no longer belongs to the tables goes
    assert Graph.read(spark, at).functions.count() == 3 and Engine(Graph.read(spark, at), at=at).matches("run").count() == 2


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc[0-9]defgh+", ("defgh",)), ("(?:abc){2,}x", ("abc",)), ("ab(c|d)efg", ("efg",)), ("(abc)?de", ()), ("abc|de", ()), ("abcd|x(wxyz)+", ("abcd", "xwxyz")), ("a.c|abc", ()),
        ("(?i)abcdef", ()), ("(?i:abcdef)ghi", ("ghi",)), (r"\Qabc\E", ()), (r"^abc$", ("abc",)), ("[abc]{3}", ()), ("abc{0}def", ("def",)), ("(?=abc)x", ()), ("(", ()), (r"\.rs\b", (".rs",)), ("(?:one|two)three", ("three",)), ("x*?yzzy", ("yzzy",)),
    ],
)
def test_required_literals(pattern, want):
    assert N.required_literals(pattern) == want


def test_a_thousand_patterns(spark, sf):
    """Every pattern against every document, by brute force; far fewer pairs are tried, and no pattern is paired with every document by a nested loop."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), "text").limit(60).cache()
    texts = {r["file"]: r["text"] for r in docs.collect()}
    rng = random.Random(3)
    words = sorted({w for t in texts.values() if t for w in re.findall(r"[^\W\d_]{6,}", t)})
    forms = ["{}[a-z]*", "(?:{})+[ .]", "{}|{}", r"\b{}", "[0-9]{{2}} {}", "(?i){}", "{} .{{3}}"]
    rows = [(str(k % 3), str(k), form.format(*[re.escape(rng.choice(words)) for _ in range(2)])) for k, form in ((k, forms[k % 7] if k % 50 else forms[5]) for k in range(1000) if k % 7 != 5 or k % 50 == 0)]
    patterns = spark.createDataFrame([*rows, ("0", "null", None)], "family string, name string, regex string")
    want = {(f, fam, n) for fam, n, p in rows for f, t in texts.items() if t is not None and re.search(p, t, re.ASCII if "(?i)" in p else 0)}
    found = N.matched_patterns(docs, patterns)
    assert "BroadcastNestedLoopJoin" not in explained(found, "simple")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert N.pattern_candidates(docs, patterns).count() < 0.1 * len(rows) * len(texts)


def test_patterns_and_texts_without_anything(spark):
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "xyz abc"), ("c", "xyz abc")], "file string, text string")
    p = lambda *rows: spark.createDataFrame(rows, "family string, name string, regex string")
    got = N.matched_patterns(docs, p(("f", "1", "abc|xyz"), ("f", "1", "abc|xyz"), ("g", "2", ""), ("g", "3", "x")))
    assert sorted(map(tuple, got.collect())) == sorted([("b", "g", "2")] + 2 * [("c", "f", "1"), ("c", "f", "1"), ("c", "g", "2"), ("c", "g", "3")])
    assert N.matched_patterns(docs, p()).count() == 0 and N.matched_patterns(docs.limit(0), p(("f", "1", "a"))).count() == 0


def test_names_in_tests_names(spark):
    """Containment by fingerprints equals a scan, and the stretches are bounded by length x distinct lengths."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab_é") for _ in range(rng.randrange(0, n)))
    rows = [(rng.choice(["k", "m", None]), word(40) if t else word(8), t) for t in (rng.random() < 0.4 for _ in range(400))] + [("k", "a" * 70, False), ("k", "a" * 70 + "b", False), ("k", "b" + "a" * 72, True), ("m", None, True), ("m", "x", None)]
    f = spark.createDataFrame(rows, "crate string, name string, is_test boolean")
    tests = {(c, "test_" + n) for c, n, t in rows if t and n is not None}
    want = {(c, n) for c, n, t in rows if t is False and n is not None for d, x in tests if c is not None and c == d and n in x}
    got = [tuple(r) for r in C.tested_names(f).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("k", "a" * 70) in want
    names = f.filter("not is_test").select("crate", "name").distinct()
    lengths = C.name_lengths(names)
    n = {r["crate"]: len(r["lengths"]) for r in lengths.collect()}
    made = C.fingerprints(spark.createDataFrame(sorted(tests, key=str), "crate string, test string"), lengths).count()
    assert made <= sum(len(x) * n.get(c, 0) for c, x in tests)


def test_patterns_of_few_syllables(spark):
    """Where all short pieces occur everywhere, a text still meets only patterns whose literals it holds, without looking at the others' pieces."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ti", "on", "en", "th"]) for _ in range(5))
    words = sorted({word() for _ in range(200)})
    texts = {str(k): " ".join(rng.choice(words) for _ in range(20)) for k in range(20)}
    many = "|".join(words[::4])
    rows = [*(f"{w}[a-z]*" for w in words), *(f"[A-Z]{w}|{w} [a-z]" for w in words), many, "a|b|" + many]
    docs = spark.createDataFrame([*texts.items(), ("none", None)], "file string, text string")
    patterns = spark.createDataFrame([("f", p, p) for p in rows], "family string, name string, regex string")
    want = sorted((f, "f", p) for p in rows for f, t in texts.items() if re.search(p, t))
    assert sorted(map(tuple, N.matched_patterns(docs, patterns).collect())) == want
    keyed, lengths, most = N.keyed_patterns(patterns)
    assert max(lengths) == 7 and most <= N.MOST_LITERALS
    assert keyed.filter("length(regex) < 40 and (size(literals) <> 1 or length(pieces[0]) <> 7)").count() == 0  # not the three last letters, of which there are few
