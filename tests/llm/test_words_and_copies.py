"""Ranked search, exact duplicates and spelling variants against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import exact, queries, spelling, wand
from symloom.llm.common import table
from tests.llm.test_operators import docs, nothing, odd, real  # noqa: F401

TABLES = ("documents", "benchmark")


@pytest.mark.parametrize("name", ["op11_wand", "op12_exact_dedup", "op13_spelling"])
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert want and collections.Counter(map(tuple, df.select(*cols).collect())) == collections.Counter(want)


# -- ranked search


def brute_rank(rows, items, top=50):
    """Rows (doc_id, text) for each item: every document scored."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    held = [(d, cut(t)) for d, t in rows]
    held = [(d, collections.Counter(w), len(w)) for d, w in held if w]
    n, total = len(held), sum(x[2] for x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = {}
    for item in {i for i, t in items if i is not None and t is not None}:
        terms = {t for i, x in items if i == item for t in cut(x)}
        scored = []
        for d, c, size in held:
            m = 100 - 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score:
                scored.append((-score, d is None, d))
        out[item] = [(d, -s) for s, _, d in sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top]]
    return {i: x for i, x in out.items() if x}


def ranked(found):
    out = collections.defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return dict(out)


def some_texts(seed, n, words=400):
    rng = random.Random(seed)
    pool = [f"{rng.choice('abcdeéß')}{k}" for k in range(words)]
    share = [1 / (1 + k) for k in range(words)]
    return [(d, " ".join(rng.choices(pool, share, k=rng.randrange(1, 120)))) for d in range(n)], rng, pool


@pytest.mark.parametrize(("shard_docs", "window", "slice_chars", "top"), [(1 << 15, 1024, 12_000_000, 50), (7, 3, 12_000_000, 5), (64, 1, 300, 50)])
def test_ranks_are_those_of_brute_force(spark, tmp_path, shard_docs, window, slice_chars, top):
    rows, rng, pool = some_texts(1, 300)
    rows += [(None, rows[3][1]), (5, rows[3][1]), (3, rows[3][1]), (900, None), (901, ""), (902, "., !"), (903, "ÀB à_b\x00c\x7fd" * 3)]
    items = [(i, " ".join(rng.sample(pool, 12))) for i in range(20)] + [(3, "b1 c1 b1"), (50, None), (51, ""), (None, "a1"), (52, "unknown words"), (53, "Àb À")]
    made = docs(spark, *[(d, t, "en") for d, t in rows]).repartition(3)
    at = str(tmp_path / "index")
    wand.write(made, at, shard_docs=shard_docs)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = ranked(wand.search(wand.read(spark, at), asked, top=top, slice_chars=slice_chars, window=window))
    want = brute_rank(rows, items, top)
    assert got == want and 53 in want and 52 not in want


def test_ranks_of_odd_and_no_rows(spark, tmp_path, odd, nothing, sf):  # noqa: F811
    items = spark.createDataFrame([(1, "one text word5 é́ 😀 123"), (2, None)], "item_id long, text string")
    for k, (d, i) in enumerate([(odd, items), (nothing, items), (odd, items.filter("false")), (odd.filter("text is null"), items)]):
        wand.write(d, str(tmp_path / str(k)))
        got = ranked(wand.search(wand.read(spark, str(tmp_path / str(k))), i))
        assert got == brute_rank([(r["doc_id"], r["text"]) for r in d.collect()], [tuple(r) for r in i.collect()])
        assert bool(got) == (k == 0)


def test_documents_that_cannot_enter_are_skipped():
    """Rare terms lift the threshold; a document with frequent terms alone is never scored, and cursors jump over it."""
    rng = np.random.default_rng(3)
    n = 20_000
    places = [np.sort(rng.choice(n, k, replace=False)).astype(np.int32) for k in (15_000, 12_000, 300, 200)]
    added = [rng.integers(w // 2, w, len(p)) for p, w in zip(places, (100, 150, 5000, 6000), strict=True)]
    most = np.array([int(a.max()) for a in added])
    total = np.zeros(n, np.int64)
    for p, a in zip(places, added, strict=True):
        total[p] += a
    want = sorted(zip((-total).tolist(), range(n), strict=True))[:10]
    for window in (1, 64, 1024):
        heap = wand.Heap(10)
        scored = wand.wand(places, added, most, heap, np.arange(n), np.zeros(n, bool), window)
        assert list(zip((-heap.scores).tolist(), heap.ids.tolist(), strict=True)) == want
        assert scored < (1500 if window == 1024 else 900) < (total > 0).sum() / 10


# -- exact duplicates


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for k, (d, t) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d is None, d or 0, k, d))
    return collections.Counter((r[4], min(g)[4], len(g), hashlib.sha256(key.encode()).hexdigest()) for key, g in groups.items() for r in g), len(groups)


def copies(found):
    rows = found.collect()
    kept = [r for r in rows if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) and all(r["doc_id"] == r["keep_id"] for r in kept)
    return collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), len(kept)


@pytest.mark.parametrize("filter_bytes", [64 << 20, 1 << 10])
def test_copies_are_those_of_brute_force(spark, odd, nothing, filter_bytes):  # noqa: F811
    rng = random.Random(5)
    rows = [(i, "hot text") for i in range(900)] + [(i, "ho t\ttex\x0bt" + " " * (i % 4)) for i in range(900, 1000)]
    rows += [(i, f"text {rng.randrange(900)}" + "\n" * rng.randrange(3)) for i in range(1000, 2500)] + [(7, "a\xa0b"), (8, "ab"), (8, "a b"), (8, "ab"), (None, "a b"), (None, "only"), (9, None), (10, ""), (11, " \n")]
    made = docs(spark, *[(d, t, "en") for d, t in rows]).repartition(5)
    assert copies(exact.deduplicate(made, filter_bytes=filter_bytes)) == brute_copies(rows)
    for df in (odd, nothing):
        assert copies(exact.deduplicate(df, filter_bytes=filter_bytes)) == brute_copies([(r["doc_id"], r["text"]) for r in df.collect()])


def test_single_rows_pass_straight_through(spark):
    """Every repeated text is let through by the filter, and few others: those that shuffle."""
    made = docs(spark, *[(i, f"text number {i if i % 10 else i % 50}", "en") for i in range(20_000)])
    for filter_bytes, slices in ((64 << 20, 1), (1 << 13, 5)):
        rows = exact.filtered(made, filter_bytes=filter_bytes)
        assert rows.select("slice").distinct().count() == slices
        got = {r["doc_id"]: r["again"] for r in rows.collect()}
        assert len(got) == 20_000 and all(got[i] for i in range(0, 20_000, 10))
        assert sum(got.values()) - 2000 < 18_000 * 0.02


# -- spelling variants


def brute_variants(rows, least=5, ratio=5):
    counts = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        own = sorted((-m, x) for x, m in words.items() if abs(len(x) - len(w)) < 2 and near(w, x))
        form[w] = own[0][1] if own and -own[0][0] >= ratio * n else None
        out[w] = (n, len(own))
    found = set()
    for w, (n, k) in out.items():
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n, k, words.get(form[w])))
    return found


def variants(df, **more):
    rows = [tuple(r) for r in spelling.variants(df, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_words(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abÿé", k=rng.randrange(6, 10))) for _ in range(12)]
    rows = []
    for d in range(250):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 1 + rng.randrange(12)])
            for _ in range(rng.choice((0, 0, 0, 0, 1, 1, 2))):
                i = rng.randrange(len(w))
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿé") + w[i:], w[:i] + rng.choice("abÿé") + w[i + 1 :]))
            words.append(rng.choice((w, w.upper().replace("Ÿ", "ÿ").replace("É", "é"), w)))
        rows.append((d if d % 50 else None, rng.choice((" ", "-", "1", "Ā", "😀")).join(words)))
    return rows


def test_variants_are_those_of_brute_force(spark):
    rows = [*some_words(), (1000, None), (1001, ""), *[(1002, "repeated rowsss " + "z" * 3000)] * 6, *[(1003, "z" * 2999)] * 5]
    got = variants(docs(spark, *[(d, t, "en") for d, t in rows]).repartition(3))
    want = brute_variants(rows)
    assert got == want and len([w for w in want if w[1]]) > 100 and any(w[1] != w[2] for w in want if w[1])


def test_colliding_keys_are_told_apart(spark):
    words = collections.Counter(w for _, t in some_words(9) for w in runs(t))
    df = spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate(sorted(words.items())) if len(w) > 5], "id long, word string, n long")
    want = {tuple(r) for r in spelling.neighbours(df).collect()}
    assert len(want) > 100 and {tuple(r) for r in spelling.neighbours(df, bits=8).collect()} == want


def runs(text):
    return [r.decode("latin-1") for r in spelling.runs_of(text)]


def test_keys_of_a_word_alone_and_among_others():
    words = [b"banana", b"bananna", b"aaaaaa", b"\xe9t\xe9s\xff\xc0", b"ban"]
    key, word, kind, place = spelling.deletion_keys(words)
    own = {w: spelling.deletion_keys([w])[0][0] for w in words + [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]}
    for k, w, s, p in zip(key.tolist(), word.tolist(), kind.tolist(), place.tolist(), strict=True):
        if s != spelling.AT_PLACE:
            assert k == own[words[w] if s == spelling.ITSELF else words[w][:p] + words[w][p + 1 :]]
    assert len(set(own.values())) == len(own) and (np.bincount(word[kind == spelling.SHORTER]) == [6, 6, 1, 6, 3]).all()


def test_variants_of_odd_and_no_rows(odd, nothing, real):  # noqa: F811
    for df in (odd, nothing, odd.filter("text is null")):
        assert variants(df, least_count=1) == brute_variants([(r["doc_id"], r["text"]) for r in df.collect()], 1)
    text = [(r["doc_id"], r["text"]) for r in real.collect()]
    assert variants(real) == brute_variants(text)
