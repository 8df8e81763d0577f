"""N-gram Jaccard join by MinHash banding.

1. Texts with the same word sequence are one class (a 64-bit key); everything after works on one text of a class.
2. MinHash signatures are cut into bands. The number of rows in a band is the largest for which the bands that reach the
   target recall at the threshold need at most ``hashes`` hashes.
3. One shuffle on band hashes. A bucket gives a star of edges to its least member, never all its pairs. The components of
   all stars are candidate clusters: two texts that share a bucket are in one cluster, so no candidate pair is lost.
4. Each clustered text's full shingle set is sent to its cluster once, and every pair within the cluster is verified there
   on the full sets. A cluster with more than ``block`` shingles or ``block_texts`` texts is dealt into blocks, and each pair of blocks is a task of
   its own, so memory is bounded. Pairs are counted, not emitted: a task returns a row for each text with its links
   and the least text it is connected to.
5. Components over the verified links give the classes.

Words are ``\\w+`` of the lower-cased text, shingles five words (a shorter text is one shingle). Null, empty and wordless texts
link to nothing and are classes of their own (class_id: their own doc_id). Rows without a doc_id come back with what their text
gives. Repeated rows are copies of one another. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from symloom.llm.common import SIMILARITY, cut, files_of, free, map_rows, shingles, small, spread_join, word_hashes, worker_words
from symloom.llm.components import components


def banding(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): a pair at ``similarity`` shares a band with probability ``recall`` at least."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def text_key(words: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes()))))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)[:, None]
        self.mix = rng.integers(0, 1 << 63, rows, np.uint64) | np.uint64(1)
        self.no = rng.integers(0, 1 << 63, bands, np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band."""
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        x = (grams >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 512):  # a chunk stays in the processor's cache
            part = self.a * x[at : at + 512]
            part += self.b
            np.minimum(low, part.min(1), out=low)
        band = (low.reshape(self.bands, self.rows).astype(np.uint64) * self.mix).sum(1, dtype=np.uint64) + self.no
        band = (band ^ (band >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (band ^ (band >> np.uint64(32))).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key, n (distinct shingles), bands; key is null and n 0 where a text has no words."""

    def run(batch: pa.RecordBatch) -> dict:
        known, minhash = worker_words(), MinHash(bands, rows)
        keys, sizes, all_bands = [], [], []
        for text in batch.column(1).to_pylist():
            words = word_hashes(text, known)
            grams = np.unique(shingles(words))
            keys.append(text_key(words) if len(words) else None)
            sizes.append(len(grams))
            all_bands.append(minhash(grams) if len(grams) else None)
        return {"doc_id": batch.column(0), "key": keys, "n": sizes, "bands": all_bands}

    arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])
    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, key long, n int, bands array<long>", arrow)


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, sizes of the intersections of some rows with all columns). Shingles that many columns hold are multiplied as a
    dense matrix, the others are looked up; both give exact counts."""
    m = len(cols)
    flat = np.concatenate(cols)
    names, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(c) for c in cols])
    common = df > max(32, m // 12)
    place = np.full(len(names), -1)
    place[common] = np.arange(common.sum())
    dense = np.zeros((m, int(common.sum())), np.float32)
    hit = common[inverse]
    dense[owner[hit], place[inverse[hit]]] = 1
    order = np.argsort(inverse, kind="stable")
    posts, first = owner[order], np.concatenate(([0], np.cumsum(df)))
    step = max(1, min(1024, (8 << 20) // max(m, dense.shape[1], 1)))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        own = np.zeros((len(part), dense.shape[1]), np.float32)
        counts = np.zeros((len(part), m), np.float32)
        for k, grams in enumerate(part):
            spot = np.searchsorted(names, grams)
            spot[spot == len(names)] = 0
            spot = spot[names[spot] == grams]
            own[k, place[spot[common[spot]]]] = 1
            rare = spot[~common[spot]]
            if len(rare):
                n = df[rare]
                go = np.repeat(first[rare] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                counts[k] = np.bincount(posts[go], minlength=m)
        if dense.shape[1]:
            counts += own @ dense.T
        yield at, counts


def linked(rows: list[np.ndarray], cols: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, mask of the columns whose Jaccard similarity reaches the threshold)."""
    n_cols = np.array([len(c) for c in cols], np.float64)
    for at, counts in overlaps(rows, cols):
        n_rows = np.array([len(r) for r in rows[at : at + len(counts)]], np.float64)
        # in float64: float32 rounds ties away
        mask = np.multiply(counts, 1 + similarity, dtype=np.float64) >= similarity * (n_rows[:, None] + n_cols) - 1e-6
        for k in range(len(counts)):
            yield at + k, mask[k]


def verify(keys: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, across: bool, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least connected key, linked documents, linked texts) of each text. ``across``: only pairs of the two sides."""
    label, docs, texts = np.arange(len(keys)), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    left = np.flatnonzero(~side) if across else np.arange(len(keys))
    right = np.flatnonzero(side) if across else left
    if not len(left) or not len(right):
        return keys, docs, texts
    for k, mask in linked([sets[i] for i in left], [sets[i] for i in right], similarity):
        if not across:
            mask[k] = False
        found = right[mask]
        if not len(found):
            continue
        i = left[k]
        docs[i] += copies[found].sum()
        texts[i] += len(found)
        if across:
            docs[found] += copies[i]
            texts[found] += 1
        near = label[found]
        low, high = min(near.min(), label[i]), max(near.max(), label[i])
        if low != high:
            label[np.isin(label, np.append(near, label[i]))] = low
    root = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(root, label, keys)
    return root[label], docs, texts


VERIFIED = "key long, root long, blocks int, docs long, texts long"
VERIFIED_ARROW = pa.schema([("key", pa.int64()), ("root", pa.int64()), ("blocks", pa.int32()), ("docs", pa.int64()), ("texts", pa.int64())])


def join(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """doc_id, class_id (the least doc_id of its class), n_links (other documents that reach the similarity), n_texts (other texts)."""
    return classes(docs, **how).drop("key", "root")


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """The rows with the key of their text in a further column."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            words = (word_hashes(t, worker_words()) for t in batch.column(at).to_pylist())
            yield batch.append_column(name, pa.array([text_key(w) if len(w) else None for w in words], pa.int64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def classes(docs: DataFrame, *, similarity: float = SIMILARITY, recall: float = 0.9995, hashes: int = 256, block: int = 1_000_000, block_texts: int = 512) -> DataFrame:
    """The rows of ``join`` with the key of their text and of their class (``root``), both null without words."""
    bands, rows = banding(similarity, recall, hashes)
    sig = cut(signatures(docs, bands, rows))
    n_docs = sig.count()
    reps = cut(sig.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.any_value("bands").alias("bands")), n_docs)
    in_band = reps.select("key", F.explode("bands").alias("band"))
    lead = in_band.groupBy("band").agg(F.min("key").alias("lead"), F.count("*").alias("m")).filter("m > 1").select("band", "lead")
    stars = spread_join(in_band, lead, "band", "key").filter("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b")).distinct()
    member = cut(components(stars, most=bands * n_docs).select(F.col("node").alias("key"), F.col("root").alias("cluster")), n_docs)

    light = reps.select("key", "rep", "copies", "n")
    wanted = member.join(light, "key")
    large = wanted.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count("*") / block_texts)).cast("int").alias("blocks")).filter("blocks > 1")
    wanted = spread_join(wanted, large, "cluster", "key", "left").select(F.col("rep").alias("doc_id"), "key", "cluster", "copies", F.coalesce("blocks", F.lit(1)).alias("blocks"))

    def sets(batch: pa.RecordBatch) -> dict:
        known, keep, out = worker_words(), [], []
        for k, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            words = word_hashes(text, known)
            if len(words) and text_key(words) == key:  # another row may share the doc_id
                keep.append(k)
                out.append(np.unique(shingles(words)).tobytes())
        kept = pa.array(keep, pa.int64())
        return {n: batch.column(c).take(kept) for c, n in ((0, "key"), (2, "cluster"), (3, "copies"), (4, "blocks"))} | {"grams": out}

    arrow = pa.schema([("key", pa.int64()), ("cluster", pa.int64()), ("copies", pa.int64()), ("blocks", pa.int32()), ("grams", pa.binary())])
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("key", "text", "cluster", "copies", "blocks")
    if not reps.filter("rep is null").isEmpty():  # texts that no row with a doc_id holds
        unnamed = keyed(docs.filter("doc_id is null").select("text"), "key").join(wanted.filter("doc_id is null").drop("doc_id"), "key")
        texts = texts.unionByName(unnamed)
    grams = map_rows(texts, sets, "key long, cluster long, copies long, blocks int, grams binary", arrow)
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = (
        grams.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "copies", "blocks", (F.col("own") > F.col("other")).alias("side"), "grams")
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j", "key")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: list[tuple] = []

        def done() -> None:
            keys, at = np.unique(np.array([h[0] for h in held], np.int64), return_index=True)
            rows_ = [held[i] for i in at]
            side = np.array([h[3] for h in rows_], bool)
            root, n_docs, n_texts = verify(keys, [np.frombuffer(h[4], np.uint64) for h in rows_], np.array([h[1] for h in rows_], np.int64), side, now[1] != now[2], similarity)
            out.extend(zip(keys.tolist(), root.tolist(), [h[2] for h in rows_], n_docs.tolist(), n_texts.tolist(), strict=True))

        for batch in small(batches):
            c, i, j, *rest = [batch.column(k).to_pylist() for k in range(8)]
            for group, row in zip(zip(c, i, j, strict=True), zip(*rest, strict=True), strict=True):
                if group != now:
                    if held:
                        done()
                    now, held = group, []
                held.append(row)
            if len(out) > 4096:
                yield pa.RecordBatch.from_pydict(dict(zip(VERIFIED_ARROW.names, map(list, zip(*out, strict=True)), strict=True)), schema=VERIFIED_ARROW)
                out = []
        if held:
            done()
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(VERIFIED_ARROW.names, map(list, zip(*out, strict=True)), strict=True)), schema=VERIFIED_ARROW)

    # a row for each text and block it meets; dealt anew, so that pairs are verified in as many tasks as they were and few write files
    n_verified = wanted.agg(F.sum("blocks")).first()[0] or 0
    verified = cut(dealt.mapInArrow(check, VERIFIED).repartition(files_of(docs.sparkSession, n_verified)))
    counts = verified.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    whole = verified.filter("blocks = 1").select("key", "root")
    parts = verified.filter("blocks > 1").select(F.col("key").alias("a"), F.col("root").alias("b"))
    if n_parts := parts.count():
        whole = whole.union(components(parts, most=n_parts).select(F.col("node").alias("key"), "root"))
    rooted = light.join(whole, "key", "left").join(counts, "key", "left").withColumn("root", F.coalesce("root", "key"))
    class_of = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_key = spread_join(rooted, class_of, "root", "key").select("key", "root", "class_id", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    return sig.select("doc_id", "key").join(by_key, "key", "left").select("doc_id", "key", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


def keep_one(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """One row of each class stays (the least doc_id; without one only where no row of the class has one), with the columns it had. Rows
    without words stay, each doc_id and text once."""
    found = classes(docs, **how)
    n, ids = found.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        kept = cut(found.filter("doc_id = class_id").select("doc_id"), n)
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    # ids that repeat or are null name no row: the key of the text does
    k, best = free(docs.columns, "_k"), free(docs.columns, "_best")
    first = found.filter("key is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("b"))
    kept = cut(first.select(F.col("b.key").alias(k), F.col("b.doc_id").alias(best)), n)
    rows = keyed(docs, k)
    held = rows.join(kept, k).filter(F.col("doc_id").eqNullSafe(F.col(best))).drop(best)
    bare = rows.filter(F.col(k).isNull())
    out = held.unionByName(bare.filter("doc_id is not null")).withColumn(best, F.row_number().over(Window.partitionBy("doc_id", k, F.when(F.col(k).isNull(), F.col("text"))).orderBy("text")))
    return out.filter(F.col(best) == 1).select(docs.columns).unionByName(bare.filter("doc_id is null").select(docs.columns))
