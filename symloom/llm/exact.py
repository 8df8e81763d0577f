"""Exact duplicates by two-pass Bloom filtering.

Texts are equal when they are identical after deleting blanks (U+0020, U+0009 to U+000D). A slim row (id, digest, length, row number) of each
document is written once; texts are read once and never shuffled. Pass one sets cells of a filter whose cells count nought, one or more:
every digest adds to ``PROBES`` cells, each task sends the cells it touched once and those it touched twice, and the merged filter keeps
one bit a cell, "touched twice". Pass two asks the filter: a digest that occurs twice has touched all its cells twice, so a row with a cell
that was touched once alone is alone and passes straight through. Only the other rows shuffle, as slim rows, and are grouped by the whole
SHA-256 digest; a row that the filter lets through by chance forms a group of one.

The filter that is broadcast has at most ``filter_bytes`` bytes. With more rows the digests are dealt to folders by their first bits, each with a filter of
its own, one after the other, so that the filter's share of false alarms and its size are the same at every size.

Of equal texts the row with the most code points in the original text stays, then the one of the smallest doc_id (null last), then the first
row. Null text is empty text. Repeated rows of a doc_id are rows like others: one row comes back for each. Other columns are
neither read nor returned, so their names cannot clash; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import mixed, scratch, small, spread_join

CELLS, PROBES, SEGMENT = 16, 3, 1 << 19
BLANKS = b" \t\n\x0b\x0c\r"
SLIM = "doc_id long, digest binary, n_points long, slice int, row long"


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, BLANKS)


def slim_rows(docs: DataFrame, slices: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of about 60 bytes for each document; ``row`` is unique once the rows are written."""
    arrow = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_points", pa.int64()), ("slice", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            digests = [hashlib.sha256(normal(t)).digest() for t in texts]
            lengths = [len(t or "") for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "digest": digests, "n_points": lengths, "slice": [int.from_bytes(d[:4], "big") * slices >> 32 for d in digests]}, schema=arrow)

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, digest binary, n_points long, slice int")
    return rows.withColumn("row", F.monotonically_increasing_id())


def cells_of(digests: pa.Array, cells: int) -> np.ndarray:
    """(n, PROBES) cells of each digest, from two of its words (double hashing)."""
    words = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)
    steps = mixed(words[:, 1]) | np.uint64(1)
    return ((words[:, 2, None] + np.arange(PROBES, dtype=np.uint64) * steps[:, None]) % np.uint64(cells)).astype(np.int64)


def touched(slim: DataFrame, cells: int) -> DataFrame:
    """(segment, twice): the filter's bits by segments of ``SEGMENT`` cells.

    A task adds up the cells of its rows and sends each touched segment's cells of one and of more; a segment is merged where it arrives, and no more
    than one is held at a time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            at, count = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for s, e in zip(*_runs(at // SEGMENT), strict=True):
                own, k = (at[s:e] % SEGMENT).astype("<u4"), count[s:e]
                rows.append((int(at[s]) // SEGMENT, own[k == 1].tobytes(), own[k > 1].tobytes()))
            return pa.RecordBatch.from_pydict({"segment": [r[0] for r in rows], "one": [r[1] for r in rows], "more": [r[2] for r in rows]}, schema=pa.schema([("segment", pa.int32()), ("one", pa.binary()), ("more", pa.binary())]))

        for batch in batches:
            if batch.num_rows:
                held.append(cells_of(batch.column(0), cells).ravel())
                n += len(held[-1])
            if n > 1 << 23:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own = np.zeros(SEGMENT, np.uint8), None
        for batch in batches:
            own = batch.column("segment")[:1]
            for one, more in zip(batch.column("one").to_pylist(), batch.column("more").to_pylist(), strict=True):
                for cells_, by in ((one, 1), (more, 2)):
                    at = np.frombuffer(cells_, "<u4")
                    counts[at] = np.minimum(counts[at] + by, 2)
        yield pa.RecordBatch.from_pydict({"segment": own, "twice": [np.packbits(counts > 1, bitorder="little").tobytes()]})

    sent = slim.select("digest").mapInArrow(pieces, "segment int, one binary, more binary")
    return sent.groupBy("segment").applyInArrow(merged, "segment int, twice binary")


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of equal neighbours."""
    cuts = np.flatnonzero(np.diff(x)) + 1
    return [0, *cuts.tolist()] if len(x) else [], [*cuts.tolist(), len(x)] if len(x) else []


def asked(slim: DataFrame, bits: np.ndarray, cells: int) -> DataFrame:
    """``slim`` with ``again``: whether all cells of the digest were touched twice."""
    sent = slim.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = cells_of(batch.column("digest"), cells)
                again = ((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again)], [*batch.schema.names, "again"])

    return slim.mapInArrow(run, f"{SLIM}, again boolean")


def filtered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_bytes: int = 64 << 20) -> DataFrame:
    """Slim rows of all documents with ``again``, which is true for every row whose normalised text occurs twice and for few others."""
    spark = docs.sparkSession
    most = filter_bytes * 8
    slices = max(1, -(-docs.count() * CELLS // most))
    at = scratch(spark, "slim")
    slim_rows(docs, slices, doc_id, text).write.partitionBy("slice").parquet(at)
    rows = spark.read.schema(SLIM).parquet(at)
    sizes = {r["slice"]: r["count"] for r in rows.groupBy("slice").count().collect()}
    out = scratch(spark, "asked")
    for k, n in sorted(sizes.items()):
        mine = rows.filter(F.col("slice") == k).select("doc_id", "digest", "n_points", "slice", "row")
        cells = min(max(SEGMENT, -(-n * CELLS // SEGMENT) * SEGMENT), 2 * most)
        bits = np.zeros(cells // 8, np.uint8)
        for segment, twice in touched(mine, cells).toLocalIterator():
            bits[segment * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(twice, np.uint8)[: len(bits) - segment * SEGMENT // 8]
        asked(mine, bits, cells).write.mode("append").parquet(out)
    return spark.read.schema(f"{SLIM}, again boolean").parquet(out) if sizes else asked(rows.select(*[c.split()[0] for c in SLIM.split(", ")]), np.zeros(SEGMENT // 8, np.uint8), SEGMENT)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, filter_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Groups are counted with partial aggregation, so a text that a third of all rows hold arrives once from each task; the join back
    is salted by row."""
    rows = filtered(docs, doc_id, text, filter_bytes)
    alone = rows.filter(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    maybe = rows.filter("again")
    best = F.min(F.struct((-F.col("n_points")).alias("longest"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = maybe.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))
    told = spread_join(maybe, groups, "digest", "row").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return alone.unionByName(told)

