"""Ranked lexical search: WAND over an inverted index in document shards.

The index is a Parquet folder. Documents become shards where they are read (no shuffle): a shard holds at most ``SHARD_DOCS`` rows and about
``SHARD_CHARS`` characters, one document at least. A shard has one row for its documents (term null: ids, lengths, their number with any term, the sum of lengths)
and one for each of its terms (places of the documents that hold it, occurrences). Shard and statistics come from the same written rows.

A search broadcasts the queries in slices of about ``slice_chars`` characters, takes the corpus statistics of their terms from the index,
and sends the rows of those terms to their shards' tasks, one shard after the other. There each query runs WAND: its terms stand in the order of the
next document that each holds; the pivot is the first document at which the terms' maximum impacts add up to the heap's threshold; cursors
before it jump there. From an aligned pivot on, a stretch of ``WINDOW`` places is judged at once: documents whose terms'
maximum impacts do not reach the threshold are left out, the rest are scored and offered to the heap. Heaps go on from shard to shard
within a task, and are merged at the end.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII; only A to Z are lower-cased. Weights and impacts are
integers (see ``weight`` and ``impacts``). Rows of a doc_id that occurs twice rank on their own; equal scores rank by ascending doc_id, null last. Null and
empty texts have no terms and count nowhere; queries without known terms have no rows, queries with equal ids are merged into one. Columns other than id and text are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.common import small

SHARD_DOCS, SHARD_CHARS, WINDOW = 1 << 15, 1 << 25, 1024
TOP = 50
INDEX = "shard long, term binary, ids array<long>, places binary, counts binary, n_docs long, n_terms long"
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("ids", pa.list_(pa.int64())), ("places", pa.binary()), ("counts", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms as UTF-8: every byte beyond ASCII belongs to a term."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, w: int, n: int, total: int) -> np.ndarray:
    """What a term adds to the score of each document, in 64-bit integers."""
    m = 100 - 50 + (50 * length * n) // total
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class _Numbers(dict):
    """term -> number, in the order of first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Shard:
    """The documents of one shard while it is filled."""

    def __init__(self):
        self.numbers, self.ids, self.lengths, self.held, self.chars = _Numbers(), [], [], [], 0

    def add(self, doc: int | None, text: str | None) -> None:
        words = terms_of(text)
        place = len(self.ids)
        self.ids.append(doc)
        self.lengths.append(len(words))
        self.chars += len(text or "")
        if words:
            term, count = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)), return_counts=True)
            self.held.append((term, np.full(len(term), place, np.uint16), count.astype(np.uint32)))

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        """Its rows, terms in byte order, so that a file's statistics help a reader that looks for few terms."""
        lengths = np.array(self.lengths, np.int64)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "ids": self.ids, "counts": lengths.tobytes(), "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())}], schema=_ARROW)
        if not self.held:
            return
        names = sorted(self.numbers)
        rank = np.empty(len(names), np.int64)
        rank[[self.numbers[t] for t in names]] = np.arange(len(names))
        term, place, count = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        term = rank[term]
        order = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(names)))
        place, count, total = place[order], count[order], np.concatenate(([0], np.cumsum(count[order], dtype=np.int64)))
        for low in range(0, len(names), 4096):
            own = range(low, min(low + 4096, len(names)))
            at = [(int(ends[t - 1]) if t else 0, int(ends[t])) for t in own]
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array(np.full(len(own), shard)),
                    "term": names[low : low + 4096],
                    "ids": pa.nulls(len(own), pa.list_(pa.int64())),
                    "places": [place[a:b].tobytes() for a, b in at],
                    "counts": [count[a:b].tobytes() for a, b in at],
                    "n_docs": [b - a for a, b in at],
                    "n_terms": [int(total[b] - total[a]) for a, b in at],
                },
                schema=_ARROW,
            )


def write(docs: DataFrame, at: str, doc_id: str = "doc_id", text: str = "text", *, shard_docs: int = SHARD_DOCS, shard_chars: int = SHARD_CHARS) -> None:
    """Write the index of ``docs`` to the folder ``at``: one pass, no shuffle. ``shard_docs`` is at most 65,536."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Shard()
        for batch in small(batches):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now.ids and (len(now.ids) >= shard_docs or now.chars + len(body or "") > shard_chars):
                    yield from now.batches(number)
                    number, now = number + 1, _Shard()
                now.add(doc, body)
        if now.ids:
            yield from now.batches(number)

    docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, INDEX).write.parquet(at)


def read(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(at)


class Heap:
    """The best ``k`` (score, id) of one query; ``floor`` is the least score that may still enter."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        scores, ids, none = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.none, none)))
        order = np.lexsort((ids, none, -scores))[: self.k]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.scores[-1]))


def wand(places: list[np.ndarray], added: list[np.ndarray], most: np.ndarray, heap: Heap, ids: np.ndarray, none: np.ndarray, window: int = WINDOW) -> int:
    """Offer the shard's documents to ``heap``; ``places`` (sorted), ``added`` (impacts) and ``most`` (their maximum) are the terms of one
    query. Documents that equal the threshold are offered too, because a smaller id wins. Returns how many documents were scored."""
    end = len(ids)
    at = [0] * len(places)
    now = np.array([p[0] for p in places], np.int64)
    scored = 0
    while len(now):
        order = np.argsort(now, kind="stable")
        reach = np.cumsum(most[order])
        first = int(np.searchsorted(reach, heap.floor))
        if first == len(order):
            break  # all terms together do not reach the threshold
        pivot = int(now[order[first]])
        if pivot >= end:
            break
        if now[order[0]] < pivot:  # no document before the pivot can enter: jump
            for t in order[:first].tolist():
                if now[t] < pivot:
                    at[t] += int(np.searchsorted(places[t][at[t] :], pivot))
                    now[t] = places[t][at[t]] if at[t] < len(places[t]) else end
            continue
        stop = min(pivot + window, end)
        bound = np.zeros(stop - pivot, np.int64)
        slices = []
        for t in np.flatnonzero(now < stop).tolist():
            to = at[t] + int(np.searchsorted(places[t][at[t] :], stop))
            here = places[t][at[t] : to] - pivot
            bound[here] += most[t]
            slices.append((here, added[t][at[t] : to]))
            at[t] = to
            now[t] = places[t][to] if to < len(places[t]) else end
        may = bound >= heap.floor
        if may.any():
            score = np.zeros(stop - pivot, np.int64)
            for here, more in slices:
                own = may[here]
                score[here[own]] += more[own]
            scored += int(may.sum())
            got = np.flatnonzero(score >= heap.floor)
            if len(got):
                heap.offer(score[got], ids[pivot + got], none[pivot + got])
    return scored


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(the documents' row, the terms' rows) of one shard after the other; rows come sorted by (shard, term), null first."""
    now, head, rows = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != now:
                if head is not None and rows:
                    yield head, rows
                now, head, rows = row["shard"], None, []
            if row["term"] is None:
                head = row
            else:
                rows.append(row)
    if head is not None and rows:
        yield head, rows


def _slices(queries: DataFrame, slice_chars: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(id, distinct terms) of the queries, collected in slices of about ``slice_chars`` characters, which bounds what is broadcast."""
    sized = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    chars = int(sized.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0)
    slices = max(1, -(-chars * 5 // (slice_chars * 4)))
    for k in range(slices):
        mine = sized if slices == 1 else sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        held: dict[int, set[bytes]] = {}
        for item, text in mine.toLocalIterator():
            held.setdefault(item, set()).update(terms_of(text))
        yield sorted((i, sorted(t)) for i, t in held.items())


RESULT = "item_id long, doc_id long, score long"
_RESULT = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def search(index: DataFrame, queries: DataFrame, *, top: int = TOP, slice_chars: int = 12_000_000, window: int = WINDOW) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with score above 0 of each row (item_id, text) of ``queries``."""
    spark = index.sparkSession
    n, total = index.filter("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = None
    for asked in _slices(queries, slice_chars):
        known = spark.createDataFrame([(bytearray(t),) for t in sorted({t for _, own in asked for t in own})], "term binary")
        df = {bytes(t): d for t, d in index.join(F.broadcast(known), "term").groupBy("term").agg(F.sum("n_docs")).collect()}
        weights = {t: weight(n, d) for t, d in df.items()}
        sent = spark.sparkContext.broadcast(([(i, [t for t in own if weights.get(t)]) for i, own in asked], weights))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            items, weights = sent.value
            heaps = [Heap(top) for _ in items]
            for head, rows in _shards(batches):
                lengths, none = np.frombuffer(head["counts"], np.int64), np.array([i is None for i in head["ids"]])
                ids = np.array([i or 0 for i in head["ids"]], np.int64)
                held = {}
                for row in rows:
                    if weights[row["term"]]:
                        place = np.frombuffer(row["places"], np.uint16).astype(np.int32)
                        add = impacts(np.frombuffer(row["counts"], np.uint32).astype(np.int64), lengths[place], weights[row["term"]], n, total)
                        held[row["term"]] = place, add, int(add.max())
                for (_, own), heap in zip(items, heaps, strict=True):
                    mine = [held[t] for t in own if t in held]
                    if mine:
                        wand([m[0] for m in mine], [m[1] for m in mine], np.array([m[2] for m in mine], np.int64), heap, ids, none, window)
            for (item, _), heap in zip(items, heaps, strict=True):
                if len(heap.ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heap.ids), item)), pa.array(heap.ids, mask=heap.none), pa.array(heap.scores)], schema=_RESULT)

        mine = index.join(F.broadcast(known), "term", "left_semi").unionByName(index.filter("term is null"))
        found = mine.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first()).mapInArrow(run, RESULT)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
