"""Spelling variants by rolling-hash deletions.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` (only A to Z are lower-cased), spoiled where a checksum of document and word says so (see ``spoiled``),
of at least ``least_length`` code points and ``least_count`` occurrences in all documents. Two words are near if they differ by one code point put in, left out or
replaced.

Every word sends 64-bit keys: one for itself, one for each text that a left-out code point leaves, and one more for that text and the place. Keys come from prefix
and suffix sums of a polynomial, for a batch of words at once. They are radix-partitioned by their top bits and sorted; equal neighbours meet. Only keys that
two words share go on; they fetch their words, and equality is then by the texts, so that equal keys of unlike texts part. Words
with the same text and place differ by a replacement there, and a word with the text itself by a code point put in. Two words meet at exactly one of these, so
neighbours are counted and the best one is chosen within such groups, without pairs. A group has at most as many words as a word has places times the 90
characters.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that is ``ratio`` times its own or more. Counts grow by that ratio at
each step, so roots are found in a number of doublings that the largest count bounds. Null and empty texts have no words; a null doc_id counts as an empty
id; repeated rows count each. Only id and text are read; an empty table has no rows.
"""

from __future__ import annotations

import collections
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import discard, mixed, scratch, small

MODULUS, LENGTH, COUNT, RATIO = 199, 6, 5, 5
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ITSELF, SHORTER, AT_PLACE = 0, 1, 2
HELD = 400_000


def runs_of(text: str | None) -> list[bytes]:
    """The lower-cased runs, a byte for each code point (Latin-1)."""
    return text.encode("latin-1", "replace").translate(_TABLE).split() if text else []


def spoiled(run: bytes, prefix: int) -> bytes:
    """The run as it counts in a document: where ``MODULUS`` divides the checksum of ``<doc_id>:<run>``, one code point is deleted. ``prefix`` is the
    checksum of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % MODULUS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least_length: int = LENGTH) -> DataFrame:
    """(word, n) of all documents. Each task adds up its words, ``HELD`` at a time, before they are shuffled."""
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def sums(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in held], "n": list(held.values())}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = collections.defaultdict(int)
        for batch in small(batches):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for word, n in collections.Counter(runs_of(body)).items():
                    if len(word) >= least_length:
                        word = spoiled(word, prefix)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= HELD:
                    yield sums(held)
                    held.clear()
        if held:
            yield sums(held)

    sent = docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, "word string, n long")
    return sent.groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of the word, kind, place) of all words. Of equal neighbours only the first is left out: the others leave the same text.

    With c the codes of a word and b the base, the sum of c[j] b^j before a place plus the sum after it, divided by b, is the sum of the text that
    leaving out that place leaves; all sums are modulo 2^64."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = mixed(np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1))
    ends = np.cumsum(lengths)
    first = np.repeat(ends - lengths, lengths)
    word, place = np.repeat(np.arange(len(words)), lengths), np.arange(len(codes)) - first
    power = np.ones(int(lengths.max()) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, BASE), out=power[1:])
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * power[place], dtype=np.uint64)))
    at = np.arange(len(codes))
    before, after = total[at] - total[first], total[first + lengths[word]] - total[at + 1]
    size = mixed(lengths.astype(np.uint64))
    whole = mixed((total[ends] - total[ends - lengths]) ^ size)
    left = np.concatenate(([True], codes[1:] != codes[:-1])) | (place == 0)
    text = before + INVERSE * after
    shorter = mixed(text ^ mixed((lengths - 1).astype(np.uint64))[word])[left]
    placed = mixed(mixed(text + mixed(place.astype(np.uint64) + np.uint64(7))) ^ size[word])
    kinds = np.repeat(np.array([ITSELF, SHORTER, AT_PLACE], np.int32), [len(words), len(shorter), len(placed)])
    return (
        np.concatenate((whole, shorter, placed)).view(np.int64),
        np.concatenate((np.arange(len(words)), word[left], word)),
        kinds,
        np.concatenate((np.zeros(len(words), np.int64), place[left], place)).astype(np.int32),
    )


KEYS = "key long, id long, kind int, place int"
_KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("kind", pa.int32()), ("place", pa.int32())])


def keyed(words: DataFrame, bits: int = 64) -> DataFrame:
    """The keys of (id, word), of ``bits`` bits: with fewer, more unlike texts meet and are told apart later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, said = batch.column(0).to_numpy(), [w.encode("latin-1") for w in batch.column(1).to_pylist()]
            low = 0
            while low < len(said):  # about a million code points at once, one word at least
                high, n = low + 1, len(said[low])
                while high < len(said) and n + len(said[high]) <= 1 << 20:
                    n += len(said[high])
                    high += 1
                key, word, kind, place = deletion_keys(said[low:high])
                key = key >> (64 - bits)
                for k in range(0, len(key), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(ids[low:high][word[part]]), pa.array(kind[part]), pa.array(place[part])], schema=_KEYS)
                low = high

    return words.select("id", "word").mapInArrow(run, KEYS)


def shared(keys: DataFrame) -> DataFrame:
    """The rows of keys that occur twice. Keys are dealt by their top bits and sorted; runs of equal keys are found in each batch, and the last
    run of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = None
        for batch in batches:
            table = pa.Table.from_batches([batch.cast(_KEYS)] if wait is None else [*wait.to_batches(), batch.cast(_KEYS)]).combine_chunks()
            key = table.column("key").to_numpy()
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            wait, key = table.slice(last), key[:last]
            same = np.concatenate(([False], key[1:] == key[:-1], [False])) if len(key) else np.zeros(1, bool)
            yield from table.slice(0, last).filter(pa.array(same[:-1] | same[1:])).to_batches()
        if wait is not None and wait.num_rows > 1:
            yield from wait.to_batches()

    dealt = keys.withColumn("bin", F.shiftrightunsigned("key", 44)).repartition("bin").drop("bin")
    return dealt.sortWithinPartitions("key").mapInArrow(run, KEYS)


def neighbours(words: DataFrame, bits: int = 64) -> DataFrame:
    """id, n_near, best (struct of -n and word) of the words (id, word, n) that have a near word."""
    met = shared(keyed(words, bits)).drop("key").join(words, "id")
    text = F.when(F.col("kind") == ITSELF, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    slot = F.when(F.col("kind") == AT_PLACE, F.col("place")).otherwise(-1)
    rows = met.select("id", "kind", F.struct((-F.col("n")).alias("less"), "word").alias("own"), text.alias("text"), slot.alias("slot"))
    group = Window.partitionBy("text", "slot")
    ranked = group.orderBy("own")
    whole, longer = F.when(F.col("kind") == ITSELF, F.col("own")), F.when(F.col("kind") == SHORTER, F.col("own"))
    seen = rows.select(
        "id",
        "kind",
        F.count("*").over(group).alias("size"),
        F.first("own").over(ranked).alias("best"),
        F.lead("own").over(ranked).alias("next"),
        F.row_number().over(ranked).alias("at"),
        F.max(whole).over(group).alias("whole"),
        F.min(longer).over(group).alias("longer"),
    )
    kind, none = F.col("kind"), F.lit(0)
    n = F.when(kind == AT_PLACE, F.col("size") - 1).when(F.col("whole").isNull(), none).when(kind == ITSELF, F.col("size") - 1).otherwise(1)
    best = F.when(kind == AT_PLACE, F.when(F.col("at") == 1, F.col("next")).otherwise(F.col("best"))).when(kind == ITSELF, F.col("longer")).otherwise(F.col("whole"))
    told = seen.select("id", n.alias("n"), best.alias("best")).filter("n > 0")
    return told.groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def rooted(formed: DataFrame, most: int, ratio: int) -> DataFrame:
    """``formed`` (word, form) with ``root``: each doubling follows the roots found so far, written once."""
    spark, steps, before = formed.sparkSession, max(1, math.ceil(math.log(max(most, 2), ratio)) + 1), None
    now = formed.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        up = now.filter("root <> word").select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = now.join(up, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        at = scratch(spark, "roots")
        now.write.parquet(at)
        if before:
            discard(spark, before)
        now, before = spark.read.schema("word string, root string").parquet(at), at
    return formed.join(now, "word")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least_length: int = LENGTH, least_count: int = COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words."""
    spark, at, told = docs.sparkSession, scratch(docs.sparkSession, "words"), scratch(docs.sparkSession, "forms")
    counts(docs, doc_id, text, least_length=least_length).filter(F.col("n") >= least_count).withColumn("id", F.monotonically_increasing_id()).write.parquet(at)
    words = spark.read.schema("word string, n long, id long").parquet(at)
    near = words.join(neighbours(words), "id", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = near.select(
        "word",
        F.when(enough, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    formed.write.parquet(told)
    formed = spark.read.schema("word string, form string, n long, n_near long, form_n long").parquet(told)
    most = words.agg(F.max("n")).first()[0] or 1
    return rooted(formed, most, ratio).select("word", "form", "root", "n", "n_near", "form_n")
