"""Shared pieces: table access, lineage cuts, Arrow batches and word hashes.

Texts are cut into words by ``\\w+`` over the lower-cased text everywhere a stage works on words. A shingle is the
64-bit hash of five consecutive words; a text of one to four words has one shingle, its whole word sequence; a null or
empty text has none.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
T = TypeVar("T")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master (tests) takes one under /tmp; any
    other is refused, because its executors could not read what another wrote."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = at or "/tmp/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


#: A file of a checkpoint holds so many rows where their number is known.
ROWS_A_FILE = 250_000


def files_of(spark: SparkSession, rows: int) -> int:
    """The files of a checkpoint of so many rows."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with an eager reliable checkpoint in the shared folder.

    Where there are ``rows`` rows or about so many, they go to two files for each core, or more as the rows grow, however many partitions a shuffle has:
    on a local disk Hadoop starts processes for each file's permissions, and one that has just been forked counts as large as its executor.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if rows is not None:
        df = df.coalesce(files_of(spark, rows))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch`` named and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread_join(left: DataFrame, groups: DataFrame, on: str, by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """Join rows to a table of one row for each ``on``, where one key may hold a large share of ``left``.

    ``left`` is dealt by the key and a salt from the hash of ``by``, and each group's row is repeated for every salt. Both sides then have an
    exchange of their own, so that AQE can split what is still large.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = groups.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return salted.join(repeated, [on, "_salt"], how).drop("_salt")


def small(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes of texts, one row at least, so that very long texts do not
    fill a worker. This is settled where a plan runs; settings of the session stay as they are."""
    for batch in batches:
        if batch.num_rows <= rows and batch.nbytes <= size:
            yield batch
            continue
        weight = np.ones(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(weight), 0
        while at < batch.num_rows:
            begun = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, begun + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def free(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one batch into columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            yield pa.RecordBatch.from_pydict(fn(batch), schema=arrow)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """word -> 64-bit hash, kept for at most ``most`` words."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_held: dict[str, object] = {}


def held(kind: str, make: Callable[[], T]) -> T:
    """What this Python worker keeps between its batches and tasks, of one kind at a time: Spark gives a worker to the next stage, and what an earlier one
    knew (a tokenizer's pieces, say) would stay beside what the next one needs."""
    if kind not in _held:
        if _held:
            _held.clear()
            gc.collect()
        _held[kind] = make()
    return _held[kind]


def worker_words() -> WordHashes:
    """The words this Python worker knows, over all its batches."""
    return held("words", WordHashes)


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Shingle hashes in text order, repeats kept."""
    if not len(words):
        return words
    k = min(size, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * _MIX + words[i : len(words) - k + 1 + i]
    return mixed(out)
