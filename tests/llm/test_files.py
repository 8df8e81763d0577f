"""The files of checkpoints."""

from __future__ import annotations

import pathlib
import weakref

import pytest

from symloom.llm import bpe, jaccard
from symloom.llm.common import cut, shared_dir, worker_words
from symloom.llm.components import components
from symloom.llm.queries import vocabulary


@pytest.fixture
def written(spark):
    """Numbers of the part files of each checkpoint that was made since, with 64 partitions after each shuffle."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    shared_dir(spark)
    at = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(at.glob("rdd-*"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda: [len(list(d.glob("part-*"))) for d in set(at.glob("rdd-*")) - before]
    for k, v in held.items():
        spark.conf.set(k, v)


def test_rounds_of_few_edges_write_few_files(spark, written):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {tuple(r) for r in components(edges, most=41).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}
    found = written()
    assert len(found) > 2 and max(found) <= 2 * spark.sparkContext.defaultParallelism


def test_join_writes_few_files(spark, written):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"{text} {k}") for k in range(30)] + [(50 + k, f"other{k} words") for k in range(5)], "doc_id long, text string")
    got = {r["doc_id"] for r in jaccard.keep_one(docs).collect()}
    assert got == {0, *range(50, 55)}
    assert sum(n > 2 * spark.sparkContext.defaultParallelism for n in written()) <= 1  # the verified pairs are dealt as they were


def test_join_verifies_in_all_partitions_and_writes_few_files(spark, written):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"{text} {k}") for k in range(40)], "doc_id long, text string")
    found = {(r["class_id"], r["n_texts"]) for r in jaccard.join(docs, block_texts=7).collect()}
    assert found == {(0, 39)}
    assert max(written()) <= 2 * spark.sparkContext.defaultParallelism


def test_a_worker_holds_one_kind_of_cache():
    words = worker_words()
    assert worker_words() is words
    tokenizer = weakref.ref(bpe.loaded(vocabulary()))
    assert bpe.loaded(vocabulary()) is tokenizer()
    assert worker_words() is not words and tokenizer() is None


def test_many_rows_keep_their_partitions(spark, written):
    rows = spark.range(64).repartition(64, "id")
    assert cut(rows, 10**9).rdd.getNumPartitions() == 64 and cut(rows).rdd.getNumPartitions() == 64
    assert sorted(r["id"] for r in cut(rows, 64).collect()) == list(range(64))
