"""The change feed and its state: what reaches a store, and what a restart repeats."""

from __future__ import annotations

import json

from symloom.sources import rust
from symloom.streaming import feed
from symloom.streaming.incremental import Store


def test_changes_reach_a_store_without_a_listing(spark, tmp_path):
    """Created, renamed, removed and rewritten files; each run starts from the checkpoint, as after a restart."""
    src = tmp_path / "tree" / "kit" / "src"
    src.mkdir(parents=True)
    s = Store(spark, str(tmp_path / "store"), buckets=4)
    batches = []

    def run():
        batches.clear()
        s.feed(str(tmp_path / "tree"), str(tmp_path / "checkpoint"), batches.append).awaitTermination(300)
        return {r["name"] for r in rust.tables(s.symbols())["functions"].collect()}, {p.rpartition("/")[2] for p in (r["path"] for r in s.state().collect())}

    (src / "a.rs").write_text("fn a() {}\n")
    (src / "b.rs").write_text("fn b() {}\n")
    assert run() == ({"a", "b"}, {"a.rs", "b.rs"}) and len(batches) == 1
    assert run() == ({"a", "b"}, {"a.rs", "b.rs"}) and not batches  # nothing is repeated
    (src / "b.rs").rename(src / "c.rs")
    (src / "a.rs").unlink()
    (src / "d.rs").write_text("fn d() {}\n")
    version = s.version()
    assert run() == ({"b", "d"}, {"c.rs", "d.rs"}) and s.version() == version + 1
    assert {r["path"] for r in spark.read.parquet(f"{s.root}/state/v{version}").collect()} == {f"{src}/a.rs", f"{src}/b.rs"}


def test_a_content_passes_once(spark, tmp_path):
    """The same file in several batches passes once, another content passes, a removal passes once, and the content after it again."""
    own = feed.stateful(spark)
    told = [("f.rs", "Created", "x", k) for k in range(4)] + [("f.rs", "Modified", "y", 4), ("f.rs", "Modified", "y", 5), ("f.rs", "Deleted", None, 6), ("f.rs", "Deleted", None, 7), ("f.rs", "Created", "y", 8), ("g.rs", "Deleted", None, 9)]
    rows = spark.createDataFrame([(p, "k", c, t, n) for p, c, t, n in told], "path string, crate string, change string, text string, n long")
    for k in range(5):
        rows.filter(f"n div 2 = {k}").selectExpr("path", "crate", "change", "text", "timestamp_seconds(n) mtime").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = own.readStream.schema(feed.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feed.once(stream).writeStream.foreachBatch(lambda b, _: got.extend((r["path"], r["change"], r["text"]) for r in b.orderBy("mtime").collect())).option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start().awaitTermination(300)
    assert got == [("f.rs", "Created", "x"), ("f.rs", "Modified", "y"), ("f.rs", "Deleted", None), ("f.rs", "Created", "y")]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_planned_batch_is_planned_again_from_its_snapshots(tmp_path):
    """Partitions come from the snapshots of the offsets, by folder; what a commit leaves behind is the newest snapshot."""
    for k in range(3):
        (tmp_path / f"d{k}").mkdir()
    for k in range(600):
        (tmp_path / f"d{k % 2}" / f"{k}.rs").write_text("")
    r = feed.TreeReader({"root": str(tmp_path), "snapshots": str(tmp_path / "s")})
    first = r.latestOffset()
    (tmp_path / "d0" / "0.rs").unlink()
    (tmp_path / "d2" / "new.rs").write_text("x")
    again = feed.TreeReader({"root": str(tmp_path), "snapshots": str(tmp_path / "s")})
    parts = again.partitions(again.initialOffset(), first)
    assert sorted(len(p.files) for p in parts) == [44, 44, 256, 256] and all(len({f.rpartition("/")[0] for f, _ in p.files}) == 1 for p in parts)
    then = again.latestOffset()
    assert sorted((f.rpartition("/")[2], c) for p in again.partitions(first, then) for f, c in p.files) == [("0.rs", "Deleted"), ("new.rs", "Created")]
    assert len([x for p in again.partitions(again.initialOffset(), first) for x in again.read(p)]) == 599  # one is gone
    again.commit(then)
    assert again._numbers() == [then["snapshot"]] and again.latestOffset() == then


def test_partitions_follow_files_not_folders(tmp_path):
    """Many folders of one file each: a partition takes several of them."""
    (tmp_path / "snapshots").mkdir()
    new = {f"/t/bin={k}/a.rs": [1, 1] for k in range(10_000)}
    (tmp_path / "snapshots" / "1.json").write_text(json.dumps({"/t/gone.rs": [1, 1]}))
    (tmp_path / "snapshots" / "2.json").write_text(json.dumps(new))
    reader = feed.TreeReader({"root": "/t", "snapshots": str(tmp_path / "snapshots")})
    got = reader.partitions({"snapshot": 1}, {"snapshot": 2})
    assert len(got) == 40 and max(len(p.files) for p in got) <= feed.FILES
    assert sorted(f for p in got for f in p.files) == sorted([("/t/gone.rs", "Deleted"), *((p, "Created") for p in new)])
    assert [len(p.files) for p in reader.partitions({"snapshot": 0}, {"snapshot": 1})] == [1]
