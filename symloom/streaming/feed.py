"""A feed of file changes: created, modified and removed files of a tree as a stream, and a filter that lets a content through once.

``TreeSource`` is a streaming data source over the files below a folder. An offset is the number of a listing (a snapshot), which lies as one file in a folder of
its own beside the checkpoint; a batch is the difference of two snapshots, dealt to partitions by folder, small folders together. Files are read where a partition runs. A
snapshot goes when a later one is committed, so a batch that was planned before a restart is planned again from the same snapshots and one that was
committed never comes back. A file that is changed between a listing and its reading comes as it is read, and once more from the next snapshot.

``Once`` keeps the hash of each path in the state store of the stream: a rewritten file of an equal hash goes no further, and a removal goes on if the
path was known.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import groupby

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import StructType

CHANGES = "path string, crate string, change string, text string, mtime timestamp"
#: A folder's changes are cut to partitions of so many files; folders of few share one, but where there are few changes, they go to so many partitions.
FILES, LEAST = 256, 32


class Changed(InputPartition):
    """Files of one folder, or of several small ones: (path, change)."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        for name in ("root", "snapshots"):
            if not options.get(name):
                raise ValueError(f"the option {name} is needed")
        self.root_uri, self.snapshots, self.suffix = options["root"], options["snapshots"], options.get("suffix", ".rs")

    def _open(self, uri: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")

    def _listed(self) -> dict[str, list[int]]:
        """path -> modification time (ns) and size."""
        files, root = self._open(self.root_uri)
        infos = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        kept = [i for i in infos if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not re.search(r"/[._]", i.path[len(root) :])]
        return {i.path: [i.mtime_ns or 0, i.size] for i in kept}

    def _numbers(self) -> list[int]:
        files, at = self._open(self.snapshots)
        return sorted(int(i.base_name.split(".")[0]) for i in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if re.fullmatch(r"\d+\.json", i.base_name))

    def _snapshot(self, n: int) -> dict[str, list[int]]:
        if not n:
            return {}
        files, at = self._open(self.snapshots)
        with files.open_input_stream(f"{at}/{n}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        last = max(self._numbers(), default=0)
        now = self._listed()
        if now == self._snapshot(last):
            return {"snapshot": last}
        files, at = self._open(self.snapshots)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{last + 1}.part") as f:
            f.write(json.dumps(now).encode())
        files.move(f"{at}/{last + 1}.part", f"{at}/{last + 1}.json")  # whole or not there
        return {"snapshot": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Changed]:
        if start == end:
            return []
        old, new = self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"])
        kind = {p: "Created" if p not in old else "Modified" for p in new if old.get(p) != new[p]} | {p: "Deleted" for p in old if p not in new}
        room = min(FILES, -(-len(kind) // LEAST))
        out: list[Changed] = []
        for _, group in groupby(sorted(kind.items(), key=lambda x: (x[0].rpartition("/")[0], x[0])), key=lambda x: x[0].rpartition("/")[0]):
            own = list(group)
            if out and len(out[-1].files) + len(own) <= room:
                out[-1].files.extend(own)
            else:
                out += [Changed(own[k : k + FILES]) for k in range(0, len(own), FILES)]
        return out

    def read(self, partition: Changed) -> Iterator[tuple]:
        files, _ = self._open(self.root_uri)
        for path, change in partition.files:
            crate = re.search(r"([^/]+)/(?:src|tests|examples|benches)/", path)
            text, at = None, datetime.now(UTC)
            if change != "Deleted":
                info = files.get_file_info(path)
                if info.type != fs.FileType.File:
                    continue  # gone since it was listed: the next snapshot tells
                at = info.mtime or at
                with files.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
            yield path, crate[1] if crate else "", change, text, at

    def commit(self, end: dict) -> None:
        """Snapshots before a committed one are read no more."""
        files, at = self._open(self.snapshots)
        for n in self._numbers():
            if n < end["snapshot"]:
                files.delete_file(f"{at}/{n}.json")


class TreeSource(DataSource):
    """Options: ``root`` (a folder, as a path or URI), ``snapshots`` (a folder that outlives the query, beside its checkpoint), ``suffix`` of the files."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


def changes(spark: SparkSession, root: str, snapshots: str, suffix: str = ".rs") -> DataFrame:
    """The stream of changes below ``root``."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("source_tree").option("root", root).option("snapshots", snapshots).option("suffix", suffix).load()


PASSED = "path string, crate string, change string, text string, mtime timestamp, hash string"


class Once(StatefulProcessor):
    """Rows of one path, in the order of their times: those whose hash is another than the last that passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()[0] if self.last.exists() else None
        before, out = held, []
        for row in pd.concat(list(rows)).sort_values(["mtime", "hash"], kind="stable", na_position="first").itertuples(index=False):
            new = None if row.change == "Deleted" else row.hash
            if new != held:
                out.append((row.path, row.crate, "Deleted" if new is None else "Created" if held is None else "Modified", None if new is None else row.text, row.mtime, new))
            held = new
        if held is None and before is not None:
            self.last.clear()
        elif held != before:
            self.last.update((held,))
        if out:
            yield pd.DataFrame(out, columns=["path", "crate", "change", "text", "mtime", "hash"])

    def close(self) -> None:
        pass


def once(feed: DataFrame) -> DataFrame:
    """``feed`` (path, crate, change, text, mtime) with ``hash``, without files whose content has passed already. The state store must be one that can
    hold typed state (RocksDB); see ``stateful``."""
    hashed = feed.select("path", "crate", "change", "text", "mtime", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    return hashed.groupBy("path").transformWithStateInPandas(statefulProcessor=Once(), outputStructType=PASSED, outputMode="Update", timeMode="None")


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep their state in RocksDB; the settings of ``spark`` stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own

