"""Incremental refresh keyed by content hash.

The state is a table (path, hash, mtime) of one version below ``<root>/state``. Symbols lie below ``<root>/symbols/v<n>/bucket=<b>``, by a hash bucket of the
file's path; a version's manifest names for each bucket the version that wrote it last. A refresh compares a listing with the state (one full outer join
on the path), and writes only the buckets that changed or removed files lie in: their old rows without those files, and the rows of changed and new
ones. The state, the manifest and at last a small pointer row are written beside the old ones, so a refresh that fails leaves the old version whole. A
pointer row holds the name of the batch it came from, so a batch that runs again, even after a restart, writes nothing.

A store with ``links`` also keeps the call edges and crate dependencies of its symbols (see ``links``), in the same versions.

The streaming form feeds new and modified files to the same refresh by ``foreachBatch``; file sources do not emit removals, so a
removal shows in the next listing, or in ``feed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.resolve import first_of
from symloom.sources.rust import scan, tables
from symloom.sources.tables import discard, scratch
from symloom.streaming.feed import PASSED, once, stateful
from symloom.streaming.feed import changes as tree_changes
from symloom.streaming.links import Links

STATE = "path string, hash string, mtime timestamp"
#: The files of a bucket are read in so many tasks.
SPLIT = 4
#: Buckets of more files in the mean are dealt anew when they are written.
FILES = 16


def content_hash(sources: DataFrame) -> DataFrame:
    """(path, crate, text, hash): SHA-256 of the text; null text is empty."""
    return sources.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def changes(state: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, change): Created, Modified, Deleted; files with an equal hash are left out. Both sides hold a path once."""
    s, n = state.select("path", F.col("hash").alias("old")), listing.select("path", F.col("hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "Created").when(F.col("new").isNull(), "Deleted").when(F.col("old") != F.col("new"), "Modified")
    return s.join(n, "path", "full_outer").select("path", kind.alias("change")).filter("change is not null")


def outdated(state: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths whose symbols no longer match: changed or not known yet."""
    return changes(state, listing).filter("change <> 'Deleted'").select("path")


def replace_files(symbols: DataFrame, changed: DataFrame, new: DataFrame, file: str = "file") -> DataFrame:
    """Symbols without those of changed files, and with the new ones."""
    kept = symbols.join(changed.select(F.col("path").alias(file)), file, "left_anti")
    return kept.select(symbols.columns).unionByName(new.select(symbols.columns))


def affected_crates(changed: DataFrame, symbols: DataFrame, file: str = "file") -> DataFrame:
    return symbols.join(changed.select(F.col("path").alias(file)), file, "left_semi").select("crate").distinct()


def affected_calls(raw_calls: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Calls to resolve anew: their last name part is a name that the changed files defined before or define now."""
    names = before.select("name").union(after.select("name")).distinct()
    last = F.element_at(F.split("callee_name", "::"), -1)
    return raw_calls.withColumn("name", last).join(names, "name", "left_semi").select(raw_calls.columns)


def statistics(symbols: DataFrame, state: DataFrame) -> DataFrame:
    """One row: files, symbols, crates, last change."""
    per = symbols.agg(F.count("*").alias("symbols"), F.countDistinct("crate").alias("crates"))
    return state.agg(F.count("*").alias("files"), F.max("mtime").alias("last_analyzed")).crossJoin(per)


def file_report(before: DataFrame, after: DataFrame, file: str = "file") -> DataFrame:
    """Functions of each file before and after."""
    b, a = (df.groupBy(F.col(file).alias("path")).agg(F.count("*").alias(n)) for df, n in ((before, "before"), (after, "after")))
    return b.join(a, "path", "full_outer").select("path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")])


def crate_of_file(files: DataFrame, crates: DataFrame) -> DataFrame:
    """(path, crate): the crate with the longest folder that the path lies in.

    Each path's ancestor folders are exploded, so the prefix match is an equi-join.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = files.filter(F.size(parts) > 1).select("path", F.posexplode(folders).alias("depth", "folder"))
    hit = up.join(crates.select(F.col("path").alias("folder"), F.col("name").alias("crate")), "folder")
    best = hit.groupBy("path").agg(F.max_by("crate", "depth").alias("crate"))
    return files.select("path").join(best, "path", "left")


class Store:
    """State and scanned symbols below a folder that all executors share. ``buckets`` is fixed when a store is first written."""

    SYMBOLS = "path string, table string, row string"
    MANIFEST = "bucket int, version long"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, links: bool = False, scope: str = "workspace"):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.links = Links(spark, f"{self.root}/links", buckets, scope) if links else None

    def _load(self, path: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def version(self, batch: str | None = None) -> int:
        """The newest version, or that of a batch; 0 where there is none."""
        rows = self._load(f"{self.root}/current", "version long, batch string")
        if rows is None:
            return 0
        return (rows if batch is None else rows.filter(F.col("batch") == batch)).agg(F.max("version")).first()[0] or 0

    def state(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(STATE).parquet(f"{self.root}/state/v{v}") if v else self.spark.createDataFrame([], STATE)

    def manifest(self) -> dict[int, int]:
        """bucket -> the version that wrote it; one entry for each bucket."""
        v = self.version()
        rows = self._load(f"{self.root}/manifest/v{v}", self.MANIFEST) if v else None
        return {r["bucket"]: r["version"] for r in rows.collect()} if rows is not None else {}

    def symbols(self, only: list[int] | None = None) -> DataFrame:
        held = {b: v for b, v in self.manifest().items() if only is None or b in only}
        if not held:
            return self.spark.createDataFrame([], self.SYMBOLS)
        return self.spark.read.schema(self.SYMBOLS).parquet(*[f"{self.root}/symbols/v{v}/bucket={b}" for b, v in sorted(held.items())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _scanned(self, files: DataFrame) -> DataFrame:
        """The symbols of files. Texts are dealt by bucket before they are read, since their rows are many times as long and would be shuffled whole."""
        dealt = files.select("path", "crate", "text").repartition(self._bucket(), F.pmod(F.xxhash64(F.lit(SPLIT), "path"), F.lit(SPLIT)))
        return scan(dealt).select(F.coalesce(F.get_json_object("row", "$.file"), F.lit("")).alias("path"), "table", "row")

    def refresh(self, listing: DataFrame, *, whole: bool = True, removed: DataFrame | None = None, batch: str | None = None) -> int:
        """Bring the store up to a listing (path, crate, text, mtime); ``whole``: files that are not listed are gone; ``removed`` (path): these are gone
        where they are not listed; ``batch`` names a listing that is taken once. Returns the version."""
        now = self.version()
        if batch is not None and (done := self.version(batch)):
            return done
        new = now + 1
        listed = first_of(content_hash(listing), ["path"], [F.desc("mtime"), F.col("hash")])
        state = self.state()
        diff = changes(state, listed)
        if not whole:
            kept = diff.filter("change <> 'Deleted'")
            diff = kept if removed is None else kept.unionByName(diff.filter("change = 'Deleted'").join(removed.select("path").distinct(), "path", "left_semi"))
        touched = sorted(r["b"] for r in diff.select(self._bucket().alias("b")).distinct().collect())  # at most one for each bucket
        fresh = listed.join(diff.filter("change <> 'Deleted'"), "path", "left_semi")
        old = self.symbols(touched)
        if len(old.inputFiles()) > FILES * len(touched):  # few and small on the whole; else a bucket that many batches touch would be read from ever more files
            old = old.repartition(self._bucket())
        kept = old.join(diff, "path", "left_anti").unionByName(self._scanned(fresh))
        at = f"{self.root}/symbols/v{new}"
        kept.withColumn("bucket", self._bucket()).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(at)
        written = self._load(at, f"{self.SYMBOLS}, bucket int") if touched else None
        held = {r["bucket"] for r in written.select("bucket").distinct().collect()} if written is not None else set()
        manifest = {b: v for b, v in self.manifest().items() if b not in touched} | dict.fromkeys(held, new)
        self.spark.createDataFrame(sorted(manifest.items()), self.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v{new}")
        if self.links is not None:
            before = self.symbols(touched).join(diff, "path", "left_semi")  # of the version that is still current
            after = written.drop("bucket").join(diff, "path", "left_semi") if written is not None else before.filter("false")
            self.links.apply(now, new, diff.select("path"), tables(before), tables(after))
        state.join(diff, "path", "left_anti").unionByName(fresh.select("path", "hash", "mtime")).write.mode("overwrite").parquet(f"{self.root}/state/v{new}")
        self.spark.createDataFrame([(new, batch)], "version long, batch string").coalesce(1).write.mode("append").parquet(f"{self.root}/current")
        return new

    def watch(self, folder: str, checkpoint: str, on_batch: Callable[[int], None] | None = None):  # noqa: ANN201
        """A stream over new ``.rs`` files below a folder; each micro-batch is one refresh, named by checkpoint and batch so a repeat writes nothing new."""
        raw = (
            self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(folder)
        )
        rows = raw.select("path", F.regexp_extract("path", r"([^/]+)/src/", 1).alias("crate"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("mtime"))

        def each(batch: DataFrame, batch_id: int) -> None:
            v = self.refresh(batch, whole=False, batch=f"{checkpoint}#{batch_id}")
            if on_batch:
                on_batch(v)

        return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def feed(self, folder: str, checkpoint: str, on_batch: Callable[[int], None] | None = None, suffix: str = ".rs"):  # noqa: ANN201
        """A stream of the changes below a folder, removals too: each micro-batch is one refresh that lists only what changed. A file that is rewritten
        with the same content is dropped by the stream's state. Paths are as the feed lists them, so a store is kept by this or by ``watch``, not by both."""
        rows = once(tree_changes(stateful(self.spark), folder, f"{checkpoint}/snapshots", suffix))

        def each(batch: DataFrame, batch_id: int) -> None:
            at = scratch(self.spark, "feed")
            batch.write.parquet(at)  # a refresh reads it several times, the state is to be asked once
            got = self.spark.read.schema(PASSED).parquet(at)
            v = self.refresh(got.filter("change <> 'Deleted'").select("path", "crate", "text", "mtime"), whole=False, removed=got.filter("change = 'Deleted'"), batch=f"{checkpoint}#{batch_id}")
            discard(self.spark, at)
            if on_batch:
                on_batch(v)

        return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
