"""Incremental blob ledger secret scan (DataFrame functions only).

Every version of a path is content-addressed (SHA-256 of its text). The ledger is a table of (blob, rule_version) pairs
that have been scanned, with their findings. A run takes the blobs of the versions at hand, leaves out those that the
ledger holds for the current rule version, scans each remaining blob once, and joins the findings back to every path.

Spans are in code points, end exclusive. For each rule the matches are leftmost and do not overlap; those that are too
short are dropped afterwards. Null text is empty text; an empty text has one (empty) blob without findings. Repeated rows
of a path each come back. Columns other than the path and the text are never read, so their names cannot clash.

A stored ledger is a Parquet folder with a folder for each run. A run that is tried again overwrites its own folder, and reading takes each
(blob, rule version) once, so neither a retried run nor two runs at a time repeat a finding.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import cut, free


@dataclass(frozen=True)
class Rule:
    """``group``'s length is held against ``least``; ``screen`` is a pattern that every kept match implies; what group ``lead`` holds stands
    before the span. A pattern's work is in proportion to the text, whatever that repeats."""

    kind: str
    pattern: str
    group: int
    least: int
    screen: str
    lead: int = 0


# The base kinds in their order, then formats of issued credentials. A run of the characters of access or hex is matched from its first
# place or not at all, so asking for the least length at once drops the same matches. In a run, only the first "eyJ" can begin a jwt.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
)
EXTRA = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, r"xox[abprs]-[A-Za-z0-9-]{15}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])((?>[A-Za-z0-9_-]*?(?=eyJ)))(eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)", 2, 40, r"[A-Za-z0-9_-]\.eyJ", 1),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA
LEDGER = "blob string, rule_version string, spans array<struct<start:int,stop:int,kind:int>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


#: So many matches are folded at once, because a fold copies the array that it grows; the parts' offsets are folded apart.
PART = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, where the value is computed once, however often it is used, and also inside of lambdas."""
    return F.transform(F.array(value), then)[0]


def parts_of(items: Column, before: Callable[[Column, Column], Column]) -> Column:
    """array<struct<at, own>>: ``items`` in parts of ``PART``, with what ``before(at, item)`` makes of all items of earlier parts, from 0. ``items`` is a
    column or a lambda's variable, and not empty."""
    starts = F.sequence(F.lit(1), F.size(items), F.lit(PART))

    def zipped(parts: Column) -> Column:
        ends = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda a, part: F.struct(F.aggregate(part, a["at"], before).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
            lambda a: a["all"],
        )
        return F.arrays_zip(ends.alias("at"), parts.alias("own"))

    return let(F.transform(starts, lambda c: F.slice(items, c, PART)), zipped)


def spans_of(text: Column, rule: Rule, at: int) -> Column:
    """array<struct<start, stop, kind>> of one rule. Between two matches lies one piece of ``split``, so starts are sums of lengths."""
    all_of = lambda g: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)), F.length)
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,kind:int>>)")
    after = lambda a, x: a + x["gap"] + x["whole"]
    names = ["whole", *(["held"] if rule.group else []), *(["lead"] if rule.lead else [])]
    groups = [0, *([rule.group] if rule.group else []), *([rule.lead] if rule.lead else [])]
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    rows = F.arrays_zip(gaps.alias("gap"), *[all_of(g).alias(n) for g, n in zip(groups, names, strict=True)])

    def step(part: Column) -> Column:
        return F.aggregate(
            part["own"],
            F.struct(part["at"].alias("at"), empty.alias("found")),
            lambda a, x: F.struct(
                after(a["at"], x).alias("at"),
                F.when(
                    x["held" if rule.group else "whole"] >= rule.least,
                    F.concat(a["found"], F.array(F.struct((a["at"] + x["gap"] + (x["lead"] if rule.lead else 0)).alias("start"), after(a["at"], x).alias("stop"), F.lit(at).alias("kind")))),
                )
                .otherwise(a["found"])
                .alias("found"),
            ),
            lambda a: a["found"],
        )

    # the piece after the last match has no match beside it
    found = let(rows, lambda all_: let(F.slice(all_, 1, F.size(all_) - 1), lambda own: F.when(F.size(own) > 0, F.flatten(F.transform(parts_of(own, after), step)))))
    return F.coalesce(F.when(text.rlike(rule.screen), found), empty)


def scan_text(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules' spans by start, then by the rules' order."""
    return F.array_sort(F.concat(*[spans_of(text, r, i) for i, r in enumerate(rules)]))


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_versions(versions: DataFrame, path: str, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """(findings: path, blob, spans; additions to the ledger). One shuffle of the unseen blobs' texts, one light join back.

    Copies of a blob are merged before they are shuffled (partial aggregation), so a blob that a third of all rows hold
    arrives once from each task. The additions are written once (``keep``: a checkpoint in the shared folder) and read from there. The join back sends (path, blob) and spans only; its hot blobs are split by AQE.
    """
    version = rule_version(rules)
    body = F.coalesce(F.col(text), F.lit(""))
    held = versions.select(F.col(path), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("body"))
    unseen = held.groupBy("blob").agg(F.any_value("body").alias("body"))
    known = None
    if ledger is not None:  # the pair may have been appended more than once
        known = ledger.filter(F.col("rule_version") == version).groupBy("blob", "rule_version").agg(F.any_value("spans").alias("spans"))
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    added = keep(unseen.select("blob", F.lit(version).alias("rule_version"), scan_text(F.col("body"), rules).alias("spans")))
    now = added if known is None else known.unionByName(added)
    found = now.filter(F.size("spans") > 0).select("blob", "spans")
    none = F.expr("cast(array() as array<struct<start:int,stop:int,kind:int>>)")
    return held.select(path, "blob").join(found, "blob", "left").select(path, "blob", F.coalesce("spans", none).alias("spans")), added


def stored(spark: SparkSession, at: str, but: str = "") -> DataFrame:
    """The ledger at ``at`` without the run ``but``, each (blob, rule version) once; empty where nothing has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(f"{LEDGER}, run string").parquet(at).filter(F.col("run") != but)
    return rows.groupBy("blob", "rule_version").agg(F.any_value("spans").alias("spans"))


def scan_into(versions: DataFrame, path: str, text: str, at: str, run: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of ``versions`` through the stored ledger at ``at``; ``run`` names this run's additions there, and a run that is tried again
    overwrites its own."""
    if not re.fullmatch(r"[A-Za-z][\w-]*", run):
        raise ValueError(f"not a name for a run: {run!r}")
    spark, own = versions.sparkSession, f"{at}/run={run}"

    def keep(added: DataFrame) -> DataFrame:
        added.write.mode("overwrite").parquet(own)
        return spark.read.schema(LEDGER).parquet(own)

    return scan_versions(versions, path, text, stored(spark, at, run), rules, keep)[0]


def digest(findings: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the base kinds, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return findings.select(
        path,
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(as_text(base, rules).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans"), rules).alias("spans"),
        "blob",
    )


def redacted(text: Column, spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``text`` with every stretch that spans cover replaced by ``[secret]``; overlapping spans give one mark. A part of the spans cuts its own
    stretch of the text into pieces, because finding a place in a string takes as long as the string is up to there."""
    last = lambda a, s: F.greatest(a, s["stop"])

    def pieces(part: Column) -> Column:
        begin = part["at"]

        def cut_from(own: Column) -> Column:
            piece = lambda a, s: F.concat(F.substr(own, a["at"] - begin + 1, s["start"] - a["at"]), F.lit("[secret]"))
            return F.aggregate(
                part["own"],
                F.struct(begin.alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
                lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["stop"].alias("at"), F.concat(a["out"], F.array(piece(a, s))).alias("out"))).otherwise(F.struct(last(a["at"], s).alias("at"), a["out"].alias("out"))),
                lambda a: a["out"],
            )

        return let(F.substr(text, begin + 1, F.aggregate(part["own"], begin, last) - begin), cut_from)

    def whole(own: Column) -> Column:
        done = F.array_join(F.flatten(F.transform(parts_of(own, last), pieces)), "")
        return F.concat(done, F.substr(text, F.aggregate(own, F.lit(0), last) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, whole))


def redact(docs: DataFrame, path: str = "doc_id", text: str = "text", n_chars: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``docs`` with their secrets replaced, found through the ledger scan; ``n_chars`` follows the new text. Clean rows stay as they are."""
    _, ledger = scan_versions(docs, path, text, None, rules)
    blob, spans, body = (free(docs.columns, x) for x in ("_blob", "_spans", "_body"))
    found = ledger.filter(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    hashed = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    clean = F.col(spans).isNull()
    rows = hashed.join(found, blob, "left").withColumn(body, F.when(clean, F.col(text)).otherwise(redacted(F.col(text), F.col(spans), rules)))
    count = F.when(clean, F.col(n_chars)).otherwise(F.length(body).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else None
    return rows.select(*[F.col(body).alias(c) if c == text else count.alias(c) if c == n_chars else F.col(c) for c in docs.columns])
