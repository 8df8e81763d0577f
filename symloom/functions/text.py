"""Column functions over names, paths, diffs and signatures; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def segment(path: Column, n: int, sep: str = "::") -> Column:
    """The n-th part of a path, from 1, or from the end when negative; null beyond it."""
    return F.try_element_at(F.split(path, sep), F.lit(n))


def snake(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?<!^)([A-Z])", "_$1"))


def pascal(x: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(x, "_"), lambda w: w != ""), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))), "")


def type_of_variable(x: Column) -> Column:
    """The type that a variable's name suggests: its words, capitalised. A suffix such as actor, supervisor, worker or handler stays."""
    return pascal(x)


def dashes(x: Column) -> Column:
    return F.replace(x, F.lit("-"), F.lit("_"))


def module_of_file(file: Column, crate: Column) -> Column:
    """Module path of a source file: below ``/src/``; lib, main and mod.rs stand for their folder."""
    inner = F.regexp_replace(F.element_at(F.split(file, "/src/"), -1), r"\.rs$", "")
    inner = F.regexp_replace(inner, r"(^|/)(lib|main|mod)$", "")
    return F.concat_ws("::", dashes(crate), F.nullif(dashes(F.replace(inner, F.lit("/"), F.lit("::"))), F.lit("")))


#: Folders and file names of tests.
TEST_FILE = r"(^|/)(tests|examples|benches)/|_tests?\.rs$|(^|/)tests?\.rs$"


def is_test_file(file: Column) -> Column:
    return file.rlike(TEST_FILE)


METHOD_OF_PATTERN = r"^[^(]*::\s*([A-Za-z_][A-Za-z0-9_]*)[^(]*\("


def method_of_pattern(x: Column) -> Column:
    """The name after the last ``::`` before the first ``(`` of a call pattern."""
    return F.nullif(F.regexp_extract(x, METHOD_OF_PATTERN, 1), F.lit(""))


def crate_of_path(file: Column) -> Column:
    return F.nullif(F.regexp_extract(file, r"([^/]+)/src/", 1), F.lit(""))


def visibility(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*(pub(?:\s*\([^)]*\))?)(?=\s)", 1), F.lit("")), F.lit("private"))


def visibility_kind(v: Column) -> Column:
    return F.when(v == "pub", "Public").when(v == "pub(crate)", "Crate").when(v.startswith("pub("), "SuperScope").otherwise("Private")


# Macro names by kind; any other macro is declarative.
MACRO_KINDS = {
    "paste": ("paste",),
    "builtin": (
        "println", "eprintln", "print", "eprint", "format", "write", "writeln",
        "vec", "assert", "assert_eq", "assert_ne", "debug_assert",
        "panic", "unreachable", "unimplemented", "todo",
        "matches", "cfg", "thread_local",
    ),
    "logging": ("info", "warn", "error", "debug", "trace"),
    "decimal": ("dec",),
    "async": ("select",),
    "custom": ("distributed_actor", "define_indicator_enums", "generate_builder"),
}
OTHER_MACRO = "declarative"


def macro_kind(name: Column) -> Column:
    return F.coalesce(*[F.when(name.isin(*names), kind) for kind, names in MACRO_KINDS.items()], F.lit(OTHER_MACRO))


def message_kind(name: Column) -> Column:
    return F.when(name.endswith("Tell"), "Tell").when(name.endswith("Ask"), "Ask").when(name.endswith("Query"), "Query").when(name.endswith("Message"), "Message")


# What is no actor's type, and how actors' types end or what they hold.
NON_ACTOR_FRAMEWORKS = ("tokio", "std", "async_std", "futures", "runtime", "task", "thread", "executor", "spawn_blocking", "smol", "async_global_executor", "blocking", "rayon")
ACTOR_TRAITS = ("Actor", "Message", "Handler")
ACTOR_ENDS = ("Actor", "Supervisor", "Worker", "Handler", "Agent", "Service")
ACTOR_PARTS = ("Actor", "Supervisor", "Manager")
LIKELY_ACTOR = rf"^(?=\p{{Lu}})(?:.*(?:{'|'.join(ACTOR_ENDS)})$|.*(?:{'|'.join(ACTOR_PARTS)}))"


def likely_actor(name: Column) -> Column:
    return ~name.isin(*NON_ACTOR_FRAMEWORKS, *ACTOR_TRAITS) & name.rlike(LIKELY_ACTOR)


# The kind of a spawn by the function around it; the first that fits.
SPAWN_CONTEXTS = (
    ("on_start", "^on_start$"),
    ("on_stop", "^on_stop$"),
    ("message_handler", "^reply$"),
    ("message_handler", "^handle_"),
    ("lifecycle_handler", "^on_"),
    ("spawn_function", "spawn"),
    ("main_function", "^main$"),
    ("run_function", "^run$"),
)


def spawn_context(function: Column) -> Column:
    """``kind:name``; outside of functions ``module_level``."""
    kind = F.coalesce(*[F.when(function.rlike(p), k) for k, p in SPAWN_CONTEXTS], F.lit("regular_function"))
    return F.when(function.isNull(), "module_level").otherwise(F.concat_ws(":", kind, function))


def health_score(violations: Column) -> Column:
    return F.when(violations == 0, F.lit(100.0)).otherwise(100.0 / (1 + violations / F.lit(10.0)))


def health_status(score: Column) -> Column:
    return F.when(score >= 90, "healthy").when(score >= 70, "warning").otherwise("critical")


def impact_level(usages: Column) -> Column:
    return F.when(usages == 0, "LOW").when(usages < 5, "MEDIUM").otherwise("HIGH")


def signature_complexity(parameters: Column, generic: Column, is_async: Column, unsafe: Column, returns: Column) -> Column:
    return parameters + 2 * generic.cast("int") + is_async.cast("int") + unsafe.cast("int") + returns.cast("int")


def type_complexity(fields: Column, variants: Column, methods: Column, generic: Column) -> Column:
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    return n(fields) + n(variants) + n(methods) + 2 * generic.cast("int")


# The parts of a function's embedded text where a configuration names none, and all parts of a type's.
FUNCTION_FIELDS = ("function_name", "module_path", "crate_name", "doc_comments", "parameter_types", "return_type")
TYPE_FIELDS = ("module_path", "doc_comments", "fields", "variants")


def _labelled(label: str, c: Column) -> Column:
    """``label: text``; null where the text is unknown or empty, so that the part is skipped."""
    return F.concat(F.lit(f"{label}: "), F.nullif(c, F.lit("")))


def embedding_text(crate: Column, name: Column, module: Column, doc: Column | None = None, types: Column | None = None, returns: Column | None = None, fields: Iterable[str] = FUNCTION_FIELDS) -> Column:
    """The text that is embedded for a function: its crate, then the configured parts in the configured order. ``types`` are the parameters' types, a list.
    Unknown and empty parts are skipped, and names of fields that functions do not have."""
    parts = {
        "function_name": ("function", name),
        "module_path": ("module", module),
        "doc_comments": ("docs", doc),
        "parameter_types": ("params", None if types is None else F.array_join(types, ", ")),
        "return_type": ("returns", returns),
    }
    return F.concat_ws(" | ", F.concat(F.lit("crate: "), crate), *[_labelled(*parts[f]) for f in fields if f in parts and parts[f][1] is not None])


def type_text(crate: Column, name: Column, kind: Column, module: Column, doc: Column, members: Column, variants: Column, fields: Iterable[str] = TYPE_FIELDS) -> Column:
    """The text that is embedded for a type: its crate, name and kind, then the configured parts in the configured order; unknown and empty parts are skipped."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.trim(F.split(x, ":")[0])), ", ")
    parts = {"module_path": ("module", module), "doc_comments": ("docs", doc), "fields": ("fields", listed(members)), "variants": ("variants", listed(variants))}
    return F.concat_ws(" | ", *[_labelled(*p) for p in (("crate", crate), ("type", name), ("kind", kind))], *[_labelled(*parts[f]) for f in fields if f in parts])


def _lines(spark: SparkSession, diff: str) -> DataFrame:
    return spark.createDataFrame([(diff,)], "diff string").select(F.explode(F.split("diff", "\n")).alias("line"))


def diff_files(spark: SparkSession, diff: str) -> DataFrame:
    """path: files that a unified diff changes."""
    lines = _lines(spark, diff)
    path = F.when(F.col("line").startswith("diff --git "), F.regexp_replace(F.split("line", " ")[2], "^a/", "")).when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 1 << 20))
    return lines.select(path.alias("path")).filter("path is not null").distinct()


def diff_functions(spark: SparkSession, diff: str) -> DataFrame:
    """name: functions that stand on added or removed lines."""
    changed = _lines(spark, diff).filter(F.col("line").rlike(r"^[+-](?!\+\+|--)"))
    return changed.select(F.regexp_extract("line", r"fn ([\p{L}\p{N}_]+)[(< ]", 1).alias("name")).filter("name <> ''").distinct()
