"""The code graph: typed tables, their keys and enumerated values.

A graph is a set of DataFrames. Every operator takes the tables it needs and typed parameters, and returns a DataFrame; nothing
is read or computed before an action. The canonical id of a function or type is ``crate:qualified_name:line_start``;
operators only need ids to be unique, so the star projection keeps the part key.
"""

from __future__ import annotations

from dataclasses import MISSING, dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import names
from symloom.sources import clustered
from symloom.sources.tables import discard

# Enumerated domains.
ACTOR_TYPES = ("Local", "Distributed", "Unknown")
TYPE_KINDS = ("Struct", "Enum", "Trait", "TypeAlias", "Union")
IMPORT_TYPES = ("Simple", "Grouped", "Glob", "Module")
CALL_TYPES = ("Direct", "Method", "Associated", "Macro")
MESSAGE_KINDS = ("Tell", "Ask", "Message", "Query")
SPAWN_PATTERNS = ("DirectType", "TraitMethod", "ModuleFunction")
SEVERITIES = ("Error", "Warning", "Info")

#: table -> DDL. Operators may carry more columns; these are the ones they rely on.
SCHEMAS = {
    "functions": "id string, name string, qualified_name string, crate string, module string, file string, line_start long, line_end long, visibility string, is_async boolean, is_unsafe boolean, is_generic boolean, is_test boolean, is_trait_impl boolean, is_method boolean, is_synthetic boolean, context string, doc string, signature string, parameters array<struct<name:string,type:string>>, return_type string",
    "types": "id string, name string, qualified_name string, crate string, module string, file string, line_start long, line_end long, kind string, visibility string, is_generic boolean, is_test boolean, doc string, fields array<string>, variants array<string>, methods array<string>",
    "modules": "name string, path string, crate string, file string, is_public boolean, parent string",
    "imports": "crate string, file string, line long, module_path string, import_type string, items array<struct<name:string,alias:string>>",
    "impls": "crate string, file string, line long, type_name string, trait_name string, methods array<string>, is_generic boolean",
    "raw_calls": "caller string, callee_name string, call_type string, crate string, module string, file string, line long, is_synthetic boolean, macro_context string, confidence double",
    "calls": "src string, dst string, line long, is_synthetic boolean",
    "macros": "id string, crate string, file string, line long, line_end long, name string, kind string, arguments string, containing string",
    "actors": "id string, name string, crate string, file string, line long, actor_type string, is_distributed boolean, is_test boolean",
    "spawns": "parent string, child string, crate string, file string, line long, method string, pattern string, context string",
    "message_types": "name string, kind string, crate string, file string, line long",
    "handles": "actor string, message_type string, reply_type string, crate string, file string, line long, is_async boolean",
    "sends": "sender string, receiver string, message_type string, method string, crate string, file string, line long",
    "errors": "file string, crate string, message string",
    "crates": "name string, version string, path string, layer int, is_workspace_member boolean, is_external boolean",
    "depends_on": "src string, dst string, kind string",
}


@dataclass(frozen=True)
class Graph:
    """The tables that the graph operators read, then those that a source tree also gives. ``id``, ``src`` and ``dst`` share one type."""

    functions: DataFrame
    calls: DataFrame
    crates: DataFrame
    depends_on: DataFrame
    actors: DataFrame
    sends: DataFrame
    handles: DataFrame
    spawns: DataFrame
    types: DataFrame | None = None
    impls: DataFrame | None = None
    modules: DataFrame | None = None
    imports: DataFrame | None = None
    macros: DataFrame | None = None
    message_types: DataFrame | None = None
    embeddings: DataFrame | None = None

    def write(self, path: str, files: int | None = None) -> None:
        """Every table there is as Parquet below ``path``; each write commits as a whole. With ``files``, functions and calls lie in so many files by ranges of ``id`` and ``dst``
        with a manifest (``clustered.read``), and an index of the names beside them (``names.find``)."""
        spark = self.functions.sparkSession
        keys = {"functions": (("id",), ("name", "qualified_name")), "calls": (("dst", "src"), ("src",))}
        for f in fields(self):
            if (table := getattr(self, f.name)) is None:
                continue
            if files is not None and f.name in keys:
                by, blooms = keys[f.name]
                clustered.write(table, f"{path}/{f.name}", *by, files=files, blooms=blooms)
            else:
                table.write.mode("overwrite").parquet(f"{path}/{f.name}")
                if f.name in keys:
                    discard(spark, f"{path}/{f.name}.files")
        if files is not None:
            names.write_index(spark.read.parquet(f"{path}/functions"), f"{path}/names", files=files)
        else:
            discard(spark, f"{path}/names.files")
            discard(spark, f"{path}/names")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Graph:
        def load(name: str, needed: bool) -> DataFrame | None:
            try:
                return spark.read.parquet(f"{path}/{name}")
            except AnalysisException as e:
                if needed or "PATH_NOT_FOUND" not in str(e):
                    raise
                return None

        return Graph(**{f.name: load(f.name, f.default is MISSING) for f in fields(Graph)})


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def canonical_id(crate: str = "crate", qualified_name: str = "qualified_name", line: str = "line_start"):  # noqa: ANN201
    return F.concat_ws(":", F.col(crate), F.col(qualified_name), F.col(line).cast("string"))
