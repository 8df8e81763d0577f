"""Tables in files by ranges of a key, with a manifest of each file's least and greatest key, so that a lookup opens only files that can hold it.

Within a file rows are sorted and pages are small, so that the reader's page index skips what a filter rules out; Bloom filters cover other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a page: what a lookup of one key decodes at least.
PAGE = 2_048


def write(df: DataFrame, path: str, *by: str, files: int = 64, blooms: tuple[str, ...] = ()) -> None:
    """``by``: the key, then columns that split a key with many rows over files."""
    out = df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").option("parquet.page.row.count.limit", PAGE)
    for c in blooms:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)
    spark, key = df.sparkSession, F.col(by[0])
    spans = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))
    spans.coalesce(1).write.mode("overwrite").parquet(f"{path}.files")


def read(spark: SparkSession, path: str, key: str, values: list | None = None, *, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The rows whose key is one of the values or begins with one of the prefixes (a few of either; they are literals of the plan). Only files whose span meets one are opened."""
    spans, whole = spark.read.parquet(f"{path}.files"), spark.read.parquet(path)
    meets, keep = F.lit(False), F.lit(False)
    for v in values or ():
        meets = meets | F.lit(v).between(F.col("lo"), F.col("hi"))
    if values:
        keep = F.col(key).isin(*values)
    for p in prefixes:
        meets = meets | (F.col("hi") >= p) & ((F.col("lo") <= p) | F.col("lo").startswith(p))
        keep = keep | F.col(key).startswith(p)
    names = [r["file"] for r in spans.filter(meets).select("file").collect()]  # at most as many as the table has files
    if not names:
        return whole.limit(0)
    return spark.read.schema(whole.schema).parquet(*[f"{path}/{n}" for n in names]).filter(keep)
