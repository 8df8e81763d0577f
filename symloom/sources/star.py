"""A deterministic code graph over the star-schema tables, for checks and benchmarks. ``SQL`` is the same rules for another engine.

Every row of every table takes part. Parts are functions, and two lines of an order that follow one another are a call (of parts) and a spawn
(of suppliers). So that some functions have no callers and some few, one callee in eight is never called, and one in eight only by callers
that a rule over both ends picks. Events are sends; the pairs of user and type in them are handlers, but for every third actor. A crate depends
on the two crates that it calls most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.model import Graph


# The columns that are read. A declared schema saves reading footers while a plan is made.
SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "documents": "doc_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def functions(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws("::", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("qualified_name"),
        F.col("p_brand").alias("crate"),
        F.col("p_type").alias("module"),
        F.concat_ws("/", F.lit("/ws"), "p_brand", F.lit("src"), F.concat(F.lower("p_type"), F.lit(".rs"))).alias("file"),
        F.when(size % 5 == 0, "private").when(size % 5 == 1, "pub(crate)").otherwise("pub").alias("visibility"),
        (size % 4 == 0).alias("is_test"),
        F.col("p_partkey").alias("line_start"),
    )


def consecutive(lineitem: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Pairs of consecutive ``key`` values within each order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = lineitem.select(
        F.col("l_orderkey").alias("order_key"),
        F.row_number().over(w).alias("seq"),
        F.col(key).alias(before),
        F.lead(key).over(w).alias(after),
        F.col("l_linenumber").alias("line"),
    )
    return rows.filter(F.col(after).isNotNull())


def called(calls: DataFrame) -> DataFrame:
    """The calls whose callee's kind admits them: no callers, few callers, any."""
    kind = (7 * F.col("dst") + 3) % 8
    return calls.filter((kind > 1) | (kind == 1) & ((5 * F.col("src") + F.col("dst")) % 16 == 0))


def crates(part: DataFrame) -> DataFrame:
    num = F.substring("p_brand", 7, 10).cast("int")
    return part.select(F.col("p_brand").alias("name"), num.alias("num"), (num % 5).alias("layer")).distinct()


def depends_on(fns: DataFrame, calls: DataFrame) -> DataFrame:
    of = lambda a, b: fns.select(F.col("id").alias(a), F.col("crate").alias(b))
    pairs = calls.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    most = Window.partitionBy("a").orderBy(F.desc("n"), "b")  # one row for each pair of crates
    return pairs.withColumn("k", F.row_number().over(most)).filter("k <= 2").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def actors(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("crate"), (F.col("s_suppkey") % 3 == 0).alias("is_distributed"), (F.col("s_suppkey") % 5 == 0).alias("is_test")
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    part, lineitem, supplier, events = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier", "events"))
    n = supplier.agg(F.count("*")).scalar()  # a subquery of the plans that need it
    fns = functions(part)
    calls = called(consecutive(lineitem, "l_partkey", "src", "dst"))
    sends = events.select(
        "event_id", (F.col("user_id") % n).alias("sender"), ((F.col("event_id") * 7 + 3) % n).alias("receiver"), F.col("event_type").alias("message_type"), F.when(F.col("event_id") % 3 == 0, "Ask").otherwise("Tell").alias("method")
    )
    handles = events.select((F.col("user_id") % n).alias("actor"), F.col("event_type").alias("message_type")).filter("actor % 3 <> 1").distinct()
    spawns = consecutive(lineitem, "l_suppkey", "parent", "child")
    return Graph(fns, calls, crates(part), depends_on(fns, calls), actors(supplier, table(spark, sf_dir, "nation")), sends, handles, spawns)


SQL = """
WITH RECURSIVE functions AS (
  SELECT p_partkey AS id, p_name AS name, p_brand || '::' || p_type || '::' || CAST(p_partkey AS VARCHAR) AS qualified_name,
         p_brand AS crate, p_type AS module, '/ws/' || p_brand || '/src/' || lower(p_type) || '.rs' AS file,
         CASE p_size % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'pub(crate)' ELSE 'pub' END AS visibility,
         p_size % 4 = 0 AS is_test, p_partkey AS line_start
  FROM part),
calls AS (
  SELECT * FROM (
    SELECT l_orderkey AS order_key, row_number() OVER w AS seq, l_partkey AS src, lead(l_partkey) OVER w AS dst, l_linenumber AS line
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
  WHERE dst IS NOT NULL AND ((7 * dst + 3) % 8 > 1 OR (7 * dst + 3) % 8 = 1 AND (5 * src + dst) % 16 = 0)),
crates AS (SELECT DISTINCT p_brand AS name, CAST(substr(p_brand, 7) AS INT) AS num, CAST(substr(p_brand, 7) AS INT) % 5 AS layer FROM part),
depends_on AS (
  SELECT src, dst FROM (
    SELECT a.crate AS src, b.crate AS dst, row_number() OVER (PARTITION BY a.crate ORDER BY count(*) DESC, b.crate) AS k
    FROM calls c JOIN functions a ON a.id = c.src JOIN functions b ON b.id = c.dst WHERE a.crate <> b.crate GROUP BY a.crate, b.crate)
  WHERE k <= 2),
actors AS (
  SELECT s_suppkey AS id, s_name AS name, n_name AS crate, s_suppkey % 3 = 0 AS is_distributed, s_suppkey % 5 = 0 AS is_test
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
sends AS (
  SELECT event_id, user_id % (SELECT count(*) FROM supplier) AS sender, (event_id * 7 + 3) % (SELECT count(*) FROM supplier) AS receiver,
         event_type AS message_type, CASE WHEN event_id % 3 = 0 THEN 'Ask' ELSE 'Tell' END AS method
  FROM events),
handles AS (
  SELECT DISTINCT user_id % (SELECT count(*) FROM supplier) AS actor, event_type AS message_type FROM events WHERE user_id % (SELECT count(*) FROM supplier) % 3 <> 1),
spawns AS (
  SELECT * FROM (
    SELECT l_orderkey AS order_key, row_number() OVER w AS seq, l_suppkey AS parent, lead(l_suppkey) OVER w AS child, l_linenumber AS line
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
  WHERE child IS NOT NULL)
"""
