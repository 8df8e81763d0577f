"""Strongly connected components by trimming, contraction of chains and forward-backward colouring (DataFrame joins only).

Each round drops the nodes that lack an edge in or out, and splices out an independent set of nodes with one edge in and one out (those whose hash is
least among such neighbours), so a chain of any length shrinks by a share each round and all rounds together shuffle in proportion to its
edges. What is left is coloured: every node takes the largest name that reaches it; from the node that has its own name, edges within the colour are
walked back, and what is met is one component. The rest goes round again. Spliced nodes are then put back, the last ones first: a node belongs to the
component of its two neighbours if that is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.sources.tables import shared_dir


#: A round of trimming and splicing is worth its joins where it can take this share of the nodes or more.
SHRINK = 0.5


def _cut(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def _thin(now: DataFrame) -> float:
    """The share of nodes that lack an edge in or out or have one of each."""
    ends = now.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(now.select("dst", F.lit(0), F.lit(1)))
    degree = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return degree.agg(F.avg(((F.col("o") == 0) | (F.col("i") == 0) | (F.col("o") + F.col("i") == 2)).cast("int"))).first()[0]


def _shrunk(now: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(edges, spliced: node, pred, succ) after one round of trimming and splicing."""
    outs = now.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.max("dst").alias("succ"))
    ins = now.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.max("src").alias("pred"))
    alive = outs.join(ins, "node").withColumn("h", F.xxhash64("node", F.lit(turn)))
    thin = alive.filter("n_in = 1 and n_out = 1").select("node", "pred", "succ", "h")
    of = lambda end: thin.select(F.col("node").alias(end), F.col("h").alias(f"{end}_h"))
    least = (F.col("h") < F.coalesce("pred_h", F.lit((1 << 63) - 1))) & (F.col("h") < F.coalesce("succ_h", F.lit((1 << 63) - 1)))
    spliced = thin.join(of("pred"), "pred", "left").join(of("succ"), "succ", "left").filter(least).select("node", "pred", "succ")  # made again from ``now``, which is cut, where it is read again
    kept = now
    for end in ("src", "dst"):
        kept = kept.join(alive.select(F.col("node").alias(end)), end, "left_semi").join(spliced.select(F.col("node").alias(end)), end, "left_anti")
    over = spliced.filter("pred <> succ").select(F.col("pred").alias("src"), F.col("succ").alias("dst"))
    return _cut(kept.select("src", "dst").unionByName(over).distinct()), spliced


def _coloured(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the nodes that one colouring finds, and the edges that are left."""
    colours = now.select(F.col("src").alias("node")).union(now.select("dst")).distinct().withColumn("c", F.col("node"))

    def hop(c: DataFrame) -> DataFrame:
        sent = now.join(c.select(F.col("node").alias("src"), F.col("c").alias("more")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("more").alias("more"))
        return c.join(sent, "node", "left").select("node", F.greatest("c", F.coalesce("more", "c")).alias("c"), "was")

    while True:
        step = _cut(hop(hop(hop(hop(colours.withColumn("was", F.col("c")))))))
        colours = step.select("node", "c")
        if step.filter("c <> was").isEmpty():
            break
    of = lambda end: colours.select(F.col("node").alias(end), F.col("c").alias(f"{end}_c"))
    within = _cut(now.join(of("src"), "src").join(of("dst"), "dst").filter("src_c = dst_c").select("src", "dst", F.col("src_c").alias("c")))
    back = lambda m: m.unionByName(within.join(m.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "c")).distinct()
    met, n, more = colours.filter("node = c"), -1, 0
    while more > n:
        n, met = more, _cut(back(back(back(back(met)))))
        more = met.count()
    rest = within
    for end in ("src", "dst"):
        rest = rest.join(met.select(F.col("node").alias(end)), end, "left_anti")
    return met.select("node", F.col("c").alias("component")), _cut(rest.select("src", "dst"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that a walk leads back to; a component is named after one of its nodes. Edges with a null end are left out."""
    shared_dir(edges.sparkSession)
    every = _cut(edges.select("src", "dst").dropna().distinct())
    now, turn = every.filter("src <> dst"), 0
    found, rings, spliced = [], [every.filter("src = dst").select(F.col("src").alias("node"))], []
    left = now.count()
    while left:
        while left and _thin(now) >= SHRINK:
            turn += 1
            now, out = _shrunk(now, turn)
            spliced.append(out)
            rings.append(out.filter("pred = succ").select(F.col("pred").alias("node")))
            left = now.count()
        if left:
            met, now = _coloured(now)
            found.append(met)
            left = now.count()
    loops = _cut(reduce(DataFrame.union, rings).distinct())
    gone = reduce(DataFrame.unionByName, [s.select("node") for s in spliced], loops.filter("false"))
    parts = reduce(DataFrame.unionByName, found, loops.select("node", F.col("node").alias("component")).filter("false"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    parts = parts.join(sizes.filter("n > 1"), "component", "left_semi").select("node", "component")
    own = loops.join(parts, "node", "left_anti").join(gone, "node", "left_anti").select("node", F.col("node").alias("component"))
    now = _cut(parts.unionByName(own))
    for out in reversed(spliced):
        of = lambda end: now.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))  # noqa: B023, E731
        ring = loops.select("node", F.lit(True).alias("ring"))
        back = out.join(of("pred"), "pred", "left").join(of("succ"), "succ", "left").join(ring, "node", "left")
        name = F.when(F.col("pred_c") == F.col("succ_c"), F.col("pred_c")).when(F.col("ring"), F.col("node"))
        now = now.unionByName(_cut(back.select("node", name.alias("component")).filter("component is not null")))
    return now
