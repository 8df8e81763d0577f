"""Approximate nearest neighbours by learned partitions.

Fit (on a bounded sample): a k-nearest-neighbour graph of the sample is cut into 2^d parts of equal size by recursive
bisection (median of a smoothed vector on the graph) and refined by balanced swaps; a small classifier (one hidden layer) learns each vector's part, with the
parts of its neighbours as soft labels. A query is routed to its most probable parts until their probabilities sum to a share, so a query near
the middle of a part goes to few; the share is the least for which queries held out of the classifier's fit reach the target recall against brute force
within the sample.

Index: every row. Equal vectors are one entry that keeps the least ``k + 1`` ids (merged in each task before they are shuffled), so
a vector that a third of all rows hold is one entry. An entry goes to its most probable part; large parts are dealt into chunks. Search: each
distinct query vector goes to the chunks of its most probable parts, is reranked there by exact cosine, and the best are merged.

Vectors are compared with those of their own length, in double precision on the components as they are stored. The ``routers`` most common
lengths have partitions of their own; any other length is one part, searched whole. Vectors that are null, empty, zero, or hold null or
non-finite components take no part. Ties go to the smaller id; repeated rows are candidates each; with fewer candidates than ``k`` all found are returned. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import cut, spread_join


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows or vanishes; cosines do not change by a bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def matrix(vecs) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(b"".join(map(bytes, vecs)), np.float64).reshape(len(vecs), -1)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) nearest others by cosine, in blocks."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        out[at : at + 512] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, depth: int, *, seed: int = 5, rounds: int = 3) -> np.ndarray:
    """Part (0 to 2^depth - 1) of each node; sizes differ by one at most."""
    n = len(graph)
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    for _ in range(depth):
        new = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            inside = part[graph[own]] == p
            v = np.zeros(n)
            v[own] = rng.standard_normal(len(own))
            for _ in range(40):  # towards the second eigenvector of the lazy walk
                mean = np.where(inside, v[graph[own]], v[own][:, None]).mean(1)
                w = 0.5 * v[own] + 0.5 * mean
                w -= w.mean()
                v[own] = w / (np.linalg.norm(w) + 1e-12)
            order = np.argsort(v[own], kind="stable")
            new[own[order[len(own) // 2 :]]] += 1
        part = new
    parts = 1 << depth
    for _ in range(rounds):  # swap nodes between two parts where both gain
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        waiting: dict[tuple[int, int], list[int]] = {}
        for i in movers.tolist():
            a, b = int(part[i]), int(want[i])
            if waiting.get((b, a)):
                j = waiting[b, a].pop(0)
                part[i], part[j] = b, a
            else:
                waiting.setdefault((a, b), []).append(i)
    return part


@dataclass
class Router:
    """``share``: of the probability that a query's parts hold together."""

    w1: np.ndarray
    w2: np.ndarray
    share: float
    dim: int

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x.astype(np.float32) @ self.w1[:-1] + self.w1[-1], 0)
        return h @ self.w2[:-1] + self.w2[-1]

    def ahead(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts by falling probability, probability of those before each)."""
        z = self.logits(x).astype(np.float64)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, 1, kind="stable")
        sorted_p = np.take_along_axis(p, order, 1)
        return order, np.cumsum(sorted_p, 1) - sorted_p

    def route(self, x: np.ndarray) -> list[np.ndarray]:
        order, before = self.ahead(x)
        return [o[b <= self.share] for o, b in zip(order, before, strict=True)]


def classifier(x: np.ndarray, target: np.ndarray, *, hidden: int = 128, epochs: int = 25, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    w1 = (rng.standard_normal((x.shape[1] + 1, hidden)) / np.sqrt(x.shape[1]) * 2).astype(np.float32)
    w2 = (rng.standard_normal((hidden + 1, target.shape[1])) * 0.05).astype(np.float32)
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (w1, w2)]
    t = 0
    for e in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            k = order[at : at + 128]
            xk = np.hstack([x[k], np.ones((len(k), 1), np.float32)])
            a = xk @ w1
            h = np.hstack([np.maximum(a, 0), np.ones((len(k), 1), np.float32)])
            z = h @ w2
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[k]) / np.float32(len(k))
            grads = (xk.T @ ((g @ w2[:-1].T) * (a > 0)), h.T @ g)
            t += 1
            rate = 3e-3 if e < epochs * 0.7 else 6e-4
            for w, grad, s in zip((w1, w2), grads, state, strict=True):
                s[0] = np.float32(0.9) * s[0] + np.float32(0.1) * grad
                s[1] = np.float32(0.999) * s[1] + np.float32(0.001) * grad * grad
                w -= np.float32(rate) * (s[0] / np.float32(1 - 0.9**t)) / (np.sqrt(s[1] / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w1, w2


def fit(sample: np.ndarray, n: int, *, k: int = 5, recall: float = 0.96, part_rows: int = 512, most_depth: int = 8, near: int = 10) -> Router:
    """``n``: the number of entries that will be indexed."""
    x = unit(np.asarray(sample, np.float64)).astype(np.float32) if len(sample) else np.zeros((0, 1), np.float32)
    dim = x.shape[1]
    depth = 0
    while depth < most_depth and n / (1 << depth) > part_rows and len(x) / (2 << depth) >= 24:
        depth += 1
    parts = 1 << depth
    if depth == 0:
        return Router(np.zeros((dim + 1, 1), np.float32), np.zeros((2, 1), np.float32), 1.0, dim)
    graph = neighbour_graph(x, min(near, len(x) - 1))
    part = balanced_parts(graph, depth)
    target = np.eye(parts, dtype=np.float32)[part] * 0.5 + np.eye(parts, dtype=np.float32)[part[graph]].mean(1) * 0.5
    held = np.arange(len(x)) % 8 == 0
    w1, w2 = classifier(x[~held], target[~held])
    router = Router(w1, w2, 1.0, dim)
    home = router.logits(x).argmax(1)
    order, before = router.ahead(x[held])
    truth = graph_best(x, np.flatnonzero(held), k)
    place = np.argsort(order, 1)  # how soon a query probes each part
    needed = np.sort(np.take_along_axis(before, np.take_along_axis(place, home[truth], 1), 1).ravel())
    router.share = float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
    return router


def graph_best(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(rows), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(rows), 512):
        s = x[rows[at : at + 512]] @ x.T
        s[np.arange(len(s)), rows[at : at + 512]] = -2
        out[at : at + 512] = np.argpartition(-s, out.shape[1] - 1, 1)[:, : out.shape[1]]
    return out


def usable(v: list | None) -> bytes | None:
    """The components as doubles, without negative zeros; None where the vector takes no part."""
    if not v or None in v:
        return None
    a = np.asarray(v, np.float64)
    return (a + 0.0).tobytes() if np.isfinite(a).all() and a.any() else None


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """(vec: bytes of doubles, ids: the least ``keep`` ids, n): one row for each distinct usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is not None and (vec := usable(v)) is not None:
                    held.setdefault(vec, []).append(i)
            yield pa.RecordBatch.from_pydict({"vec": list(held), "ids": [sorted(x)[:keep] for x in held.values()], "n": [len(x) for x in held.values()]}, schema=arrow)

    arrow = pa.schema([("vec", pa.binary()), ("ids", pa.list_(pa.int64())), ("n", pa.int64())])
    part = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec binary, ids array<long>, n long")
    # each task sends at most ``keep`` ids of a vector for each batch; a vector that many hold is first merged by salt
    least = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, keep)
    salt = F.pmod(F.element_at("ids", 1), F.lit(64))
    few = part.groupBy("vec", salt.alias("salt")).agg(least("ids").alias("ids"), F.sum("n").alias("n"))
    return few.groupBy("vec").agg(least("ids").alias("ids"), F.sum("n").alias("n"))


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, recall: float = 0.96, sample: int = 8192, chunk: int = 8000, ask: int = 20_000, routers: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries`` are rows (vec_id, embedding) of ``vectors``; a row is not its own candidate.

    ``sample`` bounds the vectors that the partitions and the classifier of a length are fitted on; about ``chunk`` entries meet about ``ask`` queries
    in a task, whatever the sizes of the tables and parts.
    """
    spark = vectors.sparkSession
    keep = k + 1
    base = cut(entries(vectors, keep))
    sizes = base.groupBy(F.length("vec").alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bytes").limit(routers).collect()
    part_of_one = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) / float(1 << 30)
    fitted: dict[int, tuple[int, Router]] = {}  # length in bytes -> (first part, router)
    first = 0
    for width, n in sizes:
        some = base.filter((F.length("vec") == width) & (part_of_one < min(1.0, 1.3 * sample / n))).select("vec", part_of_one.alias("u")).orderBy("u", "vec").limit(sample).toPandas()
        router = fit(matrix(some["vec"]), n, k=k, recall=recall)
        fitted[width] = first, router
        first += router.parts
    sent = spark.sparkContext.broadcast(fitted)  # a few matrices, whatever the table's size

    def routed_to(vec: pd.Series, most: bool) -> list[np.ndarray]:
        """Parts of each vector; a length without a router is the part of its negative number of bytes."""
        out: list[np.ndarray] = [np.array([-len(v)], np.int32) for v in vec]
        wide = np.array([len(v) for v in vec])
        for width, (at, router) in sent.value.items():
            rows = np.flatnonzero(wide == width)
            if len(rows):
                x = unit(matrix(vec.iloc[rows]))
                got = router.logits(x).argmax(1)[:, None] if most else router.route(x)
                for r, p in zip(rows.tolist(), got, strict=True):
                    out[r] = (p + at).astype(np.int32)
        return out

    def home(vec: pd.Series) -> pd.Series:
        return pd.Series([int(p[0]) for p in routed_to(vec, True)], dtype="int32")

    def route(vec: pd.Series) -> pd.Series:
        return pd.Series(routed_to(vec, False))

    placed = cut(base.withColumn("part", F.pandas_udf(home, "int")("vec")).select("part", "vec", "ids"))
    # one row for each part, and for each length that has no router
    chunks = placed.groupBy("part").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    asked = cut(entries(queries, 1).select("vec"))
    turns = max(1, -(-asked.count() // ask))
    dealt = placed.join(chunks, "part").select(
        "part", F.pmod(F.xxhash64("vec", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "vec", "ids"
    )
    turn = F.pmod(F.xxhash64("vec", F.lit(2)), F.lit(turns)).cast("int").alias("turn")
    routed = asked.withColumn("part", F.explode(F.pandas_udf(route, "array<int>")("vec"))).join(chunks, "part").select("vec", "part", turn, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"vec": [], "vec_id": [], "score": []}).astype({"vec": object, "vec_id": "int64", "score": "float64"})
        x = scaled(matrix(left["vec"]))
        order = np.argsort(np.array([i[0] for i in left["ids"]]), kind="stable")
        x, ids = x[order], [left["ids"].iloc[i] for i in order]
        norm = np.sqrt((x * x).sum(1))
        out = []
        for at in range(0, len(right), 256):
            vecs = right["vec"].iloc[at : at + 256]
            q = scaled(matrix(vecs))
            rough = (q @ x.T) / norm / np.sqrt((q * q).sum(1))[:, None]
            near = np.argpartition(-rough, min(4 * keep, len(x)) - 1, 1)[:, : 4 * keep] if len(x) > 4 * keep else np.tile(np.arange(len(x)), (len(q), 1))
            for r, (vec, cand) in enumerate(zip(vecs, near, strict=True)):
                if len(x) > 4 * keep:  # ties at the edge
                    cand = np.flatnonzero(rough[r] >= rough[r][cand].min() - 1e-12)
                score = (x[cand] * q[r]).sum(1) / (norm[cand] * np.sqrt((q[r] * q[r]).sum()))
                best = np.lexsort((cand, -score))[:keep]
                rows = sorted((-score[b], int(i)) for b in best for i in ids[cand[b]])[:keep]
                out += [(vec, i, -s) for s, i in rows]
        return pd.DataFrame(out, columns=["vec", "vec_id", "score"])

    found = dealt.groupBy("part", "chunk", "turn").cogroup(routed.groupBy("part", "chunk", "turn")).applyInPandas(rerank, "vec binary, vec_id long, score double")
    top = Window.partitionBy("vec").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= keep).groupBy("vec").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("best"))
    named = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("query_id is not null")

    def raw(vecs: pd.Series) -> pd.Series:
        return pd.Series([usable(None if v is None else [None if y != y else y for y in v]) for v in vecs])

    keyed = named.select("query_id", F.pandas_udf(raw, "binary")("embedding").alias("vec")).filter("vec is not null")
    own = F.filter("best", lambda b: b["vec_id"] != F.col("query_id"))
    # many queries may hold one vector
    rows = spread_join(keyed, best, "vec", "query_id").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "b"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b")["vec_id"].alias("vec_id"), F.col("b")["score"].alias("score"))
