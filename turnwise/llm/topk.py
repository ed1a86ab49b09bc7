"""Exact top-k inner product search with a KD-tree per shard.

Vectors are dealt into shards by a hash of their id. Each shard builds a tree:
median splits along the widest side, a tight bounding box at every node. A query
walks the nodes best first by the greatest inner product that a box allows, and
stops when that falls below its kth score. The first round searches one shard
per query and yields a kth score; the second searches all other shards with it,
so most of their boxes are never opened. Queries come in blocks, (block, shard)
is the unit of work, and of each only the k best per query are shuffled on.

Scores are inner products of ``floor(1024 * x)``, exact in integers: in doubles
where every sum stays below 2^53, else in whole numbers of any size; a score
beyond 64 bits is given as the nearest that they hold. Ties go to the smaller id.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part; vectors of different lengths do not meet; a query meets
every row but those of its own id; each different vector of a query's id is a
query of its own; repeated rows are candidates as often as they stand; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize

SCALE = 1024
K = 10
LEAF = 64
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
_EXACT = 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query long, query_id long, vec_id long, score long"


@dataclass
class Tree:
    """Nodes in one array each; a leaf's rows are order[begin:end]."""

    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    order: np.ndarray


def build(x: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.arange(len(x))
    lo, hi, left, begin, end = [], [], [], [], []

    def node(a: int, b: int) -> int:
        part = x[order[a:b]]
        lo.append(part.min(0))
        hi.append(part.max(0))
        left.append(-1)
        begin.append(a)
        end.append(b)
        return len(lo) - 1

    todo = [node(0, len(x))]
    while todo:
        at = todo.pop()
        a, b = begin[at], end[at]
        side = hi[at] - lo[at]
        axis = int(side.argmax())
        if b - a <= leaf or not side[axis]:  # equal vectors stay together, however many
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(x[order[a:b], axis], middle)]
        left[at] = node(a, a + middle)
        node(a + middle, b)
        todo += [left[at], left[at] + 1]
    return Tree(np.array(lo), np.array(hi), np.array(left), np.array(begin), np.array(end), order)


def best_first(tree: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, kth: float, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best rows whose score is at least ``kth``."""
    scores, names = np.zeros(0, x.dtype), np.zeros(0, np.int64)
    heap = [(-bound[0], 0)]
    while heap:
        most, at = heapq.heappop(heap)
        if -most < kth:
            break
        if tree.left[at] >= 0:
            for child in (tree.left[at], tree.left[at] + 1):
                if bound[child] >= kth:
                    heapq.heappush(heap, (-bound[child], child))
            continue
        rows = tree.order[tree.begin[at] : tree.end[at]]
        got = x[rows] @ q
        fine = (got >= kth) & (ids[rows] != own)
        scores, names = np.concatenate([scores, got[fine]]), np.concatenate([names, ids[rows][fine]])
        if len(scores) > k:
            top = np.lexsort((names, -scores))[:k]
            scores, names = scores[top], names[top]
        if len(scores) == k:
            kth = max(kth, float(scores.min()))
    return scores, names


def scaled(rows: pd.Series) -> np.ndarray:
    """floor(1024 * x) of each vector's components, as doubles where these are exact, else as whole numbers."""
    x = np.stack(rows.to_list()).astype(np.float64)
    if float(np.abs(x).max()) * SCALE < _EXACT:
        return np.floor(x * SCALE)
    # a double of 2^53 or more is a whole number
    return np.array([[int(c) * SCALE if abs(c) >= _EXACT else math.floor(c * SCALE) for c in v] for v in x.tolist()], object)


def search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """One block of queries (query, query_id, v, kth) against one shard (vec_id, v)."""
    if queries.empty or rows.empty:
        return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
    x, q = scaled(rows["v"]), scaled(queries["v"])
    if x.dtype == object or q.dtype == object or float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= _EXACT:
        x, q = (np.array([[int(c) for c in v] for v in y.tolist()], object) for y in (x, q))
    ids, tree = rows["vec_id"].to_numpy(np.int64), build(x)
    bounds = np.maximum(q, 0) @ tree.hi.T + np.minimum(q, 0) @ tree.lo.T
    out = []
    for i, (query, own, kth) in enumerate(zip(queries["query"], queries["query_id"], queries["kth"].tolist(), strict=True)):
        scores, names = best_first(tree, x, ids, q[i], own, -np.inf if kth == LEAST else kth, bounds[i], k)
        held = [min(max(int(s), LEAST), MOST) for s in scores]
        out.append(pd.DataFrame({"query": query, "query_id": own, "vec_id": names, "score": pd.Series(held, dtype="int64")}))
    return pd.concat(out).astype("int64")


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), dim of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    named = vectors.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long"), v.alias("v"))
    return named.where(fine).withColumn("dim", F.size("v"))


def best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = 100, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose id is divisible by ``every`` against all rows."""
    rows = materialize(whole(vectors), "vectors")
    n = rows.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (every * block)))
    deal = F.xxhash64("vec_id")
    rows = rows.withColumn("shard", F.pmod(deal, F.lit(shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("query", F.xxhash64("vec_id", "v")).dropDuplicates(["query"])
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "query"), F.lit(blocks)).cast("int")).withColumnRenamed("vec_id", "query_id")
    queries = materialize(queries, "queries")

    unit = ["dim", "shard", "block"]
    # each shard stands once per block of queries, each query once per shard
    against = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*unit, "vec_id", "v")

    def run(some: DataFrame) -> DataFrame:
        def unit_of_work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return search(left, right, k)

        return some.groupBy(*unit).cogroup(against.groupBy(*unit)).applyInPandas(unit_of_work, FOUND)

    at_home = queries.select(*unit, "query", "query_id", "v", F.lit(LEAST).alias("kth"))
    home = materialize(run(at_home), "kth")
    kth = home.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    others = F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.array("shard"))
    away = queries.join(kth, "query", "left").withColumn("shard", F.explode(others)).select(*unit, "query", "query_id", "v", F.coalesce("kth", F.lit(LEAST)).alias("kth"))
    found = home if shards == 1 else home.unionByName(run(away))
    return best(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op9(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return top_k(vectors)
