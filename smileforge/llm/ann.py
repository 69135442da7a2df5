"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree hashes a vector to a long bit string, one bit per random hyperplane,
and keeps the strings in a sorted array.  A query descends in every tree to
the rows with the longest common prefix, then ascends in all trees at the same
time, one bit at a time, until enough rows share a prefix with it in some tree.
These are ranked by the exact inner product.

Rows are indexed in blocks by a hash of their id; every query searches every
block, in chunks of queries, and the best of each block are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table

TREES = 64
#: Bits of a hash string; they are packed in one unsigned integer.
BITS = 32
#: A query ascends until this share of a block's rows are candidates (and at least as many as it returns).
CANDIDATE_SHARE = 0.55
#: Rows of a block and queries of a chunk, about.
BLOCK_ROWS, CHUNK_QUERIES = 8192, 8192
NEIGHBOURS = 20


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(dim * 7919 + 6).standard_normal((dim, TREES * BITS))


def strings(vectors: np.ndarray) -> np.ndarray:
    """Bit strings, one row per tree; the first hyperplane gives the highest bit."""
    out = np.zeros((TREES, len(vectors)), np.uint64)
    for lo in range(0, len(vectors), 2048):
        bits = (vectors[lo : lo + 2048] @ planes(vectors.shape[1]) > 0).reshape(-1, TREES, BITS)
        for k in range(BITS):
            out[:, lo : lo + 2048] = (out[:, lo : lo + 2048] << np.uint64(1)) | bits[:, :, k].T
    return out


class Forest:
    """Sorted arrays of hash strings over one block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.vectors = ids, vectors
        hashed = strings(augmented(vectors, longest))
        self.order = np.argsort(hashed, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashed, self.order, axis=1)

    def ranges(self, hashed: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query: the rows whose first ``depth`` bits are the query's."""
        shift = np.uint64(BITS - depth)
        low = (hashed >> shift) << shift
        high = low + (np.uint64(1) << shift)
        lo = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, low, strict=True)])
        hi = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, high, strict=True)])
        return lo, hi

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each query's best ``k`` candidates, best first, ties to the smaller id; ``own`` ids take no part."""
        n = len(self.ids)
        want = min(n, max(k + 1, math.ceil(CANDIDATE_SHARE * n)))
        hashed = strings(augmented(queries, None))
        levels = {}
        for q in range(len(queries)):
            seen = np.zeros(n, bool)
            for depth in range(BITS, -1, -1):
                if depth not in levels:
                    levels[depth] = self.ranges(hashed, depth)
                lo, hi = levels[depth][0][:, q], levels[depth][1][:, q]
                if (hi - lo).sum() < want and depth:
                    continue  # fewer rows than are wanted, even if all were different
                for t in range(TREES):
                    seen[self.order[t, lo[t] : hi[t]]] = True
                if seen.sum() >= want:
                    break
            found = np.flatnonzero(seen & (self.ids != own[q]))
            scores = (self.vectors[found] * queries[q]).sum(axis=1)
            if len(found) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= least
                found, scores = found[keep], scores[keep]
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield self.ids[found[best]], scores[best]


def augmented(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """One more component, so that the largest inner product is the smallest angle: rows get the length that they lack to ``longest``, queries (None) get 0."""
    if longest is None:
        return np.hstack([vectors, np.zeros((len(vectors), 1))])
    lack = np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(axis=1), 0))
    return np.hstack([vectors, lack[:, None]])


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, dim, norm) of the rows whose vector takes part, in double precision."""
    v = F.col(vector_column).cast("array<double>")
    ok = F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return rows.where(ok).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"), norm.alias("norm"))


def neighbours(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product for each row whose id ``every`` divides.

    Vectors that are null, empty or zero, or hold a null or non-finite
    component, take no part, nor do rows with a null id.  Vectors are compared
    with those of the same length only.  A row is no neighbour of its own id.
    Equal scores rank by the smaller id; repeated rows are neighbours as often
    as they come, and one query; rows that share an id and differ in the vector
    are a query each, with ranks of their own.  An empty table gives an empty
    result, and columns of any other name play no part.
    """
    spark = rows.sparkSession
    space = Workspace(spark, "ann")
    good = space.write(valid_vectors(rows, id_column, vector_column))
    sizes = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max("norm").alias("longest")).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = spark.createDataFrame([(r["dim"], max(1, -(-r["n"] // BLOCK_ROWS)), max(1, -(-r["q"] // CHUNK_QUERIES)), float(r["longest"])) for r in sizes], "dim int, blocks int, chunks int, longest double")
    placed = good.join(F.broadcast(plan), "dim")
    own = lambda what: F.pmod(F.xxhash64("vec_id", F.lit(what)), F.col({"block": "blocks", "chunk": "chunks"}[what])).cast("int")
    data = placed.withColumn("block", own("block")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = placed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn("chunk", own("chunk")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["dim", "block", "chunk"]
    schema = "query_id long, q_key long, vec_id long, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], [], []
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            vectors, queries = (c.combine_chunks().flatten().to_numpy().reshape(-1, dim) for c in (left["v"], right["q_v"]))
            ids, own_ids, keys_ = left["vec_id"].to_numpy(), right["q_id"].to_numpy(), right["q_key"].to_numpy()
            forest = Forest(ids, vectors, left["longest"][0].as_py())
            for lo in range(0, len(queries), 1024):
                part = slice(lo, lo + 1024)
                for q, key, (found, scores) in zip(own_ids[part], keys_[part], forest.search(queries[part], own_ids[part], k), strict=True):
                    for column, x in zip(out, (np.full(len(found), q), np.full(len(found), key), found, scores), strict=True):
                        column.append(x)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("query_id", "q_key", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})

    data = data.select(*keys, "vec_id", "v", "longest")
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in keys), F.col("vec_id").alias("q_id"), F.xxhash64("v").alias("q_key"), F.col("v").alias("q_v"))
    best = data.groupBy(*keys).cogroup(asked.groupBy(*(f"q_{c}" for c in keys))).applyInArrow(run, schema)
    order = Window.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector, by inner product."""
    return neighbours(table(spark, sf_dir, "embeddings"))
