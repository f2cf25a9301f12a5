"""Approximate nearest neighbours by inner product in a hash-prefix forest.

A vector gets a string of 64 bits in each tree: on which sides of random hyperplanes it lies, after a
coordinate has been added that gives all vectors the same length (so the largest inner product is the
smallest angle). A tree is the sorted array of its strings. A query descends to its longest prefix
matches in all trees, then all trees ascend together, one bit at a time, until there are enough
candidates; from the worst of the best so far follows the prefix length at which a better vector
would have been missed with no more than the chance ``miss``, and the trees ascend to it. Candidates
are ranked by the exact product.

Vectors are dealt at random into blocks of bounded size, each with a forest of its own, and the
queries, in blocks as well, meet every block; the best of all blocks are merged.

Defined cases: vectors that are null, empty, zero or hold nulls or non-finite numbers take no part,
nor do rows without id; vectors of different lengths do not meet; rows that repeat id and vector count
once; of equal vectors only the ``k + 1`` least ids can ever be returned, so only they are indexed;
ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modcensus.llm.common import land

TREES, BITS = 32, 64
MISS = 0.05
BLOCK, QUERY_BLOCK = 8_192, 32_768
PORTION = 1_024  # queries searched at a time
SALTS = 32
FOUND = "query_id LONG, vec_id LONG, score DOUBLE"


class Forest:
    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, seed: int = 7):
        self._vectors, self._longest = vectors, longest
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        self._planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1] + 1, BITS))
        strings = self._strings(np.column_stack([vectors, rest]))
        self._order = np.argsort(strings, axis=1, kind="stable")
        self._sorted = np.take_along_axis(strings, self._order, 1)

    def _strings(self, points: np.ndarray) -> np.ndarray:
        """Of each tree and point the sides as one 64-bit string."""
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        return np.stack([((points @ planes) > 0) @ weights for planes in self._planes])

    def _ranges(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the points with the first ``level`` bits of each query lie in each tree."""
        if level == 0:
            return np.zeros(strings.shape, np.int64), np.full(strings.shape, self._sorted.shape[1])
        rest = np.uint64((1 << (BITS - level)) - 1)
        low, high = strings & ~rest, strings | rest
        first = [np.searchsorted(keys, row, "left") for keys, row in zip(self._sorted, low, strict=True)]
        last = [np.searchsorted(keys, row, "right") for keys, row in zip(self._sorted, high, strict=True)]
        return np.stack(first), np.stack(last)

    def _products(self, query: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = np.zeros(len(self._vectors), bool)
        for order, a, b in zip(self._order, first, last, strict=True):
            met[order[a:b]] = True
        at = np.flatnonzero(met)
        return at, self._vectors[at] @ query

    def search(self, queries: np.ndarray, own: list[np.ndarray], k: int, miss: float = MISS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query places and products of at least its k best found; ``own`` are left out."""
        best: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), PORTION):  # what is met by a portion's queries is alive at a time
            best += self._search(queries[at : at + PORTION], own[at : at + PORTION], k, miss)
        return best

    def _search(self, queries: np.ndarray, own: list[np.ndarray], k: int, miss: float) -> list[tuple[np.ndarray, np.ndarray]]:
        strings = self._strings(np.column_stack([queries, np.zeros(len(queries))]))
        enough = min(4 * k, len(self._vectors))
        levels = np.zeros(len(queries), np.int64)
        waiting = np.arange(len(queries))
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for level in range(BITS, -1, -1):  # all trees ascend together
            first, last = self._ranges(strings[:, waiting], level)
            ready = (last - first).sum(0) >= enough
            levels[waiting[ready]] = level
            for j in np.flatnonzero(ready):
                ranges[int(waiting[j])] = first[:, j], last[:, j]
            waiting = waiting[~ready]
            if not len(waiting):
                break
        best: list = [None] * len(queries)
        higher: dict[int, list[int]] = {}
        for i, query in enumerate(queries):
            found = self._products(query, *ranges[i])
            wanted = self._level(query, found, own[i], k, miss)
            if wanted < levels[i]:
                higher.setdefault(wanted, []).append(i)
            else:
                best[i] = self._best(query, *found, own[i], k)
        for level, some in higher.items():
            first, last = self._ranges(strings[:, some], level)
            for j, i in enumerate(some):
                best[i] = self._best(queries[i], *self._products(queries[i], first[:, j], last[:, j]), own[i], k)
        return best

    def _level(self, query, found, own, k: int, miss: float) -> int:
        """The prefix length that misses a vector as near as the k-th so far with chance ``miss``."""
        at, products = found
        products = products[~np.isin(at, own)]
        if len(products) < k:
            return 0
        cosine = np.partition(products, -k)[-k] / (np.linalg.norm(query) * self._longest)
        same_side = 1 - np.arccos(np.clip(cosine, -1, 1 - 1e-12)) / np.pi
        if same_side <= 0:
            return 0
        return int(np.log(1 - miss ** (1 / len(self._sorted))) / np.log(same_side))

    def _best(self, query, at, products, own, k: int) -> tuple[np.ndarray, np.ndarray]:
        keep = ~np.isin(at, own)
        at, products = at[keep], products[keep]
        if len(at) > k:
            close = products >= np.partition(products, -k)[-k] - 1e-9 * (1 + np.abs(products).max())
            at = at[close]
        # row by row in one order, so that equal vectors have equal products
        return at, (self._vectors[at] * query).sum(1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _search_block(k: int, trees: int, miss: float):
    def search(key: tuple, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        points = points.sort_values("vec_id", ignore_index=True)
        ids, names = points["vec_id"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
        forest = Forest(_matrix(points["embedding"]), float(points["longest"].iloc[0]), trees)
        own = [np.arange(a, b) for a, b in zip(np.searchsorted(ids, names, "left"), np.searchsorted(ids, names, "right"), strict=True)]
        names_of, found, scores = [], [], []
        for name, (at, score) in zip(names, forest.search(_matrix(queries["embedding"]), own, k, miss), strict=True):
            best = np.lexsort((ids[at], -score))[:k]
            names_of.append(np.full(len(best), name))
            found.append(ids[at[best]])
            scores.append(score[best])
        return pd.DataFrame({"query_id": np.concatenate(names_of), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    return search


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _least_ids(rows: DataFrame, salt: list[Column], most: int) -> DataFrame:
    """The rows with the ``most`` least ids of each vector (and salt)."""
    place = F.row_number().over(Window.partitionBy("embedding", *salt).orderBy("vec_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def neighbours(table: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest found for each query."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("_query"))
    rows = land(rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct(), "vectors")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    longest = land(rows.groupBy(F.size("embedding").alias("_size")).agg(F.max(length).alias("longest")), "lengths")
    # a very common vector is thinned in two steps
    indexed = _least_ids(_least_ids(rows, [F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))], k + 1), [], k + 1)
    indexed = land(indexed.select("vec_id", "embedding", F.size("embedding").alias("_size")), "indexed")
    queries = rows.where("_query")
    blocks, query_blocks = (max(1, -(-frame.count() // most)) for frame, most in ((indexed, block), (queries, QUERY_BLOCK)))
    deal = lambda name, n: F.pmod(F.xxhash64(name, F.lit(11)), F.lit(n)).alias("_" + name)
    # bounded: a row for each length of vectors
    points = indexed.join(F.broadcast(longest), "_size").select("_size", "longest", "vec_id", "embedding", deal("vec_id", blocks))
    points = points.withColumn("_query_id", F.explode(_numbers(query_blocks)))
    queries = queries.select(F.size("embedding").alias("_size"), F.col("vec_id").alias("query_id"), "embedding")
    queries = queries.select("*", deal("query_id", query_blocks)).withColumn("_vec_id", F.explode(_numbers(blocks)))
    keys = ["_size", "_vec_id", "_query_id"]
    found = points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search_block(k, trees, miss), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
