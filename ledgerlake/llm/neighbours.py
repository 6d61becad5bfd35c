"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Vectors are dealt into blocks of about ``BLOCK`` rows by a hash of their id. A block keeps ``LINES`` random
projections, each a sorted array. A query's windows, centred on its own projections, grow by virtual
rehashing (radius times ``GROW``); windows end at whole ``PARTS``ths of an array, so a row's place is one byte and
collisions are counted for all rows at once. Vectors in at least ``MEET`` of the windows are verified, once ``SHARE`` of the
block are, with exact inner products; each block's best are merged.
Inner product becomes distance by one more coordinate, which levels all norms of a block.

Every row is indexed and every block is asked, so blocks need no routing and no group can be hot. Queries
are dealt in blocks too: nothing grows but the number of pairs of blocks. Counting is queries times rows: in isotropic vectors of 64
dimensions a window that holds a neighbour with probability 0.74 holds 0.60 of all rows, so that windows of a globally sorted projection
would reach most of its partitions and nothing is saved by routing. (recall is measured in the tests and in the README)

Defined cases: null, zero or non-finite vectors and null ids take no part; vectors of each length are searched among
themselves; magnitudes are levelled before squaring, so none is too large or small; with equal ids each row is a vector of its own, and
none is a candidate of a query with that id; ties go to the smaller id; fewer than k candidates are all returned; a product that is no number
comes last; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ._spark import settle
from ._words import release

BLOCK, QUERIES, LINES, MEET, SHARE, FEW, GROW, START, LEVELS, PARTS = 16_384, 4_096, 128, 84, 0.15, 200, 1.05, 0.02, 160, 256


class Block:
    """Sorted projections of the rows of ``x`` (n, d)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        level = x / np.abs(x).max()
        square = (level * level).sum(1)
        self.norm = np.sqrt(square.max())
        rest = np.sqrt(np.maximum(self.norm**2 - square, 0))
        self.lines = np.random.default_rng(7).standard_normal((x.shape[1] + 1, LINES))
        p = (level @ self.lines[:-1] + rest[:, None] * self.lines[-1]).T
        order = np.argsort(p, axis=1)
        self.sorted = np.take_along_axis(p, order, 1)
        place = (np.arange(len(x)) * PARTS // len(x)).astype(np.uint8)
        self.place = np.empty(p.shape, np.uint8)  # of each row, on each line
        np.put_along_axis(self.place, order, np.broadcast_to(place, p.shape), 1)
        self.from_low, self.inside = np.empty_like(self.place), np.empty(p.shape, bool)

    def candidates(self, q: np.ndarray) -> np.ndarray:
        """Rows that share at least MEET windows with ``q`` at the radius where enough do."""
        n = len(self.x)
        q = q / np.abs(q).max()
        centre = (q * (self.norm / np.sqrt((q * q).sum()))) @ self.lines[:-1]
        reach = START * self.norm * GROW ** np.arange(LEVELS)
        reach[-1] = np.inf
        low = np.array([s.searchsorted(c - reach) for s, c in zip(self.sorted, centre)])  # ends of each line's window at each level
        high = np.array([s.searchsorted(c + reach, "right") for s, c in zip(self.sorted, centre)])
        enough = min(n, max(FEW, ceil(SHARE * n)))
        # Windows in which a row is met MEET times less a deviation and a half on average are a beginning; smaller ones hold too few.
        level = min(int(((high - low).sum(0) < (MEET - 0.75 * LINES**0.5) * n).sum()), LEVELS - 1)
        while True:
            first = low[:, level] * PARTS // n
            last = np.minimum(np.maximum((high[:, level] * PARTS + n - 1) // n, first + 1), PARTS) - 1
            np.subtract(self.place, np.minimum(first, PARTS - 1).astype(np.uint8)[:, None], out=self.from_low)
            np.less_equal(self.from_low, np.maximum(last - first, 0).astype(np.uint8)[:, None], out=self.inside)
            met = np.add.reduce(self.inside.view(np.uint8), 0, dtype=np.uint8)
            found = np.flatnonzero(met >= MEET)
            if len(found) >= enough or level == LEVELS - 1:
                return found
            level += 1

    def best(self, key: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.candidates(q)
        found = found[self.ids[found] != key]
        with np.errstate(all="ignore"):
            score = np.einsum("ij,j->i", self.x[found], q)
        order = np.where(np.isnan(score), -np.inf, score)
        if len(found) > k:
            keep = order >= np.partition(order, len(order) - k)[len(order) - k]
            found, score, order = found[keep], score[keep], order[keep]
        first = np.lexsort((self.ids[found], -order))[:k]
        return self.ids[found][first], score[first]


def searcher(k: int):
    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            block = Block(rows.vec_id.to_numpy(), np.stack(rows.x.to_list()).astype(np.float64))
            for key, q in zip(queries.vec_id, queries.x):
                ids, score = block.best(key, np.asarray(q, np.float64), k)
                out.append(pd.DataFrame({"query_id": key, "vec_id": ids, "score": score}))
            del block
            release()
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return search


def nearest(vectors: DataFrame, queries, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors found with the largest inner product (double precision) for each query.

    ``vectors(vec_id, embedding)``; ``queries``: condition on its rows that makes one a query.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", fine) & F.exists("x", lambda v: v != 0))
    x = x.withColumn("d", F.size("x"))
    sizes = x.groupBy("d").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count_if("asks") / QUERIES)).cast("int").alias("asked"))
    x = x.join(F.broadcast(sizes), "d")  # a row for each length of vector that there is
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = x.select("d", deal("blocks", 1).alias("b"), every("asked").alias("q"), "vec_id", "x")
    asks = x.filter("asks").select(F.col("d").alias("d"), every("blocks").alias("b"), deal("asked", 2).alias("q"), F.col("vec_id").alias("vec_id"), F.col("x").alias("x"))
    keys = ("d", "b", "q")
    found = settle(rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(searcher(k), "query_id long, vec_id long, score double"))
    found = found.withColumn("order", F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")))
    best = Window.partitionBy("query_id").orderBy(F.desc("order"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
