"""Operator 5, exact top-k search by Fagin's threshold algorithm.

Candidates are dealt into blocks of some BLOCK rows, queries into blocks of at most QUERIES. In a candidate block each
dimension has a list of the rows sorted by that component. A query reads the lists from the top where its own
component is positive and from the bottom where it is negative (sorted accesses), always going on in those whose next entry adds
most: all entries that add more than a level are read, then the level falls. A row met for the first time gets its whole score
(random access). The bound, the sum of what the lists' next entries add, is the most that a row not yet met can have; the walk stops as soon as it
is below the k-th score so far, or when every row has been met. Ties with the k-th score go on, so that the smaller id
wins. The blocks' k best are merged by query.

Scores are exact integers: in float64 where no sum can pass 2^52, else in int64, and where one could pass 2^62 in Python's
integers; a score beyond 64 bits becomes the nearest long before it is ranked, so such scores are ties. Defined results:
vectors that are null or hold a null, NaN or infinite component or no component take no part; vectors of unlike length are
not compared; rows that share an id are one query, whose list merges theirs, and not candidates of each other; fewer than
k candidates give fewer rows; ties go to the smaller id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 20
BLOCK = 32_768
QUERIES, LEAST_QUERIES = 8_192, 32
#: The level falls to this share of the greatest next entry.
FALL = 0.7
_MOST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components, and not empty."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """(id, dims, v): each component to floor(factor * x), x as double."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e")).where(usable(F.col("e")) & F.col("id").isNotNull())
    return rows.select("id", F.size("e").alias("dims"), F.transform("e", lambda x: F.floor(x.cast("double") * F.lit(factor)).cast("long")).alias("v"))


class Walk(NamedTuple):
    best: list[tuple[int, int]]  # (score, id)
    sorted_accesses: int
    random_accesses: int
    stopped: bool  # by the bound, with rows that were never met


class Block:
    """A candidate block: rows in rising order of id, and each dimension's list of row numbers in rising order of its component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.lists = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(rows.T, self.lists, 1)

    def threshold_search(self, query_id: int, q: np.ndarray, k: int) -> Walk:
        """The k best of the block for one query."""
        n = len(self.ids)
        open_ = np.ones(n, bool)
        open_[np.searchsorted(self.ids, query_id, "left") : np.searchsorted(self.ids, query_id, "right")] = False
        dims = np.flatnonzero(q != 0)  # a list with weight 0 adds nothing to a score
        weight = q[dims]
        up = weight > 0
        depth = np.zeros(len(dims), np.int64)  # entries read of each list
        best_rows, best = np.empty(0, np.int64), np.empty(0, self.rows.dtype)
        read = random = 0
        unmet = int(open_.sum())
        if not len(dims):  # all scores are 0
            best_rows = np.flatnonzero(open_)[:k]
            return Walk([(0, int(i)) for i in self.ids[best_rows]], 0, 0, unmet > k)
        while unmet:
            # no list has been read through, as it would have met every row
            adds = self.values[dims, np.where(up, n - 1 - depth, depth)] * weight
            if len(best) == k and adds.sum() < best.min():
                break
            top = adds.max()
            level = top * FALL if top > 1 else 0.0 if top > 0 else 2.0 * top - 1
            slices = []
            for i, (d, w) in enumerate(zip(dims.tolist(), weight.tolist(), strict=True)):
                # entries x with w * x above the level
                limit = level / w
                upto = n - int(np.searchsorted(self.values[d], limit, "right")) if w > 0 else int(np.searchsorted(self.values[d], limit, "left"))
                if upto > depth[i]:
                    slices.append(self.lists[d, n - upto : n - depth[i]] if w > 0 else self.lists[d, depth[i] : upto])
                    read += upto - int(depth[i])
                    depth[i] = upto
            if not slices:  # the level's rounding left out the greatest next entry
                i = int(np.argmax(adds))
                slices.append(self.lists[dims[i], [n - 1 - depth[i] if up[i] else depth[i]]])
                read, depth[i] = read + 1, depth[i] + 1
            new = np.zeros(n, bool)
            new[np.concatenate(slices)] = True
            fresh = np.flatnonzero(new & open_)
            open_[fresh] = False
            unmet -= len(fresh)
            random += len(fresh)
            score = np.concatenate([best, saturated(self.rows[fresh] @ q)])
            at = np.concatenate([best_rows, fresh])
            if len(at) > k:
                # all above the k-th score, then of those equal to it the smallest ids
                kth = np.partition(score, len(score) - k)[len(score) - k]
                above, level_ = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
                level_ = level_[np.argsort(at[level_], kind="stable")][: k - len(above)]
                take = np.concatenate([above, level_])
                score, at = score[take], at[take]
            best, best_rows = score, at
        order = sorted(range(len(best)), key=lambda i: (-best[i], best_rows[i]))
        return Walk([(int(best[i]), int(self.ids[best_rows[i]])) for i in order], read, random, unmet > 0)


def saturated(scores: np.ndarray) -> np.ndarray:
    return np.array([max(-_MOST - 1, min(_MOST, x)) for x in scores], object) if scores.dtype == object else scores


def _matrices(*vectors: pd.Series) -> list[np.ndarray]:
    """The vectors as matrices of a type in which no sum of products is inexact."""
    whole = [np.stack(v.to_numpy()).astype(np.int64) for v in vectors]
    top = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in whole]
    most = top[0] * top[-1] * whole[0].shape[1]
    return [x.astype(np.float64 if most < 1 << 52 else np.int64 if most < 1 << 62 else object) for x in whole]


def block_search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int = K) -> pd.DataFrame:
    found: list[tuple[int, int, int]] = []
    if len(queries) and len(candidates):
        candidates = candidates.sort_values("id", kind="stable")
        rows, asked = _matrices(candidates["v"], queries["v"])
        block = Block(candidates["id"].to_numpy(), rows)
        for query_id, q in zip(queries["id"].tolist(), asked, strict=True):
            found += [(query_id, vec_id, score) for score, vec_id in block.threshold_search(query_id, q, k).best]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")


def search(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of greatest inner product for every query, its own id left out.

    Both inputs are quantised(). Each pair of blocks is one group of bounded size; a candidate is repeated once for each
    query block. Where there are fewer pairs than the session has cores, query blocks are made smaller."""
    n, asked = candidates.count(), queries.count()
    n_blocks = max(1, -(-n // block))
    spare = -(-queries.sparkSession.sparkContext.defaultParallelism // n_blocks)
    q_blocks = max(1, -(-asked // query_block), min(spare, -(-asked // LEAST_QUERIES)))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", deal(q_blocks)).withColumn("cb", spread(n_blocks))
    right = candidates.withColumn("cb", deal(n_blocks)).withColumn("qb", spread(q_blocks))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return block_search(a, b, k)

    keys = ["dims", "qb", "cb"]
    # dealt by a number of its own: the work isn't in proportion to the bytes
    tasks = min(n_blocks * q_blocks, 4 * queries.sparkSession.sparkContext.defaultParallelism)
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    best = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return search(rows.where(F.col("id") % 20 == 0), rows)


ORACLE = """
    WITH good AS (
        SELECT vec_id, embedding FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM good),
    scored AS (
        SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
        FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
