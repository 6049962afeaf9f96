"""Operator 1: exact top-k inner-product search without random access.

Each component of a block of candidates is one sorted list, whose entries hold
a row, its value and the row's norm. A query reads all lists sequentially from
the end that its signs ask for, in chunks, and keeps for each candidate the sum
of what was read and the norm of what was not. A score is at most that sum
plus, for the unread rest, the lists' values at the depth; at least the sum
plus their far ends; and either way within the product of the unread norms. A
candidate that can't reach the k-th best lower bound is out for good. Once no
more than a few times k are left, outsiders can't qualify, reading stops and
the scores of those left are resolved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import common

#: Rows of a block: candidates and queries meet in pairs of blocks, each in a task's group.
CANDIDATES, QUERIES = 8192, 2048
#: Queries that read a block's lists together.
TILE = 128
#: Shares of the lists after which the bounds are looked at.
DEPTHS = (0.25, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
#: Candidates in multiples of k that may be left when a query stops reading.
OPEN = 8
#: Integers up to this are exact as doubles.
EXACT = 1 << 53


def scored(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q and x."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if bound < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.array(q.astype(object) @ x.astype(object).T, np.int64)


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Lists:
    """A block's candidates as one sorted list a component, read from either end."""

    def __init__(self, x: np.ndarray):
        self.n, self.dim = x.shape
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0).astype(np.float64)
        self.rank = np.empty((self.n, self.dim), np.int32)
        np.put_along_axis(self.rank, self.order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        self.norms = (x.astype(np.float64) ** 2).sum(axis=1)

    def read(self, q: np.ndarray, sums: np.ndarray, squares: np.ndarray, begun: int, upto: int) -> None:
        """Adds the entries at depths begun to upto to each query's sums and squared norms: (candidates, queries).

        The chunk's entries alone are laid out by row and summed for all queries at once.
        """
        for sign, at in ((1, slice(self.n - upto, self.n - begun)), (-1, slice(begun, upto))):
            asks = np.where(q * sign > 0, q, 0.0).T
            chunk = np.zeros((self.n, self.dim))
            np.put_along_axis(chunk, self.order[at], self.sorted[at], axis=0)
            sums += chunk @ asks
            squares += (chunk * chunk) @ (asks != 0).astype(np.float64)

    def bounds(self, q: np.ndarray, rows: np.ndarray, sums: np.ndarray, squares: np.ndarray, depth: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of one query's scores with these rows, after all lists were read to the depth."""
        up = q > 0
        # each list's places as counted from the end that is read last, so what is unread has the places below n - depth
        unread = (np.where(up, 0, self.n - 1) + np.where(up, 1, -1) * self.rank[rows] < self.n - depth).astype(np.float32)
        last = min(depth, self.n - 1)
        next_, far = np.where(up, self.sorted[self.n - 1 - last], self.sorted[last]) * q, np.where(up, self.sorted[0], self.sorted[-1]) * q
        most, least, asked = (unread @ np.stack([next_, far, q * q], axis=1).astype(np.float64)).T
        rest = np.sqrt(np.maximum(asked * (self.norms[rows] - squares + slack), 0)) * (1 + 2.0**-40)
        return sums + np.minimum(most, rest) + slack, sums + np.maximum(least, -rest) - slack


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best in the block, and the share of the lists that each query read.

    A query's own id is no candidate of it. Sums are doubles; what rounding
    could do to large integers widens the bounds, and scores are exact.
    """
    out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    lists, depth_of = Lists(x), np.zeros(len(q))
    biggest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    slack = 0.0 if biggest < EXACT / 4 else max(biggest, float(lists.norms.max(initial=0))) * 2.0**-44
    for start in range(0, len(q), TILE):
        left = np.arange(start, min(start + TILE, len(q)))
        asks = q[left].astype(np.float64)
        sums, squares = np.zeros((lists.n, len(left))), np.zeros((lists.n, len(left)))
        may = [np.flatnonzero(ids != q_ids[i]) for i in left]
        read = 0
        for depth in DEPTHS:
            upto = min(lists.n, int(np.ceil(depth * lists.n)))
            lists.read(asks, sums, squares, read, upto)
            read = upto
            go_on = []
            for place, i in enumerate(left):
                rows = may[place]
                upper, lower = lists.bounds(asks[place], rows, sums[rows, place], squares[rows, place], upto, slack)
                if len(rows) > k:
                    rows = rows[upper >= np.partition(lower, len(rows) - k)[len(rows) - k]]
                may[place] = rows
                if len(rows) > OPEN * k and upto < lists.n:
                    go_on.append(place)
                    continue
                scores = scored(q[i][None, :], x[rows])[0]
                best = top_rows(scores, ids[rows], k)
                out.append((np.full(len(best), i), rows[best], scores[best]))
                depth_of[i] = upto / max(1, lists.n)
            if not go_on:
                break
            left, asks, may = left[go_on], asks[go_on], [may[p] for p in go_on]
            sums, squares = sums[:, go_on], squares[:, go_on]
    return *(np.concatenate(c) for c in zip(*out, strict=True)), depth_of


def integers(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (array of long: floor(scale * component)) and dim of the vectors that take part."""
    rows = common.only(embeddings, "vec_id", "embedding").where("vec_id is not null and size(embedding) > 0")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.where(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k vectors of highest inner product, ties to the smaller vec_id.

    vectors and queries: vec_id, v, dim as from integers(). Only vectors of a
    query's own length are its candidates, and none with its own vec_id; all,
    if they are fewer than k. A query id that repeats counts once, with its
    least vector; repeated candidates (same id and vector) count once. Empty
    tables give no rows. Scores must fit into 64 bits.

    Both sides are dealt to blocks by a hash of the id, so blocks are of even
    size whatever the vectors; each pair of blocks is searched on its own, and
    the blocks' best are merged. The number of blocks grows with the rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.dropDuplicates(["vec_id", "v"])
    queries = queries.groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    n, m = vectors.count(), queries.count()
    c_blocks = max(-(-n // CANDIDATES), min(spark.sparkContext.defaultParallelism, -(-n // 2048)), 1)
    q_blocks = max(-(-m // QUERIES), 1)
    block = lambda count: F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("vec_id", "v", "dim", block(q_blocks).alias("qb"), every(c_blocks).alias("cb"), F.lit(True).alias("asks"))
    right = vectors.select("vec_id", "v", "dim", every(q_blocks).alias("qb"), block(c_blocks).alias("cb"), F.lit(False).alias("asks"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("asks").to_numpy()
        ids = group.column("vec_id").to_numpy()
        lists = group.column("v").combine_chunks()
        rows = lists.flatten().to_numpy().reshape(len(group), -1)
        if asks.all() or not asks.any():
            return schema.empty_table()
        q, x, score, _ = search_block(rows[asks], ids[asks], rows[~asks], ids[~asks], k)
        return pa.Table.from_arrays([pa.array(ids[asks][q]), pa.array(ids[~asks][x]), pa.array(score)], schema=schema)

    found = left.unionByName(right).groupBy("dim", "qb", "cb").applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
