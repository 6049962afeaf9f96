"""Operator 6: near duplicates among embeddings by collision counting.

Vectors are projected on many seeded random lines and sorted along each. A
pair collides on a line when one lies in the window centred on the other.
Pairs that collide on enough lines are verified by their cosine. How many are
enough follows from the recall asked for: a pair at the threshold itself
differs along a line by a normal variable of known width.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common
from codeloom.llm.components import components

LINES, WINDOW, RECALL, SEED = 64, 0.15, 0.995, 6
BLOCK = 8192


def enough_collisions(threshold: float, lines: int = LINES, window: float = WINDOW, recall: float = RECALL) -> int:
    """The highest count that a pair at the threshold reaches with the probability `recall`."""
    apart = math.sqrt(max(2 - 2 * threshold, 1e-12))
    p = math.erf(window / apart / math.sqrt(2))
    reach, least = 1.0, 0
    for k in range(lines):  # reach: the chance of k collisions or more
        reach -= math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if reach < recall:
            return max(1, least)
        least = k + 1
    return max(1, least)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def lines_for(dim: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(SEED + 1000 * dim).standard_normal((dim, lines))


def links_in(a: np.ndarray, b: np.ndarray, same: bool, threshold: float):
    """For each row of a: its number and the rows of b it links to. same: a is b, and each pair comes once."""
    least = enough_collisions(threshold)
    directions = lines_for(a.shape[1])
    pa_, pb = a @ directions, b @ directions
    order = np.argsort(pb, axis=0, kind="stable").astype(np.int32)
    sorted_b = np.take_along_axis(pb, order, axis=0)
    low = np.stack([np.searchsorted(sorted_b[:, j], pa_[:, j] - WINDOW, "left") for j in range(LINES)], axis=1)
    high = np.stack([np.searchsorted(sorted_b[:, j], pa_[:, j] + WINDOW, "right") for j in range(LINES)], axis=1)
    columns = [np.ascontiguousarray(order[:, j]) for j in range(LINES)]
    for i in range(len(a)):
        lo, hi = low[i].tolist(), high[i].tolist()
        met = np.bincount(np.concatenate([c[x:y] for c, x, y in zip(columns, lo, hi, strict=True)]), minlength=len(b))
        found = np.flatnonzero(met >= least)
        if same:
            found = found[found > i]
        if len(found):
            found = found[b[found] @ a[i] >= threshold]
            if len(found):
                yield i, found


def tile(ids_a, a, weight_a, ids_b, b, weight_b, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, least id it is joined with here) of the rows that link in a pair of blocks.

    Links are counted and joined as they are found; pairs are never kept.
    """
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    shift = 0 if same else len(ids_a)
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label = rank.copy()
    links = np.zeros(len(ids), np.int64)
    for i, found in links_in(unit(a), unit(b), same, threshold):
        there = found + shift
        links[i] += weight_b[found].sum()
        links[there] += weight_a[i]
        roots = np.unique(np.append(label[there], label[i]))
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    some = links > 0
    return ids[some], links[some], np.sort(ids)[label[some]]


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings(vec_id, embedding).

    Equal vectors are one class, compared once; each member counts the others
    of its class and the members of the classes it links to. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing:
    0 links, their own component, kept. Vectors of different lengths don't
    link. A null vec_id links with nothing. An empty table gives no rows.

    Classes are dealt to blocks by a hash of the id and each pair of blocks is
    one group, so no task holds more than two blocks, whatever is alike.
    """
    rows = common.only(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    classes = rows.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"))
    # a vec_id that repeats with other vectors stands for all of them
    classes = common.stored(classes.withColumn("dim", F.size("embedding")), "vector-classes")
    n = classes.count()
    blocks = max(-(-n // BLOCK), min(12, -(-n // 512)), 1)
    own = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int")
    dealt = classes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("rep", "members", "embedding", "dim", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own, i, j = group.column("own").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        ids, members = group.column("rep").to_numpy(), group.column("members").to_numpy()
        vectors = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(group), -1)
        x, y = own == i, own == j
        found = tile(ids[x], vectors[x], members[x], ids[y], vectors[y], members[y], i == j, threshold) if x.any() and y.any() else (np.zeros(0, np.int64),) * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in found], names=["rep", "links", "least"])

    found = common.stored(dealt.groupBy("dim", "i", "j").applyInArrow(run, "rep bigint, links bigint, least bigint"), "vector-links")
    counts = found.groupBy(F.col("rep").alias("_rep")).agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    of = classes.join(counts, F.col("rep") == F.col("_rep"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    of = of.select(F.col("embedding").alias("_e"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = rows.where(fine).join(of, F.col("embedding") == F.col("_e")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
