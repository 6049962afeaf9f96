"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger neighbours (large) or smaller ones (small) to the least of its neighbourhood.

    Minima are pre-aggregated and joined back, so a node with any number of
    edges is spread over tasks.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_u", "_m"))
    joined = edges.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = joined.select("v", "_m").withColumnsRenamed({"v": "u", "_m": "v"}).unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component_id (its component's least node) of every node of links(a, b) but the least ones.

    Links may repeat, point either way or to themselves; without links the
    result is empty. The rounds grow with the logarithm of the nodes.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = common.stored(edges, "components")
    seen = None
    while True:
        after = common.stored(_stars(_stars(edges, True), False), "components")
        now = after.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        common.forget(edges)
        edges = after
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
        seen = now
