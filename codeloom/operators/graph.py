"""The property graph: edges(src, dst, kind), and traversals as loops of frontier joins.

Joins carry no hints: a small frontier is broadcast by its written size, and the
edges stay where they are; a large one is shuffled. Edges are written once for a
traversal and each level once, so lineage stays short and a lost executor costs
one level. Traversals take repeated edges as they come: what a level reaches is
made distinct, so nobody need shuffle all edges first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.lineage import cut


def union_edges(producers: list[DataFrame]) -> DataFrame:
    """One edge for each (src, dst, kind)."""
    return dedupe_edges(reduce(DataFrame.unionByName, [p.select("src", "dst", "kind") for p in producers]))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "kind"])


def with_kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    """the edges of some kinds; all without a list, none with an empty one."""
    return edges if kinds is None else edges.where(F.col("kind").isin(kinds) if kinds else F.lit(False))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def via_sets(edges: DataFrame) -> DataFrame:
    """A2: id, via (sorted kinds of the edges that reach it)."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("kind")).alias("via"))


def visit(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """id, depth of the roots (0) and of all they reach, least depth each.

    stop(id): nodes that are reached but neither kept nor left again (G9).
    Further columns of roots name separate traversals, walked in one go.
    """
    pairs = edges.select("src", "dst")
    if stop is not None:
        pairs = pairs.join(stop.select(F.col("id").alias("dst")), "dst", "left_anti")
    return _levels(pairs if max_depth is not None and max_depth < 2 else cut(pairs), roots, max_depth)


def _levels(pairs: DataFrame, roots: DataFrame, max_depth: int | None) -> DataFrame:
    """visit() on pairs that are cheap to read once a level."""
    key = [c for c in roots.columns if c != "id"] + ["id"]
    frontier = cut(roots.select(key).distinct().withColumn("depth", F.lit(0)))
    levels = [frontier]
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        seen = reduce(DataFrame.unionByName, levels).select(key)
        step = frontier.join(pairs, F.col("id") == F.col("src")).select(*key[:-1], F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, key, "left_anti").withColumn("depth", F.lit(depth)))
        levels.append(frontier)
        if depth != max_depth and frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def traverse(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, kinds: list[str] | None = None, universe: DataFrame | None = None) -> DataFrame:
    """id, depth, via of what the roots reach, without them (G1; G2 on reverse(edges)).

    via holds the kinds of all edges from nodes that were left, not only those
    on shortest paths; nodes at the depth limit are not left. universe(id):
    only these nodes are stepped on (F15).
    """
    allowed = with_kinds(edges, kinds)
    if universe is not None:
        allowed = allowed.join(universe.select(F.col("id").alias("dst")), "dst", "left_semi")
    allowed = cut(allowed.select("src", "dst", "kind"))
    seen = _levels(allowed, roots, max_depth)
    left = seen if max_depth is None else seen.where(F.col("depth") < max_depth)
    used = allowed.join(left.select(F.col("id").alias("src")), "src", "left_semi")
    return seen.where("depth > 0").join(via_sets(used), "id")


def flow(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """src, dst, kind, depth of every edge left within the depth (G7): also those to nodes seen before."""
    edges = cut(edges)
    seen = _levels(edges, roots, max_depth - 1)
    return dedupe_edges(edges.join(seen.select(F.col("id").alias("src"), (F.col("depth") + 1).alias("depth")), "src"))


def related_edges(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Each arc once, with the level that it is walked at."""
    edges = cut(edges)
    seen = _levels(edges, roots, None if max_depth is None else max_depth - 1)
    return dedupe_edges(edges.join(seen.select(F.col("id").alias("src"), (F.col("depth") + 1).alias("level")), "src").select("src", "dst", "kind", "level"))


def first_parents(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, depth, parent, kind: the breadth-first tree (W1); among parents a level up the least (parent, kind) wins.

    Further columns of roots name separate trees and come first.
    """
    edges = cut(edges.select("src", "dst", "kind"))
    seen = _levels(edges, roots, max_depth)
    key = [c for c in seen.columns if c not in ("id", "depth")]
    up = seen.select(*key, F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"))
    arcs = edges.join(up, F.col("src") == F.col("parent")).withColumnRenamed("dst", "id").join(seen, [*key, "id", "depth"])
    return arcs.groupBy(*key, "id", "depth").agg(F.min(F.struct("parent", "kind")).alias("p")).select(*key, "id", "depth", "p.parent", "p.kind")


def path_kinds(tree: DataFrame) -> DataFrame:
    """id, kinds of the path from its root (G10), from first_parents(): a join a level; further columns as there."""
    tree = cut(tree)
    key = [c for c in tree.columns if c not in ("id", "depth", "parent", "kind")]
    paths = tree.where("depth = 1").select(*key, "id", F.array("kind").alias("kinds"))
    out, depth = [paths], 1
    while True:
        depth += 1
        level = tree.where(F.col("depth") == depth)
        paths = cut(level.join(out[-1].withColumnsRenamed({"id": "parent", "kinds": "_k"}), [*key, "parent"]).select(*key, "id", F.array_append("_k", F.col("kind")).alias("kinds")))
        if paths.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(paths)


def confidence(kinds: F.Column, low: list[str], medium: list[str]) -> F.Column:
    """Low if any kind is, else medium if any is, else high."""
    any_of = lambda names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    return F.when(any_of(low), "low").when(any_of(medium), "medium").otherwise("high")


def closure(edges: DataFrame) -> DataFrame:
    """a, b: b is reached from a, by doubling of paths; the rounds grow with the logarithm of the longest one."""
    reach = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    while True:
        longer = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        more = cut(reach.unionByName(longer).distinct())
        if more.count() == reach.count():
            return more
        reach = more


def trim(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have edges both in and out, again and again: those of no cycle's reach fall away."""
    n = edges.count()
    while n:
        kept = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n, edges = n, kept.count(), kept
        if n == before:
            break
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """id, component: the strongly connected components of two nodes or more, named by their least node.

    Each node takes the least node that reaches it as its colour; what reaches
    that node back within the colour is its component. Components are taken out
    and the rest is coloured again, so no more than nodes and edges is ever held.
    """
    left = trim(cut(edges.select("src", "dst").where("src <> dst").distinct()))
    found = [left.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)]
    while not left.isEmpty():
        colours = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("component", F.col("id")))
        while True:
            sent = left.join(colours, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "component")
            after = cut(colours.unionByName(sent).groupBy("id").agg(F.min("component").alias("component")))
            changed = not after.join(colours, ["id", "component"], "left_anti").isEmpty()
            colours = after
            if not changed:
                break
        ends = [colours.withColumnsRenamed({"id": c, "component": f"_{c}"}) for c in ("src", "dst")]
        within = left.join(ends[0], "src").join(ends[1], "dst").where("_src = _dst").select("src", "dst")
        members = cut(visit(reverse(within), colours.where("id = component")).select("id").join(colours, "id"))
        found.append(members.join(members.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1"), "component", "left_semi").select("id", "component"))
        for c in ("src", "dst"):
            left = left.join(members.select(F.col("id").alias(c)), c, "left_anti")
        left = trim(cut(left.select("src", "dst")))
    return reduce(DataFrame.unionByName, found)


def inherited_or(values: DataFrame, edges: DataFrame) -> DataFrame:
    """id, value: true if it or anything below it is."""
    reach = closure(edges).withColumnRenamed("b", "id").join(values, "id").groupBy(F.col("a").alias("id")).agg(F.bool_or("value").alias("below"))
    return values.join(reach, "id", "left").select("id", (F.col("value") | F.coalesce("below", F.lit(False))).alias("value"))


def collapse(entries: DataFrame, folder: F.Column) -> DataFrame:
    """id, depth, via of entries(id, depth, via) by folder: least depth, and the via of the first row (F1)."""
    return entries.groupBy(folder.alias("folder")).agg(F.min("depth").alias("depth"), F.min_by("via", F.struct("depth", "id")).alias("via")).withColumnRenamed("folder", "id")


def take_in_groups(candidates: DataFrame, limits: dict[str, int], total: int) -> DataFrame:
    """candidates(group, ord, item) that fit: each group in the order of `limits` up to its limit, all up to the total."""
    rank = F.create_map(*[x for i, g in enumerate(limits) for x in (F.lit(g), F.lit(i))])
    limit = F.create_map(*[x for g, n in limits.items() for x in (F.lit(g), F.lit(n))])
    own = Window.partitionBy("group").orderBy("ord", "item")
    kept = candidates.where(F.col("group").isin(list(limits))).withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= limit[F.col("group")])
    kept = kept.withColumn("_g", rank[F.col("group")])
    # what is left is bounded by the limits' sum
    return kept.withColumn("_all", F.row_number().over(Window.orderBy("_g", "_n"))).where(F.col("_all") <= total).drop("_n", "_g", "_all")


def public_names(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """All nodes(id, name) that share a wanted name."""
    return nodes.join(wanted.select("name").distinct(), "name", "left_semi")
