"""Traversals against plain breadth-first search on random graphs with cycles, repeats and parallel kinds."""

import random
from collections import deque

import pytest

from codeloom.operators import graph as G


def random_edges(seed, nodes=25, n=60):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice("xyz")) for _ in range(n)]


def plain(edges, roots, most=None):
    depth = dict.fromkeys(roots, 0)
    queue, via = deque(roots), {}
    while queue:
        a = queue.popleft()
        if most is not None and depth[a] >= most:
            continue
        for s, d, k in edges:
            if s == a:
                via.setdefault(d, set()).add(k)
                if d not in depth:
                    depth[d] = depth[a] + 1
                    queue.append(d)
    return {n: (d, sorted(via[n])) for n, d in depth.items() if n not in roots}


def roots_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@pytest.mark.parametrize("seed, most", [(1, None), (2, 2), (3, 1), (4, 3)])
def test_traverse(spark, seed, most):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, "src string, dst string, kind string")
    got = {r.id: (r.depth, r.via) for r in G.traverse(df, roots_of(spark, ["n1", "n2"]), most).collect()}
    assert got == plain(edges, ["n1", "n2"], most)
    back = [(b, a, k) for a, b, k in edges]
    got = {r.id: (r.depth, r.via) for r in G.traverse(G.reverse(df), roots_of(spark, ["n3"]), most, ["x", "y"]).collect()}
    assert got == plain([e for e in back if e[2] != "z"], ["n3"], most)


def test_separate_starts(spark):
    edges = random_edges(9)
    df = spark.createDataFrame(edges, "src string, dst string, kind string")
    starts = spark.createDataFrame([("n1", "n1"), ("n2", "n2"), ("n1", "both"), ("n2", "both")], "id string, start string")
    tree = G.first_parents(df, starts)
    paths = {(r.start, r.id): r.kinds for r in G.path_kinds(tree).collect()}
    for start, ids in (("n1", ["n1"]), ("n2", ["n2"]), ("both", ["n1", "n2"])):
        depth = {n: d for n, (d, _) in plain(edges, ids).items()}
        assert {i: len(k) for (s, i), k in paths.items() if s == start} == depth


def test_edges_of_the_rule_book(spark):
    df = spark.createDataFrame([("r", "a", "x"), ("r", "a", "y"), ("a", "r", "x"), ("a", "b", "x"), ("c", "b", "z"), ("r", "c", "x"), ("r", "a", "x")], "src string, dst string, kind string")
    got = {r.id: (r.depth, r.via) for r in G.traverse(df, roots_of(spark, ["r", "missing"])).collect()}
    assert got == {"a": (1, ["x", "y"]), "c": (1, ["x"]), "b": (2, ["x", "z"])}
    assert G.traverse(df, roots_of(spark, ["r"]), kinds=[]).count() == 0
    assert {r.id for r in G.traverse(df, roots_of(spark, ["r"]), universe=roots_of(spark, ["a", "b"])).collect()} == {"a", "b"}
    assert {r.id for r in G.visit(df, roots_of(spark, ["r"]), stop=roots_of(spark, ["a"])).collect()} == {"r", "b", "c"}
    assert G.dedupe_edges(df).count() == 6


def test_paths_and_flow(spark):
    edges = random_edges(7)
    df = spark.createDataFrame(edges, "src string, dst string, kind string")
    tree = {r.id: r for r in G.first_parents(df, roots_of(spark, ["n1"])).collect()}
    depth = {n: d for n, (d, _) in plain(edges, ["n1"]).items()}
    assert {n: r.depth for n, r in tree.items()} == depth
    for n, r in tree.items():
        assert r.depth == (depth[r.parent] if r.parent != "n1" else 0) + 1
        assert (r.parent, r.kind) == min((s, k) for s, d, k in edges if d == n and (s == "n1" and depth[n] == 1 or depth.get(s) == depth[n] - 1 and s != "n1"))
    paths = {r.id: r.kinds for r in G.path_kinds(G.first_parents(df, roots_of(spark, ["n1"]))).collect()}
    assert {n: len(k) for n, k in paths.items()} == depth
    arcs = {(r.src, r.dst, r.kind) for r in G.flow(df, roots_of(spark, ["n1"]), 2).collect()}
    assert arcs == {e for e in edges if e[0] == "n1" or depth.get(e[0]) == 1}


@pytest.mark.parametrize("seed", [1, 5])
def test_cycles(spark, seed):
    edges = random_edges(seed, 14, 22)
    reach = {a: set(plain(edges, [a])) | ({a} if any(a in plain(edges, [d]) or d == a for s, d, _ in edges if s == a) else set()) for a in {x for e in edges for x in e[:2]}}
    want = {a: min([a, *[b for b in reach[a] if a in reach[b]]]) for a in reach if any(b != a and a in reach[b] for b in reach[a])}
    df = spark.createDataFrame(edges, "src string, dst string, kind string")
    assert {r.id: r.component for r in G.cycles(df).collect()} == want


def test_budget(spark):
    rows = [("a", float(i), f"a{i}") for i in range(5)] + [("b", float(i), f"b{i}") for i in range(5)] + [("c", 0.0, "c0")]
    df = spark.createDataFrame(rows, "group string, ord double, item string")
    assert sorted(r.item for r in G.take_in_groups(df, {"b": 2, "a": 4}, 5).collect()) == ["a0", "a1", "a2", "b0", "b1"]
    assert G.take_in_groups(df, {"b": 0}, 5).count() == 0


def test_no_cartesian_products(spark):
    df = spark.createDataFrame(random_edges(1), "src string, dst string, kind string")
    plan = G.traverse(df, roots_of(spark, ["n1"]), 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cycles_of_whole_keys(spark):
    from codeloom.plans import catalogue

    at = "/root/testdata/sf0.001"
    edges = {(f"n{r[0]}", f"n{r[1]}", "k") for r in spark.read.parquet(f"{at}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()}
    reach = {a: set(plain(edges, [a])) for a in {x for e in edges for x in e[:2]}}
    want = {a: min([a, *[b for b in reach[a] if a in reach[b]]]) for a in reach if any(b != a and a in reach[b] for b in reach[a])}
    assert want and {r.id: r.component for r in catalogue.Q["scc_whole"](spark, at).collect()} == want
