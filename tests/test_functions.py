import random
import re
import shlex

import pytest
from pyspark.sql import functions as F

from codeloom.facts import documents, languages, masking, typescript
from codeloom.functions import paths as P
from codeloom.operators import matching as M


def column(spark, values, f, *more):
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    return [r[0] for r in df.select(f(*[F.col(c) for c in df.columns], *more)).collect()]


def test_paths(spark):
    assert column(spark, ["a/./b/../c", "../x", "/a//b/", "a/../../b", ""], P.normalize_path) == ["a/c", "../x", "/a/b", "../b", ""]
    assert column(spark, ["a/b.ts", "c", "a/.x"], P.extension) == ["ts", "", "x"]
    assert column(spark, ["/users/{id}/x", "//a/:b/", "{x*}", "/f/*"], P.normalize_route) == ["/users/*/x", "/a/*", "/**", "/f/*"]
    assert column(spark, [("/api/", "/x/"), ("", "/")], P.join_routes) == ["/api/x", "/"]
    assert column(spark, ["users/[id]", "(group)/a/@slot", "[...all]", "[[...x]]", ""], P.file_to_route) == ["/users/:id", "/a", "/*", "/**", "/"]
    assert column(spark, ["/a/:x*", "/a/:x+?q=1", "/a/:x"], P.rewrite_pattern) == ["/a/**", "/a/*", "/a/:x"]
    assert column(spark, ["@a/b/c", "lodash/x", "./y", "#z", "@a", "node:fs"], P.package_name) == ["@a/b", "lodash", None, None, None, None]
    assert column(spark, ["/x?b=1&a=2&:c=3&b=4", "/x"], P.query_params) == [["a", "b"], None]
    assert column(spark, ["/@s/n@1.2(3)", "n@1"], P.pnpm_name) == ["@s/n", "n"]
    assert column(spark, ["https://h/a/b?q#f", "/a#b"], P.url_path) == ["/a/b", "/a"]


@pytest.mark.parametrize("a, b, same", [("/users/1", "/users/:id", True), ("/users/1/x", "/users/:id", False), ("/a/b/c", "/a/**", True), ("/a", "/a/**", True), ("/:x/b", "/a/b", True), ("/a/b?q=1", "/a/b/", True), ("/", "/", True), ("/a", "/b", False)])
def test_routes(spark, a, b, same):
    assert column(spark, [(a, b)], P.route_matches) == [same]


def test_specificity_orders_patterns(spark):
    df = spark.createDataFrame([(p,) for p in ("/**", "/:a/:b", "/a/:b", "/a/b")], "p string")
    assert [r.p for r in df.orderBy(P.route_specificity(F.col("p")).desc()).collect()] == ["/a/b", "/a/:b", "/:a/:b", "/**"]


def test_globs(spark):
    for glob, yes, no in (("src/*.ts", "src/a.ts", "src/x/a.ts"), ("**/a.ts", "a.ts", "b.ts"), ("src/**", "src/x/y", "lib/x"), ("*.{ts,js}", "a.js", "a.py"), ("a?c", "abc", "a/c"), ("[!a]b", "cb", "ab")):
        assert re.match(P.glob_regex(glob), yes) and not re.match(P.glob_regex(glob), no)
    assert column(spark, ["src/a.ts", "src/gen/a.ts", "lib/x"], lambda c: P.ordered_match(c, ["src/**", "!src/gen/**"])) == [True, False, False]


def test_masking_keeps_lengths():
    source = "a // c\nb = 'x//y' /* z\n */ + `t${1}` # \"q\n"
    for f in (masking.strip_comments, masking.mask_strings):
        out = f(source)
        assert len(out) == len(source) and out.count("\n") == source.count("\n")
    assert "x//y" in masking.strip_comments(source) and "x//y" not in masking.mask_strings(source)
    assert [masking.classify(*x) for x in ((" \n", "ts"), ("// a\n/* b */", "ts"), ("# a", "py"), ("x = 1 # a", "py"))] == ["empty", "comments-only", "comments-only", "content"]


def test_typescript_imports():
    f = typescript.extract("a.ts", "import d, { a as b, type T } from './x';\nimport 'side';\nimport * as ns from \"y\";\nexport * from './z';\nconst r = require('r'); require.resolve('q');\nfunction unused() { import('./never'); }\nfunction used() { return import('./later'); }\nused();\n// import 'comment'\nconst s = \"import 'string'\";\n")
    found = {i["specifier"]: i for i in f["imports"]}
    assert found["./x"]["names"] == ["a", "T", "default"] and found["./x"]["locals"] == ["b", "T", "d"]
    assert found["side"]["side_effect_only"] and found["y"]["names"] == ["*"] and found["./z"]["re_export"]
    assert found["r"]["kind"] == "require" and found["q"]["kind"] == "require-resolve" and "comment" not in found
    assert not found["./never"]["reachable"] and found["./later"]["reachable"]


def test_languages():
    assert languages.rust_uses("a::{b, c::{d, e}, self}") == ["a::b", "a::c::d", "a::c::e", "a"]
    assert languages.python_absolute("..x", "p/q/r.py") == "p.x" and languages.python_absolute("os", "p/q.py") == "os"
    go = languages.extract("a.go", 'package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\nfunc F() {}\nr.GET("/x", F)\n', "go")
    assert go["package"] == "p" and go["imports"] == ["a/b", "fmt"] and go["declarations"] == ["F"] and go["routes"] == ["/x"]
    java = languages.extract("A.java", 'package a.b;\nimport c.D;\n@GetMapping("/h")\nclass A { D d; }\n', "java")
    assert (java["package"], java["imports"], java["routes"], java["references"]) == ("a.b", ["c.D"], ["/h"], ["D", "GetMapping"])
    kafka = languages.extract("a.py", "p.send('orders')\nc.subscribe(['orders', 'x'])\n", "py")
    assert kafka["topics_out"] == ["orders"] and kafka["topics_in"] == ["orders"]


def test_lockfiles_and_manifests():
    npm = documents.lockfile("package-lock.json", '{"packages": {"": {}, "node_modules/@a/b": {"version": "1", "integrity": "x"}, "node_modules/a/node_modules/c": {"version": "2"}}}')
    assert [(p["name"], p["version"]) for p in npm] == [("@a/b", "1"), ("c", "2")]
    pnpm = documents.lockfile("pnpm-lock.yaml", "packages:\n  '@a/b@1.0.0(c@2)':\n    resolution: {integrity: s}\n  /d@3.0.0:\n    resolution: {}\n")
    assert [(p["name"], p["version"]) for p in pnpm] == [("@a/b", "1.0.0"), ("d", "3.0.0")]
    yarn = documents.lockfile("yarn.lock", '# x\n"@a/b@^1":\n  version "1.1"\n  integrity z\n\nc@2:\n  version "2"\n')
    assert [(p["name"], p["version"], p["fingerprint"]) for p in yarn] == [("@a/b", "1.1", "z"), ("c", "2", None)]
    with pytest.raises(ValueError):
        documents.lockfile("bun.lockb", "")
    assert documents.manifest("package.json", '{"exports": {".": {"import": "./a.js"}, "./x": "./x.js"}}')["exports"] == {".": "./a.js", "./x": "./x.js"}


def test_diff():
    rows = documents.diff("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\ndiff --git a/o b/n\nrename from o\nrename to n\ndiff --git a/g b/g\ndeleted file mode 1\n@@ -1 +0,0 @@\n-z\n")
    assert [(r["path"], r["status"], r["kind"], r["text"], r["line"]) for r in rows] == [("x", "modified", "context", "a", 1), ("x", "modified", "remove", "b", None), ("x", "modified", "add", "c", 2), ("n", "renamed", None, None, None), ("g", "deleted", "remove", "z", None)]


def test_matrix_and_references():
    assert documents.matrix_instances({"a": [1, 2], "b": [1, 2, 3], "exclude": [{"a": 1, "b": 2}], "include": [{"a": 9}, {"a": 1, "c": 1}]}) == 6
    assert documents.matrix_instances("${{ x }}") is None and documents.matrix_instances(None) == 1
    assert documents.references("${{ secrets.A }} ${{ 'needs.x' }} ${{ env['B'] }} inputs.c") == ["env.B", "secrets.A"]


def test_fnv(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "k string")
    assert [r[0] and int(r[0]) for r in df.select(M.fnv1a(F.col("k"))).collect()] == [14695981039346656037, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, None]


def test_shell_words(spark):
    words = ["a/b.ts", "it's", "a b", "", "$x", "-n", "é"]
    assert column(spark, words, P.shell_quote) == [shlex.quote(w) for w in words]


def test_lookup_ignoring_case(spark):
    name = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = {tuple(r) for r in M.lookup_ignoring_case(name("A", "b", "C", "d"), name("A", "a", "B", "c", "Cc", "CC", "D", "D")).collect()}
    assert got == {("A", "A", "exact"), ("b", "B", "ignoring-case"), ("C", "c", "ignoring-case"), ("d", "D", "ignoring-case")}
    assert [tuple(r) for r in M.lookup_ignoring_case(name("x", "cC"), name("Cc", "CC")).orderBy("name").collect()] == [("cC", None, "ambiguous"), ("x", None, "missing")]


def test_matching_against_brute_force(spark):
    rng = random.Random(3)
    old, new = ([(f"k{rng.randrange(8)}", str(rng.randrange(3))) for _ in range(12)] for _ in range(2))
    got = {tuple(r) for r in M.snapshot_diff(spark.createDataFrame(old, "k string, v string"), spark.createDataFrame(new, "k string, v string"), "k", ["v"]).collect()}
    sets = lambda rows: {k: {v for q, v in rows if q == k} for k, _ in rows}
    a, b = sets(old), sets(new)
    assert got == {(k, "added" if k not in a else "removed" if k not in b else "changed") for k in a | b if a.get(k) != b.get(k)}
    rows = [("t", f"i{k}", rng.sample("abcd", rng.randint(1, 3))) for k in range(12)]
    got = {tuple(r) for r in M.strict_prefixes(spark.createDataFrame(rows, "t string, name string, cols array<string>"), ["t"], "cols", "name").collect()}
    want = {n: min(m for _, m, d in rows if len(d) > len(c) and d[: len(c)] == c) for _, n, c in rows if any(len(d) > len(c) and d[: len(c)] == c for _, _, d in rows)}
    assert got == set(want.items())
    owners = spark.createDataFrame([("", "r"), ("a/", "x"), ("a/b/", "y"), ("a/b/", "z")], "prefix string, owner string")
    got = {r.path: r.owner for r in M.nearest_ancestor(spark.createDataFrame([("a/c",), ("a/b/c",), ("q",)], "path string"), owners).collect()}
    assert got == {"a/c": "x", "q": "r"}


def test_strict_prefixes_need_no_broadcast(spark, tmp_path):
    """Arrays made of a small file outgrow the size that the plan expects, and the driver couldn't hold them."""
    keys = range(30000)
    spark.createDataFrame([(k, f"b{k % 7}") for k in keys], "k long, b string").coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").select("k", "b", F.split(F.col("k").cast("string"), "").alias("digits"))
    want: dict = {}
    for k in keys:
        for p in (int(str(k)[:n]) for n in range(1, len(str(k)))):
            if p % 7 == k % 7:
                want[p] = min(k, want.get(p, k))
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "1m")
    try:
        got = {tuple(r) for r in M.strict_prefixes(rows, ["b"], "digits", "k").collect()}
    finally:
        spark.conf.unset(limit)
    assert got == set(want.items())


def test_strict_prefixes_of_equal_rows_and_nulls(spark):
    rows = [("t", "a", ["x"]), ("t", "b", ["x"]), ("t", "d", ["x", "y"]), ("t", "c", ["x", "z"]), (None, "e", ["x"]), (None, "f", ["x", "y"]), ("t", "g", None), ("t", "h", []), ("u", "i", ["x"])]
    got = {tuple(r) for r in M.strict_prefixes(spark.createDataFrame(rows, "t string, name string, cols array<string>"), ["t"], "cols", "name").collect()}
    assert got == {("a", "c"), ("b", "c")}
