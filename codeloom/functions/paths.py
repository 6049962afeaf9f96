"""Paths, routes, globs and names as Column expressions; patterns are compiled on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Resolves "." and ".." by text alone (C1, C29); a leading ".." stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, p)),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"\.([^.]+)$", 1)


def relative_to(path: Column, root: str) -> Column:
    """The path below root, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), f"^{re.escape(root.rstrip('/'))}/", "")


def normalize_route(route: Column) -> Column:
    """No empty segments; parameters become *, rest parameters **; nothing is /."""
    def segment(s: Column) -> Column:
        return F.when(s.rlike(r"^\{[^}]*\*\}$") | s.rlike(r"^\{.*/.*\}$") | (s == "**"), "**").when(s.rlike(r"^(:.*|\*|\{[^}]*\})$"), "*").otherwise(s)

    parts = F.transform(F.filter(F.split(route, "/(?![^{]*\\})"), lambda s: s != ""), segment)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def join_routes(prefix: Column, path: Column) -> Column:
    """C4."""
    joined = F.regexp_replace(F.concat(prefix, F.lit("/"), path), "//+", "/")
    return F.when(F.length(joined) > 1, F.regexp_replace(joined, "/$", "")).otherwise(joined)


def file_to_route(path: Column) -> Column:
    """[id] is :id, [...x] is *, [[...x]] is **; (groups) and @slots vanish."""
    def segment(s: Column) -> Column:
        return F.when(s.rlike(r"^\[\[\.\.\..*\]\]$"), "**").when(s.rlike(r"^\[\.\.\..*\]$"), "*").when(s.rlike(r"^\[.*\]$"), F.concat(F.lit(":"), F.regexp_extract(s, r"^\[(.*)\]$", 1))).otherwise(s)

    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("@"))
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, segment), "/"))


def rewrite_pattern(pattern: Column) -> Column:
    """Query and fragment go; a final :x* is **, a final :x+ is *."""
    bare = F.regexp_replace(pattern, r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/:[^/]+\*$", "/**"), r"/:[^/]+\+$", "/*")


def url_path(url: Column) -> Column:
    """The path of an absolute URL, or the text itself."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")


def reference_segments(reference: Column) -> Column:
    """C8."""
    return F.filter(F.split(F.regexp_replace(reference, r"[?#].*$", ""), "/"), lambda s: s != "")


def template_pattern(template: Column) -> Column:
    """${x} becomes :param."""
    return F.regexp_replace(template, r"\$\{[^}]*\}", ":param")


def package_name(specifier: Column) -> Column:
    """Null for relative, absolute and # specifiers, builtins and incomplete scopes."""
    name = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^@./#][^/]*)", 1)
    return F.when(specifier.rlike(r"^(\.|/|#|node:)") | (name == ""), F.lit(None)).otherwise(name)


def line_of(text: Column, offset: Column) -> Column:
    """C14: the 1-based line of a character offset."""
    return (F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))).cast("int")


def is_external(url: Column) -> Column:
    """C19."""
    return url.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|//)")


def local_link(url: Column) -> Column:
    """Without fragment and query, percent-decoded."""
    return F.try_url_decode(F.replace(F.regexp_replace(url, r"[?#].*$", ""), F.lit("+"), F.lit("%2B")))


def squeezed(text: Column) -> Column:
    """C20: trimmed, white space runs as one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def query_params(pattern: Column) -> Column:
    """Sorted distinct query keys without :parameters; null if there are none."""
    query = F.regexp_extract(pattern, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda kv: F.substring_index(kv, "=", 1))
    kept = F.array_sort(F.array_distinct(F.filter(keys, lambda k: (k != "") & ~k.startswith(":"))))
    return F.when(F.size(kept) > 0, kept)


def shell_quote(word: Column) -> Column:
    """The word as a POSIX shell reads it back, in single quotes unless it is plain."""
    quoted = F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(word.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), word).otherwise(quoted)


def topic_identity(cluster: Column, topic: Column) -> Column:
    """C23."""
    return F.concat_ws(":", cluster, topic)


def pnpm_name(key: Column) -> Column:
    """The name in /@scope/name@1.2.3(peer)."""
    return F.regexp_extract(key, r"^/?(@?[^@]+)@", 1)


def pnpm_version(key: Column) -> Column:
    return F.regexp_extract(key, r"^/?@?[^@]+@([^(]+)", 1)


def glob_regex(pattern: str, separators: bool = True) -> str:
    """A glob as a Java and Python regular expression (C11, C12): * and ? stay in a segment, ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*" if separators else ".*"
        elif c == "?":
            out += "[^/]" if separators else "."
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x, separators)[1:-1] for x in pattern[i + 1 : end].split(",")) + ")", end
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether any of the globs matches."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def ordered_match(path: Column, globs: list[str]) -> Column:
    """the last matching glob decides; a leading ! unselects; none matching is false."""
    out = F.lit(False)
    for g in globs:
        out = F.when(path.rlike(glob_regex(g.removeprefix("!"))), F.lit(not g.startswith("!"))).otherwise(out)
    return out


def route_matches(reference: Column, pattern: Column) -> Column:
    """Segments of both sides; a :parameter or * stands for one segment, ** for any rest, on either side."""
    a, b = reference_segments(reference), reference_segments(pattern)
    wild = lambda s: s.startswith(":") | (s == "*")
    same = lambda x, y: (x == y) | wild(x) | wild(y)
    rest_at = lambda xs: F.array_position(xs, "**")
    cut = F.when((rest_at(a) > 0) & ((rest_at(b) == 0) | (rest_at(a) <= rest_at(b))), rest_at(a)).otherwise(rest_at(b)) - 1
    head = lambda xs, n: F.slice(xs, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))
    all_same = lambda xs, ys: F.forall(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: F.coalesce(same(p["x"], p["y"]), F.lit(False)))
    exact = (F.size(a) == F.size(b)) & all_same(a, b)
    rest = (F.size(a) >= cut) & (F.size(b) >= cut) & all_same(head(a, cut), head(b, cut))
    return F.when((rest_at(a) > 0) | (rest_at(b) > 0), rest).otherwise(exact)


def route_specificity(pattern: Column) -> Column:
    """Per segment literal 3, :parameter 2, * 1, ** 0, then 4 as the end; arrays compare lexicographically."""
    rank = F.transform(reference_segments(pattern), lambda s: F.when(s == "**", 0).when(s == "*", 1).when(s.startswith(":"), 2).otherwise(3))
    return F.array_append(rank, F.lit(4))
