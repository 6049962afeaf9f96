"""Import resolution as joins: candidates by priority against the files that exist."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.facts import documents
from codeloom.functions import paths as P
from codeloom.operators.matching import nearest_ancestor

#: Endings probed for a specifier without one of EXPLICIT, in order; then the same as index files.
ENDINGS = [".mts", ".ts", ".tsx", ".mjs", ".js", ".jsx", ".cjs", ".cts", ".d.ts", ".d.mts", ".d.cts"]
#: Endings that name a file as it stands.
EXPLICIT = "mts ts tsx mjs js jsx cjs cts json css scss sass less svg png jpg jpeg gif webp avif txt wasm".split()
#: Sources of an emitted ending, probed before the literal file, and what stands in for it, probed behind it.
EMITTED = {"mjs": ([".mts"], [".d.mts"]), "cjs": ([".cts"], [".d.cts"]), "js": ([".ts", ".tsx"], [".jsx", ".d.ts"])}
ALIASES = "dir string, head string, tail string, exact boolean, target string, ord int"


def tsconfig_aliases(files: DataFrame) -> DataFrame:
    """dir, head, tail, exact, target, ord: path mappings of every tsconfig, extends followed; baseUrl maps everything.

    Configurations are few and small; they are read on the driver.
    """
    rows = files.where(P.basename(F.col("path")).rlike(r"^(ts|js)config.*\.json$")).select("path", "content").collect()
    texts = dict(rows)

    def options(path: str, seen: tuple = ()) -> dict:
        try:
            doc = documents.load(texts[path], path) or {}
        except (KeyError, ValueError):
            return {}
        out: dict = {}
        for base in documents.listed(doc.get("extends")):
            at = posixpath.normpath(posixpath.join(posixpath.dirname(path), base))
            at = at if at in texts else at + ".json"
            if at not in seen:
                out |= options(at, (*seen, path))
        own = doc.get("compilerOptions") or {}
        if "baseUrl" in own or "paths" in own:
            base = posixpath.normpath(posixpath.join(posixpath.dirname(path), own.get("baseUrl", ".")))
            if "baseUrl" in own:
                out["base"] = base
            if "paths" in own:
                out["paths"] = {k: [posixpath.normpath(posixpath.join(base, v)) for v in vs] for k, vs in own["paths"].items()}
        return out

    found = []
    for path in texts:
        if posixpath.basename(path) not in ("tsconfig.json", "jsconfig.json"):
            continue
        here = options(path)
        own = posixpath.dirname(path) + "/" if "/" in path else ""
        targets = [(k, v) for k in sorted(here.get("paths", {}), key=lambda k: -len(k.split("*")[0])) for v in here["paths"][k]]
        if "base" in here:
            targets.append(("*", posixpath.join(here["base"], "*")))
        for i, (k, v) in enumerate(targets):
            head, star, tail = k.partition("*")
            found.append((own, head, tail, not star, v, i))
    return files.sparkSession.createDataFrame(found, ALIASES)


def candidates(base: F.Column) -> F.Column:
    """The paths that an extensionless or emitted base stands for, in the order they are probed."""
    def ended(stem: F.Column, endings: list[str]) -> list[F.Column]:
        return [F.concat(stem, F.lit(e)) for e in endings]

    other = F.array(*ended(base, ENDINGS), *ended(F.concat(base, F.lit("/index")), ENDINGS), base)
    out = F.when(base.rlike(r"\.(" + "|".join(EXPLICIT) + ")$"), F.array(base)).otherwise(other)
    for ending, (before, behind) in EMITTED.items():
        stem = F.regexp_replace(base, rf"\.{ending}$", "")
        out = F.when(base.endswith(f".{ending}"), F.array(*ended(stem, before), base, *ended(stem, behind))).otherwise(out)
    return out


def resolve(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """imports(importer, specifier, ...) with target (a path or null) and package (the external module or null).

    Each (folder, specifier) is resolved once: relative ones by their folder,
    others by the mappings of the nearest tsconfig and by the workspace's
    packages(name, dir, entry, exports). The first candidate that exists wins.
    """
    asked = imports.select(P.dirname(F.col("importer")).alias("_dir"), F.col("specifier").alias("_spec")).distinct()
    spec = F.regexp_replace("_spec", r"(?<!^)[?#].*$", "")
    relative = asked.where(F.col("_spec").rlike(r"^\.{1,2}(/|$)")).select("_dir", "_spec", F.lit(0).alias("_way"), P.normalize_path(F.concat_ws("/", "_dir", spec)).alias("_base"))
    absolute = asked.where(~F.col("_spec").rlike(r"^(\.{1,2}(/|$)|/|[a-z]+:)"))
    aliases = tsconfig_aliases(files)
    owners = aliases.select(F.col("dir").alias("prefix"), F.col("dir").alias("owner")).distinct()
    at = absolute.select("_dir", F.concat("_dir", F.when(F.col("_dir") == "", "").otherwise("/"), F.lit("x")).alias("path")).distinct()
    owned = absolute.join(nearest_ancestor(at, owners).select("_dir", "owner"), "_dir").join(aliases, F.col("owner") == F.col("dir"))
    fits = F.when(F.col("exact"), spec == F.col("head")).otherwise(spec.startswith(F.col("head")) & spec.endswith(F.col("tail")) & (F.length(spec) >= F.length("head") + F.length("tail")))
    middle = F.substr(spec, F.length("head") + 1, F.length(spec) - F.length("head") - F.length("tail"))
    aliased = owned.where(fits).select("_dir", "_spec", (F.col("ord") + 1).alias("_way"), F.replace("target", F.lit("*"), F.when(F.col("exact"), F.lit("")).otherwise(middle)).alias("_base"))
    ways = relative.unionByName(aliased)
    if packages is not None:
        named = absolute.withColumn("_name", P.package_name(F.col("_spec"))).join(packages.select(F.col("name").alias("_name"), F.col("dir").alias("_pdir"), "entry", "exports").where("_name is not null"), "_name")
        sub = F.substr(spec, F.length("_name") + 2)
        into = F.coalesce(F.try_element_at("exports", F.when(sub == "", ".").otherwise(F.concat(F.lit("./"), sub))), F.when(sub == "", F.coalesce("entry", F.lit("src/index"))).otherwise(sub))
        ways = ways.unionByName(named.select("_dir", "_spec", F.lit(1000).alias("_way"), P.normalize_path(F.concat_ws("/", "_pdir", into)).alias("_base")))
    tried = ways.select("_dir", "_spec", "_way", F.posexplode(candidates(F.col("_base"))).alias("_pos", "path"))
    hits = tried.join(files.select("path"), "path").groupBy("_dir", "_spec").agg(F.min_by("path", F.struct("_way", "_pos")).alias("target"))
    out = imports.withColumns({"_dir": P.dirname(F.col("importer"))}).join(hits.withColumnRenamed("_spec", "specifier"), ["_dir", "specifier"], "left").drop("_dir")
    return out.withColumn("package", F.when(F.col("target").isNull(), P.package_name(F.col("specifier"))))


def star_exports(exports: DataFrame) -> DataFrame:
    """File, name, origin of exports(file, name, target, star, type_only), export * followed.

    A file's own exports hide starred ones, default is never passed on, and a
    name that two stars bring from different files is ambiguous and dropped.
    """
    from codeloom.functions.lineage import cut

    own = exports.where("not star").select("file", "name", F.coalesce("target", "file").alias("origin")).distinct()
    stars = exports.where("star and target is not null").select("file", "target").distinct()
    known = cut(own)
    while True:
        passed = stars.join(known.withColumnRenamed("file", "target"), "target").where("name <> 'default'").select("file", "name", "origin").distinct()
        passed = passed.join(own.select("file", "name"), ["file", "name"], "left_anti")
        clear = passed.groupBy("file", "name").agg(F.min("origin").alias("origin"), F.max("origin").alias("_o")).where("origin = _o").drop("_o")
        more = cut(own.unionByName(clear))
        if more.count() == known.count():
            return more
        known = more
