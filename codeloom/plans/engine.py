"""One object for a repository snapshot: facts and edges are made once and shared by all reports."""

from __future__ import annotations

import math
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions.lineage import cut
from codeloom.operators import graph as G
from codeloom.operators import matching as M
from codeloom.operators import resolve as R
from codeloom.operators import rules
from codeloom.sources import repository as S

TEST = r"(\.(test|spec)\.[^/]+$|(^|/)(tests?|__tests__)/|_test\.(go|py|rb|exs)$|(^|/)test_[^/]*\.py$)"
LOW, MEDIUM = ["http", "process", "route", "selector"], ["dynamic-import"]


class Engine:
    """Reports over files(path, ext, tracked, content, error); config is the parsed configuration."""

    IMPORTS = ["import", "type-import", "dynamic-import", "require", "require-resolve"]
    RUNTIME = ["import", "dynamic-import", "require", "require-resolve", "workspace"]

    def __init__(self, spark: SparkSession, files: DataFrame, config: dict | None = None):
        self.spark, self.config = spark, config or {}
        self.files = files.persist()

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: str = ".codeloom.yml") -> Engine:
        files = S.scan(spark, root)
        return cls(spark, files, S.config(files, config))

    # facts

    @cached_property
    def typescript(self) -> DataFrame:
        return S.typescript_facts(self.files).persist()

    @cached_property
    def languages(self) -> DataFrame:
        return S.language_facts(self.files).persist()

    @cached_property
    def workflows(self) -> DataFrame:
        return S.workflow_facts(self.files, self.config.get("ci", {}).get("workflowDirs", [".github/workflows"])).persist()

    @cached_property
    def sql(self) -> DataFrame:
        return S.sql_facts(self.files).persist()

    @cached_property
    def terraform(self) -> DataFrame:
        return S.terraform_facts(self.files).persist()

    @cached_property
    def markdown(self) -> DataFrame:
        return S.markdown_facts(self.files).persist()

    @cached_property
    def packages(self) -> DataFrame:
        return S.manifests(self.files).persist()

    def _each(self, family: str, keep: str = "file") -> DataFrame:
        return self.typescript.select(F.col("path").alias(keep), F.explode(family).alias("x")).select(keep, "x.*")

    @cached_property
    def imports(self) -> DataFrame:
        return self._each("imports", "importer")

    @cached_property
    def exports(self) -> DataFrame:
        return self._each("exports")

    @cached_property
    def locators(self) -> DataFrame:
        return self._each("locators")

    @cached_property
    def directives(self) -> DataFrame:
        return self._each("directives", "path")

    @cached_property
    def resolved(self) -> DataFrame:
        return R.resolve(self.imports, self.files, self.packages).persist()

    @cached_property
    def links(self) -> DataFrame:
        """Local Markdown links with their target paths."""
        rows = self.markdown.select("path", F.explode("links").alias("l")).select("path", "l.text", F.col("l.target").alias("url"), "l.line").where(~P.is_external(F.col("url")) & ~F.col("url").startswith("#"))
        local = P.local_link(F.col("url"))
        return rows.withColumn("target", P.normalize_path(F.when(local.startswith("/"), F.substring(local, F.lit(2), F.length(local))).otherwise(F.concat_ws("/", P.dirname(F.col("path")), local))))

    @cached_property
    def page_routes(self) -> DataFrame:
        """File, route of pages and Remix routes."""
        app = F.regexp_extract("path", r"(?:^|/)app/((?:.*/)?)page\.[jt]sx?$", 1)
        pages = F.regexp_extract("path", r"(?:^|/)pages/(.*)\.[jt]sx?$", 1)
        remix = F.regexp_extract("path", r"(?:^|/)app/routes/(.*)\.[jt]sx?$", 1)
        is_app = F.col("path").rlike(r"(?:^|/)app/(.*/)?page\.[jt]sx?$")
        dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(remix, r"(^|\.)_index$", ""), r"(^|\.)_[^.]+", ""), r"\.", "/"), r"\$(\w+)", ":$1")
        route = F.when(is_app, P.file_to_route(app)).when(pages != "", P.file_to_route(F.regexp_replace(pages, r"(^|/)index$", ""))).when(remix != "", F.concat(F.lit("/"), F.regexp_replace(dotted, r"\$$", "*")))
        return self.files.where(~F.col("path").rlike(r"/pages/(_app|_document|_error)\.")).select(F.col("path").alias("file"), route.alias("route")).where("route is not null")

    @cached_property
    def server_routes(self) -> DataFrame:
        """File, method, route, line, params; routers that are mounted elsewhere get each mount's prefix."""
        own = self._each("routes").where("method not in ('use', 'route')")
        mounts = self.typescript.select(F.col("path").alias("importer"), F.explode(F.filter("calls", lambda c: c["callee"].endswith(".use") & (F.size(c["args"]) > 1))).alias("c"))
        mounts = mounts.select("importer", F.regexp_extract(F.col("c.args")[0], r"[\"'`]([^\"'`]*)", 1).alias("prefix"), F.regexp_extract(F.col("c.args")[1], r"^([\w$]+)", 1).alias("local"))
        named = self.resolved.where("target is not null").select("importer", "target", F.explode("locals").alias("local"))
        mounts = mounts.where("prefix <> ''").join(named, ["importer", "local"]).select(F.col("target").alias("file"), "importer", "prefix")
        step = mounts.select("file", "prefix", F.col("importer").alias("at"))
        outer = mounts.select(F.col("file").alias("at"), F.col("prefix").alias("_o"), F.col("importer").alias("_at"), F.col("file").alias("_via"))
        step = step.withColumn("seen", F.array("file"))
        done = []
        while True:  # prefixes of routers in routers; a mount that leads back to itself isn't followed
            longer = step.join(outer, "at", "left")
            done.append(longer.where("_o is null").select("file", "prefix"))
            step = cut(longer.where(F.col("_o").isNotNull() & ~F.array_contains("seen", F.col("_via"))).select("file", P.join_routes("_o", F.col("prefix")).alias("prefix"), F.col("_at").alias("at"), F.array_append("seen", F.col("_via")).alias("seen")).distinct())
            if step.isEmpty():
                break
        full = reduce(DataFrame.unionByName, done)
        routed = own.join(full.select("file", "prefix").distinct(), "file", "left")
        params = self.typescript.select(F.col("path").alias("file"), F.col("query_reads").alias("params"))
        return routed.withColumn("route", P.join_routes(F.coalesce("prefix", F.lit("")), F.col("route"))).drop("prefix", "object").join(params, "file")

    @cached_property
    def client_calls(self) -> DataFrame:
        return self._each("http_calls").where("url like '/%'")

    @cached_property
    def queue_producers(self) -> DataFrame:
        mine = self._each("queue_enqueues").select("file", "queue", "job", "line")
        theirs = self.languages.select(F.col("path").alias("file"), F.col("lang").alias("queue"), F.explode("queue_enqueues").alias("job"), F.lit(None).cast("int").alias("line"))
        kafka = self.languages.select(F.col("path").alias("file"), F.lit("kafka").alias("queue"), F.explode("topics_out").alias("job"), F.lit(None).cast("int").alias("line"))
        return mine.unionByName(theirs).unionByName(kafka)

    @cached_property
    def queue_workers(self) -> DataFrame:
        mine = self._each("queue_workers").select("file", "queue", F.explode_outer("jobs").alias("job"), "line")
        theirs = self.languages.select(F.col("path").alias("file"), F.col("lang").alias("queue"), F.explode("queue_workers").alias("job"), F.lit(None).cast("int").alias("line"))
        kafka = self.languages.select(F.col("path").alias("file"), F.lit("kafka").alias("queue"), F.explode("topics_in").alias("job"), F.lit(None).cast("int").alias("line"))
        return mine.unionByName(theirs).unionByName(kafka)

    @cached_property
    def package_edges(self) -> DataFrame:
        names = self.packages.select(F.col("name").alias("dst"))
        return self.packages.where("name is not null").select(F.col("name").alias("src"), F.explode("dependencies").alias("d")).select("src", F.col("d.name").alias("dst"), F.lit("package").alias("kind")).join(names, "dst", "left_semi").distinct()

    # edges

    def _edge(self, rows: DataFrame, src: str, dst: str, kind) -> DataFrame:
        return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind")).where("src is not null and dst is not null and src <> dst")

    def producers(self) -> dict[str, DataFrame]:
        """2.12: the edges of each family, lazily; a relationship filter unions those it needs."""
        code = F.col("ext").isin(S.CODE)
        known = self.files.select(F.col("path").alias("dst"), code.alias("_code"))
        res = self.resolved.where("reachable")
        hit = res.where("target is not null").join(known, F.col("target") == F.col("dst"))
        relative = F.col("specifier").startswith(".")
        calls = self.client_calls.select("file", "url", "method")
        routes = self.server_routes.select(F.col("file").alias("handler"), "route", F.upper("method").alias("_m"))
        http = calls.join(routes, P.route_matches(F.col("url"), F.col("route")) & ((F.col("_m") == F.col("method")) | (F.col("_m") == "ALL")))
        tests = self.files.where(F.col("path").rlike(r"\.(test|spec)\.[^./]+$")).select(F.col("path").alias("test"), F.regexp_replace("path", r"\.(test|spec)\.[^./]+$", "").alias("stem"))
        sources = self.files.where(code & ~F.col("path").rlike(r"\.(test|spec)\.[^./]+$")).select("path", F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"))
        jobs = F.concat(F.lit("queue:"), "queue", F.lit(":"), "job")
        lang = self.languages
        decl = lang.select(F.col("path").alias("dst"), F.col("lang").alias("_l"), F.col("package").alias("_p"), F.explode("declarations").alias("name"))
        refs = lang.select(F.col("path").alias("src"), F.col("lang").alias("_l"), F.col("package").alias("_p"), F.explode("references").alias("name"))
        mods = lang.where("module is not null").select(F.col("path").alias("dst"), "lang", F.col("module").alias("name"))
        packs = lang.where("package is not null").select(F.col("path").alias("dst"), "lang", F.col("package").alias("name"))
        uses = lang.select(F.col("path").alias("src"), "lang", F.explode("imports").alias("name"))
        lang_imports = self._edge(uses.join(mods.unionByName(packs), ["lang", "name"]), "src", "dst", F.concat("lang", F.lit("-import")))
        # a name means the declaration beside it, in its package, or in a file that it imports
        named = refs.withColumnRenamed("_p", "_rp").join(decl, ["_l", "name"]).withColumn("_pkg", F.coalesce(F.col("_rp") == F.col("_p"), F.lit(False)))
        named = named.join(lang_imports.select("src", "dst", F.lit(True).alias("_i")).distinct(), ["src", "dst"], "left").withColumn("_brought", F.coalesce("_i", F.lit(False)))
        same_folder = (P.dirname(F.col("src")) == P.dirname(F.col("dst"))) & F.equal_null("_rp", "_p")
        tf = self.terraform.withColumn("dir", P.dirname(F.col("path")))
        blocks = tf.select("dir", F.col("path").alias("dst"), F.explode("blocks").alias("b")).select("dir", "dst", "b.*")
        tf_refs = tf.select("dir", F.col("path").alias("src"), F.explode("refs").alias("r")).select("dir", "src", "r.*")
        modules = blocks.where("kind = 'module' and source like '.%'").select("dir", "address", P.normalize_path(F.concat_ws("/", "dir", "source")).alias("mdir"))
        outputs = blocks.where("kind = 'output'").select(F.col("dir").alias("mdir"), F.substring_index("address", ".", -1).alias("output"), F.col("dst").alias("odst"))
        components = self._each("components")
        brought = self.resolved.where("target is not null and kind <> 'type-import'").select(F.col("importer").alias("file"), F.explode("locals").alias("child"), F.col("target").alias("dst"))
        rendered = components.select("file", F.explode("children").alias("child")).withColumn("child", F.substring_index("child", ".", 1))
        job = lambda p, j: F.concat(p, F.lit("#job:"), j)
        wf = rules.jobs_of(self)
        nav = self._each("urls").withColumn("url", P.url_path(F.col("url")))
        spawned = self._each("spawns").select("file", F.explode(F.array_append("args", F.col("command"))).alias("arg"))
        trpc = self.typescript.select(F.col("path").alias("file"), F.explode("trpc_calls").alias("call")).withColumn("procedure", F.substring_index("call", ".", -1))
        routers = self.typescript.select(F.col("path").alias("dst"), F.explode("procedures").alias("procedure"))
        out = {
            "import": self._edge(hit.where("_code"), "importer", "target", F.col("kind").alias("kind")),
            "module": self._edge(res.where("target is null and package is not null"), "importer", "package", F.col("kind").alias("kind")),
            "asset": self._edge(hit.where(~F.col("_code") & relative), "importer", "target", "asset"),
            "workspace": self._edge(hit.where(~relative).join(self.packages.where("name is not null").select(F.col("name").alias("_n")).distinct(), P.package_name(F.col("specifier")) == F.col("_n")), "importer", "target", F.when(F.col("kind") == "type-import", "workspace-type-import").otherwise("workspace")),
            "package": self._edge(self.packages.where("name is not null").select(F.explode("dependencies").alias("d"), "path").select("path", F.col("d.name").alias("n")).join(self.packages.select(F.col("name").alias("n"), F.col("path").alias("p")), "n", "left").select("path", F.coalesce("p", "n").alias("t")), "path", "t", "package"),
            "test": self._edge(tests.join(sources, "stem"), "test", "path", "test"),
            "md": self._edge(self.links.join(self.files.select(F.col("path").alias("target")), "target", "left_semi"), "path", "target", "md"),
            "http": self._edge(http, "file", "handler", "http"),
            "route": self._edge(calls.join(self.page_routes.select(F.col("file").alias("page"), F.col("route").alias("r")), P.route_matches(F.col("url"), F.col("r"))), "file", "page", "route"),
            "queue": self._edge(self.queue_producers.withColumn("node", jobs), "file", "node", "queue-enqueue").unionByName(self._edge(self.queue_workers.where("job is not null").withColumn("node", jobs), "node", "file", "queue-worker")),
            "process": self._edge(spawned.join(self.files.select("path"), P.normalize_path(F.col("arg")) == F.col("path")), "file", "path", "process"),
            "resource": self._edge(self._each("resources").join(self.files.select("path"), P.normalize_path(F.col("target")) == F.col("path")), "file", "path", "resource"),
            "react-render": self._edge(rendered.join(brought, ["file", "child"]), "file", "dst", "react-render"),
            "route-test": self._edge(nav.join(self.page_routes.withColumnRenamed("file", "page"), P.route_matches(F.col("url"), F.col("route"))), "file", "page", "route-test"),
            "layout": self._edge(self.page_routes.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/")) - 1), lambda n: F.array_join(F.slice(F.split("file", "/"), F.lit(1), n), "/"))).alias("dir")).join(self.files.where(P.basename(F.col("path")).rlike(r"^layout\.[jt]sx?$")).select("path", P.dirname(F.col("path")).alias("dir")), "dir"), "file", "path", "layout"),
            "selector": self._edge(self.locators.where("kind = 'getByTestId'").join(rules.selectors(self).select(F.col("file").alias("component"), "value"), "value"), "file", "component", "selector"),
            "trpc": self._edge(trpc.join(routers, "procedure").withColumn("node", F.concat("dst", F.lit("#procedure:"), "procedure")), "file", "node", "trpc-call").unionByName(self._edge(routers.withColumn("node", F.concat("dst", F.lit("#procedure:"), "procedure")), "node", "dst", "trpc-procedure")),
            "terraform-ref": self._edge(tf_refs.join(blocks.select("dir", "address", "dst"), ["dir", "address"]), "src", "dst", "terraform-ref"),
            "terraform-output": self._edge(tf_refs.where("output is not null").join(modules, ["dir", "address"]).join(outputs, ["mdir", "output"]), "src", "odst", "terraform-output"),
            "terraform-module": self._edge(tf_refs.where("address like 'module.%' and output is null").join(modules, ["dir", "address"]).join(self.files.where("ext = 'tf'").select(P.dirname(F.col("path")).alias("mdir"), F.col("path").alias("odst")), "mdir"), "src", "odst", "terraform-module"),
            "lang-import": lang_imports,
            "lang-ref": self._edge(named.where(same_folder | (F.col("_pkg") & (F.col("_l") != "go")) | F.col("_brought")), "src", "dst", F.concat("_l", F.lit("-ref"))),
            "rust-mod": self._edge(lang.where("lang = 'rs'").select(F.col("path").alias("src"), P.dirname(F.col("path")).alias("d"), F.explode("mods").alias("m")).select("src", F.explode(F.array(F.concat_ws("/", "d", F.concat("m", F.lit(".rs"))), F.concat_ws("/", "d", "m", F.lit("mod.rs")))).alias("path")).join(self.files.select("path"), "path"), "src", "path", "rust-mod"),
            "workflow-job": self._edge(wf.withColumn("node", job(F.col("path"), F.col("job"))), "path", "node", "workflow-job"),
            "workflow-needs": self._edge(wf.select(job(F.col("path"), F.col("job")).alias("a"), F.explode("needs").alias("n"), "path").withColumn("b", job(F.col("path"), F.col("n"))), "a", "b", "workflow-needs"),
            "workflow-uses": self._edge(wf.where("uses like './%'").select(job(F.col("path"), F.col("job")).alias("a"), P.normalize_path(F.regexp_replace("uses", "@.*", "")).alias("b")), "a", "b", "workflow-uses"),
            "workflow-run": self._edge(rules.steps_of(self).where("run is not null").select(job(F.col("path"), F.col("job")).alias("a"), F.explode(F.regexp_extract_all("run", F.lit(r"((?:[\w.-]+/)*[\w.-]+\.\w+)"))).alias("t")).join(self.files.select("path"), P.normalize_path(F.col("t")) == F.col("path")), "a", "path", "workflow-run"),
            "workflow-artifact": self._edge(self.artifacts.withColumns({"a": job(F.col("path"), F.col("consumer")), "b": job(F.col("path"), F.col("producer"))}), "a", "b", "workflow-artifact"),
        }
        return out

    @cached_property
    def edges(self) -> DataFrame:
        return G.union_edges(list(self.producers().values())).persist()

    @cached_property
    def artifacts(self) -> DataFrame:
        """Path, consumer, producer, name: downloads with the uploads of their name that come before them by needs or step."""
        steps = rules.steps_of(self)
        up = steps.where("artifact_kind = 'upload'").select("path", F.col("job").alias("producer"), F.col("step").alias("_ps"), F.col("artifact").alias("name"))
        down = steps.where("artifact_kind = 'download'").select("path", F.col("job").alias("consumer"), F.col("step").alias("_cs"), F.col("artifact").alias("wanted"))
        needs = rules.jobs_of(self).select("path", "job", F.explode("needs").alias("need")).select(F.concat_ws("#", "path", "job").alias("src"), F.concat_ws("#", "path", "need").alias("dst"))
        before = G.closure(needs).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_ok"))
        fits = (F.col("name") == F.col("wanted")) | F.rlike("name", F.concat(F.lit("^"), F.replace(F.regexp_replace("wanted", r"([.+(){}|^$\\\[\]])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$")))
        both = up.join(down, "path").where(fits).withColumns({"_a": F.concat_ws("#", "path", "consumer"), "_b": F.concat_ws("#", "path", "producer")}).join(before, ["_a", "_b"], "left")
        return both.where("_ok or (producer = consumer and _ps < _cs)").select("path", "consumer", "producer", "name").distinct()

    # traversal reports

    def _roots(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _graph(self, relationships: list[str] | None) -> DataFrame:
        made = self.producers()
        if not relationships or "all" in relationships:
            return self.edges.where("kind not in ('trpc-call', 'trpc-procedure')")
        chosen = [made[k] for k in relationships if k in made]
        return G.union_edges(chosen) if chosen else G.with_kinds(self.edges, relationships)

    def dependencies(self, *entries: str, depth: int | None = None, relationships: list[str] | None = None, filters: list[str] | None = None, target_modules: list[str] | None = None) -> DataFrame:
        """G1; with target_modules (F2) only the packages outside the repository whose names match."""
        if any("#" in e and "#job" not in e and "#procedure" not in e for e in entries):
            raise ValueError("symbols have no dependencies of their own; name the file")
        out = self._filtered(G.traverse(self._graph(relationships), self._roots(*entries), depth), filters)
        if not target_modules:
            return out
        inside = F.col("id").contains("#") | F.col("id").startswith("queue:")
        return out.where(~inside & P.matches_any(F.col("id"), target_modules)).join(self.files.select(F.col("path").alias("id")), "id", "left_anti")

    def dependents(self, *entries: str, depth: int | None = None, relationships: list[str] | None = None, filters: list[str] | None = None) -> DataFrame:
        """G2, and G3 for file#symbol: importers of the symbol first, then their dependents."""
        graph = G.reverse(self._graph(relationships))
        files = [e for e in entries if "#" not in e or "#job" in e or "#procedure" in e]
        out = G.traverse(graph, self._roots(*files), depth) if files else None
        for entry in (e for e in entries if e not in files):
            file, symbol = entry.split("#", 1)
            first = self.importers(file, symbol).select(F.col("importer").alias("id")).distinct().persist()
            rest = G.traverse(graph, first, None if depth is None else depth - 1).withColumn("depth", F.col("depth") + 1)
            found = first.select("id", F.lit(1).alias("depth"), F.array(F.lit("import")).alias("via")).unionByName(rest)
            out = found if out is None else out.unionByName(found)
        return self._filtered(out, filters)

    related = dependents

    def _filtered(self, rows: DataFrame, filters: list[str] | None) -> DataFrame:
        """file globs keep rows, folder globs collapse them; virtual nodes pass."""
        if not filters:
            return rows
        virtual = F.col("id").contains("#") | F.col("id").startswith("queue:")
        files = [f for f in filters if not f.endswith("/")]
        out = rows.where(virtual | P.matches_any(F.col("id"), files))
        for f in (f for f in filters if f.endswith("/")):
            depth = f.rstrip("/").count("/") + 1
            folder = F.array_join(F.slice(F.split("id", "/"), F.lit(1), depth), "/")
            out = out.unionByName(G.collapse(rows.where(~virtual & P.matches_any(folder, [f.rstrip("/")])), F.concat(folder, F.lit("/"))))
        return out

    def flow(self, entry: str, depth: int = 2, direction: str = "both") -> DataFrame:
        out = [G.flow(g, self._roots(entry), depth) for d, g in (("deps", self.edges), ("dependents", G.reverse(self.edges))) if direction in (d, "both")]
        return out[0] if len(out) == 1 else out[0].unionByName(out[1].select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "depth"))

    def effects(self, entry: str, names: dict[str, list[str]], depth: int | None = None) -> DataFrame:
        """File, callee, line, category of configured calls in what the entry reaches."""
        reached = G.visit(G.with_kinds(self.edges, self.RUNTIME), self._roots(entry), depth).select(F.col("id").alias("file"))
        known = self.spark.createDataFrame([(n, c) for c, ns in names.items() for n in ns], "callee string, category string")
        return self._each("calls").select("file", "callee", "line").join(known, "callee").join(reached, "file", "left_semi")

    def rsc_callers(self, component: str, depth: int | None = None) -> DataFrame:
        """G9."""
        client = self.typescript.where("environment = 'client'").select(F.col("path").alias("id"))
        return G.visit(G.reverse(G.with_kinds(self.edges, self.RUNTIME)), self._roots(component), depth, client).where("depth > 0")

    # symbols

    def symbols(self, kinds: list[str] | None = None) -> DataFrame:
        """The exports, of some kinds where they are named."""
        return self.exports.where(F.col("kind").isin(kinds)) if kinds else self.exports

    def import_usages(self) -> DataFrame:
        return self.imports.select(F.col("importer").alias("path"), "specifier", P.package_name(F.col("specifier")).alias("package_name"), "kind", "line", "side_effect_only", "re_export")

    @cached_property
    def symbol_imports(self) -> DataFrame:
        """Source, symbol, importer, local, re_export."""
        pairs = self.resolved.where("target is not null").select("importer", F.col("target").alias("source"), "re_export", F.explode(F.arrays_zip("names", "locals")).alias("n"))
        return pairs.select("source", F.col("n.names").alias("symbol"), "importer", F.col("n.locals").alias("local"), "re_export")

    def importers(self, file: str, symbol: str | None = None) -> DataFrame:
        """Who imports a file or a symbol of it, through re-exports too."""
        rows = self.symbol_imports
        if symbol is None:
            return self.resolved.where(F.col("target") == file).select("importer", "kind", "line").distinct()
        found = rows.where((F.col("source") == file) & F.col("symbol").isin(symbol, "*"))
        out = step = cut(found)
        while True:  # re-exports hand the symbol on, until they bring nothing new
            passed = step.where("re_export").select(F.col("importer").alias("source"), F.when(F.col("local") == "*", F.col("symbol") if symbol == "*" else F.lit(symbol)).otherwise(F.col("local")).alias("symbol")).distinct()
            step = cut(rows.join(passed, ["source", "symbol"]).select(out.columns).join(out, out.columns, "left_anti").distinct())
            if step.isEmpty():
                break
            out = cut(out.unionByName(step))
        return out.select("importer", "symbol", "local", "re_export").distinct()

    def exports_of(self, file: str) -> DataFrame:
        uses = self.symbol_imports.where(F.col("source") == file).groupBy(F.col("symbol").alias("name")).agg(F.array_sort(F.collect_set("importer")).alias("importers"))
        return self.exports.where(F.col("file") == file).join(uses, "name", "left")

    def dead_exports(self) -> DataFrame:
        used = self.symbol_imports.select(F.col("source").alias("file"), F.col("symbol").alias("name")).distinct()
        whole = used.where("name = '*'").select("file")
        return self.exports.join(used, ["file", "name"], "left_anti").join(whole, "file", "left_anti").select("file", "name", "kind", "line")

    def call_sites(self, file: str, symbol: str) -> DataFrame:
        locals_ = self.symbol_imports.where((F.col("source") == file) & (F.col("symbol") == symbol)).select(F.col("importer").alias("file"), F.col("local").alias("callee"))
        return self._each("calls").join(locals_, ["file", "callee"]).select("file", "callee", "line", F.size("args").alias("arg_count"), F.array_contains("shapes", "spread").alias("has_spread"), "shapes")

    def signature_impact(self, file: str, symbol: str) -> DataFrame:
        return self.importers(file, symbol).withColumn("is_test", F.col("importer").rlike(TEST))

    def resolve_check(self) -> DataFrame:
        status = F.when(F.col("target").isNotNull(), "resolved").when(F.col("package").isNotNull() | F.col("specifier").startswith("node:"), "external").otherwise("unresolved")
        return self.resolved.select("importer", "specifier", "line", "target", status.alias("status"))

    # domains

    def fetches(self) -> DataFrame:
        return self._each("http_calls").groupBy("url", "method").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("file")).alias("files"))

    def queue_edges(self) -> DataFrame:
        p, w = self.queue_producers, self.queue_workers.where("job is not null")
        return p.select("queue", "job", F.col("file").alias("producer")).join(w.select("queue", "job", F.col("file").alias("worker")), ["queue", "job"]).distinct()

    def queue_check(self) -> DataFrame:
        wild = self.queue_workers.where("job is null").select("queue")
        return M.unmatched(self.queue_producers, self.queue_workers.where("job is not null"), ["queue", "job"], wild)

    queues = queue_edges

    def queue_related(self, *files: str, depth: int | None = None) -> DataFrame:
        return G.related_edges(self._graph(["queue"]), self._roots(*files), depth)

    def server_route_list(self) -> DataFrame:
        return self.server_routes.select("file", F.upper("method").alias("method"), P.normalize_route(F.col("route")).alias("route"), "line", "params")

    def server_route_edges(self) -> DataFrame:
        return G.dedupe_edges(self.producers()["http"])

    def server_route_related(self, *files: str, depth: int | None = None) -> DataFrame:
        return G.related_edges(self.server_route_edges(), self._roots(*files), depth)

    def server_contracts(self) -> DataFrame:
        """Client calls whose query keys the first matching route doesn't read."""
        routes = self.server_routes.select(F.col("file").alias("server"), F.upper("method").alias("_m"), "route", F.col("line").alias("_l"), "params")
        both = self.client_calls.join(routes, P.route_matches(F.col("url"), F.col("route")) & ((F.upper("method") == F.col("_m")) | (F.col("_m") == "ALL")))
        first = both.withColumn("_n", F.row_number().over(Window.partitionBy("file", "line", "url").orderBy("server", "_l"))).where("_n = 1")
        missing = F.array_except(F.coalesce(P.query_params(F.col("url")), F.array().cast("array<string>")), "params")
        return first.select("file", "line", "url", F.col("route").alias("matched_route"), missing.alias("missing_params")).where(F.size("missing_params") > 0)

    def react_analyze(self) -> DataFrame:
        """Components with their own traits, and state and fetches inherited from what they render."""
        c = self._each("components")
        node = F.concat_ws("#", "file", "name")
        tree = c.select(node.alias("src"), F.explode("children").alias("name")).join(c.select("name", node.alias("dst")), "name").select("src", "dst")
        own = c.select(node.alias("id"), (F.col("fetches") > 0).alias("value"))
        state = G.inherited_or(c.select(node.alias("id"), F.col("state").alias("value")), tree).withColumnRenamed("value", "inherits_state")
        fetch = G.inherited_or(own, tree).withColumnRenamed("value", "inherits_fetch")
        return c.withColumn("id", node).join(state, "id").join(fetch, "id")

    def react_check(self) -> DataFrame:
        return self.react_analyze().where("inherits_fetch").select("file", "name", "line")

    def react_usages(self, name: str) -> DataFrame:
        return self._each("components").where(F.array_contains("children", name)).select("file", F.col("name").alias("parent"), F.col("file").rlike(r"\.stories\.").alias("is_story"), F.col("file").rlike(TEST).alias("is_test"))

    def data_pw(self, value: str) -> DataFrame:
        return rules.selectors(self).where(F.col("value") == value).withColumn("is_test", F.col("file").rlike(TEST))

    def registry_extension(self, file: str) -> DataFrame:
        """The calls of a file by how often their callee registers; the most frequent with two or more."""
        calls = self._each("calls").where(F.col("file") == file).groupBy("callee").agg(F.count("*").alias("n"), F.max("line").alias("last_line")).where("n > 1")
        return calls.orderBy(F.desc("n"), "callee").limit(1)

    def playwright_edges(self) -> DataFrame:
        made = self.producers()
        return made["route-test"].unionByName(made["selector"])

    def playwright_related(self, *files: str) -> DataFrame:
        return self.playwright_edges().where(F.col("dst").isin(list(files)))

    def playwright_tests(self) -> DataFrame:
        return self.locators.groupBy("file").agg(F.count("*").alias("locators"), F.array_sort(F.collect_set("value")).alias("values"))

    def playwright_check(self) -> DataFrame:
        """Kind, total, covered of page routes and exact selectors."""
        edges = self.playwright_edges().select("dst").distinct()
        routes = self.page_routes.join(edges, F.col("file") == F.col("dst"), "left").agg(F.count("*").alias("total"), F.count("dst").alias("covered")).withColumn("kind", F.lit("route"))
        used = self.locators.where("kind = 'getByTestId'").select(F.col("value").alias("_v")).distinct()
        ids = rules.selectors(self).where("exact and attribute <> 'id'").join(used, F.col("value") == F.col("_v"), "left").agg(F.count("*").alias("total"), F.count("_v").alias("covered")).withColumn("kind", F.lit("selector"))
        return routes.unionByName(ids)

    def infra_resource_refs(self, address: str) -> DataFrame:
        return self.terraform.select("path", F.explode("refs").alias("r")).where(F.col("r.address") == address).select("path").distinct()

    def infra_outputs(self) -> DataFrame:
        own = self.terraform.select("path", F.explode("blocks").alias("b")).where("b.kind = 'output'").select(F.col("path").alias("dst"), F.col("b.address").alias("output"))
        return own.join(self.producers()["terraform-output"].select("dst", F.col("src").alias("consumer")), "dst", "left")

    def infra_test_for(self, path: str) -> DataFrame:
        folder = path.rsplit("/", 1)[0] if "/" in path else ""
        return self.files.where(F.col("path").startswith(folder) & F.col("path").rlike(r"(\.tftest\.hcl|_test\.(go|py)|test_[^/]*\.py)$")).select("path")

    def swift_importers(self, target: str) -> DataFrame:
        return self.languages.where((F.col("lang") == "swift") & F.array_contains("imports", target)).select("path")

    def swift_test_targets(self, target: str) -> DataFrame:
        module = F.regexp_extract("path", r"(?:Sources|Tests)/([^/]+)/", 1)
        edges = self.languages.where("lang = 'swift'").select(module.alias("dst"), F.explode("imports").alias("src")).where("dst <> ''").select("src", "dst", F.lit("swift-import").alias("kind")).distinct()
        return G.traverse(edges, self._roots(target)).where("id like '%Tests'")

    # CI

    def ci_topology(self) -> DataFrame:
        made = self.producers()
        return G.union_edges([made[k] for k in made if k.startswith("workflow")])

    def workflow_closure(self, *requested: str) -> DataFrame:
        """Path, depth of the workflows asked for and of the local ones that they call."""
        calls = rules.jobs_of(self).where("uses like './%'").select(F.col("path").alias("src"), P.normalize_path(F.regexp_replace("uses", "@.*", "")).alias("dst")).distinct()
        return G.visit(calls, self._roots(*requested)).select(F.col("id").alias("path"), "depth").join(self.workflows.select("path"), "path", "left_semi")

    def ci_diagnostics(self) -> DataFrame:
        """Code, path, subject of cycles, missing needs, unknown workflow_run names and call contracts."""
        jobs = rules.jobs_of(self)
        needs = jobs.select("path", "job", F.explode("needs").alias("need"))
        missing = needs.join(jobs.select("path", F.col("job").alias("need")), ["path", "need"], "left_anti").select(F.lit("missing-need").alias("code"), "path", F.col("need").alias("subject"))
        loops = G.cycles(needs.select(F.concat_ws("#", "path", "job").alias("src"), F.concat_ws("#", "path", "need").alias("dst"))).select(F.lit("needs-cycle").alias("code"), F.substring_index("id", "#", 1).alias("path"), F.substring_index("id", "#", -1).alias("subject"))
        names = self.workflows.where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
        after = self.workflows.select("path", F.explode("after").alias("name")).join(names, "name", "left")
        runs = after.where("n is null or n > 1").select(F.when(F.col("n").isNull(), "missing-workflow-run").otherwise("ambiguous-workflow-run").alias("code"), "path", F.col("name").alias("subject"))
        called = jobs.where("uses like './%'").select("path", P.normalize_path(F.col("uses")).alias("callee"), "inputs")
        wanted = self.workflows.select(F.col("path").alias("callee"), F.explode("inputs").alias("i")).select("callee", F.col("i.name").alias("name"), F.col("i.required").alias("required"))
        given = called.select("path", "callee", F.explode("inputs").alias("name"), F.lit(True).alias("given"))
        asked = called.select("path", "callee").distinct().join(wanted, "callee")
        both = asked.join(given, ["path", "callee", "name"], "full_outer")
        contracts = both.where("(required and given is null) or required is null").select(F.when(F.col("required").isNull(), "unknown-input").otherwise("missing-input").alias("code"), "path", F.col("name").alias("subject"))
        broken = self.workflows.where("error is not null").select(F.lit("parse-error").alias("code"), "path", F.col("error").alias("subject"))
        return missing.unionByName(loops).unionByName(runs).unionByName(contracts).unionByName(broken).distinct()

    def ci_impact(self, changed: list[str]) -> DataFrame:
        """Path, trigger (matched, always), permissions of the workflows that changed files trigger."""
        files = self.spark.createDataFrame([(c,) for c in changed], "file string")
        rows = self.workflows.where("error is null").select("path", "permissions", "events", F.explode_outer("paths").alias("p")).select("path", "permissions", "events", "p.event", "p.globs")
        compiled = F.udf(_last_match, "boolean")
        hit = rows.where(F.size("globs") > 0).join(files, compiled(F.col("file"), F.col("globs"))).select("path").distinct().withColumn("_hit", F.lit(True))
        always = rows.where(F.arrays_overlap("events", F.array(F.lit("push"), F.lit("pull_request"))) & (F.coalesce(F.size("globs"), F.lit(0)) <= 0)).select("path").distinct().withColumn("_always", F.lit(True))
        out = self.workflows.where("error is null").select("path", "permissions").join(hit, "path", "left").join(always, "path", "left").where("_hit or _always")
        own = F.map_concat(F.coalesce("permissions", F.create_map(F.lit("contents"), F.lit("read"))), F.create_map())
        full = F.map_from_entries(F.array_distinct(F.concat(F.filter(F.map_entries(own), lambda x: x["key"] != "metadata"), F.array(F.struct(F.lit("metadata").alias("key"), F.lit("read").alias("value"))))))
        return out.select("path", F.when(F.col("_hit"), "matched").otherwise("always").alias("trigger"), F.to_json(full).alias("permissions"))

    def ci_env(self, name: str) -> DataFrame:
        rows = rules.each_line(self.files.where(F.col("path").rlike(r"^\.github/")))
        return rows.where(F.col("text").rlike(rf"\b{name}\b")).select("path", "line", F.col("text").rlike(rf"^\s*{name}\s*:").alias("is_definition"))

    def impacted_checks(self, changed: list[str], commands: list[dict]) -> DataFrame:
        """Command, files; commands are rows {globs, command}, equal ones merged."""
        files = self.spark.createDataFrame([(c,) for c in changed], "file string")
        out = [files.where(P.ordered_match(F.col("file"), c["globs"])).select(F.lit(c["command"]).alias("command"), "file") for c in commands]
        rows = out[0] if out else self.spark.createDataFrame([], "command string, file string")
        for more in out[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("command").agg(F.array_sort(F.collect_set("file")).alias("files"))

    # tests

    @cached_property
    def tests(self) -> DataFrame:
        return self.files.where(F.col("path").rlike(TEST)).select(F.col("path").alias("test"))

    def changed_inputs(self, files: list[str] = (), diff: str | None = None, base: str | None = None, root: str = ".") -> DataFrame:
        """Path of all that changed by name, by a unified diff (S10) or since the merge base with a commit (S11), each once."""
        rows = [self.spark.createDataFrame([(f,) for f in files], "path string")]
        if diff:
            rows.append(S.diff_lines(self.spark, diff).select("path"))
        if base:
            rows.append(S.git_changes(self.spark, root, base).select("path"))
        return reduce(DataFrame.unionByName, rows).select(P.normalize_path(F.col("path")).alias("path")).distinct()

    def removed_selectors(self, diff: str) -> DataFrame:
        """Path, value of the test ids that a diff takes from a file and doesn't put back there."""
        named = F.regexp_extract_all("text", F.lit(r"""\bdata-(?:pw|testid|test-id|test)=[{"'`]+([^"'`}]+)"""), 1)
        ids = S.diff_lines(self.spark, diff).where("kind in ('add', 'remove')").select("path", "kind", F.explode(named).alias("value"))
        return ids.where("kind = 'remove'").select("path", "value").distinct().join(ids.where("kind = 'add'"), ["path", "value"], "left_anti")

    def lockfile_seeds(self, before: DataFrame) -> DataFrame:
        """Package, file: importers of the packages whose lockfile entries changed; where there are none, the workspace's own entry."""
        changed = self.lockfile_diff(before).select(F.col("name").alias("package")).distinct()
        uses = self.resolved.where("package is not null").select("package", F.col("importer").alias("file")).distinct()
        entry = F.when(F.col("entry").isNotNull(), P.normalize_path(F.concat_ws("/", "dir", "entry"))).otherwise(F.col("path"))
        own = self.packages.select(F.col("name").alias("package"), entry.alias("file"))
        return changed.join(uses, "package").unionByName(changed.join(uses, "package", "left_anti").join(own, "package")).distinct()

    def tests_plan(self, changed: list[str] | DataFrame, groups: dict[str, dict] | None = None, total: int | None = None) -> DataFrame:
        """Test, confidence, reasons of the tests a change reaches; changed tests select themselves.

        changed: paths, or rows of changed_inputs(). groups: limits {files,
        percent, sample} of direct, coverage and dependencies, in their order
        (a sample is that many tests by the hash of their paths, L6); total
        bounds all.
        """
        starts = (changed.select(F.col("path").alias("id")) if isinstance(changed, DataFrame) else self._roots(*changed)).withColumn("changed_file", F.col("id"))
        paths = G.path_kinds(G.first_parents(G.reverse(self.edges), starts))
        found = paths.join(self.tests, F.col("id") == F.col("test"), "left_semi").select(F.col("id").alias("test"), "changed_file", "kinds")
        own = self.tests.join(starts, F.col("test") == F.col("id"), "left_semi").select("test", F.col("test").alias("changed_file"), F.array(F.lit("self")).alias("kinds"))
        rows = found.unionByName(own)
        rows = rows.withColumn("_c", F.when(F.arrays_overlap("kinds", F.array(*map(F.lit, LOW))), 0).when(F.arrays_overlap("kinds", F.array(*map(F.lit, MEDIUM))), 1).otherwise(2))
        rows = rows.withColumn("_g", F.when(F.size("kinds") <= 1, "direct").when(F.arrays_overlap("kinds", F.array(F.lit("route-test"), F.lit("layout"), F.lit("selector"))), "coverage").otherwise("dependencies"))
        order = F.create_map(F.lit("direct"), F.lit(0), F.lit("coverage"), F.lit(1), F.lit("dependencies"), F.lit(2))
        plan = rows.groupBy("test").agg(F.max("_c").alias("_c"), F.min_by("_g", order[F.col("_g")]).alias("group"), F.array_sort(F.collect_set(F.struct("changed_file", F.col("kinds").alias("via")))).alias("reasons"))
        plan = plan.withColumn("confidence", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("_c") + 1)).drop("_c")
        if groups is None:
            return plan
        limits = {}
        for name, limit in groups.items():
            n = plan.where(F.col("group") == name).count()
            percent = math.ceil(n * limit["percent"] / 100) if "percent" in limit else n
            limits[name] = min(n, percent, limit.get("files", n), limit.get("sample", n))
        sampled = F.col("group").isin([name for name, limit in groups.items() if "sample" in limit])
        rank = F.when(F.col("reasons")[0]["via"][0] == "self", F.lit(0)).when(sampled, M.fnv1a(F.col("test")) + 1).otherwise(F.lit(1))
        ranked = plan.select("group", rank.alias("ord"), F.col("test").alias("item"))
        kept = G.take_in_groups(ranked, limits, sum(limits.values()) if total is None else total)
        return plan.join(kept.select(F.col("item").alias("test")), "test", "left_semi")

    tests_impact = tests_plan

    def tests_why(self, test: str, changed: str) -> DataFrame:
        return self.tests_plan([changed]).where(F.col("test") == test).select(F.explode("reasons").alias("r")).select("r.*")

    def tests_targets(self, tests: DataFrame, command: str = "vitest run") -> DataFrame:
        """A10: command, files by folder of the nearest package."""
        owners = self.packages.select(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))).alias("prefix"), F.col("dir").alias("owner"))
        return M.nearest_ancestor(tests.select(F.col("test").alias("path")), owners).groupBy(F.col("owner").alias("project")).agg(F.array_sort(F.collect_set("path")).alias("files")).withColumn("command", F.concat_ws(" ", F.lit(command), F.array_join(F.transform("files", P.shell_quote), " ")))

    def tests_graph(self, plan: DataFrame) -> DataFrame:
        return plan.select("test", F.explode("reasons").alias("r")).select(F.col("r.changed_file").alias("src"), F.col("test").alias("dst"), F.array_join("r.via", "+").alias("kind"))

    def tests_graph_mermaid(self, plan: DataFrame) -> str:
        return S.mermaid(self.tests_graph(plan))

    def tests_comment(self, plan: DataFrame) -> str:
        rows = plan.orderBy("test").collect()
        return "\n".join(["| Test | Confidence | Changed |", "| --- | --- | --- |", *[f"| `{r['test']}` | {r['confidence']} | {', '.join(sorted({x['changed_file'] for x in r['reasons']}))} |" for r in rows]])

    def lockfile_diff(self, before: DataFrame) -> DataFrame:
        """J29 against another snapshot's files."""
        return M.snapshot_diff(S.lockfile_packages(before).where("name is not null"), S.lockfile_packages(self.files).where("name is not null"), "name", ["version", "fingerprint", "kind"])

    def validate_mermaid_markdown(self) -> DataFrame:
        return self.markdown.select("path", F.explode("mermaid").alias("m")).select("path", "m.*")

    def check(self, names: dict[str, dict] | None = None) -> DataFrame:
        chosen = names if names is not None else {r["rule"]: r.get("options", {}) for r in self.config.get("rules", [])}
        return rules.check(self, chosen)

    def resolve_config(self) -> dict:
        return self.config

    def analyze_project(self, reports: list[str]) -> dict[str, DataFrame]:
        """Several argument-free reports over the shared facts."""
        return {r: getattr(self, r)() for r in reports}


def _last_match(path: str, globs: list[str]) -> bool:
    import re

    out = False
    for g in globs or []:
        if re.match(P.glob_regex(g.removeprefix("!")), path):
            out = not g.startswith("!")
    return out
