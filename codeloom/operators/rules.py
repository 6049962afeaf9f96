"""Repository rules as anti joins and filters: each gives findings(rule, file, line, message, import, target) (section 2.15).

A rule is a function of a snapshot (see plans.engine.Engine) and its options;
RULES has them by name. Options that are missing make a rule find nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.facts.masking import classify, mask_strings
from codeloom.functions import paths as P
from codeloom.operators import graph as G

FINDING = "rule string, file string, line int, message string, import string, target string"
RULES: dict[str, Callable] = {}


def rule(name: str):
    def add(f):
        RULES[name] = f
        return f

    return add


def finding(name: str, rows: DataFrame, file: str = "path", line: Column | None = None, message: Column | str = "", imported: Column | None = None, target: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(name).alias("rule"), F.col(file).alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line"), text.alias("message"), (null if imported is None else imported).alias("import"), (null if target is None else target).alias("target"))


def scoped(e, o: dict, default: list[str] = ("**",)) -> DataFrame:
    """the tracked files that the rule is for."""
    inside = P.matches_any(F.col("path"), list(o.get("include") or o.get("files") or default))
    return e.files.where(F.col("tracked") & inside & ~P.matches_any(F.col("path"), list(o.get("exclude") or [])))


def lines_in(text: str = "content") -> Column:
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n$", "")
    return F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(F.split(body, "\n")))


def each_line(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.posexplode(F.split("content", "\n")).alias("_n", "text")).withColumn("line", F.col("_n") + 1)


def suppress(found: DataFrame, directives: DataFrame) -> DataFrame:
    """findings without those that a directive(path, scope, rule, line) hides."""
    d = directives.select(F.col("path").alias("_p"), F.col("scope").alias("_s"), F.col("rule").alias("_r"), F.col("line").alias("_l"))
    here = (F.col("_s") == "file") | ((F.col("_s") == "line") & (F.col("_l") == F.col("line"))) | ((F.col("_s") == "next-line") & (F.col("_l") + 1 == F.col("line")))
    return found.join(d, (F.col("file") == F.col("_p")) & (F.col("_r").isNull() | (F.col("_r") == F.col("rule"))) & here, "left_anti")


def max_lines(name: str, globs: list[str], most: int):
    @rule(name)
    def check(e, o):
        limit = F.when(P.matches_any(F.col("path"), ["**/*test*", "**/tests/**"]), o.get("testMax", o.get("max", most))).otherwise(o.get("max", most))
        rows = scoped(e, o, globs).withColumn("_n", lines_in()).where(F.col("_n") > limit)
        return finding(name, rows, message=F.concat(F.col("_n").cast("string"), F.lit(" lines exceed the limit")))

    return check


max_lines("csharp-max-lines-per-file", ["**/*.cs"], 500)
max_lines("rust-max-lines-per-file", ["**/*.rs"], 500)


def line_pattern(name: str, globs: list[str], pattern: str, message: str, masked: bool = False):
    @rule(name)
    def check(e, o):
        rows = scoped(e, o, globs)
        if masked:
            mask = F.udf(lambda s, x: mask_strings(s or "", x), "string")
            rows = rows.withColumn("content", mask("content", "ext"))
        return finding(name, each_line(rows).where(F.col("text").rlike(o.get("pattern", pattern))), line=F.col("line"), message=message)

    return check


line_pattern("no-git-identity-mutation", ["**/*.sh", "**/*.yml", "**/*.yaml", "**/*.py", "**/*.ts", "**/*.js", "**/*.mjs", "**/Makefile"], r"git\s+(-\S+\s+)*config\s+(--\S+\s+)*user\.(name|email)\b(?!\s*$)", "git identity is changed")
line_pattern("no-raw-ephemeral-port", ["**/*.py", "**/*.sh", "**/*.yml", "**/*.yaml", "**/*.ts", "**/*.js", "**/*.mjs"], r"\.listen\(\s*0\b|\.bind\(\s*\(\s*[\"'][^\"']*[\"']\s*,\s*0\s*\)", "raw ephemeral port 0")
line_pattern("rust-no-inline-allows", ["**/*.rs"], r"#!?\[\s*(cfg_attr\([^)]*,\s*)?allow\(", "inline allow attribute", True)
line_pattern("github-actions-test-timeout-literals", ["**/*.test.*", "**/*.spec.*", "**/*_test.*"], r"timeout-minutes[\"']?\]?\s*[:=)]?\s*.{0,20}\d", "timeout-minutes literal in a test")
line_pattern("test-no-dependency-pins", ["**/*.test.*", "**/*.spec.*", "**/*_test.*"], r"[\w./-]+@v?\d+\.\d+\.\d+|@[0-9a-f]{40}\b", "dependency version in a test")
line_pattern("test-no-error-message-matching", ["**/*.test.*", "**/*.spec.*"], r"toThrow(Error)?\(\s*[\"'`/]|\.message\)\.to(Be|Equal|Match|Contain)", "error message is matched")
line_pattern("await-array-methods", ["**/*.ts", "**/*.tsx", "**/*.js"], r"\bawait\s+[\w$.]+\.(map|filter|forEach|reduce|some|every|find)\(", "a synchronous array method is awaited", True)
line_pattern("no-delete-property", ["**/*.ts", "**/*.tsx", "**/*.js"], r"(^|[^\w$.])delete\s+[\w$]+[.\[]", "a property is deleted", True)
line_pattern("no-vitest-sequential", ["**/*.test.*", "**/*.spec.*"], r"\b(describe|it|test)\.sequential\b", "sequential tests", True)
line_pattern("playwright-no-set-timeout", ["**/*.spec.*", "**/*.test.*"], r"\bwaitForTimeout\(|\bsetTimeout\(", "a fixed sleep in a test", True)
line_pattern("playwright-no-empty", ["**/*.tsx", "**/*.jsx"], r"data-(testid|test-id|test|pw)=[\"']\s*[\"']", "an empty test id")
line_pattern("playwright-prefer-get-by-test-id", ["**/*.spec.*", "**/*.test.*"], r"locator\(\s*[\"'`]\[data-(testid|test-id|test|pw)=", "a CSS selector for a test id")
line_pattern("nextjs-no-manual-script-tags", ["**/*.tsx", "**/*.jsx"], r"<script[\s>]", "a script tag rather than next/script")
line_pattern("nextjs-static-fetch-url", ["**/*.ts", "**/*.tsx"], r"\bfetch\(\s*(?![\"'`\s)])", "the URL isn't static")
line_pattern("no-placeholder-never-type-exports", ["**/*.ts", "**/*.tsx"], r"\bexport\s+type\s+\w+\s*=\s*never\b", "a placeholder type", True)
line_pattern("react-no-iife-in-jsx", ["**/*.tsx", "**/*.jsx"], r"\{\s*\(\s*(async\s*)?(\([^)]*\)\s*=>|function\b).*\)\s*\(\s*\)\s*\}", "a function called in place in JSX", True)
line_pattern("react-no-use-promise-resolve", ["**/*.tsx", "**/*.ts"], r"\buse\(\s*Promise\.resolve\(", "use(Promise.resolve())", True)
line_pattern("ts-no-export-renaming", ["**/*.ts", "**/*.tsx"], r"\bexport\s*\{[^}]*\b\w+\s+as\s+(?!default\b)\w+", "an export is renamed", True)
line_pattern("postgres-no-manual-transaction", ["**/*.ts", "**/*.js"], r"\.(query|execute|unsafe)\(\s*[\"'`]\s*(BEGIN|COMMIT|ROLLBACK)\b", "a manual transaction")


@rule("agents-md-max-size")
def agents_md_max_size(e, o):
    rows = scoped(e, o, ["**/AGENTS.md", "**/CLAUDE.md", "AGENTS.md", "CLAUDE.md"]).withColumns({"_n": lines_in(), "_c": F.length("content")})
    return finding("agents-md-max-size", rows.where((F.col("_n") > o.get("maxLines", 200)) | (F.col("_c") > o.get("maxChars", 40000))), message=F.concat_ws(" ", F.col("_n").cast("string"), F.lit("lines,"), F.col("_c").cast("string"), F.lit("characters")))


@rule("banned-paths")
def banned_paths(e, o):
    return finding("banned-paths", e.files.where(F.col("tracked") & P.matches_any(F.col("path"), o.get("paths", []))), message="the path is banned")


@rule("banned-renamed-files")
def banned_renamed_files(e, o):
    names = e.spark.createDataFrame(list(o.get("renames", {}).items()), "_name string, _new string")
    rows = scoped(e, o).withColumn("_name", P.basename(F.col("path"))).join(names, "_name")
    return finding("banned-renamed-files", rows, message=F.concat(F.lit("use "), "_new"))


@rule("doc-consistency")
def doc_consistency(e, o):
    out = []
    for path, want in o.get("documents", {}).items():
        row = e.spark.createDataFrame([(path,)], "path string").join(e.files.select("path", "content"), "path", "left")
        out.append(finding("doc-consistency", row.where("content is null"), message="the document is missing"))
        for text in want.get("required", []):
            out.append(finding("doc-consistency", row.where(F.col("content").isNotNull() & ~F.col("content").contains(text)), message=f"missing: {text}"))
        for text in want.get("banned", []):
            out.append(finding("doc-consistency", row.where(F.col("content").contains(text)), message=f"banned: {text}"))
    return union(e, out)


def union(e, found: list[DataFrame]) -> DataFrame:
    out = e.spark.createDataFrame([], FINDING)
    for f in found:
        out = out.unionByName(f)
    return out


@rule("file-extension-policy")
def file_extension_policy(e, o):
    ext = F.lower("ext")
    bad = ext.isin(o.get("banned", [])) if o.get("banned") else F.lit(False)
    bad = bad | (~ext.isin(o["allowed"]) if o.get("allowed") else F.lit(False))
    return finding("file-extension-policy", scoped(e, o).where(bad), message=F.concat(F.lit("extension ."), "ext"))


@rule("finite-set-consistency")
def finite_set_consistency(e, o):
    def values(spec):
        rows = e.files.where(P.matches_any(F.col("path"), spec["files"]))
        return rows.select(F.explode(F.regexp_extract_all("content", F.lit(spec["pattern"]))).alias("value")).distinct()

    if not o.get("left"):
        return union(e, [])
    left, right = values(o["left"]), values(o["right"])
    out = [left.join(right, "value", "left_anti").withColumn("m", F.lit("missing on the right"))]
    if o.get("mode", "equal-set") == "equal-set":
        out.append(right.join(left, "value", "left_anti").withColumn("m", F.lit("missing on the left")))
    return union(e, [finding("finite-set-consistency", x.withColumn("path", F.lit(o["left"]["files"][0])), message=F.concat_ws(": ", "m", "value"), target=F.col("value")) for x in out])


@rule("forbidden-dependencies")
def forbidden_dependencies(e, o):
    roots = e.files.where(P.matches_any(F.col("path"), o.get("roots", []))).select(F.col("path").alias("id"))
    hit = G.traverse(e.edges, roots, kinds=e.RUNTIME).where(P.matches_any(F.col("id"), o.get("forbidden", [])))
    return finding("forbidden-dependencies", hit, file="id", message="a forbidden dependency is reached", target=F.col("id"))


@rule("forbidden-workspace-closure")
def forbidden_workspace_closure(e, o):
    reached = [G.visit(e.package_edges, e.spark.createDataFrame([(p,)], "id string")).where("depth > 0").select(F.lit(p).alias("a"), F.col("id").alias("b")) for p in o.get("packages", [])]
    if not reached:
        return union(e, [])
    hit = reduce(DataFrame.unionByName, reached).where(F.col("b").isin(o.get("forbidden", [])))
    return finding("forbidden-workspace-closure", hit.join(e.packages.select(F.col("name").alias("a"), "path"), "a"), message=F.concat_ws(" reaches ", "a", "b"), target=F.col("b"))


def jobs_of(e) -> DataFrame:
    return e.workflows.where("error is null").select("path", F.explode("jobs").alias("j")).select("path", "j.*")


def steps_of(e) -> DataFrame:
    return jobs_of(e).select("path", "job", F.explode("steps").alias("s")).select("path", "job", "s.*")


@rule("github-actions-job-timeouts")
def github_actions_job_timeouts(e, o):
    bad = jobs_of(e).where(F.col("uses").isNull() & (F.col("timeout").isNull() | (F.col("timeout") > o.get("maxMinutes", 1 << 30))))
    return finding("github-actions-job-timeouts", bad, message=F.concat(F.lit("job "), "job", F.when(F.col("timeout").isNull(), " has no timeout-minutes").otherwise(" has too long a timeout")), target=F.col("job"))


@rule("github-actions-action-timeout-pair")
def github_actions_action_timeout_pair(e, o):
    paired = o.get("actions", [])
    return finding("github-actions-action-timeout-pair", steps_of(e).where(P.matches_any(F.regexp_replace("uses", "@.*", ""), paired) & F.col("timeout").isNull()), message=F.concat(F.lit("no timeout-minutes for "), "uses"), target=F.col("job"))


@rule("github-actions-composite-step-schema")
def github_actions_composite_step_schema(e, o):
    def keys(path, text):
        from codeloom.facts.documents import load

        steps = ((load(text, path) or {}).get("runs") or {}).get("steps") or []
        return {"bad": sorted({k for s in steps for k in s if k not in ("name", "id", "if", "run", "shell", "uses", "with", "env", "working-directory", "continue-on-error")})}

    from codeloom.sources.repository import facts

    rows = facts(e.files.where(P.basename(F.col("path")).isin("action.yml", "action.yaml")), keys, "bad array<string>").select("path", F.explode("bad").alias("key"))
    return finding("github-actions-composite-step-schema", rows, message=F.concat(F.lit("no such step key: "), "key"))


@rule("github-actions-pinned-hash")
def github_actions_pinned_hash(e, o):
    rows = each_line(e.files.where(F.col("path").rlike(r"^\.github/(workflows|actions)/.*\.ya?ml$"))).withColumn("_u", F.regexp_extract("text", r"^\s*-?\s*uses:\s*[\"']?([^\s\"'#]+)", 1))
    bad = rows.where((F.col("_u") != "") & ~F.col("_u").rlike(r"^(\./|docker://)") & ~F.col("text").rlike(r"@[0-9a-f]{40}[\"']?\s+#\s*\S"))
    return finding("github-actions-pinned-hash", bad, line=F.col("line"), message=F.concat(F.lit("not pinned to a commit with its version: "), "_u"))


@rule("lockfile-allowlist")
def lockfile_allowlist(e, o):
    known = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "npm-shrinkwrap.json"]
    return finding("lockfile-allowlist", scoped(e, o).where(P.basename(F.col("path")).isin(known) & ~F.col("path").isin(o.get("allow", []))), message="the lockfile isn't allowed")


@rule("integration-test-no-mocks")
def integration_test_no_mocks(e, o):
    rows = each_line(scoped(e, o, ["**/*.integration.*", "**/integration/**"])).where(F.col("text").rlike(r"\b(vi|jest)\.(mock|fn|spyOn|stubGlobal)\(|from\s+[\"'](nock|msw|sinon)"))
    return finding("integration-test-no-mocks", rows, line=F.col("line"), message="a mock in an integration test")


@rule("markdown-child-links")
def markdown_child_links(e, o):
    out = []
    for parent, children in o.get("parents", {}).items():
        linked = e.links.where(F.col("path") == parent).select(F.col("target").alias("path"))
        out.append(finding("markdown-child-links", e.files.where(P.matches_any(F.col("path"), [children]) & (F.col("path") != parent)).join(linked, "path", "left_anti").select(F.lit(parent).alias("parent"), "path"), file="parent", message=F.concat(F.lit("no link to "), "path"), target=F.col("path")))
    return union(e, out)


@rule("markdown-eval-tests")
def markdown_eval_tests(e, o):
    c = F.col("content")
    return finding("markdown-eval-tests", scoped(e, o, ["**/*.test.*", "**/*.spec.*"]).where(c.rlike(r"\.md[\"'`]") & c.rlike(r"\beval\b") & c.rlike(r"\b(bash|sh|zsh)\b") & c.rlike(r"spawn|exec")), message="a test evaluates Markdown in a shell")


@rule("markdown-link-display-text")
def markdown_link_display_text(e, o):
    rows = e.links.where((F.col("target") != "") & F.col("text").rlike(r"^`?[\w./-]+\.\w+`?$") & (P.basename(F.regexp_replace("text", "`", "")) != P.basename(F.col("target"))))
    return finding("markdown-link-display-text", rows, line=F.col("line"), message="the text isn't the linked file's name", target=F.col("target"))


@rule("markdown-mermaid-validation")
def markdown_mermaid_validation(e, o):
    rows = e.markdown.select("path", F.explode("mermaid").alias("m")).where("m.error is not null")
    return finding("markdown-mermaid-validation", rows, line=F.col("m.line"), message=F.col("m.error"))


@rule("markdown-reachability")
def markdown_reachability(e, o):
    roots = e.files.where(P.matches_any(F.col("path"), o.get("roots", ["CLAUDE.md", "AGENTS.md"]))).select(F.col("path").alias("id"))
    seen = G.visit(e.links.select(F.col("path").alias("src"), F.col("target").alias("dst")), roots, o.get("maxDepth", 2)).select(F.col("id").alias("path"))
    return finding("markdown-reachability", e.files.where(P.matches_any(F.col("path"), o.get("targets", []))).join(seen, "path", "left_anti"), message="not reachable from an instruction file")


@rule("markdown-structure-budget")
def markdown_structure_budget(e, o):
    rows = e.markdown.join(e.files.select("path", "content"), "path").where((lines_in() > o.get("maxLines", 180)) | (F.length("content") > o.get("maxChars", 12000)))
    return finding("markdown-structure-budget", rows.where((F.col("tables") > o.get("maxTables", 1)) | (F.col("fences") > o.get("maxFences", 1))), message="too many tables or fences for a large file")


@rule("nextjs-no-api-routes")
def nextjs_no_api_routes(e, o):
    return finding("nextjs-no-api-routes", e.files.where(F.col("path").rlike(r"(^|/)(pages/api/.*|app/(.*/)?route)\.[jt]sx?$")), message="an API route")


@rule("nextjs-no-caching")
def nextjs_no_caching(e, o):
    rows = each_line(scoped(e, o, ["**/*.ts", "**/*.tsx"])).where(F.col("text").rlike(r"[\"']use cache|\bunstable_cache\(|\brevalidate(Tag|Path)\(|export\s+const\s+revalidate\b|cache:\s*[\"']force-cache|next:\s*\{\s*(revalidate|tags)"))
    return finding("nextjs-no-caching", rows, line=F.col("line"), message="a caching feature")


@rule("no-empty-or-comments-only-files")
def no_empty_or_comments_only_files(e, o):
    kind = F.udf(lambda s, x: classify(s or "", x), "string")
    rows = scoped(e, o, ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.py", "**/*.rs", "**/*.go"]).withColumn("_k", kind("content", "ext"))
    return finding("no-empty-or-comments-only-files", rows.where("_k <> 'content'"), message=F.col("_k"))


@rule("package-json-registry-only")
def package_json_registry_only(e, o):
    rows = e.packages.select("path", F.explode("dependencies").alias("d")).where(F.col("d.spec").rlike(r"^(git(\+\w+)?|https?|file|link|github):|^[\w-]+/[\w-]+$") & ~F.col("d.name").isin(o.get("allow", [])))
    return finding("package-json-registry-only", rows, message=F.concat_ws("@", "d.name", "d.spec"), target=F.col("d.name"))


@rule("package-json-workspace-coverage")
def package_json_workspace_coverage(e, o):
    globs = [g.rstrip("/") for r in e.packages.select("workspaces").collect() for g in r[0] or []]
    return finding("package-json-workspace-coverage", e.packages.where((F.col("dir") != "") & P.matches_any(F.col("dir"), o.get("roots", ["**"])) & ~P.matches_any(F.col("dir"), globs)), message="no workspace holds the package")


@rule("postgres-constraint-validate")
def postgres_constraint_validate(e, o):
    c = e.sql.select("path", F.explode("constraints").alias("c")).select("path", "c.*")
    loose, valid = c.where("not_valid"), c.where("validates")
    return finding("postgres-constraint-validate", loose.join(valid.select("table", "name"), ["table", "name"], "left_anti"), line=F.col("line"), message=F.concat(F.lit("never validated: "), "name")).unionByName(
        finding("postgres-constraint-validate", valid.join(c.where("not validates").select("table", "name"), ["table", "name"], "left_anti"), line=F.col("line"), message=F.concat(F.lit("no such constraint: "), "name"))
    )


@rule("postgres-fk-index")
def postgres_fk_index(e, o):
    keys = e.sql.select("path", F.explode("foreign_keys").alias("k")).select("path", "k.table", F.element_at("k.columns", 1).alias("col"), "k.line")
    usable = e.sql.select(F.explode("indexes").alias("i")).select("i.*").where("method in ('btree', 'hash')").withColumn("col", F.element_at("columns", 1)).where("predicate is null or predicate = concat(col, ' is not null')")
    bare = lambda c: P.basename(F.replace(F.col(c), F.lit("."), F.lit("/")))
    keys = keys.withColumn("_b", bare("table")).where(~F.concat_ws(".", "table", "col").isin(o.get("allow", [])))
    return finding("postgres-fk-index", keys.join(usable.select(bare("table").alias("_b"), "col"), ["_b", "col"], "left_anti"), line=F.col("line"), message=F.concat(F.lit("no index begins with "), F.concat_ws(".", "table", "col")))


@rule("postgres-lock-ordering")
def postgres_lock_ordering(e, o):
    rows = e.sql.select("path", F.explode("locks").alias("l")).where("l.many and not l.ordered and not l.skips")
    return finding("postgres-lock-ordering", rows, line=F.col("l.line"), message="rows are locked in no fixed order")


@rule("postgres-no-generated-column-writes")
def postgres_no_generated_column_writes(e, o):
    made = e.sql.select(F.explode("tables").alias("t")).select(F.col("t.name").alias("table"), F.explode("t.columns").alias("c")).where("c.generated").select("table", F.col("c.name").alias("col"))
    writes = e.sql.select("path", F.explode("writes").alias("w")).select("path", "w.table", F.explode("w.columns").alias("col"), "w.line")
    return finding("postgres-no-generated-column-writes", writes.join(made, ["table", "col"], "left_semi"), line=F.col("line"), message=F.concat(F.lit("a generated column is written: "), "col"))


@rule("postgres-redundant-index")
def postgres_redundant_index(e, o):
    from codeloom.operators.matching import strict_prefixes

    rows = e.sql.select("path", F.explode("indexes").alias("i")).select("path", "i.*").where("method = 'btree'").withColumn("_p", F.coalesce("predicate", F.lit("")))
    named = rows.withColumn("name", F.coalesce("name", F.concat_ws("_", F.lit("key of"), "table", F.array_join("columns", "_"))))
    covered = strict_prefixes(named, ["table", "_p"], "columns", "name")
    return finding("postgres-redundant-index", rows.where("not unique and name is not null").join(covered, "name"), line=F.col("line"), message=F.concat(F.col("name"), F.lit(" is a prefix of "), "covered_by"), target=F.col("covered_by"))


@rule("production-dependency-declarations")
def production_dependency_declarations(e, o):
    used = e.resolved.where("package is not null and kind <> 'type-import'").where(~P.matches_any(F.col("importer"), ["**/*.test.*", "**/*.spec.*", "**/tests/**", "**/__tests__/**"]))
    from codeloom.operators.matching import nearest_ancestor

    owners = e.packages.select(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))).alias("prefix"), F.col("dir").alias("owner"))
    owned = nearest_ancestor(used.withColumnRenamed("importer", "path"), owners)
    told = e.packages.select(F.col("dir").alias("owner"), F.explode("dependencies").alias("d")).select("owner", F.col("d.name").alias("package"), F.col("d.field").alias("field"))
    prod = told.where("field <> 'devDependencies'")
    missing = owned.join(prod, ["owner", "package"], "left_anti").join(told.where("field = 'devDependencies'").select("owner", "package", F.lit(True).alias("_dev")), ["owner", "package"], "left")
    return finding("production-dependency-declarations", missing, line=F.col("line"), message=F.when(F.col("_dev"), "dev-only").otherwise("undeclared"), imported=F.col("specifier"), target=F.col("package"))


@rule("require-files-in-subdirs")
def require_files_in_subdirs(e, o):
    dirs = e.files.select(P.dirname(F.col("path")).alias("dir")).distinct().where(P.matches_any(F.col("dir"), o.get("directories", [])))
    need = dirs.withColumn("name", F.explode(F.array(*[F.lit(n) for n in o.get("required", ["README.md"])]))).withColumn("path", F.concat_ws("/", "dir", "name"))
    return finding("require-files-in-subdirs", need.join(e.files.select("path"), "path", "left_anti"), file="dir", message=F.concat(F.lit("missing "), "name"))


@rule("require-storybook-stories")
def require_storybook_stories(e, o):
    shown = e.resolved.where(F.col("importer").rlike(r"\.stories\.[jt]sx?$") & F.col("target").isNotNull()).select(F.col("target").alias("path")).distinct()
    parts = e.typescript.where(F.size("components") > 0).where(P.matches_any(F.col("path"), o.get("include", ["**/components/**"])) & ~F.col("path").rlike(r"\.(stories|test|spec)\."))
    return finding("require-storybook-stories", parts.join(shown, "path", "left_anti"), message="no story imports the component")


@rule("require-test-per-subdir")
def require_test_per_subdir(e, o):
    out = []
    for root in o.get("roots", []):
        below = e.files.where(F.col("path").startswith(root.rstrip("/") + "/")).withColumn("dir", F.regexp_extract("path", f"^({re.escape(root.rstrip('/'))}/[^/]+)/", 1)).where("dir <> ''")
        tested = P.matches_any(P.basename(F.col("path")), o.get("tests", ["*.test.*", "*.spec.*", "*_test.*", "test_*"]))
        out.append(finding("require-test-per-subdir", below.groupBy("dir").agg(F.count_if(tested).alias("n")).where("n = 0"), file="dir", message="no test in the folder"))
    return union(e, out)


@rule("required-companion-imports")
def required_companion_imports(e, o):
    suffix = o.get("companion", ".test.ts")
    want = scoped(e, o, []).select("path", F.concat(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit(suffix)).alias("companion"))
    have = e.resolved.select(F.col("importer").alias("companion"), F.col("target").alias("path"))
    return finding("required-companion-imports", want.join(have, ["companion", "path"], "left_anti"), message=F.concat(F.lit("no import from "), "companion"), target=F.col("companion"))


@rule("required-doc-section")
def required_doc_section(e, o):
    have = e.markdown.select("path", F.explode("headings").alias("h")).where(F.lower("h.title") == o.get("heading", "").lower()).select("path")
    return finding("required-doc-section", scoped(e, o, []).join(have, "path", "left_anti"), message=f"no heading {o.get('heading', '')}")


@rule("required-entrypoint-reachability")
def required_entrypoint_reachability(e, o):
    roots = e.files.where(P.matches_any(F.col("path"), o.get("entrypoints", []))).select(F.col("path").alias("id"))
    seen = G.visit(G.with_kinds(e.edges, e.RUNTIME), roots).select(F.col("id").alias("path"))
    return finding("required-entrypoint-reachability", e.files.where(P.matches_any(F.col("path"), o.get("sourceGlobs", []))).join(seen, "path", "left_anti"), message="no entrypoint reaches the file")


@rule("required-local-docs")
def required_local_docs(e, o):
    dirs = scoped(e, o, []).select(P.dirname(F.col("path")).alias("dir")).distinct()
    docs = e.files.where(F.lower(P.basename(F.col("path"))).isin([n.lower() for n in o.get("names", ["README.md"])])).select(P.dirname(F.col("path")).alias("dir"))
    return finding("required-local-docs", dirs.join(docs, "dir", "left_anti"), file="dir", message="no documentation beside the code")


@rule("rust-no-inline-tests")
def rust_no_inline_tests(e, o):
    return finding("rust-no-inline-tests", scoped(e, o, ["**/*.rs"]).where(F.col("content").rlike(r"#\[cfg\(test\)\]\s*(pub\s+)?mod\s+\w+\s*\{")), message="tests within the source")


@rule("server-route-client-boundary")
def server_route_client_boundary(e, o):
    rows = e.typescript.where(P.matches_any(F.col("path"), o.get("include", ["**/routes/**"])) & ((F.col("environment") == "client") | (F.size("http_calls") > 0)) & (F.size("routes") == 0))
    return finding("server-route-client-boundary", rows, message="client code in a folder of server routes")


@rule("shellcheck-runner")
def shellcheck_runner(e, o):
    """Runs the shellcheck program on the executors, where it is installed; elsewhere it finds nothing."""
    from codeloom.sources.repository import facts

    def run(path, text):
        import json
        import shutil
        import subprocess

        if not shutil.which("shellcheck"):
            return {"found": []}
        out = subprocess.run(["shellcheck", "-f", "json", "-"], input=text, capture_output=True, text=True)
        return {"found": [dict(line=x["line"], message=f"SC{x['code']}: {x['message']}") for x in json.loads(out.stdout or "[]")]}

    rows = facts(scoped(e, o, ["**/*.sh", "**/*.bash"]), run, "found array<struct<line:int,message:string>>").select("path", F.explode("found").alias("x"))
    return finding("shellcheck-runner", rows, line=F.col("x.line"), message=F.col("x.message"))


@rule("strict-package-layout")
def strict_package_layout(e, o):
    out = [finding("strict-package-layout", e.files.where(F.col("path").startswith(r.rstrip("/") + "/") & ~P.matches_any(F.regexp_replace("path", f"^{re.escape(r.rstrip('/'))}/[^/]+/", ""), o.get("allowed", ["**"]))), message="the file is outside the layout") for r in o.get("roots", [])]
    return union(e, out)


@rule("structured-config-policy")
def structured_config_policy(e, o):
    from codeloom.facts.documents import load
    from codeloom.sources.repository import facts

    def keys(path, text):
        def walk(prefix, value):
            if isinstance(value, dict):
                for k, v in value.items():
                    yield from walk(f"{prefix}.{k}" if prefix else str(k), v)
            else:
                yield prefix, str(value)
            if prefix and isinstance(value, dict):
                yield prefix, ""

        return {"found": dict(walk("", load(text, path)))}

    rows = facts(scoped(e, o, []), keys, "found map<string,string>").where("error is null")
    has = lambda k: F.map_contains_key("found", F.lit(k))
    out = [finding("structured-config-policy", rows.where(~has(k)), message=f"missing {k}") for k in o.get("required", [])]
    out += [finding("structured-config-policy", rows.where(has(k)), message=f"banned {k}") for k in o.get("banned", [])]
    out += [finding("structured-config-policy", rows.where(has(k) & (F.try_element_at("found", F.lit(k)) != str(v))), message=f"{k} isn't {v}") for k, v in o.get("values", {}).items()]
    return union(e, out)


@rule("config-path-references")
def config_path_references(e, o):
    rows = scoped(e, o, []).select("path", F.explode(F.regexp_extract_all("content", F.lit(o.get("pattern", r"[\"'](\.{0,2}/?[\w.-]+(?:/[\w.-]+)+\.\w+)[\"']")))).alias("ref"))
    rows = rows.withColumn("_t", P.normalize_path(F.when(F.col("ref").startswith("."), F.concat_ws("/", P.dirname(F.col("path")), "ref")).otherwise(F.col("ref"))))
    return finding("config-path-references", rows.join(e.files.select(F.col("path").alias("_t")), "_t", "left_anti"), message=F.concat(F.lit("no such file: "), "ref"), target=F.col("_t"))


@rule("test-email-domain-policy")
def test_email_domain_policy(e, o):
    rows = each_line(scoped(e, o, ["**/*.test.*", "**/*.spec.*", "**/*.md", "**/fixtures/**"])).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"[\w.+-]+@([\w-]+(?:\.[\w-]+)+)"))).alias("domain"))
    bad = F.lower("domain").isin([d.lower() for d in o.get("banned", [])])
    return finding("test-email-domain-policy", rows.where(bad), line=F.col("line"), message=F.concat(F.lit("banned domain "), "domain"))


@rule("test-no-unmocked-dynamic-imports")
def test_no_unmocked_dynamic_imports(e, o):
    tests = e.files.where(P.matches_any(F.col("path"), o.get("tests", ["**/*.test.*"])))
    mocked = tests.select(F.col("path").alias("test"), F.explode(F.regexp_extract_all("content", F.lit(r"\b(?:vi|jest)\.mock\(\s*[\"']([^\"']+)"))).alias("specifier"))
    late = e.resolved.where("kind = 'dynamic-import'").join(tests.select(F.col("path").alias("importer")), "importer")
    return finding("test-no-unmocked-dynamic-imports", late.join(mocked.withColumnRenamed("test", "importer"), ["importer", "specifier"], "left_anti"), file="importer", line=F.col("line"), message="a dynamic import isn't mocked", imported=F.col("specifier"))


@rule("tsconfig-alias-folder-mapping")
def tsconfig_alias_folder_mapping(e, o):
    from codeloom.operators.resolve import tsconfig_aliases

    rows = tsconfig_aliases(e.files).where("not exact and head <> ''").withColumn("folder", F.regexp_replace("target", r"/?\*.*$", ""))
    dirs = e.files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("folder")).distinct()
    return finding("tsconfig-alias-folder-mapping", rows.join(dirs, "folder", "left_anti").withColumn("path", F.concat("dir", F.lit("tsconfig.json"))), message=F.concat(F.lit("no folder for "), "head"), target=F.col("folder"))


@rule("tsconfig-file-coverage")
def tsconfig_file_coverage(e, o):
    return finding("tsconfig-file-coverage", e.files.where(F.col("ext").isin("ts", "tsx", "mts", "cts") & ~P.matches_any(F.col("path"), [*o.get("include", []), *o.get("allow", [])])), message="no tsconfig holds the file")


@rule("tsconfig-gate-coverage")
def tsconfig_gate_coverage(e, o):
    configs = e.files.where(P.basename(F.col("path")).rlike(r"^tsconfig(\..*)?\.json$")).select("path")
    runs = steps_of(e).where("run is not null").select(F.explode(F.regexp_extract_all("run", F.lit(r"(?:-p|--project|-b|--build)\s+(\S+)"))).alias("path")).select(F.when(F.col("path").endswith(".json"), F.col("path")).otherwise(F.concat_ws("/", "path", F.lit("tsconfig.json"))).alias("path"))
    return finding("tsconfig-gate-coverage", configs.join(runs.select(P.normalize_path(F.col("path")).alias("path")), "path", "left_anti"), message="no workflow checks the configuration")


@rule("unique-exports")
def unique_exports(e, o):
    from codeloom.operators.matching import duplicates

    rows = e.exports.where("kind <> 're-export' and name <> 'default'").withColumn("bucket", F.when(F.col("type_only"), "type").otherwise("value"))
    return finding("unique-exports", duplicates(rows, ["name", "bucket"], ["file", "line"]), file="file", line=F.col("line"), message=F.concat(F.col("name"), F.lit(" is also exported by "), "first_file"), target=F.col("first_file"))


@rule("version-pin-consistency")
def version_pin_consistency(e, o):
    if not o.get("source"):
        return union(e, [])
    pin = e.files.where(F.col("path") == o["source"]["file"]).select(F.regexp_extract("content", o["source"]["pattern"], 1).alias("pin"))
    rows = e.files.where(P.matches_any(F.col("path"), o.get("targets", []))).select("path", F.explode(F.regexp_extract_all("content", F.lit(o["pattern"]))).alias("found"))
    return finding("version-pin-consistency", rows.join(pin, F.col("found") != F.col("pin")), message=F.concat_ws(" isn't ", "found", "pin"), target=F.lit(o["source"]["file"]))


@rule("vitest-ci-path-coverage")
def vitest_ci_path_coverage(e, o):
    globs = [g for r in e.workflows.where("error is null").select(F.flatten("paths.globs")).collect() for g in r[0] or []]
    return finding("vitest-ci-path-coverage", scoped(e, o, []).where(~P.ordered_match(F.col("path"), globs)), message="no workflow's path filter holds the input")


@rule("vitest-project-mapping")
def vitest_project_mapping(e, o):
    projects = o.get("projects", {})
    count = F.lit(0)
    for globs in projects.values():
        count = count + P.matches_any(F.col("path"), globs).cast("int")
    return finding("vitest-project-mapping", scoped(e, o, ["**/*.test.*"]).withColumn("_n", count).where("_n <> 1"), message=F.concat(F.col("_n").cast("string"), F.lit(" projects hold the test")))


@rule("vitest-test-correspondence")
def vitest_test_correspondence(e, o):
    tests = scoped(e, o, ["**/*.test.*", "**/*.spec.*"]).withColumn("stem", F.regexp_replace("path", r"\.(test|spec)\.[^.]+$", ""))
    sources = e.files.where(~F.col("path").rlike(r"\.(test|spec)\.")).select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"))
    return finding("vitest-test-correspondence", tests.join(sources, "stem", "left_anti"), message="no source beside the test")


@rule("workspace-package-cycles")
def workspace_package_cycles(e, o):
    return finding("workspace-package-cycles", G.cycles(e.package_edges).join(e.packages.select(F.col("name").alias("id"), "path"), "id"), message=F.concat(F.lit("cycle of "), "component"), target=F.col("component"))


def selectors(e) -> DataFrame:
    return e.typescript.select(F.col("path").alias("file"), F.explode("selectors").alias("s")).select("file", "s.*")


def repeated(name: str, wanted: Column):
    @rule(name)
    def check(e, o):
        from codeloom.operators.matching import occurrences_of_repeats

        rows = occurrences_of_repeats(selectors(e).where(wanted & F.col("exact")), ["attribute", "value"])
        return finding(name, rows, file="file", line=F.col("line"), message=F.concat(F.col("value"), F.lit(" is used more than once")), target=F.col("value"))


@rule("playwright-coverage")
def playwright_coverage(e, o):
    tested = e.locators.where("kind = 'getByTestId'").select("value").distinct()
    return finding("playwright-coverage", selectors(e).where("attribute <> 'id' and exact").join(tested, "value", "left_anti"), file="file", line=F.col("line"), message=F.concat(F.lit("no test uses "), "value"), target=F.col("value"))


@rule("playwright-prefer-test-id-locators")
def playwright_prefer_test_id_locators(e, o):
    rows = e.locators.where("kind in ('getByText', 'getByLabel', 'getByPlaceholder')")
    return finding("playwright-prefer-test-id-locators", rows.join(selectors(e).select("value").distinct(), "value", "left_semi"), file="file", line=F.col("line"), message="a test id exists for the text", target=F.col("value"))


@rule("nextjs-redirect-destinations")
def nextjs_redirect_destinations(e, o):
    rows = e.files.where(P.basename(F.col("path")).rlike(r"^next\.config\.")).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"destination\s*:\s*[\"'`](/[^\"'`]*)"))).alias("to"))
    both = rows.join(e.page_routes.select(F.col("route").alias("_r")), P.route_matches(P.rewrite_pattern(F.col("to")), F.col("_r")), "left_anti")
    return finding("nextjs-redirect-destinations", both, message=F.concat(F.lit("no page for "), "to"), target=F.col("to"))


# file-local lint rules over extracted facts (2.16)

TESTS = ["**/*.test.*", "**/*.spec.*", "*.test.*", "*.spec.*"]
FETCH_METHOD = r"\bmethod\s*:\s*+(?![\"'`])"


def calls(e, o: dict, default: list[str] = ("**",)) -> DataFrame:
    """path, callee, line, scope, args, shapes of the rule's files."""
    rows = e.typescript.join(scoped(e, o, default).select("path"), "path", "left_semi")
    return rows.select("path", F.explode("calls").alias("c")).select("path", "c.*")


@rule("async-call-disposition")
def async_call_disposition(e, o):
    """Calls of configured names that no await, return, void, then, catch or assignment handles on their line."""
    lines = each_line(scoped(e, o, ["**/*.ts", "**/*.tsx", "**/*.js"])).select("path", "line", "text")
    rows = calls(e, o).where(F.col("callee").isin(o.get("calls", []))).join(lines, ["path", "line"])
    handled = rf"(\b(await|return|void)\s+|=>?\s*)({'|'.join(map(re.escape, o.get('calls', [''])))})\(|\.(then|catch|finally)\("
    return finding("async-call-disposition", rows.where(~F.col("text").rlike(handled)), line=F.col("line"), message=F.concat("callee", F.lit(" isn't handled")))


@rule("module-mock-boundary")
def module_mock_boundary(e, o):
    rows = calls(e, o, TESTS).where(F.col("callee").isin("vi.mock", "jest.mock", "vi.doMock", "jest.doMock")).withColumn("_m", F.regexp_extract(F.col("args")[0], r"[\"'`]([^\"'`]*)", 1))
    return finding("module-mock-boundary", rows.where(P.matches_any(F.col("_m"), o.get("banned", [])) & ~P.matches_any(F.col("_m"), o.get("allowed", []))), line=F.col("line"), message=F.concat(F.lit("mocked: "), "_m"), imported=F.col("_m"))


@rule("module-mock-preserve-exports")
def module_mock_preserve_exports(e, o):
    rows = calls(e, o, TESTS).where(F.col("callee").isin("vi.mock", "jest.mock") & (F.size("args") > 1)).withColumn("_m", F.regexp_extract(F.col("args")[0], r"[\"'`]([^\"'`]*)", 1))
    return finding("module-mock-preserve-exports", rows.where(P.matches_any(F.col("_m"), o.get("modules", ["./**", "../**", "@/**"])) & ~F.col("args")[1].rlike(r"importActual|importOriginal|requireActual")), line=F.col("line"), message=F.concat(F.lit("the mock drops exports of "), "_m"), imported=F.col("_m"))


@rule("vitest-mock-test-file-naming")
def vitest_mock_test_file_naming(e, o):
    rows = calls(e, o, TESTS).where(F.col("callee").isin("vi.mock", "vi.doMock") & ~F.col("path").rlike(r"\.mock\.(test|spec)\."))
    return finding("vitest-mock-test-file-naming", rows, line=F.col("line"), message="a test that mocks modules is named .mock.test")


@rule("nextjs-metadata-exports-location")
def nextjs_metadata_exports_location(e, o):
    rows = e.exports.where(F.col("name").isin("metadata", "generateMetadata", "viewport", "generateViewport") & ~P.basename(F.col("file")).rlike(r"^(page|layout|template|not-found)\.[jt]sx?$"))
    return finding("nextjs-metadata-exports-location", rows, file="file", line=F.col("line"), message=F.concat("name", F.lit(" is exported outside a route segment")))


@rule("nextjs-static-fetch-method")
def nextjs_static_fetch_method(e, o):
    rows = calls(e, o).where((F.col("callee") == "fetch") & F.coalesce(F.try_element_at("args", F.lit(2)), F.lit("")).rlike(FETCH_METHOD))
    return finding("nextjs-static-fetch-method", rows, line=F.col("line"), message="the method isn't static")


@rule("no-banned-import-outside-allowed-paths")
def no_banned_import_outside_allowed_paths(e, o):
    """Imports of banned names, re-exports followed, from files outside the allowed paths."""
    out = []
    for ban in o.get("bans", []):
        rows = e.imports.where((F.col("specifier") == ban["module"]) & F.exists("names", lambda n: n.isin(ban.get("names", [])) | (n == "*")))
        out.append(finding("no-banned-import-outside-allowed-paths", rows.where(~P.matches_any(F.col("importer"), ban.get("allowed", []))), file="importer", line=F.col("line"), message=f"banned import of {ban['module']}", imported=F.col("specifier")))
    return union(e, out)


@rule("no-global-fetch-outside-helper")
def no_global_fetch_outside_helper(e, o):
    rows = calls(e, o).where(F.col("callee").isin("fetch", "window.fetch", "globalThis.fetch") & ~P.matches_any(F.col("path"), o.get("helpers", [])))
    return finding("no-global-fetch-outside-helper", rows, line=F.col("line"), message="fetch is called outside its helper")


@rule("no-import-only-test-files")
def no_import_only_test_files(e, o):
    rows = e.typescript.join(scoped(e, o, TESTS).select("path"), "path", "left_semi").where((F.size("imports") > 0) & (F.size("calls") == 0) & (F.size("exports") == 0))
    return finding("no-import-only-test-files", rows, message="the test only imports other files")


@rule("playwright-assertion-timeout-cap")
def playwright_assertion_timeout_cap(e, o):
    rows = each_line(scoped(e, o, TESTS)).withColumn("_t", F.regexp_extract("text", r"\.to[A-Z]\w*\(.*\btimeout\s*:\s*(\d[\d_]*)", 1)).where("_t <> ''")
    return finding("playwright-assertion-timeout-cap", rows.where(F.regexp_replace("_t", "_", "").try_cast("bigint") > o.get("max", 10000)), line=F.col("line"), message=F.concat(F.lit("timeout "), "_t"))


@rule("playwright-consistent-attribute")
def playwright_consistent_attribute(e, o):
    wanted = o.get("attribute", "data-testid")
    return finding("playwright-consistent-attribute", selectors(e).where((F.col("attribute") != "id") & (F.col("attribute") != wanted)), file="file", line=F.col("line"), message=F.concat(F.lit(f"{wanted} rather than "), "attribute"))


@rule("playwright-literals")
def playwright_literals(e, o):
    return finding("playwright-literals", selectors(e).where("not exact and attribute <> 'id'"), file="file", line=F.col("line"), message="the test id isn't a literal")


@rule("playwright-naming-convention")
def playwright_naming_convention(e, o):
    return finding("playwright-naming-convention", selectors(e).where((F.col("attribute") != "id") & F.col("exact") & ~F.col("value").rlike(o.get("pattern", "^[a-z][a-z0-9]*(-[a-z0-9]+)*$"))), file="file", line=F.col("line"), message=F.concat("value", F.lit(" breaks the naming convention")))


@rule("playwright-unique")
def playwright_unique(e, o):
    from codeloom.operators.matching import duplicates

    return finding("playwright-unique", duplicates(selectors(e).where("exact and attribute <> 'id'"), ["file", "attribute", "value"], ["line"]), file="file", line=F.col("line"), message=F.concat("value", F.lit(" is used before in the file")))


@rule("playwright-require-exported-component-attribute")
def playwright_require_exported_component_attribute(e, o):
    made = e.typescript.where((F.size("components") > 0) & (F.size("selectors") == 0)).select("path", F.explode("exports").alias("x")).where("x.name rlike '^[A-Z]' or x.kind = 'default'")
    return finding("playwright-require-exported-component-attribute", made, line=F.col("x.line"), message=F.concat(F.col("x.name"), F.lit(" renders no test id")))


@rule("playwright-require-interactive-test-id")
def playwright_require_interactive_test_id(e, o):
    rows = scoped(e, o, ["**/*.tsx", "**/*.jsx", "*.tsx", "*.jsx"]).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"<(?:button|input|select|textarea|a)\b(?:[^>{}]|\{[^{}]*\})*>"), F.lit(0))).alias("tag"))
    return finding("playwright-require-interactive-test-id", rows.where(~F.col("tag").rlike(r"data-(testid|test-id|test|pw)")), message=F.concat(F.lit("no test id: "), F.substring("tag", 1, 60)))


@rule("playwright-selector-priority")
def playwright_selector_priority(e, o):
    return finding("playwright-selector-priority", e.locators.where(F.col("kind").isin("locator") & ~F.col("value").rlike(r"data-(testid|test-id|test|pw)")), file="file", line=F.col("line"), message=F.concat(F.lit("a raw selector: "), "value"))


@rule("postgres-no-unbounded-query-fanout")
def postgres_no_unbounded_query_fanout(e, o):
    body = F.concat_ws(",", "args")
    rows = calls(e, o).where((F.col("callee") == "Promise.all") & body.rlike(r"\.map\(") & body.rlike(r"\.(query|execute|unsafe|one|many|any)\(") & ~body.rlike(r"^\s*\["))
    return finding("postgres-no-unbounded-query-fanout", rows, line=F.col("line"), message="a query for each of unboundedly many items")


@rule("server-require-nullable-fetch-wrapper")
def server_require_nullable_fetch_wrapper(e, o):
    helpers, wrapper = o.get("helpers", []), o.get("wrapper", "nullable")
    lines = each_line(scoped(e, o, ["**/*.ts", "**/*.tsx"])).select("path", "line", "text")
    rows = calls(e, o).where(F.col("callee").isin(helpers)).join(lines, ["path", "line"])
    return finding("server-require-nullable-fetch-wrapper", rows.where(~F.col("text").contains(wrapper + "(")), line=F.col("line"), message=F.concat("callee", F.lit(f" isn't wrapped in {wrapper}")))


@rule("test-no-shared-state")
def test_no_shared_state(e, o):
    mask = F.udf(lambda s, x: mask_strings(s or "", x), "string")
    rows = each_line(scoped(e, o, TESTS).withColumn("content", mask("content", "ext"))).where(F.col("text").rlike(r"^(export\s+)?(let|var)\s+\w+"))
    return finding("test-no-shared-state", rows, line=F.col("line"), message="mutable state of the whole test module")


line_pattern("react-no-nullish-react-node", ["**/*.tsx", "*.tsx"], r"\{\s*(children|icon|label|title|content|node)\s*\?\?", "nullish coalescing of a node", True)
line_pattern("ts-no-function-aliases", ["**/*.ts", "**/*.tsx", "*.ts"], r"\b(const|let)\s+\w+\s*=\s*\(\s*((?:\.\.\.)?\w+)\s*\)\s*=>\s*[\w.]+\(\s*\2\s*\)", "a function that only calls another", True)
line_pattern("ts-preserve-null-option-defaults", ["**/*.ts", "**/*.tsx", "*.ts"], r"\b(options|opts|params|config)\??\.\w+\s*(\?\?|\|\|)=?\s", "a default that hides null", True)
line_pattern("playwright-defaults", ["**/*.tsx", "*.tsx"], r"data-(testid|test-id|test|pw)=\{\s*(props\.)?\w+\s*\}", "a test id from a property without a literal default")
line_pattern("async-try-catch-return-await", ["**/*.ts", "**/*.tsx", "*.ts"], r"\btry\s*\{[^}]*\breturn\s+(?!await\b)\w[\w.]*\([^}]*\}\s*catch", "a promise is returned from try without await", True)


def register_repeats() -> None:
    """The rules whose filters need a running session."""
    repeated("playwright-unique-html-ids", F.col("attribute") == "id")
    repeated("playwright-unique-test-ids", F.col("attribute") != "id")


def check(e, rules: dict[str, dict]) -> DataFrame:
    """The findings of the rules, suppressed ones left out, each once."""
    register_repeats()
    found = union(e, [RULES[name](e, options or {}) for name, options in rules.items()])
    return suppress(found, e.directives).distinct().orderBy("file", F.col("line").asc_nulls_first(), "rule", "message", "target")
