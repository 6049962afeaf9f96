"""Queries over fixed snapshots: every edge family, report and rule of the engine, with the rows a reader of the files expects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.engine import Engine
from codeloom.plans.rule_cases import RULE_CASES, WF, package
from codeloom.sources import repository as S

PAGES = {"app/users/[id]/page.tsx": "export default function Page() { return null; }\n", "app/about/page.tsx": "", "app/layout.tsx": "", "app/users/layout.tsx": ""}
SERVER = {
    "src/server.ts": 'import router from "./router";\napp.use("/api", router);\n',
    "src/router.ts": 'const r = Router();\nr.get("/users/:id", (req, res) => res.json(req.query.page));\nr.post("/users", save);\nexport default r;\n',
    "src/client.ts": 'fetch(`/api/users/${id}?page=1&sort=2`);\nfetch("/api/users", { headers: { a: 1 }, method: "POST" });\nfetch("/api/none");\n',
}
QUEUES = {
    "src/queue.ts": 'const q = new Queue("mail");\nq.add("send", {});\nq.add("lost", {});\n',
    "src/worker.ts": 'new Worker("mail", async (job) => { switch (job.name) { case "send": break; case "idle": break; } });\n',
}
TERRAFORM = {
    "infra/main.tf": 'module "net" {\n  source = "./net"\n}\nresource "aws_instance" "web" {\n  subnet = module.net.subnet_id\n  ami = var.ami\n}\n',
    "infra/vars.tf": 'variable "ami" {}\n',
    "infra/net/out.tf": 'output "subnet_id" {\n  value = 1\n}\n',
}
WORKFLOW = {
    WF: "name: CI\non:\n  push:\n    paths: ['src/**', '!src/skip.ts']\njobs:\n  build:\n    steps:\n      - run: node src/server.ts\n      - uses: actions/upload-artifact@v4\n        with: {name: out}\n  test:\n    needs: [build, ghost]\n    steps:\n      - uses: actions/download-artifact@v4\n        with: {name: out}\n  call:\n    uses: ./.github/workflows/reuse.yml\n",
    ".github/workflows/reuse.yml": "name: Reuse\non:\n  workflow_call:\n    inputs:\n      level: {required: true, type: string}\njobs:\n  a:\n    needs: [b]\n    steps: []\n  b:\n    needs: [a]\n    steps: []\n",
    "src/server.ts": "",
}
BARREL = {
    "lib/core.ts": "export const used = 1;\nexport const unused = 2;\nexport function run(a, b) { return a; }\n",
    "lib/index.ts": 'export { used, run } from "./core";\n',
    "src/a.ts": 'import { used, run } from "../lib/index";\nrun(1, 2);\nrun(...used);\n',
    "src/a.test.ts": 'import "./a";\nimport type { T } from "./types";\n',
    "src/types.ts": "export type T = string;\n",
    "src/late.ts": 'export async function f() { return import("./a"); }\n',
}
REACT = {
    "src/page.tsx": '"use client";\nimport { Card } from "./card";\nexport function Page(props) { return <div data-testid="page"><Card /></div>; }\n',
    "src/card.tsx": "export const Card = memo(({ x }) => { const [a] = useState(0); fetch('/x'); return <p>{a}</p>; });\n",
    "other/card.tsx": "export function Card() { return <b />; }\n",
    "src/card.test.tsx": 'import { Card } from "./card";\nrender(<Card />);\n',
}
E2E = PAGES | {
    "src/view.tsx": 'export function View() { return <p data-testid="users" />; }\nexport function Other() { return <p data-testid="other" />; }\n',
    "e2e/users.spec.ts": 'test("x", async ({ page }) => { await page.goto("/users/1"); await page.getByTestId("users").click(); });\n',
}
PLAN = {
    "src/types.ts": "export type T = string;\n", "src/helper.ts": 'import type { T } from "./types";\nexport function helper() {}\n', "src/lazy.ts": 'export const f = () => import("./helper");\n',
    "src/helper.test.ts": 'import { helper } from "./helper";\nhelper();\n', "src/lazy.test.ts": 'import { f } from "./lazy";\nf();\n', "package.json": package("r"),
}
DIFF = 'diff --git a/src/view.tsx b/src/view.tsx\n--- a/src/view.tsx\n+++ b/src/view.tsx\n@@ -1,2 +1,1 @@\n-<p data-testid="gone" />\n-<p data-testid="moved" />\n+<b data-testid="moved" />\n'
SWIFT = {"Sources/Core/A.swift": "import Foundation\nstruct A {}\n", "Sources/App/B.swift": "import Core\nstruct B {}\n", "Tests/AppTests/T.swift": "import App\n"}
PYTHON = {"py/app/models.py": "class User:\n    pass\n", "py/app/views.py": "from .models import User\n\nUser()\n", "py/other/thing.py": "class User:\n    pass\n"}
GO = {"go/shop/a.go": "package shop\n\ntype Cart struct{}\n", "go/shop/b.go": "package shop\n\nfunc f(c Cart) {}\n", "go/other/c.go": "package shop\n\ntype Cart struct{}\n"}

#: edge family: (snapshot, (src, dst, kind) of all its edges).
EDGE_CASES: dict[str, tuple[dict[str, str], list[tuple[str, str, str]]]] = {
    "import": (
        {"src/a.ts": 'import "./x.js";\nimport "./y";\nimport type { T } from "./t";\nconst r = require("./r");\nexport const f = () => import("./late");\nfunction unused() { require("./never"); }\n', "src/x.js": "", "src/x.ts": "", "src/y.ts": "", "src/y.mts": "", "src/t/index.ts": "", "src/r.cjs": "", "src/late.tsx": "", "src/never.ts": ""},
        [("src/a.ts", "src/x.ts", "import"), ("src/a.ts", "src/y.mts", "import"), ("src/a.ts", "src/t/index.ts", "type-import"), ("src/a.ts", "src/r.cjs", "require"), ("src/a.ts", "src/late.tsx", "dynamic-import")],
    ),
    "module": ({"src/a.ts": 'import x from "left-pad/lib";\nimport { y } from "@s/p/deep";\n'}, [("src/a.ts", "left-pad", "import"), ("src/a.ts", "@s/p", "import")]),
    "asset": ({"src/a.ts": 'import "./s.css";\nimport "./b";\n', "src/s.css": "", "src/b.ts": ""}, [("src/a.ts", "src/s.css", "asset")]),
    "workspace": (
        {"packages/u/package.json": '{"name": "@app/u", "exports": {".": "./src/index.ts"}}', "packages/u/src/index.ts": "", "src/a.ts": 'import "@app/u";\n', "src/b.ts": 'import type { T } from "@app/u";\n'},
        [("src/a.ts", "packages/u/src/index.ts", "workspace"), ("src/b.ts", "packages/u/src/index.ts", "workspace-type-import")],
    ),
    "package": ({"package.json": package("root", "a"), "packages/a/package.json": package("a", "left-pad")}, [("package.json", "packages/a/package.json", "package"), ("packages/a/package.json", "left-pad", "package")]),
    "test": ({"src/a.ts": "", "src/a.test.ts": "", "src/b.spec.tsx": ""}, [("src/a.test.ts", "src/a.ts", "test")]),
    "md": ({"docs/a.md": "[b](b.md) [web](https://x.y) [gone](gone.md)\n", "docs/b.md": "[a](../docs/a.md#top)\n"}, [("docs/a.md", "docs/b.md", "md"), ("docs/b.md", "docs/a.md", "md")]),
    "http": (SERVER, [("src/client.ts", "src/router.ts", "http")]),
    "route": (PAGES | {"src/nav.ts": 'fetch("/users/7");\nfetch("/gone");\n'}, [("src/nav.ts", "app/users/[id]/page.tsx", "route")]),
    "queue": (QUEUES, [("src/queue.ts", "queue:mail:send", "queue-enqueue"), ("src/queue.ts", "queue:mail:lost", "queue-enqueue"), ("queue:mail:send", "src/worker.ts", "queue-worker"), ("queue:mail:idle", "src/worker.ts", "queue-worker")]),
    "process": ({"src/a.ts": 'spawn("node", ["scripts/run.js", "gone.js"]);\n', "scripts/run.js": ""}, [("src/a.ts", "scripts/run.js", "process")]),
    "resource": ({"src/a.ts": 'readFileSync("data/x.json");\n', "data/x.json": "{}"}, [("src/a.ts", "data/x.json", "resource")]),
    "react-render": (REACT, [("src/page.tsx", "src/card.tsx", "react-render")]),
    "route-test": (E2E, [("e2e/users.spec.ts", "app/users/[id]/page.tsx", "route-test")]),
    "layout": (PAGES, [("app/users/[id]/page.tsx", "app/layout.tsx", "layout"), ("app/users/[id]/page.tsx", "app/users/layout.tsx", "layout"), ("app/about/page.tsx", "app/layout.tsx", "layout")]),
    "selector": (E2E, [("e2e/users.spec.ts", "src/view.tsx", "selector")]),
    "trpc": (
        {"src/router.ts": "export const users = router({ list: publicProcedure.query(() => 1) });\n", "src/use.ts": "const x = trpc.users.list.useQuery();\n"},
        [("src/use.ts", "src/router.ts#procedure:list", "trpc-call"), ("src/router.ts#procedure:list", "src/router.ts", "trpc-procedure")],
    ),
    "terraform-ref": (TERRAFORM, [("infra/main.tf", "infra/vars.tf", "terraform-ref")]),
    "terraform-output": (TERRAFORM, [("infra/main.tf", "infra/net/out.tf", "terraform-output")]),
    "lang-import": (PYTHON, [("py/app/views.py", "py/app/models.py", "py-import")]),
    "lang-ref": (GO, [("go/shop/b.go", "go/shop/a.go", "go-ref")]),
    "rust-mod": ({"rust/src/lib.rs": "mod inner;\nmod deep;\n", "rust/src/inner.rs": "", "rust/src/deep/mod.rs": ""}, [("rust/src/lib.rs", "rust/src/inner.rs", "rust-mod"), ("rust/src/lib.rs", "rust/src/deep/mod.rs", "rust-mod")]),
    "workflow-job": (WORKFLOW, [(WF, f"{WF}#job:{j}", "workflow-job") for j in ("build", "test", "call")] + [(".github/workflows/reuse.yml", f".github/workflows/reuse.yml#job:{j}", "workflow-job") for j in "ab"]),
    "workflow-needs": (WORKFLOW, [(f"{WF}#job:test", f"{WF}#job:build", "workflow-needs"), (f"{WF}#job:test", f"{WF}#job:ghost", "workflow-needs"), (".github/workflows/reuse.yml#job:a", ".github/workflows/reuse.yml#job:b", "workflow-needs"), (".github/workflows/reuse.yml#job:b", ".github/workflows/reuse.yml#job:a", "workflow-needs")]),
    "workflow-uses": (WORKFLOW, [(f"{WF}#job:call", ".github/workflows/reuse.yml", "workflow-uses")]),
    "workflow-run": (WORKFLOW, [(f"{WF}#job:build", "src/server.ts", "workflow-run")]),
    "workflow-artifact": (WORKFLOW, [(f"{WF}#job:test", f"{WF}#job:build", "workflow-artifact")]),
}


def _list(column: str):
    return F.array_join(F.array_sort(column), ",").alias(column)


NAMES = ["id", "depth"]
#: report: (snapshot, what to ask the engine, columns, rows).
REPORT_CASES: dict[str, tuple[dict[str, str], Callable[[Engine], DataFrame], list[str], list[tuple]]] = {
    "dependencies": (BARREL, lambda e: e.dependencies("src/late.ts"), NAMES, [("src/a.ts", 1), ("lib/index.ts", 2), ("lib/core.ts", 3)]),
    "dependencies_depth": (BARREL, lambda e: e.dependencies("src/late.ts", depth=2), NAMES, [("src/a.ts", 1), ("lib/index.ts", 2)]),
    "dependencies_filter": (BARREL, lambda e: e.dependencies("src/late.ts", filters=["lib/"]), NAMES, [("lib/", 2)]),
    "dependents": (BARREL, lambda e: e.dependents("lib/core.ts"), NAMES, [("lib/index.ts", 1), ("src/a.ts", 2), ("src/a.test.ts", 3), ("src/late.ts", 3)]),
    "dependents_of_symbol": (BARREL, lambda e: e.dependents("lib/core.ts#used", depth=1), NAMES, [("lib/index.ts", 1), ("src/a.ts", 1)]),
    "symbols_list": (BARREL, lambda e: e.symbols().where("file = 'lib/core.ts'"), ["name", "kind", "line"], [("used", "const", 1), ("unused", "const", 2), ("run", "function", 3)]),
    "signature_impact": (BARREL, lambda e: e.signature_impact("lib/index.ts", "used"), ["importer", "is_test"], [("src/a.ts", False)]),
    "import_usages": (BARREL, lambda e: e.import_usages().where("path = 'src/a.test.ts'"), ["specifier", "kind", "line", "side_effect_only"], [("./a", "import", 1, True), ("./types", "type-import", 2, False)]),
    "importers": (BARREL, lambda e: e.importers("src/a.ts"), ["importer", "kind", "line"], [("src/a.test.ts", "import", 1), ("src/late.ts", "dynamic-import", 1)]),
    "importers_of_symbol": (BARREL, lambda e: e.importers("lib/core.ts", "run"), ["importer", "re_export"], [("lib/index.ts", True), ("src/a.ts", False)]),
    "exports_of": (BARREL, lambda e: e.exports_of("lib/core.ts").withColumn("importers", F.coalesce(_list("importers"), F.lit(""))), ["name", "importers"], [("used", "lib/index.ts"), ("unused", ""), ("run", "lib/index.ts")]),
    "dead_exports_report": (BARREL, lambda e: e.dead_exports(), ["file", "name"], [("lib/core.ts", "unused"), ("src/late.ts", "f")]),
    "call_sites": (BARREL, lambda e: e.call_sites("lib/index.ts", "run"), ["file", "line", "arg_count", "has_spread"], [("src/a.ts", 2, 2, False), ("src/a.ts", 3, 1, True)]),
    "resolve_check": ({"src/a.ts": 'import "./b";\nimport "./gone";\nimport "pad";\nimport "node:fs";\n', "src/b.ts": ""}, lambda e: e.resolve_check(), ["specifier", "status"], [("./b", "resolved"), ("./gone", "unresolved"), ("pad", "external"), ("node:fs", "external")]),
    "fetches": (SERVER, lambda e: e.fetches().withColumn("files", _list("files")), ["url", "method", "files"], [("/api/users/:param?page=1&sort=2", "GET", "src/client.ts"), ("/api/users", "POST", "src/client.ts"), ("/api/none", "GET", "src/client.ts")]),
    "flow": (BARREL, lambda e: e.flow("src/a.ts", 2, "deps"), ["src", "dst", "kind", "depth"], [("src/a.ts", "lib/index.ts", "import", 1), ("lib/index.ts", "lib/core.ts", "import", 2)]),
    "effects": (SERVER | {"src/main.ts": 'import "./client";\nfetch("/y");\n'}, lambda e: e.effects("src/main.ts", {"network": ["fetch"]}), ["file", "callee", "line", "category"], [("src/main.ts", "fetch", 2, "network"), *[("src/client.ts", "fetch", n, "network") for n in (1, 2, 3)]]),
    "rsc_callers": ({"src/a.tsx": 'import "./b";\n', "src/b.tsx": 'import "./c";\n', "src/c.tsx": "", "src/d.tsx": '"use client";\nimport "./c";\n', "src/e.tsx": 'import "./d";\n'}, lambda e: e.rsc_callers("src/c.tsx"), NAMES, [("src/b.tsx", 1), ("src/a.tsx", 2)]),
    "registry_extension": ({"src/r.ts": "setup();\nreg.add(1);\nreg.add(2);\nreg.add(3);\n"}, lambda e: e.registry_extension("src/r.ts"), ["callee", "last_line"], [("reg.add", 4)]),
    "data_pw": (E2E, lambda e: e.data_pw("users"), ["file", "attribute", "line", "is_test"], [("src/view.tsx", "data-testid", 1, False)]),
    "playwright_edges": (E2E, lambda e: e.playwright_edges(), ["src", "dst", "kind"], [("e2e/users.spec.ts", "app/users/[id]/page.tsx", "route-test"), ("e2e/users.spec.ts", "src/view.tsx", "selector")]),
    "playwright_related": (E2E, lambda e: e.playwright_related("src/view.tsx"), ["src", "kind"], [("e2e/users.spec.ts", "selector")]),
    "playwright_tests": (E2E, lambda e: e.playwright_tests().withColumn("values", _list("values")), ["file", "values"], [("e2e/users.spec.ts", "users")]),
    "playwright_check": (E2E, lambda e: e.playwright_check().withColumns({"total": F.col("total").cast("int"), "covered": F.col("covered").cast("int")}), ["kind", "total", "covered"], [("route", 2, 1), ("selector", 2, 1)]),
    "react_analyze": (REACT, lambda e: e.react_analyze(), ["file", "name", "state", "inherits_state", "inherits_fetch"], [("src/page.tsx", "Page", False, True, True), ("src/card.tsx", "Card", True, True, True), ("other/card.tsx", "Card", False, False, False)]),
    "react_check": (REACT, lambda e: e.react_check(), ["file", "name"], [("src/page.tsx", "Page"), ("src/card.tsx", "Card")]),
    "react_usages": (REACT, lambda e: e.react_usages("Card"), ["file", "parent", "is_test"], [("src/page.tsx", "Page", False)]),
    "queues_edges": (QUEUES, lambda e: e.queue_edges(), ["producer", "worker", "queue", "job"], [("src/queue.ts", "src/worker.ts", "mail", "send")]),
    "queues_related": (QUEUES, lambda e: e.queue_related("src/queue.ts"), ["src", "dst", "level"], [("src/queue.ts", "queue:mail:send", 1), ("src/queue.ts", "queue:mail:lost", 1), ("queue:mail:send", "src/worker.ts", 2)]),
    "queues_check": (QUEUES, lambda e: e.queue_check(), ["queue", "job", "kind"], [("mail", "lost", "producer"), ("mail", "idle", "worker")]),
    "server_routes": (SERVER, lambda e: e.server_route_list().withColumn("params", _list("params")), ["file", "method", "route", "line", "params"], [("src/router.ts", "GET", "/api/users/*", 2, "page"), ("src/router.ts", "POST", "/api/users", 3, "page")]),
    "server_edges": (SERVER, lambda e: e.server_route_edges(), ["src", "dst", "kind"], [("src/client.ts", "src/router.ts", "http")]),
    "server_related": (SERVER, lambda e: e.server_route_related("src/client.ts"), ["src", "dst", "level"], [("src/client.ts", "src/router.ts", 1)]),
    "server_contracts": (SERVER, lambda e: e.server_contracts().withColumn("missing_params", _list("missing_params")), ["file", "line", "matched_route", "missing_params"], [("src/client.ts", 1, "/api/users/:id", "sort")]),
    "infra_resource_refs": (TERRAFORM, lambda e: e.infra_resource_refs("var.ami"), ["path"], [("infra/main.tf",)]),
    "infra_outputs": (TERRAFORM, lambda e: e.infra_outputs().withColumn("output", F.substring_index("output", ".", -1)), ["dst", "output", "consumer"], [("infra/net/out.tf", "subnet_id", "infra/main.tf")]),
    "infra_test_for": (TERRAFORM | {"infra/net/net.tftest.hcl": "", "other/x.tftest.hcl": ""}, lambda e: e.infra_test_for("infra/net/out.tf"), ["path"], [("infra/net/net.tftest.hcl",)]),
    "swift_importers": (SWIFT, lambda e: e.swift_importers("Core"), ["path"], [("Sources/App/B.swift",)]),
    "swift_test_targets": (SWIFT, lambda e: e.swift_test_targets("Core"), NAMES, [("AppTests", 2)]),
    "ci_topology": (WORKFLOW, lambda e: e.ci_topology().groupBy("kind").agg(F.count("*").cast("int").alias("n")), ["kind", "n"], [("workflow-job", 5), ("workflow-needs", 4), ("workflow-uses", 1), ("workflow-run", 1), ("workflow-artifact", 1)]),
    "ci_diagnostics": (WORKFLOW, lambda e: e.ci_diagnostics(), ["code", "path", "subject"], [("missing-need", WF, "ghost"), ("needs-cycle", ".github/workflows/reuse.yml", "a"), ("needs-cycle", ".github/workflows/reuse.yml", "b"), ("missing-input", WF, "level")]),
    "ci_impact": (WORKFLOW, lambda e: e.ci_impact(["src/server.ts"]), ["path", "trigger"], [(WF, "matched")]),
    "ci_env": ({WF: "env:\n  TOKEN: x\njobs:\n  a:\n    steps:\n      - run: echo $TOKEN\n"}, lambda e: e.ci_env("TOKEN"), ["path", "line", "is_definition"], [(WF, 2, True), (WF, 6, False)]),
    "impacted_checks": ({}, lambda e: e.impacted_checks(["src/a.ts", "docs/a.md"], [{"globs": ["src/**"], "command": "lint"}, {"globs": ["docs/**", "!docs/b.md"], "command": "docs"}, {"globs": ["src/*.ts"], "command": "lint"}]).withColumn("files", _list("files")), ["command", "files"], [("lint", "src/a.ts"), ("docs", "docs/a.md")]),
    "tests_plan": (PLAN, lambda e: e.tests_plan(["src/types.ts"]), ["test", "confidence", "group"], [("src/helper.test.ts", "high", "dependencies"), ("src/lazy.test.ts", "medium", "dependencies")]),
    "tests_plan_limits": (PLAN, lambda e: e.tests_plan(["src/helper.test.ts", "src/helper.ts"], {"direct": {"files": 1}, "dependencies": {"percent": 100}}), ["test", "group"], [("src/helper.test.ts", "direct"), ("src/lazy.test.ts", "dependencies")]),
    "tests_why": (PLAN, lambda e: e.tests_why("src/lazy.test.ts", "src/helper.ts").withColumn("via", F.array_join("via", ",")), ["changed_file", "via"], [("src/helper.ts", "dynamic-import,import")]),
    "tests_targets": (PLAN, lambda e: e.tests_targets(e.tests), ["command"], [("vitest run src/helper.test.ts src/lazy.test.ts",)]),
    "tests_graph": (PLAN, lambda e: e.tests_graph(e.tests_plan(["src/helper.ts"])), ["src", "dst", "kind"], [("src/helper.ts", "src/helper.test.ts", "import"), ("src/helper.ts", "src/lazy.test.ts", "dynamic-import+import")]),
    "lockfile_diff_report": (
        {"package-lock.json": '{"packages": {"node_modules/a": {"version": "2"}, "node_modules/b": {"version": "1"}}}'},
        lambda e: e.lockfile_diff(S.from_rows(e.spark, {"package-lock.json": '{"packages": {"node_modules/a": {"version": "1"}, "node_modules/c": {"version": "1"}}}'})),
        ["name", "change"],
        [("a", "changed"), ("b", "added"), ("c", "removed")],
    ),
    "dependencies_modules": ({"src/a.ts": 'import "./b";\nimport "left-pad";\nimport "right";\n', "src/b.ts": 'import "@s/p/x";\n'}, lambda e: e.dependencies("src/a.ts", target_modules=["left-*", "@s/*"]), NAMES, [("left-pad", 1), ("@s/p", 2)]),
    "symbols_of_kind": (BARREL, lambda e: e.symbols(["function"]), ["file", "name"], [("lib/core.ts", "run"), ("src/late.ts", "f")]),
    "workflow_closure": (WORKFLOW, lambda e: e.workflow_closure(WF), ["path", "depth"], [(WF, 0), (".github/workflows/reuse.yml", 1)]),
    "changed_inputs": ({}, lambda e: e.changed_inputs(["./src/x.ts", "src/y.ts"], DIFF), ["path"], [("src/x.ts",), ("src/y.ts",), ("src/view.tsx",)]),
    "removed_selectors": ({}, lambda e: e.removed_selectors(DIFF), ["path", "value"], [("src/view.tsx", "gone")]),
    "lockfile_seeds": (
        {"package-lock.json": '{"packages": {"node_modules/a": {"version": "2"}, "node_modules/b": {"version": "1"}, "node_modules/own": {"version": "2"}}}', "src/a.ts": 'import "a/deep";\nimport "b";\n', "packages/own/package.json": '{"name": "own", "main": "./index.js"}'},
        lambda e: e.lockfile_seeds(S.from_rows(e.spark, {"package-lock.json": '{"packages": {"node_modules/a": {"version": "1"}, "node_modules/b": {"version": "1"}, "node_modules/own": {"version": "1"}}}'})),
        ["package", "file"],
        [("a", "src/a.ts"), ("own", "packages/own/index.js")],
    ),
    # the three of the least 64-bit FNV-1a hashes of their paths
    "tests_plan_sample": ({"src/x.ts": ""} | {f"src/{c}.test.ts": 'import "./x";\n' for c in "abcdefgh"}, lambda e: e.tests_plan(["src/x.ts"], {"direct": {"sample": 3}}), ["test", "group"], [("src/b.test.ts", "direct"), ("src/d.test.ts", "direct"), ("src/e.test.ts", "direct")]),
    "tests_plan_diff": (PLAN, lambda e: e.tests_plan(e.changed_inputs(diff="diff --git a/src/types.ts b/src/types.ts\n--- a/src/types.ts\n+++ b/src/types.ts\n@@ -1 +1 @@\n-a\n+b\n")), ["test", "confidence"], [("src/helper.test.ts", "high"), ("src/lazy.test.ts", "medium")]),
    "tests_targets_quoted": ({"package.json": package("r"), "src/it's [id].test.ts": ""}, lambda e: e.tests_targets(e.tests), ["command"], [("vitest run 'src/it'\"'\"'s [id].test.ts'",)]),
    "check_suppressed": ({"a.tsx": "// any-tool-disable-next-line nextjs-no-manual-script-tags\nconst a = <script>;\nconst b = <script>;\n"}, lambda e: e.check({"nextjs-no-manual-script-tags": {}}), ["file", "line"], [("a.tsx", 3)]),
    "visible_paths": ({"src/a.ts": "", "node_modules/x.js": "", ".hidden/y.ts": "", ".github/workflows/c.yml": "", "dist/z.js": ""}, lambda e: S.visible(e.files), ["path"], [("src/a.ts",), (".github/workflows/c.yml",)]),
    "page_routes": (PAGES | {"pages/blog/index.tsx": "", "app/routes/shop.$id.tsx": ""}, lambda e: e.page_routes, ["file", "route"], [("app/users/[id]/page.tsx", "/users/:id"), ("app/about/page.tsx", "/about"), ("pages/blog/index.tsx", "/blog"), ("app/routes/shop.$id.tsx", "/shop/:id")]),
    "mounted_routers": (
        {"src/app.ts": 'import a from "./r0";\napp.use("/p0", a);\n'} | {f"src/r{i}.ts": f'import a from "./r{i + 1}";\nr.use("/p{i + 1}", a);\nexport default r;\n' for i in range(10)} | {"src/r10.ts": 'r.get("/end", h);\nexport default r;\n'},
        lambda e: e.server_route_list(), ["file", "route"], [("src/r10.ts", "/" + "/".join(f"p{i}" for i in range(11)) + "/end")],
    ),
    "long_arguments": ({"src/a.ts": "f(" + '"' + "x" * 5000 + '", 2);\nfetch("/y", { headers: { k: "' + "z" * 500 + '" }, method: "PUT" });\n'}, lambda e: e._each("calls").select("callee", F.size("args").alias("n")), ["callee", "n"], [("f", 2), ("fetch", 2)]),
    "workspace_manifests": ({"package.json": package("r", workspaces=["packages/*"]), "packages/a/package.json": package("a", "b")}, lambda e: e.packages.select("name", "dir", F.size("dependencies").alias("n")), ["name", "dir", "n"], [("r", "", 0), ("a", "packages/a", 1)]),
    "lockfile_packages": ({"package-lock.json": '{"packages": {"node_modules/a": {"version": "2"}}}', "pnpm-lock.yaml": "lockfileVersion: '9.0'\npackages:\n  b@1.0.0:\n    resolution: {integrity: x}\n"}, lambda e: S.lockfile_packages(e.files), ["path", "name", "version"], [("package-lock.json", "a", "2"), ("pnpm-lock.yaml", "b", "1.0.0")]),
    "markdown_links": ({"docs/a.md": "# T\n\n[b](b.md) and [c](/c.md)\n\n[x](https://x.y)\n"}, lambda e: e.links, ["text", "target", "line"], [("b", "docs/b.md", 3), ("c", "c.md", 3)]),
    "suppressions": ({"src/a.ts": "// my-tool-disable-file\nf(); // my-tool-disable-line some-rule\n"}, lambda e: e.directives.select("scope", F.coalesce("rule", F.lit("")).alias("rule"), "line"), ["scope", "rule", "line"], [("file", "", 1), ("line", "some-rule", 2)]),
}


def _literal(value) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _sql(columns: list[str], rows: list[tuple]) -> str:
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({names})"


def _query(files: dict[str, str], ask: Callable[[Engine], DataFrame], columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A fixed snapshot: the tables of sf_dir hold no repository."""
        return ask(Engine(spark, S.from_rows(spark, files))).select(*columns)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _family, (_files, _rows) in EDGE_CASES.items():
    QUERIES[f"edge_{_family.replace('-', '_')}"] = _query(_files, lambda e, f=_family: e.producers()[f].distinct(), ["src", "dst", "kind"])
    ORACLES[f"edge_{_family.replace('-', '_')}"] = _sql(["src", "dst", "kind"], _rows)
for _name, (_files, _ask, _columns, _rows) in REPORT_CASES.items():
    QUERIES[f"report_{_name}"] = _query(_files or {"x": ""}, _ask, _columns)
    ORACLES[f"report_{_name}"] = _sql(_columns, _rows)
for _name, (_options, _files, _found) in RULE_CASES.items():
    QUERIES[f"rule_{_name.replace('-', '_')}"] = _query(_files, lambda e, n=_name, o=_options: e.check({n: o}).select("file", F.coalesce("line", F.lit(0)).alias("line")), ["file", "line"])
    ORACLES[f"rule_{_name.replace('-', '_')}"] = _sql(["file", "line"], _found)
