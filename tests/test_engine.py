import pytest
from corpus import FILES

from codeloom.operators import rules
from codeloom.plans.engine import Engine
from codeloom.sources import repository as S


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, S.visible(S.from_rows(spark, FILES)))


def pairs(df):
    return {(r.src, r.dst) for r in df.collect()}


def test_skipped_folders(engine):
    seen = {r.path for r in engine.files.select("path").collect()}
    assert "node_modules/x/index.ts" not in seen and ".github/workflows/ci.yml" in seen


def test_edges(engine):
    made = engine.producers()
    core = "packages/core/src/"
    assert (core + "helper.ts", core + "lazy.ts") in pairs(made["import"]) and ("src/alias.ts", core + "lazy.ts") in pairs(made["import"])
    assert pairs(made["workspace"]) == {(core + "index.ts", "packages/util/src/index.ts"), (core + "index.ts", "packages/util/src/deep.ts")}
    assert pairs(made["test"]) == {(core + "helper.test.ts", core + "helper.ts")}
    assert pairs(made["http"]) == {("src/client.tsx", "src/router.ts")}
    assert ("queue:mail:send", "src/worker.ts") in pairs(made["queue"])
    assert pairs(made["md"]) == {("docs/README.md", "docs/guide.md")}
    assert pairs(made["layout"]) == {("app/users/[id]/page.tsx", "app/layout.tsx")}
    assert pairs(made["route-test"]) == {("e2e/users.spec.ts", "app/users/[id]/page.tsx")}
    assert pairs(made["terraform-output"]) == {("infra/main.tf", "infra/net/out.tf")}
    assert ("go/b.go", "go/a.go") in pairs(made["lang-ref"]) and ("py/app/views.py", "py/app/models.py") in pairs(made["lang-import"])
    assert pairs(made["rust-mod"]) == {("rust/src/lib.rs", "rust/src/inner.rs")}
    wf = ".github/workflows/ci.yml"
    assert pairs(made["workflow-artifact"]) == {(wf + "#job:test", wf + "#job:build")} and pairs(made["workflow-run"]) == {(wf + "#job:build", "src/server.ts")}


def test_traversals(engine):
    got = {r.id: (r.depth, r.via) for r in engine.dependencies("packages/core/src/index.ts").collect()}
    assert got["packages/util/src/deep.ts"] == (1, ["import", "workspace"]) and got["packages/core/src/types.ts"] == (2, ["type-import"]) and got["left-pad"][0] == 2
    assert {r.id for r in engine.dependencies("packages/core/src/index.ts", depth=1, relationships=["workspace"]).collect()} == {"packages/util/src/index.ts", "packages/util/src/deep.ts"}
    folded = {r.id: r.depth for r in engine.dependencies("packages/core/src/index.ts", filters=["packages/util/"]).collect()}
    assert folded["packages/util/"] == 1
    by_symbol = {r.id: r.depth for r in engine.dependents("packages/core/src/helper.ts#helper").collect()}
    assert by_symbol["packages/core/src/helper.test.ts"] == 1
    with pytest.raises(ValueError):
        engine.dependencies("a.ts#b")


def test_reports(engine):
    assert {(r.file, r.name) for r in engine.dead_exports().collect()} >= {("packages/util/src/index.ts", "unused")}
    assert {tuple(r) for r in engine.queue_check().collect()} == {("mail", "lost", "producer")}
    c = engine.server_contracts().collect()
    assert [(r.matched_route, r.missing_params) for r in c] == [("/api/users/:id", ["sort"])]
    calls = sorted((r.line, r.arg_count, r.has_spread) for r in engine.call_sites("packages/core/src/helper.ts", "helper").collect())
    assert calls == [(2, 2, False), (3, 1, True), (4, 0, False)]
    status = {r.specifier: r.status for r in engine.resolve_check().collect()}
    assert status["left-pad"] == "external" and status["./helper.js"] == "resolved" and status["#lib/lazy"] == "resolved"
    assert {(r.code, r.subject) for r in engine.ci_diagnostics().collect()} == {("missing-need", "ghost")}
    assert [r.trigger for r in engine.ci_impact(["src/router.ts"]).collect()] == ["matched"] and engine.ci_impact(["src/card.tsx"]).count() == 0
    react = {r.name: r for r in engine.react_analyze().collect()}
    assert react["Users"].inherits_state and not react["Users"].state
    plan = engine.tests_plan(["packages/core/src/types.ts"]).collect()
    assert [(r.test, r.group, r.confidence) for r in plan] == [("packages/core/src/helper.test.ts", "dependencies", "high")]
    assert "helper.test.ts" in engine.tests_comment(engine.tests_plan(["packages/core/src/types.ts"]))
    assert engine.tests_plan(["packages/core/src/helper.test.ts"], {"direct": {"files": 1}}).count() == 1
    assert engine.queue_edges().where("job = 'send'").count() == 1
    assert engine.analyze_project(["fetches", "import_usages"])["fetches"].count() == 1
    before = S.from_rows(engine.spark, {"package-lock.json": '{"packages": {"node_modules/a": {"version": "1"}}}'})
    assert [tuple(r) for r in engine.lockfile_diff(before).collect()] == [("a", "removed")]


WANTED = {
    "no-git-identity-mutation": "scripts/id.sh", "rust-no-inline-allows": "rust/src/lib.rs", "rust-no-inline-tests": "rust/src/inner.rs", "test-no-error-message-matching": "packages/core/src/helper.test.ts",
    "github-actions-job-timeouts": ".github/workflows/ci.yml", "github-actions-pinned-hash": ".github/workflows/ci.yml", "markdown-mermaid-validation": "docs/README.md", "no-empty-or-comments-only-files": "scripts/empty.py",
    "package-json-registry-only": "package.json", "postgres-constraint-validate": "db/schema.sql", "postgres-fk-index": "db/schema.sql", "postgres-lock-ordering": "db/schema.sql",
    "postgres-no-generated-column-writes": "db/schema.sql", "postgres-redundant-index": "db/schema.sql", "tsconfig-gate-coverage": "tsconfig.json", "vitest-test-correspondence": "e2e/users.spec.ts",
    "workspace-package-cycles": "packages/core/package.json", "playwright-unique-test-ids": "src/card.tsx", "production-dependency-declarations": "packages/core/src/helper.ts",
}


@pytest.mark.parametrize("name", sorted(WANTED))
def test_rules_find(engine, name):
    assert WANTED[name] in {r.file for r in engine.check({name: {}}).collect()}


def test_rules_with_options(engine):
    found = lambda name, **o: {r.file for r in engine.check({name: o}).collect()}
    assert found("banned-paths", paths=["docs/**"]) == {"docs/README.md", "docs/guide.md", "docs/orphan.md"}
    assert found("markdown-reachability", roots=["docs/README.md"], targets=["docs/**"]) == {"docs/orphan.md"}
    assert found("forbidden-dependencies", roots=["packages/core/src/index.ts"], forbidden=["packages/util/**"]) == {"packages/util/src/index.ts", "packages/util/src/deep.ts"}
    assert found("file-extension-policy", banned=["sql"]) == {"db/schema.sql"}
    assert found("required-doc-section", include=["docs/*.md"], heading="Docs") == {"docs/guide.md", "docs/orphan.md"}
    assert found("agents-md-max-size", include=["docs/README.md"], maxLines=3) == {"docs/README.md"}
    assert found("structured-config-policy", include=["package.json"], required=["name", "license"]) == {"package.json"}
    assert found("require-test-per-subdir", roots=["packages"]) == {"packages/util"}
    assert found("unique-exports") == set()


LINT = {
    "a.test.ts": "import './b';\n",
    "m.test.ts": "vi.mock('./x', () => ({}));\nlet shared = 1;\nexpect(l).toBeVisible({ timeout: 20_000 });\npage.locator('.css');\n",
    "c.tsx": "export const metadata = {};\nexport function Card(props) { save(); fetch(u, { method: m }); return <button data-test=\"Bad Name\" onClick={() => 1}>{children ?? x}</button>; }\n",
    "d.tsx": "export function Plain() { return <a href='x'>y</a>; }\nconst f = (x) => g(x);\nconst t = options.a ?? 1;\n",
    "e.ts": "async function f(ids) { await Promise.all(ids.map((i) => db.query(i))); }\n",
}


@pytest.mark.parametrize(
    "name, options, file",
    [
        ("async-call-disposition", {"calls": ["save"]}, "c.tsx"), ("module-mock-boundary", {"banned": ["./x"]}, "m.test.ts"), ("module-mock-preserve-exports", {}, "m.test.ts"), ("vitest-mock-test-file-naming", {}, "m.test.ts"),
        ("nextjs-metadata-exports-location", {}, "c.tsx"), ("nextjs-static-fetch-method", {}, "c.tsx"), ("no-global-fetch-outside-helper", {}, "c.tsx"), ("no-import-only-test-files", {}, "a.test.ts"),
        ("playwright-assertion-timeout-cap", {}, "m.test.ts"), ("playwright-consistent-attribute", {}, "c.tsx"), ("playwright-naming-convention", {}, "c.tsx"), ("playwright-require-interactive-test-id", {}, "d.tsx"),
        ("playwright-require-exported-component-attribute", {}, "d.tsx"), ("playwright-selector-priority", {}, "m.test.ts"), ("postgres-no-unbounded-query-fanout", {}, "e.ts"), ("test-no-shared-state", {}, "m.test.ts"),
        ("react-no-nullish-react-node", {}, "c.tsx"), ("ts-no-function-aliases", {}, "d.tsx"), ("ts-preserve-null-option-defaults", {}, "d.tsx"), ("no-banned-import-outside-allowed-paths", {"bans": []}, None),
    ],
)
def test_lint_rules(lint, name, options, file):
    assert {r.file for r in lint.check({name: options}).collect()} == ({file} if file else set())


@pytest.fixture(scope="module")
def lint(spark):
    return Engine(spark, S.from_rows(spark, LINT))


def test_suppression(spark):
    e = Engine(spark, S.from_rows(spark, {"a.tsx": "// any-tool-disable-next-line nextjs-no-manual-script-tags\nconst a = <script>;\nconst b = <script>;\n"}))
    assert [r.line for r in e.check({"nextjs-no-manual-script-tags": {}}).collect()] == [3]


def test_every_rule_runs_on_an_empty_snapshot(spark):
    e = Engine(spark, S.from_rows(spark, {"x": ""}))
    rules.register_repeats()
    assert len(rules.RULES) >= 100
    for name in ("unique-exports", "postgres-fk-index", "github-actions-job-timeouts", "markdown-reachability", "workspace-package-cycles"):
        assert e.check({name: {}}).count() == 0


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("import './b'\n")
    (tmp_path / "bad.ts").write_bytes(b"\xff\xfe")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist/x.js").write_text("")
    rows = {r.path: r for r in S.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/a.ts", "bad.ts"} and rows["bad.ts"].error == "not UTF-8" and rows["src/a.ts"].content.startswith("import")


def test_mermaid_and_json(spark):
    df = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y")], "src string, dst string, kind string")
    assert '"x, y"' in S.mermaid(df) and S.to_json(df).count("src") == 2


def test_stream(spark, tmp_path):
    import json

    from codeloom.streaming import changes

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"path": "a.ts", "ext": "ts", "tracked": True, "content": "x", "error": None}))
    q = changes.each_batch(changes.watch(spark, str(tmp_path / "in")), lambda f: f.select("path"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert [r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a.ts"]


def test_star_exports(spark):
    from codeloom.operators.resolve import star_exports

    rows = [
        ("a", "own", None, False), ("a", None, "b", True), ("a", None, "c", True), ("b", "x", None, False), ("b", "own", None, False), ("b", "default", None, False),
        ("c", "y", None, False), ("c", "both", None, False), ("b", "both", None, False), ("top", None, "a", True), ("loop", None, "top", True), ("top", None, "loop", True),
    ]
    got = {(r.file, r.name): r.origin for r in star_exports(spark.createDataFrame(rows, "file string, name string, target string, star boolean")).collect()}
    assert got[("a", "own")] == "a" and got[("a", "x")] == "b" and got[("top", "y")] == "c" and got[("loop", "x")] == "b"
    assert ("a", "both") not in got and ("a", "default") not in got
