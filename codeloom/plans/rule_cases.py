"""Small snapshots for every rule: what it is given and which findings a reader of the files expects, written by hand."""

from __future__ import annotations

WF = ".github/workflows/ci.yml"


def package(name: str, *dependencies: str, **more) -> str:
    import json

    return json.dumps({"name": name, "dependencies": dict.fromkeys(dependencies, "*")} | more)


#: rule: (options, {path: content}, [(file, line; 0 for the whole file)]).
RULE_CASES: dict[str, tuple[dict, dict[str, str], list[tuple[str, int]]]] = {
    "agents-md-max-size": ({"maxLines": 2}, {"AGENTS.md": "a\nb\nc\n", "docs/CLAUDE.md": "a\n"}, [("AGENTS.md", 0)]),
    "banned-paths": ({"paths": ["tmp/**"]}, {"tmp/a.txt": "x", "src/a.txt": "x"}, [("tmp/a.txt", 0)]),
    "banned-renamed-files": ({"renames": {"middleware.ts": "proxy.ts"}}, {"src/middleware.ts": "", "src/proxy.ts": ""}, [("src/middleware.ts", 0)]),
    "config-path-references": ({"include": ["c/conf.json"]}, {"c/conf.json": '{"a": "./src/x.ts", "b": "./src/gone.ts"}', "c/src/x.ts": ""}, [("c/conf.json", 0)]),
    "csharp-max-lines-per-file": ({"max": 2}, {"src/A.cs": "a\nb\nc\n", "src/B.cs": "a\nb\n"}, [("src/A.cs", 0)]),
    "doc-consistency": ({"documents": {"d/a.md": {"required": ["must"], "banned": ["never"]}, "d/b.md": {}}}, {"d/a.md": "never say"}, [("d/a.md", 0), ("d/a.md", 0), ("d/b.md", 0)]),
    "file-extension-policy": ({"banned": ["js"]}, {"src/a.js": "", "src/b.ts": ""}, [("src/a.js", 0)]),
    "finite-set-consistency": ({"left": {"files": ["s/a.txt"], "pattern": r"id=(\w+)"}, "right": {"files": ["s/b.txt"], "pattern": r"id=(\w+)"}}, {"s/a.txt": "id=x id=y", "s/b.txt": "id=y id=z"}, [("s/a.txt", 0), ("s/a.txt", 0)]),
    "forbidden-dependencies": ({"roots": ["src/a.ts"], "forbidden": ["lib/**"]}, {"src/a.ts": "import './b';\n", "src/b.ts": "import '../lib/c';\n", "lib/c.ts": "", "lib/d.ts": ""}, [("lib/c.ts", 0)]),
    "forbidden-workspace-closure": ({"packages": ["a"], "forbidden": ["c"]}, {"p/a/package.json": package("a", "b"), "p/b/package.json": package("b", "c"), "p/c/package.json": package("c")}, [("p/a/package.json", 0)]),
    "github-actions-action-timeout-pair": ({"actions": ["actions/cache"]}, {WF: "on: push\njobs:\n  a:\n    steps:\n      - uses: actions/cache@v4\n      - uses: actions/cache@v4\n        timeout-minutes: 2\n"}, [(WF, 0)]),
    "github-actions-composite-step-schema": ({}, {"act/action.yml": "runs:\n  using: composite\n  steps:\n    - run: x\n      shell: sh\n      timeout-minutes: 3\n"}, [("act/action.yml", 0)]),
    "github-actions-job-timeouts": ({}, {WF: "on: push\njobs:\n  a:\n    steps: []\n  b:\n    timeout-minutes: 5\n    steps: []\n"}, [(WF, 0)]),
    "github-actions-pinned-hash": ({}, {WF: "on: push\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n      - uses: ./local\n"}, [(WF, 5)]),
    "github-actions-test-timeout-literals": ({}, {"t/a.test.ts": "expect(job['timeout-minutes']).toBe(30);\n"}, [("t/a.test.ts", 1)]),
    "integration-test-no-mocks": ({}, {"t/a.integration.ts": "x();\nvi.mock('./b');\n", "t/a.test.ts": "vi.mock('./b');\n"}, [("t/a.integration.ts", 2)]),
    "lockfile-allowlist": ({"allow": ["package-lock.json"]}, {"package-lock.json": "{}", "sub/yarn.lock": ""}, [("sub/yarn.lock", 0)]),
    "markdown-child-links": ({"parents": {"docs/README.md": "docs/*.md"}}, {"docs/README.md": "[a](a.md)\n", "docs/a.md": "# A\n", "docs/b.md": "# B\n"}, [("docs/README.md", 0)]),
    "markdown-eval-tests": ({}, {"t/a.test.ts": "const md = read('x.md');\nspawn('bash', ['-c', 'eval x']);\n", "t/b.test.ts": "const md = read('x.md');\n"}, [("t/a.test.ts", 0)]),
    "markdown-link-display-text": ({}, {"docs/a.md": "[b.md](c.md)\n[c.md](c.md)\n[the c](c.md)\n", "docs/c.md": ""}, [("docs/a.md", 1)]),
    "markdown-mermaid-validation": ({}, {"docs/a.md": "```mermaid\nnonsense\n```\n\n```mermaid\nflowchart LR\n a --> b\n```\n"}, [("docs/a.md", 1)]),
    "markdown-reachability": ({"roots": ["docs/README.md"], "targets": ["docs/**"]}, {"docs/README.md": "[a](a.md)\n", "docs/a.md": "[b](sub/b.md)\n", "docs/sub/b.md": "", "docs/orphan.md": ""}, [("docs/orphan.md", 0)]),
    "markdown-structure-budget": ({"maxLines": 3, "maxTables": 0}, {"docs/a.md": "# A\n\n|a|b|\n|-|-|\n|1|2|\n", "docs/b.md": "# B\n"}, [("docs/a.md", 0)]),
    "nextjs-no-api-routes": ({}, {"pages/api/x.ts": "", "app/y/route.ts": "", "app/y/page.tsx": ""}, [("pages/api/x.ts", 0), ("app/y/route.ts", 0)]),
    "nextjs-no-caching": ({}, {"src/a.ts": "export const x = 1;\nexport const revalidate = 60;\n"}, [("src/a.ts", 2)]),
    "nextjs-redirect-destinations": ({}, {"next.config.js": "module.exports = { r: [{ destination: '/gone' }, { destination: '/users' }] };\n", "app/users/page.tsx": ""}, [("next.config.js", 0)]),
    "no-empty-or-comments-only-files": ({}, {"src/a.py": "# c\n", "src/b.py": "x = 1\n", "src/c.ts": ""}, [("src/a.py", 0), ("src/c.ts", 0)]),
    "no-git-identity-mutation": ({}, {"s/a.sh": "set -e\ngit config user.name bot\n"}, [("s/a.sh", 2)]),
    "no-raw-ephemeral-port": ({}, {"s/a.ts": "server.listen(0);\nserver.listen(8080);\n"}, [("s/a.ts", 1)]),
    "package-json-registry-only": ({}, {"package.json": '{"name": "r", "dependencies": {"x": "git+ssh://a/b", "y": "1.0.0"}}'}, [("package.json", 0)]),
    "package-json-workspace-coverage": ({}, {"package.json": package("r", workspaces=["packages/*"]), "packages/a/package.json": package("a"), "other/b/package.json": package("b")}, [("other/b/package.json", 0)]),
    "playwright-coverage": ({}, {"src/c.tsx": 'const a = <p data-testid="seen" />;\nconst b = <p data-testid="unseen" />;\n', "e/a.spec.ts": 'page.getByTestId("seen");\n'}, [("src/c.tsx", 2)]),
    "playwright-prefer-test-id-locators": ({}, {"src/c.tsx": 'const a = <p data-testid="Save" />;\n', "e/a.spec.ts": 'page.getByText("Other");\npage.getByText("Save");\n'}, [("e/a.spec.ts", 2)]),
    "playwright-unique-html-ids": ({}, {"src/a.tsx": 'const a = <p id="x" />;\n', "src/b.tsx": 'const a = <p id="y" />;\nconst b = <p id="x" />;\n'}, [("src/a.tsx", 1), ("src/b.tsx", 2)]),
    "playwright-unique-test-ids": ({}, {"src/a.tsx": 'const a = <p data-testid="x" />;\n', "src/b.tsx": 'const b = <p data-testid="x" />;\n'}, [("src/a.tsx", 1), ("src/b.tsx", 1)]),
    "postgres-constraint-validate": ({}, {"db/s.sql": "ALTER TABLE t ADD CONSTRAINT c1 CHECK (a > 0) NOT VALID;\nALTER TABLE t ADD CONSTRAINT c2 CHECK (a > 0) NOT VALID;\nALTER TABLE t VALIDATE CONSTRAINT c2;\n"}, [("db/s.sql", 1)]),
    "postgres-fk-index": ({}, {"db/s.sql": "CREATE TABLE a (id bigint PRIMARY KEY, b_id bigint REFERENCES b(id), c_id bigint REFERENCES c(id));\nCREATE INDEX a_b ON a (b_id);\n"}, [("db/s.sql", 1)]),
    "postgres-lock-ordering": ({}, {"db/s.sql": "SELECT * FROM t WHERE id IN (1, 2) FOR UPDATE;\nSELECT * FROM t WHERE id IN (1, 2) ORDER BY id FOR UPDATE;\n"}, [("db/s.sql", 1)]),
    "postgres-no-generated-column-writes": ({}, {"db/s.sql": "CREATE TABLE u (id bigint PRIMARY KEY, n text GENERATED ALWAYS AS (name) STORED);\nUPDATE u SET n = 'x' WHERE id = 1;\n"}, [("db/s.sql", 2)]),
    "postgres-redundant-index": ({}, {"db/s.sql": "CREATE INDEX ia ON t (a);\nCREATE INDEX iab ON t (a, b);\n"}, [("db/s.sql", 1)]),
    "production-dependency-declarations": ({}, {"package.json": '{"name": "r", "dependencies": {"p": "1"}, "devDependencies": {"d": "1"}}', "src/a.ts": "import 'd';\nimport 'u';\nimport 'p';\n", "src/a.test.ts": "import 'd';\n"}, [("src/a.ts", 1), ("src/a.ts", 2)]),
    "require-files-in-subdirs": ({"directories": ["pkg/*"], "required": ["README.md"]}, {"pkg/a/README.md": "", "pkg/a/x.ts": "", "pkg/b/x.ts": ""}, [("pkg/b", 0)]),
    "require-storybook-stories": ({}, {"src/components/A.tsx": "export function A() { return <p />; }\n", "src/components/B.tsx": "export function B() { return <p />; }\n", "src/components/A.stories.tsx": "import { A } from './A';\n"}, [("src/components/B.tsx", 0)]),
    "require-test-per-subdir": ({"roots": ["packages"]}, {"packages/a/x.ts": "", "packages/a/x.test.ts": "", "packages/b/y.ts": ""}, [("packages/b", 0)]),
    "required-companion-imports": ({"include": ["src/*.ts"], "exclude": ["src/*.test.ts"]}, {"src/a.ts": "", "src/a.test.ts": "import './a';\n", "src/b.ts": "", "src/b.test.ts": "import './a';\n"}, [("src/b.ts", 0)]),
    "required-doc-section": ({"include": ["docs/*.md"], "heading": "Usage"}, {"docs/a.md": "# A\n\n## usage\n", "docs/b.md": "# B\n"}, [("docs/b.md", 0)]),
    "required-entrypoint-reachability": ({"entrypoints": ["src/main.ts"], "sourceGlobs": ["src/*.ts"]}, {"src/main.ts": "import './a';\n", "src/a.ts": "", "src/b.ts": ""}, [("src/b.ts", 0)]),
    "required-local-docs": ({"include": ["src/**"]}, {"src/a/x.ts": "", "src/a/README.md": "", "src/b/y.ts": ""}, [("src/b", 0)]),
    "rust-max-lines-per-file": ({"max": 2}, {"src/a.rs": "a\nb\nc\n", "src/b.rs": "a\n"}, [("src/a.rs", 0)]),
    "rust-no-inline-allows": ({}, {"src/a.rs": "fn y() {}\n#[allow(dead_code)]\nfn x() {}\n"}, [("src/a.rs", 2)]),
    "rust-no-inline-tests": ({}, {"src/a.rs": "#[cfg(test)]\nmod tests {}\n", "src/b.rs": "#[cfg(test)]\nmod tests;\n"}, [("src/a.rs", 0)]),
    "server-route-client-boundary": ({}, {"src/routes/a.ts": '"use client";\nexport const x = 1;\n', "src/routes/b.ts": "app.get('/x', h);\n"}, [("src/routes/a.ts", 0)]),
    "strict-package-layout": ({"roots": ["pkg"], "allowed": ["src/**", "package.json"]}, {"pkg/a/src/x.ts": "", "pkg/a/package.json": "{}", "pkg/a/junk.txt": ""}, [("pkg/a/junk.txt", 0)]),
    "structured-config-policy": ({"include": ["c/app.json"], "required": ["name", "license"], "values": {"type": "module"}}, {"c/app.json": '{"name": "x", "type": "commonjs"}'}, [("c/app.json", 0), ("c/app.json", 0)]),
    "test-email-domain-policy": ({"banned": ["corp.com"]}, {"t/a.test.ts": "// a@example.com\n// b@corp.com\n"}, [("t/a.test.ts", 2)]),
    "test-no-dependency-pins": ({}, {"t/a.test.ts": "expect(x).toBe('left-pad');\nexpect(x).toBe('left-pad@1.2.3');\n"}, [("t/a.test.ts", 2)]),
    "test-no-unmocked-dynamic-imports": ({}, {"t/a.test.ts": "await import('./x');\nvi.mock('./y');\nawait import('./y');\n", "t/x.ts": "", "t/y.ts": ""}, [("t/a.test.ts", 1)]),
    "tsconfig-alias-folder-mapping": ({}, {"tsconfig.json": '{"compilerOptions": {"paths": {"#a/*": ["./src/*"], "#b/*": ["./gone/*"]}}}', "src/x.ts": ""}, [("tsconfig.json", 0)]),
    "tsconfig-file-coverage": ({"include": ["src/**"]}, {"src/a.ts": "", "tools/b.ts": ""}, [("tools/b.ts", 0)]),
    "tsconfig-gate-coverage": ({}, {"tsconfig.json": "{}", "tsconfig.build.json": "{}", WF: "on: push\njobs:\n  a:\n    steps:\n      - run: tsc -p tsconfig.build.json\n"}, [("tsconfig.json", 0)]),
    "unique-exports": ({}, {"src/a.ts": "export const x = 1;\n", "src/b.ts": "export const y = 1;\nexport const x = 2;\n"}, [("src/b.ts", 2)]),
    "version-pin-consistency": ({"source": {"file": "versions.txt", "pattern": "node ([0-9.]+)"}, "targets": ["docker/*"], "pattern": "node:([0-9.]+)"}, {"versions.txt": "node 20.1.0", "docker/a": "FROM node:20.1.0", "docker/b": "FROM node:18.0.0"}, [("docker/b", 0)]),
    "vitest-ci-path-coverage": ({"include": ["vitest.config.ts", "src/setup.ts"]}, {"vitest.config.ts": "", "src/setup.ts": "", WF: "on:\n  push:\n    paths: ['src/**']\njobs:\n  a:\n    steps: []\n"}, [("vitest.config.ts", 0)]),
    "vitest-project-mapping": ({"projects": {"unit": ["src/*.test.ts"], "all": ["src/b.test.ts"]}}, {"src/a.test.ts": "", "src/b.test.ts": "", "t/c.test.ts": ""}, [("src/b.test.ts", 0), ("t/c.test.ts", 0)]),
    "vitest-test-correspondence": ({}, {"src/a.ts": "", "src/a.test.ts": "", "src/b.test.ts": ""}, [("src/b.test.ts", 0)]),
    "workspace-package-cycles": ({}, {"p/a/package.json": package("a", "b"), "p/b/package.json": package("b", "a"), "p/c/package.json": package("c", "a")}, [("p/a/package.json", 0), ("p/b/package.json", 0)]),
    "async-call-disposition": ({"calls": ["save"]}, {"src/a.ts": "save();\nawait save();\nconst p = save();\n"}, [("src/a.ts", 1)]),
    "async-try-catch-return-await": ({}, {"src/a.ts": "async function f() { try { return g(); } catch (e) {} }\nasync function h() { try { return await g(); } catch (e) {} }\n"}, [("src/a.ts", 1)]),
    "await-array-methods": ({}, {"src/a.ts": "const x = await ids.map(f);\nconst y = await Promise.all(ids.map(f));\n"}, [("src/a.ts", 1)]),
    "module-mock-boundary": ({"banned": ["./db"]}, {"t/a.test.ts": "vi.mock('./db');\nvi.mock('./ok');\n"}, [("t/a.test.ts", 1)]),
    "module-mock-preserve-exports": ({}, {"t/a.test.ts": "vi.mock('./x', () => ({}));\nvi.mock('./y', async () => ({ ...(await vi.importActual('./y')) }));\n"}, [("t/a.test.ts", 1)]),
    "nextjs-metadata-exports-location": ({}, {"src/c.tsx": "export const metadata = {};\n", "app/page.tsx": "export const metadata = {};\n"}, [("src/c.tsx", 1)]),
    "nextjs-no-manual-script-tags": ({}, {"src/a.tsx": "const a = <script src='x' />;\nconst b = <Script src='x' />;\n"}, [("src/a.tsx", 1)]),
    "nextjs-static-fetch-method": ({}, {"src/a.ts": "fetch(u, { method: m });\nfetch(u, { method: 'POST' });\n"}, [("src/a.ts", 1)]),
    "nextjs-static-fetch-url": ({}, {"src/a.ts": "fetch(url);\nfetch('/x');\n"}, [("src/a.ts", 1)]),
    "no-banned-import-outside-allowed-paths": ({"bans": [{"module": "lodash", "names": ["debounce"], "allowed": ["src/util/**"]}]}, {"src/a.ts": "import { debounce } from 'lodash';\n", "src/b.ts": "import { pick } from 'lodash';\n", "src/util/c.ts": "import { debounce } from 'lodash';\n"}, [("src/a.ts", 1)]),
    "no-delete-property": ({}, {"src/a.ts": "delete o.x;\nmap.delete(o);\n"}, [("src/a.ts", 1)]),
    "no-global-fetch-outside-helper": ({"helpers": ["src/api.ts"]}, {"src/api.ts": "fetch('/x');\n", "src/a.ts": "fetch('/x');\n"}, [("src/a.ts", 1)]),
    "no-import-only-test-files": ({}, {"t/a.test.ts": "import './b';\n", "t/c.test.ts": "import './b';\ntest('x', () => {});\n"}, [("t/a.test.ts", 0)]),
    "no-placeholder-never-type-exports": ({}, {"src/a.ts": "export type X = never;\nexport type Y = string;\n"}, [("src/a.ts", 1)]),
    "no-vitest-sequential": ({}, {"t/a.test.ts": "describe.sequential('x', () => {});\ndescribe('y', () => {});\n"}, [("t/a.test.ts", 1)]),
    "playwright-assertion-timeout-cap": ({}, {"e/a.spec.ts": "await expect(l).toBeVisible({ timeout: 20_000 });\nawait expect(l).toBeVisible({ timeout: 5000 });\n"}, [("e/a.spec.ts", 1)]),
    "playwright-consistent-attribute": ({}, {"src/c.tsx": 'const a = <p data-test="x" />;\nconst b = <p data-testid="y" />;\n'}, [("src/c.tsx", 1)]),
    "playwright-defaults": ({}, {"src/c.tsx": "const a = <p data-testid={testId} />;\nconst b = <p data-testid={testId ?? 'b'} />;\n"}, [("src/c.tsx", 1)]),
    "playwright-literals": ({}, {"src/c.tsx": "const a = <p data-testid={`row-${i}`} />;\nconst b = <p data-testid=\"b\" />;\n"}, [("src/c.tsx", 1)]),
    "playwright-naming-convention": ({}, {"src/c.tsx": 'const a = <p data-testid="Bad Name" />;\nconst b = <p data-testid="good-name" />;\n'}, [("src/c.tsx", 1)]),
    "playwright-no-empty": ({}, {"src/c.tsx": 'const a = <p data-testid="" />;\nconst b = <p data-testid="b" />;\n'}, [("src/c.tsx", 1)]),
    "playwright-no-set-timeout": ({}, {"e/a.spec.ts": "await page.waitForTimeout(100);\nawait page.waitForURL('/x');\n"}, [("e/a.spec.ts", 1)]),
    "playwright-prefer-get-by-test-id": ({}, {"e/a.spec.ts": "page.locator('[data-testid=\"x\"]');\npage.getByTestId('x');\n"}, [("e/a.spec.ts", 1)]),
    "playwright-require-exported-component-attribute": ({}, {"src/d.tsx": "export function Plain() { return <p>x</p>; }\n", "src/e.tsx": 'export function Marked() { return <p data-testid="m">x</p>; }\n'}, [("src/d.tsx", 1)]),
    "playwright-require-interactive-test-id": ({}, {"src/d.tsx": "const a = <button>x</button>;\n", "src/e.tsx": 'const a = <button data-testid="x">x</button>;\n'}, [("src/d.tsx", 0)]),
    "playwright-selector-priority": ({}, {"e/a.spec.ts": "page.locator('.css');\npage.locator('[data-testid=x]');\n"}, [("e/a.spec.ts", 1)]),
    "playwright-unique": ({}, {"src/c.tsx": 'const a = <p data-testid="x" />;\nconst b = <p data-testid="x" />;\n', "src/d.tsx": 'const b = <p data-testid="x" />;\n'}, [("src/c.tsx", 2)]),
    "postgres-no-manual-transaction": ({}, {"src/a.ts": "db.query('BEGIN');\ndb.query('SELECT 1');\n"}, [("src/a.ts", 1)]),
    "postgres-no-unbounded-query-fanout": ({}, {"src/a.ts": "async function f(ids) { await Promise.all(ids.map((i) => db.query(i))); }\nasync function g() { await Promise.all([db.query(1), db.query(2)]); }\n"}, [("src/a.ts", 1)]),
    "react-no-iife-in-jsx": ({}, {"src/a.tsx": "const a = <p>{(() => 1)()}</p>;\nconst b = <p>{f()}</p>;\n"}, [("src/a.tsx", 1)]),
    "react-no-nullish-react-node": ({}, {"src/a.tsx": "const a = <p>{children ?? x}</p>;\nconst b = <p>{count ?? x}</p>;\n"}, [("src/a.tsx", 1)]),
    "react-no-use-promise-resolve": ({}, {"src/a.tsx": "const a = use(Promise.resolve(1));\nconst b = use(promise);\n"}, [("src/a.tsx", 1)]),
    "server-require-nullable-fetch-wrapper": ({"helpers": ["getUser"]}, {"src/a.ts": "const a = getUser(1);\nconst b = nullable(getUser(1));\n"}, [("src/a.ts", 1)]),
    "test-no-error-message-matching": ({}, {"t/a.test.ts": "expect(() => f()).toThrow('x');\nexpect(() => f()).toThrow(RangeError);\n"}, [("t/a.test.ts", 1)]),
    "test-no-shared-state": ({}, {"t/a.test.ts": "let shared = 1;\nconst fine = 2;\n"}, [("t/a.test.ts", 1)]),
    "ts-no-export-renaming": ({}, {"src/a.ts": "export { a as b };\nexport { c };\n"}, [("src/a.ts", 1)]),
    "ts-no-function-aliases": ({}, {"src/a.ts": "const f = (x) => g(x);\nconst h = (x) => g(x, 1);\n"}, [("src/a.ts", 1)]),
    "ts-preserve-null-option-defaults": ({}, {"src/a.ts": "const t = options.a ?? 1;\nconst u = a ?? 1;\n"}, [("src/a.ts", 1)]),
    "vitest-mock-test-file-naming": ({}, {"t/a.test.ts": "vi.mock('./x');\n", "t/b.mock.test.ts": "vi.mock('./x');\n"}, [("t/a.test.ts", 1)]),
}
