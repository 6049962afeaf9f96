"""A small repository that has a little of everything."""

FILES = {
    "package.json": '{"name": "root", "workspaces": ["packages/*"], "dependencies": {"left-pad": "1.0.0", "weird": "git+ssh://x/y"}}',
    "packages/core/package.json": '{"name": "@app/core", "main": "src/index.ts", "dependencies": {"@app/util": "workspace:*"}}',
    "packages/util/package.json": '{"name": "@app/util", "exports": {".": "./src/index.ts", "./deep": "./src/deep.ts"}, "dependencies": {"@app/core": "workspace:*"}}',
    "packages/util/src/index.ts": "export const pad = (x: string) => x;\nexport const unused = 1;\n",
    "packages/util/src/deep.ts": "export function deep() { return 1; }\n",
    "packages/core/src/index.ts": 'import { pad } from "@app/util";\nimport { deep } from "@app/util/deep";\nexport { helper } from "./helper.js";\nexport function run() { return pad("x") + deep(); }\n',
    "packages/core/src/helper.ts": 'import lp from "left-pad";\nimport type { T } from "./types";\nexport function helper(...a: number[]) { return lp(String(a)); }\nexport async function lazy() { return import("./lazy"); }\n',
    "packages/core/src/types.ts": "export type T = string;\n",
    "packages/core/src/lazy.ts": "export const late = 1; // import './never'\n",
    "packages/core/src/helper.test.ts": 'import { helper } from "./helper";\nhelper(1, 2);\nhelper(...[3]);\nexpect(() => helper()).toThrow("x");\n',
    "src/server.ts": 'import router from "./router";\napp.use("/api", router);\n',
    "src/router.ts": 'const r = Router();\nr.get("/users/:id", (req, res) => res.json(req.query.page));\nexport default r;\n',
    "src/client.tsx": '"use client";\nexport function Users(props) { fetch(`/api/users/${id}?page=1&sort=2`); return <div data-testid="users"><Card /></div>; }\n',
    "src/card.tsx": 'export const Card = memo(({ x }) => { const [a] = useState(0); return <p data-testid="users">{a}</p>; });\n',
    "src/queue.ts": 'const q = new Queue("mail");\nq.add("send", {});\nq.add("lost", {});\n',
    "src/worker.ts": 'new Worker("mail", async (job) => { switch (job.name) { case "send": break; } });\n',
    "app/users/[id]/page.tsx": "export default function Page() { return null; }\n",
    "app/layout.tsx": "export default function Layout() { return null; }\n",
    "e2e/users.spec.ts": 'test("x", async ({ page }) => { await page.goto("/users/1"); await page.getByTestId("users").click(); });\n',
    "docs/README.md": "# Docs\n\n[guide](guide.md) and [web](https://x.y)\n\n```mermaid\nflowchart LR\n a --> b\n```\n\n```mermaid\nnonsense\n```\n",
    "docs/guide.md": "# Guide\n",
    "docs/orphan.md": "# Orphan\n",
    "tsconfig.json": '{"compilerOptions": {"paths": {"#lib/*": ["./packages/core/src/*"]}}}',
    "src/alias.ts": 'import { late } from "#lib/lazy";\nexport const z = late;\n',
    ".github/workflows/ci.yml": "name: CI\non:\n  push:\n    paths: ['src/**', '!src/card.tsx']\njobs:\n  build:\n    runs-on: x\n    steps:\n      - uses: actions/checkout@v4\n      - run: node src/server.ts\n      - uses: actions/upload-artifact@v4\n        with: {name: out}\n  test:\n    needs: [build, ghost]\n    timeout-minutes: 5\n    steps:\n      - uses: actions/download-artifact@v4\n        with: {name: out}\n",
    "db/schema.sql": "CREATE TABLE users (id bigint PRIMARY KEY, team_id bigint REFERENCES teams(id), full_name text GENERATED ALWAYS AS (name) STORED);\nCREATE INDEX users_a ON users (a);\nCREATE INDEX users_ab ON users (a, b);\nALTER TABLE users ADD CONSTRAINT c1 CHECK (a > 0) NOT VALID;\nUPDATE users SET full_name = 'x' WHERE id = 1;\nSELECT * FROM users WHERE id IN (1, 2) FOR UPDATE;\n",
    "infra/main.tf": 'module "net" {\n  source = "./net"\n}\nresource "aws_instance" "web" {\n  subnet = module.net.subnet_id\n  ami = var.ami\n}\nvariable "ami" {}\n',
    "infra/net/out.tf": 'output "subnet_id" {\n  value = 1\n}\n',
    "py/app/models.py": "class User:\n    pass\n",
    "py/app/views.py": "from .models import User\nimport py.app.models\n\n@app.route('/hello')\ndef hello():\n    User()\n    send_mail.delay(1)\n",
    "py/app/tasks.py": "@shared_task\ndef send_mail(x):\n    pass\n",
    "go/a.go": "package shop\n\nfunc Buy() {}\ntype Cart struct{}\n",
    "go/b.go": 'package shop\n\nimport "fmt"\n\nfunc f(c Cart) { fmt.Println(c) }\n',
    "rust/src/lib.rs": "mod inner;\nuse crate::inner::{Thing, other::*};\n#[allow(dead_code)]\nfn x() {}\n",
    "rust/src/inner.rs": "pub struct Thing;\n#[cfg(test)]\nmod tests {}\n",
    "scripts/empty.py": "# nothing\n",
    "scripts/id.sh": "git config user.name bot\n",
    "broken.ts": "export const ok = (((;\n",
    "node_modules/x/index.ts": "export const hidden = 1;\n",
}
