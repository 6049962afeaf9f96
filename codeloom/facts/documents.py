"""Facts of structured files: workflows, SQL, Terraform, Markdown, lockfiles, manifests, diffs."""

from __future__ import annotations

import json
import re

import yaml

from codeloom.facts.masking import line_at, strip_comments

EXPRESSION = re.compile(r"\$\{\{(.*?)\}\}", re.S)
REFERENCE = re.compile(r"\b(inputs|secrets|needs|env|vars|github|matrix|steps|jobs|outputs)((?:\.[\w*-]+|\[['\"][^'\"]+['\"]\])+)")


def load(text: str, path: str = ""):
    """JSON (with comments) or YAML as one value tree (S12); YAML's on: key stays a string."""
    if path.endswith((".json", ".jsonc", ".json5")):
        bare = re.sub(r",(\s*[}\]])", r"\1", strip_comments(text, "ts"))
        return json.loads(bare)

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return yaml.load(text, Loader)  # noqa: S506  a safe loader


def references(text) -> list[str]:
    """Context.path of every ${{ }} expression, quoted text apart."""
    out = set()
    for inner in EXPRESSION.findall(str(text)):
        bare = re.sub(r"'(?:[^']|'')*'(?!\])", "''", inner)
        out |= {m[1] + re.sub(r"\[['\"]([^'\"]+)['\"]\]", r".\1", m[2]) for m in REFERENCE.finditer(bare)}
    return sorted(out)


def matrix_instances(matrix) -> int | None:
    """The product of the axes, less exclusions, plus own inclusions; null if it isn't static."""
    if not isinstance(matrix, dict):
        return 1 if matrix is None else None
    axes = {k: v for k, v in matrix.items() if k not in ("include", "exclude")}
    if any(not isinstance(v, list) for v in axes.values()):
        return None
    rows: list[dict] = [{}]
    for k, v in axes.items():
        rows = [r | {k: x} for r in rows for x in v]
    if not axes:
        rows = []
    rows = [r for r in rows if not any(all(r.get(k) == x for k, x in e.items()) for e in matrix.get("exclude") or [])]
    extra = sum(not any(all(r.get(k) == x for k, x in i.items() if k in axes) for r in rows) for i in matrix.get("include") or [])
    return len(rows) + extra


def listed(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def workflow(path: str, text: str) -> dict:
    """Name, triggers, jobs with steps, artifacts and calls of a workflow file."""
    doc = load(text, path) or {}
    on = doc.get("on", {})
    events = {k: (on.get(k) if isinstance(on, dict) else None) or {} for k in (on if isinstance(on, dict) else listed(on))}
    jobs = []
    for name, job in (doc.get("jobs") or {}).items():
        job = job or {}
        steps = []
        for k, s in enumerate(job.get("steps") or []):
            uses, inputs = s.get("uses"), s.get("with") or {}
            kind = "upload" if str(uses or "").startswith("actions/upload-artifact") else "download" if str(uses or "").startswith("actions/download-artifact") else None
            artifact = str(inputs.get("name", inputs.get("pattern", "artifact" if kind == "upload" else "*"))) if kind else None
            steps.append(dict(step=k, name=s.get("name"), uses=uses, run=s.get("run"), timeout=_int(s.get("timeout-minutes")), artifact_kind=kind, artifact=artifact, overwrite=str(inputs.get("overwrite", "false")).lower() == "true", conditional="if" in s, keys=sorted(s), refs=references(s)))
        jobs.append(
            dict(job=str(name), needs=[str(n) for n in listed(job.get("needs"))], uses=job.get("uses"), timeout=_int(job.get("timeout-minutes")), permissions=_permissions(job.get("permissions")), instances=matrix_instances((job.get("strategy") or {}).get("matrix") if isinstance(job.get("strategy"), dict) else None), inputs=sorted((job.get("with") or {})), secrets=sorted(job["secrets"]) if isinstance(job.get("secrets"), dict) else listed(job.get("secrets")), steps=steps)
        )
    paths = {e: [str(p) for p in listed(f.get("paths"))] + ["!" + str(p) for p in listed(f.get("paths-ignore"))] for e, f in events.items() if isinstance(f, dict)}
    ignored = {e: not listed(f.get("paths")) and bool(listed(f.get("paths-ignore"))) for e, f in events.items() if isinstance(f, dict)}
    call = events.get("workflow_call") or {}
    return dict(
        name=doc.get("name"), events=sorted(map(str, events)), paths=[dict(event=e, globs=["**", *g] if ignored[e] else g) for e, g in paths.items()], permissions=_permissions(doc.get("permissions")),
        after=[str(w) for w in listed((events.get("workflow_run") or {}).get("workflows"))], jobs=jobs, env=sorted(map(str, doc.get("env") or {})), refs=references(text),
        inputs=[dict(name=k, required=bool((v or {}).get("required")) and "default" not in (v or {}), type=str((v or {}).get("type", "string"))) for k, v in (call.get("inputs") or {}).items()],
        secrets=[dict(name=k, required=bool((v or {}).get("required")), type="secret") for k, v in (call.get("secrets") or {}).items()],
    )


def _int(value) -> int | None:
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _permissions(value) -> dict | None:
    if value is None:
        return None
    if isinstance(value, str):
        return {"*": value.removesuffix("-all")}
    return {str(k): str(v) for k, v in value.items()}


STEP = "struct<step:int,name:string,uses:string,run:string,timeout:int,artifact_kind:string,artifact:string,overwrite:boolean,conditional:boolean,keys:array<string>,refs:array<string>>"
CONTRACT = "array<struct<name:string,required:boolean,type:string>>"
WORKFLOW_SCHEMA = f"""name string, events array<string>, paths array<struct<event:string,globs:array<string>>>, permissions map<string,string>, after array<string>,
jobs array<struct<job:string,needs:array<string>,uses:string,timeout:int,permissions:map<string,string>,instances:int,inputs:array<string>,secrets:array<string>,steps:array<{STEP}>>>,
env array<string>, refs array<string>, inputs {CONTRACT}, secrets {CONTRACT}"""

NAME = r'((?:"[^"]+"|[\w$]+)(?:\.(?:"[^"]+"|[\w$]+))?)'
TABLE = re.compile(rf"\bCREATE\s+(?:UNLOGGED\s+|TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\(", re.I)
INDEX = re.compile(rf"\bCREATE\s+(UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(?:{NAME}\s+)?ON\s+(?:ONLY\s+)?{NAME}\s*(?:USING\s+(\w+)\s*)?\(", re.I)
FOREIGN = re.compile(rf"\bFOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+{NAME}", re.I)
ALTER = re.compile(rf"\bALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{NAME}\s+([^;]*)", re.I)
CONSTRAINT = re.compile(r'\bADD\s+CONSTRAINT\s+("?[\w$]+"?)\s+(.*)', re.I | re.S)
VALIDATE = re.compile(r'\bVALIDATE\s+CONSTRAINT\s+("?[\w$]+"?)', re.I)
LOCK = re.compile(r"\bSELECT\b[^;]*?\bFOR\s+(?:NO\s+KEY\s+)?UPDATE\b[^;]*", re.I)
WRITE = re.compile(rf"\b(?:INSERT\s+INTO\s+{NAME}\s*\(([^)]*)\)|UPDATE\s+{NAME}\s+SET\s+([^;]*?)(?:\bWHERE\b|;|\Z))", re.I | re.S)
SQL_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


def bare(name: str | None) -> str | None:
    return None if name is None else name.replace('"', "").lower()


def balanced(text: str, at: int) -> int:
    """The place of the bracket that closes the one before `at`."""
    depth = 1
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return i
    return len(text)


def parts(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text + ",":
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
            continue
        depth += (c in "([") - (c in ")]")
        part += c
    return [p for p in out if p]


def sql(path: str, text: str) -> dict:
    """Tables, indexes, foreign keys, constraints, locks and writes of a PostgreSQL file."""
    text = SQL_COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    tables, indexes, foreign, constraints = [], [], [], []
    for m in TABLE.finditer(text):
        table, columns = bare(m[1]), []
        for part in parts(text[m.end() : balanced(text, m.end())]):
            head = part.split()[0].upper()
            line = line_at(text, m.start() + text[m.start() :].find(part))
            if f := FOREIGN.search(part):
                foreign.append(dict(table=table, columns=[bare(c.strip()) for c in f[1].split(",")], target=bare(f[2]), line=line))
            elif head in ("PRIMARY", "UNIQUE", "CONSTRAINT"):
                if key := re.search(r"\b(PRIMARY\s+KEY|UNIQUE)\s*\(([^)]*)\)", part, re.I):
                    indexes.append(dict(name=None, table=table, columns=[bare(c.strip()) for c in key[2].split(",")], unique=True, predicate=None, method="btree", line=line))
            elif head not in ("CHECK", "EXCLUDE", "LIKE"):
                column = bare(part.split()[0])
                columns.append(dict(name=column, generated=bool(re.search(r"\bGENERATED\s+ALWAYS\b", part, re.I))))
                if r := re.search(rf"\bREFERENCES\s+{NAME}", part, re.I):
                    foreign.append(dict(table=table, columns=[column], target=bare(r[1]), line=line))
                if re.search(r"\b(PRIMARY\s+KEY|UNIQUE)\b", part, re.I):
                    indexes.append(dict(name=None, table=table, columns=[column], unique=True, predicate=None, method="btree", line=line))
        tables.append(dict(name=table, columns=columns, line=line_at(text, m.start())))
    for m in INDEX.finditer(text):
        end = balanced(text, m.end())
        where = re.match(r"\s*(?:INCLUDE\s*\([^)]*\)\s*)?(?:WITH\s*\([^)]*\)\s*)?WHERE\s+([^;]*)", text[end + 1 :], re.I)
        columns = [re.sub(r"\s+", " ", c.replace('"', "").lower()).removesuffix(" asc") for c in parts(text[m.end() : end])]
        indexes.append(dict(name=bare(m[2]), table=bare(m[3]), columns=columns, unique=bool(m[1]), predicate=re.sub(r"\s+", " ", where[1].strip().lower()) if where else None, method=(m[4] or "btree").lower(), line=line_at(text, m.start())))
    for m in ALTER.finditer(text):
        table, line = bare(m[1]), line_at(text, m.start())
        for c in parts(m[2]):
            if a := CONSTRAINT.search(c):
                constraints.append(dict(table=table, name=bare(a[1]), not_valid=bool(re.search(r"\bNOT\s+VALID\b", a[2], re.I)), validates=False, line=line))
            if f := FOREIGN.search(c):
                foreign.append(dict(table=table, columns=[bare(x.strip()) for x in f[1].split(",")], target=bare(f[2]), line=line))
            if v := VALIDATE.search(c):
                constraints.append(dict(table=table, name=bare(v[1]), not_valid=False, validates=True, line=line))
    locks = [dict(line=line_at(text, m.start()), many=bool(re.search(r"\bIN\s*\(|=\s*ANY\b", m[0], re.I)), ordered=bool(re.search(r"\bORDER\s+BY\b", m[0], re.I)), skips=bool(re.search(r"\bSKIP\s+LOCKED\b", m[0], re.I))) for m in LOCK.finditer(text)]
    writes = [dict(table=bare(m[1] or m[3]), columns=[bare(c.split("=")[0].strip()) for c in parts(m[2] or m[4])], line=line_at(text, m.start())) for m in WRITE.finditer(text)]
    return dict(tables=tables, indexes=indexes, foreign_keys=foreign, constraints=constraints, locks=locks, writes=writes)


SQL_SCHEMA = """tables array<struct<name:string,columns:array<struct<name:string,generated:boolean>>,line:int>>,
indexes array<struct<name:string,table:string,columns:array<string>,unique:boolean,predicate:string,method:string,line:int>>,
foreign_keys array<struct<table:string,columns:array<string>,target:string,line:int>>,
constraints array<struct<table:string,name:string,not_valid:boolean,validates:boolean,line:int>>,
locks array<struct<line:int,many:boolean,ordered:boolean,skips:boolean>>, writes array<struct<table:string,columns:array<string>,line:int>>"""

BLOCK = re.compile(r'^\s*(resource|data|module|variable|output|locals|provider)\s*(?:"([^"]+)"\s*)?(?:"([^"]+)"\s*)?\{', re.M)
ADDRESS = re.compile(r"(?<![\w.-])((?:data\.)?[a-z][\w-]*\.[\w-]+(?:\.[\w-]+)*)")


def terraform(path: str, text: str) -> dict:
    """Blocks with addresses and what they refer to."""
    code = strip_comments(text, "tf")
    blocks, refs = [], []
    found = list(BLOCK.finditer(code))
    for m, n in zip(found, [*found[1:], None], strict=False):
        kind, a, b = m.groups()
        body = code[m.end() : n.start() if n else len(code)]
        if kind == "locals":
            names = [f"local.{x}" for x in re.findall(r"^\s*([\w-]+)\s*=", body, re.M)]
        else:
            names = [{"resource": f"{a}.{b}", "data": f"data.{a}.{b}", "module": f"module.{a}", "variable": f"var.{a}", "output": f"output.{a}", "provider": f"provider.{a}"}[kind]]
        source = re.search(r'^\s*source\s*=\s*"([^"]+)"', body, re.M) if kind == "module" else None
        blocks += [dict(kind=kind, address=x, source=source[1] if source else None, line=line_at(code, m.start())) for x in names]
        for r in ADDRESS.findall(re.sub(r'"(?:[^"$]|\$(?!\{))*"', '""', body)):
            bits = r.split(".")
            size = 3 if bits[0] in ("data",) else 2
            refs.append(dict(address=".".join(bits[:size]), output=bits[2] if bits[0] == "module" and len(bits) > 2 else None))
    return dict(blocks=blocks, refs=[dict(t) for t in sorted({tuple(r.items()) for r in refs}, key=str)])


TERRAFORM_SCHEMA = "blocks array<struct<kind:string,address:string,source:string,line:int>>, refs array<struct<address:string,output:string>>"

FENCE = re.compile(r"^(```+|~~~+)[ \t]*([\w-]*)[^\n]*\n(.*?)(?:^\1[ \t]*$|\Z)", re.M | re.S)
DIAGRAMS = ("graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "stateDiagram-v2", "erDiagram", "gantt", "pie", "journey", "gitGraph", "mindmap", "timeline", "quadrantChart", "requirementDiagram", "C4Context", "sankey-beta", "xychart-beta", "block-beta")


def markdown(path: str, text: str) -> dict:
    """Links, headings and Mermaid fences (S13, P31): a fence's diagram type and brackets are checked, its grammar isn't."""
    fences = [(m[2].lower(), m[3], line_at(text, m.start())) for m in FENCE.finditer(text)]
    body = FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    links = [dict(text=m[1], target=m[2], line=line_at(body, m.start())) for m in re.finditer(r"(?<!!)\[((?:[^\[\]]|\[[^\]]*\])*)\]\(\s*<?([^)\s>]+)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)", body)]
    links += [dict(text=m[1], target=m[2], line=line_at(body, m.start())) for m in re.finditer(r"^\[([^\]^]+)\]:\s*<?(\S+?)>?(?:\s|$)", body, re.M)]
    headings = [dict(level=len(m[1]), title=m[2].strip(), line=line_at(body, m.start())) for m in re.finditer(r"^(#{1,6})[ \t]+([^\n#]*)#*[ \t]*$", body, re.M)]
    mermaid = []
    for lang, code, line in fences:
        if lang == "mermaid":
            lines = [x.strip() for x in re.sub(r"^---\n.*?\n---\n", "", code, flags=re.S).split("\n") if x.strip() and not x.strip().startswith("%%")]
            kind = lines[0].split()[0].rstrip(";") if lines else ""
            unpaired = any(code.count(a) != code.count(b) for a, b in ("[]", "()", "{}"))
            mermaid.append(dict(line=line, diagram=kind, error="empty diagram" if not lines else "unknown diagram type" if kind not in DIAGRAMS else "unbalanced brackets" if unpaired else None))
    tables = len(re.findall(r"^[ \t]*(?=.*\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$", body, re.M))
    return dict(links=links, headings=headings, mermaid=mermaid, tables=tables, fences=len(fences))


MARKDOWN_SCHEMA = "links array<struct<text:string,target:string,line:int>>, headings array<struct<level:int,title:string,line:int>>, mermaid array<struct<line:int,diagram:string,error:string>>, tables int, fences int"


def lockfile(name: str, text: str) -> list[dict]:
    """name, version, fingerprint, kind of the packages in an npm, pnpm, yarn or bun lockfile."""
    row = lambda name, version, mark, kind: dict(name=name, version=version, fingerprint=mark, kind=kind)
    if name.endswith("package-lock.json"):
        doc = json.loads(text)
        if "packages" in doc:
            return [row(p.get("name") or k.rsplit("node_modules/", 1)[-1], p.get("version"), p.get("integrity") or p.get("resolved"), "link" if p.get("link") else "registry") for k, p in doc["packages"].items() if k]
        return [row(k, p.get("version"), p.get("integrity"), "registry") for k, p in (doc.get("dependencies") or {}).items()]
    if name.endswith("pnpm-lock.yaml"):
        doc = load(text) or {}
        out = []
        for key, p in (doc.get("packages") or {}).items():
            m = re.match(r"^/?(@?[^@/]+(?:/[^@/]+)?)[@/]([^(]+)", str(key))
            if m:
                out.append(row(m[1], m[2], ((p or {}).get("resolution") or {}).get("integrity"), "registry"))
        return out
    if name.endswith("yarn.lock"):
        out = []
        for block in re.split(r"\n(?=\S)", text):
            head = re.match(r'^"?(@?[^@"\s]+)@', block)
            version = re.search(r'^\s+version:?\s+"?([^"\s]+)"?', block, re.M)
            mark = re.search(r'^\s+(?:integrity|checksum):?\s+"?([^"\s]+)"?', block, re.M)
            if head and version:
                out.append(row(head[1], version[1], mark[1] if mark else None, "registry"))
        return out
    if name.endswith("bun.lock"):
        doc = load(text, "bun.jsonc")
        return [row(k, str(v[0]).rsplit("@", 1)[-1], str(v[-1]) if len(v) > 1 else None, "registry") for k, v in (doc.get("packages") or {}).items() if v]
    raise ValueError(f"{name} can't be read as a lockfile")


def manifest(path: str, text: str) -> dict:
    """A package.json's name, entry points and dependencies."""
    doc = load(text, "package.json")
    spaces = doc.get("workspaces") or []
    exports = doc.get("exports")
    flat = {}

    def walk(key, value):
        if isinstance(value, str):
            flat.setdefault(key, value)
        elif isinstance(value, dict):
            if any(k.startswith(".") for k in value):
                for k, v in value.items():
                    walk(k, v)
            else:
                for k in ("source", "import", "module", "require", "default", "types"):
                    if k in value:
                        walk(key, value[k])

    walk(".", exports)
    fields = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    return dict(
        name=doc.get("name"), entry=doc.get("source") or flat.get(".") or doc.get("module") or doc.get("main"), exports=flat or None, workspaces=[str(w) for w in (spaces.get("packages", []) if isinstance(spaces, dict) else spaces)],
        dependencies=[dict(name=k, spec=str(v), field=f) for f in fields for k, v in (doc.get(f) or {}).items()], scripts={k: str(v) for k, v in (doc.get("scripts") or {}).items()},
    )


MANIFEST_SCHEMA = "name string, entry string, exports map<string,string>, workspaces array<string>, dependencies array<struct<name:string,spec:string,field:string>>, scripts map<string,string>"

HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def diff(text: str) -> list[dict]:
    """Rows (path, old_path, status, hunk, ord, kind, text, line) of a unified diff (S10), a row at least for each file."""
    out: list[dict] = []
    file, hunk, order, line = None, 0, 0, 0

    def close():
        if file and not file["_rows"]:
            out.append({k: v for k, v in file.items() if k[0] != "_"} | dict(hunk=0, ord=0, kind=None, text=None, line=None))

    for raw in text.split("\n"):
        if raw.startswith("diff --git "):
            close()
            names = re.match(r'diff --git "?a/(.*?)"? "?b/(.*?)"?$', raw)
            file = dict(path=names[2] if names else None, old_path=names[1] if names else None, status="modified", _rows=0)
            hunk = 0
        elif file is None:
            continue
        elif raw.startswith("new file"):
            file["status"] = "added"
        elif raw.startswith("deleted file"):
            file["status"] = "deleted"
        elif raw.startswith(("rename from ", "copy from ")):
            file["status"], file["old_path"] = ("renamed" if raw[0] == "r" else "copied"), raw.split(" from ", 1)[1]
        elif raw.startswith(("rename to ", "copy to ")):
            file["path"] = raw.split(" to ", 1)[1]
        elif m := HUNK.match(raw):
            hunk, order, line = hunk + 1, 0, int(m[2])
        elif hunk and raw[:1] in ("+", "-", " "):
            kind = {"+": "add", "-": "remove", " ": "context"}[raw[0]]
            out.append({k: v for k, v in file.items() if k[0] != "_"} | dict(hunk=hunk, ord=order, kind=kind, text=raw[1:], line=None if kind == "remove" else line))
            file["_rows"] += 1
            order += 1
            line += kind != "remove"
    close()
    return out


DIFF_SCHEMA = "path string, old_path string, status string, hunk int, ord int, kind string, text string, line int"
