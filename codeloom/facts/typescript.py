"""Facts of TypeScript and JavaScript files, from tokens rather than a syntax tree.

Comments are blanked first and strings are read where they stand. What a
token-level reader cannot see (computed specifiers, re-assigned functions) is
left out, never guessed.
"""

from __future__ import annotations

import re

from codeloom.facts.masking import line_at, mask_strings, strip_comments

STRING = r"""(?:"([^"\n]*)"|'([^'\n]*)'|`([^`]*)`)"""
IMPORT = re.compile(rf"""\bimport\s+(type\s+)?(?:([\w$*\s{{}},]+?)\s+from\s+)?{STRING}""")
EXPORT_FROM = re.compile(rf"""\bexport\s+(type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{{[^}}]*\}})\s*from\s*{STRING}""")
DYNAMIC = re.compile(rf"""\bimport\s*\(\s*{STRING}""")
REQUIRE = re.compile(rf"""\brequire(\.resolve)?\s*\(\s*{STRING}\s*\)""")
EXPORT = re.compile(r"\bexport\s+(default\s+)?(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(function\*?|class|const|let|var|type|interface|enum)\s+([\w$]+)")
EXPORT_DEFAULT = re.compile(r"\bexport\s+default\b(?!\s+(?:async\s+)?(?:function|class)\s+[\w$])")
EXPORT_LIST = re.compile(r"\bexport\s+(type\s+)?\{([^}]*)\}(?!\s*from)")
CALL = re.compile(r"(?<![\w$.])((?:[\w$]+(?:\?\.|\.))*[\w$]+)\s*\(")
FUNCTION = re.compile(r"(?:\bfunction\*?\s+([\w$]+)\s*\(|\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=\n]+?)?=>)")
HTTP = re.compile(rf"""\b(?:(fetch)|(?:axios|http|client|api|ky|got)\.(get|post|put|patch|delete|head)|(axios|ky|got))\s*(?:<[^>()]*>)?\(\s*{STRING}""")
METHOD = re.compile(r"""\bmethod\s*:\s*["'](\w+)["']""")
ROUTE = re.compile(rf"""\b([\w$]+)\.(get|post|put|patch|delete|options|head|all|use|route)\s*\(\s*{STRING}""")
NEST = re.compile(rf"""@(Controller|Get|Post|Put|Patch|Delete)\s*\(\s*(?:{STRING})?\s*\)""")
QUERY_READ = re.compile(r"""\b(?:req|request|ctx|c)\.(?:query|req\.query)(?:\.([\w$]+)|\s*\(\s*["']([\w$-]+)["']|\[\s*["']([\w$-]+)["'])|searchParams\.get\(\s*["']([\w$-]+)["']""")
QUEUE_NEW = re.compile(rf"""\b(?:const|let|var)\s+([\w$]+)\s*=\s*(?:new\s+Queue|createQueue)\s*(?:<[^>()]*>)?\(\s*{STRING}""")
QUEUE_ADD = re.compile(rf"""\b([\w$]+)\.add(?:Bulk)?\s*\(\s*{STRING}""")
WORKER = re.compile(rf"""\bnew\s+Worker\s*(?:<[^>()]*>)?\(\s*{STRING}\s*,""")
CASE = re.compile(rf"""\bcase\s+{STRING}\s*:|\bjob\.name\s*===?\s*{STRING}""")
SPAWN = re.compile(rf"""\b(?:[\w$]+\.)?(spawn|spawnSync|exec|execSync|execFile|fork)\s*\(\s*{STRING}(?:\s*,\s*\[([^\]]*)\])?""")
RESOURCE = re.compile(rf"""\b(?:fs(?:p|Promises)?\.)?(readFile|readFileSync|readdir|readdirSync|createReadStream|glob|globSync)\s*\(\s*{STRING}""")
TEST_ID = re.compile(r"""\b(data-testid|data-test-id|data-test|data-pw|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|\{\s*`([^`]*)`\s*\}|\{\s*["']([^"']*)["']\s*\})""")
LOCATOR = re.compile(rf"""\.(getByTestId|getByText|getByLabel|getByPlaceholder|getByRole|locator)\s*\(\s*{STRING}""")
GOTO = re.compile(rf"""\.(goto|waitForURL|toHaveURL)\s*\(\s*{STRING}""")
COMPONENT = re.compile(r"\b(?:function\s+([A-Z][\w$]*)\s*\(|(?:const|let)\s+([A-Z][\w$]*)\s*(?::[^=\n]+)?=\s*(?:React\.)?(?:memo\s*\(|forwardRef\s*\()?(?:async\s*)?\(?[^=\n]*=>)")
ELEMENT = re.compile(r"<([A-Z][\w$.]*)")
DIRECTIVE = re.compile(r"""^\s*["']use (client|server)["']""")
PROCEDURE = re.compile(r"\b([\w$]+)\s*:\s*[\w$.]*[pP]rocedure\b")
TRPC_CALL = re.compile(r"\b(?:trpc|api)\.((?:[\w$]+\.)*[\w$]+)\.(?:useQuery|useMutation|query|mutate|fetch)\b")
#: A suppression under any tool's name but those of other linters.
DISABLE = re.compile(r"(?<![\w-])(?!(?:eslint|oxlint|tslint|stylelint|biome|prettier)-)[a-z]+(?:-[a-z]+)*?-disable-(file|next-line|line)(?:[ \t]+([\w-]+))?")


def text_of(groups) -> str | None:
    return next((g for g in groups if g is not None), None)


def template(text: str | None) -> str | None:
    return None if text is None else re.sub(r"\$\{[^}]*\}", ":param", text)


def names_of(clause: str | None) -> list[tuple[str, str]]:
    """(imported, local) names of an import clause; * for a namespace, default for a default."""
    out: list[tuple[str, str]] = []
    for braces in re.findall(r"\{([^}]*)\}", clause or ""):
        for part in braces.split(","):
            bits = part.replace("type ", " ").split()
            if bits:
                out.append((bits[0], bits[-1]))
    rest = re.sub(r"\{[^}]*\}", "", clause or "")
    if m := re.search(r"\*\s+as\s+([\w$]+)", rest):
        out.append(("*", m[1]))
        rest = rest.replace(m[0], "")
    out += [("default", x.strip()) for x in rest.split(",") if re.fullmatch(r"[\w$]+", x.strip())]
    return out


def brackets(masked: str) -> dict[int, tuple[int, list[int]]]:
    """For each opening bracket the place of its closing one, and the commas directly inside; one pass."""
    out: dict[int, tuple[int, list[int]]] = {}
    open_: list[tuple[int, list[int]]] = []
    for m in re.finditer(r"[()\[\]{},]", masked):
        if m[0] in "([{":
            open_.append((m.start(), []))
        elif open_ and m[0] == ",":
            open_[-1][1].append(m.start())
        elif open_:
            begin, commas = open_.pop()
            out[begin] = (m.start(), commas)
    return out


def scopes(masked: str, closed: dict[int, tuple[int, list[int]]]) -> list[tuple[str, int, int]]:
    """(name, begin, end) of named functions, by braces."""
    out = []
    for m in FUNCTION.finditer(masked):
        brace = masked.find("{", m.end())
        if brace < 0 or ";" in masked[m.end() : brace] and m[2]:
            continue
        if brace in closed:
            out.append((m[1] or m[2], m.start(), closed[brace][0]))
    return out


def scope_at(found: list[tuple[str, int, int]], at: int) -> str | None:
    inner = [s for s in found if s[1] < at <= s[2]]
    return min(inner, key=lambda s: s[2] - s[1])[0] if inner else None


def reachable_scopes(found, calls: list[tuple[str | None, str]], exported: set[str]) -> set[str]:
    """Scopes that top-level code, an export or another reachable scope calls."""
    names = {s[0] for s in found}
    reached = {n for n in names if n in exported} | {c for s, c in calls if s is None and c in names}
    while True:
        more = {c for s, c in calls if s in reached and c in names} - reached
        if not more:
            return reached
        reached |= more


def extract(path: str, source: str) -> dict:
    """All fact families of a file."""
    code = strip_comments(source)
    masked = mask_strings(source)
    at = lambda m: line_at(code, m.start())
    closed = brackets(masked)
    found = scopes(masked, closed)
    imports, exports = [], []

    def add(kind, specifier, m, names=(), re_export=False, side_effect=False):
        if specifier is not None and "${" not in specifier:
            imports.append(dict(kind=kind, specifier=specifier, line=at(m), scope=scope_at(found, m.start()), names=[n for n, _ in names], locals=[n for _, n in names], re_export=re_export, side_effect_only=side_effect))

    for m in IMPORT.finditer(code):
        add("type-import" if m[1] else "import", text_of(m.groups()[2:]), m, names_of(m[2]), side_effect=m[2] is None)
    for m in EXPORT_FROM.finditer(code):
        names = names_of(m[2]) if m[2].startswith("{") else [("*", "*")]
        add("type-import" if m[1] else "import", text_of(m.groups()[2:]), m, names, re_export=True)
        exports += [dict(name=local, kind="re-export", line=at(m), type_only=bool(m[1]), source=text_of(m.groups()[2:]), imported=name) for name, local in names]
    for m in DYNAMIC.finditer(code):
        add("dynamic-import", text_of(m.groups()), m)
    for m in REQUIRE.finditer(code):
        add("require-resolve" if m[1] else "require", text_of(m.groups()[1:]), m)
    for m in EXPORT.finditer(masked):
        exports.append(dict(name="default" if m[1] else m[3], kind="default" if m[1] else m[2].rstrip("*"), line=at(m), type_only=m[2] in ("type", "interface"), source=None, imported=m[3]))
    for m in EXPORT_DEFAULT.finditer(masked):
        exports.append(dict(name="default", kind="default", line=at(m), type_only=False, source=None, imported=None))
    for m in EXPORT_LIST.finditer(masked):
        exports += [dict(name=b, kind="const", line=at(m), type_only=bool(m[1]), source=None, imported=a) for a, b in names_of("{" + m[2] + "}")]

    calls = []
    for m in CALL.finditer(masked):
        name = m[1].replace("?.", ".")
        if name in ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "import", "super"):
            continue
        close, commas = closed.get(m.end() - 1, (m.end(), []))
        args = [code[x + 1 : y].strip() for x, y in zip([m.end() - 1, *commas], [*commas, close], strict=True)]
        args = [a for a in args if a]
        calls.append(dict(callee=name, line=at(m), scope=scope_at(found, m.start()), args=args, shapes=[shape(a) for a in args]))
    exported = {e["imported"] for e in exports if e["imported"]}
    reached = reachable_scopes(found, [(c["scope"], c["callee"].split(".")[0]) for c in calls], exported)
    for i in imports:
        i["reachable"] = i["scope"] is None or i["scope"] in reached

    http = []
    for m in HTTP.finditer(code):
        upto = closed.get(code.find("(", m.start()), (len(code), []))[0]
        method = METHOD.search(code, m.end(), upto) if m[1] or m[3] else None
        http.append(dict(url=template(text_of(m.groups()[3:])), method=(m[2] or (method[1] if method else "get")).upper(), line=at(m)))
    routes = [dict(object=m[1], method=m[2], route=text_of(m.groups()[2:]), line=at(m)) for m in ROUTE.finditer(code) if (text_of(m.groups()[2:]) or "").startswith(("/", "*", ""))]
    prefix = ""
    for m in NEST.finditer(code):
        value = text_of(m.groups()[1:]) or ""
        if m[1] == "Controller":
            prefix = value
        else:
            routes.append(dict(object="controller", method=m[1].lower(), route=re.sub("/+", "/", f"/{prefix}/{value}").rstrip("/") or "/", line=at(m)))
    queues = {m[1]: text_of(m.groups()[1:]) for m in QUEUE_NEW.finditer(code)}
    enqueues = [dict(queue=queues[m[1]], job=text_of(m.groups()[1:]), line=at(m)) for m in QUEUE_ADD.finditer(code) if m[1] in queues]
    jobs = [text_of(m.groups()) for m in CASE.finditer(code)]
    workers = [dict(queue=text_of(m.groups()), jobs=jobs, line=at(m)) for m in WORKER.finditer(code)]
    components = []
    declared = list(COMPONENT.finditer(masked)) if path.endswith(("x", "js")) else []
    for m, n in zip(declared, [*declared[1:], None], strict=False):
        body = code[m.start() : n.start() if n else len(code)]
        components.append(
            dict(name=m[1] or m[2], line=at(m), children=sorted(set(ELEMENT.findall(body))), state=bool(re.search(r"\buse(State|Reducer)\s*[<(]", body)), memo="memo(" in m[0], props=bool(re.search(r"\bprops\b|\(\s*\{", m[0] + body[:80])), suspense="<Suspense" in body, context=".Provider" in body, fetches=len(HTTP.findall(body)))
        )
    directive = DIRECTIVE.match(code)
    return dict(
        imports=imports, exports=exports, calls=calls, http_calls=http, routes=routes, queue_enqueues=enqueues, queue_workers=workers,
        query_reads=sorted({text_of(m.groups()) for m in QUERY_READ.finditer(code)}),
        spawns=[dict(command=text_of(m.groups()[1:4]), args=re.findall(r"""["']([^"']*)["']""", m[5] or ""), line=at(m)) for m in SPAWN.finditer(code)],
        resources=[dict(call=m[1], target=text_of(m.groups()[1:]), line=at(m)) for m in RESOURCE.finditer(code)],
        selectors=[dict(attribute=m[1], value=template(text_of(m.groups()[1:])), exact="${" not in (text_of(m.groups()[1:]) or ""), line=at(m)) for m in TEST_ID.finditer(code)],
        locators=[dict(kind=m[1], value=text_of(m.groups()[1:]), line=at(m)) for m in LOCATOR.finditer(code)],
        urls=[dict(call=m[1], url=template(text_of(m.groups()[1:])), line=at(m)) for m in GOTO.finditer(code)],
        components=components, environment=directive[1] if directive else "unknown",
        procedures=sorted({m[1] for m in PROCEDURE.finditer(code)}), trpc_calls=sorted({m[1] for m in TRPC_CALL.finditer(code)}),
        directives=[dict(scope=m[1], rule=m[2], line=line_at(source, m.start())) for m in DISABLE.finditer(source)],
    )


def shape(arg: str) -> str:
    """What kind of expression an argument is."""
    for kind, pattern in (("spread", r"\.\.\."), ("string", r"[\"'`]"), ("number", r"-?\d"), ("object", r"\{"), ("array", r"\["), ("function", r"(async\s*)?(function\b|\([^()]*\)\s*=>|[\w$]+\s*=>)"), ("boolean", r"(true|false)\b"), ("null", r"(null|undefined)\b"), ("call", r"[\w$.]+\s*\("), ("identifier", r"[\w$.]+$")):
        if re.match(pattern, arg):
            return kind
    return "expression"


SCHEMA = """imports array<struct<kind:string,specifier:string,line:int,scope:string,names:array<string>,locals:array<string>,re_export:boolean,side_effect_only:boolean,reachable:boolean>>,
exports array<struct<name:string,kind:string,line:int,type_only:boolean,source:string,imported:string>>,
calls array<struct<callee:string,line:int,scope:string,args:array<string>,shapes:array<string>>>,
http_calls array<struct<url:string,method:string,line:int>>, routes array<struct<object:string,method:string,route:string,line:int>>,
queue_enqueues array<struct<queue:string,job:string,line:int>>, queue_workers array<struct<queue:string,jobs:array<string>,line:int>>, query_reads array<string>,
spawns array<struct<command:string,args:array<string>,line:int>>, resources array<struct<call:string,target:string,line:int>>,
selectors array<struct<attribute:string,value:string,exact:boolean,line:int>>, locators array<struct<kind:string,value:string,line:int>>, urls array<struct<call:string,url:string,line:int>>,
components array<struct<name:string,line:int,children:array<string>,state:boolean,memo:boolean,props:boolean,suspense:boolean,context:boolean,fetches:int>>, environment string,
procedures array<string>, trpc_calls array<string>, directives array<struct<scope:string,rule:string,line:int>>"""
FAMILIES = re.findall(r"(?:^|[,\n]\s*|, )(\w+) (?:array|string)", SCHEMA)
