"""Facts of Python, Go, Rust, Ruby, PHP, Java, Kotlin, Elixir, Dart, C# and Swift files (P27, S16, S17), by patterns.

A language is a row of patterns for what it imports, declares, refers to,
routes, enqueues and works on; each pattern's first group is the name.
"""

from __future__ import annotations

import re

from codeloom.facts.masking import strip_comments

Q = r"""["']([^"'\n]+)["']"""
LANGUAGES = {
    "py": dict(imports=[r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"], declarations=[r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)"], routes=[rf"@\w+\.(?:route|get|post|put|patch|delete)\(\s*{Q}", rf"\bpath\(\s*{Q}"], enqueues=[r"\b(\w+)\.(?:delay|apply_async)\("], workers=[r"@(?:\w+\.)?(?:shared_)?task\b[^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(\w+)"]),
    "go": dict(imports=[rf"^\s*import\s+(?:\w+\s+)?{Q}", r"^\s+(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$"], declarations=[r"^func\s+(?:\([^)]*\)\s*)?(\w+)", r"^type\s+(\w+)"], routes=[rf"\.(?:HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Delete)\(\s*{Q}"], enqueues=[rf"NewTask\(\s*{Q}"], workers=[rf"mux\.HandleFunc\(\s*{Q}"], package=r"^package\s+(\w+)"),
    "rs": dict(imports=[r"^\s*(?:pub\s+)?use\s+([\w:]+)"], declarations=[r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|type)\s+(\w+)"], routes=[rf"\.route\(\s*{Q}", rf"#\[(?:get|post|put|delete|patch)\(\s*{Q}"], mods=[r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"]),
    "rb": dict(imports=[rf"^\s*require(?:_relative)?\s+{Q}"], declarations=[r"^\s*(?:class|module)\s+([\w:]+)", r"^\s*def\s+(?:self\.)?(\w+)"], routes=[rf"^\s*(?:get|post|put|patch|delete)\s+{Q}"], enqueues=[r"\b([A-Z]\w*(?:::\w+)*)\.perform_(?:later|async|in)\b"], workers=[r"^\s*class\s+([\w:]+)\s*<\s*(?:ApplicationJob|ActiveJob::Base)", r"^\s*class\s+([\w:]+)[^\n]*\n\s*include\s+Sidekiq"]),
    "php": dict(imports=[r"^\s*use\s+([\w\\]+)"], declarations=[r"\b(?:class|interface|trait|enum)\s+(\w+)", r"\bfunction\s+(\w+)"], routes=[rf"Route::(?:get|post|put|patch|delete|any)\(\s*{Q}"], enqueues=[r"\b(\w+)::dispatch\("], workers=[r"\bclass\s+(\w+)[^{{]*implements[^{{]*ShouldQueue".replace("{{", "{")], package=r"^\s*namespace\s+([\w\\]+)"),
    "java": dict(imports=[r"^\s*import\s+(?:static\s+)?([\w.]+)"], declarations=[r"\b(?:class|interface|enum|record)\s+(\w+)"], routes=[rf"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?{Q}"], enqueues=[rf"\.(?:convertAndSend|send)\(\s*{Q}"], workers=[rf"@(?:Rabbit|Kafka|Jms)Listener\([^)]*?(?:queues|topics|destination)\s*=\s*\{{?\s*{Q}"], package=r"^\s*package\s+([\w.]+)"),
    "kt": dict(imports=[r"^\s*import\s+([\w.]+)"], declarations=[r"\b(?:class|interface|object)\s+(\w+)", r"\bfun\s+(?:[\w<>]+\.)?(\w+)"], routes=[rf"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*{Q}", rf"^\s*(?:get|post|put|delete|patch)\(\s*{Q}"], enqueues=[rf"\.(?:convertAndSend|send)\(\s*{Q}"], workers=[rf"@(?:Rabbit|Kafka|Jms)Listener\([^)]*?(?:queues|topics|destination)\s*=\s*\[?\s*{Q}"], package=r"^\s*package\s+([\w.]+)"),
    "ex": dict(imports=[r"^\s*(?:alias|import|use|require)\s+([\w.]+)"], declarations=[r"\bdefmodule\s+([\w.]+)", r"^\s*defp?\s+(\w+)"], routes=[rf"^\s*(?:get|post|put|patch|delete|live)\s+{Q}"], enqueues=[r"\b([A-Z][\w.]*)\.new\([^\n]*\)\s*\|>\s*Oban\.insert"], workers=[r"\bdefmodule\s+([\w.]+)\s+do\s*\n\s*use\s+Oban\.Worker"]),
    "dart": dict(imports=[rf"^\s*(?:import|export|part)\s+{Q}"], declarations=[r"\b(?:class|mixin|enum|extension)\s+(\w+)"], http=[rf"\b(?:http|dio|client)\.(?:get|post|put|patch|delete)\(\s*(?:Uri\.parse\(\s*)?{Q}"]),
    "cs": dict(imports=[r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;"], declarations=[r"\b(?:class|interface|struct|enum|record)\s+(\w+)"], package=r"^\s*namespace\s+([\w.]+)", routes=[rf"\[(?:Http(?:Get|Post|Put|Delete|Patch)|Route)\(\s*{Q}", rf"\.Map(?:Get|Post|Put|Delete)\(\s*{Q}"]),
    "swift": dict(imports=[r"^\s*(?:@testable\s+)?import\s+(\w+)"], declarations=[r"\b(?:class|struct|enum|protocol|actor)\s+(\w+)"], http=[rf"URL\(\s*string:\s*{Q}"]),
}
LANGUAGES["exs"] = LANGUAGES["ex"]
LANGUAGES["kts"] = LANGUAGES["kt"]
COMPILED = {ext: {family: [re.compile(p, re.M) for p in ([patterns] if isinstance(patterns, str) else patterns)] for family, patterns in rows.items()} for ext, rows in LANGUAGES.items()}
REFERENCE = re.compile(r"(?<![\w.])([A-Z]\w*)\b")
KAFKA = {"produce": re.compile(rf"\b(?:produce|ProducerRecord(?:<[^>]*>)?|send)\(\s*(?:topic\s*[:=]\s*)?{Q}"), "consume": re.compile(rf"\b(?:subscribe|KafkaConsumer)\(\s*[\[({{]?\s*(?:topics?\s*[:=]\s*\[?\s*)?{Q}")}


def rust_uses(tree: str) -> list[str]:
    """A::{b, c::{d, e}, f::*} as single paths."""
    tree = tree.strip()
    if "{" not in tree:
        return [tree] if tree else []
    head, rest = tree.split("{", 1)
    inner, depth, part, out = rest[: rest.rindex("}")], 0, "", []
    for c in inner + ",":
        if c == "," and not depth:
            out += [head.strip() + x for x in rust_uses(part)]
            part = ""
            continue
        depth += (c == "{") - (c == "}")
        part += c
    return [x.removesuffix("::self") for x in out]


def python_absolute(module: str, path: str) -> str:
    """A relative import's module by the file's folder."""
    dots = len(module) - len(module.lstrip("."))
    if not dots:
        return module
    folder = path.split("/")[:-1]
    return ".".join([*folder[: len(folder) - dots + 1], *filter(None, [module[dots:]])])


def module_of(path: str, ext: str) -> str | None:
    """The dotted module of a file."""
    stem = path.rsplit(".", 1)[0]
    if ext == "py":
        return stem.removesuffix("/__init__").replace("/", ".")
    if ext == "rs":
        return re.sub(r"^.*?src/", "crate/", stem).removesuffix("/mod").removesuffix("/lib").removesuffix("/main").replace("/", "::")
    return None


def extract(path: str, source: str, ext: str) -> dict:
    code = strip_comments(source, ext)
    found = {family: sorted({m[1] for p in patterns for m in p.finditer(code)}) for family, patterns in COMPILED.get(ext, {}).items()}
    if ext == "py":
        dotted = [m[1] for m in re.finditer(r"^\s*from\s+(\.+[\w.]*)\s+import", code, re.M)]
        found["imports"] = sorted({python_absolute(m, path) for m in [*found["imports"], *dotted]})
    if ext == "rs":
        found["imports"] = sorted({u for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([^;]+);", code, re.M) for u in rust_uses(re.sub(r"\s+", "", m[1].split(" as ")[0]))})
    names = found.get("declarations", [])
    return dict(
        lang=ext, package=(found.get("package") or [None])[0], module=module_of(path, ext), imports=found.get("imports", []), declarations=names,
        references=sorted(set(REFERENCE.findall(code)) - set(names)), routes=found.get("routes", []), queue_enqueues=found.get("enqueues", []),
        queue_workers=found.get("workers", []), mods=found.get("mods", []), http_paths=found.get("http", []),
        topics_out=sorted(set(KAFKA["produce"].findall(code))), topics_in=sorted(set(KAFKA["consume"].findall(code))),
    )


SCHEMA = ", ".join(["lang string", "package string", "module string", *[f"{c} array<string>" for c in "imports declarations references routes queue_enqueues queue_workers mods http_paths topics_out topics_in".split()]])
