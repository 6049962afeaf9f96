"""Repository snapshots as DataFrames: files, changes, and the facts of each family."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.facts import documents, languages, typescript
from codeloom.functions import paths as P

#: Folders that are never scanned.
SKIPPED = ["node_modules", "dist", ".git", ".next", "coverage", "fixtures", "target", "build"]
CODE = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
FILES = "path string, ext string, tracked boolean, content string, error string"


def visible(files: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Without skipped folders, and without hidden ones but .github/workflows; one row a path."""
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    banned = F.array(*[F.lit(s) for s in [*SKIPPED, *extra]])
    hidden = F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", "..")) & ~F.col("path").startswith(".github/workflows/")
    return files.where(~F.arrays_overlap(parts, banned) & ~hidden).dropDuplicates(["path"])


def scan(spark: SparkSession, root: str, extra: list[str] = ()) -> DataFrame:
    """files(path, ext, tracked, content, error) under a folder that Spark reads; unreadable text is an error, not a failure.

    Git's own list decides what is tracked where the driver has a work tree;
    elsewhere every file counts as tracked.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    files = raw.select(P.relative_to(path, base.removeprefix("file://")).alias("path"), text.alias("content"))
    files = files.withColumns({"ext": P.extension(F.col("path")), "error": F.when(F.col("content").isNull(), "not UTF-8")})
    listed = subprocess.run(["git", "-C", base, "ls-files", "-z"], capture_output=True, text=True) if os.path.isdir(f"{base}/.git") else None
    if listed is None or listed.returncode:
        files = files.withColumn("tracked", F.lit(True))
    else:
        known = spark.createDataFrame([(p,) for p in listed.stdout.split("\0") if p], "path string").withColumn("tracked", F.lit(True))
        files = files.join(known, "path", "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))
    return visible(files.select("path", "ext", "tracked", "content", "error"), list(extra))


def from_rows(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    """files of {path: content}."""
    return spark.createDataFrame([(p, p.rsplit(".", 1)[-1] if "." in p.rsplit("/", 1)[-1] else "", True, c, None) for p, c in rows.items()], FILES)


def facts(files: DataFrame, extract: Callable[[str, str], dict], schema: str) -> DataFrame:
    """path, error and the columns of an extractor, run once a file over Arrow batches; what it raises becomes the error."""
    names = [f.name for f in files.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                row: dict = dict.fromkeys(["path", "error", *names]) | {"path": path}
                try:
                    row |= extract(path, content or "")
                except Exception as e:  # a file that can't be read is a row, never a failed task
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "error", *names], dtype=object)

    return files.where("content is not null").select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def typescript_facts(files: DataFrame) -> DataFrame:
    return facts(files.where(F.col("ext").isin(CODE)), typescript.extract, typescript.SCHEMA)


def language_facts(files: DataFrame) -> DataFrame:
    return facts(files.where(F.col("ext").isin(list(languages.LANGUAGES))), lambda p, s: languages.extract(p, s, p.rsplit(".", 1)[-1]), languages.SCHEMA)


def workflow_facts(files: DataFrame, folders: list[str] = (".github/workflows",)) -> DataFrame:
    inside = F.col("path").rlike("^(" + "|".join(f.rstrip("/").replace(".", r"\.") for f in folders) + r")/[^/]+\.ya?ml$")
    return facts(files.where(inside), documents.workflow, documents.WORKFLOW_SCHEMA)


def sql_facts(files: DataFrame) -> DataFrame:
    return facts(files.where("ext = 'sql'"), documents.sql, documents.SQL_SCHEMA)


def terraform_facts(files: DataFrame) -> DataFrame:
    return facts(files.where("ext in ('tf', 'tofu')"), documents.terraform, documents.TERRAFORM_SCHEMA)


def markdown_facts(files: DataFrame) -> DataFrame:
    return facts(files.where("ext in ('md', 'mdx', 'markdown')"), documents.markdown, documents.MARKDOWN_SCHEMA)


def manifests(files: DataFrame) -> DataFrame:
    return facts(files.where(P.basename(F.col("path")) == "package.json"), documents.manifest, documents.MANIFEST_SCHEMA).withColumn("dir", P.dirname(F.col("path")))


def lockfile_packages(files: DataFrame) -> DataFrame:
    """path, name, version, fingerprint, kind; a null name with an error for what can't be read."""
    locks = files.where(P.basename(F.col("path")).isin("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb"))
    rows = facts(locks, lambda p, s: {"packages": documents.lockfile(p, s)}, "packages array<struct<name:string,version:string,fingerprint:string,kind:string>>")
    return rows.select("path", "error", F.explode_outer("packages").alias("p")).select("path", "error", "p.*")


def diff_lines(spark: SparkSession, text: str) -> DataFrame:
    """A row for each line of a unified diff's hunks; files without hunks have one of nulls."""
    names = [c.split()[0] for c in documents.DIFF_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(row[n] for n in names) for row in documents.diff(text)], documents.DIFF_SCHEMA)


def git_changes(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """Status, path, old_path between the merge base and head."""
    out = subprocess.run(["git", "-C", root, "diff", "--name-status", "-z", f"{base}...{head}"], capture_output=True, text=True, check=True).stdout.split("\0")
    rows, i = [], 0
    while i < len(out) - 1:
        status = out[i][0]
        if status in "RC":
            rows.append(({"R": "renamed", "C": "copied"}[status], out[i + 2], out[i + 1]))
            i += 3
        else:
            rows.append(({"A": "added", "D": "deleted"}.get(status, "modified"), out[i + 1], None))
            i += 2
    return spark.createDataFrame(rows, "status string, path string, old_path string")


def config(files: DataFrame, path: str = ".codeloom.yml") -> dict:
    """The typed configuration, read on the driver; an absent file is an empty one."""
    row = files.where(F.col("path") == path).select("content").first()
    return (documents.load(row[0], path) or {}) if row else {}


def saved_plan(spark: SparkSession, path: str) -> DataFrame:
    """S22."""
    return spark.read.schema("test string, confidence string, reasons array<struct<changed_file:string,path:array<string>,via:array<string>>>").json(path)


def to_json(df: DataFrame, *order: str) -> str:
    """K1, K5: sorted rows as one JSON document, for reports that people read."""
    return json.dumps([r.asDict(recursive=True) for r in df.orderBy(*(order or df.columns)).collect()], indent=2)


def mermaid(edges: DataFrame) -> str:
    """K2, K3: a flowchart with one arrow for each pair and its kinds."""
    rows = edges.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("label")).orderBy("src", "dst").collect()
    ids = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in r[:2]}))}
    quoted = lambda s: s.replace('"', "#quot;")
    return "\n".join(["flowchart LR", *[f'  {i}["{quoted(n)}"]' for n, i in ids.items()], *[f'  {ids[a]} -->|"{quoted(k)}"| {ids[b]}' for a, b, k in rows]])
