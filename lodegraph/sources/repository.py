"""A repository's files, history and manifests as tables.

Files are read in parallel by Spark's binary reader; only names and small options are held on the driver."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.redact import redacted
from lodegraph.functions.text import commit_type, is_generated, is_secret_file, is_test_path, language_of, matches_any, package_name, renamed_path

#: Files that declare dependencies.
MANIFESTS = ("package.json", "pyproject.toml", "requirements.txt")


def list_files(root: str) -> list[str]:
    """Paths that git tracks, and untracked ones that it doesn't ignore, sorted, each once."""
    out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, check=True).stdout
    return sorted({p for p in out.decode("utf-8", "replace").split("\0") if p})


def read_tree(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """path, size, content of the files below `root`, or of those listed: a listed file that is missing has null content.
    The content of files is only read where a column of it is asked for."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace("path", rf"^(file:)?/*{re.escape(base.lstrip('/'))}/", "")
    own = files.select(rel.alias("path"), F.col("length").alias("size"), "content")
    if paths is None:
        return own.where(~F.col("path").rlike(r"(^|/)\.git/"))
    return spark.createDataFrame([(p,) for p in paths], "path string").join(own, "path", "left")


def walk(files: DataFrame, include: list[str], exclude: list[str], max_kb: int = 512) -> DataFrame:
    """path, lang, sha256, size, is_test, text, reason of files (path, size, content): the first rule that a file fails is
    its reason, null if it is to be scanned. Manifests are set apart unless excluded (then nothing is told of them)."""
    head, text = F.substring(F.col("content").cast("string"), 1, 512), F.col("content").cast("string")
    path = F.col("path")
    manifest = path.isin(*MANIFESTS) | path.endswith("/package.json") | path.endswith("/pyproject.toml")
    out = matches_any(path, exclude)
    reason = (
        F.when(manifest, F.when(out, "excluded_manifest").otherwise("manifest"))
        .when(is_secret_file(path), "secret_file")
        .when(language_of(path).isNull(), "unsupported_type")
        .when(~matches_any(path, include) | out, "excluded")
        .when(F.col("content").isNull(), "missing")
        .when(F.col("size") > max_kb * 1024, "too_large")
        .when(F.hex(F.substring("content", 1, 8192)).rlike("^(..)*00"), "binary")
        .when(is_generated(path, head), "generated")
    )
    digest = F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)
    kept = reason.isNull()
    return files.select("path", F.when(kept, language_of(path)).alias("lang"), F.when(kept, digest).alias("sha256"), "size", is_test_path(path).alias("is_test"), F.when(kept | (reason == "manifest"), text).alias("text"), reason.alias("reason"))


def skip_counts(walked: DataFrame) -> DataFrame:
    """reason, n of files that aren't scanned; manifests are no reason."""
    return walked.where("reason is not null and reason not in ('manifest', 'excluded_manifest')").groupBy("reason").agg(F.count("*").alias("n"))


def _declared(path: str, text: str) -> list[str]:
    split = lambda spec: re.split(r"[<>=!~\[; ]", spec, maxsplit=1)[0].lower()
    try:
        if path.endswith("package.json"):
            data = json.loads(text)
            return [n for s in ("dependencies", "devDependencies", "peerDependencies") for n in data.get(s) or {}]
        if path.endswith("pyproject.toml"):
            return [split(x) for x in (tomllib.loads(text).get("project") or {}).get("dependencies") or []]
        return [split(x) for line in text.splitlines() if (x := line.strip()) and not x.startswith(("#", "-"))]
    except (ValueError, AttributeError, TypeError):  # a manifest that can't be read declares nothing
        return []


def dependencies(walked: DataFrame) -> DataFrame:
    """dep, manifest: declared packages, each with the first manifest (by path) that names it; unreadable manifests have
    none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, p) for p, t in zip(frame["path"], frame["text"]) for d in _declared(p, t or "")]
            yield pd.DataFrame(rows, columns=["dep", "manifest"])

    found = walked.where("reason = 'manifest'").select("path", "text").mapInPandas(run, "dep string, manifest string")
    return found.groupBy("dep").agg(F.min("manifest").alias("manifest"))


def git_log(root: str, limit: int) -> str:
    """The log that `history` reads: records and fields parted by control characters, with line counts by file."""
    if limit <= 0:
        return ""
    return subprocess.run(["git", "-C", root, "log", f"-n{limit}", "--no-merges", "--numstat", "--format=%x1e%H%x1f%ae%x1f%aI%x1f%s"], capture_output=True, text=True, check=True).stdout


def history(records: DataFrame, salt: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits sha, message, type, author_hash, date, file_count; touches sha, path, added, deleted) of log records (value,
    one commit each), without commits that are known (sha).

    Messages are redacted, then cut at 300 characters; authors are salted hashes; the type of an unconventional message is
    null; of a rename the new name counts; binary files have no line counts. Malformed records are left out."""
    lines = F.split(F.regexp_replace("value", r"^\n+|\n+$", ""), "\n")
    parts = F.split(F.get(lines, F.lit(0)), "\x1f")
    x = records.select(lines.alias("lines"), parts.alias("parts")).where("size(parts) >= 4").withColumn("sha", F.get("parts", F.lit(0)))
    if known is not None:
        x = x.join(known.select("sha").distinct(), "sha", "left_anti")
    subject = F.array_join(F.slice("parts", 4, 1 << 30), "\x1f")
    author = F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.lower(F.get("parts", F.lit(1)))), 256), 1, 12)
    rows = F.filter(F.transform(F.slice("lines", 2, 1 << 30), lambda s: F.split(s, "\t")), lambda c: F.size(c) == 3)
    number = lambda i: F.when(F.get("c", F.lit(i)).rlike("^[0-9]+$"), F.get("c", F.lit(i)).cast("int")).otherwise(0)
    x = x.dropDuplicates(["sha"]).withColumn("rows", rows)
    commits = x.select("sha", F.substring(redacted(subject), 1, 300).alias("message"), F.nullif(commit_type(subject), F.lit("other")).alias("type"), author.alias("author_hash"), F.get("parts", F.lit(2)).alias("date"), F.size("rows").alias("file_count"))
    touches = x.select("sha", F.explode("rows").alias("c")).select("sha", renamed_path(F.get("c", F.lit(2))).alias("path"), number(0).alias("added"), number(1).alias("deleted"))
    return commits, touches


def read_history(spark: SparkSession, path: str, salt: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`history` of log files: the reader splits records, so logs of any size are read in parallel."""
    return history(spark.read.option("lineSep", "\x1e").text(path).where("trim(value) <> ''"), salt, known)


def snapshot_diff(old: DataFrame, new: DataFrame, numstat: DataFrame) -> DataFrame:
    """path, status (A, M or D), added, deleted of two walks (path, sha256), with line counts where git gives them."""
    a, b = old.select("path", F.col("sha256").alias("_a")), new.select("path", F.col("sha256").alias("_b"))
    x = a.join(b, "path", "full_outer").where("not (_a <=> _b)")
    status = F.when(F.col("_a").isNull(), "A").when(F.col("_b").isNull(), "D").otherwise("M")
    lines = numstat.groupBy("path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return x.join(lines, "path", "left").select("path", status.alias("status"), F.coalesce("added", F.lit(0)).cast("long").alias("added"), F.coalesce("deleted", F.lit(0)).cast("long").alias("deleted"))


def new_dependencies(old: DataFrame, new: DataFrame) -> DataFrame:
    """dep, manifest that the new tree declares and the old one doesn't."""
    return new.join(old.select("dep"), "dep", "left_anti")


def load_snapshot(spark: SparkSession, root: str, project: str) -> dict[str, DataFrame]:
    """symbols (with the class that owns each), files and edges of a stored project: partitions of others aren't read."""
    own = lambda n: spark.read.parquet(f"{root}/{n}").where(F.col("project_id") == project)
    edges = own("edges")
    owner = edges.where("rel = 'HAS_MEMBER'").groupBy(F.col("dst").alias("uid")).agg(F.min("src").alias("owner"))
    return {"symbols": own("symbols").join(owner, "uid", "left"), "files": own("files"), "edges": edges}


def load_cases(spark: SparkSession, text: str) -> DataFrame:
    """Evaluation cases from a YAML list of flat mappings with inline lists, JSON being YAML too: request, name, desc,
    methods, expect, split. The files are written by hand and small."""
    rows = []
    for block in re.split(r"(?m)^\s*-\s+(?=\{|\w+:)", text)[1:]:
        block = block.strip().removeprefix("{").removesuffix("}")
        row: dict[str, object] = {}
        for key, value in re.findall(r"(\w+):\s*(\[[^\]]*\]|\"[^\"]*\"|'[^']*'|[^,\n}]+)", block):
            items = [v.strip().strip("\"'") for v in value.strip("[]").split(",") if v.strip()]
            row[key] = items if value.startswith("[") else value.strip().strip("\"'")
        rows.append(tuple(row.get(k) for k in ("request", "name", "desc", "methods", "expect", "split")))
    return spark.createDataFrame(rows, "request string, name string, desc string, methods array<string>, expect array<string>, split string")


def card(name: Column, kind: Column, path: Column, roles: Column, signature: Column, methods: Column, extends: Column, table: Column, doc: Column, used_by: Column) -> Column:
    """A symbol's text for embedding: a line each for what it is, how it is called, its methods (20), parents, table, doc
    and users (12); lines without content aren't there."""
    role = F.coalesce(F.concat(F.lit(", "), F.get(roles, F.lit(0))), F.lit(""))
    head = F.when(kind == "route", F.concat(F.lit("Route "), name, F.lit(" in "), path)).otherwise(F.concat(name, F.lit(" ("), kind, role, F.lit(") in "), path))
    some = lambda xs, n, sep, label: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(F.slice(xs, 1, n), sep)))
    said = lambda x, label: F.when(x != "", F.concat(F.lit(label), x))
    calls = F.when(kind.isin("function", "method"), said(signature, "Signature: "))
    return F.concat_ws("\n", head, calls, some(methods, 20, " · ", "Methods: "), some(extends, 1 << 30, ", ", "Extends: "), said(table, "Table: "), said(doc, "Doc: "), some(used_by, 12, ", ", "Used by: "))


def card_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def is_embeddable(kind: Column, exported: Column, roles: Column) -> Column:
    """Exported classes, functions, interfaces, types and constants, routes, and all that has a role, but no method."""
    known = kind.isin("class", "function", "interface", "type", "const", "route") & (F.coalesce(exported, F.lit(False)) | (kind == "route"))
    return (kind != "method") & (known | (F.size(F.coalesce(roles, F.array().cast("array<string>"))) > 0))


def external_imports(imports: DataFrame) -> DataFrame:
    """path, package of imports (path, module) of packages: sorted lists by file."""
    x = imports.select("path", package_name(F.col("module")).alias("package")).where("package is not null")
    return x.groupBy("path").agg(F.array_sort(F.collect_set("package")).alias("external_imports"))
