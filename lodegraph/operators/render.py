"""Reports as Markdown: rows become lines in the engine, and one row a report is put together from its ordered lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections of a context pack in order, their titles, and what an empty one says.
PACK_SECTIONS = (
    ("architecture", "Relevant architecture", None),
    ("related_features", "Related features", None),
    ("reusable", "Reusable implementations", "_Nothing similar found; a new abstraction may be justified._"),
    ("patterns", "Patterns to follow", None),
    ("decisions", "Decisions", None),
    ("constraints", "Constraints (must not be violated)", "_No validated constraints in scope._"),
    ("dependencies", "Dependencies (who else uses what you may change)", None),
    ("tests", "Relevant tests", None),
    ("memory", "What memory says", None),
    ("docs", "Documentation", None),
    ("unverified", "Unverified observations (candidates — not rules)", None),
)
STATUS_MARKS = {"pass": "✓", "warn": "⚠", "fail": "✗"}
# end of fixed values


def _together(lines: DataFrame, key: str) -> DataFrame:
    """key, markdown of lines (key, a, b, line) in the order of a, b and line."""
    g = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", "b", "line"))).alias("x"))
    return g.select(key, F.array_join(F.transform("x", lambda l: l["line"]), "\n").alias("markdown"))


def table_lines(rows: DataFrame, key: str, a: int, columns: list[tuple[str, str]], order: str) -> DataFrame:
    """Lines of a Markdown table with these (column, title), one row each; nulls are dashes, bars are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|"))
    head = "| " + " | ".join(t for _, t in columns) + " |\n|" + "---|" * len(columns)
    top = rows.select(key).distinct().select(key, F.lit(a).alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(head).alias("line"))
    return top.union(rows.select(key, F.lit(a), F.col(order).cast("long"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c, _ in columns]), F.lit(" |"))))


def context_pack(requests: DataFrame, items: DataFrame) -> DataFrame:
    """key, markdown of packs: requests (key, request) and their kept items (key, section, pos, text). Empty sections are
    left out or say so."""
    heads = requests.select("key", F.lit(-1).alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("# Context for: "), "request", F.lit("\n")).alias("line"))
    named = requests.sparkSession.createDataFrame([(i, s, t, e) for i, (s, t, e) in enumerate(PACK_SECTIONS)], "a int, section string, title string, empty string")
    filled = items.select("key", "section").distinct().withColumn("has", F.lit(True))
    every = requests.select("key").crossJoin(F.broadcast(named)).join(filled, ["key", "section"], "left").where("has or empty is not null")
    titles = every.select("key", "a", F.lit(-1).cast("long").alias("b"), F.concat_ws("\n", F.concat(F.lit("## "), "title"), F.when(F.col("has").isNull(), F.concat("empty", F.lit("\n")))).alias("line"))
    last = items.groupBy("key", "section").agg(F.max("pos").alias("last"))
    body = items.join(named, "section").join(last, ["key", "section"]).select("key", "a", F.col("pos").cast("long").alias("b"), F.concat(F.lit("- "), "text", F.when(F.col("pos") == F.col("last"), "\n").otherwise("")).alias("line"))
    return _together(heads.union(titles).union(body), "key")


def guardrail_report(checks: DataFrame, findings: DataFrame) -> DataFrame:
    """key, markdown: checks (key, pos, check, status, summary) and findings (key, check, severity, message, path, waived)."""
    n = findings.groupBy("key", "check").agg(F.count("*").alias("n"), F.count_if("waived").alias("w"))
    x = checks.join(n, ["key", "check"], "left").fillna(0, ["n", "w"])
    count = F.when(F.col("w") > 0, F.format_string("%d (%d waived)", F.col("n"), F.col("w"))).otherwise(F.col("n").cast("string"))
    mark = F.create_map(*[F.lit(v) for kv in STATUS_MARKS.items() for v in kv])
    worst = x.groupBy("key").agg(F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)).alias("s"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    state = F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("s") + 1)
    head = worst.select("key", F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.format_string("# Guardrail Report: %s %s\n\n**Findings:** %d total (%d waived)\n", F.upper(state), mark[state], F.col("n"), F.col("w")).alias("line"))
    rows = x.select("key", "pos", "check", F.concat_ws(" ", mark[F.col("status")], "status").alias("status"), "summary", count.alias("count"))
    open_ = findings.where("not waived").join(checks.select("key", "check", "pos"), ["key", "check"])
    title = open_.select("key").distinct().select("key", F.lit(2).alias("a"), F.lit(-1).cast("long").alias("b"), F.lit("\n## Actionable Findings\n").alias("line"))
    said = open_.select("key", F.lit(2), F.col("pos").cast("long"), F.concat(F.lit("- **["), "severity", F.lit("]** "), "message", F.coalesce(F.concat(F.lit(" (`"), "path", F.lit("`)")), F.lit(""))))
    return _together(head.union(table_lines(rows, "key", 1, [("check", "Check"), ("status", "Status"), ("summary", "Summary"), ("count", "Findings")], "pos")).union(title).union(said), "key")


def sections(requests: DataFrame, title: Column, items: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """key, markdown of any report of titled lists: impact, reuse, plans, change descriptions, knowledge. requests hold key
    and what `title` needs; items are key, section, pos, text; sections come in this order, others are left out."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("section")).cast("int")
    head = requests.select("key", F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("# "), title).alias("line"))
    x = items.where(F.col("section").isin(*order)).withColumn("a", rank)
    names = x.select("key", "a", "section").distinct().select("key", "a", F.lit(-1).cast("long").alias("b"), F.concat(F.lit("\n## "), "section").alias("line"))
    return _together(head.union(names).union(x.select("key", "a", F.col("pos").cast("long"), F.concat(F.lit("- "), "text"))), "key")


def schema_document(tables: dict[str, DataFrame]) -> str:
    """The tables' columns and types as Markdown, from the plans alone: nothing is read."""
    parts = [f"## {n}\n\n| Column | Type |\n|---|---|\n" + "\n".join(f"| {f.name} | {f.dataType.simpleString()} |" for f in df.schema.fields) for n, df in sorted(tables.items())]
    return "# Schema\n\n" + "\n\n".join(parts) + "\n"


def fit(result: dict, limit: int = 25_000) -> dict:
    """A response whose JSON has at most `limit` characters: the longest list of `data` is halved until it fits, then the
    summary is cut. What was trimmed is told. For one response on its way out, not for data."""
    size = lambda x: len(json.dumps(x, default=str))
    if size(result) <= limit:
        return result
    out, trimmed = {**result, "data": dict(result["data"]) if isinstance(result.get("data"), dict) else result.get("data")}, set()
    while size(out) > limit and isinstance(out["data"], dict):
        lists = {k: v for k, v in out["data"].items() if isinstance(v, list) and len(v) > 1}
        if not lists:
            break
        longest = max(lists, key=lambda k: size(lists[k]))
        out["data"][longest] = lists[longest][: len(lists[longest]) // 2]
        trimmed.add(longest)
    if size(out) > limit:
        out |= {"summary": str(out.get("summary", ""))[: limit // 2] + "\n…(truncated)", "data": {"truncated": True}}
    return out | {"truncated": True, "next": f"Output was trimmed to fit {limit // 1000} KB ({', '.join(sorted(trimmed)) or 'summary'})."}
