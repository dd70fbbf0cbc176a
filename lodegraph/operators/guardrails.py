"""Checks over a change: each gives findings (id, check, severity, message, path, line, waived).

symbols: uid, name, kind, path, line_start, loc, roles, methods, exported, validated of what a change adds or modifies;
null roles, flags and counts count as none, false and 0. Empty tables give no findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Packages by what they are for, files of infrastructure, limits of the checks, forms of test reports.
CATEGORIES = {
    "validation": ("zod", "joi", "yup", "class-validator", "valibot", "pydantic", "marshmallow"),
    "orm": ("drizzle-orm", "prisma", "@prisma/client", "typeorm", "sequelize", "mongoose", "knex", "sqlalchemy", "django"),
    "state-management": ("redux", "@reduxjs/toolkit", "zustand", "mobx", "jotai", "recoil", "pinia", "vuex"),
    "http-client": ("axios", "got", "node-fetch", "ky", "superagent", "requests", "httpx"),
    "queue": ("bullmq", "bull", "bee-queue", "agenda", "celery", "rq"),
    "test": ("vitest", "jest", "mocha", "ava", "pytest"),
    "email": ("nodemailer", "@sendgrid/mail", "postmark", "resend"),
    "web-framework": ("express", "fastify", "koa", "@nestjs/core", "hono", "fastapi", "flask"),
}
INFRASTRUCTURE = ("dockerfile", "docker-compose.yml", "docker-compose.yaml", "procfile", "k8s", "helm", "terraform", ".github", ".gitlab-ci.yml")
MOST_CONTROLLER_LINES, MOST_ABSTRACTIONS, DUPLICATE_AT = 25, 3, 0.70
TEST_COUNTS = (r"(?i)(\d+)\s+passed", r"(?i)tests:\s+(\d+)\s+passed", r"(?i)(\d+)\s+tests? passed", r"(?i)Tests:\s+(\d+)\s+passed,\s+(\d+)\s+total")
# end of fixed values

COLUMNS = ("id", "check", "severity", "message", "path", "line", "waived")


def _has(role: str) -> Column:
    return F.coalesce(F.array_contains("roles", role), F.lit(False))


def _findings(rows: DataFrame, check: str, id_: Column, severity: Column | str, message: Column, waived: Column | None = None) -> DataFrame:
    optional = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(id_.alias("id"), F.lit(check).alias("check"), level.alias("severity"), message.alias("message"), optional("path", "string").alias("path"), optional("line_start", "int").alias("line"), (waived if waived is not None else F.lit(False)).alias("waived"))


def duplication(added: DataFrame, best: DataFrame, plan: DataFrame) -> DataFrame:
    """Added classes and functions with a role whose best reuse candidate (uid, top, score) is too similar. A reason in
    the plan (name, justification) waives the failure."""
    x = added.where(F.col("kind").isin("class", "function") & (F.size(F.coalesce("roles", F.array().cast("array<string>"))) > 0))
    x = x.join(best.where(F.col("score") >= DUPLICATE_AT), "uid").join(plan.select("name", "justification").dropDuplicates(["name"]), "name", "left")
    reason = F.coalesce("justification", F.lit("")) != ""
    text = F.format_string("'%s' duplicates existing '%s' (similarity %.2f)", F.col("name"), F.col("top"), F.col("score"))
    return _findings(x, "duplication", F.concat(F.lit("dup-"), "name"), F.when(reason, "warn").otherwise("fail"), text, reason)


def abstraction(added: DataFrame, plan: DataFrame) -> DataFrame:
    """Added classes and functions with a role that the plan (name) doesn't declare, and one finding for too many."""
    own = added.where(F.col("kind").isin("class", "function") & (F.size(F.coalesce("roles", F.array().cast("array<string>"))) > 0))
    undeclared = own.join(plan.select("name").distinct(), "name", "left_anti")
    many = own.agg(F.count("*").alias("n")).where(F.col("n") > MOST_ABSTRACTIONS)
    return _findings(undeclared, "abstraction", F.concat(F.lit("abs-undeclared-"), "name"), "warn", F.format_string("'%s' was not declared in the plan", F.col("name"))).union(
        _findings(many, "abstraction", F.lit("abs-count-limit"), "warn", F.format_string("%d new abstractions (limit %d)", F.col("n"), F.lit(MOST_ABSTRACTIONS)))
    )


def architecture(violations: DataFrame, changed: DataFrame) -> DataFrame:
    """Violations of validated constraints (constraint, title, severity, violator, target) whose either end the change
    touches."""
    uids = changed.select("uid").distinct()
    hit = violations.join(uids.withColumnRenamed("uid", "violator"), "violator", "left_semi").union(violations.select("violator", *[c for c in violations.columns if c != "violator"]).join(uids.withColumnRenamed("uid", "target"), "target", "left_semi").select("violator", *[c for c in violations.columns if c != "violator"])).distinct()
    return _findings(hit, "architecture", F.concat_ws("-", F.lit("arch"), "constraint", "violator", "target"), "fail", F.format_string("violates '%s'", F.col("title")))


def reusability(changed: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Long controller functions, services that aren't exported, and controllers that reach into the data layer.
    symbols: uid, name, roles of the whole graph."""
    long = changed.where((_has("Controller") | _has("Route")) & F.col("kind").isin("function", "method") & (F.col("loc") > MOST_CONTROLLER_LINES))
    hidden = changed.where(_has("Service") & (F.col("kind") == "class") & ~F.coalesce("exported", F.lit(False)))
    data = symbols.where(_has("Repository") | _has("Model")).select(F.col("uid").alias("dst"), F.col("name").alias("target"))
    reach = edges.where(F.col("rel").isin("USES", "CALLS", "ACCESSES")).select("src", "dst").distinct().join(data, "dst")
    layers = changed.where(_has("Controller")).join(reach.withColumnRenamed("src", "uid"), "uid")
    out = _findings(long, "reusability", F.concat(F.lit("reuse-controller-loc-"), "name"), "warn", F.format_string("'%s' has %d lines of code", F.col("name"), F.col("loc")))
    out = out.union(_findings(hidden, "reusability", F.concat(F.lit("reuse-unexported-service-"), "name"), "warn", F.format_string("service '%s' is not exported", F.col("name"))))
    return out.union(_findings(layers, "reusability", F.concat_ws("-", F.lit("reuse-layering"), "name", "target"), "warn", F.format_string("controller '%s' directly accesses '%s'", F.col("name"), F.col("target"))))


def consistency(added: DataFrame) -> DataFrame:
    """Routes without validation, and services and repositories that aren't named so. One pass: each rule is a condition
    on the row."""
    named = lambda rx: F.col("name").rlike(rx)
    rules = (
        ("const-route-unvalidated-", (_has("Route") | (F.col("kind") == "route")) & ~F.coalesce("validated", F.lit(False)), "lacks input validation"),
        ("const-service-naming-", _has("Service") & (F.col("kind") == "class") & ~named("Service$"), "is a service not named so"),
        ("const-repo-naming-", _has("Repository") & (F.col("kind") == "class") & ~named("(Repository|Repo)$"), "is a repository not named so"),
    )
    hit = F.filter(F.array(*[F.when(c, F.struct(F.lit(p).alias("prefix"), F.lit(m).alias("says"))) for p, c, m in rules]), lambda h: h.isNotNull())
    x = added.withColumn("_hit", F.explode(hit))
    return _findings(x, "consistency", F.concat("_hit.prefix", "name"), "warn", F.concat_ws(" ", F.col("name"), "_hit.says"))


def category_of(package: Column) -> Column:
    table = F.create_map(*[F.lit(v) for c, packages in CATEGORIES.items() for p in packages for v in (p, c)])
    return F.try_element_at(table, F.lower(package))


def complexity(new_deps: DataFrame, existing: DataFrame, forbidden: DataFrame, files: DataFrame) -> DataFrame:
    """New dependencies (dep, manifest): forbidden ones (dep, title) and those of a category that existing ones (dep)
    serve fail, others warn; and added files (path, status) of infrastructure."""
    served = existing.select(F.col("dep").alias("_dep"), category_of(F.col("dep")).alias("category")).where("category is not null").groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("_dep")), ", ").alias("current"), F.collect_set("_dep").alias("_set"))
    x = new_deps.select("dep", F.col("manifest").alias("path")).withColumn("category", category_of(F.col("dep")))
    x = x.join(served, "category", "left").join(forbidden.groupBy("dep").agg(F.min("title").alias("title")), "dep", "left")
    twice = F.col("current").isNotNull() & ~F.coalesce(F.array_contains("_set", F.col("dep")), F.lit(False))
    says = F.when(F.col("title").isNotNull(), F.format_string("'%s' violates %s", F.col("dep"), F.col("title"))).when(twice, F.format_string("'%s' duplicates category %s of %s", F.col("dep"), F.col("category"), F.col("current"))).otherwise(F.format_string("new dependency '%s'", F.col("dep")))
    out = _findings(x, "complexity", F.concat(F.lit("complex-dep-"), "dep"), F.when(F.col("title").isNotNull() | twice, "fail").otherwise("warn"), says)
    low = F.lower("path")
    infra = files.where((F.col("status") == "A") & F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, INFRASTRUCTURE))))
    return out.union(_findings(infra, "complexity", F.concat(F.lit("complex-infra-"), F.substring_index(low, "/", -1)), "warn", F.format_string("new infrastructure file '%s'", F.col("path"))))


def test_count(output: Column) -> Column:
    """The number of tests that a runner's output tells, by the first form that occurs; null if none does."""
    found = [F.nullif(F.regexp_extract(output, rx, 1), F.lit("")) for rx in TEST_COUNTS]
    return F.coalesce(*found).cast("int")


def junit_count(xml: Column) -> Column:
    """Tests of a JUnit report: the root's number, else the sum over suites; null without any."""
    root = F.nullif(F.xpath_string(xml, F.lit("/*/@tests")), F.lit("")).cast("int")
    total = F.xpath_int(xml, F.lit("sum(//testsuite/@tests)"))
    return F.coalesce(root, F.when(total > 0, total))


def regression(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Commands (name, exit_code, output) that failed, and test counts below their baseline (name, tests)."""
    x = runs.withColumn("now", test_count(F.col("output"))).join(baseline.select("name", F.col("tests").alias("before")), "name", "left")
    failed, fewer = F.col("exit_code") != 0, F.col("now") < F.col("before")
    out = _findings(x.where(failed), "regression", F.concat(F.lit("reg-exit-"), "name"), "fail", F.format_string("'%s' exited with %d", F.col("name"), F.col("exit_code")))
    return out.union(_findings(x.where(fewer), "regression", F.concat(F.lit("reg-count-"), "name"), "fail", F.format_string("%d tests, %d before", F.col("now"), F.col("before"))))


def run_metrics(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: failed duplication and architecture checks (0 or 1 each), complexity, scope and all findings, and lines
    added and deleted."""
    fails = lambda c: F.max(F.when((F.col("check") == c) & (F.col("severity") == "fail") & ~F.col("waived"), 1).otherwise(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    a = findings.agg(zero(fails("duplication")).alias("duplicate_abstractions"), zero(fails("architecture")).alias("constraint_violations"), F.count_if(F.col("check") == "complexity").alias("new_dependencies"), F.count_if(F.col("check") == "scope").alias("out_of_scope_files"), F.count("*").alias("total_findings"))
    b = files.agg(zero(F.sum("added")).alias("lines_added"), zero(F.sum("deleted")).alias("lines_deleted"))
    return a.join(b)
