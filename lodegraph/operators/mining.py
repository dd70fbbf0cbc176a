"""Roles, patterns, rules and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import glob_to_regex
from lodegraph.operators.graph import listed, unlisted

ROLE_FLOOR = 0.6


def role_scores(facts: DataFrame, rules: list[tuple[str, Column, float]]) -> DataFrame:
    """uid, role, score: weights of the rules that hold, summed by role. Rules are conditions on one row, so all are
    weighed in one projection and nothing is joined."""
    hits = F.array(*[F.when(cond, F.struct(F.lit(role).alias("role"), F.lit(float(w)).alias("w"))) for role, cond, w in rules])
    return facts.select("uid", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).groupBy("uid", F.col("h.role").alias("role")).agg(F.sum("h.w").alias("score"))


def decide_roles(scores: DataFrame, floor: float = ROLE_FLOOR) -> DataFrame:
    """uid, role, score, roles: the best by (score, name) among those at the floor or above, and all of them."""
    ok = scores.where(F.round("score", 6) >= floor)
    best = F.max(F.struct(F.round("score", 6).alias("score"), F.col("role")))
    return ok.groupBy("uid").agg(best.alias("b"), F.array_sort(F.collect_set("role")).alias("roles")).select("uid", F.col("b.role").alias("role"), F.round("b.score", 2).alias("score"), "roles")


def mode_by(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group, value, n: the most common value; among equals the one seen first."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max(F.struct(F.col("n"), (-F.col("first")).alias("early"), F.col(value).alias("value")))
    return counts.groupBy(group).agg(best.alias("b")).select(group, F.col("b.value").alias(value), F.col("b.n").alias("n"))


def support(rows: DataFrame, by: list[str], ok: Column, bad: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(ok).alias("support"), F.count_if(bad).alias("violations"))


def layered(edges: DataFrame, role: str, allowed: str, forbidden: list[str]) -> DataFrame:
    """uid, verdict of each node of `role` (src_role, dst_role on edges): violation if it depends on a forbidden role, else
    support if on the allowed one."""
    own = edges.where(F.col("src_role") == role).groupBy(F.col("src").alias("uid")).agg(F.bool_or(F.col("dst_role").isin(*forbidden)).alias("bad"), F.bool_or(F.col("dst_role") == allowed).alias("good"))
    return own.select("uid", F.when(F.col("bad"), "violation").when(F.col("good"), "support").otherwise("none").alias("verdict"))


def lifecycle_owners(methods: DataFrame, stages: dict[str, tuple[str, ...]], least: int = 3) -> DataFrame:
    """uid, n_stages, stages: classes whose methods' prefixes cover so many stages of a lifecycle."""
    stage = None
    for name, prefixes in stages.items():
        cond = F.col("method").rlike("^(" + "|".join(prefixes) + ")")
        stage = F.when(cond, name) if stage is None else stage.when(cond, name)
    hit = methods.withColumn("stage", stage).where("stage is not null")
    return hit.groupBy("uid").agg(F.count_distinct("stage").alias("n_stages"), F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages")).where(F.col("n_stages") >= least)


def forbid_dependency(edges: DataFrame, from_role: str, to_roles: list[str]) -> DataFrame:
    """violator, target of edges from one role to others."""
    return edges.where((F.col("src_role") == from_role) & F.col("dst_role").isin(*to_roles)).select(F.col("src").alias("violator"), F.col("dst").alias("target")).distinct()


def restrict_access(edges: DataFrame, target_role: str, only: list[str]) -> DataFrame:
    """violator, target of edges to a role from anything but some roles."""
    return edges.where((F.col("dst_role") == target_role) & ~F.col("src_role").isin(*only)).select(F.col("src").alias("violator"), F.col("dst").alias("target")).distinct()


def forbid_external(files: DataFrame, package: str) -> DataFrame:
    return files.where(F.array_contains("external_imports", package)).select(F.col("uid").alias("violator"), F.lit(package).alias("target"))


def placement(nodes: DataFrame, role: str, globs: list[str]) -> DataFrame:
    """violator, target (its path) of nodes of a role outside their places."""
    place = "|".join(map(glob_to_regex, globs))
    return nodes.where((F.col("role") == role) & ~F.col("path").rlike(place)).select(F.col("uid").alias("violator"), F.col("path").alias("target"))


def single_choice(uses: DataFrame, categories: DataFrame, least: int = 1) -> DataFrame:
    """category, library, n of categories in which a single library is used: others of the category are then forbidden."""
    g = uses.join(categories, "library").groupBy("category").agg(F.count_distinct("library").alias("k"), F.min("library").alias("library"), F.count("*").alias("n"))
    return g.where((F.col("k") == 1) & (F.col("n") >= least)).select("category", "library", "n")


def out_of_scope(files: DataFrame, planned: list[str], most: float = 0.3) -> DataFrame:
    """One row: changed lines outside the planned places, their share, and whether that fails."""
    rx = "|".join(map(glob_to_regex, planned))
    outside = ~F.col("path").rlike(rx)
    g = files.agg(F.coalesce(F.sum(F.when(outside, F.col("lines"))), F.lit(0)).alias("outside"), F.greatest(F.lit(1), F.coalesce(F.sum("lines"), F.lit(0))).alias("all"))
    return g.select("outside", (F.col("outside") / F.col("all")).alias("share"), (F.col("outside") / F.col("all") > most).alias("fails"))


def report(findings: DataFrame, waivers: DataFrame, by: str) -> DataFrame:
    """by, status, n_fail, n_warn, n_waived: any failure that isn't waived fails; else any warning, or waived failure, warns."""
    x = findings.join(waivers.select("finding", F.lit(True).alias("waived")).distinct(), "finding", "left").withColumn("waived", F.coalesce("waived", F.lit(False)))
    fail, warn = (F.col("level") == "fail") & ~F.col("waived"), (F.col("level") == "warn") | ((F.col("level") == "fail") & F.col("waived"))
    g = x.groupBy(by).agg(F.count_if(fail).alias("n_fail"), F.count_if(warn).alias("n_warn"), F.count_if("waived").alias("n_waived"))
    return g.select(by, F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").otherwise("pass").alias("status"), "n_fail", "n_warn", "n_waived")


def replay(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Events with the state before each in its key's order."""
    return events.withColumn("before", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))


#: Signs of roles (name endings, folders, decorators, and the weights of the three), stages of lifecycles by
#: how methods begin, and libraries that detectors know.
ROLE_SIGNS = (
    ("Service", ("Service",), ("services", "service"), ("Injectable", "Service"), 0.6, 0.3, 0.4),
    ("Repository", ("Repository", "Repo"), ("repositories", "repository", "repos", "dao"), ("Repository",), 0.6, 0.3, 0.4),
    ("Controller", ("Controller",), ("controllers", "controller"), ("Controller", "RestController"), 0.6, 0.3, 0.4),
    ("Middleware", ("Middleware",), ("middleware", "middlewares"), (), 0.5, 0.4, 0.4),
    ("Worker", ("Worker", "Processor", "Job", "Consumer"), ("workers", "jobs", "processors"), ("Processor",), 0.6, 0.3, 0.4),
    ("Queue", ("Queue", "Producer", "Publisher"), ("queues",), (), 0.6, 0.3, 0.4),
    ("Validator", ("Validator", "Schema"), ("validators", "schemas", "validation"), (), 0.6, 0.3, 0.4),
    ("Integration", ("Client", "Gateway", "Adapter", "Integration"), ("integrations", "clients", "adapters"), (), 0.3, 0.4, 0.4),
)
LIFECYCLES = {
    "token": {"create": ("create", "issue", "generate", "mint", "sign"), "validate": ("validate", "verify", "check", "find", "lookup"), "consume": ("consume", "redeem", "use", "burn"), "expire": ("expire", "revoke", "invalidate", "purge", "cleanup")},
    "queue": {"enqueue": ("enqueue", "add", "push", "publish", "schedule"), "process": ("process", "handle", "consume", "run"), "retry": ("retry", "requeue", "fail", "dead")},
}
TEST_FRAMEWORKS = ("vitest", "jest", "mocha", "pytest", "ava")
BODY_METHODS = ("POST", "PUT", "PATCH")
# end of fixed values


def local_role_scores(symbols: DataFrame) -> DataFrame:
    """uid, role, score by the symbol itself: name endings, folders, decorators, and what a parser says of it.

    symbols: uid, name, kind, path, parent, decorators, table, validator, returns_jsx, signature, external_imports.
    Methods have no role; routes are Routes; constants only have what parsers say. A table is a Model (and no Validator
    then); hooks, components and (req, next) functions have signs of their own; an Integration with external imports
    counts more. Weights of one row: nothing is joined."""
    name, kind, path = F.col("name"), F.col("kind"), F.col("path")
    empty = F.array().cast("array<string>")
    folders = F.transform(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.lower)
    file = F.lower(F.substring_index(path, "/", -1))
    external = F.size(F.coalesce("external_imports", empty)) > 0
    top = F.col("parent").isNull() & (kind != "method")
    plain = top & ~kind.isin("route", "const")
    weigh = lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), float(w)).otherwise(0.0)
    parts: dict[str, Column] = {}
    for role, ends, dirs, marks, a, b, c in ROLE_SIGNS:
        placed = F.arrays_overlap(folders, F.array(*map(F.lit, dirs))) | file.rlike("|".join(rf"\.{d.rstrip('s')}\." for d in dirs))
        marked = F.arrays_overlap(F.coalesce("decorators", empty), F.array(*map(F.lit, marks))) if marks else F.lit(False)
        parts[role] = weigh(plain & name.rlike("(" + "|".join(ends) + ")$"), a) + weigh(plain & placed, b) + weigh(plain & marked, c)
    parts["Integration"] = parts["Integration"] + F.when((parts["Integration"] > 0) & external, 0.2).otherwise(0.0)
    parts["Middleware"] = parts["Middleware"] + weigh(plain & (kind == "function") & F.col("signature").contains("next") & F.col("signature").contains("req"), 0.3)
    model = top & (kind != "route") & F.col("table").isNotNull()
    parts["Validator"] = F.when(F.coalesce(model, F.lit(False)), 0.0).otherwise(F.greatest(parts["Validator"], weigh(top & (kind != "route") & F.col("validator").isNotNull(), 0.8)))
    parts["Model"] = weigh(model, 0.95)
    parts["Route"] = weigh(top & (kind == "route"), 1.0)
    parts["Hook"] = weigh(plain & (kind == "function") & name.rlike(r"^use[A-Z]\w*$") & path.rlike(r"\.(ts|tsx|js|jsx)$"), 0.8)
    parts["Component"] = weigh(plain & kind.isin("function", "class") & F.col("returns_jsx") & name.rlike("^[A-Z][A-Za-z0-9]*$"), 0.85)
    every = F.array(*[F.struct(F.lit(r).alias("role"), s.alias("score")) for r, s in parts.items()])
    return symbols.select("uid", F.explode(F.filter(every, lambda x: x["score"] > 0)).alias("x")).select("uid", "x.role", F.round("x.score", 6).alias("score"))


def boosted_roles(symbols: DataFrame, scores: DataFrame, used_by: DataFrame, models: DataFrame) -> DataFrame:
    """uid, role, score after a look at the graph: a class that controllers or routes (used_by: uid, role) use is more of a
    Service if it is one at all, and one that accesses a model (models: uid) more of a Repository."""
    classes = symbols.where("kind = 'class'").select("uid")
    served = used_by.where("role in ('Controller', 'Route')").select("uid").distinct().join(classes, "uid", "left_semi").withColumn("served", F.lit(True))
    data = models.select("uid").distinct().join(classes, "uid", "left_semi")
    more = data.select("uid", F.lit("Repository").alias("role"), F.lit(0.4).alias("score"))
    x = scores.join(served, "uid", "left").withColumn("score", F.col("score") + F.when(F.col("served") & (F.col("role") == "Service"), 0.2).otherwise(0.0)).drop("served")
    return x.unionByName(more).groupBy("uid", "role").agg(F.round(F.sum("score"), 6).alias("score"))


def classified(symbols: DataFrame, uses: DataFrame, accesses: DataFrame) -> DataFrame:
    """uid, role, score in two passes: what symbols are by themselves names the users' roles (uses: src, dst; accesses:
    src, dst), which weigh in the second."""
    local = local_role_scores(symbols)
    first = decide_roles(local).select("uid", "role")
    used = uses.join(first.withColumnRenamed("uid", "src"), "src").select(F.col("dst").alias("uid"), "role")
    models = accesses.join(first.where("role = 'Model'").withColumnRenamed("uid", "dst"), "dst").select(F.col("src").alias("uid"))
    out = decide_roles(boosted_roles(symbols, local, used, models))
    return out.select("uid", "role", F.least(F.lit(1.0), F.col("score")).alias("score"))


def most_common(rows: DataFrame, value: str, order: str) -> DataFrame:
    """One row: value and n of the most common value, among equals that of the smallest `order`; none of an empty table."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.col("n").desc(), "_first").limit(1).select(value, "n")


def data_access(edges: DataFrame) -> DataFrame:
    """uid, verdict of each class that accesses a model (src_role, dst_role on edges of accesses): support iff it is a
    Repository. A source without a role violates."""
    own = edges.where("dst_role = 'Model'").select(F.col("src").alias("uid"), (F.coalesce("src_role", F.lit("")) == "Repository").alias("ok"))
    return own.groupBy("uid").agg(F.bool_or("ok").alias("ok")).select("uid", F.when(F.col("ok"), "support").otherwise("violation").alias("verdict"))


def route_validation(routes: DataFrame, uses: DataFrame, validators: DataFrame) -> DataFrame:
    """uid, verdict, library of routes that take a body: support if they use a validator (uid, validator) or are flagged
    validated. The library is the most common one; without validators there is no pattern."""
    library = most_common(validators, "validator", "uid").select(F.col("validator").alias("library"))
    hit = uses.join(validators.select(F.col("uid").alias("dst")), "dst", "left_semi").select(F.col("src").alias("uid"), F.lit(True).alias("uses")).distinct()
    body = routes.where(F.upper("http_method").isin(*BODY_METHODS)).join(hit, "uid", "left")
    ok = F.coalesce("uses", F.lit(False)) | F.coalesce("validated", F.lit(False))
    return body.select("uid", F.when(ok, "support").otherwise("violation").alias("verdict")).join(F.broadcast(library))


def error_base(symbols: DataFrame, extends: DataFrame) -> DataFrame:
    """uid, verdict, base: classes named ...Error or ...Exception that extend the most extended class (of at least two) or
    don't. The smallest uid is the base among equals."""
    base = most_common(extends.join(symbols.select(F.col("uid").alias("dst")), "dst", "left_semi"), "dst", "dst").where("n >= 2").select(F.col("dst").alias("base"))
    own = symbols.where((F.col("kind") == "class") & F.col("name").rlike("(Error|Exception)$")).select("uid").join(F.broadcast(base)).where("uid <> base")
    hit = extends.select(F.col("src").alias("uid"), F.col("dst").alias("base"), F.lit(True).alias("hit")).distinct()
    return own.join(hit, ["uid", "base"], "left").select("uid", F.when(F.col("hit"), "support").otherwise("violation").alias("verdict"), "base")


def test_layout(files: DataFrame) -> DataFrame:
    """uid, verdict, layout, framework of test files (uid, path, is_test, external_imports): whether they lie as most do,
    in a folder for tests or beside the code. Under two test files there is no pattern."""
    tests = files.where("is_test").withColumn("layout", F.when(F.split("path", "/")[0].isin("tests", "test", "__tests__"), "tests-dir").otherwise("co-located"))
    usual = most_common(tests, "layout", "path").select(F.col("layout").alias("usual"))
    used = tests.select("path", F.explode("external_imports").alias("framework")).where(F.col("framework").isin(*TEST_FRAMEWORKS))
    framework = usual.join(most_common(used, "framework", "path").select("framework"), F.lit(True), "left")
    enough = tests.agg(F.count("*").alias("_tests")).where("_tests >= 2")
    told = framework.join(enough)
    return tests.join(F.broadcast(told)).select("uid", F.when(F.col("layout") == F.col("usual"), "support").otherwise("violation").alias("verdict"), F.col("usual").alias("layout"), F.coalesce("framework", F.lit("the project test runner")).alias("framework"))


def lifecycle_roles(classes: DataFrame, uses: DataFrame, lifecycle: str) -> DataFrame:
    """owner, uid, part of a lifecycle: classes (uid, name, methods) that cover three stages own it, classes that use an
    owner are users, and classes of the lifecycle's name that cover two stages and don't use the owner are rivals."""
    stages = LIFECYCLES[lifecycle]
    low = F.transform(F.coalesce("methods", F.array().cast("array<string>")), F.lower)
    begins = lambda prefixes: F.exists(low, lambda m: m.rlike("^(" + "|".join(prefixes) + ")")).cast("int")
    covers = [begins(v) for v in stages.values()]
    x = classes.withColumn("covered", sum(covers, F.lit(0)))
    owners = x.where("covered >= 3").select(F.col("uid").alias("owner"))
    users = uses.select(F.col("src").alias("uid"), F.col("dst").alias("owner")).distinct().join(owners, "owner", "left_semi").join(classes.select("uid"), "uid", "left_semi").where("uid <> owner")
    near = x.where((F.col("covered") >= 2) & F.lower("name").contains(lifecycle)).select("uid")
    # what a class uses goes with it, so that pairs of rivals are made where they are written, and not shuffled
    used = near.join(users.groupBy("uid").agg(F.collect_list("owner").alias("own")), "uid", "left").select(F.lit(0).alias("k"), F.struct("uid", F.coalesce("own", F.array()).alias("own")).alias("c"))
    met = listed(used, "k", "c").withColumnRenamed("items", "p").join(listed(owners.withColumn("k", F.lit(0)), "k", "owner").withColumnRenamed("items", "q"), "k")
    rivals = unlisted(met, "p", "q", "c", "owner").select("owner", "c.uid", "c.own").where("uid <> owner and not array_contains(own, owner)")
    part = lambda df, name: df.select("owner", "uid", F.lit(name).alias("part"))
    return part(owners.select("owner", F.col("owner").alias("uid")), "owner").union(part(users, "user")).union(part(rivals, "rival"))
