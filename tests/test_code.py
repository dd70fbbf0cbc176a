"""Roles, detectors, reuse and guardrails on small tables with literal results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import guardrails, mining, reuse

SYMBOL = "uid string, name string, kind string, path string, parent string, decorators array<string>, `table` string, validator string, returns_jsx boolean, signature string, external_imports array<string>"


def one(spark, make, *xs):
    cols = [f"c{i}" for i in range(len(xs))]
    return spark.range(1).select(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)).cast("array<string>") for x in xs]).toDF(*cols).select(make(*map(F.col, cols)).alias("y")).first().y


def test_reuse_features(spark):
    assert sorted(one(spark, reuse.core_tokens, "MailerService")) == ["email"] and one(spark, reuse.core_tokens, "BaseService") == ["base", "service"]
    assert one(spark, reuse.name_similarity, "MailerService", "EmailService", "") == 1.0
    assert one(spark, reuse.name_similarity, "InviteTokenStore", "TokenService", "") == 0.9
    assert one(spark, reuse.name_similarity, "Foo", "PasswordReset", "reset the password") == 0.8
    assert one(spark, reuse.name_similarity, "", "X", "") == 0.0
    for method, verb in {"issueToken": "create", "fetchAll": "validate", "burn": "consume", "revoke_all": "expire", "notifyUser": "send", "patch": "update", "searchX": "list", "frobnicate": "frobnicate", "_": None}.items():
        assert one(spark, reuse.normal_verb, method) == verb
    assert one(spark, reuse.method_overlap, ["create", "verify"], ["issue", "check", "revoke"]) == 1.0
    assert one(spark, reuse.method_overlap, ["create"], []) == 0.0
    assert one(spark, reuse.inferred_role, "UserRepo") == "Repository" and one(spark, reuse.inferred_role, "Foo") is None
    assert one(spark, lambda m: reuse.lifecycle_text(F.lit(None).cast("string"), m), ["create", "verify", "burn", "x"]) == "create → verify → burn"


def test_reuse_verdicts(spark):
    p = spark.createDataFrame([("p1", "InviteTokenService", "issues invitation tokens", ["create", "validate", "expire"], None), ("p2", "WeatherClient", "", ["forecast"], None), ("p3", None, None, None, None)], "uid string, name string, description string, methods array<string>, role string")
    s = spark.createDataFrame([("s1", "TokenService", "class", ["Service"], ["issue", "verify", "revoke"], 8, True), ("s2", "TokenModel", "class", ["Model"], [], 0, False), ("s3", "InviteTokenService", "class", ["Service"], ["create"], 0, False), ("s4", "Clock", "class", None, None, None, None)], "uid string, name string, kind string, roles array<string>, methods array<string>, fan_in int, validated_pattern boolean")
    v = spark.createDataFrame([("p1", "s1", 0.8)], "proposal string, uid string, vector double")
    got = {(r.proposal, r.uid): r for r in reuse.find(p, s, v).collect()}
    assert set(got) == {("p1", "s1")}
    r = got["p1", "s1"]
    assert (r.f_name, r.f_methods, r.f_maturity, r.f_pattern, r.f_role, r.verdict) == (0.9, 1.0, 1.0, 1.0, 1.0, "reuse")
    assert r.score == pytest.approx(0.30 * 0.8 + 0.25 * 0.9 + 0.25 + 0.10 + 0.05 + 0.05)
    users = spark.createDataFrame([("s1", "B"), ("s1", "A"), ("s1", "A")], "uid string, user string")
    patterns = spark.createDataFrame([("s1", "P", "validated"), ("s1", "Q", "rejected")], "uid string, title string, status string")
    e = reuse.enriched(reuse.find(p, s, v), users, patterns, patterns.where("false").select("uid", "title")).first()
    assert (e.used_by, e.patterns, e.knowledge) == (["A", "B"], ["P"], [])
    assert reuse.find(p.where("false"), s).count() == 0 and reuse.find(p, s.where("false")).count() == 0


def test_roles(spark):
    rows = [
        ("a", "UserService", "class", "src/services/user.ts", None, ["Injectable"], None, None, False, "", []),
        ("b", "users", "const", "src/db/schema.ts", None, [], "users", "zod", False, "", []),
        ("c", "POST /x", "route", "src/routes/x.ts", None, [], None, None, False, "", []),
        ("d", "useThing", "function", "src/hooks/t.ts", None, [], None, None, False, "", []),
        ("e", "Panel", "function", "src/p.tsx", None, [], None, None, True, "", []),
        ("f", "guard", "function", "src/middleware/g.ts", None, [], None, None, False, "(req, res, next)", []),
        ("g", "MailClient", "class", "src/x.ts", None, [], None, None, False, "", ["axios"]),
        ("h", "find", "method", "src/services/user.ts", "a", None, None, None, None, None, None),
        ("i", "Users", "class", "src/db/u.ts", None, None, None, None, None, None, None),
        ("j", "UserController", "class", "src/controllers/u.ts", None, None, None, None, None, None, None),
        ("k", "Plain", None, None, None, None, None, None, None, None, None),
    ]
    symbols = spark.createDataFrame(rows, SYMBOL)
    uses = spark.createDataFrame([("j", "a"), ("j", "i")], "src string, dst string")
    accesses = spark.createDataFrame([("a", "b")], "src string, dst string")
    local = {(r.uid, r.role): r.score for r in mining.local_role_scores(symbols).collect()}
    assert local["a", "Service"] == pytest.approx(1.3) and local["b", "Model"] == 0.95 and ("b", "Validator") not in local
    assert local["f", "Middleware"] == pytest.approx(0.7) and local["g", "Integration"] == pytest.approx(0.5) and not [x for x in local if x[0] in "hk"]
    got = {r.uid: (r.role, r.score) for r in mining.classified(symbols, uses, accesses).collect()}
    assert got == {"a": ("Service", 1.0), "b": ("Model", 0.95), "c": ("Route", 1.0), "d": ("Hook", 0.8), "e": ("Component", 0.85), "f": ("Middleware", 0.7), "j": ("Controller", 0.9)}
    assert mining.classified(symbols.where("false"), uses, accesses).where("role <> 'Repository'").count() == 0


def verdicts(df):
    return {r.uid: r.verdict for r in df.collect()}


def test_detectors(spark):
    routes = spark.createDataFrame([("r1", "post", None), ("r2", "PUT", True), ("r3", "PATCH", False), ("r4", "GET", False), ("r5", None, None)], "uid string, http_method string, validated boolean")
    v = spark.createDataFrame([("v1", "zod"), ("v2", "zod"), ("v3", "joi"), ("v4", None)], "uid string, validator string")
    uses = spark.createDataFrame([("r1", "v1"), ("r1", "v2"), ("r3", "x")], "src string, dst string")
    got = mining.route_validation(routes, uses, v)
    assert verdicts(got) == {"r1": "support", "r2": "support", "r3": "violation"} and {r.library for r in got.collect()} == {"zod"}
    assert mining.route_validation(routes, uses, v.where("false")).count() == 0
    symbols = spark.createDataFrame([("b", "AppError", "class"), ("e1", "NotFoundError", "class"), ("e2", "BadException", "class"), ("e3", "LoneError", "class"), ("x", "Thing", "class")], "uid string, name string, kind string")
    extends = spark.createDataFrame([("e1", "b"), ("e2", "b"), ("x", "gone"), ("y", "gone"), ("z", "gone")], "src string, dst string")
    assert verdicts(mining.error_base(symbols, extends)) == {"e1": "support", "e2": "support", "e3": "violation"}
    assert mining.error_base(symbols, extends.limit(1)).count() == 0
    files = spark.createDataFrame([("t1", "tests/a.ts", True, ["vitest"]), ("t2", "tests/b.ts", True, ["vitest", "x"]), ("t3", "src/c.test.ts", True, ["jest"]), ("s", "src/c.ts", False, None)], "uid string, path string, is_test boolean, external_imports array<string>")
    got = mining.test_layout(files)
    assert verdicts(got) == {"t1": "support", "t2": "support", "t3": "violation"} and {(r.layout, r.framework) for r in got.collect()} == {("tests-dir", "vitest")}
    assert mining.test_layout(files.limit(1)).count() == 0
    classes = spark.createDataFrame([("o", "TokenService", ["createToken", "verify", "revokeAll"]), ("u", "Invite", ["run"]), ("r", "ResetTokenStore", ["issue", "check"]), ("n", "Other", ["issue", "check"]), ("m", "TokenX", None)], "uid string, name string, methods array<string>")
    used = spark.createDataFrame([("u", "o")], "src string, dst string")
    assert {(r.owner, r.uid, r.part) for r in mining.lifecycle_roles(classes, used, "token").collect()} == {("o", "o", "owner"), ("o", "u", "user"), ("o", "r", "rival")}
    e = spark.createDataFrame([("a", "m", "Repository", "Model"), ("b", "m", None, "Model"), ("c", "x", "Service", "Service")], "src string, dst string, src_role string, dst_role string")
    assert verdicts(mining.data_access(e)) == {"a": "support", "b": "violation"}


CHANGE = "uid string, name string, kind string, path string, line_start int, loc int, roles array<string>, methods array<string>, exported boolean, validated boolean"


def found(df):
    assert tuple(df.columns) == guardrails.COLUMNS
    return {r.id: (r.severity, r.waived) for r in df.collect()}


def test_guardrails(spark):
    rows = [
        ("a", "OrderService", "class", "a.ts", 1, 9, ["Service"], [], False, None),
        ("b", "Orders", "class", "b.ts", 1, 9, ["Repository"], [], True, None),
        ("c", "list", "method", "c.ts", 5, 40, ["Controller"], [], None, None),
        ("d", "POST /x", "route", "d.ts", 1, 3, ["Route"], [], None, None),
        ("e", "GET /x", "route", "d.ts", 2, 3, None, None, None, True),
        ("f", "helper", "function", "f.ts", None, None, None, None, None, None),
        ("g", "Billing", "class", "g.ts", 1, 5, ["Service"], [], True, None),
    ]
    change = spark.createDataFrame(rows, CHANGE)
    none = change.where("false")
    plan = spark.createDataFrame([("OrderService", "legacy must stay"), ("Billing", None)], "name string, justification string")
    best = spark.createDataFrame([("a", "CartService", 0.9), ("b", "CartRepo", 0.7), ("g", "Pay", 0.69)], "uid string, top string, score double")
    assert found(guardrails.duplication(change, best, plan)) == {"dup-OrderService": ("warn", True), "dup-Orders": ("fail", False)}
    assert found(guardrails.abstraction(change, plan)) == {"abs-undeclared-Orders": ("warn", False)}
    assert set(found(guardrails.abstraction(change.union(change.where("uid = 'a'")), plan))) == {"abs-undeclared-Orders", "abs-count-limit"}
    edges = spark.createDataFrame([("USES", "c", "b"), ("IMPORTS", "c", "a"), ("CALLS", "c", "a")], "rel string, src string, dst string")
    assert set(found(guardrails.reusability(change, edges, change))) == {"reuse-controller-loc-list", "reuse-unexported-service-OrderService", "reuse-layering-list-Orders"}
    assert set(found(guardrails.consistency(change))) == {"const-route-unvalidated-POST /x", "const-service-naming-Billing", "const-repo-naming-Orders"}
    violations = spark.createDataFrame([("k1", "no repos", "error", "c", "b"), ("k1", "no repos", "error", "zz", "yy"), ("k2", "t", "warn", "zz", "a")], "constraint string, title string, severity string, violator string, target string")
    assert found(guardrails.architecture(violations, change)) == {"arch-k1-c-b": ("fail", False), "arch-k2-zz-a": ("fail", False)}
    new = spark.createDataFrame([("joi", "package.json"), ("left-pad", "package.json"), ("axios", "p.json"), ("zod", "p.json")], "dep string, manifest string")
    existing = spark.createDataFrame([("zod",), ("Express",)], "dep string")
    bans = spark.createDataFrame([("left-pad", "no left-pad")], "dep string, title string")
    files = spark.createDataFrame([("Dockerfile", "A", 10, 0), (".github/workflows/x.yml", "A", 5, 0), ("helm", "M", 1, 1)], "path string, status string, added int, deleted int")
    assert found(guardrails.complexity(new, existing, bans, files)) == {"complex-dep-joi": ("fail", False), "complex-dep-left-pad": ("fail", False), "complex-dep-axios": ("warn", False), "complex-dep-zod": ("warn", False), "complex-infra-dockerfile": ("warn", False), "complex-infra-x.yml": ("warn", False)}
    runs = spark.createDataFrame([("t", 0, "== 12 passed =="), ("u", 1, "boom"), ("v", 0, "Tests:  7 passed, 7 total"), ("w", 0, None)], "name string, exit_code int, output string")
    base = spark.createDataFrame([("t", 20), ("v", 7), ("w", 1)], "name string, tests int")
    assert found(guardrails.regression(runs, base)) == {"reg-count-t": ("fail", False), "reg-exit-u": ("fail", False)}
    everything = guardrails.duplication(change, best, plan).union(guardrails.complexity(new, existing, bans, files))
    assert tuple(guardrails.run_metrics(everything, files).first()) == (1, 0, 6, 0, 8, 16, 1)
    assert tuple(guardrails.run_metrics(everything.where("false"), files.where("false")).first()) == (0,) * 7
    for empty in (guardrails.duplication(none, best, plan), guardrails.abstraction(none, plan), guardrails.reusability(none, edges, none), guardrails.consistency(none)):
        assert empty.count() == 0


def test_junit_counts(spark):
    reports = {'<testsuites tests="7"><testsuite tests="3"/></testsuites>': 7, '<testsuites><testsuite tests="3"/><testsuite tests="4"/></testsuites>': 7, "<testsuites/>": None}
    for xml, n in reports.items():
        assert one(spark, guardrails.junit_count, xml) == n


def test_reuse_meets_kinds_not_rows(spark):
    """Sixty times the same symbols are no more pairs of kinds; own names, ties and the boundary of k stay right."""
    p = spark.createDataFrame([(f"p{i}", n, "", ["create", "verify"], "Service") for i, n in enumerate(("TokenService", "TokenRepo", "UserToken", "Clock"))], "uid string, name string, description string, methods array<string>, role string")
    names = ("TokenService", "TokenRepo", "TokenClient", "UserToken", "User", "Clock", "Plain")
    rows = [(f"s{i:03}", names[i % 7], "class" if i % 3 else "function", ["Service"] if i % 2 else ["Repository"], [["issue", "check"], ["burn"], [], ["create", "send", "list"]][i % 4], i % 9, i % 5 == 0) for i in range(420)]
    s = spark.createDataFrame(rows, "uid string, name string, kind string, roles array<string>, methods array<string>, fan_in int, validated_pattern boolean")
    cols = ["proposal", "uid", "rank", "score", "f_name", "f_methods", "f_maturity", "f_pattern", "f_role", "verdict"]
    got = {tuple(r) for r in reuse.find(p, s).select(*cols).collect()}
    every = reuse.scored(p, s, reuse.candidates(p, s))
    want = {tuple(r) for r in reuse.top_per(every, ["proposal"], [F.col("score").desc(), F.col("name"), F.col("uid")], 5).select(*cols).collect()}
    assert got == want and len(got) == 20
    asking = reuse._asking(p).groupBy(*reuse._ASKS).agg(F.min("proposal").alias("gid")).withColumn("words", F.array_union(F.array_union("core", "described"), F.col("asked")))
    few, many = (reuse._kinds(asking, reuse._having(x, 5)).count() for x in (s, s.withColumn("uid", F.explode(F.array(*[F.concat("uid", F.lit(f"-{j}")) for j in range(60)])))))
    assert few == many
