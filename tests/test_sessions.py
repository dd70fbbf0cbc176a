"""Sessions, memory, reports, ids and the TypeScript scanner on small inputs with literal results."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators import render, resolution, retrieval, sessions
from lodegraph.sources import typescript_modules


def test_ids(spark):
    one = spark.range(1)
    got = lambda c: one.select(c.alias("y")).first().y
    s = F.lit
    assert got(text.module_uid("p", s("./"))) == "p:mod:." and got(text.file_uid("p", s("a\\b.ts"))) == "p:file:a/b.ts"
    assert got(text.symbol_uid("p", s("a.ts"), s("X.y"))) == "p:sym:a.ts#X.y" and got(text.chunk_uid("p", s("d.md"), s(3))) == "p:chunk:d.md#3"
    assert got(text.knowledge_uid("p", s("pattern"), s("My Key!"))) == "p:k:pattern:my-key" and got(text.commit_uid("p", s("abc"))) == "p:commit:abc"
    assert got(text.run_uid("p", F.to_timestamp(s("2024-01-02 03:04:05.123456")))) == "p:run:20240102T030405123456"
    assert got(text.project_of(s("p:x:y"))) == "p" and len(got(text.event_uid("p"))) == len("p:event:") + 32


def test_feature_sessions(spark):
    features = spark.createDataFrame([("p:feat:feat_20240101_add-teams", "feat_20240101_add-teams", "n", "r", "planning", "b1", "2024-01-01"), ("p:feat:y", "y", "n", "r", "done", "b1", "2024-01-02"), ("p:feat:z", "z", "n", "r", "verifying", "b2", "2024-01-01")], "uid string, feature_id string, name string, request string, status string, branch string, created_at string")
    new = spark.createDataFrame([("Add teams", "PASSWORD=abcdefgh1", "b3", "2024-01-01 10:00:00"), ("Add teams", "second", "b3", "2024-01-01 11:00:00"), ("Other!", "x", None, "2024-01-01 11:00:00")], "name string, request string, branch string, at string").withColumn("at", F.to_timestamp("at"))
    got = {r.feature_id: r.request for r in sessions.start(new, features, "p").collect()}
    assert got == {"feat_20240101_add-teams-2": "PASSWORD=[REDACTED:env_assignment]", "feat_20240101_add-teams-3": "second", "feat_20240101_other": "x"}
    assert {(r.branch, r.uid) for r in sessions.active(features).collect()} == {("b1", "p:feat:feat_20240101_add-teams"), ("b2", "p:feat:z")}
    out, refused = sessions.move(features, spark.createDataFrame([("p:feat:y", "planning"), ("p:feat:z", "done"), ("p:feat:no", "done")], "uid string, status string"))
    assert {r.uid: r.status for r in out.collect()} == {"p:feat:feat_20240101_add-teams": "planning", "p:feat:y": "done", "p:feat:z": "done"} and {r.uid for r in refused.collect()} == {"p:feat:y", "p:feat:no"}
    plans = spark.createDataFrame([("p:feat:feat_20240101_add-teams", "do it", ["a.ts"], ["T"], ["p:k:pattern:x", "p:file:a"])], "uid string, summary string, files array<string>, abstractions array<string>, cited array<string>")
    out, cited = sessions.planned(features, plans)
    assert {r.uid: (r.status, r.planned_files) for r in out.collect()}["p:feat:feat_20240101_add-teams"] == ("in_progress", ["a.ts"]) and [r.dst for r in cited.collect()] == ["p:k:pattern:x"]
    pair = lambda *rows: spark.createDataFrame([(*r, "A") if len(r) == 2 else r for r in rows], "feature string, uid string, status string")
    edges = sessions.completed(spark.createDataFrame([("f",)], "uid string"), pair(("f", "s1", "A"), ("f", "s2", "M"), ("f", "s3", "D"), ("g", "s4", "A")), pair(("f", "r")).drop("status"), pair(("f", "t")).drop("status"), pair(("f", "e")).drop("status"))
    assert {(r.rel, r.dst) for r in edges.collect()} == {("INTRODUCES", "s1"), ("MODIFIES", "s2"), ("REUSES", "r"), ("TESTED_BY", "t"), ("HAS_EVIDENCE", "e")}


def test_memory(spark):
    schema = "uid string, kind string, session string, text string, at string"
    memory = spark.createDataFrame([("t1", "trace", "s", "add team invitation tokens", "1"), ("t2", "trace", "s", "fix billing invoice totals", "2"), ("p1", "preference", None, "Tabs please", "1"), ("m1", "message", "s9", "hello there", "3")], schema)
    out, refused = sessions.remember(memory, spark.createDataFrame([("m2", "message", "s9", "TOKEN=abcdefghij", "4"), ("p2", "preference", None, " tabs PLEASE", "5"), ("f1", "fact", None, "uses postgres", "6"), ("m3", "message", "s9", None, "7")], schema))
    assert {r.uid for r in out.collect()} == {"t1", "t2", "p1", "m1", "f1", "m3"} and [r.uid for r in refused.collect()] == ["m2"]
    ask = spark.createDataFrame([("q", "s9", "team invitation by email"), ("r", None, None)], "key string, session string, text string")
    assert {(r.key, r.kind, r.uid) for r in sessions.recall(ask, memory).collect()} == {("q", "preference", "p1"), ("r", "preference", "p1"), ("q", "trace", "t1"), ("q", "note", "m1")}


def test_similar_traces_equal_brute_force(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("uid"), "text")
    rows = [(r.uid, set(r.w)) for r in turns.select("uid", sessions.words(F.col("text")).alias("w")).collect()]
    asked = turns.where("cast(uid as long) % 50 = 0").withColumnRenamed("uid", "key")
    got = {(r.key, r.uid): r.score for r in sessions.similar_traces(asked, turns, 3, 0.3).collect()}
    expected = {}
    for q, a in rows:
        if int(q) % 50 == 0:
            every = sorted((-round(len(a & b) / (len(a) * len(b)) ** 0.5, 6), u) for u, b in rows if a and b)
            expected |= {(q, u): -s for s, u in every[:3] if -s >= 0.3}
    assert got == expected


def test_reports(spark):
    req = spark.createDataFrame([("k", "add teams")], "key string, request string")
    items = spark.createDataFrame([("k", "patterns", 1, "one"), ("k", "patterns", 2, "two"), ("k", "tests", 1, "t.ts")], "key string, section string, pos int, text string")
    md = render.context_pack(req, items).first().markdown
    assert md == "# Context for: add teams\n\n## Reusable implementations\n_Nothing similar found; a new abstraction may be justified._\n\n## Patterns to follow\n- one\n- two\n\n## Constraints (must not be violated)\n_No validated constraints in scope._\n\n## Relevant tests\n- t.ts\n"
    checks = spark.createDataFrame([("k", 1, "scope", "pass", "fine"), ("k", 2, "duplication", "fail", "bad | worse")], "key string, pos int, check string, status string, summary string")
    found = spark.createDataFrame([("k", "duplication", "fail", "X duplicates Y", "x.ts", False), ("k", "duplication", "warn", "w", None, True)], "key string, check string, severity string, message string, path string, waived boolean")
    md = render.guardrail_report(checks, found).first().markdown
    assert md == "# Guardrail Report: FAIL ✗\n\n**Findings:** 2 total (1 waived)\n\n| Check | Status | Summary | Findings |\n|---|---|---|---|\n| scope | ✓ pass | fine | 0 |\n| duplication | ✗ fail | bad \\| worse | 2 (1 waived) |\n\n## Actionable Findings\n\n- **[fail]** X duplicates Y (`x.ts`)"
    assert render.sections(req, F.col("request"), items, ("tests", "patterns")).first().markdown == "# add teams\n\n## tests\n- t.ts\n\n## patterns\n- one\n- two"
    assert render.schema_document({"a": req}).startswith("# Schema\n\n## a\n\n| Column | Type |\n|---|---|\n| key | string |")
    small = {"summary": "s", "data": {"a": [1]}}
    assert render.fit(small) == small
    big = render.fit({"summary": "s", "data": {"a": list(range(9000)), "b": [1, 2]}}, 2000)
    assert len(json.dumps(big)) < 2200 and big["data"]["b"] == [1, 2] and big["truncated"] and "(a)" in big["next"]
    assert render.fit({"summary": "x" * 5000, "data": {}}, 1000)["data"] == {"truncated": True}


def test_queries_in_blocks(spark, monkeypatch):
    q, rows = spark.range(7).toDF("q"), spark.range(11).toDF("uid")
    small = {tuple(r) for r in retrieval.against(q, rows).select("q", "uid").collect()}
    monkeypatch.setattr(retrieval, "SENT_QUERIES", 2)
    assert {tuple(r) for r in retrieval.against(q, rows).select("q", "uid").collect()} == small and len(small) == 77


APP = {
    "src/services/token.service.ts": "import { db } from '../db';\nimport { tokens as table } from '../db/schema';\n/* class Nope {} */\n@Injectable()\nexport class TokenService extends Base implements Issuer {\n  private readonly clock = new Clock();\n  constructor(private readonly repo: TokenRepository, n: number) {}\n  async create(kind: Kind): Promise<string> {\n    const x = new Mail(\"new Fake()\");\n    await this.repo.save(kind);\n    return helper(`t ${kind}`);\n  }\n  private check() { return db.insert(table); }\n}\nexport function helper(a: string) { return a; }\n",
    "src/index.ts": "export * from './services/token.service';\nexport { a as b } from './x';\nimport def, { type T } from 'zod';\nimport * as path from 'node:path';\nexport const schema = z.object({ a: z.string() });\nexport const tokens = pgTable('tokens', {});\nconst svc = new TokenService();\nexport const run = async (req: Request) => { svc.create('x'); };\nrouter.post('/tokens', validate(schema), (req, res) => controller.create(req, res));\ninterface Issuer { create(): void }\n",
    "empty.ts": None,
    "odd.ts": "}}} class { ( ' unclosed",
}


def test_typescript_facts(spark):
    facts = typescript_modules.parse(spark.createDataFrame(list(APP.items()), "path string, text string")).collect()
    symbols = {r.qualname: r for r in facts if r.fact == "symbol" and r.path in APP and r.path != "odd.ts"}
    assert {q: r.kind for q, r in symbols.items()} == {"TokenService": "class", "TokenService.create": "method", "TokenService.check": "method", "helper": "function", "schema": "const", "tokens": "const", "svc": "const", "run": "function", "route:POST /tokens": "route", "Issuer": "interface"}
    c = symbols["TokenService"]
    assert (c.decorators, c.extends, c.methods, c.exported, c.line_start) == (["Injectable"], ["Base"], ["create"], True, 5)
    assert symbols["tokens"].table == "tokens" and symbols["schema"].validator == "zod" and symbols["svc"].target == "TokenService" and not symbols["svc"].exported
    assert (symbols["route:POST /tokens"].http_method, symbols["route:POST /tokens"].target) == ("POST", "controller.create")
    seen = {(r.fact, r.qualname, r.receiver, r.name, r.target, r.via, r.op) for r in facts}
    for x in [("field", "TokenService", None, "repo", "TokenRepository", "constructor", None), ("field", "TokenService", None, "clock", "Clock", "new", None), ("call", "TokenService.create", "self.repo", "save", None, None, None), ("call", "TokenService.create", None, "helper", None, None, None), ("ref", "TokenService.create", None, None, "Mail", "new", None), ("ref", "TokenService", None, None, "Issuer", "implements", None), ("table", "TokenService.check", None, None, "table", None, "write"), ("call", "run", "svc", "create", None, None, None)]:
        assert x in seen, x
    assert not any(r.target == "Fake" or r.name == "Nope" for r in facts)
    imports = {(r.module, r.imported, r.local) for r in facts if r.fact == "import"}
    assert imports == {("../db", "db", "db"), ("../db/schema", "tokens", "table"), ("./services/token.service", "*", "*"), ("./x", "a", "b"), ("zod", "default", "def"), ("zod", "T", "T"), ("node:path", "*module", "path")}
    assert resolution.VIA["constructor"] == 0


def test_typescript_edges(spark):
    app = {
        "src/repo.ts": "export class TokenRepository { save(x) { return x; } }\n",
        "src/lib/index.ts": "export { TokenRepository as Repo } from '../repo';\n",
        "src/service.ts": "import { Repo } from './lib';\nexport class TokenService { constructor(private repo: Repo) {} create() { return this.repo.save(1); } }\n",
        "src/routes.ts": "import { TokenService } from './service.js';\nconst svc = new TokenService();\nexport function handle(req, res) { svc.create(); }\nrouter.post('/t', handle);\n",
        "tests/a.test.ts": "import { TokenService } from '../src/service';\n",
    }
    files = spark.createDataFrame(list(app.items()), "path string, text string")
    facts = typescript_modules.parse(files)
    symbols = facts.where("fact = 'symbol'").withColumn("uid", F.concat_ws("#", "path", "qualname"))
    table = files.select("path", F.col("path").alias("uid"), F.col("path").startswith("tests/").alias("is_test"))
    edges = {(r.src, r.rel, r.dst) for r in resolution.edges_of(facts, symbols, table).collect()}
    s, r = "src/service.ts#TokenService", "src/repo.ts#TokenRepository"
    assert {(s, "USES", r), (f"{s}.create", "CALLS", f"{r}.save"), ("src/routes.ts#handle", "CALLS", f"{s}.create"), ("src/routes.ts#route:POST /t", "HANDLES", "src/routes.ts#handle"), ("tests/a.test.ts", "COVERS", s), ("src/service.ts", "IMPORTS", "src/repo.ts")} <= edges
