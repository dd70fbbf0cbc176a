"""Context operators on a small graph with literal results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import context as cx


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("svc", "TokenService", "class", "s.ts", None, ["Service"], "TokenService"), ("svc.create", "create", "method", "s.ts", "svc", None, "TokenService.create"), ("ctl", "TokenController", "class", "c.ts", None, ["Controller"], "TokenController"), ("repo", "TokenRepo", "class", "r.ts", None, ["Repository"], "TokenRepo"), ("c#route:POST /t", "POST /t", "route", "c.ts", None, ["Route"], None), ("cfg", "config", "const", "k.ts", None, None, "config"), ("fn", "create", "function", "f.ts", None, None, "create"), ("t1", "t1", "file", "t.test.ts", None, None, None), ("f1", "f1", "file", "s.ts", None, None, None), ("f2", "f2", "file", "f.ts", None, None, None)]
    nodes = spark.createDataFrame(rows, "uid string, name string, kind string, path string, parent string, roles array<string>, qualname string")
    edges = [("svc", "HAS_MEMBER", "svc.create"), ("ctl", "CALLS", "svc.create"), ("svc.create", "USES", "repo"), ("svc", "USES", "cfg"), ("c#route:POST /t", "HANDLES", "ctl"), ("t1", "COVERS", "svc"), ("f1", "DEFINES", "svc"), ("f2", "DEFINES", "fn"), ("f1", "CO_CHANGES", "f2"), ("svc", "FOLLOWS", "k1"), ("d1", "ESTABLISHES", "k1"), ("k1", "SUPPORTED_BY", "e1"), ("k1", "SUPPORTED_BY", "e2"), ("feat1", "MODIFIES", "svc"), ("feat2", "REUSES", "svc"), ("cfg", "USES", "svc")]
    return nodes, spark.createDataFrame(edges, "src string, rel string, dst string")


def uids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "uid string")


def test_understanding(spark):
    r = spark.range(1).select(cx.understand(F.lit("Please add the invitations for TokenService with 2 emails")).alias("q")).first().q
    assert r.terms == ["invitation", "token", "service", "email"] and r.identifiers == ["TokenService"]
    assert r.expanded == ["invite", "code", "nonce", "otp", "mail", "notification", "smtp", "template"]
    assert spark.range(1).select(cx.understand(F.lit("")).alias("q")).first().q.terms == []
    assert cx.synonym_groups(spark, (("x", "y"),)).count() == 17


def test_neighbours_and_users(spark, graph):
    nodes, edges = graph
    got = {(r.src, r.rel, r.dst) for r in cx.neighbours(uids(spark, "svc", "svc"), nodes, edges).collect()}
    assert got == {("svc", "CALLS", "ctl"), ("svc", "USES", "repo"), ("svc", "CO_CHANGES", "fn")}
    assert {r.uid: r.users for r in cx.fan_in(nodes, edges).collect()} == {"svc": ["TokenController"], "repo": ["TokenService"], "cfg": ["TokenService"]}
    assert {(r.uid, r.part) for r in cx.parts(uids(spark, "svc", "repo"), edges).collect()} == {("svc", "svc"), ("svc", "svc.create"), ("repo", "repo")}
    assert cx.neighbours(uids(spark, "svc"), nodes, edges.where("false")).count() == 0


def test_resolution(spark, graph):
    nodes, _ = graph
    got = cx.resolve(spark.createDataFrame([("create",), ("TokenService.create",), ("s.ts",), ("nope",)], "ref string"), nodes).collect()
    assert {(r.ref, r.rank, r.uid) for r in got} == {("create", 1, "fn"), ("create", 2, "svc.create"), ("TokenService.create", 1, "svc.create"), ("s.ts", 1, "svc"), ("s.ts", 2, "f1"), ("s.ts", 3, "svc.create")}
    items = spark.createDataFrame([("p:pattern:auditor:naming", "Naming of services"), ("p:pattern:auditor:layers", "Layers"), ("p:decision:adr:1", "Use layers")], "uid string, title string")
    refs = spark.createDataFrame([("naming",), ("layer",), ("use",), ("pattern",), ("zz",)], "ref string")
    assert {r.ref: (r.uid, r.matches) for r in cx.resolve_fragment(refs, items).collect()} == {"naming": ("p:pattern:auditor:naming", 1), "layer": ("p:pattern:auditor:layers", 1), "use": ("p:decision:adr:1", 1), "pattern": (None, 2), "zz": (None, 0)}


def test_selections(spark, graph):
    nodes, edges = graph
    assert {r.uid for r in cx.without_routes(nodes).collect()} == {r.uid for r in nodes.collect()} - {"c#route:POST /t"}
    hits = spark.createDataFrame([("d1", 1, 0.9, ["svc", "repo"]), ("d2", 2, 0.8, ["svc", "ctl"]), ("d3", 3, 0.7, None)], "doc string, rank int, score double, describes array<string>")
    assert {(r.uid, r.doc, r.score) for r in cx.document_votes(hits).collect()} == {("svc", "d1", 0.9), ("repo", "d1", 0.9), ("ctl", "d2", 0.8)}
    ranked = spark.createDataFrame([("ctl", 1), ("repo", 2), ("svc", 3), ("svc.create", 4)], "uid string, rank int")
    assert [r.uid for r in cx.reusable(ranked, nodes).collect()] == ["repo", "svc"] and cx.reusable(ranked, nodes, 1).count() == 1
    assert [(r.path, r.covers) for r in cx.covering_tests(uids(spark, "svc"), nodes, edges).collect()] == [("t.test.ts", ["TokenService"])]
    features = spark.createDataFrame([("feat1", "A", "2024"), ("feat2", "B", "2025"), ("feat3", "C", "2026")], "uid string, name string, created_at string")
    assert [(r.name, r.touched) for r in cx.related_features(uids(spark, "svc"), features, nodes, edges).collect()] == [("B", ["TokenService"]), ("A", ["TokenService"])]


def test_attached_knowledge(spark, graph):
    _, edges = graph
    known = spark.createDataFrame([("k1", "pattern", "T", "validated", 0.9, None), ("d1", "decision", "D", "validated", 0.95, None), ("c1", "constraint", "no axios", "validated", 0.5, "forbid_external_dep"), ("c2", "constraint", "x", "candidate", None, "forbid_external_dep"), ("d2", "decision", "E", "candidate", 0.2, None), ("d3", "decision", "Old", "deprecated", 0.99, None)], "uid string, kind string, title string, status string, confidence double, rule_type string")
    found = uids(spark, "d2", "d3")
    got = {(r.uid, r.section, r.pos) for r in cx.attached_knowledge(uids(spark, "svc"), known, edges, found).collect()}
    assert got == {("k1", "patterns", 1), ("d1", "decisions", 1), ("c1", "constraints", 1), ("d2", "unverified", 1)}
    assert ("d3", "decisions", 1) in {(r.uid, r.section, r.pos) for r in cx.attached_knowledge(uids(spark, "svc"), known, edges, found, True).collect()}
    listed = cx.knowledge_list(known, edges).collect()
    assert [r.uid for r in listed] == ["c2", "c1", "d2", "d3", "d1", "k1"] and listed[-1].evidence_count == 2
    assert [r.uid for r in cx.knowledge_list(known, edges, "decision", "validated").collect()] == ["d1"]


def test_impact(spark, graph):
    nodes, edges = graph
    got = {(r.section, r.uid, r.depth) for r in cx.impact(uids(spark, "svc"), nodes, edges).collect()}
    assert got == {("upstream", "ctl", 1), ("upstream", "cfg", 1), ("upstream", "c#route:POST /t", 2), ("downstream", "repo", 1), ("downstream", "cfg", 1), ("route", "c#route:POST /t", 1), ("test", "t1", 1), ("co_change", "f2", 1)}


def test_guarded_queries(spark):
    spark.range(300).createOrReplaceTempView("ctx_numbers")
    assert cx.read_only(spark, "SELECT id FROM ctx_numbers -- drop table x").count() == 100
    assert cx.read_only(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a WHERE x IN (SELECT id FROM ctx_numbers)", 5).count() == 1
    for bad in ("DROP TABLE ctx_numbers", "INSERT INTO ctx_numbers SELECT 1", "CREATE TABLE zz AS SELECT 1 AS x", "SET spark.x = 1", "SELECT 1; DROP VIEW ctx_numbers", "CACHE TABLE ctx_numbers", "EXPLAIN SELECT 1"):
        with pytest.raises(Exception):
            cx.read_only(spark, bad)
    assert spark.catalog.tableExists("ctx_numbers")
    assert cx.ask(spark, "how many?", lambda prompt: "SELECT count(*) AS n FROM ctx_numbers" if "how many?" in prompt else "", "ctx_numbers(id)").first().n == 300
