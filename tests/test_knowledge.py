"""Knowledge lifecycle and mutations on small tables with literal results."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import knowledge as kn
from lodegraph.operators import store

KNOWN = "uid string, kind string, title string, claim string, source string, status string, confidence double, support_count int, violation_count int, validated_by string, rule_type string, rule string, detector string"
PROPOSAL = "uid string, kind string, title string, claim string, rationale string, source string, actor string, adr_status string, rule_type string, rule string, support_count int, violation_count int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_evidence_checks(spark):
    files = spark.createDataFrame([("a.ts", "one\ntwo\r\nthree\n"), ("e.ts", "")], "path string, text string")
    refs = spark.createDataFrame([("r1", "k", 1, "a.ts", 2, 3), ("r2", "k", 2, "a.ts", 2, None), ("r3", "k", 3, "a.ts", None, None), ("r4", "k", 4, "a.ts", 3, 9), ("r5", "k", 5, "gone.ts", 1, 1), ("r6", "k", 6, "e.ts", None, None), ("r7", "k", 7, None, None, None)] + [(f"s{i}", "m", i, "a.ts", 1, 1) for i in range(22)], "ref string, knowledge_uid string, pos int, path string, line_start int, line_end int")
    got = {r.ref: r for r in kn.check_evidence(refs, files).collect()}
    assert got["r1"].content_hash == sha("two\nthree")[:16] and got["r2"].content_hash == sha("two")[:16] and got["r3"].content_hash == sha("one\ntwo\nthree")[:16]
    assert {k: got[k].dropped for k in ("r4", "r5", "r6", "r7")} == {"r4": "outside the file", "r5": "file not found", "r6": "outside the file", "r7": "file not found"}
    assert sum(r.dropped is None for k, r in got.items() if k[0] == "s") == 20
    assert kn.check_evidence(refs.where("false"), files).count() == 0


def test_attached_evidence(spark):
    e = spark.createDataFrame([("k1", "a.ts", 1, 2, "s1"), ("k1", "a.ts", 1, 2, "s1"), ("k1", None, None, None, None)], "knowledge_uid string, path string, line_start int, line_end int, symbol_uid string")
    targets = spark.createDataFrame([("f1", "a.ts", None), ("s1", None, "s1"), ("d1", "a.ts", None)], "uid string, path string, symbol_uid string")
    rows, edges = kn.attach_evidence(e, "p", "SUPPORTED_BY", targets)
    uid = "p:ev:" + sha("\x1f".join(["p", "k1", "SUPPORTED_BY", "a.ts", "1", "2", "s1"]))[:16]
    assert {r.uid for r in rows.collect()} == {uid, "p:ev:" + sha("\x1f".join(["p", "k1", "SUPPORTED_BY"] + ["None"] * 4))[:16]}
    assert {(r.src, r.rel, r.dst) for r in edges.collect() if r.rel == "REFERENCES"} == {(uid, "REFERENCES", x) for x in ("f1", "d1", "s1")}


def test_submission(spark):
    known = spark.createDataFrame(
        [
            ("k1", "pattern", "Services live in the services folder", "c", "auditor", "candidate", 0.5, 2, 0, None, None, None, "naming"),
            ("k2", "pattern", "Repositories wrap tables", "c", "auditor", "rejected", 0.5, 3, 0, None, None, None, None),
            ("k3", "constraint", "No axios", "c", "auditor", "validated", 0.9, 5, 0, "auditor", "forbid_external_dep", '{"p":1}', None),
        ],
        KNOWN,
    )
    p = lambda uid, title, source, kind="pattern", **kw: (uid, kind, title, "claim", None, source, kw.get("actor", source), kw.get("adr"), kw.get("rule_type"), kw.get("rule"), kw.get("s"), kw.get("v"))
    proposals = spark.createDataFrame(
        [
            p("n1", "password=hunter2hunter2 PASSWORD=abcdefgh1", "agent"),
            p("n2", "a fresh idea", "agent"),
            p("n3", "a well supported idea", "auditor", s=6, v=0),
            p("n4", "services live in the SERVICES folder!", "agent"),
            p("n5", "repositories wrap tables", "agent"),
            p("n6", "another rule", "agent", kind="constraint", rule_type="placement", rule='{"r":1}'),
            p("k3", "No axios", "auditor", kind="constraint", actor="revalidation", rule_type="forbid_external_dep", rule='{"p":1}'),
            p("n7", "decided so", "adr", adr="validated"),
            p("n8", "no evidence at all", "human"),
            p("n3", "z repeated", "auditor", s=0, v=9),
        ],
        PROPOSAL,
    )
    kept = spark.createDataFrame([(u, 2, 0) for u in ("n1", "n2", "n3", "n4", "n5", "n7")], "knowledge_uid string, kept int, against int")
    again = spark.createDataFrame([("n6", 4, 0), ("k3", 0, 3)], "uid string, support int, violations int")
    got = {r.uid: r for r in kn.submit(proposals, known, kept, again).collect()}
    assert {u: (r.outcome, r.target, r.status) for u, r in got.items()} == {
        "n1": ("rejected", "n1", None),
        "n2": ("created", "n2", "candidate"),
        "n3": ("created", "n3", "validated"),
        "n4": ("merged", "k1", "candidate"),
        "n5": ("rejected", "k2", None),
        "n6": ("created", "n6", "candidate"),
        "k3": ("updated", "k3", "deprecated"),
        "n7": ("created", "n7", "validated"),
        "n8": ("rejected", "n8", None),
    }
    assert got["n4"].support == 4 and got["n3"].confidence == 0.77 and got["n7"].confidence == 0.95 and got["n8"].reason == "no valid evidence" and got["n1"].reason == "contains a secret"
    assert kn.submit(proposals.where("false"), known, kept).count() == 0 and kn.submit(proposals, known.where("false"), kept).count() == 9


def test_decisions(spark):
    known = spark.createDataFrame([(u, "pattern", u, "c", "agent", s, 0.5, 1, 0, None, None, None, None) for u, s in (("a", "candidate"), ("b", "validated"), ("c", "validated"), ("d", "rejected"), ("e", "candidate"))], KNOWN)
    orders = spark.createDataFrame([("a", "validated", "human:kim", None, None), ("b", "deprecated", "human", "old", None), ("c", "superseded", "human", None, "b"), ("d", "validated", "human", "x", None), ("e", "rejected", "human", " ", None), ("zz", "rejected", "human", "x", None)], "uid string, to_status string, actor string, reason string, superseded_by string")
    out, events = kn.decide(known, orders)
    assert {r.uid: (r.status, r.superseded_by, r.validated_by) for r in out.collect()} == {"a": ("validated", None, "human:kim"), "b": ("deprecated", None, None), "c": ("superseded", "b", None), "d": ("rejected", None, None), "e": ("candidate", None, None)}
    assert {r.uid: r.action for r in events.collect()} == {"a": "status_change", "b": "status_change", "c": "status_change", "d": "refused", "e": "refused", "zz": "refused"}


def test_revalidation(spark):
    rows = [("a", "auditor", "validated", "placement", "{}", None), ("b", "auditor", "validated", None, None, "naming"), ("c", "agent", "validated", None, None, None), ("d", "agent", "validated", None, None, None), ("e", "agent", "rejected", None, None, None), ("f", "agent", "validated", None, None, None)]
    known = spark.createDataFrame([(u, "pattern", u, "c", src, s, 0.5, 1, 0, None, rt, r, d) for u, src, s, rt, r, d in rows], KNOWN)
    e = spark.createDataFrame([("e1", "c", "h1"), ("e2", "c", "h2"), ("e3", "d", "h3"), ("e4", "d", "h4"), ("e5", "d", None)], "uid string, knowledge_uid string, content_hash string")
    now = spark.createDataFrame([("e1", "x"), ("e3", "h3"), ("e4", None), ("e5", "y")], "ref string, content_hash string")
    marks = kn.stale_evidence(e, now)
    assert {r.uid: r.stale_reason for r in marks.collect()} == {"e1": "changed", "e2": "missing", "e3": None, "e4": "missing", "e5": None}
    stale = marks.groupBy("knowledge_uid").agg(F.count("*").alias("refs"), F.count_if("stale").alias("stale"))
    got = {r.uid: (r.way, r.status) for r in kn.revalidation(known, known.where("uid = 'f'"), stale).collect()}
    assert got == {"a": ("rule", "validated"), "b": ("lost", "validated"), "c": ("evidence", "deprecated"), "d": ("evidence", "validated")}


def test_proposals_and_links(spark):
    seen = spark.createDataFrame([("p1", f"s{i:02d}", f"f{i:02d}.ts", 1, "support") for i in range(25)] + [("p1", "v", "v.ts", 2, "violation")], "key string, uid string, path string, line int, verdict string")
    p = kn.proposals_of(seen, spark.createDataFrame([("p1", "T", "C"), ("p2", "T", "C")], "key string, title string, claim string")).collect()
    assert len(p) == 1 and (p[0].support_count, p[0].violation_count, len(p[0].evidence), p[0].contradictions) == (25, 1, 20, ["v.ts:2"])
    links = kn.ingest_links(seen.limit(1).union(seen.where("uid = 'v'")), spark.createDataFrame([("c1", "s1")], "constraint string, uid string"), spark.createDataFrame([("ADR-002", ["ADR-001"])], "adr_id string, supersedes array<string>"), spark.createDataFrame([("d", "k")], "a string, b string"))
    assert {(r.src, r.rel, r.dst) for r in links.collect()} == {("s00", "FOLLOWS", "p1"), ("s1", "CONSTRAINED_BY", "c1"), ("ADR-002", "SUPERSEDES", "ADR-001"), ("d", "ESTABLISHES", "k")}


def test_mutations(spark, tmp_path):
    nodes = spark.createDataFrame([("s1", "f1", "r2", "candidate", False), ("s2", "f1", "r1", "validated", None), ("s3", "f2", None, "validated", True)], "uid string, file_uid string, last_audit_run string, status string, is_test boolean")
    edges = spark.createDataFrame([("s1", "USES", "s2"), ("s1", "USES", "s3"), ("e1", "REFERENCES", "s2"), ("e2", "REFERENCES", "s3"), ("k1", "SUPPORTED_BY", "e1"), ("k2", "SUPPORTED_BY", "e1"), ("k1", "SUPPORTED_BY", "e2")], "src string, rel string, dst string")
    evidence = spark.createDataFrame([("e1", False, None), ("e2", False, None), ("e3", None, None)], "uid string, stale boolean, stale_reason string")
    flags = store.set_flags(nodes, spark.createDataFrame([("s1", True), ("s3", None)], "uid string, is_test boolean"), "uid", "is_test")
    assert {r.uid: r.is_test for r in flags.collect()} == {"s1": True, "s2": None, "s3": None}
    n, e, v = store.delete_stale_nodes(nodes, edges, evidence, spark.createDataFrame([("f1",)], "file_uid string"), "r2")
    assert {r.uid for r in n.collect()} == {"s1", "s3"} and ("s1", "USES", "s2") not in {tuple(r) for r in e.collect()}
    assert {r.uid: r.stale_reason for r in v.collect()} == {"e1": "target_deleted", "e2": None, "e3": None}
    assert {r.uid for r in store.delete_stale_nodes(nodes, edges, evidence, None, "r2")[0].collect()} == {"s1"}
    files = spark.createDataFrame([("f1",), ("f2",)], "uid string")
    f, s, _, v = store.delete_files(files, nodes, edges, evidence, spark.createDataFrame([("f2",)], "uid string"))
    assert [r.uid for r in f.collect()] == ["f1"] and {r.uid for r in s.collect()} == {"s1", "s2"} and {r.uid for r in v.where("stale").collect()} == {"e2"}
    known = spark.createDataFrame([("k1",), ("k2",)], "uid string")
    k, v, e = store.delete_knowledge(known, evidence, edges, spark.createDataFrame([("k1",)], "uid string"))
    assert [r.uid for r in k.collect()] == ["k2"] and {r.uid for r in v.collect()} == {"e1", "e3"} and {(r.src, r.dst) for r in e.where("rel = 'SUPPORTED_BY'").collect()} == {("k2", "e1")}
    left, count = store.purge({"a": nodes.withColumn("project_id", F.when(F.col("uid") == "s1", "p"))}, "p")
    assert count == {"a": 1} and left["a"].count() == 2
    after, before = store.update_status(nodes, spark.createDataFrame([("s1", "rejected", "no")], "uid string, status string, reason string"))
    assert {r.uid: r.status for r in after.collect()}["s1"] == "rejected" and [tuple(r) for r in before.collect()] == [("s1", "candidate")]
    with pytest.raises(KeyError):
        store.update_status(nodes, spark.createDataFrame([("zz", "x", None)], "uid string, status string, reason string"))
    again = store.relink(edges, "USES", spark.createDataFrame([("k9", "s2"), (None, "s3")], "src string, dst string"))
    assert {(r.src, r.dst) for r in again.where("rel = 'USES'").collect()} == {("k9", "s2")} and again.count() == edges.count() - 1
    assert [r.body for r in store.normalised(nodes, edges).collect()] == [r.body for r in store.normalised(nodes.orderBy(F.desc("uid")).withColumn("created_at", F.rand()), edges.repartition(3)).collect()]
    store.record_events(evidence, str(tmp_path / "t"), str(tmp_path / "l"))
    store.record_events(evidence, str(tmp_path / "t"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.json(str(tmp_path / "l")).count() == 6
    hits, misses = store.cached(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", None)], "uid string, text string"), spark.createDataFrame([(sha("m\x1f3\x1fx"), [1.0])], "key string, vector array<double>"), "m", 3)
    assert [r.uid for r in hits.collect()] == ["a"] and sorted(r.text for r in misses.collect()) == ["", "y"]
    cards = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "uid string, card_hash string")
    assert {r.uid for r in store.to_embed(cards, spark.createDataFrame([("a", "h1", "m"), ("b", "h2", "old"), ("c", "hx", "m")], "uid string, card_hash string, embedding_model string"), "m").collect()} == {"b", "c"}


def test_artifacts_and_schema(spark):
    manifest = spark.createDataFrame([("a.txt", "test", "0", 1)], "path string, kind string, sha256 string, size long")
    new = spark.createDataFrame([("a.txt", "test", bytearray(b"PASSWORD=abcdefgh1")), ("b.bin", "screenshot", bytearray(b"\xff\xfe\x00"))], "path string, kind string, content binary")
    got = {r.path: r.sha256 for r in store.add_artifacts(manifest, new).collect()}
    assert got == {"a.txt": sha("PASSWORD=[REDACTED:env_assignment]"), "b.bin": hashlib.sha256(b"\xff\xfe\x00").hexdigest()}
    rows, edges = store.evidence_nodes(store.add_artifacts(manifest, new), "p", "p:feat:1")
    assert rows.count() == edges.count() == 2
    state = {r.kind: r.state for r in store.checklist(manifest.withColumn("pos", F.lit(1)), True).collect()}
    assert state == {"diff": "missing", "test": "verified", "guardrail": "missing", "screenshot": "missing", "recording": "missing"}
    assert store.migrate(1, {1: "a;", 2: "b {{dims}};\n c ;"}, 64) == [(2, "b 64"), (2, "c")]
    with pytest.raises(ValueError):
        store.migrate(0, {1: "a", 3: "b"}, 64)
    assert store.schema_report(rows, "uid string, size long, kind int") == ["missing size", "kind: string, not int"]
