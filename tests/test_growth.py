"""What joins make of many rows that agree: pairs of what differs, not of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import docs, graph, knowledge, mining, reuse
from lodegraph.plans import catalog


def nodes(plan):
    name = plan.nodeName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in name else None
    below = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *[x for p in below for x in nodes(p)]]


def joined(df, column=""):
    """The rows, and the most that a join made, of joins that hold the column."""
    rows = df.collect()
    joins = [p for p in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName() and column in p.output().mkString(",")]
    return rows, max((p.metrics().apply("numOutputRows").value() for p in joins), default=0)


def test_verb_sharers(spark):
    s = spark.range(600).select(F.col("id").alias("uid"), F.when(F.col("id") % 2 == 0, F.array(F.lit("create"), F.lit("burn"))).otherwise(F.array(F.lit("issueToken"))).alias("methods"))
    rows, most = joined(reuse.verb_sharers(s.where("uid < 100"), s))
    assert len({(r.proposal, r.uid) for r in rows}) == len(rows) == 100 * 599 and most <= 600
    assert {r.overlap for r in rows if r.proposal == 1} == {1.0} and {r.overlap for r in rows if r.proposal == 0} == {1.0, 0.5}


def test_equal_titles(spark, monkeypatch):
    monkeypatch.setattr(graph, "LISTED", 50)
    titles = spark.range(400).select(F.col("id").alias("uid"), F.when(F.col("id") < 300, "one two three four five").when(F.col("id") < 390, "one two three four five six").otherwise("seven eight").alias("title"))
    rows, most = joined(docs.similar_titles(titles, "uid", "title"))
    assert len({(r.a, r.b) for r in rows}) == len(rows) == 390 * 389 // 2 + 45 and all(r.a < r.b for r in rows) and most < 1000


def test_rivals(spark):
    methods = F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, ("create", "verify", "burn")))).otherwise(F.array(*map(F.lit, ("create", "verify"))))
    classes = spark.range(400).select(F.col("id").alias("uid"), F.lit("Token").alias("name"), methods.alias("methods"))
    used = spark.createDataFrame([(1, 0), (2, 0)], "src long, dst long")
    rows, most = joined(mining.lifecycle_roles(classes, used, "token"))
    assert len(rows) == 200 + 2 + 200 * 399 - 2 and most < 1000


def test_equal_knowledge(spark):
    d = spark.createDataFrame([("d1", "keep the token service"), ("d2", "keep nothing")], "uid string, text string")
    k = spark.range(3000).select(F.col("id").alias("uid"), F.lit("the token store").alias("text"))
    rows, most = joined(docs.established(d, k))
    assert len(rows) == 3000 and {(r.a, round(r.score, 6)) for r in rows} == {("d1", 0.666667)} and most <= 3000


def test_no_rank_over_all_orders(spark, sf):
    plan = catalog.queries()["document_vote"](spark, sf)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_texts_meet_ranges(spark):
    files = spark.createDataFrame([("p", "a\nb\nc")], "path string, text string")
    refs = spark.range(500).select(F.col("id").alias("ref"), F.col("id").alias("knowledge_uid"), F.lit(1).alias("pos"), F.lit("p").alias("path"), F.when(F.col("id") % 2 == 0, 2).alias("line_start"), F.lit(None).cast("int").alias("line_end"))
    for column in ("text", "_lines"):
        rows, most = joined(knowledge.check_evidence(refs, files), column)
        assert len({(r.line_start, r.line_end, r.content_hash) for r in rows if r.dropped is None and r.line_start == 2}) == 1 and len(rows) == 500 and most < 10


def test_places_meet_ranges(spark):
    points = spark.range(300).select(F.col("id").alias("pid"), F.lit("f").alias("k"), F.lit(5).alias("at"))
    spans = spark.range(300).select(F.lit("f").alias("k"), F.col("id").alias("uid"), F.lit(1).alias("low"), (F.col("id") % 3 + 5).cast("int").alias("high"))
    rows, most = joined(graph.enclosing(points, spans, ["k"]))
    assert {r.uid for r in rows} == {0} and len(rows) == 300 and most <= 300
