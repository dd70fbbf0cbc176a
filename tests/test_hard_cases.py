"""Nulls, empty tables, ties, repeated rows and clashing columns in the graph, store, document and retrieval operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import docs, graph, mining, packing, retrieval, store


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b", "USES", 1.0), ("a", "b", "USES", 1.0), ("b", "c", "CALLS", 0.8), ("c", "a", "USES", 1.0), (None, "a", "USES", 1.0), ("d", None, None, None)], "src string, dst string, rel string, weight double").withColumns({"uid": F.lit("clash"), "depth": F.lit(9), "_member": F.lit("clash")})


def ids(df, column="uid"):
    return {r[column] for r in df.collect()}


def test_graph(spark, edges):
    none = edges.where("false")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "uid string")
    assert {(r.uid, r.depth) for r in graph.reach(edges, seeds, 5).where("uid is not null").collect()} == {("b", 1), ("c", 2)}
    assert ids(graph.dependents(edges.select("src", "dst"), seeds, 1).where("uid is not null")) == {"c"}
    assert graph.reach(none, seeds, 3).count() == 0 and graph.reach(edges, seeds.where("false"), 3).count() == 0
    assert graph.undirected(edges.where("src = 'a'"), "rel").count() == 2
    pairs = spark.createDataFrame([("g1", "x"), ("g1", "y"), ("g1", "y"), ("g2", "x"), ("g2", "y"), (None, "x"), ("g3", None)], "g string, i string")
    assert [tuple(r) for r in graph.co_occurring(pairs, "g", "i", 2, 50).collect()] == [("x", "y", 2)]
    assert graph.co_occurring(pairs, "g", "i", 1, 1).count() == 0 and graph.co_occurring(pairs.where("false"), "g", "i", 1, 5).count() == 0
    scores = {r.uid: round(r.score, 6) for r in graph.spread(spark.createDataFrame([("a", 1.0)], "uid string, score double"), edges.select("src", "dst", "weight").distinct()).collect()}
    assert scores["a"] == 1.0 and scores["b"] == 0.125
    assert graph.spread(spark.createDataFrame([], "uid string, score double"), edges.select("src", "dst", "weight")).count() == 0
    top = graph.top_per(spark.createDataFrame([("q", 1.0, "b"), ("q", 1.0, "a"), ("q", None, "c"), (None, 1.0, "d")], "q string, s double, uid string"), ["q"], [F.col("s").desc(), F.col("uid")], 2)
    assert {(r.q, r.uid, r["rank"]) for r in top.collect()} == {("q", "a", 1), ("q", "b", 2), (None, "d", 1)}


def test_enclosing_spans(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 50), (3, None, 5), (4, "f", None)], "pid int, path string, at int")
    spans = spark.createDataFrame([("f", "big", 1, 9), ("f", "s2", 4, 6), ("f", "s1", 4, 6), (None, "n", 1, 9), ("f", "x", None, 9)], "path string, uid string, low int, high int")
    assert {r.pid: r.uid for r in graph.enclosing(points, spans, ["path"]).collect()} == {1: "s1", 2: None, 3: None, 4: None}


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "uid string, n int, created string")
    new = spark.createDataFrame([("a", None, "z"), (None, 5, None), ("b", 7, "w")], "uid string, n int, created string")
    assert {tuple(r) for r in store.upsert(old, new, ["uid"], "created").collect()} == {("a", 1, "x"), (None, 5, "y"), ("b", 7, "w")}
    assert store.upsert(old.where("false"), new, ["uid"]).count() == 3 and store.upsert(old, new.where("false"), ["uid"]).count() == 2
    a = spark.createDataFrame([("p", "1"), ("q", None), ("r", "1")], "path string, sha string")
    b = spark.createDataFrame([("p", "2"), ("q", None), ("s", "1")], "path string, sha string")
    assert {tuple(r) for r in store.change_set(a, b, "path", "sha").collect()} == {("p", "M"), ("r", "D"), ("s", "A")}
    with pytest.raises(ValueError):
        store.assert_unique(a.union(a), "path")
    assert store.orphans(a.select(F.col("path").alias("uid")), b.select(F.lit("x").alias("src"), F.col("path").alias("dst"))).count() == 1


def test_documents(spark):
    table = spark.createDataFrame([(1, None), (2, ""), (3, "# A\n\n# A\ntext\n"), (3, "# B"), (4, "```\n# code\nnever do this at all\n```\n- You must always do this\n> must not quote this\n")], "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("line", F.lit("clash"))
    assert {(r.doc_id, r.heading) for r in docs.sections(table.where("doc_id <> 3"), "doc_id").collect()} == {(4, None)}
    assert {(r.heading, r.start) for r in docs.sections(table.where("text like '# A%'"), "doc_id").collect()} == {("A", 1), ("A", 3)}
    assert [(r.doc_id, r.rule) for r in docs.rules(table, "doc_id").collect()] == [(4, "You must always do this")]
    assert docs.chunks(table.where("false"), "doc_id").count() == 0 and docs.sections(table.where("false"), "doc_id").count() == 0
    titles = spark.createDataFrame([("a", "use the postgres database"), ("b", "Use THE postgres database!"), ("c", None), ("d", ""), ("e", "x y z")], "uid string, title string")
    assert {(r.a, r.b, r.similarity) for r in docs.similar_titles(titles, "uid", "title").collect()} == {("a", "b", 1.0)}


def test_retrieval(spark):
    table = spark.createDataFrame([("a", "token token service"), ("b", "tokens"), ("c", None), ("d", ""), ("e", "token token service")], "uid string, text string")
    got = {r.uid: r.score for r in retrieval.text_hits(table, "uid", "text", ["token"]).collect()}
    assert set(got) == {"a", "b", "e"} and got["a"] == got["e"] > got["b"] == 1.0
    assert [r.uid for r in retrieval.ranked(retrieval.text_hits(table, "uid", "text", ["token"]), 2).orderBy("rank").collect()] == ["a", "e"]
    assert retrieval.text_hits(table.where("false"), "uid", "text", ["token"]).count() == 0 and retrieval.text_hits(table, "uid", "text", ["zzz"]).count() == 0
    lists = {"vector": (spark.createDataFrame([("a", 1), ("b", 2)], "uid string, rank int"), 1.0), "fulltext": (spark.createDataFrame([("b", 1), ("c", 2)], "uid string, rank int"), 1.0)}
    assert [r.uid for r in retrieval.ranked(retrieval.fuse(lists), 3).orderBy("rank").collect()] == ["b", "a", "c"]
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 0.0]), ("z", None)], "uid string, v array<double>")
    near = {r.uid: r.score for r in retrieval.vector_hits(vectors.withColumnRenamed("v", "e"), spark.createDataFrame([([1.0, 0.0],)], "v array<double>"), "uid", "e").collect()}
    assert near == {"x": 1.0, "y": 0.5}


def test_packing_and_rules(spark):
    items = spark.createDataFrame([("p", "tests", 1, 5), ("p", "nowhere", 1, 5)], "k string, section string, pos int, cost int")
    assert {r.section: r.used for r in packing.pack(items, "k", 100).collect()}["tests"] == 5 and packing.pack(items.where("false"), "k", 100).count() == 0
    files = spark.createDataFrame([("src/a.ts", 10), ("docs/b.md", 5), (None, 3)], "path string, lines int")
    assert packing.fit_response(files.withColumn("k", F.lit(1)), "k", "path", 10).count() == 0
    row = mining.out_of_scope(files.where("path is not null"), ["src/**"]).first()
    assert row.outside == 5 and row.fails and not mining.out_of_scope(files.where("false"), ["src/**"]).first().fails
    tied = spark.createDataFrame([("g", "x", 2), ("g", "y", 1), ("g", None, 0)], "g string, v string, pos int")
    assert mining.mode_by(tied.where("v is not null"), "g", "v", "pos").first().v == "y"
