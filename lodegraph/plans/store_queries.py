"""Upserts, deletes, exports and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import store
from lodegraph.plans.registry import Tables, query

_NEW = "n AS (SELECT c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1000000 ELSE 0 END AS uid, c_acctbal + 1 AS balance, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'seen' END AS note, '2025' AS created_at FROM customer WHERE c_custkey % 5 = 0)"


def _nodes(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("2024").alias("created_at"))


def _new(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.where("c_custkey % 5 = 0").select((k + F.when(k % 10 == 0, 1000000).otherwise(0)).alias("uid"), (F.col("c_acctbal") + 1).alias("balance"), F.when(k % 3 != 0, "seen").alias("note"), F.lit("2025").alias("created_at"))


@query(f"WITH {_NEW} SELECT coalesce(c.c_custkey, n.uid) AS uid, c.c_name AS name, round(coalesce(n.balance, c.c_acctbal), 6) AS balance, n.note, CASE WHEN c.c_custkey IS NOT NULL THEN '2024' ELSE n.created_at END AS created_at FROM customer c FULL JOIN n ON n.uid = c.c_custkey")
def upsert_snapshot(t: Tables) -> DataFrame:
    return store.upsert(_nodes(t), _new(t), ["uid"], "created_at").withColumn("balance", F.round("balance", 6))


@query(f"WITH {_NEW} SELECT uid, round(balance, 6) AS balance FROM n UNION ALL SELECT c_custkey, round(c_acctbal, 6) FROM customer WHERE c_custkey NOT IN (SELECT uid FROM n)")
def overlay_latest(t: Tables) -> DataFrame:
    return store.overlay(_nodes(t).select("uid", "balance"), _new(t).select("uid", "balance"), "uid").withColumn("balance", F.round("balance", 6))


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag AS rel, l_linestatus AS last_audit_run FROM lineitem WHERE NOT (l_linestatus <> 'O' AND l_returnflag IN ('A', 'R') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))")
def stale_edge_delete(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"), F.col("l_linestatus").alias("last_audit_run"))
    return store.delete_stale(edges, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("uid")), "O", ["A", "R"])


@query("SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def export_induced(t: Tables) -> DataFrame:
    edges = t.orders.select(F.col("o_orderkey").cast("string").alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    nodes = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("uid"), F.lit("Commit").alias("label"))
    nodes = nodes.union(t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("File")))
    kept = store.induced(nodes, edges, ["Commit", "File"])[1]
    return kept.select(F.col("src").cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst")).distinct()


@query("SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_orderkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def detach_deleted(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return store.detach(edges, t.part.where("p_size > 40").select(F.col("p_partkey").alias("uid")))


@query("SELECT c_custkey AS uid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_nodes(t: Tables) -> DataFrame:
    return store.orphans(t.customer.select(F.col("c_custkey").alias("uid")), t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")))


@query("""SELECT p_partkey AS uid FROM part WHERE p_size < 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09""")
def intersect_except(t: Tables) -> DataFrame:
    parts = lambda cond: t.lineitem.where(cond).select(F.col("l_partkey").alias("uid"))
    return t.part.where("p_size < 10").select(F.col("p_partkey").alias("uid")).intersect(parts("l_quantity > 45")).subtract(parts("l_discount > 0.09"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))
