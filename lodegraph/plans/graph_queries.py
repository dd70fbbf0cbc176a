"""Graph operators on the driver tables: parts as symbols, orders as owners and commits, nations as modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import graph
from lodegraph.plans.registry import Tables, query

#: Parts on consecutive lines of an order are linked, by a relation that the line's flag names.
EDGES = """e AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CASE a.l_returnflag WHEN 'A' THEN 'USES' WHEN 'N' THEN 'CALLS' ELSE 'ACCESSES' END AS rel
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""
TREE = """c AS (
  SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def part_edges(t: Tables) -> DataFrame:
    a = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.when(F.col("l_returnflag") == "A", "USES").when(F.col("l_returnflag") == "N", "CALLS").otherwise("ACCESSES").alias("rel"))
    b = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst", "rel").distinct()


def tree(t: Tables) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return (
        t.nation.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
        .union(t.customer.select(key("n", "c_nationkey"), key("c", "c_custkey")))
        .union(t.supplier.select(key("n", "s_nationkey"), key("s", "s_suppkey")))
        .union(t.orders.select(key("c", "o_custkey"), key("o", "o_orderkey")))
    )


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem),
k AS (SELECT g FROM s GROUP BY g HAVING count(*) <= 50)
SELECT a.i AS a, b.i AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.i < b.i WHERE a.g IN (SELECT g FROM k) GROUP BY a.i, b.i HAVING count(*) >= 3""")
def cochange_pairs(t: Tables) -> DataFrame:
    return graph.co_occurring(t.lineitem, "l_orderkey", "l_suppkey", 3, 50)


@query("""SELECT o_custkey AS uid, max(l_extendedprice) AS best, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey
UNION ALL SELECT l_orderkey, max(l_extendedprice), count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""")
def owner_rollup(t: Tables) -> DataFrame:
    members = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("member"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("uid"), "l_extendedprice")
    return graph.owner_rollup(rows, members, "uid").groupBy("uid").agg(F.max("l_extendedprice").alias("best"), F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT src, dst, rel FROM e UNION SELECT dst, src, rel FROM e")
def neighbours_undirected(t: Tables) -> DataFrame:
    return graph.undirected(part_edges(t), "rel")


@query(f"""WITH {EDGES}, p AS (SELECT p_partkey FROM part WHERE p_size > 25)
SELECT src, dst, rel FROM e WHERE src IN (SELECT p_partkey FROM p) AND dst IN (SELECT p_partkey FROM p)""")
def edges_with_endpoints(t: Tables) -> DataFrame:
    return graph.with_endpoints(part_edges(t), t.part.where("p_size > 25").select(F.col("p_partkey").alias("uid"))).select("src", "dst", "rel")


_BFS = """WITH RECURSIVE {edges}, d0 AS (SELECT CAST(1 AS BIGINT) AS uid),
d1 AS (SELECT DISTINCT {to} AS uid FROM e WHERE {of} IN (SELECT uid FROM d0) AND {to} NOT IN (SELECT uid FROM d0)),
d2 AS (SELECT DISTINCT {to} AS uid FROM e WHERE {of} IN (SELECT uid FROM d1) AND {to} NOT IN (SELECT uid FROM d0 UNION SELECT uid FROM d1)),
d3 AS (SELECT DISTINCT {to} AS uid FROM e WHERE {of} IN (SELECT uid FROM d2) AND {to} NOT IN (SELECT uid FROM d0 UNION SELECT uid FROM d1 UNION SELECT uid FROM d2))
SELECT uid, 1 AS depth FROM d1 UNION ALL SELECT uid, 2 FROM d2 UNION ALL SELECT uid, 3 FROM d3"""


@query(_BFS.format(edges=EDGES, to="src", of="dst"))
def impact_upstream(t: Tables) -> DataFrame:
    return graph.dependents(part_edges(t).select("src", "dst").distinct(), t.spark.range(1, 2).select(F.col("id").alias("uid")), 3)


@query(_BFS.format(edges=EDGES, to="dst", of="src"))
def impact_downstream(t: Tables) -> DataFrame:
    return graph.reach(part_edges(t).select("src", "dst").distinct(), t.spark.range(1, 2).select(F.col("id").alias("uid")), 3)


@query(f"""WITH {EDGES}, d0 AS (SELECT p_partkey AS uid FROM part WHERE p_size = 1),
d1 AS (SELECT src AS uid FROM e WHERE rel IN ('USES', 'CALLS') AND dst IN (SELECT uid FROM d0)),
d2 AS (SELECT src AS uid FROM e WHERE rel IN ('USES', 'CALLS') AND dst IN (SELECT uid FROM d1)),
a AS (SELECT uid FROM d0 UNION SELECT uid FROM d1 UNION SELECT uid FROM d2)
SELECT DISTINCT l_orderkey AS route FROM lineitem WHERE l_linenumber = 1 AND l_partkey IN (SELECT uid FROM a)""")
def route_reach(t: Tables) -> DataFrame:
    """Routes (orders) whose handler (first line's part) reaches a small part within two steps."""
    edges = part_edges(t).where("rel in ('USES', 'CALLS')").select("src", "dst").distinct()
    targets = t.part.where("p_size = 1").select(F.col("p_partkey").alias("uid"))
    near = graph.dependents(edges, targets, 2).select("uid").union(targets)
    handled = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("route"), F.col("l_partkey").alias("uid"))
    return handled.join(near, "uid", "left_semi").select("route").distinct()


@query(f"""WITH {TREE}, big AS (SELECT 'o' || o_orderkey AS uid FROM orders WHERE o_totalprice > 300000),
c1 AS (SELECT src AS uid FROM c WHERE dst IN (SELECT uid FROM big)), c2 AS (SELECT src AS uid FROM c WHERE dst IN (SELECT uid FROM c1)), c3 AS (SELECT src AS uid FROM c WHERE dst IN (SELECT uid FROM c2))
SELECT DISTINCT src AS uid FROM c WHERE src NOT IN (SELECT uid FROM c1 UNION SELECT uid FROM c2 UNION SELECT uid FROM c3)""")
def empty_modules(t: Tables) -> DataFrame:
    """Containers below which there is no large order."""
    edges = tree(t)
    leaves = t.orders.where("o_totalprice > 300000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("uid"))
    return graph.without_reach(edges.select(F.col("src").alias("uid")).distinct(), edges, leaves, 3)


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT src AS uid, 0 AS depth FROM c WHERE src LIKE 'r%' GROUP BY src UNION ALL SELECT c.dst, w.depth + 1 FROM w JOIN c ON c.src = w.uid)
SELECT depth, substr(uid, 1, 1) AS kind, count(*) AS n FROM w GROUP BY 1, 2""")
def containment_depth(t: Tables) -> DataFrame:
    edges = tree(t)
    roots = edges.where("src like 'r%'").select(F.col("src").alias("uid")).distinct()
    return graph.reach(edges, roots, 4, 0).groupBy("depth", F.substring("uid", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH spans AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS uid, CAST(l_quantity AS BIGINT) AS low, CAST(l_quantity AS BIGINT) + l_linenumber * 3 AS high FROM lineitem),
points AS (SELECT event_id AS pid, user_id % 100 + 1 AS k, CAST(floor(value) AS BIGINT) % 60 AS place FROM events),
r AS (SELECT pid, uid, row_number() OVER (PARTITION BY pid ORDER BY high - low, uid) AS rn FROM points JOIN spans USING (k) WHERE place BETWEEN low AND high)
SELECT p.pid, r.uid FROM points p LEFT JOIN r ON r.pid = p.pid AND r.rn = 1""")
def enclosing_span(t: Tables) -> DataFrame:
    spans = t.lineitem.select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"), F.col("l_quantity").cast("long").alias("low"), (F.col("l_quantity").cast("long") + F.col("l_linenumber") * 3).alias("high"))
    points = t.events.select(F.col("event_id").alias("pid"), (F.col("user_id") % 100 + 1).alias("k"), (F.floor("value").cast("long") % 60).alias("at"))
    return graph.enclosing(points, spans, ["k"]).select("pid", "uid")


@query("""WITH j AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT src, dst, count(*) AS weight FROM j WHERE src <> dst GROUP BY src, dst""")
def module_weights(t: Tables) -> DataFrame:
    """Dependencies between modules (nations), weighed by the lines that cross."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    homes = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("src"))
    j = lines.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey").join(homes, "l_orderkey")
    return j.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query("""WITH x AS (SELECT l_suppkey AS src, l_partkey AS dst, l_linestatus AS rel, l_returnflag AS via, CASE WHEN l_discount > 0.05 THEN 'write' ELSE 'read' END AS op FROM lineitem)
SELECT src, dst, rel, CASE min(CASE via WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'N' WHEN 2 THEN 'A' ELSE 'R' END AS via, count(*) AS n, CASE WHEN count(DISTINCT op) > 1 THEN 'rw' ELSE min(op) END AS op FROM x GROUP BY 1, 2, 3""")
def edge_merge_policy(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linestatus").alias("rel"), F.col("l_returnflag").alias("via"), F.when(F.col("l_discount") > 0.05, "write").otherwise("read").alias("op"))
    return graph.merge_edges(edges, {"N": 1, "A": 2, "R": 3})


@query(f"""WITH {EDGES}, u AS (SELECT src, dst, rel FROM e UNION SELECT dst, src, rel FROM e)
SELECT dst AS uid, count(DISTINCT src) AS fan_in, round(least(1.0, log2(1.0 + count(DISTINCT src)) / log2(9.0)), 3) AS maturity FROM u WHERE rel <> 'ACCESSES' GROUP BY dst""")
def fan_in_maturity(t: Tables) -> DataFrame:
    from lodegraph.functions.scores import maturity

    users = graph.undirected(part_edges(t).where("rel <> 'ACCESSES'"), "rel").select("src", "dst").distinct()
    return users.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("fan_in")).withColumn("maturity", maturity(F.col("fan_in")))


_W = "CASE rel WHEN 'USES' THEN 1.0 WHEN 'CALLS' THEN 0.8 ELSE 0.7 END"


@query(f"""WITH {EDGES}, u AS (SELECT src, dst, {_W} AS w FROM e UNION SELECT dst, src, {_W} FROM e),
s AS (SELECT p_partkey AS uid, CAST(1.0 AS DOUBLE) / p_size AS score FROM part WHERE p_partkey <= 12),
f1 AS (SELECT u.dst AS uid, s.score * 0.5 * u.w / sqrt(count(*) OVER (PARTITION BY s.uid)) AS g FROM s JOIN u ON u.src = s.uid), g1 AS (SELECT uid, sum(g) AS g FROM f1 GROUP BY uid),
t1 AS (SELECT uid, g FROM g1 ORDER BY round(g, 9) DESC, uid LIMIT 24),
f2 AS (SELECT u.dst AS uid, t1.g * 0.5 * u.w / sqrt(count(*) OVER (PARTITION BY t1.uid)) AS g FROM t1 JOIN u ON u.src = t1.uid), g2 AS (SELECT uid, sum(g) AS g FROM f2 GROUP BY uid)
SELECT uid, round(sum(x), 6) AS score FROM (SELECT uid, score AS x FROM s UNION ALL SELECT uid, g * 0.25 FROM g1 UNION ALL SELECT uid, g * 0.125 FROM g2) GROUP BY uid""")
def graph_spread(t: Tables) -> DataFrame:
    seeds = t.part.where("p_partkey <= 12").select(F.col("p_partkey").alias("uid"), (F.lit(1.0) / F.col("p_size")).alias("score"))
    return graph.spread(seeds, weighted(t)).select("uid", F.round("score", 6).alias("score"))


def weighted(t: Tables) -> DataFrame:
    w = F.when(F.col("rel") == "USES", 1.0).when(F.col("rel") == "CALLS", 0.8).otherwise(0.7)
    return graph.undirected(part_edges(t).select("src", "dst", w.alias("weight")), "weight")


@query("""SELECT c.c_custkey AS uid, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_users,
 coalesce((SELECT string_agg(DISTINCT o.o_orderpriority, ',' ORDER BY o.o_orderpriority) FROM orders o WHERE o.o_custkey = c.c_custkey), '') AS patterns, n.n_name AS module
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def info_enrichment(t: Tables) -> DataFrame:
    """Optional matches: each branch is aggregated by itself and then joined, so no rows multiply."""
    users = t.orders.groupBy(F.col("o_custkey").alias("uid")).agg(F.count("*").alias("n_users"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("patterns"))
    base = t.customer.select(F.col("c_custkey").alias("uid"), "c_nationkey").join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("module")), "c_nationkey", "left")
    return base.join(users, "uid", "left").select("uid", F.coalesce("n_users", F.lit(0)).cast("long").alias("n_users"), F.coalesce("patterns", F.lit("")).alias("patterns"), "module")


@query("""SELECT n_name AS controller, p_brand AS service, s_name AS repository, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = c_nationkey WHERE p_size <= 5 GROUP BY 1, 2, 3""")
def layered_path(t: Tables) -> DataFrame:
    """A path of fixed shape through five layers."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").join(t.part.where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("service")), "l_partkey")
    lines = lines.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("repository")), "l_suppkey")
    who = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("controller"))
    j = lines.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(who, "o_custkey")
    return j.groupBy("controller", "service", "repository").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS feature, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS touched, count(DISTINCT l_suppkey) AS n_evidence, min(c_name) AS owner
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey""")
def feature_subgraph(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("feature"), "o_custkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("feature"), "l_partkey", "l_suppkey").join(urgent, "feature", "left_semi")
    touched = lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left").groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("touched"), F.count_distinct("l_suppkey").alias("n_evidence"))
    owners = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner"))
    out = urgent.join(touched, "feature", "left").join(owners, "o_custkey", "left")
    return out.select("feature", F.coalesce("touched", F.lit("")).alias("touched"), F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"), "owner")


@query(f"""WITH {EDGES}, i AS (SELECT dst AS uid, count(DISTINCT src) AS n FROM e GROUP BY dst), o AS (SELECT src AS uid, count(DISTINCT dst) AS m FROM e GROUP BY src)
SELECT p_partkey AS uid, coalesce(n, 0) AS users, coalesce(m, 0) AS deps FROM part LEFT JOIN i ON i.uid = p_partkey LEFT JOIN o ON o.uid = p_partkey""")
def degree_summary(t: Tables) -> DataFrame:
    pairs = part_edges(t).select("src", "dst").distinct()
    users, deps = pairs.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("users")), pairs.groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("deps"))
    return t.part.select(F.col("p_partkey").alias("uid")).join(users, "uid", "left").join(deps, "uid", "left").fillna(0, ["users", "deps"])
