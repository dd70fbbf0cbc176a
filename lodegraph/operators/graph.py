"""Graph operators over edge tables (src, dst, and what else an edge has)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.lineage import cut


#: So many seeds at most are broadcast to the edges.
SENT_SEEDS = 10_000


def undirected(edges: DataFrame, *keep: str) -> DataFrame:
    """Both directions of each edge, once."""
    return edges.select("src", "dst", *keep).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keep)).distinct()


def owner_rollup(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """`key` replaced by its owner where `members` (owner, member) has one."""
    m = members.select(F.col("owner"), F.col("member").alias("_member"))
    return rows.join(m, rows[key] == m["_member"], "left").withColumn(key, F.coalesce("owner", key)).drop("owner", "_member")


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    n = nodes.select(F.col("uid"))
    return edges.join(n.withColumnRenamed("uid", "src"), "src", "left_semi").join(n.withColumnRenamed("uid", "dst"), "dst", "left_semi")


def co_occurring(rows: DataFrame, group: str, item: str, min_count: int, max_items: int | None) -> DataFrame:
    """a, b, n: unordered pairs of items that share at least min_count groups; groups of over max_items items don't count.

    The pairs of a group number at most max_items squared, so no group is expanded without a bound; None is for groups
    that the data bound."""
    seen = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    if max_items is not None:
        small = seen.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") <= max_items).select("g")
        seen = seen.join(small, "g", "left_semi")
    pairs = seen.select("g", F.col("i").alias("a")).join(seen.select("g", F.col("i").alias("b")), "g").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, min_depth: int = 1) -> DataFrame:
    """uid, depth: what the seeds (uid) reach over src -> dst within `depth` steps, with the fewest steps, seeds left out.

    Level by level: each step joins the frontier with the edges and drops what was seen, so cycles cost nothing and no
    path is listed. The number of steps is the query's own bound."""
    frontier = seeds.select("uid").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    edges = cut(edges.select("src", "dst").distinct()) if depth > 1 else edges
    for d in range(1, depth + 1):
        step = frontier.join(edges.select(F.col("src").alias("uid"), "dst"), "uid").select(F.col("dst").alias("uid")).distinct()
        frontier = cut(step.join(seen.select("uid"), "uid", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    return seen.where(F.col("depth") >= min_depth)


def dependents(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The same against the edges' direction: what would feel a change of the seeds."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth)


def without_reach(nodes: DataFrame, edges: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """Nodes that reach none of the leaves (uid) within the depth of the containment tree."""
    full = dependents(edges, leaves, depth).select("uid").union(leaves.select("uid"))
    return nodes.join(full, "uid", "left_anti")


def spread(seeds: DataFrame, edges: DataFrame, hops: int = 2, decay: float = 0.5, share: float = 0.25, frontier: int = 24) -> DataFrame:
    """uid, score: seeds' scores plus what flows to neighbours over weighted edges (src, dst, weight), divided by the root
    of the source's degree. Each hop adds a share of what it brings, half as much as the hop before, and only its best
    nodes go on.

    Edges stay where they are: a hop's frontier is at most `frontier` nodes, so it is sent to them. Seeds are sent too
    while there are at most SENT_SEEDS of them; more are joined by a shuffle."""
    seeds = cut(seeds.select("uid", "score"))
    scores = wave = seeds
    few = seeds.limit(SENT_SEEDS + 1).count() <= SENT_SEEDS
    for hop in range(hops):
        near = (F.broadcast(wave) if hop or few else wave).join(edges.withColumnRenamed("src", "uid"), "uid")
        degree = near.groupBy("uid").agg(F.count("*").alias("degree"))
        flow = near.join(degree, "uid").select(F.col("dst").alias("uid"), (F.col("score") * decay * F.col("weight") / F.sqrt(F.col("degree").cast("double"))).alias("gain"))
        gained = cut(flow.groupBy("uid").agg(F.sum("gain").alias("score")))
        part = share / 2**hop
        scores = scores.union(gained.select("uid", F.col("score") * part)).groupBy("uid").agg(F.sum("score").alias("score"))
        wave = gained.orderBy(F.round("score", 9).desc(), "uid").limit(frontier)
    return scores


def merge_edges(edges: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One edge of each (src, dst, rel): its best `via`, how many there were, and `op`, rw where reads and writes meet."""
    rank = F.create_map(*[F.lit(v) for kv in priority.items() for v in kv])
    return edges.groupBy("src", "dst", "rel").agg(F.min_by("via", F.struct(F.coalesce(F.try_element_at(rank, F.col("via")), F.lit(99)), F.col("via"))).alias("via"), F.count("*").alias("n"), F.when(F.min("op") != F.max("op"), "rw").otherwise(F.min("op")).alias("op"))


def enclosing(points: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """Each point (pid, at) with the uid of the shortest span (uid, low, high) of its key around it, the smallest uid of
    several; null if none is. Places are joined with spans on the key with a range condition, each place and each range of a
    key once, however many points and spans share it; one minimum per place goes back to its points."""
    ranges = spans.groupBy(*on, "low", "high").agg(F.min("uid").alias("uid"))
    hit = points.select(*on, "at").distinct().join(ranges, on).where(F.col("at").between(F.col("low"), F.col("high")))
    inner = hit.groupBy(*on, "at").agg(F.min(F.struct((F.col("high") - F.col("low")).alias("width"), F.col("uid").alias("uid"))).alias("best"))
    return points.join(inner, [*on, "at"], "left").select(*points.columns, F.col("best.uid").alias("uid"))


#: So many ids, about, are in one list of `listed`.
LISTED = 4096


def listed(rows: DataFrame, key: str, item: str) -> DataFrame:
    """key, items: the items of each key in lists of about LISTED, so that a key of many rows is many lists. What is broadcast
    are the counts of keys with more items than one list has."""
    x = rows.select(key, item).where(F.col(key).isNotNull() & F.col(item).isNotNull())
    large = x.groupBy(key).agg(F.ceil(F.count("*") / LISTED).alias("_n")).where("_n > 1")
    dealt = x.join(F.broadcast(large), key, "left").withColumn("_part", F.pmod(F.xxhash64(item), F.coalesce("_n", F.lit(1))))
    return dealt.groupBy(key, "_part").agg(F.collect_list(item).alias("items")).drop("_part")


def unlisted(pairs: DataFrame, left: str, right: str, a: str, b: str) -> DataFrame:
    """Every item of list `left` (as a) beside every one of list `right` (as b), each pair of lists in some task; pairs of
    items are made where they are used, never shuffled."""
    n = max(32, pairs.sparkSession.sparkContext.defaultParallelism * 8)
    return pairs.repartition(n).withColumn(a, F.explode(left)).drop(left).withColumn(b, F.explode(right)).drop(right)


def top_per(df: DataFrame, by: list[str | Column], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
