"""Feature sessions and agent memory as tables of events.

features: uid, feature_id, name, request, status, branch, created_at. Texts are redacted before they are stored; a message
or fact with a secret is refused. Empty tables give empty results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.redact import contains_secret, redacted
from lodegraph.functions.scores import feature_step
from lodegraph.functions.text import slug

CLOSED = ("done", "abandoned")
SIMILAR = 0.3


def start(requests: DataFrame, features: DataFrame, project: str) -> DataFrame:
    """New features of requests (name, request, branch, at): ids of day and name, the second of an id ending in -2 and so
    on, after those that exist (feature_id)."""
    base = F.concat_ws("_", F.lit("feat"), F.date_format("at", "yyyyMMdd"), F.regexp_replace(F.substring(slug(F.col("name")), 1, 40), "-+$", ""))
    x = requests.withColumn("base", base)
    taken = features.select(F.regexp_extract("feature_id", r"^(.*?)(?:-(\d+))?$", 1).alias("stem"), F.col("feature_id").alias("_id"))
    used = taken.select(F.col("_id").alias("base")).union(taken.select("stem")).distinct()
    most = features.select("feature_id").join(F.broadcast(used), F.col("feature_id").startswith(F.col("base"))).withColumn("tail", F.substring("feature_id", F.length("base") + 1, 99))
    most = most.where(F.col("tail").rlike(r"^(-\d+)?$")).groupBy("base").agg(F.max(F.coalesce(F.try_to_number(F.nullif(F.substring("tail", 2, 9), F.lit("")), F.lit("999999999")), F.lit(1))).alias("top"))
    x = x.join(most, "base", "left").withColumn("n", F.coalesce(F.col("top").cast("int"), F.lit(0)) + F.row_number().over(Window.partitionBy("base").orderBy("at", "request")))
    fid = F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base"))
    return x.select(F.concat(F.lit(f"{project}:feat:"), fid).alias("uid"), fid.alias("feature_id"), F.substring(redacted(F.col("name")), 1, 120).alias("name"), F.substring(redacted(F.col("request")), 1, 2000).alias("request"), F.lit("planning").alias("status"), "branch", F.col("at").alias("created_at"))


def move(features: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features with new statuses, refused steps) of steps (uid, status): a step that isn't legal changes nothing."""
    x = steps.dropDuplicates(["uid"]).join(features.select("uid", F.col("status").alias("current")), "uid", "left")
    legal = F.coalesce((F.col("current") == F.col("status")) | feature_step(F.col("current"), F.col("status")), F.lit(False))
    done = x.where(legal).select("uid", F.col("status").alias("_to"))
    return features.join(done, "uid", "left").withColumn("status", F.coalesce("_to", "status")).select(*features.columns), x.where(~legal).select("uid", "current", "status")


def active(features: DataFrame) -> DataFrame:
    """branch, uid: the newest feature of each branch that isn't closed."""
    open_ = features.where(~F.col("status").isin(*CLOSED) & F.col("branch").isNotNull())
    return open_.groupBy("branch").agg(F.max_by("uid", F.struct("created_at", "uid")).alias("uid"))


def planned(features: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features with plan_summary, planned_files and new_abstractions, in progress; FOLLOWED edges to the knowledge cited)
    of plans (uid, summary, files, abstractions, cited)."""
    p = plans.dropDuplicates(["uid"]).select("uid", F.substring(redacted(F.col("summary")), 1, 1000).alias("plan_summary"), F.col("files").alias("planned_files"), F.col("abstractions").alias("new_abstractions"), F.lit(True).alias("_has"))
    begun = F.col("_has") & feature_step(F.col("status"), F.lit("in_progress"))
    out = features.join(p, "uid", "left").withColumn("status", F.when(F.coalesce(begun, F.lit(False)), "in_progress").otherwise(F.col("status"))).drop("_has")
    cited = plans.select(F.col("uid").alias("src"), F.explode("cited").alias("dst")).where(F.split("dst", ":")[1] == "k")
    return out, cited.select("src", F.lit("FOLLOWED").alias("rel"), "dst").distinct()


def completed(feature: DataFrame, diff: DataFrame, plan_reuses: DataFrame, tests: DataFrame, evidence: DataFrame) -> DataFrame:
    """src, rel, dst of a finished feature (uid): INTRODUCES and MODIFIES symbols of the diff (feature, uid, status A or M),
    REUSES what the plan reuses, TESTED_BY test files and HAS_EVIDENCE artifacts (all: feature, uid)."""
    rel = F.when(F.col("status") == "A", "INTRODUCES").otherwise("MODIFIES")
    edge = lambda df, r: df.select(F.col("feature").alias("src"), r.alias("rel"), F.col("uid").alias("dst"))
    every = [edge(diff.where("status in ('A', 'M')"), rel), edge(plan_reuses, F.lit("REUSES")), edge(tests, F.lit("TESTED_BY")), edge(evidence, F.lit("HAS_EVIDENCE"))]
    return reduce(DataFrame.union, every).join(feature.select(F.col("uid").alias("src")).distinct(), "src", "left_semi").select("src", "rel", "dst").distinct()


def remember(memory: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memory with what may be stored, what is refused): rows (uid, kind, session, text, at) with a secret are refused; of a
    fact or preference that says the same as one before, nothing is added."""
    bad = contains_secret(F.col("text"))
    x = new.withColumn("_bad", bad)
    fine = x.where("not _bad").drop("_bad").dropDuplicates(["uid"])
    known = memory.where("kind in ('fact', 'preference')").select("kind", F.lower(F.trim("text")).alias("_said")).distinct()
    fresh = fine.withColumn("_said", F.lower(F.trim("text"))).join(known, ["kind", "_said"], "left_anti").join(memory.select("uid"), "uid", "left_anti").drop("_said")
    return memory.unionByName(fresh.select(*memory.columns)), x.where("_bad").drop("_bad")


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


def similar_traces(requests: DataFrame, traces: DataFrame, k: int = 3, least: float = SIMILAR) -> DataFrame:
    """key, uid, score, rank: the k traces (uid, text) nearest to each request (key, text), by the cosine of their sets of
    words. Only words that a trace and a request share are joined, rarest first: a pair whose cosine reaches `least` shares
    one of the request's n - ceil(least² n) + 1 rarest words."""
    r = requests.select("key", words(F.col("text")).alias("rw"))
    t = traces.select("uid", words(F.col("text")).alias("tw"))
    posts = t.select("uid", F.explode("tw").alias("w"))
    f = posts.groupBy("w").agg(F.count("*").alias("f"))
    asked = r.select("key", F.explode("rw").alias("w")).join(f, "w", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "w"))).alias("o"))
    prefix = F.size("o") - F.ceil(F.size("o") * F.lit(least * least)).cast("int") + 1
    rare = asked.select("key", F.explode(F.slice("o", F.lit(1), prefix)).alias("p")).select("key", F.col("p.w").alias("w"))
    pairs = rare.join(posts, "w").select("key", "uid").distinct().join(r, "key").join(t, "uid")
    score = F.size(F.array_intersect("rw", "tw")) / F.sqrt((F.size("rw") * F.size("tw")).cast("double"))
    x = pairs.select("key", "uid", F.round(score, 6).alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "uid")
    return x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(requests: DataFrame, memory: DataFrame, preferences: int = 6, traces: int = 3) -> DataFrame:
    """key, kind, uid: for each request (key, session, text) the newest preferences, the most similar traces, and the notes of
    its own session."""
    newest = memory.where("kind = 'preference'").orderBy(F.col("at").desc(), "uid").limit(preferences).select("uid")
    own = requests.join(memory.where("kind = 'message'").select("session", "uid"), "session").select("key", F.lit("note").alias("kind"), "uid")
    near = similar_traces(requests, memory.where("kind = 'trace'"), traces).select("key", F.lit("trace").alias("kind"), "uid")
    return requests.select("key").crossJoin(F.broadcast(newest)).select("key", F.lit("preference").alias("kind"), "uid").union(near).union(own)
