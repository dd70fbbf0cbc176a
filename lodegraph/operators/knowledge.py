"""Knowledge: evidence checks, submission of proposals in batches, decisions on single items, and revalidation.

knowledge: uid, kind, title, claim, source, status, confidence, support_count, violation_count, validated_by, rule_type,
rule, detector. evidence: knowledge_uid, path, line_start, line_end, symbol_uid, content_hash. events: uid, action, actor,
from_status, to_status, reason. Nulls of counts are 0, of flags false; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.redact import contains_secret
from lodegraph.functions.scores import confidence, decide_status, may_move

MOST_EVIDENCE = 20
MACHINE_RULES = ("forbid_dependency", "restrict_access", "forbid_external_dep", "placement")
ACTIVE = ("candidate", "validated", "deprecated")
DUPLICATE_TITLES = 0.8


def check_evidence(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (ref, knowledge_uid, pos, path, line_start, line_end) with line_start, line_end, content_hash and dropped: why a
    reference doesn't hold, null if it does. files: path, text.

    Start defaults to the first line; end to start, or, without one, to the last line. Of each piece of knowledge the
    first 20 references count. The hash is of the lines between, 16 digits of sha256. A file meets its distinct ranges, not
    its references, and texts stay with their files. Of files that repeat a path the smallest text counts."""
    own = files.groupBy("path").agg(F.min("text").alias("text")).where("text is not null")
    lines = F.split(F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\n$", ""), "\n")
    # a null has a key of its own here, so that ranges without a start or an end meet their references
    key = ["path", F.coalesce("line_start", F.lit(-1)).alias("_from"), F.coalesce("line_end", F.lit(-1)).alias("_to"), F.col("line_start").isNull().alias("_open"), F.col("line_end").isNull().alias("_rest")]
    asked = refs.select(*key, "line_start", "line_end").distinct()
    x = asked.join(own, "path").withColumn("_lines", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(lines)).withColumn("total", F.size("_lines"))
    start = F.coalesce("line_start", F.lit(1))
    end = F.coalesce("line_end", "line_start", F.coalesce("total", F.lit(0)))
    body = F.array_join(F.slice("_lines", F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")
    names = ["path", "_from", "_to", "_open", "_rest"]
    held = x.select(*names, "total", F.substring(F.sha2(body, 256), 1, 16).alias("_hash"))
    x = refs.select("*", *key[1:]).join(held, names, "left")
    x = x.withColumn("_rank", F.row_number().over(Window.partitionBy("knowledge_uid").orderBy("pos", "ref")))
    why = F.when(F.col("_rank") > MOST_EVIDENCE, "beyond the first 20").when(F.col("total").isNull(), "file not found").when((start < 1) | (start > end) | (end > F.col("total")), "outside the file")
    return x.select("ref", "knowledge_uid", "path", start.alias("line_start"), end.alias("line_end"), F.when(why.isNull(), F.col("_hash")).alias("content_hash"), why.alias("dropped"))


def evidence_uid(project: Column, knowledge: Column, rel: Column, path: Column, start: Column, end: Column, symbol: Column) -> Column:
    """project:ev:16 digits of sha256 over the parts, parted by a unit separator; a null part reads None."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat_ws(":", project, F.lit("ev"), F.substring(F.sha2(F.concat_ws("\x1f", *map(part, (project, knowledge, rel, path, start, end, symbol))), 256), 1, 16))


def attach_evidence(evidence: DataFrame, project: str, rel: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence with uid, edges src, rel, dst): knowledge to evidence, and evidence to the files, documents (by path) and
    symbols (by uid) of `targets` (uid, path, symbol_uid) that exist. The uid names the content, so a rerun adds nothing."""
    lit = F.lit(project)
    e = evidence.withColumn("uid", evidence_uid(lit, F.col("knowledge_uid"), F.lit(rel), F.col("path"), F.col("line_start"), F.col("line_end"), F.col("symbol_uid"))).dropDuplicates(["uid"])
    hold = e.select(F.col("knowledge_uid").alias("src"), F.lit(rel).alias("rel"), F.col("uid").alias("dst"))
    by = lambda c: e.select("uid", c).where(f"{c} is not null").join(targets.select(c, F.col("uid").alias("dst")), c).select(F.col("uid").alias("src"), F.lit("REFERENCES").alias("rel"), "dst")
    return e, hold.union(by("path")).union(by("symbol_uid")).distinct()


def duplicate_of(proposals: DataFrame, knowledge: DataFrame) -> DataFrame:
    """uid, dup of new proposals: the first knowledge (by kind, status, confidence down, title) of the same kind with the
    same rule, or a title whose words agree to 0.8 (Jaccard). Candidates share a rule or a word; none is held against all."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    p = proposals.select("uid", "kind", "rule", words("title").alias("pw"))
    k = knowledge.select(F.col("uid").alias("dup"), "kind", F.col("rule").alias("krule"), F.col("status").alias("_s"), F.col("confidence").alias("_c"), F.col("title").alias("_t"), words("title").alias("kw"))
    same_rule = p.where("rule is not null").join(k, (p["kind"] == k["kind"]) & (p["rule"] == k["krule"])).select("uid", "dup", "_s", "_c", "_t")
    a = p.select("uid", "kind", F.size("pw").alias("n"), F.explode("pw").alias("w"))
    b = k.select("dup", "kind", F.size("kw").alias("m"), F.explode("kw").alias("w"), "_s", "_c", "_t")
    near = a.join(b, ["kind", "w"]).groupBy("uid", "dup", "n", "m", "_s", "_c", "_t").agg(F.count("*").alias("k")).where(F.col("k") / (F.col("n") + F.col("m") - F.col("k")) >= DUPLICATE_TITLES)
    every = same_rule.union(near.select("uid", "dup", "_s", "_c", "_t")).where("uid <> dup").distinct()
    line = Window.partitionBy("uid").orderBy("_s", F.col("_c").desc_nulls_last(), "_t", "dup")
    return every.withColumn("_r", F.row_number().over(line)).where("_r = 1").select("uid", "dup")


def submit(proposals: DataFrame, knowledge: DataFrame, kept: DataFrame, rederived: DataFrame | None = None) -> DataFrame:
    """uid, target, outcome, status, confidence, support, violations, reason, from_status of each proposal of a batch.

    proposals: uid, kind, title, claim, rationale, source, actor, adr_status, rule_type, rule, support_count,
    violation_count. kept: knowledge_uid, kept, against: how much of a proposal's evidence holds. rederived: uid,
    support, violations that evaluating machine-checkable rules gave.

    In order: secrets are rejected; proposals without evidence, unless a machine rule speaks for them or they revalidate
    known knowledge; new ones of agents and humans that repeat known knowledge are merged into it; what was rejected
    before isn't taken from agents again. Then counts, confidence, the status policy and the transitions' guard. Rows
    that repeat a uid in a batch are taken once, by the smallest title and claim."""
    one = proposals.withColumn("_r", F.row_number().over(Window.partitionBy("uid").orderBy("title", "claim"))).where("_r = 1").drop("_r")
    known = knowledge.select(F.col("uid").alias("k_uid"), F.col("status").alias("k_status"), F.col("support_count").alias("k_support"), F.col("violation_count").alias("k_violations"), F.col("validated_by").alias("k_by"))
    first = one.join(known.select(F.col("k_uid").alias("uid"), F.lit(True).alias("exists")), "uid", "left")
    fresh = first.where("exists is null and source in ('agent', 'human')")
    dup = duplicate_of(fresh, knowledge)
    x = first.join(dup, "uid", "left").withColumn("target", F.coalesce("dup", "uid")).join(known, F.col("target") == F.col("k_uid"), "left")
    x = x.join(kept.select(F.col("knowledge_uid").alias("uid"), "kept", "against"), "uid", "left").fillna(0, ["kept", "against"])
    again = rederived if rederived is not None else proposals.where("false").select("uid", F.lit(0).alias("support"), F.lit(0).alias("violations"))
    x = x.join(again.select("uid", F.col("support").alias("r_support"), F.col("violations").alias("r_violations")), "uid", "left")
    machine = F.coalesce(F.col("rule_type").isin(*MACHINE_RULES) & F.col("rule").isNotNull(), F.lit(False))
    merge, derived = F.col("dup").isNotNull(), F.col("r_support").isNotNull()
    secret = contains_secret(F.concat_ws("\n", "title", "claim", "rationale"))
    bare = (F.col("kept") == 0) & ~machine & ~(F.coalesce(F.col("actor") == "revalidation", F.lit(False)) & F.col("exists").isNotNull())
    refused = F.when(secret, "contains a secret").when(bare, "no valid evidence").when((F.col("k_status") == "rejected") & (F.col("source") == "agent"), "a matching claim was rejected before")
    zero = lambda c: F.coalesce(c, F.lit(0))
    support = F.when(derived, F.col("r_support")).when(merge, zero("k_support") + F.col("kept")).otherwise(F.coalesce("support_count", "kept"))
    against = F.when(derived, F.col("r_violations")).when(merge, zero("k_violations") + F.col("against")).otherwise(F.coalesce("violation_count", "against"))
    human = F.coalesce(F.col("k_by").startswith("human"), F.lit(False))
    weigh = F.when(derived & (F.col("source") == "agent"), "auditor").otherwise(F.col("source"))
    accepted = (F.col("source") == "adr") & F.coalesce(F.col("adr_status") == "validated", F.lit(False))
    x = x.select("*", refused.alias("refused"), support.cast("long").alias("support"), against.cast("long").alias("violations"), human.alias("human"), derived.alias("derived"), weigh.alias("weigh"), accepted.alias("accepted"))
    x = x.withColumn("conf", confidence(F.col("support"), F.col("violations"), F.col("weigh"), None, F.col("accepted"), F.col("human")))
    wish = decide_status(F.col("k_status"), F.col("source"), F.col("adr_status"), F.col("support"), F.col("conf"), F.col("derived"), F.col("human"))
    x = x.withColumn("wish", wish)
    allowed = F.col("k_status").isNull() | may_move(F.col("k_status"), F.col("wish"), F.coalesce("actor", "source"), F.col("derived"))
    status = F.when(F.coalesce(allowed, F.lit(False)), F.col("wish")).otherwise(F.col("k_status"))
    ok = F.col("refused").isNull()
    outcome = F.when(~ok, "rejected").when(F.col("dup").isNotNull(), "merged").when(F.col("exists").isNotNull(), "updated").otherwise("created")
    reason = F.coalesce("refused", F.when(~F.coalesce(allowed, F.lit(False)), F.concat(F.lit("kept "), "k_status")))
    return x.select("uid", "target", outcome.alias("outcome"), F.when(ok, status).alias("status"), F.when(ok, F.col("conf")).alias("confidence"), F.when(ok, F.col("support")).alias("support"), F.when(ok, F.col("violations")).alias("violations"), reason.alias("reason"), F.col("k_status").alias("from_status"))


def decide(knowledge: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(knowledge with new statuses, events) of orders (uid, to_status, actor, reason, superseded_by): approve, reject,
    deprecate and supersede. Rejecting and deprecating need a reason, superseding a successor that exists, all of them a
    legal transition; other orders are events with the action `refused`. Of orders that repeat a uid the smallest counts."""
    own = orders.withColumn("_r", F.row_number().over(Window.partitionBy("uid").orderBy("to_status", "actor", "reason"))).where("_r = 1").drop("_r")
    successors = knowledge.select(F.col("uid").alias("superseded_by"), F.lit(True).alias("_there"))
    x = own.join(knowledge.select("uid", F.col("status").alias("from_status")), "uid", "left").join(successors, "superseded_by", "left")
    said = F.coalesce(F.trim("reason"), F.lit("")) != ""
    legal = may_move(F.col("from_status"), F.col("to_status"), F.col("actor"), F.lit(False))
    ok = F.col("from_status").isNotNull() & legal & (said | ~F.col("to_status").isin("rejected", "deprecated")) & (F.col("_there").isNotNull() | (F.col("to_status") != "superseded"))
    x = x.withColumn("ok", F.coalesce(ok, F.lit(False)))
    events = x.select("uid", F.when(F.col("ok"), "status_change").otherwise("refused").alias("action"), "actor", "from_status", "to_status", "reason")
    done = x.where("ok").select("uid", F.col("to_status").alias("_to"), F.col("actor").alias("_by"), F.col("superseded_by").alias("_next"))
    base = knowledge.drop("superseded_by") if "superseded_by" in knowledge.columns else knowledge
    out = base.join(done, "uid", "left")
    validated = F.when(F.col("_to") == "validated", F.col("_by")).otherwise(F.col("validated_by"))
    return out.withColumn("validated_by", validated).withColumn("status", F.coalesce("_to", "status")).withColumn("superseded_by", F.col("_next")).drop("_to", "_by", "_next"), events


def revalidation(knowledge: DataFrame, touched: DataFrame, stale: DataFrame) -> DataFrame:
    """uid, way, status of active knowledge that the run didn't touch: `rule` is evaluated again, `lost` is the auditor's
    whose detector no longer finds it (its support is 0), and `evidence` is re-hashed. stale: knowledge_uid, refs, stale.

    Where all evidence is stale, validated knowledge is deprecated; rules and lost ones get their status from `submit`."""
    x = knowledge.where(F.col("status").isin(*ACTIVE)).join(touched.select("uid").distinct(), "uid", "left_anti")
    x = x.join(stale.select(F.col("knowledge_uid").alias("uid"), "refs", "stale"), "uid", "left")
    way = F.when(F.col("rule_type").isin(*MACHINE_RULES) & F.col("rule").isNotNull(), "rule").when((F.col("source") == "auditor") & F.col("detector").isNotNull(), "lost").otherwise("evidence")
    gone = (F.col("refs") > 0) & (F.col("refs") == F.col("stale")) & (F.col("status") == "validated")
    x = x.withColumn("way", way)
    return x.select("uid", "way", F.when((F.col("way") == "evidence") & F.coalesce(gone, F.lit(False)), "deprecated").otherwise(F.col("status")).alias("status"))


def stale_evidence(evidence: DataFrame, now: DataFrame) -> DataFrame:
    """uid, knowledge_uid, stale, stale_reason of evidence (uid, knowledge_uid, content_hash) against fresh hashes (ref,
    content_hash): missing without one, changed with another; a reference that never had a hash is only missing."""
    x = evidence.join(now.select(F.col("ref").alias("uid"), F.col("content_hash").alias("_now")), "uid", "left")
    why = F.when(F.col("_now").isNull(), "missing").when(F.col("content_hash").isNotNull() & (F.col("content_hash") != F.col("_now")), "changed")
    return x.select("uid", "knowledge_uid", why.isNotNull().alias("stale"), why.alias("stale_reason"))


def proposals_of(verdicts: DataFrame, patterns: DataFrame, sample: int = 20) -> DataFrame:
    """key, title, claim, support_count, violation_count, evidence, contradictions: what a detector saw (key, uid, path,
    line, verdict) as proposals of its patterns (key, title, claim), with the first `sample` references of each side."""
    line = Window.partitionBy("key", "verdict").orderBy("path", "line", "uid")
    seen = verdicts.withColumn("_r", F.row_number().over(line)).withColumn("_ref", F.when(F.col("_r") <= sample, F.concat_ws(":", "path", "line")))
    side = lambda v: F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.col("_ref"))))
    g = seen.groupBy("key").agg(F.count_if(F.col("verdict") == "support").alias("support_count"), F.count_if(F.col("verdict") == "violation").alias("violation_count"), side("support").alias("evidence"), side("violation").alias("contradictions"))
    return patterns.join(g, "key").select("key", "title", "claim", "support_count", "violation_count", "evidence", "contradictions")


def ingest_links(verdicts: DataFrame, constraints: DataFrame, records: DataFrame, established: DataFrame) -> DataFrame:
    """src, rel, dst: symbols FOLLOWS patterns they support (verdicts: key, uid, verdict), CONSTRAINED_BY constraints
    (constraint, uid), decisions SUPERSEDES others (adr_id, supersedes) and ESTABLISHES knowledge (a, b)."""
    edge = lambda df, src, rel, dst: df.select(F.col(src).cast("string").alias("src"), F.lit(rel).alias("rel"), F.col(dst).cast("string").alias("dst"))
    follows = edge(verdicts.where("verdict = 'support'"), "uid", "FOLLOWS", "key")
    bound = edge(constraints, "uid", "CONSTRAINED_BY", "constraint")
    newer = edge(records.select("adr_id", F.explode("supersedes").alias("old")), "adr_id", "SUPERSEDES", "old")
    return follows.union(bound).union(newer).union(edge(established, "a", "ESTABLISHES", "b")).distinct()
