"""Confidence, status, roles, patterns, rules and guardrails on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import scores
from lodegraph.operators import graph, mining
from lodegraph.plans.registry import Tables, query

_SUP = "sup AS (SELECT source, count(*) FILTER (quality = 1) AS s, count(*) FILTER (quality = 0) AS v FROM labels JOIN documents USING (doc_id) GROUP BY source)"
_WILSON = "greatest(0.0, ((s / (s + v)) + 1.0 / (2 * (s + v)) - sqrt((s / (s + v)) * (1 - s / (s + v)) / (s + v) + 1.0 / (4.0 * (s + v) * (s + v)))) / (1 + 1.0 / (s + v)))"


def _support(t: Tables) -> DataFrame:
    x = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return mining.support(x, ["source"], F.col("quality") == 1, F.col("quality") == 0)


@query(f"WITH {_SUP} SELECT source, s AS support, v AS violations, round({_WILSON}, 6) AS wilson FROM sup")
def wilson_confidence(t: Tables) -> DataFrame:
    return _support(t).select("source", "support", "violations", F.round(scores.wilson_lower_bound(F.col("support"), F.col("support") + F.col("violations")), 6).alias("wilson"))


_KIND = "CASE length(source) % 2 WHEN 0 THEN 'agent' ELSE 'auditor' END"


@query(f"""WITH {_SUP}, c AS (SELECT source, {_KIND} AS kind, {_WILSON} * (CASE {_KIND} WHEN 'agent' THEN 0.75 ELSE 0.9 END) * (CASE WHEN v % 3 = 0 THEN 0.9 ELSE 1.0 END) AS c, v % 5 = 0 AS adr, v % 7 = 0 AS human FROM sup)
SELECT source, kind, round(least(1.0, greatest(c, CASE WHEN adr THEN 0.95 ELSE 0 END, CASE WHEN human THEN 0.90 ELSE 0 END)), 6) AS confidence FROM c""")
def confidence_floors(t: Tables) -> DataFrame:
    kind = F.when(F.length("source") % 2 == 0, "agent").otherwise("auditor")
    v = F.col("violations")
    conf = scores.confidence(F.col("support"), v, kind, v % 3 == 0, v % 5 == 0, v % 7 == 0, 6)
    return _support(t).select("source", kind.alias("kind"), conf.alias("confidence"))


_CASES = """k AS (SELECT event_id, CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN 'candidate' WHEN 'click' THEN 'validated' WHEN 'purchase' THEN 'deprecated' ELSE 'rejected' END AS cur,
 CASE user_id % 4 WHEN 0 THEN 'adr' WHEN 1 THEN 'agent' WHEN 2 THEN 'human' ELSE 'auditor' END AS src, user_id % 5 AS support, round(least(1.0, value / 40), 2) AS conf, event_id % 3 = 0 AS red, event_id % 7 = 0 AS human, CASE WHEN event_id % 11 = 0 THEN 'superseded' END AS adr FROM events)"""


def _cases(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.select(
        "event_id",
        F.when(e == "signup", F.lit(None).cast("string")).when(e == "view", "candidate").when(e == "click", "validated").when(e == "purchase", "deprecated").otherwise("rejected").alias("cur"),
        F.get(F.array(F.lit("adr"), F.lit("agent"), F.lit("human"), F.lit("auditor")), (F.col("user_id") % 4).cast("int")).alias("src"),
        (F.col("user_id") % 5).alias("support"),
        F.round(F.least(F.lit(1.0), F.col("value") / 40), 2).alias("conf"),
        (F.col("event_id") % 3 == 0).alias("red"),
        (F.col("event_id") % 7 == 0).alias("human"),
        F.when(F.col("event_id") % 11 == 0, "superseded").alias("adr"),
    )


_PASS = "((src IN ('auditor', 'adr', 'human') OR red) AND conf >= 0.75 AND support >= 3)"


@query(f"""WITH {_CASES} SELECT event_id, CASE WHEN src = 'adr' AND adr IS NOT NULL THEN adr WHEN cur IN ('rejected', 'superseded') THEN cur
 WHEN cur IS NULL OR cur = 'candidate' THEN CASE WHEN {_PASS} THEN 'validated' ELSE 'candidate' END
 WHEN cur = 'validated' AND human THEN CASE WHEN support >= 3 THEN cur ELSE 'deprecated' END
 WHEN cur = 'validated' THEN CASE WHEN (src IN ('auditor', 'adr', 'human') OR red) AND NOT {_PASS} THEN 'deprecated' ELSE cur END
 WHEN cur = 'deprecated' AND ({_PASS} OR (human AND support >= 3)) THEN 'validated' ELSE cur END AS status FROM k""")
def status_policy(t: Tables) -> DataFrame:
    c = F.col
    return _cases(t).select("event_id", scores.decide_status(c("cur"), c("src"), c("adr"), c("support"), c("conf"), c("red"), c("human")).alias("status"))


_RULES = ", ".join(f"('{a}', '{b}', '{who}')" for (a, b), actors in scores.TRANSITIONS.items() for who in actors)
_MOVES = "m AS (SELECT event_id, user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"
_STATUS_OF = {"signup": "candidate", "view": "validated", "click": "deprecated", "purchase": "superseded", "error": "rejected"}
_AS_STATUS = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATUS_OF.items()) + " END"


@query(f"""WITH {_MOVES}, x AS (SELECT event_id, {_AS_STATUS.format(c='prev')} AS cur, {_AS_STATUS.format(c='event_type')} AS tgt, CASE user_id % 5 WHEN 0 THEN 'adr' WHEN 1 THEN 'agent' WHEN 2 THEN 'human' WHEN 3 THEN 'auditor' ELSE 'revalidation' END AS who, event_id % 2 = 0 AS red FROM m WHERE prev IS NOT NULL),
r(a, b, who) AS (VALUES {_RULES})
SELECT cur, tgt, who, count(*) AS n, count(*) FILTER (cur = tgt OR (EXISTS (SELECT 1 FROM r WHERE r.a = x.cur AND r.b = x.tgt AND r.who = x.who) AND NOT (x.who = 'agent' AND cur = 'candidate' AND tgt = 'validated' AND NOT red))) AS allowed FROM x GROUP BY 1, 2, 3""")
def transition_matrix(t: Tables) -> DataFrame:
    table = F.create_map(*[F.lit(v) for kv in _STATUS_OF.items() for v in kv])
    x = mining.replay(t.events, "user_id", ["ts", "event_id"], "event_type").where("before is not null")
    who = F.get(F.array(*map(F.lit, ("adr", "agent", "human", "auditor", "revalidation"))), (F.col("user_id") % 5).cast("int"))
    x = x.select(table[F.col("before")].alias("cur"), table[F.col("event_type")].alias("tgt"), who.alias("who"), (F.col("event_id") % 2 == 0).alias("red"))
    ok = scores.may_move(F.col("cur"), F.col("tgt"), F.col("who"), F.col("red"))
    return x.groupBy("cur", "tgt", "who").agg(F.count("*").alias("n"), F.count_if(ok).alias("allowed"))


_STEP = {"signup": "planning", "view": "in_progress", "click": "verifying", "purchase": "done", "error": "abandoned"}
_AS_STEP = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STEP.items()) + " END"
_STEPS = ", ".join(f"('{a}', '{b}')" for a, b in sorted(scores.FEATURE_STEPS))


@query(f"WITH {_MOVES} SELECT user_id, count(*) AS moves, count(*) FILTER (({_AS_STEP.format(c='prev')}, {_AS_STEP.format(c='event_type')}) IN ({_STEPS})) AS legal FROM m WHERE prev IS NOT NULL GROUP BY user_id")
def feature_state_machine(t: Tables) -> DataFrame:
    table = F.create_map(*[F.lit(v) for kv in _STEP.items() for v in kv])
    x = mining.replay(t.events, "user_id", ["ts", "event_id"], "event_type").where("before is not null")
    return x.groupBy("user_id").agg(F.count("*").alias("moves"), F.count_if(scores.feature_step(table[F.col("before")], table[F.col("event_type")])).alias("legal"))


@query("""SELECT d.source, count(*) AS evidence, count(*) FILTER (sha256(d.text) <> sha256(CASE WHEN d.doc_id % 9 = 0 THEN d.text || '!' ELSE d.text END)) AS stale, bool_and(d.doc_id % 9 = 0) AS deprecated FROM documents d GROUP BY d.source""")
def revalidate_stale(t: Tables) -> DataFrame:
    """Evidence re-hashed against its stored digest; a source all of whose evidence is stale is deprecated."""
    d = t.documents.select("source", F.sha2("text", 256).alias("now"), F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("stored"))
    return d.groupBy("source").agg(F.count("*").alias("evidence"), F.count_if(F.col("now") != F.col("stored")).alias("stale"), F.bool_and(F.col("now") != F.col("stored")).alias("deprecated"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-03' ORDER BY ts DESC, event_id DESC LIMIT 50")
def event_log_topk(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error' and ts >= timestamp_ntz'2024-01-03'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select("event_id", "user_id", "event_type")


@query("SELECT user_id, max(ts) AS at, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def last_run(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_ROLE_SQL = """f AS (SELECT p_partkey AS uid, unnest([CASE WHEN p_name LIKE '%bolt' THEN {'r': 'Service', 'w': 0.6} END, CASE WHEN p_type = 'SMALL' THEN {'r': 'Service', 'w': 0.3} END, CASE WHEN p_name LIKE '%gear' THEN {'r': 'Repository', 'w': 0.6} END,
 CASE WHEN p_size > 30 THEN {'r': 'Repository', 'w': 0.3} END, CASE WHEN p_type = 'ECONOMY' THEN {'r': 'Controller', 'w': 0.6} END, CASE WHEN p_brand = 'Brand#1' THEN {'r': 'Controller', 'w': 0.4} END, CASE WHEN p_name LIKE 'red%' THEN {'r': 'Model', 'w': 0.95} END]) AS h FROM part),
sc AS (SELECT uid, h.r AS role, CAST(sum(h.w) AS DOUBLE) AS score FROM f WHERE h IS NOT NULL GROUP BY 1, 2)"""


def _role_scores(t: Tables) -> DataFrame:
    c = F.col
    rules = [("Service", c("p_name").like("%bolt"), 0.6), ("Service", c("p_type") == "SMALL", 0.3), ("Repository", c("p_name").like("%gear"), 0.6), ("Repository", c("p_size") > 30, 0.3), ("Controller", c("p_type") == "ECONOMY", 0.6), ("Controller", c("p_brand") == "Brand#1", 0.4), ("Model", c("p_name").like("red%"), 0.95)]
    return mining.role_scores(t.part.withColumn("uid", c("p_partkey")), rules)


@query(f"WITH {_ROLE_SQL} SELECT uid, role, round(score, 6) AS score FROM sc")
def role_score(t: Tables) -> DataFrame:
    return _role_scores(t).withColumn("score", F.round("score", 6))


_DECIDED = "dc AS (SELECT uid, arg_max(role, (round(score, 6), role)) AS role, round(max(round(score, 6)), 2) AS score, string_agg(role, ',' ORDER BY role) AS roles FROM sc WHERE round(score, 6) >= 0.6 GROUP BY uid)"


@query(f"WITH {_ROLE_SQL}, {_DECIDED} SELECT * FROM dc")
def role_decide(t: Tables) -> DataFrame:
    return mining.decide_roles(_role_scores(t)).withColumn("roles", F.array_join("roles", ","))


_RE = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
re AS (SELECT src, dst, s.role AS sr, d.role AS dr FROM e JOIN dc s ON s.uid = src JOIN dc d ON d.uid = dst)"""


def _role_edges(t: Tables) -> DataFrame:
    from lodegraph.plans.graph_queries import part_edges

    r = mining.decide_roles(_role_scores(t)).select("uid", "role")
    e = part_edges(t).select("src", "dst").distinct()
    return e.join(r.select(F.col("uid").alias("src"), F.col("role").alias("src_role")), "src").join(r.select(F.col("uid").alias("dst"), F.col("role").alias("dst_role")), "dst")


@query(f"WITH {_ROLE_SQL}, {_DECIDED}, {_RE} SELECT src AS uid, CASE WHEN bool_or(dr IN ('Repository', 'Model')) THEN 'violation' WHEN bool_or(dr = 'Service') THEN 'support' ELSE 'none' END AS verdict FROM re WHERE sr = 'Controller' GROUP BY src")
def pattern_layered(t: Tables) -> DataFrame:
    return mining.layered(_role_edges(t), "Controller", "Service", ["Repository", "Model"])


@query(f"WITH {_ROLE_SQL}, {_DECIDED}, {_RE} SELECT DISTINCT src AS violator, dst AS target FROM re WHERE sr = 'Controller' AND dr = 'Model'")
def rule_forbid(t: Tables) -> DataFrame:
    return mining.forbid_dependency(_role_edges(t), "Controller", ["Model"])


@query(f"WITH {_ROLE_SQL}, {_DECIDED}, {_RE} SELECT DISTINCT src AS violator, dst AS target FROM re WHERE dr = 'Model' AND sr <> 'Repository'")
def rule_restrict(t: Tables) -> DataFrame:
    return mining.restrict_access(_role_edges(t), "Model", ["Repository"])


_PATHS = "pn AS (SELECT p_partkey AS uid, 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.ts' AS path FROM part)"


@query(f"WITH {_ROLE_SQL}, {_DECIDED}, {_PATHS} SELECT uid AS violator, path AS target FROM dc JOIN pn USING (uid) WHERE role = 'Controller' AND NOT regexp_matches(path, '^src/economy/[^/]*_(ring|bolt)\\.ts$')")
def rule_placement(t: Tables) -> DataFrame:
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".ts"))
    nodes = mining.decide_roles(_role_scores(t)).join(t.part.select(F.col("p_partkey").alias("uid"), path.alias("path")), "uid")
    return mining.placement(nodes, "Controller", ["src/economy/*_ring.ts", "src/economy/*_bolt.ts"])


@query("SELECT p_type AS category, min(CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'one' ELSE p_brand END) AS library, count(*) AS n FROM part GROUP BY p_type HAVING count(DISTINCT CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'one' ELSE p_brand END) = 1")
def rule_single_library(t: Tables) -> DataFrame:
    library = F.concat_ws("|", "p_type", F.when(F.col("p_type").isin("SMALL", "LARGE"), "one").otherwise(F.col("p_brand")))
    uses = t.part.select(F.col("p_partkey").alias("uid"), library.alias("library"))
    categories = t.part.select(library.alias("library"), F.col("p_type").alias("category")).distinct()
    return mining.single_choice(uses, categories).withColumn("library", F.substring_index("library", "|", -1))


@query("""WITH c AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2) SELECT p_brand, arg_max(p_name, (n, -first)) AS p_name, max(n) AS n FROM c GROUP BY 1""")
def mode_first_seen(t: Tables) -> DataFrame:
    return mining.mode_by(t.part, "p_brand", "p_name", "p_partkey")


@query("""WITH m AS (SELECT p_brand, string_split(p_name, ' ')[2] AS suffix, p_type FROM part), top AS (SELECT p_brand, arg_max(p_type, (n, p_type)) AS dir FROM (SELECT p_brand, p_type, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1)
SELECT p_brand, dir, count(*) FILTER (p_type = dir AND suffix = 'bolt') AS support, count(*) FILTER (NOT (p_type = dir AND suffix = 'bolt')) AS violations FROM m JOIN top USING (p_brand) GROUP BY 1, 2""")
def pattern_naming(t: Tables) -> DataFrame:
    m = t.part.select("p_brand", F.get(F.split("p_name", " "), F.lit(1)).alias("suffix"), "p_type")
    counts = m.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    top = counts.groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("dir"))
    ok = (F.col("p_type") == F.col("dir")) & (F.col("suffix") == "bolt")
    return mining.support(m.join(top, "p_brand"), ["p_brand", "dir"], ok, ~ok)


@query("""WITH s AS (SELECT user_id AS uid, CASE WHEN regexp_matches(event_type, '^(sign|create)') THEN 'create' WHEN regexp_matches(event_type, '^(vi|read)') THEN 'read' WHEN regexp_matches(event_type, '^(cl|use)') THEN 'use' WHEN regexp_matches(event_type, '^(pur|close)') THEN 'close' END AS stage FROM events)
SELECT uid, count(DISTINCT stage) AS n_stages, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM s WHERE stage IS NOT NULL GROUP BY uid HAVING count(DISTINCT stage) >= 3""")
def pattern_lifecycle(t: Tables) -> DataFrame:
    methods = t.events.select(F.col("user_id").alias("uid"), F.col("event_type").alias("method"))
    return mining.lifecycle_owners(methods, {"create": ("sign", "create"), "read": ("vi", "read"), "use": ("cl", "use"), "close": ("pur", "close")})


@query("""SELECT l_suppkey AS uid, count(*) FILTER (l_returnflag <> 'R') AS support, count(*) FILTER (l_returnflag = 'R') AS violations, CASE WHEN bool_or(l_returnflag = 'R') THEN 'violation' ELSE 'support' END AS verdict FROM lineitem GROUP BY 1""")
def pattern_injection(t: Tables) -> DataFrame:
    new = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy(F.col("l_suppkey").alias("uid")).agg(F.count_if(~new).alias("support"), F.count_if(new).alias("violations"), F.when(F.bool_or(new), "violation").otherwise("support").alias("verdict"))


@query(f"""WITH x AS (SELECT 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.ts' AS path, CAST(l_quantity AS BIGINT) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT CAST(sum(lines) FILTER (NOT regexp_matches(path, '^src/(?:.*/)?[^/]*_bolt\\.ts$|^src/small/.*$')) AS BIGINT) AS outside, round(sum(lines) FILTER (NOT regexp_matches(path, '^src/(?:.*/)?[^/]*_bolt\\.ts$|^src/small/.*$')) / sum(lines), 6) AS share,
 sum(lines) FILTER (NOT regexp_matches(path, '^src/(?:.*/)?[^/]*_bolt\\.ts$|^src/small/.*$')) / sum(lines) > 0.3 AS fails FROM x""")
def guard_scope_ratio(t: Tables) -> DataFrame:
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".ts"))
    files = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(path.alias("path"), F.col("l_quantity").cast("long").alias("lines"))
    return mining.out_of_scope(files, ["src/**/*_bolt.ts", "src/small/**"]).withColumn("share", F.round("share", 6))


@query("""WITH f AS (SELECT event_id AS finding, user_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'warn' ELSE 'info' END AS level FROM events), w AS (SELECT event_id AS finding FROM events WHERE event_id % 2 = 0),
x AS (SELECT f.*, w.finding IS NOT NULL AS waived FROM f LEFT JOIN w USING (finding))
SELECT user_id, CASE WHEN count(*) FILTER (level = 'fail' AND NOT waived) > 0 THEN 'fail' WHEN count(*) FILTER (level = 'warn' OR (level = 'fail' AND waived)) > 0 THEN 'warn' ELSE 'pass' END AS status,
 count(*) FILTER (level = 'fail' AND NOT waived) AS n_fail, count(*) FILTER (level = 'warn' OR (level = 'fail' AND waived)) AS n_warn, count(*) FILTER (waived) AS n_waived FROM x GROUP BY user_id""")
def guard_report(t: Tables) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "warn").otherwise("info")
    findings = t.events.select(F.col("event_id").alias("finding"), "user_id", level.alias("level"))
    return mining.report(findings, findings.where("finding % 2 = 0"), "user_id")


@query("""SELECT doc_id, CASE WHEN stored IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM (SELECT d.doc_id, s.stored, sha256(d.text) AS now FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '0' ELSE sha256(text) END AS stored FROM documents WHERE doc_id % 17 <> 0) s USING (doc_id)) WHERE stored IS NULL OR stored <> now""")
def evidence_verify(t: Tables) -> DataFrame:
    """A manifest of digests against the files' own: what is missing or has changed."""
    manifest = t.documents.where("doc_id % 17 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, "0").otherwise(F.sha2("text", 256)).alias("stored"))
    x = t.documents.select("doc_id", F.sha2("text", 256).alias("now")).join(manifest, "doc_id", "left")
    return x.where("stored is null or stored <> now").select("doc_id", F.when(F.col("stored").isNull(), "missing").otherwise("changed").alias("problem"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def stats_histogram(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def first_evidence(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return graph.top_per(rows, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3).drop("l_extendedprice")
