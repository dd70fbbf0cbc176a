"""Reuse, roles, detectors and guardrails on the driver tables: parts as symbols of a code base, their types as roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import guardrails, mining, reuse
from lodegraph.plans.graph_queries import EDGES, part_edges
from lodegraph.plans.registry import Tables, query
from lodegraph.plans.text_queries import _SINGULAR

_SUFFIX = (" service", " mailer", "_repo", "Client", "s", " otp code", "", "Worker")
_METHODS = ("create", "issueToken", "verify", "fetchAll", "burn", "revoke", "notifyUser", "save", "searchAll", "frobnicate")
_ROLES = {"STANDARD": "Service", "LARGE": "Repository", "ECONOMY": "Controller", "MEDIUM": "Route", "PROMO": "Model", "SMALL": "Validator"}
_KINDS = ("class", "function", "method")
_DEPS = ("zod", "joi", "axios", "express", "left-pad", "pytest", "redux", "knex", "got")


def _pick(values: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({at} AS BIGINT) % {len(values)} + 1]"


#: Symbols in SQL; `symbols` is the same in Spark.
SYM = f"""sym AS (SELECT p_partkey AS uid, p_name || {_pick(_SUFFIX, 'p_partkey')} AS name, {_pick(_KINDS, 'p_size')} AS kind,
 CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROLES.items())} END AS role, p_size AS loc, p_retailprice > 1000 AS exported, p_partkey % 2 = 0 AS validated,
 'src/' || lower(p_type) || '/' || p_partkey || '.ts' AS path, [{_pick(_METHODS, 'p_partkey')}, {_pick(_METHODS, 'p_size')}, {_pick(_METHODS, 'p_partkey // 7')}] AS methods FROM part)"""


def symbols(t: Tables) -> DataFrame:
    at = lambda values, i: F.get(F.array(*map(F.lit, values)), F.pmod(i, F.lit(len(values))).cast("int"))
    role = F.try_element_at(F.create_map(*[F.lit(x) for kv in _ROLES.items() for x in kv]), F.col("p_type"))
    key, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        key.alias("uid"),
        F.concat("p_name", at(_SUFFIX, key)).alias("name"),
        at(_KINDS, size).alias("kind"),
        F.array(role).alias("roles"),
        role.alias("role"),
        size.alias("loc"),
        (F.col("p_retailprice") > 1000).alias("exported"),
        (key % 2 == 0).alias("validated"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), key.cast("string"), F.lit(".ts")).alias("path"),
        F.array(at(_METHODS, key), at(_METHODS, size), at(_METHODS, F.floor(key / 7))).alias("methods"),
        size.alias("line_start"),
    )


_SYN = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in reuse.NAME_SYNONYMS.items()) + " ELSE w END"
_SING = f"(SELECT list_distinct(list_transform(list_transform(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({{x}}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {_SINGULAR}), lambda w: {_SYN})))"
_ROLE_LIST = "[" + ", ".join(f"'{w}'" for w in reuse.ROLE_WORDS) + "]"
_CORE = f"(CASE WHEN len(list_filter({{m}}, lambda w: NOT list_contains({_ROLE_LIST}, w))) > 0 THEN list_filter({{m}}, lambda w: NOT list_contains({_ROLE_LIST}, w)) ELSE {{m}} END)"
_MEANT = f"meant AS (SELECT *, {_SING.format(x='name')} AS m FROM sym), cored AS (SELECT *, {_CORE.format(m='m')} AS core FROM meant)"


@query(f"WITH {SYM}, {_MEANT} SELECT uid, array_to_string(list_sort(core), ' ') AS core FROM cored")
def reuse_core_tokens(t: Tables) -> DataFrame:
    return symbols(t).select("uid", F.array_join(F.array_sort(reuse.core_tokens(F.col("name"))), " ").alias("core"))


_VERB = "CASE " + " ".join(f"WHEN regexp_matches(head, '^({'|'.join(g)})') THEN '{v}'" for v, g in reuse.VERBS.items()) + " ELSE head END"
_HEADS = "(SELECT uid, unnest(methods) AS method FROM sym)"
_VERBED = f"verbed AS (SELECT uid, method, {_VERB} AS verb FROM (SELECT *, list_filter(string_split_regex(lower(regexp_replace(method, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')[1] AS head FROM {_HEADS}))"


@query(f"WITH {SYM}, {_VERBED} SELECT verb, count(*) AS n, count(DISTINCT uid) AS n_symbols FROM verbed GROUP BY verb")
def reuse_verbs(t: Tables) -> DataFrame:
    x = symbols(t).select("uid", F.explode("methods").alias("method")).withColumn("verb", reuse.normal_verb(F.col("method")))
    return x.groupBy("verb").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("n_symbols"))


@query(f"""WITH {SYM}, {_VERBED}, vs AS (SELECT uid, list(DISTINCT verb) AS vs FROM verbed GROUP BY uid), b AS (SELECT uid, verb FROM verbed WHERE uid IN (SELECT uid FROM sym WHERE kind = 'class')),
p AS (SELECT DISTINCT q.uid AS proposal, b.uid FROM verbed q JOIN b ON q.verb = b.verb WHERE q.uid % 50 = 0 AND q.uid <> b.uid)
SELECT proposal, p.uid, round(greatest(len(list_intersect(x.vs, y.vs)) / len(x.vs), len(list_intersect(x.vs, y.vs)) / len(list_distinct(list_concat(x.vs, y.vs)))), 3) AS overlap
FROM p JOIN vs x ON x.uid = proposal JOIN vs y ON y.uid = p.uid""")
def reuse_method_overlap(t: Tables) -> DataFrame:
    """Every 50th symbol against classes that share a verb."""
    s = symbols(t).select("uid", "kind", "methods")
    return reuse.verb_sharers(s.where("uid % 50 = 0"), s.where("kind = 'class'"))


_PAIRS = f"""words AS (SELECT uid, unnest(core) AS w FROM cored), pairs AS (SELECT DISTINCT q.uid AS proposal, b.uid FROM words q JOIN words b ON q.w = b.w WHERE q.uid % 50 = 0),
vs AS (SELECT uid, list(DISTINCT verb) AS vs FROM verbed GROUP BY uid), fans AS (SELECT l_partkey AS uid, count(DISTINCT l_suppkey) AS fan FROM lineitem GROUP BY 1),
verb_pairs AS (SELECT z.proposal, z.uid FROM (SELECT q.uid AS proposal, b.uid, count(*) AS k FROM (SELECT uid, unnest(vs) AS v FROM vs WHERE uid % 50 = 0) q JOIN (SELECT uid, unnest(vs) AS v FROM vs WHERE uid IN (SELECT uid FROM sym WHERE kind = 'class')) b ON q.v = b.v GROUP BY 1, 2) z JOIN vs x ON x.uid = z.proposal JOIN vs y ON y.uid = z.uid WHERE greatest(k / len(x.vs), k / (len(x.vs) + len(y.vs) - k)) >= 0.5),
cand AS (SELECT p.proposal, b.uid, a.core AS ca, b.core AS cb, b.name, a.role AS ra, b.role AS rb FROM (SELECT * FROM pairs UNION SELECT * FROM verb_pairs) p JOIN cored a ON a.uid = p.proposal JOIN cored b ON b.uid = p.uid WHERE a.name <> b.name AND b.role NOT IN ('Route', 'Model')),
feat AS (SELECT proposal, c.uid, name, round(greatest(len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))), 0.9 * len(list_intersect(ca, cb)) / len(cb), 0.8 * len(list_intersect(ca, cb)) / len(cb)), 3) AS n,
 round(greatest(len(list_intersect(x.vs, y.vs)) / len(x.vs), len(list_intersect(x.vs, y.vs)) / len(list_distinct(list_concat(x.vs, y.vs)))), 3) AS m,
 round(least(1, log2(1 + coalesce(fan, 0)) / log2(9)), 3) AS f, CASE WHEN ra = rb THEN 1 ELSE 0 END AS r FROM cand c JOIN vs x ON x.uid = proposal JOIN vs y ON y.uid = c.uid LEFT JOIN fans ON fans.uid = c.uid),
scored AS (SELECT proposal, uid, name, n, m, f, round(0.25 * n + 0.25 * m + 0.1 * f + 0.05 * r, 3) AS score FROM feat)"""


def _found(t: Tables) -> DataFrame:
    users = t.lineitem.groupBy(F.col("l_partkey").alias("uid")).agg(F.count_distinct("l_suppkey").alias("fan_in"))
    s = symbols(t).join(users, "uid", "left").withColumn("validated_pattern", F.lit(False))
    p = s.where("uid % 50 = 0").select("uid", "name", F.lit(None).cast("string").alias("description"), "methods", "role")
    return reuse.find(p, s)


@query(f"""WITH {SYM}, {_MEANT}, {_VERBED}, {_PAIRS}
SELECT proposal, uid AS candidate, CAST(rank AS INTEGER) AS rank, n AS name_score, m AS method_score, f AS maturity, score, CASE WHEN score >= 0.7 THEN 'reuse' WHEN score >= 0.5 THEN 'extend' ELSE 'new_ok' END AS verdict
FROM (SELECT *, row_number() OVER (PARTITION BY proposal ORDER BY score DESC, name, uid) AS rank FROM scored) WHERE rank <= 5""")
def reuse_verdict(t: Tables) -> DataFrame:
    """Every 50th symbol as a proposal: candidates by shared tokens and verbs, the six features, and the five best."""
    return _found(t).select("proposal", F.col("uid").alias("candidate"), "rank", F.col("f_name").alias("name_score"), F.col("f_methods").alias("method_score"), F.col("f_maturity").alias("maturity"), "score", "verdict")


_LAST = "list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')[-1]"


@query(f"""WITH {SYM}, l AS (SELECT uid, {_LAST} AS w FROM sym), s AS (SELECT uid, {_SINGULAR} AS w FROM l)
SELECT uid, CASE w {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in reuse.ROLE_SUFFIXES.items())} END AS role FROM s""")
def reuse_inferred_role(t: Tables) -> DataFrame:
    return symbols(t).select("uid", reuse.inferred_role(F.col("name")).alias("role"))


@query(f"""WITH {SYM}, {_VERBED} SELECT s.uid, CASE WHEN (SELECT count(DISTINCT verb) FROM verbed v WHERE v.uid = s.uid AND verb IN ('create', 'validate', 'consume', 'expire')) >= 3
 THEN array_to_string(s.methods, ' → ') END AS lifecycle FROM sym s""")
def reuse_lifecycle_text(t: Tables) -> DataFrame:
    return symbols(t).select("uid", reuse.lifecycle_text(F.lit(None).cast("string"), F.col("methods")).alias("lifecycle"))


@query("""SELECT l_partkey AS uid, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS used_by, list_sort(list(DISTINCT l_returnflag) FILTER (WHERE l_linestatus = 'O')) AS patterns
FROM lineitem GROUP BY 1""")
def reuse_enrichment(t: Tables) -> DataFrame:
    key = t.lineitem.select(F.col("l_partkey").alias("uid"), F.col("l_suppkey").cast("string").alias("user"), F.col("l_returnflag").alias("title"), F.when(F.col("l_linestatus") == "O", "validated").otherwise("rejected").alias("status"))
    out = reuse.enriched(key.select("uid").distinct(), key.select("uid", "user"), key.select("uid", "title", "status"), key.where("false").select("uid", "title"))
    return out.select("uid", "used_by", F.when(F.size("patterns") > 0, F.col("patterns")).alias("patterns"))


_REACH = f"""e2 AS (SELECT DISTINCT src, dst FROM e)"""


@query(f"""WITH {SYM}, {EDGES}, {_REACH}
SELECT 'reuse-controller-loc-' || name AS id, uid FROM sym WHERE role IN ('Controller', 'Route') AND kind IN ('function', 'method') AND loc > 25
UNION ALL SELECT 'reuse-unexported-service-' || name, uid FROM sym WHERE role = 'Service' AND kind = 'class' AND NOT exported
UNION ALL SELECT 'reuse-layering-' || a.name || '-' || b.name, a.uid FROM sym a JOIN e2 ON e2.src = a.uid JOIN sym b ON b.uid = e2.dst WHERE a.role = 'Controller' AND b.role IN ('Repository', 'Model')""")
def guard_reusability(t: Tables) -> DataFrame:
    s = symbols(t)
    return guardrails.reusability(s, part_edges(t), s).select("id", F.regexp_extract("path", r"/(\d+)\.ts$", 1).cast("long").alias("uid"))


@query(f"""WITH {SYM} SELECT 'const-route-unvalidated-' || name AS id, path FROM sym WHERE role = 'Route' AND NOT validated
UNION ALL SELECT 'const-service-naming-' || name, path FROM sym WHERE role = 'Service' AND kind = 'class' AND name NOT LIKE '%Service'
UNION ALL SELECT 'const-repo-naming-' || name, path FROM sym WHERE role = 'Repository' AND kind = 'class' AND name NOT LIKE '%Repository' AND name NOT LIKE '%Repo'""")
def guard_consistency(t: Tables) -> DataFrame:
    return guardrails.consistency(symbols(t)).select("id", "path")


@query(f"""WITH {SYM}, own AS (SELECT * FROM sym WHERE kind IN ('class', 'function')) SELECT 'abs-undeclared-' || name AS id, path FROM own WHERE name NOT IN (SELECT name FROM sym WHERE loc > 40)
UNION ALL SELECT 'abs-count-limit', NULL FROM own HAVING count(*) > 3""")
def guard_abstraction(t: Tables) -> DataFrame:
    s = symbols(t)
    return guardrails.abstraction(s, s.where("loc > 40").select("name")).select("id", "path")


@query(f"""WITH {SYM}, {_MEANT}, {_VERBED}, {_PAIRS}, best AS (SELECT proposal, max(score) AS score FROM scored GROUP BY 1 HAVING max(score) >= 0.7)
SELECT 'dup-' || s.name AS id, CASE WHEN s.loc > 40 THEN 'warn' ELSE 'fail' END AS severity FROM best JOIN sym s ON s.uid = proposal WHERE s.kind IN ('class', 'function')""")
def guard_duplication(t: Tables) -> DataFrame:
    """Every 50th symbol as an addition, held against all others; those over 40 lines have a reason in the plan."""
    s = symbols(t)
    best = _found(t).where("rank = 1").select(F.col("proposal").alias("uid"), F.col("name").alias("top"), "score")
    plan = s.where("uid % 50 = 0 and loc > 40").select("name", F.lit("planned").alias("justification"))
    return guardrails.duplication(s.where("uid % 50 = 0"), best, plan).select("id", "severity")


@query(f"""WITH {SYM}, {EDGES}, bad AS (SELECT DISTINCT src AS violator, dst AS target FROM e JOIN sym a ON a.uid = src JOIN sym b ON b.uid = dst WHERE a.role = 'Controller' AND b.role IN ('Repository', 'Model')),
d AS (SELECT uid FROM sym WHERE loc > 45) SELECT 'arch-layers-' || violator || '-' || target AS id FROM bad WHERE violator IN (SELECT uid FROM d) OR target IN (SELECT uid FROM d)""")
def guard_architecture(t: Tables) -> DataFrame:
    s = symbols(t)
    roles = s.select("uid", "role")
    edges = part_edges(t).join(roles.toDF("src", "src_role"), "src").join(roles.toDF("dst", "dst_role"), "dst")
    bad = mining.forbid_dependency(edges, "Controller", ["Repository", "Model"]).select(F.lit("layers").alias("constraint"), F.lit("no direct data access").alias("title"), F.lit("error").alias("severity"), "violator", "target")
    return guardrails.architecture(bad, s.where("loc > 45")).select("id")


_CATS = ", ".join(f"('{c}', '{p}')" for c, ps in guardrails.CATEGORIES.items() for p in ps)


@query(f"""WITH cat(c, dep) AS (VALUES {_CATS}), deps AS (SELECT DISTINCT {_pick(_DEPS, 'p_size')} AS dep, p_brand AS brand FROM part),
old AS (SELECT brand, dep FROM deps WHERE dep IN ('zod', 'axios')), served AS (SELECT DISTINCT brand, c FROM old JOIN cat USING (dep))
SELECT d.brand, d.dep, CASE WHEN dep = 'left-pad' THEN 'fail' WHEN s.c IS NOT NULL AND d.dep NOT IN (SELECT dep FROM old o WHERE o.brand = d.brand) THEN 'fail' ELSE 'warn' END AS severity
FROM deps d LEFT JOIN cat USING (dep) LEFT JOIN served s ON s.brand = d.brand AND s.c = cat.c WHERE d.brand = 'Brand#4'""")
def guard_complexity(t: Tables) -> DataFrame:
    """The dependencies of one project (a brand) as new ones, of which two are known already."""
    at = F.get(F.array(*map(F.lit, _DEPS)), F.pmod(F.col("p_size"), F.lit(len(_DEPS))).cast("int"))
    own = t.part.where("p_brand = 'Brand#4'").select(at.alias("dep"), F.col("p_brand").alias("manifest")).distinct()
    bans = t.spark.createDataFrame([("left-pad", "none of it")], "dep string, title string")
    files = t.part.where("false").select(F.col("p_name").alias("path"), F.col("p_type").alias("status"))
    out = guardrails.complexity(own, own.where("dep in ('zod', 'axios')").select("dep"), bans, files)
    return out.select(F.col("path").alias("brand"), F.regexp_replace("id", "^complex-dep-", "").alias("dep"), "severity")


@query("""WITH r AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE n_chars % 50 END AS now, n_chars % 40 AS before, CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS code FROM documents)
SELECT 'reg-exit-' || doc_id AS id FROM r WHERE code <> 0 UNION ALL SELECT 'reg-count-' || doc_id FROM r WHERE now < before""")
def guard_regression(t: Tables) -> DataFrame:
    """Each document stands for a test run: its output tells a count, or none."""
    d = t.documents.select(F.col("doc_id").cast("string").alias("name"), (F.col("n_chars") % 7 == 0).cast("int").alias("exit_code"), F.when(F.col("n_chars") % 3 != 0, F.concat(F.lit("ran: "), (F.col("n_chars") % 50).cast("string"), F.lit(" passed"))).otherwise("nothing").alias("output"), (F.col("n_chars") % 40).alias("tests"))
    return guardrails.regression(d, d.select("name", "tests")).select("id")


@query(f"""WITH {SYM} SELECT CAST(1 AS BIGINT) AS duplicate_abstractions, CAST(0 AS BIGINT) AS constraint_violations, CAST(0 AS BIGINT) AS new_dependencies, CAST(0 AS BIGINT) AS out_of_scope_files, count(*) AS total_findings,
 (SELECT CAST(sum(l_linenumber) AS BIGINT) FROM lineitem) AS lines_added, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS lines_deleted FROM sym WHERE kind = 'class'""")
def guard_metrics(t: Tables) -> DataFrame:
    f = symbols(t).where("kind = 'class'").select(F.lit("duplication").alias("check"), F.lit("fail").alias("severity"), (F.col("uid") % 2 == 0).alias("waived"))
    return guardrails.run_metrics(f, t.lineitem.select(F.col("l_linenumber").alias("added"), (F.col("l_returnflag") == "R").cast("int").alias("deleted")))


@query(f"""WITH {SYM}, p AS (SELECT uid, kind, CASE WHEN name LIKE '%Worker' THEN 0.6 ELSE 0 END AS worker, CASE WHEN name LIKE '%Client' THEN 0.5 ELSE 0 END AS integration FROM sym)
SELECT uid, CASE WHEN worker >= 0.6 THEN 'Worker' END AS role, CAST(worker AS DOUBLE) AS score FROM p WHERE kind <> 'method' AND worker >= 0.6""")
def role_local(t: Tables) -> DataFrame:
    none = lambda n, kind: F.lit(None).cast(kind).alias(n)
    s = symbols(t).select("uid", "name", "kind", "path", none("parent", "string"), none("decorators", "array<string>"), none("table", "string"), none("validator", "string"), none("returns_jsx", "boolean"), none("signature", "string"), F.array(F.lit("axios")).alias("external_imports"))
    return mining.decide_roles(mining.local_role_scores(s)).select("uid", "role", "score")


@query(f"""WITH {SYM}, {EDGES}, v AS (SELECT uid, lower(kind) AS validator FROM sym WHERE role = 'Validator'), lib AS (SELECT validator FROM v GROUP BY 1 ORDER BY count(*) DESC, min(uid) LIMIT 1)
SELECT uid, CASE WHEN validated OR uid IN (SELECT src FROM e WHERE dst IN (SELECT uid FROM v)) THEN 'support' ELSE 'violation' END AS verdict, (SELECT validator FROM lib) AS library FROM sym WHERE role = 'Route' AND kind <> 'method'""")
def pattern_route_validation(t: Tables) -> DataFrame:
    s = symbols(t)
    routes = s.where("role = 'Route'").select("uid", F.when(F.col("kind") != "method", "post").otherwise("get").alias("http_method"), "validated")
    return mining.route_validation(routes, part_edges(t), s.where("role = 'Validator'").select("uid", F.lower("kind").alias("validator")))


@query(f"""WITH {SYM}, {EDGES}, e2 AS (SELECT DISTINCT src, dst FROM e WHERE rel = 'USES'), base AS (SELECT dst FROM e2 WHERE dst IN (SELECT uid FROM sym) GROUP BY 1 HAVING count(*) >= 2 ORDER BY count(*) DESC, dst LIMIT 1)
SELECT uid, CASE WHEN EXISTS (SELECT 1 FROM e2 WHERE src = uid AND e2.dst = base.dst) THEN 'support' ELSE 'violation' END AS verdict, base.dst AS base FROM sym, base WHERE kind = 'class' AND uid <> base.dst""")
def pattern_error_base(t: Tables) -> DataFrame:
    s = symbols(t).withColumn("name", F.concat("name", F.lit("Error")))
    return mining.error_base(s, part_edges(t).where("rel = 'USES'").select("src", "dst").distinct())


@query(f"""WITH {SYM}, f AS (SELECT uid, path, CASE WHEN role = 'Service' THEN 'tests-dir' ELSE 'co-located' END AS layout FROM sym WHERE kind = 'method'), u AS (SELECT layout FROM f GROUP BY 1 ORDER BY count(*) DESC, min(CASE WHEN layout = 'tests-dir' THEN 'tests/' || path ELSE path END) LIMIT 1)
SELECT f.uid, CASE WHEN f.layout = u.layout THEN 'support' ELSE 'violation' END AS verdict, u.layout, 'pytest' AS framework FROM f, u""")
def pattern_test_layout(t: Tables) -> DataFrame:
    path = F.when(F.col("role") == "Service", F.concat(F.lit("tests/"), "path")).otherwise(F.col("path"))
    return mining.test_layout(symbols(t).select("uid", path.alias("path"), (F.col("kind") == "method").alias("is_test"), F.array(F.lit("pytest"), F.lit("x")).alias("external_imports")))


@query(f"""WITH {SYM}, {EDGES}, st(m, stage) AS (VALUES ('create', 'create'), ('issueToken', 'create'), ('verify', 'validate'), ('burn', 'consume'), ('revoke', 'expire')),
c AS (SELECT uid, count(DISTINCT stage) AS k FROM (SELECT uid, unnest(methods) AS m FROM sym) JOIN st USING (m) GROUP BY 1), o AS (SELECT uid FROM c WHERE k >= 3)
SELECT uid AS owner, uid, 'owner' AS part FROM o UNION ALL SELECT DISTINCT dst, src, 'user' FROM e WHERE dst IN (SELECT uid FROM o) AND src IN (SELECT uid FROM sym)
UNION ALL SELECT o.uid, c.uid, 'rival' FROM c, o WHERE c.k >= 2 AND c.uid <> o.uid AND c.uid IN (SELECT uid FROM sym WHERE kind = 'class') AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.uid AND e.dst = o.uid)""")
def pattern_lifecycle_roles(t: Tables) -> DataFrame:
    s = symbols(t).select("uid", F.when(F.col("kind") == "class", "tokens").otherwise("other").alias("name"), "methods")
    return mining.lifecycle_roles(s, part_edges(t), "token")


@query(f"""WITH {SYM}, {EDGES} SELECT src AS uid, CASE WHEN bool_or(a.role = 'Repository') THEN 'support' ELSE 'violation' END AS verdict FROM e JOIN sym a ON a.uid = src JOIN sym b ON b.uid = dst WHERE b.role = 'Model' AND rel = 'ACCESSES' GROUP BY 1""")
def pattern_data_access(t: Tables) -> DataFrame:
    roles = symbols(t).select("uid", "role")
    return mining.data_access(part_edges(t).where("rel = 'ACCESSES'").join(roles.toDF("src", "src_role"), "src").join(roles.toDF("dst", "dst_role"), "dst"))
