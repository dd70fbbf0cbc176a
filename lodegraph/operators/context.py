"""Context of a request: what its words mean, which symbols, knowledge, tests, features and decisions concern it, and what
a change would touch.

nodes: uid, name, kind, path, parent, roles, qualname. edges: src, rel, dst. Members are HAS_MEMBER edges from a class.
Empty tables give empty results; rows of one node that repeat count once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import identifiers, query_terms
from lodegraph.operators.graph import dependents, reach, undirected

#: Words that say nothing of what a request is about, groups of words of one domain, and ranks of kinds.
STOP_WORDS = ("a", "an", "the", "to", "for", "of", "and", "or", "in", "on", "with", "by", "from", "into", "that", "this", "add", "adding", "implement", "implementing", "build", "support", "feature", "new", "make", "allow", "let", "lets", "can", "should", "we", "our", "their", "them", "they", "it", "its", "be", "is", "are", "when", "so", "want", "need", "please", "how", "what", "which", "where", "does", "do", "change", "update", "fix", "some", "via", "use", "using", "able", "also", "all", "any", "each", "per", "who", "about")
SYNONYMS = (
    ("invitation", "invite", "token", "email"),
    ("token", "code", "otp", "nonce"),
    ("email", "mail", "notification", "smtp", "template"),
    ("team", "org", "organization", "workspace", "group", "member"),
    ("user", "account", "member", "profile"),
    ("password", "reset", "credential"),
    ("verification", "verify", "confirm"),
    ("login", "signin", "auth", "authentication", "session", "register", "signup"),
    ("permission", "role", "authorization", "access"),
    ("payment", "billing", "invoice", "charge", "subscription"),
    ("queue", "job", "worker", "background"),
    ("cache", "redis"),
    ("validation", "validate", "schema", "zod"),
    ("error", "exception", "failure"),
    ("database", "db", "table", "model", "repository", "persistence", "storage"),
    ("expire", "expiry", "expiration", "ttl"),
)
KIND_RANK = {"class": 0, "function": 1, "route": 2, "const": 3, "method": 4}
NEAR = ("USES", "CALLS", "ACCESSES", "HANDLES")
# end of fixed values


def synonym_groups(spark: SparkSession, extra: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """grp, words: the groups, and a project's own after them."""
    return spark.createDataFrame([(i, sorted(set(g))) for i, g in enumerate(SYNONYMS + tuple(extra))], "grp int, words array<string>")


def understand(request: Column, groups: tuple[tuple[str, ...], ...] = SYNONYMS) -> Column:
    """struct(terms, identifiers, expanded): singular words in order without stop words, camel-case names, and, group by
    group, the other words of groups that a term belongs to. Groups are a constant: no join."""
    terms = query_terms(request, STOP_WORDS)
    members = F.array(*[F.array(*map(F.lit, sorted(set(g)))) for g in groups])
    others = F.flatten(F.transform(F.filter(members, lambda g: F.arrays_overlap(g, terms)), lambda g: F.array_except(g, terms)))
    return F.struct(terms.alias("terms"), identifiers(request).alias("identifiers"), F.array_distinct(others).alias("expanded"))


def members(edges: DataFrame) -> DataFrame:
    return edges.where("rel = 'HAS_MEMBER'").select(F.col("src").alias("owner"), F.col("dst").alias("member")).distinct()


def parts(uids: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, part: each uid itself, and its members."""
    own = uids.select("uid").distinct()
    return own.select("uid", F.col("uid").alias("part")).union(own.join(members(edges), F.col("uid") == F.col("owner")).select("uid", F.col("member").alias("part")))


def rolled_up(rows: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """`column` replaced by its class where it is a member."""
    m = members(edges).groupBy(F.col("member").alias("_m")).agg(F.min("owner").alias("_o"))
    return rows.join(m, F.col(column) == F.col("_m"), "left").withColumn(column, F.coalesce("_o", column)).drop("_m", "_o")


def neighbours(uids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, rel, dst: what is one step from each uid or its members, either way, rolled up to classes; no constants, not
    itself. And by CO_CHANGES of their files (DEFINES), top-level classes and functions of the other file."""
    near = undirected(edges.where(F.col("rel").isin(*NEAR)), "rel")
    hit = parts(uids, edges).join(near.withColumnRenamed("src", "part"), "part").select(F.col("uid").alias("src"), "rel", "dst")
    direct = rolled_up(hit, edges, "dst").join(nodes.where("kind <> 'const'").select(F.col("uid").alias("dst")), "dst", "left_semi")
    defines = edges.where("rel = 'DEFINES'").select(F.col("src").alias("file"), F.col("dst").alias("uid"))
    together = undirected(edges.where("rel = 'CO_CHANGES'"), "rel").select(F.col("src").alias("file"), F.col("dst").alias("other"))
    top = nodes.where("parent is null and kind in ('class', 'function')").select(F.col("uid").alias("dst"))
    theirs = defines.select(F.col("file").alias("other"), F.col("uid").alias("dst")).join(top, "dst", "left_semi")
    changed = uids.select("uid").distinct().join(defines, "uid").join(together, "file").join(theirs, "other").select(F.col("uid").alias("src"), F.lit("CO_CHANGES").alias("rel"), "dst")
    return direct.select("src", "rel", "dst").union(changed).where("src <> dst").distinct()


def fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, users: distinct names of users of a class or its members, both rolled up, no constants, not itself."""
    use = edges.where("rel in ('USES', 'CALLS')").select("src", "dst")
    both = rolled_up(rolled_up(use, edges, "src"), edges, "dst").where("src <> dst")
    named = both.join(nodes.where("kind <> 'const'").select(F.col("uid").alias("src"), "name"), "src")
    return named.groupBy(F.col("dst").alias("uid")).agg(F.array_sort(F.collect_set("name")).alias("users"))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref, rank, uid of all nodes that a reference may mean, by uid, qualified name, name or path; rank 1 is the best:
    exact (uid or qualified name) first, then top-level, then by kind, path, name and uid."""
    keys = reduce(DataFrame.union, [nodes.select(F.col(c).alias("ref"), "uid", F.lit(c in ("uid", "qualname")).alias("exact")) for c in ("uid", "qualname", "name", "path")])
    hit = refs.select("ref").distinct().join(keys.where("ref is not null"), "ref").groupBy("ref", "uid").agg(F.max("exact").alias("exact"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv]), F.col("kind")), F.lit(9))
    x = hit.join(nodes.select("uid", "kind", "path", "name", "parent").dropDuplicates(["uid"]), "uid")
    order = Window.partitionBy("ref").orderBy(F.col("exact").desc(), F.col("parent").isNotNull(), kind, F.col("path").asc_nulls_last(), F.col("name").asc_nulls_last(), "uid")
    return x.select("ref", F.row_number().over(order).alias("rank"), "uid")


def resolve_fragment(refs: DataFrame, items: DataFrame) -> DataFrame:
    """ref, uid, matches: knowledge (uid, title) whose id ends with `:ref`, else whose id holds it, else whose title does
    (any case); null uid where the best tier has none or several. References are few and asked by people: each is held
    against every item once, as a broadcast of the references."""
    r = F.broadcast(refs.select("ref").distinct())
    low = F.lower("ref")
    tier = F.when(F.col("uid").endswith(F.concat(F.lit(":"), F.col("ref"))) | (F.col("uid") == F.col("ref")), 1).when(F.lower("uid").contains(low), 2).when(F.lower("title").contains(low), 3)
    hit = items.select("uid", "title").join(r, tier.isNotNull()).withColumn("tier", tier)
    best = hit.groupBy("ref", "tier").agg(F.count("*").alias("matches"), F.min("uid").alias("uid"))
    top = best.groupBy("ref").agg(F.min(F.struct("tier", "matches", "uid")).alias("b"))
    return refs.select("ref").distinct().join(top, "ref", "left").select("ref", F.when(F.col("b.matches") == 1, F.col("b.uid")).alias("uid"), F.coalesce("b.matches", F.lit(0)).cast("long").alias("matches"))


def without_routes(rows: DataFrame) -> DataFrame:
    """Rows whose uid's part after # isn't a route."""
    return rows.where(~F.substring_index("uid", "#", -1).startswith("route:"))


def document_votes(hits: DataFrame) -> DataFrame:
    """uid, doc, score: for each symbol that documents describe (hits: doc, rank, score, describes), its best document.
    A rank is a number or anything else that sorts."""
    x = hits.select("doc", "rank", "score", F.explode("describes").alias("uid"))
    return x.groupBy("uid").agg(F.min(F.struct("rank", "doc", "score")).alias("b")).select("uid", "b.doc", "b.score")


def reusable(relevant: DataFrame, nodes: DataFrame, k: int = 8) -> DataFrame:
    """The first k (by rank) relevant classes and functions that are no route, controller or model."""
    bad = F.array(*map(F.lit, ("Route", "Controller", "Model")))
    fit = nodes.where(F.col("kind").isin("class", "function") & ~F.arrays_overlap(F.coalesce("roles", F.array().cast("array<string>")), bad))
    return relevant.join(fit.select("uid", "name"), "uid").orderBy("rank", "uid").limit(k)


def attached_knowledge(uids: DataFrame, knowledge: DataFrame, edges: DataFrame, decisions: DataFrame, history: bool = False) -> DataFrame:
    """uid, section, pos of what concerns the symbols: what they follow or are constrained by, validated constraints on
    external packages, decisions that establish those, and `decisions` (uid) found by text. Candidates are unverified;
    validated ones have sections of their kind, as have deprecated and superseded ones where history is asked for."""
    own = edges.where("rel in ('FOLLOWS', 'CONSTRAINED_BY')").join(uids.select(F.col("uid").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("uid"))
    general = knowledge.where("kind = 'constraint' and status = 'validated' and rule_type = 'forbid_external_dep'").select("uid")
    why = edges.where("rel = 'ESTABLISHES'").join(own.select(F.col("uid").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("uid"))
    every = own.union(general).union(why).union(decisions.select("uid")).distinct()
    shown = ("validated", "deprecated", "superseded") if history else ("validated",)
    plural = F.try_element_at(F.create_map(*map(F.lit, ("pattern", "patterns", "decision", "decisions", "constraint", "constraints"))), F.col("kind"))
    section = F.when(F.col("status") == "candidate", "unverified").when(F.col("status").isin(*shown), plural)
    x = every.join(knowledge, "uid").withColumn("section", section).where("section is not null")
    return x.select("uid", "section", F.row_number().over(Window.partitionBy("section").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "title", "uid")).alias("pos"))


def covering_tests(uids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, covers: test files (nodes of edges COVERS) of the symbols, with the sorted names of those they cover."""
    names = nodes.select(F.col("uid").alias("dst"), "name").join(uids.select(F.col("uid").alias("dst")).distinct(), "dst", "left_semi")
    hit = edges.where("rel = 'COVERS'").join(names, "dst").join(nodes.select(F.col("uid").alias("src"), "path"), "src")
    return hit.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("covers"))


def related_features(uids: DataFrame, features: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The newest k features (uid, name, created_at) that modify, reuse or introduce the symbols, with the names touched."""
    names = nodes.select(F.col("uid").alias("dst"), F.col("name").alias("symbol")).join(uids.select(F.col("uid").alias("dst")).distinct(), "dst", "left_semi")
    hit = edges.where("rel in ('MODIFIES', 'REUSES', 'INTRODUCES')").join(names, "dst").groupBy(F.col("src").alias("uid")).agg(F.array_sort(F.collect_set("symbol")).alias("touched"))
    return features.select("uid", "name", "created_at").join(hit, "uid").orderBy(F.col("created_at").desc(), "uid").limit(k)


def knowledge_list(knowledge: DataFrame, edges: DataFrame, kind: str | None = None, status: str | None = None) -> DataFrame:
    """uid, kind, status, confidence, title, evidence_count, by kind, status, confidence down, title. A filter that isn't
    given isn't there."""
    for column, value in (("kind", kind), ("status", status)):
        knowledge = knowledge.where(F.col(column) == value) if value is not None else knowledge
    n = edges.where("rel = 'SUPPORTED_BY'").groupBy(F.col("src").alias("uid")).agg(F.count_distinct("dst").alias("evidence_count"))
    x = knowledge.join(n, "uid", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)).cast("long"))
    return x.select("uid", "kind", "status", "confidence", "title", "evidence_count").orderBy(F.col("kind").asc_nulls_last(), F.col("status").asc_nulls_last(), F.col("confidence").desc_nulls_first(), F.col("title").asc_nulls_last(), "uid")


def impact(target: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """section, uid, depth of what a change of the target (uid) touches: `upstream` dependents within depth (1 to 4 steps),
    `downstream` dependencies of one step, `route`s whose handler reaches it in at most four calls, covering `test`s and
    files that `co_change`. Symbols are rolled up to classes; depth is the fewest steps."""
    depth = min(4, max(1, depth))
    whole = parts(target, edges).select(F.col("part").alias("uid")).distinct()
    use = edges.where("rel in ('USES', 'CALLS', 'ACCESSES', 'EXTENDS', 'HANDLES')").select("src", "dst")
    up = rolled_up(dependents(use, whole, depth), edges, "uid").groupBy("uid").agg(F.min("depth").alias("depth")).join(target, "uid", "left_anti")
    down = rolled_up(reach(edges.where("rel in ('USES', 'CALLS', 'ACCESSES', 'EXTENDS')"), whole, 1), edges, "uid").select("uid", F.lit(1).alias("depth")).distinct().join(target, "uid", "left_anti")
    calls = edges.where("rel in ('CALLS', 'USES')")
    near = dependents(calls, whole, 4).select("uid", "depth").union(whole.select("uid", F.lit(0)))
    routes = edges.where("rel = 'HANDLES'").join(near.withColumnRenamed("uid", "dst"), "dst").groupBy(F.col("src").alias("uid")).agg(F.min("depth").alias("depth"))
    tests = edges.where("rel = 'COVERS'").join(whole.withColumnRenamed("uid", "dst"), "dst", "left_semi").select(F.col("src").alias("uid"), F.lit(1).alias("depth")).distinct()
    files = edges.where("rel = 'DEFINES'").join(whole.withColumnRenamed("uid", "dst"), "dst", "left_semi").select(F.col("src").alias("file")).distinct()
    moved = undirected(edges.where("rel = 'CO_CHANGES'")).join(files.withColumnRenamed("file", "src"), "src", "left_semi").select(F.col("dst").alias("uid"), F.lit(1).alias("depth")).distinct()
    named = {"upstream": up, "downstream": down, "route": routes, "test": tests, "co_change": moved}
    return reduce(DataFrame.union, [df.select(F.lit(n).alias("section"), "uid", F.col("depth").cast("int").alias("depth")) for n, df in named.items()])


#: What the parser makes of a query, and of nothing that writes or sets.
QUERY_NODES = {"Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union", "Unpivot", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedOrderBy", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedWith", "Window", "WithWindowDefinition"}


def read_only(spark: SparkSession, sql: str, limit: int = 100) -> DataFrame:
    """The rows of one statement that only reads, at most `limit`. All else is an error: the engine's own parser tells what
    a statement is, so nothing hides in comments or strings, and only nodes known to be queries pass."""
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in QUERY_NODES:
            raise ValueError(f"not a query: {node.getClass().getSimpleName()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return spark.sql(sql).limit(limit)


def ask(spark: SparkSession, question: str, generator: Callable[[str], str], schema: str, limit: int = 100) -> DataFrame:
    """The rows of the query that `generator` writes for a question, asked with the schema's description, under the guard."""
    return read_only(spark, generator(f"{schema}\n\nQuestion: {question}\nOne SELECT statement:"), limit)
