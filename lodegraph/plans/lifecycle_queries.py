"""Knowledge, mutations, context and sources on the driver tables: orders as knowledge, lines as evidence, parts as symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import context as cx
from lodegraph.operators import knowledge as kn
from lodegraph.operators import store
from lodegraph.plans.code_queries import SYM, symbols
from lodegraph.plans.graph_queries import EDGES, part_edges
from lodegraph.plans.registry import Tables, query
from lodegraph.sources import repository

_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text FROM documents)"


@query(rf"""WITH {_DOCS}, r AS (SELECT l_orderkey * 10 + l_linenumber AS ref, CAST(l_suppkey % 900 AS VARCHAR) AS path, l_linenumber AS s, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linenumber + 1 END AS e, l_orderkey AS k FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, CAST(ref AS VARCHAR)) AS pos, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS ls FROM r LEFT JOIN docs USING (path)),
j AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE len(ls) END AS total, coalesce(e, s) AS stop FROM n)
SELECT ref, CASE WHEN pos > 20 OR text IS NULL OR s > stop OR stop > total THEN NULL ELSE substr(sha256(array_to_string(ls[s:stop], chr(10))), 1, 16) END AS content_hash,
 CASE WHEN pos > 20 THEN 'beyond the first 20' WHEN text IS NULL THEN 'file not found' WHEN s > stop OR stop > total THEN 'outside the file' END AS dropped FROM j""")
def evidence_check(t: Tables) -> DataFrame:
    """Every line refers to lines of a document: existence, range and hash."""
    files = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    refs = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("ref"), F.col("l_orderkey").alias("knowledge_uid"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 900).cast("string").alias("path"), F.col("l_linenumber").cast("int").alias("line_start"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber") + 1).cast("int").alias("line_end"))
    return kn.check_evidence(refs, files).select(F.col("ref").cast("long").alias("ref"), "content_hash", "dropped")


@query("""SELECT 'p:ev:' || substr(sha256(array_to_string(['p', CAST(l_orderkey AS VARCHAR), 'SUPPORTED_BY', CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), 'None', CAST(l_suppkey AS VARCHAR)], chr(31))), 1, 16) AS uid, l_orderkey AS knowledge_uid FROM lineitem""")
def evidence_ids(t: Tables) -> DataFrame:
    none = F.lit(None).cast("int")
    return t.lineitem.select(kn.evidence_uid(F.lit("p"), F.col("l_orderkey"), F.lit("SUPPORTED_BY"), F.col("l_partkey"), F.col("l_linenumber"), none, F.col("l_suppkey")).alias("uid"), F.col("l_orderkey").alias("knowledge_uid"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem)
SELECT CAST(k AS VARCHAR) AS knowledge, CAST(p AS VARCHAR) AS target FROM e WHERE p IN (SELECT p_partkey FROM part WHERE p_size > 30)""")
def evidence_references(t: Tables) -> DataFrame:
    """Which parts the evidence of each order refers to, where they exist (here: large ones)."""
    none = F.lit(None)
    e = t.lineitem.select(F.col("l_orderkey").cast("string").alias("knowledge_uid"), F.col("l_partkey").cast("string").alias("path"), none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), none.cast("string").alias("symbol_uid"))
    targets = t.part.where("p_size > 30").select(F.col("p_partkey").cast("string").alias("uid"), F.col("p_partkey").cast("string").alias("path"), none.cast("string").alias("symbol_uid"))
    _, edges = kn.attach_evidence(e, "p", "SUPPORTED_BY", targets)
    hold, refer = edges.where("rel = 'SUPPORTED_BY'"), edges.where("rel = 'REFERENCES'")
    return hold.join(refer.select(F.col("src").alias("dst"), F.col("dst").alias("target")), "dst").select(F.col("src").alias("knowledge"), "target").distinct()


_K = """k AS (SELECT p_partkey AS uid, CASE p_size % 3 WHEN 0 THEN 'pattern' WHEN 1 THEN 'decision' ELSE 'constraint' END AS kind, p_name || ' ' || p_partkey AS title, CASE p_size % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'validated' WHEN 2 THEN 'deprecated' WHEN 3 THEN 'rejected' ELSE 'superseded' END AS status,
 round(p_retailprice / 3000, 2) AS confidence, CASE WHEN p_brand = 'Brand#4' THEN 'human' ELSE 'auditor' END AS by_, CASE WHEN p_size % 7 = 0 THEN 'placement' END AS rule_type, p_size FROM part)"""


def _knowledge(t: Tables) -> DataFrame:
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("p_size") % len(values)).cast("int"))
    return t.part.select(
        F.col("p_partkey").alias("uid"),
        pick(("pattern", "decision", "constraint")).alias("kind"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("title"),
        F.lit("c").alias("claim"),
        F.lit("auditor").alias("source"),
        pick(("candidate", "validated", "deprecated", "rejected", "superseded")).alias("status"),
        F.round(F.col("p_retailprice") / 3000, 2).alias("confidence"),
        F.lit(1).alias("support_count"),
        F.lit(0).alias("violation_count"),
        F.when(F.col("p_brand") == "Brand#4", "human").otherwise("auditor").alias("validated_by"),
        F.when(F.col("p_size") % 7 == 0, "placement").alias("rule_type"),
        F.lit("{}").alias("rule"),
        F.when(F.col("p_size") % 2 == 0, "naming").alias("detector"),
        "p_size",
    )


_Z = "(((s / (s + v)) + 1 / (2 * (s + v)) - sqrt((s / (s + v)) * (1 - s / (s + v)) / (s + v) + 1 / (4 * (s + v) * (s + v)))) / (1 + 1 / (s + v)))"


@query(f"""WITH {_K}, ev AS (SELECT l_partkey AS uid, CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) AS s, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS v FROM lineitem GROUP BY 1),
x AS (SELECT k.uid, k.status, by_, s, v, {_Z} * 0.9 AS w FROM k JOIN ev USING (uid)), y AS (SELECT *, round(least(1, CASE WHEN by_ = 'human' THEN greatest(w, 0.9) ELSE w END), 2) AS conf FROM x),
z AS (SELECT *, conf >= 0.75 AND s >= 3 AS pass FROM y)
SELECT uid, 'updated' AS outcome, CASE WHEN status IN ('rejected', 'superseded') THEN status WHEN status = 'candidate' THEN CASE WHEN pass THEN 'validated' ELSE status END
 WHEN status = 'validated' AND by_ = 'human' THEN CASE WHEN s >= 3 THEN status ELSE 'deprecated' END WHEN status = 'validated' THEN CASE WHEN pass THEN status ELSE 'deprecated' END
 WHEN pass OR (by_ = 'human' AND s >= 3) THEN 'validated' ELSE status END AS status, conf AS confidence FROM z WHERE s > 0""")
def knowledge_submit(t: Tables) -> DataFrame:
    """The auditor proposes every part again, with what its lines say for and against it."""
    k = _knowledge(t).withColumn("rule_type", F.lit(None).cast("string"))
    n = t.lineitem.groupBy(F.col("l_partkey").alias("knowledge_uid")).agg(F.count_if(F.col("l_returnflag") != "R").alias("kept"), F.count_if(F.col("l_returnflag") == "R").alias("against"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    p = k.select("uid", "kind", "title", "claim", none("rationale", "string"), "source", F.lit("auditor").alias("actor"), none("adr_status", "string"), "rule_type", none("rule", "string"), none("support_count", "int"), none("violation_count", "int"))
    return kn.submit(p, k, n).where("outcome <> 'rejected'").select("uid", "outcome", "status", "confidence")


@query(f"""WITH {_K} SELECT uid, CASE WHEN status = 'candidate' THEN 'rejected' ELSE status END AS status FROM k""")
def knowledge_decide(t: Tables) -> DataFrame:
    """A human rejects everything that isn't rejected yet: only candidates may be."""
    k = _knowledge(t)
    orders = k.select("uid", F.lit("rejected").alias("to_status"), F.lit("human:a").alias("actor"), F.lit("not wanted").alias("reason"), F.lit(None).cast("long").alias("superseded_by"))
    return kn.decide(k, orders)[0].select("uid", "status")


@query(f"""WITH {_K}, ev AS (SELECT l_partkey AS uid, count(*) AS refs, count(*) FILTER (l_returnflag <> 'N') AS stale FROM lineitem GROUP BY 1)
SELECT k.uid, CASE WHEN rule_type IS NOT NULL THEN 'rule' WHEN p_size % 2 = 0 THEN 'lost' ELSE 'evidence' END AS way,
 CASE WHEN rule_type IS NULL AND p_size % 2 = 1 AND refs > 0 AND refs = stale AND status = 'validated' THEN 'deprecated' ELSE status END AS status
FROM k LEFT JOIN ev USING (uid) WHERE status IN ('candidate', 'validated', 'deprecated') AND p_size <> 10""")
def knowledge_revalidate(t: Tables) -> DataFrame:
    k = _knowledge(t)
    stale = t.lineitem.groupBy(F.col("l_partkey").alias("knowledge_uid")).agg(F.count("*").alias("refs"), F.count_if(F.col("l_returnflag") != "N").alias("stale"))
    return kn.revalidation(k, k.where("p_size = 10"), stale)


@query("""SELECT o_orderkey AS uid, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_totalprice > 200000 THEN 'changed' END AS stale_reason FROM orders""")
def evidence_stale(t: Tables) -> DataFrame:
    e = t.orders.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("knowledge_uid"), F.lit("h").alias("content_hash"), "o_orderstatus", "o_totalprice")
    now = e.where("o_orderstatus <> 'P'").select(F.col("uid").alias("ref"), F.when(F.col("o_totalprice") > 200000, "x").otherwise("h").alias("content_hash"))
    return kn.stale_evidence(e.select("uid", "knowledge_uid", "content_hash"), now).select("uid", "stale_reason")


@query("""WITH v AS (SELECT l_suppkey AS key, l_returnflag = 'R' AS bad, l_partkey AS path, l_linenumber AS line, l_orderkey AS uid FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY key, bad ORDER BY CAST(path AS VARCHAR), line, uid) AS rn FROM v)
SELECT key, count(*) FILTER (NOT bad) AS support_count, count(*) FILTER (bad) AS violation_count, coalesce(list_sort(list(path || ':' || line) FILTER (NOT bad AND rn <= 20)), []) AS evidence FROM r GROUP BY 1""")
def knowledge_proposals(t: Tables) -> DataFrame:
    seen = t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("uid"), F.col("l_partkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "violation").otherwise("support").alias("verdict"))
    patterns = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"), F.lit("c").alias("claim"))
    return kn.proposals_of(seen, patterns).select("key", "support_count", "violation_count", "evidence")


@query("""SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS src, 'FOLLOWS' AS rel, CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem WHERE l_returnflag <> 'R'
UNION SELECT CAST(l_partkey AS VARCHAR), 'CONSTRAINED_BY', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linestatus = 'O'""")
def knowledge_links(t: Tables) -> DataFrame:
    line = t.lineitem
    seen = line.select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("uid"), F.when(F.col("l_returnflag") == "R", "violation").otherwise("support").alias("verdict"))
    bound = line.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("constraint"), F.col("l_partkey").alias("uid"))
    none = line.where("false")
    return kn.ingest_links(seen, bound, none.select(F.lit("").alias("adr_id"), F.array(F.lit("")).alias("supersedes")), none.select(F.lit("").alias("a"), F.lit("").alias("b")))


@query("""SELECT c_custkey AS uid, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN true ELSE false END AS is_test FROM customer""")
def label_toggle(t: Tables) -> DataFrame:
    nodes = t.customer.select(F.col("c_custkey").alias("uid"), F.lit(False).alias("is_test"))
    return store.set_flags(nodes, nodes.where("uid % 3 < 2").select("uid", F.when(F.col("uid") % 3 == 1, True).alias("is_test")), "uid", "is_test")


@query("""SELECT p_partkey AS uid, CASE WHEN p_partkey < 500 THEN 64 END AS width, CASE WHEN p_partkey < 500 THEN 'm' END AS embedding_model FROM part""")
def embedding_upsert(t: Tables) -> DataFrame:
    none = F.lit(None)
    nodes = t.part.select(F.col("p_partkey").alias("uid"), none.cast("array<float>").alias("embedding"), none.cast("string").alias("embedding_model"))
    out = store.set_embeddings(nodes, t.embeddings.where("vec_id < 500").select(F.col("vec_id").alias("uid"), "embedding", F.lit("m").alias("embedding_model")), "Symbol")
    return out.select("uid", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"), "embedding_model")


@query("""SELECT p_partkey AS uid FROM part WHERE NOT (p_size % 2 = 0 AND p_type IN ('SMALL', 'PROMO'))""")
def embedding_misses(t: Tables) -> DataFrame:
    cards = t.part.select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("card_hash"), "p_size", "p_type")
    done = cards.where("p_size % 2 = 0").select("uid", "card_hash", F.when(F.col("p_type").isin("SMALL", "PROMO"), "m").otherwise("old").alias("embedding_model"))
    return store.to_embed(cards, done, "m").select("uid")


@query("""WITH gone AS (SELECT c_custkey AS uid FROM customer WHERE c_acctbal < 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT o_orderkey AS uid, o_custkey IN (SELECT uid FROM gone) AS stale, CASE WHEN o_custkey IN (SELECT uid FROM gone) THEN 'target_deleted' END AS stale_reason FROM orders""")
def stale_symbol_delete(t: Tables) -> DataFrame:
    """Symbols (customers) that a run didn't see again, of two files (segments): what referred to them is marked."""
    nodes = t.customer.select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("file_uid"), F.when(F.col("c_acctbal") < 0, "r1").otherwise("r2").alias("last_audit_run"))
    evidence = t.orders.select(F.col("o_orderkey").alias("uid"), F.lit(False).alias("stale"), F.lit(None).cast("string").alias("stale_reason"))
    edges = t.orders.select(F.col("o_orderkey").alias("src"), F.lit("REFERENCES").alias("rel"), F.col("o_custkey").alias("dst"))
    scope = nodes.where("file_uid in ('BUILDING', 'MACHINERY')").select("file_uid")
    return store.delete_stale_nodes(nodes, edges, evidence, scope, "r2")[2]


@query("""SELECT c_custkey AS uid FROM customer WHERE c_nationkey NOT IN (3, 4)""")
def file_cascade_delete(t: Tables) -> DataFrame:
    files = t.nation.select((-F.col("n_nationkey") - 1).cast("long").alias("uid"))
    symbols_ = t.customer.select(F.col("c_custkey").alias("uid"), (-F.col("c_nationkey") - 1).cast("long").alias("file_uid"))
    edges = t.orders.select(F.col("o_orderkey").alias("src"), F.lit("USES").alias("rel"), F.col("o_custkey").alias("dst"))
    evidence = t.orders.select(F.col("o_orderkey").alias("uid"), F.lit(False).alias("stale"), F.lit(None).cast("string").alias("stale_reason"))
    return store.delete_files(files, symbols_, edges, evidence, files.where("uid in (-4, -5)"))[1].select("uid")


@query("""WITH g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT p_partkey AS uid FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT k FROM g))
 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM g))""")
def knowledge_delete(t: Tables) -> DataFrame:
    """Urgent orders go as knowledge; parts are evidence that stays while another order holds it."""
    edges = t.lineitem.select(F.concat(F.lit("k"), "l_orderkey").alias("src"), F.lit("SUPPORTED_BY").alias("rel"), F.col("l_partkey").cast("string").alias("dst"))
    known = t.orders.select(F.concat(F.lit("k"), "o_orderkey").alias("uid"), "o_orderpriority")
    evidence = t.part.select(F.col("p_partkey").cast("string").alias("uid"))
    return store.delete_knowledge(known, evidence, edges, known.where("o_orderpriority = '1-URGENT'"))[1].select(F.col("uid").cast("long").alias("uid"))


@query("""SELECT c_mktsegment AS project_id, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1""")
def project_purge(t: Tables) -> DataFrame:
    left, _ = store.purge({"customer": t.customer.withColumnRenamed("c_mktsegment", "project_id")}, "BUILDING")
    return left["customer"].groupBy("project_id").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS uid, o_orderstatus AS previous FROM orders WHERE o_orderkey % 4 = 0""")
def status_update(t: Tables) -> DataFrame:
    nodes = t.orders.select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("status"))
    return store.update_status(nodes, nodes.where("uid % 4 = 0").select("uid", F.lit("X").alias("status"), F.lit("because").alias("reason")))[1]


@query("""SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_partkey >= 100 UNION ALL SELECT p_partkey + 1000000, p_partkey FROM part WHERE p_partkey < 100""")
def relinked(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.lit("USES").alias("rel"), F.col("l_partkey").alias("dst"))
    return store.relink(edges, "USES", t.part.where("p_partkey < 100").select((F.col("p_partkey") + 1000000).alias("src"), F.col("p_partkey").alias("dst"))).select("src", "dst")


@query("""WITH ex(pos, kind) AS (VALUES (0, 'diff'), (1, 'test'), (2, 'guardrail'), (3, 'screenshot'), (4, 'recording')), m AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'diff' WHEN 'O' THEN 'test' ELSE 'other' END AS kind, arg_max(sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS h FROM orders GROUP BY 1)
SELECT pos, ex.kind, h AS sha256, CASE WHEN h IS NULL THEN 'missing' ELSE 'verified' END AS state FROM ex LEFT JOIN m USING (kind)""")
def evidence_checklist(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "diff").when(F.col("o_orderstatus") == "O", "test").otherwise("other")
    manifest = t.orders.select(kind.alias("kind"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), F.col("o_orderkey").alias("pos"))
    return store.checklist(manifest, True).select("pos", "kind", "sha256", "state")


_NEAR = f"""{SYM}, {EDGES}, hm AS (SELECT a.uid AS owner, a.uid + 1 AS member FROM sym a JOIN sym b ON b.uid = a.uid + 1 WHERE a.kind = 'class' AND b.kind = 'method'),
q AS (SELECT uid FROM sym WHERE uid % 50 = 0), parts AS (SELECT uid, uid AS part FROM q UNION ALL SELECT owner, member FROM hm WHERE owner IN (SELECT uid FROM q)), u AS (SELECT src, dst, rel FROM e UNION SELECT dst, src, rel FROM e)"""


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = symbols(t)
    members = s.where("kind = 'class'").select("uid").join(s.where("kind = 'method'").select((F.col("uid") - 1).alias("uid")), "uid")
    edges = part_edges(t).select("src", "rel", "dst").union(members.select(F.col("uid").alias("src"), F.lit("HAS_MEMBER").alias("rel"), (F.col("uid") + 1).alias("dst")))
    return s.withColumn("parent", F.lit(None).cast("long")).withColumn("qualname", F.col("name")), edges


@query(f"""WITH {_NEAR} SELECT DISTINCT p.uid AS src, u.rel, coalesce(hm.owner, u.dst) AS dst FROM parts p JOIN u ON u.src = p.part LEFT JOIN hm ON hm.member = u.dst WHERE p.uid <> coalesce(hm.owner, u.dst) AND coalesce(hm.owner, u.dst) IN (SELECT uid FROM sym)""")
def neighbours_rolled_up(t: Tables) -> DataFrame:
    """One step from every 50th symbol and its members, rolled up to classes."""
    nodes, edges = _graph(t)
    return cx.neighbours(nodes.where("uid % 50 = 0").select("uid"), nodes, edges)


@query(f"""WITH {_NEAR}, r AS (SELECT coalesce(a.owner, src) AS s, coalesce(b.owner, dst) AS d FROM e LEFT JOIN hm a ON a.member = src LEFT JOIN hm b ON b.member = dst WHERE rel IN ('USES', 'CALLS'))
SELECT d AS uid, list_sort(list(DISTINCT name)) AS users FROM r JOIN sym ON sym.uid = s WHERE s <> d GROUP BY 1""")
def fan_in_names(t: Tables) -> DataFrame:
    nodes, edges = _graph(t)
    return cx.fan_in(nodes, edges)


@query("""WITH d AS (SELECT o_orderkey AS k, l_suppkey AS s, o_totalprice AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
n AS (SELECT k, row_number() OVER (ORDER BY price DESC, k) AS rank, price, list(DISTINCT s) AS ss FROM d GROUP BY k, price), x AS (SELECT k, rank, price, unnest(ss) AS uid FROM n)
SELECT uid, arg_min(k, rank) AS doc, arg_min(price, rank) AS score FROM x GROUP BY 1""")
def document_vote(t: Tables) -> DataFrame:
    """Orders as documents ranked by price; each supplier takes the best that mentions it. A rank is what the order compares,
    not a number: numbers would take all orders through one task."""
    said = t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_set("l_suppkey").alias("describes"))
    ranked = t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("score")).join(said, "doc")
    price = F.col("score")
    return cx.document_votes(ranked.withColumn("rank", F.struct(price.isNull(), ~F.isnan(price), -price, F.col("doc"))))


@query(f"""WITH {SYM}, n AS (SELECT uid, name, row_number() OVER (ORDER BY loc DESC, uid) AS rank FROM sym WHERE kind IN ('class', 'function') AND role NOT IN ('Route', 'Controller', 'Model')) SELECT uid, name FROM n WHERE rank <= 8""")
def reusable_selection(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    s = symbols(t)
    relevant = s.select("uid", F.row_number().over(Window.orderBy(F.col("loc").desc(), "uid")).alias("rank"))
    return cx.reusable(relevant, s).select("uid", "name")


@query(f"""WITH {_K}, q AS (SELECT DISTINCT l_partkey AS uid FROM lineitem WHERE l_suppkey % 50 = 0), w AS (SELECT DISTINCT l_suppkey AS uid FROM lineitem WHERE l_partkey IN (SELECT uid FROM q) AND l_returnflag = 'R'),
c AS (SELECT uid FROM q UNION SELECT uid FROM w), s AS (SELECT k.*, CASE WHEN status = 'candidate' THEN 'unverified' WHEN status = 'validated' THEN kind || 's' END AS section FROM k WHERE uid IN (SELECT uid FROM c))
SELECT uid, section, CAST(row_number() OVER (PARTITION BY section ORDER BY confidence DESC, title, uid) AS INTEGER) AS pos FROM s WHERE section IS NOT NULL""")
def knowledge_attached(t: Tables) -> DataFrame:
    """What suppliers of every 50th number follow, and the decisions that establish it."""
    line = t.lineitem
    edges = line.where("l_suppkey % 50 = 0").select((-F.col("l_suppkey") - 1).alias("src"), F.lit("FOLLOWS").alias("rel"), F.col("l_partkey").alias("dst"))
    edges = edges.union(line.where("l_returnflag = 'R'").select("l_suppkey", F.lit("ESTABLISHES"), "l_partkey"))
    k = _knowledge(t)
    return cx.attached_knowledge(t.supplier.select((-F.col("s_suppkey") - 1).alias("uid")), k, edges, k.where("false").select("uid"))


@query("""SELECT o_orderpriority AS path, list_sort(list(DISTINCT c_name)) AS covers FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 50 = 0 GROUP BY 1""")
def test_coverage(t: Tables) -> DataFrame:
    """Tests that cover every 50th customer: orders stand for test files, their priority for the path."""
    nodes = t.customer.select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("path"))
    nodes = nodes.union(t.orders.select((-F.col("o_orderkey") - 1).alias("uid"), F.lit("t"), F.col("o_orderpriority")))
    edges = t.orders.select((-F.col("o_orderkey") - 1).alias("src"), F.lit("COVERS").alias("rel"), F.col("o_custkey").alias("dst"))
    return cx.covering_tests(t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("uid")), nodes, edges)


@query("""WITH x AS (SELECT o_orderkey AS uid, o_orderdate AS created_at, list_sort(list(DISTINCT p_name)) AS touched FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_partkey % 50 = 0 GROUP BY 1, 2)
SELECT uid, touched FROM x ORDER BY created_at DESC, uid LIMIT 5""")
def related_features(t: Tables) -> DataFrame:
    features = t.orders.select(F.col("o_orderkey").alias("uid"), F.lit("f").alias("name"), F.col("o_orderdate").alias("created_at"))
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.lit("MODIFIES").alias("rel"), F.col("l_partkey").alias("dst"))
    nodes = t.part.select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("name"))
    return cx.related_features(nodes.where("uid % 50 = 0").select("uid"), features, nodes, edges).select("uid", "touched")


@query(f"""WITH {_K}, n AS (SELECT l_partkey AS uid, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT k.uid, kind, status, confidence, title, coalesce(n, 0) AS evidence_count FROM k LEFT JOIN n USING (uid) WHERE kind = 'decision'""")
def knowledge_listing(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.lit("SUPPORTED_BY").alias("rel"), F.col("l_orderkey").alias("dst"))
    return cx.knowledge_list(_knowledge(t), edges, "decision")


_RANK = "CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 ELSE 4 END"


@query(f"""WITH {SYM}, r AS (SELECT DISTINCT name AS ref FROM sym WHERE uid % 50 = 0), h AS (SELECT ref, s.*, row_number() OVER (PARTITION BY ref ORDER BY {_RANK}, path, s.uid) AS rank FROM r JOIN sym s ON s.name = r.ref)
SELECT ref, CAST(rank AS INTEGER) AS rank, uid FROM h""")
def reference_resolution(t: Tables) -> DataFrame:
    s = symbols(t).withColumn("parent", F.lit(None).cast("string")).withColumn("qualname", F.lit(None).cast("string"))
    text = s.withColumn("id", F.col("uid")).withColumn("uid", F.col("uid").cast("string"))
    got = cx.resolve(s.where("uid % 50 = 0").select(F.col("name").alias("ref")), text)
    return got.select("ref", "rank", F.col("uid").cast("long").alias("uid"))


_BACK = "SELECT DISTINCT src AS uid FROM e WHERE dst IN (SELECT uid FROM {0})"


@query(f"""WITH {EDGES}, t AS (SELECT CAST(1 AS BIGINT) AS uid), u1 AS ({_BACK.format('t')}), u2 AS ({_BACK.format('u1')}), up AS (SELECT uid, min(d) AS depth FROM (SELECT uid, 1 AS d FROM u1 UNION ALL SELECT uid, 2 FROM u2) GROUP BY 1)
SELECT 'upstream' AS section, uid, CAST(depth AS INTEGER) AS depth FROM up WHERE uid <> 1 UNION ALL SELECT 'downstream', dst, 1 FROM (SELECT DISTINCT dst FROM e WHERE src = 1) WHERE dst <> 1""")
def impact_report(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("uid"))
    return cx.impact(t.spark.range(1, 2).select(F.col("id").alias("uid")), nodes, part_edges(t).select("src", "rel", "dst"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'secret_file' WHEN doc_id % 5 = 1 THEN 'unsupported_type' WHEN doc_id % 5 = 2 THEN 'excluded' WHEN text IS NULL THEN 'missing' WHEN n_chars > 4096 THEN 'too_large' WHEN doc_id % 5 = 3 THEN NULL ELSE 'generated' END AS reason,
 CASE WHEN doc_id % 5 = 3 AND text IS NOT NULL AND n_chars <= 4096 THEN sha256(replace(text, chr(13) || chr(10), chr(10))) END AS sha256 FROM documents""")
def filtered_walk(t: Tables) -> DataFrame:
    """Documents as files whose names, sizes and places fail different rules."""
    name = F.get(F.array(*map(F.lit, ("secrets.toml", "logo.png", "dist/x.ts", "src/x.ts", "src/x.min.js"))), (F.col("doc_id") % 5).cast("int"))
    files = t.documents.select("doc_id", F.concat_ws("/", F.lit("r"), F.col("doc_id").cast("string"), name).alias("path"), F.col("n_chars").alias("size"), F.encode("text", "utf-8").alias("content"))
    walked = repository.walk(files.drop("doc_id"), ["**"], ["**/dist/**"], 4)
    return walked.select(F.split("path", "/")[1].cast("long").alias("doc_id"), "reason", "sha256")


@query(r"""SELECT CAST(o_orderkey AS VARCHAR) AS sha, 'feat: order ' || o_orderkey AS message, 'feat' AS type, substr(sha256('salt:' || lower('C' || o_custkey)), 1, 12) AS author_hash, CAST(coalesce(n, 0) AS INTEGER) AS file_count
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def history_scan(t: Tables) -> DataFrame:
    """Orders as commits in the log's own format, lines as the files that they touch."""
    touched = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.lit("0"), F.concat(F.lit("p/"), "l_partkey"))), "\n").alias("rows"))
    head = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), F.concat(F.lit("C"), "o_custkey"), F.col("o_orderdate").cast("string"), F.concat(F.lit("feat: order "), "o_orderkey"))
    records = t.orders.join(touched, "o_orderkey", "left").select(F.concat(head, F.lit("\n\n"), F.coalesce("rows", F.lit(""))).alias("value"))
    return repository.history(records, "salt")[0].select("sha", "message", "type", "author_hash", "file_count")


@query("""SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'A' WHEN b.k IS NULL THEN 'D' ELSE 'M' END AS status FROM (SELECT CAST(p_partkey AS VARCHAR) AS k, p_name FROM part WHERE p_size < 40) a
FULL JOIN (SELECT CAST(p_partkey AS VARCHAR) AS k, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS p_name FROM part WHERE p_size > 10) b ON a.k = b.k WHERE a.p_name IS DISTINCT FROM b.p_name""")
def snapshot_changes(t: Tables) -> DataFrame:
    path = F.col("p_partkey").cast("string").alias("path")
    old = t.part.where("p_size < 40").select(path, F.col("p_name").alias("sha256"))
    new = t.part.where("p_size > 10").select(path, F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("sha256"))
    none = t.part.where("false").select(path, F.lit(0).alias("added"), F.lit(0).alias("deleted"))
    return repository.snapshot_diff(old, new, none).select("path", "status")


@query(f"""WITH {SYM} SELECT uid, CASE WHEN kind = 'method' THEN false ELSE true END AS embeddable, substr(sha256(name || ' (' || kind || ', ' || role || ') in ' || path || CASE WHEN kind IN ('function', 'method') THEN chr(10) || 'Signature: f()' ELSE '' END || chr(10) || 'Methods: ' || array_to_string(methods, ' · ')), 1, 16) AS card_hash FROM sym""")
def symbol_cards(t: Tables) -> DataFrame:
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    text = repository.card(*map(F.col, ("name", "kind", "path", "roles")), F.lit("f()"), F.col("methods"), empty, none, none, empty)
    return symbols(t).select("uid", repository.is_embeddable(F.col("kind"), F.col("exported"), F.col("roles")).alias("embeddable"), repository.card_hash(text).alias("card_hash"))
