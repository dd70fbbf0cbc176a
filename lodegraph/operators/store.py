"""Upserts, deletes, snapshots, exports and imports of node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema's closed lists. Rows of any other label or relation are refused.
LABELS = ("Project", "Module", "File", "TestFile", "Symbol", "Knowledge", "Pattern", "Decision", "Constraint", "Feature", "Evidence", "Commit", "Doc", "DocChunk", "AuditRun", "MemoryEvent", "SchemaVersion")
ROLES = ("Service", "Repository", "Controller", "Route", "Component", "Hook", "Worker", "Queue", "Middleware", "Model", "Validator", "Integration")
RELS = ("CONTAINS", "DEFINES", "HAS_MEMBER", "IMPORTS", "DEPENDS_ON", "USES", "CALLS", "EXTENDS", "IMPLEMENTS", "ACCESSES", "HANDLES", "COVERS", "FOLLOWS", "ESTABLISHES", "CONSTRAINED_BY", "SUPERSEDES", "SUPPORTED_BY", "CONTRADICTED_BY", "REFERENCES", "TOUCHES", "CO_CHANGES", "MODIFIES", "INTRODUCES", "REUSES", "TESTED_BY", "IMPLEMENTED_IN", "HAS_EVIDENCE", "FOLLOWED", "CREATED", "FROM_DOC", "NEXT_CHUNK", "DESCRIBES")
# end of fixed values


def check_known(names: list[str], known: tuple[str, ...]) -> None:
    """Before a plan is built: labels and relations outside the schema are an error."""
    if bad := sorted(set(names) - set(known)):
        raise ValueError(f"unknown: {', '.join(bad)}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], created: str | None = None) -> DataFrame:
    """Rows of `old` with what `new` gives (nulls give nothing), and the new rows. `created` is only set on new rows.

    Keys of `new` are unique. One full outer join; null keys match null keys."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    a, b = old.alias("a"), new.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])

    def merged(c: str):
        if c not in new.columns:
            return F.col(f"a.{c}")
        if c not in old.columns:
            return F.col(f"b.{c}")
        order = (f"a.{c}", f"b.{c}") if c == created else (f"b.{c}", f"a.{c}")
        return F.coalesce(*map(F.col, order))

    return a.join(b, same, "full_outer").select(*[merged(c).alias(c) for c in columns])


def overlay(stored: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    """The latest wins: rows of the diff, and stored rows that it doesn't have."""
    return stored.join(diff.select(key), key, "left_anti").unionByName(diff, allowMissingColumns=True)


def delete_stale(edges: DataFrame, audited: DataFrame, run: str, rels: list[str]) -> DataFrame:
    """Without edges of these relations, from an audited source (uid), that another run wrote."""
    stale = edges.where(F.col("rel").isin(*rels) & ~F.col("last_audit_run").eqNullSafe(F.lit(run)))
    gone = stale.join(audited.select(F.col("uid").alias("src")), "src", "left_semi").select("src", "rel", "dst").distinct()
    return edges.join(gone, ["src", "rel", "dst"], "left_anti").unionByName(edges.where(F.col("last_audit_run") == run).join(gone, ["src", "rel", "dst"], "left_semi"))


def detach(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges that touch no deleted uid."""
    d = deleted.select("uid").distinct()
    return edges.join(d.withColumnRenamed("uid", "src"), "src", "left_anti").join(d.withColumnRenamed("uid", "dst"), "dst", "left_anti").select(*edges.columns)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.join(edges.select(F.col("dst").alias("uid")), "uid", "left_anti")


def change_set(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change (A, M or D) of two snapshots; what stayed the same isn't listed."""
    a, b = old.select(F.col(key), F.col(digest).alias("_a")), new.select(F.col(key), F.col(digest).alias("_b"))
    both = a.join(b, key, "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, F.when(F.col("_a").isNull(), "A").when(F.col("_b").isNull(), "D").otherwise("M").alias("change"))


def induced(nodes: DataFrame, edges: DataFrame, labels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of these labels, and the edges among them, without embeddings."""
    if labels is not None:
        check_known(labels, LABELS + ROLES)
        nodes = nodes.where(F.col("label").isin(*labels))
    ids = nodes.select("uid")
    kept = edges.join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(ids.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    return nodes.drop("embedding"), kept.select(*edges.columns)


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder of JSON lines each; every task writes its own part."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def import_json(spark: SparkSession, path: str, project: str) -> tuple[DataFrame, DataFrame]:
    """An export of this project. Rows of another project, of unknown labels or relations are an error before anything is
    returned: one pass over the labels, projects and relations that occur."""
    nodes, edges = spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")
    wrong = ~F.col("project_id").eqNullSafe(F.lit(project)) | ~F.coalesce(F.col("label").isin(*LABELS, *ROLES), F.lit(False))
    bad = nodes.where(wrong).limit(1).collect()
    odd = edges.where(~F.coalesce(F.col("rel").isin(*RELS), F.lit(False))).limit(1).collect()
    if bad or odd:
        raise ValueError(f"not importable: {(bad or odd)[0].asDict()}")
    return nodes, edges


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new version beside the old ones; readers take the largest. A failed write leaves no version behind."""
    path = f"{root}/v={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, or an error at run time where a key repeats."""
    n = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if n:
        raise ValueError(f"{', '.join(keys)}: not unique")
    return df


def set_flags(nodes: DataFrame, values: DataFrame, key: str, flag: str) -> DataFrame:
    """`flag` of the nodes in `values` (key, flag) replaced, null included; others keep theirs. What labels are in a graph
    (a test file, roles, a kind) is a column here, so taking one away and setting another is one write."""
    new = values.select(F.col(key), F.col(flag).alias("_new"), F.lit(True).alias("_hit")).dropDuplicates([key])
    return nodes.join(new, key, "left").withColumn(flag, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(flag))).drop("_new", "_hit").select(*nodes.columns)


def set_embeddings(nodes: DataFrame, vectors: DataFrame, label: str) -> DataFrame:
    """embedding and embedding_model of nodes (uid) from `vectors`; only symbols, document chunks and knowledge have them."""
    if label not in ("Symbol", "DocChunk", "Knowledge"):
        raise ValueError(f"{label} has no embedding")
    return upsert(nodes, vectors.select("uid", "embedding", "embedding_model").join(nodes.select("uid"), "uid", "left_semi"), ["uid"])


def to_embed(cards: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Cards (uid, card_hash ...) whose text or model isn't what was embedded before (uid, card_hash, embedding_model)."""
    done = embedded.where(F.col("embedding_model") == model).select("uid", "card_hash")
    return cards.join(done, ["uid", "card_hash"], "left_anti")


def cached(texts: DataFrame, cache: DataFrame, model: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """(uid, key, vector of cached texts; distinct key, text of misses): texts (uid, text) against a cache (key, vector)
    addressed by model, dimensions and content."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(dims)), F.coalesce("text", F.lit(""))), 256)
    x = texts.withColumn("key", key)
    return x.join(cache, "key").select("uid", "key", "vector"), x.join(cache.select("key"), "key", "left_anti").select("key", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])


def delete_stale_nodes(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, scope: DataFrame | None, run: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence) without nodes that another run wrote, of the files in `scope` (file_uid) or all; edges that
    touch them go, and evidence that refers to them (REFERENCES) is marked stale."""
    old = nodes.where(~F.coalesce("last_audit_run", F.lit("")).eqNullSafe(F.lit(run)))
    old = old.join(scope.select("file_uid").distinct(), "file_uid", "left_semi") if scope is not None else old
    gone = old.select("uid").distinct()
    return nodes.join(gone, "uid", "left_anti").select(*nodes.columns), detach(edges, gone), mark_stale(evidence, edges, gone)


def mark_stale(evidence: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Evidence (uid, stale, stale_reason ...) that refers to a deleted uid, marked as such."""
    hit = edges.where("rel = 'REFERENCES'").join(gone.select(F.col("uid").alias("dst")), "dst", "left_semi").select(F.col("src").alias("uid"), F.lit(True).alias("_hit")).distinct()
    x = evidence.join(hit, "uid", "left")
    return x.withColumn("stale", F.coalesce("_hit", "stale")).withColumn("stale_reason", F.when(F.col("_hit"), "target_deleted").otherwise(F.col("stale_reason"))).select(*evidence.columns)


def delete_files(files: DataFrame, symbols: DataFrame, edges: DataFrame, evidence: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, symbols, edges, evidence) without the files in `gone` (uid) and what they define. Knowledge stays; evidence
    that refers to what went is marked stale."""
    own = symbols.join(gone.select(F.col("uid").alias("file_uid")), "file_uid", "left_semi").select("uid")
    every = gone.select("uid").union(own).distinct()
    return files.join(gone.select("uid"), "uid", "left_anti").select(*files.columns), symbols.join(own, "uid", "left_anti").select(*symbols.columns), detach(edges, every), mark_stale(evidence, edges, every)


EVIDENCE_RELS = ("SUPPORTED_BY", "CONTRADICTED_BY", "HAS_EVIDENCE")


def delete_knowledge(knowledge: DataFrame, evidence: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(knowledge, evidence, edges) without the knowledge in `gone` (uid) and the evidence that nothing holds any more.
    Evidence that nothing held before stays."""
    g = gone.select("uid").distinct()
    held = edges.where(F.col("rel").isin(*EVIDENCE_RELS))
    theirs = held.join(g.withColumnRenamed("uid", "src"), "src", "left_semi").select(F.col("dst").alias("uid")).distinct()
    still = held.join(g.withColumnRenamed("uid", "src"), "src", "left_anti").select(F.col("dst").alias("uid"))
    loose = theirs.join(still, "uid", "left_anti")
    return knowledge.join(g, "uid", "left_anti").select(*knowledge.columns), evidence.join(loose, "uid", "left_anti").select(*evidence.columns), detach(edges, g.union(loose))


def purge(tables: dict[str, DataFrame], project: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(the tables without a project's rows, how many rows of each went). Stored by project, this drops a partition."""
    own = F.col("project_id").eqNullSafe(F.lit(project))
    return {n: df.where(~own) for n, df in tables.items()}, {n: df.where(own).count() for n, df in tables.items()}


def update_status(nodes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the statuses of `changes` (uid, status, reason), uid and previous of each change). A change of what
    isn't there is an error."""
    new = changes.select("uid", F.col("status").alias("_to"), F.col("reason").alias("_why")).dropDuplicates(["uid"])
    missing = new.join(nodes.select("uid"), "uid", "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0]["uid"])
    before = nodes.join(new.select("uid"), "uid", "left_semi").select("uid", F.col("status").alias("previous"))
    x = nodes.join(new, "uid", "left").withColumn("status", F.coalesce("_to", "status"))
    x = x.withColumn("status_reason", F.when(F.col("_to").isNotNull(), F.col("_why")).otherwise(F.col("status_reason"))) if "status_reason" in nodes.columns else x
    return x.select(*nodes.columns), before


def relink(edges: DataFrame, rel: str, new: DataFrame) -> DataFrame:
    """Edges of a relation into the targets in `new` (src, dst) replaced by those; a target with a null src loses all."""
    targets = new.select("dst").distinct().withColumn("rel", F.lit(rel))
    kept = edges.join(targets, ["rel", "dst"], "left_anti").select(*edges.columns)
    return kept.unionByName(new.where("src is not null").select("src", "dst", F.lit(rel).alias("rel")).distinct(), allowMissingColumns=True)


def normalised(nodes: DataFrame, edges: DataFrame, drop: tuple[str, ...] = ("created_at", "updated_at", "last_audit_run", "embedding")) -> DataFrame:
    """kind, body: nodes and edges as JSON without what changes from run to run, sorted: equal graphs give equal rows."""
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(c for c in df.columns if c not in drop))).alias("body"))
    return line(nodes, "node").union(line(edges, "edge")).orderBy("kind", "body")


def record_events(events: DataFrame, table: str, log: str) -> None:
    """Events appended to a table and, as JSON lines, to a log for replay."""
    events.write.mode("append").parquet(table)
    events.write.mode("append").json(log)


def add_artifacts(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """A manifest (path, kind, sha256, size ...) with new artifacts (path, kind, content binary): texts are redacted before
    they are hashed, other bytes are hashed as they are, and an artifact replaces that of its path."""
    from lodegraph.functions.redact import redacted

    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), redacted(F.col("content").cast("string")))
    data = F.coalesce(F.encode(text, "utf-8"), F.col("content"))
    rows = new.select("path", "kind", F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("size"))
    return overlay(manifest, rows, "path")


def evidence_nodes(manifest: DataFrame, project: str, feature: str) -> tuple[DataFrame, DataFrame]:
    """(evidence rows, HAS_EVIDENCE edges from the feature) of a manifest's artifacts; the uid names path and content."""
    uid = F.concat_ws(":", F.lit(project), F.lit("ev"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(feature), "path", "sha256"), 256), 1, 16))
    e = manifest.select(uid.alias("uid"), F.lit(project).alias("project_id"), "kind", "path", "sha256").dropDuplicates(["uid"])
    return e, e.select(F.lit(feature).alias("src"), F.lit("HAS_EVIDENCE").alias("rel"), F.col("uid").alias("dst"))


#: What a change's evidence should hold.
EXPECTED_EVIDENCE = (("diff", "Git diff stat & patch"), ("test", "Test execution & JUnit XML"), ("guardrail", "Anti-slop guardrail report"), ("screenshot", "UI Screenshot / Visual diff"), ("recording", "Session video recording"))


def checklist(manifest: DataFrame, verified: bool) -> DataFrame:
    """pos, kind, label, sha256, state (verified, unverified or missing) of the expected kinds; of several artifacts of a
    kind the last (by pos) counts."""
    spark = manifest.sparkSession
    wanted = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(EXPECTED_EVIDENCE)], "pos int, kind string, label string")
    last = manifest.groupBy("kind").agg(F.max_by("sha256", "pos").alias("sha256"))
    state = F.when(F.col("sha256").isNull(), "missing").otherwise("verified" if verified else "unverified")
    return wanted.join(last, "kind", "left").select("pos", "kind", "label", "sha256", state.alias("state"))


def migrate(applied: int, migrations: dict[int, str], dims: int) -> list[tuple[int, str]]:
    """(version, statement) of what is still to run: versions must be contiguous from 1, statements end with a semicolon,
    and {{dims}} stands for the vectors' width. Bounded by the repository's own files: glue, not data."""
    if sorted(migrations) != list(range(1, len(migrations) + 1)):
        raise ValueError(f"versions are not contiguous: {sorted(migrations)}")
    out = []
    for version in sorted(v for v in migrations if v > applied):
        out += [(version, s.strip()) for s in migrations[version].replace("{{dims}}", str(dims)).split(";") if s.strip()]
    return out


def schema_report(df: DataFrame, expected: str, dims: int | None = None, vector: str = "embedding") -> list[str]:
    """How a table's columns differ from a DDL string, and how many vectors have another width."""
    from pyspark.sql.types import _parse_datatype_string

    want = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(expected).fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [f"missing {n}" for n in want if n not in have] + [f"{n}: {have[n]}, not {t}" for n, t in want.items() if n in have and have[n] != t]
    if dims is not None and vector in have:
        wrong = df.where(F.col(vector).isNotNull() & (F.size(vector) != dims)).count()
        out += [f"{wrong} vectors not of {dims} dimensions"] if wrong else []
    return out
