"""Readers, parser, resolution and streams on small trees with literal results."""

from __future__ import annotations

import hashlib
import subprocess

from pyspark.sql import functions as F

from lodegraph.operators import resolution
from lodegraph.sources import python_modules, repository
from lodegraph.streaming import streams


def put(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=A@x.y", *args], check=True, capture_output=True)


def test_walk(spark, tmp_path):
    put(tmp_path, {".gitignore": "ignored/\n", "src/a.ts": "export const a = 1;\r\n", "src/b.min.js": "x", "src/gen.ts": "// @generated\n", "dist/out.js": "x", "ignored/x.ts": "x", "docs/guide.md": "# Guide\n", "tests/a.test.ts": "import { a } from '../src/a';\n", "logo.png": "no", "package.json": '{"dependencies": {"zod": "1"}, "devDependencies": {"vitest": "2"}}', "py/pyproject.toml": '[project]\ndependencies = ["Flask>=2", "zod"]\n', "requirements.txt": "# c\nrequests==1\n-r x\n", "src/big.ts": "x" * 3000, "src/blob.ts": b"\x00\x01binary", ".env": "SECRET=1\n"})
    git(tmp_path, "init", "-q")
    paths = repository.list_files(str(tmp_path))
    assert "ignored/x.ts" not in paths and paths == sorted(paths)
    walked = repository.walk(repository.read_tree(spark, str(tmp_path), [*paths, "gone.ts"]), ["**"], ["dist/**"], 2).cache()
    kept = {r.path: r for r in walked.where("reason is null").collect()}
    assert set(kept) == {"src/a.ts", "docs/guide.md", "tests/a.test.ts"} and kept["tests/a.test.ts"].is_test
    assert kept["src/a.ts"].sha256 == hashlib.sha256(b"export const a = 1;\n").hexdigest() and kept["src/a.ts"].lang == "typescript"
    assert {r.reason: r.n for r in repository.skip_counts(walked).collect()} == {"secret_file": 1, "too_large": 1, "binary": 1, "generated": 2, "excluded": 1, "unsupported_type": 2, "missing": 1}
    deps = {r.dep: r.manifest for r in repository.dependencies(walked).collect()}
    assert deps == {"zod": "package.json", "vitest": "package.json", "flask": "py/pyproject.toml", "requests": "requirements.txt"}
    assert repository.read_tree(spark, str(tmp_path)).where("path = 'src/a.ts'").count() == 1
    old = spark.createDataFrame([("src/a.ts", "0"), ("x", "1"), ("docs/guide.md", kept["docs/guide.md"].sha256)], "path string, sha256 string")
    lines = spark.createDataFrame([("src/a.ts", 3, 1)], "path string, added int, deleted int")
    assert {tuple(r) for r in repository.snapshot_diff(old, walked.where("reason is null"), lines).collect()} == {("src/a.ts", "M", 3, 1), ("x", "D", 0, 0), ("tests/a.test.ts", "A", 0, 0)}


def test_history(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    git(root, "init", "-q")
    for i, (files, message) in enumerate([({"a.py": "1\n", "b.py": "2\n"}, "feat(core): start"), ({"a.py": "1\n3\n"}, "no type here"), ({"c.bin": b"\x00\xff\x00"}, "fix!: TOKEN=abcdefghij1")]):
        put(root, files)
        git(root, "add", "-A")
        git(root, "commit", "-qm", message)
    git(root, "mv", "b.py", "d.py")
    git(root, "commit", "-qm", "chore: move")
    log = tmp_path / "log.txt"
    log.write_text(repository.git_log(str(root), 10))
    commits, touches = repository.read_history(spark, str(log), "salt")
    got = {r.message: r for r in commits.collect()}
    assert set(got) == {"feat(core): start", "no type here", "fix!: TOKEN=[REDACTED:env_assignment]", "chore: move"}
    assert (got["feat(core): start"].type, got["no type here"].type, got["fix!: TOKEN=[REDACTED:env_assignment]"].type) == ("feat", None, "fix")
    assert {r.author_hash for r in got.values()} == {hashlib.sha256(b"salt:a@x.y").hexdigest()[:12]} and got["feat(core): start"].file_count == 2
    rows = {(r.path, r.added, r.deleted) for r in touches.collect()}
    assert {("a.py", 1, 0), ("b.py", 1, 0), ("c.bin", 0, 0), ("d.py", 0, 0)} <= rows
    known = commits.where("message = 'no type here'")
    assert repository.read_history(spark, str(log), "salt", known)[0].count() == 3 and repository.git_log(str(root), 0) == ""


APP = {
    "app/__init__.py": "from .token import TokenService\n",
    "app/base.py": "class Base:\n    pass\n",
    "app/models.py": "from .base import Base\n\nclass Invite(Base):\n    __tablename__ = 'invites'\n",
    "app/token.py": 'from .models import Invite\n\nclass TokenService:\n    """Issues tokens."""\n\n    def create(self, kind: str) -> str:\n        db.add(Invite)\n        db.query(Invite)\n        return self.verify(kind)\n\n    def verify(self, x):\n        return x\n',
    "app/invite.py": "from typing import Optional\nfrom app import TokenService\nfrom .util import slugify\nimport app.util as util\n\nservice = TokenService()\n\nclass Inviter:\n    def __init__(self, tokens: Optional[TokenService], n=1):\n        self.tokens = tokens\n\n    def run(self):\n        slugify('x')\n        util.shout('y')\n        return self.tokens.create('invite')\n\n@router.post('/invites')\ndef post_invite(inviter: Inviter):\n    return inviter.run()\n",
    "app/util.py": "def slugify(x):\n    return x\n\ndef shout(x):\n    return slugify(x)\n",
    "tests/test_invite.py": "from app.invite import Inviter\n\ndef test_it():\n    assert Inviter\n",
    "app/broken.py": "def (:\n",
    "app/empty.py": None,
}


def test_python_facts_and_edges(spark):
    files = spark.createDataFrame([(p, t) for p, t in APP.items()], "path string, text string")
    facts = python_modules.parse(files).cache()
    assert [r.path for r in facts.where("fact = 'error'").collect()] == ["app/broken.py"]
    symbols = facts.where("fact = 'symbol'").withColumn("uid", F.concat_ws("#", "path", "qualname"))
    service = symbols.where("qualname = 'TokenService'").first()
    assert (service.kind, service.doc, service.methods, service.exported) == ("class", "Issues tokens.", ["create", "verify"], True)
    assert symbols.where("kind = 'route'").first().name == "POST /invites" and symbols.where("qualname = 'Invite'").first().table == "invites"
    table = files.select("path", F.col("path").alias("uid"), F.col("path").startswith("tests/").alias("is_test"))
    edges = {(r.src, r.rel, r.dst): r for r in resolution.edges_of(facts, symbols, table).collect()}
    t, i, u = "app/token.py#TokenService", "app/invite.py#Inviter", "app/util.py#"
    for e in [
        (i, "USES", t),
        (f"{i}.run", "CALLS", f"{t}.create"),
        (f"{i}.run", "CALLS", f"{u}slugify"),
        (f"{i}.run", "CALLS", f"{u}shout"),
        (f"{u}shout", "CALLS", f"{u}slugify"),
        (f"{t}.create", "CALLS", f"{t}.verify"),
        ("app/invite.py#post_invite", "CALLS", f"{i}.run"),
        ("app/invite.py#route:POST /invites", "HANDLES", "app/invite.py#post_invite"),
        ("app/models.py#Invite", "EXTENDS", "app/base.py#Base"),
        (f"{t}.create", "ACCESSES", "app/models.py#Invite"),
        ("tests/test_invite.py", "COVERS", i),
        ("app/invite.py", "IMPORTS", "app/token.py"),
        ("app/invite.py", "IMPORTS", "app/util.py"),
        (t, "HAS_MEMBER", f"{t}.create"),
        ("app/token.py", "DEFINES", t),
    ]:
        assert e in edges, e
    assert edges[i, "USES", t].via == "constructor" and edges[f"{t}.create", "ACCESSES", "app/models.py#Invite"].op == "rw"
    assert not [e for e in edges if e[0] == e[2]]
    assert resolution.edges_of(facts.where("false"), symbols.where("false"), table).count() == 0


def test_cards(spark):
    r = spark.sql("SELECT 'A' AS name, 'class' AS kind, 'a.ts' AS path, array('Service') AS roles, '' AS signature, array('x', 'y') AS methods, array() AS extends, cast(null AS string) AS tbl, 'does' AS doc, array('B') AS used_by")
    text = r.select(repository.card(*map(F.col, ("name", "kind", "path", "roles", "signature", "methods", "extends", "tbl", "doc", "used_by"))).alias("c")).first().c
    assert text == "A (class, Service) in a.ts\nMethods: x · y\nDoc: does\nUsed by: B"
    cases = "- {request: 'add teams', expect: [TeamService, TeamRepo], split: tune}\n- request: other thing\n  expect: [X]\n  split: holdout\n"
    assert [(c.request, c.expect, c.split) for c in repository.load_cases(spark, cases).collect()] == [("add teams", ["TeamService", "TeamRepo"], "tune"), ("other thing", ["X"], "holdout")]


def run_all(spark, df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("s1", "a", "2024-01-01 00:00:00"), ("s1", "b", "2024-01-01 00:00:00"), ("s2", "a", "2024-01-01 01:00:00"), ("s2", "b", "2024-01-01 01:00:00"), ("s2", "c", "2024-01-01 01:00:00")], "sha string, path string, at string").withColumn("at", F.to_timestamp("at"))
    rows.coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(source))
    assert sorted(r.sha for r in run_all(spark, streams.new_commits(stream()).select("sha"), "append", tmp_path, "commits_once")) == ["s1", "s2"]
    for _ in range(2):  # the second run finds nothing new and changes nothing
        streams.cochange_to_table(stream(), str(tmp_path / "co"), str(tmp_path / "co_state")).awaitTermination()
    assert {(r.a, r.b): r.n for r in spark.read.parquet(str(tmp_path / "co/v=00000000")).collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    steps = spark.createDataFrame([("f", "2024-01-01 00:00:01", "in_progress"), ("f", "2024-01-01 00:00:02", "done"), ("f", "2024-01-01 00:00:03", "verifying"), ("g", "2024-01-01 00:00:01", "abandoned")], "feature string, at string, status string")
    steps.coalesce(1).write.parquet(str(tmp_path / "steps"))
    states = run_all(spark, streams.feature_states(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps"))), "update", tmp_path, "feature_states")
    assert {r.feature: (r.status, r.moves, r.refused) for r in states} == {"f": ("done", 2, 1), "g": ("abandoned", 1, 0)}
    streams.event_log(stream(), str(tmp_path / "t"), str(tmp_path / "l"), str(tmp_path / "log_state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.json(str(tmp_path / "l")).count() == 5


def test_event_windows_stream_as_batches_do(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    small = events.select("ts", "event_type", "value", "user_id").where("user_id < 40")
    small.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(small.schema).parquet(str(tmp_path / "e"))
    got = run_all(spark, streams.windowed(stream, "6 hours", "3 hours"), "complete", tmp_path, "sliding")
    expected = streams.windowed(small, "6 hours", "3 hours").collect()
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, got)) == sorted(map(key, expected)) and len(got) > 10
    got = run_all(spark, streams.sessions(stream, "30 minutes"), "complete", tmp_path, "sessions")
    assert sorted(map(tuple, got)) == sorted(map(tuple, streams.sessions(small, "30 minutes").collect()))
