"""From parsed facts to edges: imports to symbols, receivers to classes, references, calls and tables to edges.

Names are resolved by joins, round by round; modules that re-export a name are followed at most HOPS times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.graph import merge_edges
from lodegraph.operators.lineage import cut

HOPS = 4
#: Which way of using a class says most.
VIA = {"constructor": 0, "field": 1, "new": 2, "extends": 3, "reference": 4, "call": 5, "type": 6}


def module_candidates(imports: DataFrame) -> DataFrame:
    """path, local, imported, ord, target: the files that an import may mean, best first.

    In Python, relative imports start from the file's folder, one up for each dot but the first, and a from-import may name
    a module itself. In TypeScript and JavaScript, paths that begin with a dot are tried with each suffix, also in place
    of a written .js, and as folders with an index; other specifiers are packages."""
    script = F.col("path").rlike(SCRIPT)
    return _python_candidates(imports.where(~script)).unionByName(_script_candidates(imports.where(script)))


#: Suffixes of scripts in the order in which an import tries them.
SCRIPT, SUFFIXES = r"\.[cm]?[jt]sx?$", (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")


def _script_candidates(imports: DataFrame) -> DataFrame:
    ups = F.size(F.regexp_extract_all("module", F.lit(r"(\.\./)"), 1))
    rest = F.regexp_replace(F.regexp_replace("module", r"^(\.\.?/)+|^\.\.?$", ""), r"\.[cm]?jsx?$", "")
    folders = F.split("path", "/")
    base = F.array_join(F.concat(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1 - ups, F.lit(0))), F.filter(F.array(rest), lambda x: x != "")), "/")
    names = [*[F.concat(base, F.lit(s)) for s in SUFFIXES], *[F.concat_ws("/", F.nullif(base, F.lit("")), F.lit(f"index{s}")) for s in SUFFIXES[:4]]]
    tries = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(False).alias("is_module"), t.alias("target")) for i, t in enumerate(names)])
    x = imports.where(F.col("module").startswith(".")).select("path", "local", "imported", F.explode(tries).alias("t"))
    return x.select("path", "local", "imported", "t.ord", "t.is_module", "t.target")


def _python_candidates(imports: DataFrame) -> DataFrame:
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    folders = F.split("path", "/")
    base = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - F.greatest(dots, F.lit(1)), F.lit(0))), "/")
    join = lambda *xs: F.regexp_replace(F.regexp_replace(F.concat_ws("/", *xs), "/+", "/"), "^/|/$", "")
    whole = F.when(dots > 0, join(base, rest)).otherwise(rest)
    named = F.when(F.col("imported") != "*module", join(whole, F.col("imported")))
    tries = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(sub).alias("is_module"), t.alias("target")) for i, (t, sub) in enumerate([(F.concat(whole, F.lit(".py")), False), (join(whole, F.lit("__init__.py")), False), (F.concat(named, F.lit(".py")), True), (join(named, F.lit("__init__.py")), True)])])
    x = imports.select("path", "local", "imported", F.explode(F.filter(tries, lambda t: t["target"].isNotNull())).alias("t"))
    return x.select("path", "local", "imported", "t.ord", "t.is_module", "t.target")


def resolve_names(symbols: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, local, uid (of a symbol) or module (a file): what each name of a file means. symbols: uid, path, name, parent.

    A file's own top-level symbols come first; then what its imports name, through modules that import it themselves, at
    most HOPS of them; cycles end there. Of several the smallest (order, uid) counts."""
    top = symbols.where("parent is null and kind <> 'route'").groupBy("path", F.col("name").alias("local")).agg(F.min("uid").alias("uid"))
    found = module_candidates(imports).join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    whole = found.where("imported = '*module' or is_module").groupBy("path", "local").agg(F.min_by("target", "ord").alias("module"))
    open_ = cut(found.where("imported <> '*module' and not is_module").select("path", "local", F.col("imported").alias("name"), "target", "ord"))
    stars = open_.where("name = '*'").select(F.col("path").alias("target"), F.col("target").alias("through"))
    solved = []
    step = open_.where("name <> '*'").select("path", "local", "name", "target", F.col("ord").cast("int").alias("ord"))
    for hop in range(HOPS + 1):
        hit = step.join(top.select(F.col("path").alias("target"), F.col("local").alias("name"), "uid"), ["target", "name"])
        solved.append(hit.select("path", "local", (F.lit(hop * 10) + F.col("ord")).alias("ord"), "uid"))
        if hop < HOPS:
            again = open_.where("name <> '*'").select(F.col("path").alias("target"), F.col("local").alias("name"), F.col("name").alias("to_name"), F.col("target").alias("to"))
            named = step.join(again, ["target", "name"]).select("path", "local", F.col("to_name").alias("name"), F.col("to").alias("target"), "ord")
            step = named.union(step.join(stars, "target").select("path", "local", "name", F.col("through").alias("target"), "ord")).distinct()
            step = cut(step)
    imported = reduce(DataFrame.union, solved).groupBy("path", "local").agg(F.min(F.struct("ord", "uid")).alias("b")).select("path", "local", "b.uid")
    own = top.select("path", "local", "uid")
    names = own.union(imported.join(own, ["path", "local"], "left_anti"))
    return names.withColumn("module", F.lit(None).cast("string")).union(whole.join(names, ["path", "local"], "left_anti").select("path", "local", F.lit(None).cast("string").alias("uid"), "module"))


def receiver_types(calls: DataFrame, facts: DataFrame, names: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, qualname, name, line_start, class_uid, resolution of calls with a receiver: self is the own class, self.x its
    field's type; x a parameter, a local, a constant made of a class, a class itself or a module. In that order."""
    typed = facts.where("fact in ('param', 'local')").groupBy("path", "qualname", F.col("name").alias("_n")).agg(F.min("target").alias("t_type"))
    fields = facts.where("fact = 'field'").groupBy("path", F.col("qualname").alias("_class"), F.col("name").alias("_n")).agg(F.min("target").alias("f_type"))
    consts = symbols.where("kind = 'const' and target is not null").select("path", F.col("name").alias("_n"), F.col("target").alias("c_type")).dropDuplicates(["path", "_n"])
    x = calls.where("receiver is not null").select("path", "qualname", "name", "receiver", "line_start").withColumn("_class", F.regexp_extract("qualname", r"^(.*)\.[^.]+$", 1)).withColumn("_n", F.regexp_replace("receiver", r"^(self|cls)\.", ""))
    x = x.join(typed, ["path", "qualname", "_n"], "left").join(fields, ["path", "_class", "_n"], "left").join(consts, ["path", "_n"], "left")
    own = F.col("receiver").isin("self", "cls")
    by_self = F.col("receiver").rlike(r"^(self|cls)\.")
    kind = F.when(own, "self").when(by_self & F.col("f_type").isNotNull(), "field").when(~by_self & F.col("t_type").isNotNull(), "param").when(~by_self & F.col("c_type").isNotNull(), "const").when(~by_self, "static")
    wanted = F.when(own, F.col("_class")).when(by_self, F.col("f_type")).otherwise(F.coalesce("t_type", "c_type", "_n"))
    x = x.withColumn("resolution", kind).withColumn("local", wanted)
    return x.join(names.select("path", "local", F.col("uid").alias("class_uid"), "module"), ["path", "local"], "left").select("path", "qualname", "name", "line_start", "class_uid", "module", "resolution")


def edges_of(facts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, rel, via, n, op of all edges that the facts of files give: DEFINES, HAS_MEMBER, IMPORTS between files, USES,
    EXTENDS, CALLS (and the USES that calls imply), ACCESSES, HANDLES and, from test files, COVERS.

    symbols: uid, path, qualname, kind, name, parent, target. files: uid, path, is_test. What isn't resolved gives no edge;
    edges to oneself are dropped; equal edges are one (best via, number, rw)."""
    names = resolve_names(symbols, facts.where("fact = 'import'"), files)
    names = cut(names)
    by_name = symbols.groupBy("path", "qualname").agg(F.min("uid").alias("uid"))
    own = lambda df: df.join(by_name.withColumnRenamed("uid", "src"), ["path", "qualname"])
    part = lambda df, rel, via=None, op=None: df.select("src", "dst", F.lit(rel).alias("rel"), (F.col("via") if via is None else F.lit(via)).alias("via"), (F.col("op") if op else F.lit(None).cast("string")).alias("op"))
    to = names.where("uid is not null").select("path", F.col("local").alias("target"), F.col("uid").alias("dst"))
    refs = own(facts.where("fact in ('ref', 'param') and qualname is not null")).join(to, ["path", "target"])
    kept = own(facts.where("fact = 'field'")).join(to, ["path", "target"])
    owner = symbols.where("parent is not null").join(by_name.select("path", F.col("qualname").alias("parent"), F.col("uid").alias("owner")), ["path", "parent"]).select("uid", "owner", F.col("name").alias("method"))
    received = cut(own(receiver_types(facts.where("fact = 'call' and qualname is not null"), facts, names, symbols)))
    direct = received.join(owner.select(F.col("owner").alias("class_uid"), F.col("method").alias("name"), F.col("uid").alias("dst")), ["class_uid", "name"])
    through = received.join(symbols.where("parent is null").select(F.col("path").alias("module"), "name", F.col("uid").alias("dst")), ["module", "name"])
    bare = own(facts.where("fact = 'call' and receiver is null and qualname is not null").withColumn("target", F.col("name"))).join(to, ["path", "target"])
    ids = files.select("path", F.col("uid").alias("file"))
    modules = names.select("path", F.col("module").alias("to")).union(names.where("uid is not null").join(symbols.select("uid", F.col("path").alias("to")), "uid").select("path", "to")).where("to is not null and to <> path").distinct()
    imports = modules.join(ids, "path").withColumnRenamed("file", "src").join(ids.select(F.col("path").alias("to"), F.col("file").alias("dst")), "to")
    tests = names.where("uid is not null").join(files.where("is_test").select("path", F.col("uid").alias("src")), "path").join(symbols.select("uid", F.col("path").alias("_p")), "uid").where("_p <> path").withColumnRenamed("uid", "dst")
    routes = symbols.where("kind = 'route'").select(F.col("uid").alias("src"), "path", F.col("target").alias("qualname")).join(by_name.withColumnRenamed("uid", "dst"), ["path", "qualname"])
    # a route without a handler of its own is handled by the first method that it calls
    named = routes.select("src").distinct()
    called = direct.join(symbols.where("kind = 'route'").select(F.col("uid").alias("src")), "src", "left_semi").join(named, "src", "left_anti").groupBy("src").agg(F.min("dst").alias("dst"))
    routes = routes.select("src", "dst").union(called)
    tables = own(facts.where("fact = 'table' and qualname is not null")).join(to, ["path", "target"])
    every = [
        part(symbols.where("kind <> 'method'").join(ids, "path").select(F.col("file").alias("src"), F.col("uid").alias("dst")), "DEFINES", ""),
        part(owner.select(F.col("owner").alias("src"), F.col("uid").alias("dst")), "HAS_MEMBER", ""),
        part(imports, "IMPORTS", ""),
        part(refs.where("via = 'extends'"), "EXTENDS"),
        part(refs.where("via <> 'extends'").unionByName(kept), "USES"),
        part(direct.select("src", "dst").union(through.select("src", "dst")).union(bare.select("src", "dst")), "CALLS", "call"),
        part(received.where("class_uid is not null").select("src", F.col("class_uid").alias("dst")), "USES", "call"),
        part(tables, "ACCESSES", "", True),
        part(routes, "HANDLES", ""),
        part(tests, "COVERS", ""),
    ]
    return merge_edges(reduce(DataFrame.unionByName, every).where("src <> dst"), VIA)
