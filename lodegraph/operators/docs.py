"""Document operators: lines, sections, chunks, rules, decision records, mentions, similar titles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.redact import redact_text, redacted
from lodegraph.functions.text import adr_number, base_name, relevance, title_tokens
from lodegraph.operators.graph import listed, unlisted

CHUNK_CHARS, OVERLAP = 3200, 400
RULE_WORDS = r"(?i)\b(must|never|always|do not|don't|should not|shouldn't|only)\b"
#: Words of a decision's status, and the knowledge status that each means.
STATUS = {"accepted": "validated", "approved": "validated", "adopted": "validated", "proposed": "candidate", "draft": "candidate", "deprecated": "deprecated", "superseded": "superseded", "rejected": "rejected"}


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n (from 1), line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section, heading, head_line, start, body: cut at headings outside code fences. A fence is open after an odd number of
    fence lines; a section is numbered by the headings before it. What stands before the first heading is section 0."""
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = lines(docs, key, text).withColumn("fence", F.col("line").rlike(r"^\s*(```|~~~)"))
    x = x.withColumn("inside", F.sum(F.col("fence").cast("int")).over(w) % 2 == 1)
    x = x.withColumn("is_head", ~F.col("inside") & ~F.col("fence") & F.col("line").rlike(r"^#{1,6}\s+\S"))
    x = x.withColumn("section", F.sum(F.col("is_head").cast("int")).over(w))
    g = x.groupBy(key, "section").agg(
        F.max(F.when(F.col("is_head"), F.trim(F.regexp_replace("line", r"^#+\s+", "")))).alias("heading"),
        F.max(F.when(F.col("is_head"), F.col("line"))).alias("head_line"),
        F.min("n").alias("start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("n", "line")))), lambda l: l["line"]), "\n").alias("body"),
    )
    return g.where((F.trim("body") != "") | F.col("heading").isNotNull())


def pack_sections(parts: list[tuple[str | None, int, str]], limit: int = CHUNK_CHARS, overlap: int = OVERLAP) -> Iterator[tuple[str, int, str]]:
    """(heading, line, text): neighbouring sections together while they fit, under the first one's heading and line.

    What outgrows a chunk is cut at its last line break past the half, else at the limit; what follows begins `overlap`
    before the cut, and takes in the next sections that fit."""
    text, name, line = "", "", 1
    for heading, start, body in parts:
        if not (body := body.strip()):
            continue
        if text and len(text) + len(body) + 2 > limit:
            yield name, line, text.strip()
            text = ""
        name, line = (name, line) if text else (heading or "", start)
        text = f"{text}\n\n{body}" if text else body
        while len(text) > limit:
            at = max(text.rfind("\n", 0, limit), 0)
            at = at if 2 * at > limit else limit
            yield name, line, text[:at].strip()
            text = text[max(0, at - overlap) :]
    if text.strip():
        yield name, line, text.strip()


def chunks(docs: DataFrame, key: str, text: str = "text", limit: int = CHUNK_CHARS, redact: bool = True) -> DataFrame:
    """key, index, heading, line_start, text. Packing carries state from section to section, so it is a function over a
    document's own sections; documents don't meet and nothing is shuffled but lines of one document."""
    whole = F.concat_ws("\n", F.col("head_line"), F.when(F.col("body") != "", F.col("body")))
    per_doc = sections(docs, key, text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "heading", "start", whole.alias("body")))).alias("parts"))
    kind = dict(docs.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, parts in zip(frame[key], frame["parts"]):
                packed = pack_sections([(p["heading"], p["start"], p["body"]) for p in parts], limit)
                rows += [(k, i, h, s, redact_text(t) if redact else t) for i, (h, s, t) in enumerate(packed)]
            yield pd.DataFrame(rows, columns=[key, "index", "heading", "line_start", "text"])

    return per_doc.mapInPandas(run, f"{key} {kind}, index int, heading string, line_start int, text string")


def next_links(rows: DataFrame, group: str, order: str, uid: str) -> DataFrame:
    """src, dst: each row's predecessor in its group and the row."""
    w = Window.partitionBy(group).orderBy(order, uid)
    return rows.select(F.lag(uid).over(w).alias("src"), F.col(uid).alias("dst")).where("src is not null")


def rules(docs: DataFrame, key: str, text: str = "text", most: int = 20) -> DataFrame:
    """key, n, rule: the first lines of 12 to 240 characters that say must, never, always and the like; no headings,
    tables, quotes or code; list marks go."""
    w = Window.partitionBy(key).orderBy("n")
    x = lines(docs, key, text).withColumn("fence", F.trim("line").startswith("```"))
    x = x.withColumn("inside", F.sum(F.col("fence").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    x = x.withColumn("rule", F.regexp_replace(F.trim("line"), r"^([-*+]|[0-9]+\.) +", ""))
    ok = ~F.col("inside") & ~F.col("fence") & ~F.col("rule").rlike(r"^[#|>]") & F.length("rule").between(12, 240) & F.col("rule").rlike(RULE_WORDS)
    return x.where(ok).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "n", "rule")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def decision_records(docs: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """key, adr_id, title, status, context, decision, consequences (redacted, at most 1000 characters), supersedes and
    superseded_by of decision records. Documents without a number, in the file name (if `path` names a column) or in the
    title, are none.

    The status is that of the first known word of the status section, else of a `status:` line; a record that states
    none at all is validated, one that states an unknown word a candidate. `superseded by` anywhere wins. Null texts are
    empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    first = F.regexp_extract(whole, r"(?m)^# (.*)$", 1)
    file = base_name(F.col(path)) if path else F.lit(None).cast("string")
    numbers = lambda rx: F.array_distinct(F.transform(F.regexp_extract_all(whole, F.lit(rx), 1), lambda n: F.concat(F.lit("ADR-"), F.lpad(n.cast("int").cast("string"), 3, "0"))))
    line = F.nullif(F.regexp_extract(whole, r"(?im)^\s*\**status\**\s*[:=]\s*(.+)$", 1), F.lit(""))
    about = docs.select(
        F.col(key),
        F.coalesce(adr_number(file), adr_number(F.concat(F.lit("# "), first))).alias("adr_id"),
        F.trim(F.regexp_replace(first, r"(?i)^\s*(adr[-_ ]?[0-9]+\s*[:.-]\s*)?", "")).alias("_title"),
        line.alias("_line"),
        numbers(r"(?i)\bsupersedes\s+\[?adr[-_ ]?([0-9]{1,4})").alias("supersedes"),
        numbers(r"(?i)superseded\s+by\s+\[?adr[-_ ]?([0-9]{1,4})").alias("superseded_by"),
    ).where("adr_id is not null")
    s = sections(docs, key, text).withColumn("h", F.lower(F.coalesce("heading", F.lit(""))))
    part = lambda name: F.max_by("body", F.when(F.col("h") == name, F.col("section")))
    parts = s.groupBy(key).agg(*[part(n).alias(f"_{n}") for n in ("status", "context", "decision", "consequences")])
    said = F.coalesce(F.nullif(_stripped(F.col("_status")), F.lit("")), F.col("_line"))
    words = F.split(F.lower(said), "[^a-z]+")
    table = F.create_map(*[F.lit(v) for kv in STATUS.items() for v in kv])
    known = F.get(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull()), F.lit(0))
    status = F.when(F.size("superseded_by") > 0, "superseded").when(said.isNull(), "validated").otherwise(F.coalesce(known, F.lit("candidate")))
    short = lambda n: F.substring(redacted(_stripped(F.coalesce(f"_{n}", F.lit("")))), 1, 1000).alias(n)
    title = redacted(F.when(F.col("_title") == "", F.col("adr_id")).otherwise(F.col("_title")))
    return about.join(parts, key, "left").select(key, "adr_id", title.alias("title"), status.alias("status"), short("context"), short("decision"), short("consequences"), "supersedes", "superseded_by")


def anchored(text: str, words: int) -> Column:
    """All runs of so many space-separated words; null where a text ends before."""
    w = F.split(text, " ")
    out = w
    for j in range(1, words):
        out = F.zip_with(out, F.slice(w, F.lit(j + 1), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def mentions(docs: DataFrame, names: DataFrame, key: str, text: str, words: int = 4) -> DataFrame:
    """key, uid: documents that hold a name (uid, name) as a substring that begins at a word.

    An equi-join on the name's first words finds candidates, and `contains` verifies; no document meets every name."""
    anchor = F.array_join(F.slice(F.split("name", " "), 1, words), " ")
    n = names.select("uid", "name", F.least(F.size(F.split("name", " ")), F.lit(words)).alias("k"), anchor.alias("anchor")).where("name <> ''")
    sizes = [r["k"] for r in n.select("k").distinct().collect()]
    out = None
    for k in sizes:
        # the last word may go on, so the anchor stops before it where the name is that short
        m = max(1, k - 1)
        mine = n.where(F.col("k") == k).withColumn("anchor", F.array_join(F.slice(F.split("name", " "), 1, m), " "))
        part = docs.select(key, F.explode(F.array_distinct(anchored(text, m))).alias("anchor")).join(mine, "anchor").select(key, "uid", "name")
        out = part if out is None else out.union(part)
    return out.distinct().join(docs.select(key, text), key).where(F.col(text).contains(F.col("name"))).select(key, "uid")


def similar_titles(rows: DataFrame, uid: str, title: str, least: float = 0.8) -> DataFrame:
    """a, b, similarity of titles whose word sets have at least this Jaccard similarity.

    Titles of one word set are one: only sets are compared, and the members of similar sets are paired from lists. Prefix
    filter: sorted by rarity, similar sets share one of their first n - ceil(least n) + 1 words, so only those words are
    join keys."""
    titles = rows.select(F.col(uid).alias("uid"), F.array_sort(title_tokens(F.col(title))).alias("words")).where(F.size("words") > 0)
    sets = titles.select("words").distinct()
    tokens = sets.select("words", F.explode("words").alias("w"))
    freq = tokens.groupBy("w").agg(F.count("*").alias("f"))
    ordered = tokens.join(freq, "w").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o"))
    keep = F.size("o") - F.ceil(F.size("o") * F.lit(least)).cast("int") + 1
    prefix = ordered.select("words", F.explode(F.slice("o", F.lit(1), keep)).alias("p")).select("words", F.col("p.w").alias("w"))
    pairs = prefix.withColumnRenamed("words", "x").join(prefix.withColumnRenamed("words", "y"), "w").where("x <= y").select("x", "y").distinct()
    score = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    pairs = pairs.withColumn("similarity", score).where(F.col("similarity") >= least)
    lists = listed(titles, "words", "uid").withColumn("_list", F.array_min("items"))
    left, right = lists.toDF("x", "p", "_i"), lists.toDF("y", "q", "_j")
    met = pairs.join(left, "x").join(right, "y").where("x < y or _i <= _j")
    out = unlisted(met, "p", "q", "a", "b").where("x < y and a <> b or _i < _j and a <> b or a < b")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def established(decisions: DataFrame, knowledge: DataFrame, least: float = 0.3) -> DataFrame:
    """a (decision), b (knowledge), score: overlap coefficients of their word sets, at least two words shared, found by
    joining on words. Only different word sets are compared, and members of those that agree are paired from lists."""
    d = decisions.select(F.col("uid").alias("a"), F.array_sort(title_tokens(F.col("text"))).alias("x"))
    k = knowledge.select(F.col("uid").alias("b"), F.array_sort(title_tokens(F.col("text"))).alias("y"))
    mine, theirs = d.select("x").distinct(), k.select("y").distinct()
    pairs = mine.select("x", F.explode("x").alias("w")).join(theirs.select("y", F.explode("y").alias("w")), "w").groupBy("x", "y").agg(F.count("*").alias("shared")).where("shared >= 2")
    pairs = pairs.select("x", "y", relevance(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= least)
    met = pairs.join(listed(d, "x", "a").withColumnRenamed("items", "p"), "x").join(listed(k, "y", "b").withColumnRenamed("items", "q"), "y")
    return unlisted(met, "p", "q", "a", "b").select("a", "b", "score")
