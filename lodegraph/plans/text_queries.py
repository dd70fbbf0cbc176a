"""Text functions and document operators on parts, documents, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import embed, redact, text
from lodegraph.operators import docs, store
from lodegraph.plans.registry import Tables, query

_WORDS = r"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"""
_SINGULAR = """CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%sses' THEN left(w, length(w) - 2)
 WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END"""
_CUT = " ".join(f"WHEN length(w) > {len(s) + 2} AND w LIKE '%{s}' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - {len(s)}) || '{k}'" for s, k in (("ies", "y"), ("ing", ""), ("ed", ""), ("es", "e"), ("s", "")))
_STEM = f"CASE WHEN length(CASE {_CUT} ELSE w END) > 4 THEN regexp_replace(CASE {_CUT} ELSE w END, 'e+$', '') ELSE CASE {_CUT} ELSE w END END"


@query(f"SELECT p_partkey AS uid, array_to_string({_WORDS.format(x=chr(34) + 'p_name' + chr(34) + ' || p_type')}, ' ') AS name_tokens, len({_WORDS.format(x='p_name')}) AS n_words FROM part")
def text_name_tokens(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("uid"), text.name_tokens(F.concat("p_name", "p_type")).alias("name_tokens"), F.size(text.split_words(F.col("p_name"))).cast("long").alias("n_words"))


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents)
SELECT w AS word, count(*) AS n, {_SINGULAR} AS singular, {_STEM} AS stem FROM w WHERE w <> '' GROUP BY w""")
def text_word_forms(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", "n", text.singular(F.col("word")).alias("singular"), text.stem(F.col("word")).alias("stem"))


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (
SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '', 'g') AS s FROM pages)""")
def text_slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.slug(F.col("url")).alias("slug"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages), d AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, path, CASE WHEN len(parts) <= 1 THEN '.' WHEN parts[1] IN ('src', 'apps', 'packages', 'lib', 'app', 'services', 'libs', 'modules') AND len(parts) > 2 THEN parts[1] || '/' || parts[2] ELSE parts[1] END AS module,
 CASE WHEN regexp_matches(path, '^(\.|/|node:)') OR path = '' THEN NULL WHEN path LIKE '@%' AND len(parts) > 1 THEN parts[1] || '/' || parts[2] ELSE string_split(parts[1], '.')[1] END AS package FROM d""")
def page_paths(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))
    return p.select("page_id", "path", text.module_path_of(F.col("path")).alias("module"), text.package_name(F.col("path")).alias("package"))


_GRAMS = f"""w AS (SELECT item_id, pos, {_STEM} AS s FROM (SELECT item_id, generate_subscripts(ws, 1) AS pos, lower(unnest(ws)) AS w FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z][a-z0-9]*|[0-9]+') AS ws FROM benchmark))),
g AS (SELECT item_id, s AS g FROM w UNION ALL SELECT a.item_id, a.s || '_' || b.s FROM w a JOIN w b ON a.item_id = b.item_id AND b.pos = a.pos + 1),
h AS (SELECT item_id, sha256(g) AS h FROM g),
v AS (SELECT item_id, CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) % 256 AS INTEGER) AS idx, sum(CASE WHEN substr(h, 1, 1) >= '8' THEN -1.0 ELSE 1.0 END) AS v FROM h GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1)"""


@query(f"WITH {_GRAMS} SELECT item_id, idx, round(CAST(v / norm AS DOUBLE), 6) AS weight FROM v JOIN n USING (item_id) WHERE v <> 0")
def hash_embed_sparse(t: Tables) -> DataFrame:
    return embed.sparse_embedding(t.benchmark, "item_id", "text", 256).select("item_id", "idx", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_GRAMS}, x AS (SELECT item_id, idx, v / norm AS w FROM v JOIN n USING (item_id) WHERE v <> 0)
SELECT a.item_id AS a, b.item_id AS b, round(CAST(sum(a.w * b.w) AS DOUBLE), 6) AS similarity FROM x a JOIN x b ON a.idx = b.idx AND a.item_id < b.item_id GROUP BY 1, 2 HAVING abs(sum(a.w * b.w)) >= 0.3""")
def hash_embed_cosine(t: Tables) -> DataFrame:
    """Similar items: sparse vectors joined on their dimensions."""
    x = embed.sparse_embedding(t.benchmark, "item_id", "text", 256)
    pairs = x.withColumnRenamed("item_id", "a").join(x.select(F.col("item_id").alias("b"), "idx", F.col("weight").alias("w")), "idx").where("a < b")
    return pairs.groupBy("a", "b").agg(F.sum(F.col("weight") * F.col("w")).alias("s")).where(F.abs("s") >= 0.3).select("a", "b", F.round("s", 6).alias("similarity"))


@query(r"""WITH k AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{32,}')) AS token FROM documents),
c AS (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM k), f AS (SELECT doc_id, token, ch, count(*) AS n FROM c GROUP BY 1, 2, 3)
SELECT doc_id, token, round(-sum(n / length(token) * log2(n / length(token))), 6) AS entropy FROM f GROUP BY 1, 2""")
def entropy_tokens(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9+/=_-]{32,})"), 1))).alias("token"))
    return k.select("doc_id", "token", F.round(redact.entropy(F.col("token")), 6).alias("entropy"))


@query()
def redact_documents(t: Tables) -> DataFrame:
    """Overlapping patterns with look-behind values: tested against a fixture, not SQL."""
    return t.documents.select("doc_id", redact.redacted(F.col("text")).alias("text"), redact.contains_secret(F.col("text")).alias("had_secret"))


@query(r"""WITH o AS (SELECT doc_id // 2 AS k, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id // 2 AS k, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h FROM documents WHERE doc_id % 2 = 1)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'A' WHEN n.k IS NULL THEN 'D' ELSE 'M' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.h IS DISTINCT FROM n.h""")
def sha_change_set(t: Tables) -> DataFrame:
    side = lambda r: t.documents.where(F.col("doc_id") % 2 == r).select(F.floor(F.col("doc_id") / 2).cast("long").alias("k"), text.content_hash(F.col("text")).alias("h"))
    return store.change_set(side(0), side(1), "k", "h")


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedupe_hash(t: Tables) -> DataFrame:
    return t.documents.select(F.sha2("text", 256).alias("digest"), "doc_id").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
f AS (SELECT *, sum(CASE WHEN trim(line) LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) % 2 AS inside, regexp_replace(trim(line), '^([-*+]|[0-9]+\.) +', '') AS rule FROM l),
r AS (SELECT doc_id, n, rule, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rank FROM f WHERE inside = 0 AND trim(line) NOT LIKE '```%' AND NOT regexp_matches(rule, '^[#|>]') AND length(rule) BETWEEN 12 AND 240
 AND regexp_matches(rule, '(?i)\b(must|never|always|do not|don''t|should not|shouldn''t|only)\b'))
SELECT doc_id, CAST(n AS INTEGER) AS n, rule FROM r WHERE rank <= 20""")
def prose_rules(t: Tables) -> DataFrame:
    return docs.rules(t.documents, "doc_id")


@query(r"""WITH l AS (SELECT page_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT page_id, string_split(regexp_replace(html, '<h([1-6])[^>]*>', chr(10) || '# ', 'g'), chr(10)) AS ls FROM pages)),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n) AS section FROM l)
SELECT page_id, CAST(section AS BIGINT) AS section, CAST(min(n) AS INTEGER) AS start, count(*) AS n_lines FROM s GROUP BY 1, 2 HAVING max(CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 1 ELSE 0 END) = 1 OR trim(coalesce(string_agg(line, chr(10)), '')) <> ''""")
def doc_sections(t: Tables) -> DataFrame:
    """Pages by their headings, written as marks."""
    marked = t.pages.select("page_id", F.regexp_replace("html", "<h([1-6])[^>]*>", "\n# ").alias("text"))
    s = docs.sections(marked, "page_id")
    return s.select("page_id", "section", "start", (F.size(F.split("body", "\n")).cast("long") + F.when(F.col("heading").isNotNull(), F.when(F.col("body") == "", 0).otherwise(1)).otherwise(0)).alias("n_lines"))


@query()
def doc_chunks(t: Tables) -> DataFrame:
    return docs.chunks(t.documents, "doc_id")


@query("""SELECT src, dst FROM (SELECT lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS src, conv_id * 1000 + turn AS dst FROM conversations) WHERE src IS NOT NULL""")
def next_chunk(t: Tables) -> DataFrame:
    return docs.next_links(t.conversations.withColumn("uid", F.col("conv_id") * 1000 + F.col("turn")), "conv_id", "turn", "uid")


@query("SELECT doc_id, item_id AS uid FROM documents d JOIN benchmark b ON contains(' ' || d.text, ' ' || b.text)")
def describes_mentions(t: Tables) -> DataFrame:
    names = t.benchmark.select(F.col("item_id").alias("uid"), F.col("text").alias("name"))
    return docs.mentions(t.documents, names, "doc_id", "text")


_TOK = "list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > 2))"


@query(f"""WITH s AS (SELECT p_partkey AS uid, {_TOK.format(x="p_name || ' ' || p_type || ' ' || p_brand")} AS w FROM part)
SELECT a.uid AS a, b.uid AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM s a JOIN s b ON a.uid < b.uid
WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.8""")
def title_duplicates(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("uid"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))
    return docs.similar_titles(rows, "uid", "title").withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH d AS (SELECT item_id AS a, {_TOK.format(x='text')} AS x FROM benchmark), k AS (SELECT p_partkey AS b, {_TOK.format(x="p_name || ' ' || p_type || ' the and of to that'")} AS y FROM part)
SELECT a, b, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) AS score FROM d JOIN k ON len(list_intersect(x, y)) >= 2 AND len(list_intersect(x, y)) / least(len(x), len(y)) >= 0.3""")
def establishes_relevance(t: Tables) -> DataFrame:
    k = t.part.select(F.col("p_partkey").alias("uid"), F.concat_ws(" ", "p_name", "p_type", F.lit("the and of to that")).alias("text"))
    return docs.established(t.benchmark.select(F.col("item_id").alias("uid"), "text"), k).withColumn("score", F.round("score", 6))
