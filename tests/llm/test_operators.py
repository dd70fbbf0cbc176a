"""Each corpus operator against brute force, and its defined results on hard cases."""

from __future__ import annotations

import glob
import hashlib
import os
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.helpers import HARD, LONG, clashing, hard_docs, no_docs
from lodegraph.llm import ann, bpe, chat, common, dartminhash, langid, license, mixing, queries, secret_scan, token_counts, topk


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# 1 language identification ------------------------------------------------------------------------------------------


def _kneser_ney(texts: list[str], order: int = 4):
    """Interpolated Kneser-Ney by dictionaries, as the operator defines it."""
    symbol = lambda t: [c if c != 32 else " " for c in langid.symbol_table()[np.frombuffer(t.encode("utf-32-le"), np.uint32)].tolist()]

    def grams(text):
        out, past = [], [" "] * (order - 1)
        for s in [*symbol(text), " "]:
            if s == " " and past[-1] == " ":
                continue
            out.append((*past, s))
            past = [*past[1:], s]
        return out

    counts = {order: Counter(g for t in texts for g in grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = one / (one + 2 * two) if one and two else 0.5
    total, kinds = defaultdict(int), defaultdict(int)
    for n, c in counts.items():
        for g, v in c.items():
            total[n, g[:-1]] += v
            kinds[n, g[:-1]] += 1

    def p(n, g, letters):
        d = discount[n]
        if n == 1:
            return max(counts[1][g] - d, 0) / total[1, ()] + d * len(counts[1]) / total[1, ()] / (letters + 1)
        lower = p(n - 1, g[1:], letters)
        t = total[n, g[:-1]]
        return lower if not t else max(counts[n][g] - d, 0) / t + d * kinds[n, g[:-1]] / t * lower

    letters = len(counts[1])
    return lambda text: -sum(np.log(p(order, g, letters)) for g in grams(text)) / len(grams(text))


def test_language_models_equal_brute_force(spark):
    texts = [t for _, t in [(i, " ".join(LONG.split()[i * 50 : i * 50 + 40])) for i in range(12)]]
    train = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    slow = _kneser_ney(texts)
    for t in ("the quick river", "zebra, quartz; dog!", "Old STONE wall 12 near", "ab"):
        assert model.models.cross_entropy([t])[0][0, 0] == pytest.approx(slow(t), rel=1e-4)


def test_language_models_keep_every_gram(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 1000))) for _ in range(2300)] + ["the quick river"] * 20
    train = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    keys, _ = langid.fit(train.repartition(8)).models.order[langid.ORDER]
    assert len(keys.keys) - 1 == len(np.unique(langid.grams(texts)[0])) > 2_200_000


def test_language_held_out_accuracy_and_fold(spark, sf):
    out = queries.op1_language_id(spark, sf).alias("o").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), "doc_id")
    seen = out.where("held_out and lang is not null and text rlike '[A-Za-z]{3}'").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    assert seen[0] > 0.97 and seen[1] >= 0 and seen[2] <= 1
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.select("doc_id", "held_out").collect())


def test_language_hard_cases(spark, docs):
    model = langid.fit(docs)
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(clashing(hard_docs(spark)), model).collect()]
    assert len(got) == len(HARD)
    assert {g[1] for g in got if g[0] in (2, 3, 5)} == {"und"} and all(g[2] for g in got if g[0] in (2, 3, 5))
    assert langid.identify(no_docs(spark), model).count() == 0
    nothing = langid.fit(no_docs(spark))
    assert {r.lang_pred for r in langid.identify(hard_docs(spark), nothing).collect()} == {"und"}
    kept = langid.keep_identified(clashing(hard_docs(spark)), model)
    assert kept.columns == clashing(hard_docs(spark)).columns and {r.doc_id for r in kept.collect()} & {2, 3, 5} == set()


def test_language_rejects_noise_and_keeps_clean(spark, docs):
    model = langid.fit(docs)
    rng = np.random.default_rng(0)
    noise = "".join(rng.choice(list("qxzwvkj"), 400))
    assert model.judge([noise])[3][0]
    clean = docs.where("length(text) > 200 and lang is not null")
    assert langid.keep_identified(clean, model).count() >= 0.98 * clean.count()


def test_language_limits_come_from_all_rows(spark):
    words, others = LONG.split(), "der schnelle braune fuchs springt heute weit hinter den alten zaun am fluss".split()
    texts = [(i if i % 2 else None, " ".join(words[i * 30 : i * 30 + 5 + i % 40]), "en") for i in range(400)]
    texts += [(None, " ".join(others[i:] + others[:i]), "de") for i in range(3)]
    model = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    ce, n = model.models.cross_entropy([t for _, t, _ in texts])
    ce, n, en = ce[np.arange(len(texts)), [model.models.langs.index(x) for *_, x in texts]], n, np.array([x == "en" for *_, x in texts])
    for rows, lang in ((en, "en"), (en | ~en, "de")):
        i, mean = model.models.langs.index(lang), np.average(ce[rows], weights=n[rows])
        z = np.sort((ce[rows] - mean) * np.sqrt(n[rows]))
        assert model.mean[i] == pytest.approx(mean)
        assert model.limit[i] == pytest.approx(2 * max(z[int(np.ceil(0.999 * len(z))) - 1], 1.0))
    noise = "".join(np.random.default_rng(0).choice(list("qxzwvkj"), 400)) + " " + " ".join(others)
    names, _, _, rejected = model.judge([noise])
    assert names == ["de"] and rejected[0]


# 2 licence scans ----------------------------------------------------------------------------------------------------


def test_licence_variants(spark):
    mit = dict((a, b) for a, b in license.KNOWN if b.startswith("MIT License"))["MIT"]
    variants = [mit, "Copyright (c) 2021 Someone\nAll rights reserved.\n" + mit, mit.upper(), mit.replace(",", " ,").replace("license", "licence"), "  " + mit.replace("\n", "\n\n")]
    other = [mit + " And one more condition.", "", None, "an ordinary text"]
    table = clashing(spark.createDataFrame([(i, t) for i, t in enumerate([*variants, *other, variants[0]])], "doc_id long, text string"))
    got = {(r.doc_id): r.license for r in license.scan_licenses(table.drop("license", "license_digest")).collect()}
    assert [got[i] for i in range(5)] == ["MIT"] * 5 and [got[i] for i in range(5, 9)] == [None] * 4 and got[9] == "MIT"
    assert license.scan_licenses(no_docs(spark)).count() == 0


def test_licence_spellings_and_typography(spark):
    words = dict((a, b) for a, b in license.KNOWN if b.startswith("Released"))["MIT"]
    mit = dict((a, b) for a, b in license.KNOWN if b.startswith("MIT License"))["MIT"]
    same = [words.replace("License", "Licence"), words.replace(" ", "\u00a0"), mit.replace('"', "\u201c").replace("AS IS", "AS\u2014IS"), "Copyright (c) Some One\n" + mit, "\u00a9 Some One\n" + mit, "Copyright by Some One\n" + mit]
    data = [(i, t) for i, t in enumerate(same)] + [(10, "licence licence licence sub licence"), (11, "license license license sublicense")]
    got = {r.doc_id: r for r in license.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(same))] == ["MIT"] * len(same)
    assert got[10].license_digest == got[11].license_digest


def test_licence_large_table_joins_alike(spark, docs, monkeypatch):
    small = sorted(map(tuple, license.scan_licenses(docs).collect()), key=str)
    monkeypatch.setattr(license, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, license.scan_licenses(docs).collect()), key=str) == small


def test_cut_leaves_no_shuffle_files(spark):
    """What a table was shuffled for goes with its lineage; the session's setting stays as it was."""
    env, setting = spark._jvm.org.apache.spark.SparkEnv.get(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = [d.toString() for d in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before, was = files(), spark.conf.get(setting, None)
    rows = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 997).alias("k")).count()
    for out in (common.cut(rows), common.cut(rows, 997)):
        assert out.count() == 997 and out.agg(F.sum("count")).first()[0] == 5000
    end = time.time() + 20
    shuffled = lambda: {f for f in files() - before if os.path.exists(f) and os.path.getsize(f) > 4000}
    while shuffled() and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() and spark.conf.get(setting, None) == was


# 3 mixing -----------------------------------------------------------------------------------------------------------


def _raked(tokens, codes, targets, rounds=20_000):
    """Plain proportional fitting: weights of cells."""
    x = tokens / tokens.sum()
    for _ in range(rounds):
        for c, t in zip(codes, targets):
            now = np.bincount(c, x, len(t))
            x = x * np.divide(t, now, out=np.ones_like(t), where=now > 0)[c]
    return x


def _mix_table(spark):
    """A null dimension, documents without words, values that nearly determine each other (slow to fit)."""
    rng = np.random.default_rng(5)
    cells = [(a, b, 400 if a == b else int(rng.integers(0, 3))) for a in range(4) for b in range(4)]
    data = [(i, " ".join(["w"] * n), "en" if a == b else "de" if a < 2 else None, f"s{a}", f"t{b}") for i, (a, b, n) in enumerate(cells)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, topic string").repartition(3), data


@pytest.mark.parametrize("values", [50_000, 0])
def test_mixing_equals_brute_force(spark, monkeypatch, values):
    """Both ways of joining factors; weights, shares reached and probabilities as plain fitting gives them."""
    monkeypatch.setattr(mixing, "BROADCAST_VALUES", values)
    table, data = _mix_table(spark)
    target = mixing.MixTarget((mixing.Marginal("source", power=0.2), mixing.Marginal("lang", (("en", 0.9), (None, 0.04))), mixing.Marginal("topic", power=0.9)), 0.7)
    tokens = np.array([len(t.split()) for _, t, *_ in data], float)
    codes, targets = [], []
    for k, m in ((3, target.marginals[0]), (2, target.marginals[1]), (4, target.marginals[2])):
        names = sorted({r[k] for r in data}, key=lambda x: (x is None, x or ""))
        codes.append(np.array([names.index(r[k]) for r in data]))
        targets.append(m.of(names, np.bincount(codes[-1], tokens, len(names))))
    assert targets[1] == pytest.approx([0.06, 0.9, 0.04])
    x = _raked(tokens, codes, targets)
    got = {r.doc_id: r for r in mixing.mix(table, target).collect()}
    for i, n in enumerate(tokens):
        assert got[i].n_tokens == n and got[i].gap < 1e-6
        if n:
            assert got[i].weight * n / tokens.sum() == pytest.approx(x[i], rel=1e-3, abs=1e-7)
    p = np.array([got[i].probability for i in range(len(data))])
    assert (p * tokens).sum() == pytest.approx(0.7 * tokens.sum()) and p.max() <= 1 and (p[tokens == 0] == 0.7).all()
    free = (p < 1) & (tokens > 0)
    ratio = p[free] / np.array([got[i].weight for i in np.flatnonzero(free)])
    assert ratio == pytest.approx(np.full(free.sum(), ratio[0]))


def test_mixing_tells_targets_out_of_reach(spark):
    data = [(i, "one two three", "en" if i % 2 else "de", "a" if i % 2 else "b", "t") for i in range(10)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, topic string")
    target = mixing.MixTarget((mixing.Marginal("source", (("a", 0.5), ("b", 0.5))), mixing.Marginal("lang", (("en", 0.8), ("de", 0.1), ("xx", 0.1)))))
    report = {(r.dimension, r.value): r for r in mixing.mix_report(table, target).collect()}
    assert report["lang", "xx"].reached == 0 and report["lang", "xx"].gap == 0.1
    assert report["lang", "en"].target == pytest.approx(0.8 / 0.9) and max(r.gap for r in report.values()) > 0.05


def test_topics_are_the_nearest_centres(spark, docs):
    model = mixing.fit_topics(docs)
    assert 2 <= len(model.centres) <= mixing.TOPICS
    for r in mixing.measured(docs.select("doc_id", "text"), "n", "topic", model).limit(300).collect():
        counts, n = mixing.hashed([r.text or ""])
        assert r.n == n[0] == len(re.findall(r"[^\W_]+", r.text or ""))
        sims = [(float((counts[0] * model.weight) @ c), -k) for k, c in enumerate(model.centres)]
        assert r.topic == (None if r.text is None else "none" if not n[0] else f"t{-max(sims)[1]}")
    two = [(i, ("river stone bridge water " if i % 2 else "market price trade bank ") * 5) for i in range(40)]
    table = spark.createDataFrame(two, "doc_id long, text string")
    got = mixing.measured(table, "n", "topic", mixing.fit_topics(table, 2)).collect()
    assert len({(r.doc_id % 2, r.topic) for r in got}) == 2 and len({r.topic for r in got}) == 2


def test_topics_are_learned_on_every_document(spark):
    """Weights and centres as plain k-means over all of several thousand documents gives them, however they are dealt."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{k % 5}x{w}" for w in rng.integers(0, 40, rng.integers(4, 30))) for k in range(6000)] + ["", None, "..."]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = [mixing.fit_topics(table.repartition(n), 4) for n in (3, 7)]
    counts = mixing.hashed([t for t in texts[:6000]])[0].astype(float)
    weight = np.log(6001 / (1 + (counts > 0).sum(0))) + 0.01
    assert models[0].weight == pytest.approx(weight, rel=1e-5)
    x = counts * weight / np.linalg.norm(counts * weight, axis=1, keepdims=True)
    x = x[np.lexsort(x.T[::-1])]
    centres = x[:1]
    while len(centres) < 4:
        centres = np.concatenate([centres, x[[(x @ centres.T).max(1).round(6).argmin()]]])
    for _ in range(mixing.TOPIC_ROUNDS):
        label = (x @ centres.T).argmax(1)
        sums = np.stack([x[label == k].sum(0) for k in range(4)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    centres = centres[np.argsort(-np.bincount((x @ centres.T).argmax(1)), kind="stable")]
    assert np.abs(models[0].centres - centres).max() < 1e-3
    assert all((getattr(models[0], c) == getattr(models[1], c)).all() for c in ("weight", "centres"))


def test_mixing_sample_follows_target(spark, sf):
    out = queries.op3_mixing(spark, sf)
    total = out.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability")), F.sum(F.when(F.col("sampled"), F.col("n_tokens"))), F.max("gap")).first()
    assert total[1] == pytest.approx(0.6 * total[0], rel=1e-6) and total[2] == pytest.approx(total[1], rel=0.2) and total[3] < 1e-6
    shares = {r.lang: r.x / total[0] for r in out.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("x")).collect()}
    named = dict(mixing.MixTarget().marginals[1].shares)
    assert shares["en"] / shares["de"] == pytest.approx(named["en"] / named["de"], rel=1e-4)


def test_mixing_hard_cases(spark):
    hard = clashing(hard_docs(spark)).withColumn("_mix_tokens", F.lit("clash")).withColumn("_mixsource", F.lit("clash"))
    out = mixing.mix(hard)
    assert out.count() == len(HARD) and out.where("probability is null").count() == 0
    assert {r.probability for r in out.where("n_tokens = 0").collect()} == {0.6}
    assert out.where("doc_id = 1").select("sampled").distinct().count() == 1 and mixing.sample_mixture(no_docs(spark)).count() == 0
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mix_report(no_docs(spark)).where("reached > 0").count() == 0
    assert mixing.sample_mixture(hard).columns == hard.columns


# 4 approximate neighbours, 10 exact top-k ---------------------------------------------------------------------------


def _vectors(spark, sf):
    got = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in got]), np.array([r.embedding for r in got], float)


def _recall(spark, table, x, every, k=10):
    """(share of true neighbours found, found pairs), scores checked; ids are row numbers."""
    got = defaultdict(dict)
    for r in ann.neighbours(table, table.where(F.col("vec_id") % every == 0), k).collect():
        got[r.query_id][r.vec_id] = r.score
    hits = total = 0
    assert set(got) == set(range(0, len(x), every))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:k]
        hits += len(set(best.tolist()) & set(found))
        total += len(best)
        assert all(s == pytest.approx(d[v], rel=1e-12, abs=1e-12) for v, s in found.items())
    return hits / total


def _visited(x, router):
    logits = router.logits(x)
    size = np.bincount(logits.argmax(1), minlength=router.parts)
    order = np.argsort(-logits, axis=1, kind="stable")[:, : router.probes]
    return size[order].sum(1).mean() / len(x)


@pytest.mark.parametrize("shape", ["clusters", "noise"])
def test_ann_partitions_and_recall(spark, shape):
    """On 20,000 vectors: parts, recall against brute force, and the share of rows that a query visits."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (60, 32))[rng.integers(0, 60, 20_000)] + 0.4 * rng.normal(0, 1, (20_000, 32)) if shape == "clusters" else rng.normal(0, 1, (20_000, 32))
    x = x.astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    router = ann.fit(x[rng.permutation(len(x))[: ann.sample_rows(len(x))]], len(x))
    assert router.parts == ann.parts_of(len(x)) > 50 and router.probes < router.parts
    assert _visited(x, router) < (0.15 if shape == "clusters" else 0.9)
    assert _recall(spark, table, x, 200) >= 0.9


def test_ann_partitions_small_tables(spark, sf):
    ids, x = _vectors(spark, sf)
    router = ann.fit(x, len(x))
    assert router.parts == ann.MIN_PARTS and router.probes < router.parts
    x = x[np.argsort(ids)]
    assert sorted(ids.tolist()) == list(range(len(x)))
    assert _recall(spark, spark.read.parquet(f"{sf}/embeddings.parquet"), x, 20) >= 0.9


def test_top_k_equals_brute_force(spark, sf):
    ids, x = _vectors(spark, sf)
    v = np.floor(256 * x).astype(np.int64)
    expected = set()
    for k in np.flatnonzero(ids % 50 == 0):
        s = v @ v[k]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[k]][:5]
        expected |= {(int(ids[k]), n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(order)}
    assert set(map(tuple, queries.op10_top_k(spark, sf).collect())) == expected


def test_vector_searches_hard_cases(spark):
    e = [1.0, 2.0, 2.0]
    data = [(0, e, 1), (0, e, 1), (50, None, 1), (100, [0.0, 0.0, 0.0], 2), (7, [1.0, None, 2.0], 2), (8, [1.0, float("nan"), 1.0], 3), (9, [float("inf"), 0.0, 0.0], 3), (10, e, 4), (11, e, 4), (12, [3.0, 2.0, 1.0], 5), (None, e, 5), (13, [], 6), (14, [1.0, 2.0], 6)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("v", F.lit("x")).withColumn("part", F.lit("x"))
    near = [tuple(r) for r in ann.neighbours(table, table.where("vec_id % 100 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert near == [(0, 1, 10, 0.0), (0, 2, 11, 0.0), (0, 3, 12, pytest.approx(5**0.5))]
    top = [tuple(r) for r in topk.top_k(table, table.where("vec_id % 50 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert top == [(0, 1, 10, 9 * 65536), (0, 2, 11, 9 * 65536), (100, 1, 0, 0), (100, 2, 0, 0)]  # a tie of three; repeated rows
    none = table.where("false")
    assert ann.neighbours(none, none, 3).count() == 0 and topk.top_k(none, none, 3).count() == 0


def test_cover_trees_split_and_prune():
    """Invariants of the tree, and pairs that pruning saves on clustered vectors."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 200, (40, 16))[rng.integers(0, 40, 4000)] + rng.normal(0, 10, (4000, 16)))
    tree = topk.cover_tree(x)
    leaf = tree.child == tree.last
    assert tree.leaves > 60 and (tree.end - tree.start)[leaf].max() <= topk.LEAF_ROWS
    assert sorted(tree.order[np.concatenate([np.arange(tree.start[i], tree.end[i]) for i in np.flatnonzero(leaf)])].tolist()) == list(range(len(x)))
    for i in range(len(leaf)):
        rows = tree.order[tree.start[i] : tree.end[i]]
        d = np.sqrt(((x[rows] - x[tree.centre[i]]) ** 2).sum(1))
        assert d.max() <= tree.radius[i] + 1e-9 and tree.centre[i] in rows
        if not leaf[i]:
            below = np.arange(tree.child[i], tree.last[i])
            assert tree.centre[below[0]] == tree.centre[i]
            centres = x[tree.centre[below]]
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1))[~np.eye(len(below), dtype=bool)]
            assert gaps.min() >= max(np.sqrt(((x[tree.order[tree.start[t] : tree.end[t]]] - x[tree.centre[t]]) ** 2).sum(1)).max() for t in below) - 1e-9
    seen, ids = topk.Visits(), np.arange(len(x))
    q, d, s = topk.dual_tree(ids[::5], x[::5], ids, x, 5, None, seen)
    assert seen.pruned > 0 and seen.multiplied < 0.2 * seen.pairs
    floor = np.array([np.sort(np.delete(x @ x[i], i))[-5] for i in ids[::5]])
    known = topk.Visits()
    again = topk.dual_tree(ids[::5], x[::5], ids, x, 5, floor, known)
    assert sorted(zip(*map(list, again))) == sorted(zip(q.tolist(), d.tolist(), s.tolist())) and known.multiplied <= seen.multiplied


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 7), st.integers(0, 1 << 30), st.sampled_from([1, 1 << 12, 3 << 29, 1 << 60]))
def test_dual_tree_equals_brute_force(n, k, seed, size):
    """Also where products outgrow a double, and a long: scores are cut to a long's range then."""
    rng = np.random.default_rng(seed)
    x = np.floor(rng.integers(-3, 4, (n * 9, 3)).astype(float) * size + rng.integers(0, 2, (n * 9, 3)))
    ids = rng.permutation(len(x))
    q, d, s = topk.dual_tree(ids[:n], x[:n], ids, x, k)
    got = sorted(zip(q.tolist(), d.tolist(), s.tolist()))
    whole = [[int(v) for v in row] for row in x.tolist()]
    expected = []
    for i in range(n):
        every = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[i], row)))), int(ids[j])) for j, row in enumerate(whole) if j != i)
        expected += [(int(ids[i]), j, -v) for v, j in every[:k]]
    assert got == sorted(expected)


# 5 byte-level BPE ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})


def test_bpe_equals_tiktoken(spark, docs, rows, encoding):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs).collect()}
    for doc, text in rows:
        ids = encoding.encode_ordinary(text)
        assert got[doc] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'stmrevld A9-")))), max_size=5))
def test_bpe_of_any_text(encoding, texts):
    vocabulary = bpe._vocabulary(open(bpe.default_path(), "rb").read())
    ids, counts, _ = vocabulary.encode(texts)
    assert ids.tolist() == [x for t in texts for x in encoding.encode_ordinary(t)]
    assert counts.tolist() == [len(encoding.encode_ordinary(t)) for t in texts]
    assert vocabulary.decode(ids).tobytes() == "".join(texts).encode()


def test_bpe_hard_cases(spark, encoding):
    got = bpe.round_trip_digests(clashing(hard_docs(spark))).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((d or -1, len(encoding.encode_ordinary(t or ""))) for d, t, *_ in HARD)
    back = bpe.decode_documents(bpe.encode_documents(hard_docs(spark))).collect()
    assert sorted((r.doc_id or -1, bytes(r.data)) for r in back) == sorted((d or -1, (t or "").encode()) for d, t, *_ in HARD)
    assert bpe.round_trip_digests(no_docs(spark)).count() == 0


# 6 secret scans -----------------------------------------------------------------------------------------------------

PLAIN = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def _base(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, rx, g, least) in enumerate(PLAIN) for m in rx.finditer(text) if len(m[g]) >= least)
    return [(kind, a, b) for a, _, b, kind in found]


def test_secrets_equal_plain_regexes(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = 0
    for r in queries.op6_secret_scan(spark, sf).collect():
        base = _base(texts[r.doc_id])
        n += len(base)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    assert n > 10


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_trigram_queries_miss_nothing(data):
    for rule in secret_scan.BASE + secret_scan.EXTRA:
        hit = data.draw(st.from_regex(re.compile(rule.pattern, rule.flags)))
        scanner = secret_scan.Scanner((rule,))
        assert [(a, b) for a, b, _ in scanner.scan(["none", hit, ""])[1]] == rule.spans(hit)


def test_secrets_hard_cases(spark):
    got = secret_scan.scan_secrets(clashing(hard_docs(spark))).collect()
    assert len(got) == len(HARD) and sum(len(r.spans) for r in got) == sum(len(_base(t or "")) for _, t, *_ in HARD)
    clean = secret_scan.redact_secrets(clashing(hard_docs(spark)))
    assert clean.columns == clashing(hard_docs(spark)).columns
    texts = [r.text for r in clean.collect()]
    assert sum(t is None for t in texts) == 2 and "[REDACTED:assign] and some more words follow here" in texts
    assert secret_scan.scan_secrets(no_docs(spark)).count() == 0


def test_secrets_are_redacted_whole(spark):
    body = "\n".join("MIIEvQIBADANBgkqhkiG9w0BAQEFAASC" + str(i) for i in range(40))
    keys = [f"-----BEGIN {k}PRIVATE KEY-----\n{body}\n" for k in ("", "RSA ", "SOME OTHER ")]
    logins = [f"https://{user}:{word}@" for user, word in (("oauth2", "t" * 500), ("u" * 200, "hunter2"), ("u", "abc"))]
    texts = [f"before {k}-----END PRIVATE KEY----- after" for k in keys] + [f"before {k}" for k in keys] + [f"before {x}host after" for x in logins]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in secret_scan.redact_secrets(table).orderBy("doc_id").collect()]
    assert got == ["before [REDACTED:private_key] after"] * 3 + ["before [REDACTED:private_key]"] * 3 + ["before [REDACTED:url_login]host after"] * 3
    two = f"{keys[0]}-----END PRIVATE KEY----- between {keys[1]}-----END RSA PRIVATE KEY-----"
    assert secret_scan.redact(two, secret_scan.Scanner(secret_scan.BASE + secret_scan.EXTRA).scan([two])[0]) == "[REDACTED:private_key] between [REDACTED:private_key]"


# 7 chat formatting --------------------------------------------------------------------------------------------------


def test_chat_round_trip_of_hard_texts(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|x", "<\\\\|im_end|>", "", None, "a\nb", "<|" * 3, "\U0001f600<|im_start|>"]
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)] + [(2, 0, "assistant", "x"), (3, None, None, None), (None, 0, "user", "q"), (4, 0, "us<er%\n", "t"), (5, 1, "user", "a"), (5, 1, "user", "a")]
    table = clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(table)).collect()}
    assert [t.text for t in got[1].turns] == [t or "" for t in hard] and got[1].valid and got[1].first_bad is None
    assert got[1].loss_text == "".join(t or "" for t in hard[1::2])
    assert not got[2].valid and got[2].first_bad == 0 and got[3].turns[0].role == "" and got[4].turns[0].role == "us<er%\n"
    assert len(got[5].turns) == 2 and got[5].first_bad == 1 and len(got[None].turns) == 1
    for r in got.values():
        assert all(s.role in ("assistant",) for s in r.segments if s.loss)


def test_chat_machine_has_states_of_its_own(spark):
    """A template in which a tool may be asked twice at most, which no pairs of roles can say."""
    moves = (("start", "user", "q"), ("q", "tool", "one"), ("one", "tool", "two"), ("q", "assistant", "end"), ("one", "assistant", "end"), ("two", "assistant", "end"))
    template = chat.ChatTemplate(moves=moves, ends=("end",))
    said = {1: "user tool tool assistant", 2: "user tool tool tool assistant", 3: "user tool", 4: "assistant user"}
    table = spark.createDataFrame([(c, i, r, f"{c} {i}") for c, roles in said.items() for i, r in enumerate(roles.split())], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.first_bad) for r in chat.format_chats(table, template).collect()}
    assert got == {1: (True, None), 2: (False, 3), 3: (False, None), 4: (False, 0)}


def test_chat_long_conversation(spark):
    """Twenty thousand turns of one conversation: positions are running sums."""
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    r = chat.parse_chats(chat.format_chats(turns)).first()
    assert len(r.turns) == 20_000 and r.valid and r.loss_text == "".join(f"t{i}" for i in range(1, 20_000, 2))
    assert all(r.formatted[s.start : s.end] == f"t{i}" for i, s in enumerate(r.segments))
    empty = chat.parse_chats(turns.limit(1).select(F.lit(None).cast("string").alias("formatted"), F.lit(None).cast("array<struct<start:int,end:int,role:string,loss:boolean>>").alias("segments"))).first()
    assert empty.turns is None


# 8 near duplicates --------------------------------------------------------------------------------------------------


def _shingles(text):
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return None
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])


def _classes(texts):
    sets = {d: s for d, t in texts if (s := _shingles(t))}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            by[g].add(d)
    for a, s in sets.items():
        for b in set().union(*(by[g] for g in s)):
            if a < b:
                both = sum((s & sets[b]).values())
                if both / (sum(s.values()) + sum(sets[b].values()) - both) >= 0.8:
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {d: find(d) if d in top else d for d, _ in texts}


def test_near_duplicates_equal_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in table.collect()]
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(table).collect()}
    expected = _classes(texts)
    wrong = [d for d in expected if got[d] != expected[d]]
    assert not wrong and any(d != c for d, c in got.items())


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Buckets go to the block path, and no link that joins components is lost."""
    monkeypatch.setattr(dartminhash, "OPEN_PAIRS", 10)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = []
    for i in range(160):
        own = list(base)
        for j in rng.integers(0, len(base), rng.integers(0, 5)):
            own[j] = f"v{rng.integers(0, 40)}"
        texts.append((i, " ".join(own)))
    texts += [(200 + i, texts[0][1]) for i in range(50)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(table).collect()}
    expected = _classes(texts)
    assert got == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.floats(0.5, 0.95))
def test_bitmaps_rule_out_no_similar_pair(seed, similarity):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 62, 400).astype(np.uint64) * np.uint64(3)
    base = rng.choice(pool, int(rng.integers(1, 200)), False)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(1, len(base) + 1))], rng.choice(pool, int(rng.integers(0, 30)))])) for _ in range(40)]
    maps = dartminhash.Bitmaps(sets)
    for x in sets[:8]:
        kept = set(maps.may_be_similar(x, similarity, np.arange(len(sets))).tolist())
        true = {i for i, y in enumerate(sets) if len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= similarity}
        assert true <= kept


def test_keep_one_loses_no_unique_text(spark):
    words = [f"w{i}" for i in range(40)]
    one, two, three = " ".join(words), " ".join(words[::-1]), " ".join(words[::2] + words[1::2])
    data = [(1, one), (5, one), (5, two), (None, one), (None, three), (None, three), (None, None), (None, None), (7, "")]
    table = spark.createDataFrame(data, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in dartminhash.keep_one(table).collect())
    assert kept == Counter([(1, one), (5, two), (None, three), (None, None), (None, None), (7, "")])
    got = Counter((r.doc_id, r.class_id, r.n_exact) for r in dartminhash.near_duplicates(table).collect())
    assert got == Counter([(1, 1, 3), (5, 1, 3), (5, 5, 1), (None, 1, 3), (None, None, 2), (None, None, 2), (None, None, 1), (None, None, 1), (7, 7, 1)])


def test_many_very_short_texts(spark):
    """Slices are bounded by texts as well as characters."""
    table = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 20_000).cast("string").alias("text"))
    assert dartminhash.near_duplicates(table).select("class_id").distinct().count() == 20_000


def test_near_duplicates_hard_cases(spark):
    got = dartminhash.near_duplicates(clashing(hard_docs(spark))).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.class_id)
    assert len(got) == len(HARD) and by[8] == by[4] == [4] and by[2] == [2] and by[3] == [3] and by[5] == [5] and by[1] == [1, 1]
    kept = dartminhash.keep_one(clashing(hard_docs(spark)))
    assert kept.columns == clashing(hard_docs(spark)).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 2, 3, 4, None, None, 5, 6, 7])
    assert dartminhash.near_duplicates(no_docs(spark)).count() == 0


# 9 token counts -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_equal_brute_force(spark, rows, encoding, rule):
    some = rows[:60]
    table = spark.createDataFrame(some, "doc_id long, text string")
    got = defaultdict(dict)
    for r in token_counts.count_sections(table, rule=rule).collect():
        got[r.doc_id][r.section] = (r.start, r.end, r.n_tokens)
    for doc, text in some:
        expected, at, data = Counter(), 0, text.encode()
        chars = [i for i, c in enumerate(text) for _ in c.encode()]
        line = np.cumsum([0] + [c == "\n" for c in text])
        for x in encoding.encode_ordinary(text):
            size = len(encoding.decode_single_token_bytes(x))
            own = [line[c] for c in sorted({chars[b] for b in range(at, at + size)})]
            expected[{"first": own[0], "last": own[-1], "largest": Counter(own).most_common(1)[0][0]}[rule]] += 1
            at += size
        assert at == len(data) and {k: v[2] for k, v in got[doc].items() if v[2]} == dict(expected)


def test_token_counts_of_overlapping_sections(spark):
    table = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    part = lambda name, a, b: f"named_struct('name', '{name}', 'start', {a}, 'end', {b})"
    alone = lambda *sections: {r.name: (r.start, r.end, r.n_tokens, r.n_crossing) for r in token_counts.count_sections(table.withColumn("s", F.expr(f"array({', '.join(sections)})")), "s").collect()}
    both = alone(part("a", 0, 12), part("b", 6, 16), part("c", 12, 22))
    for name, a, b in (("a", 0, 12), ("b", 6, 16), ("c", 12, 22)):
        assert both[name] == alone(part(name, a, b))[name]
    assert None not in both


def test_token_counts_hard_cases(spark, encoding):
    out = token_counts.count_sections(clashing(hard_docs(spark)))
    sums = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    expected = Counter()
    for d, t, *_ in HARD:
        expected[d] += len(encoding.encode_ordinary(t or ""))
    assert {r.doc_id: r.n for r in sums} == dict(expected)
    assert token_counts.count_sections(no_docs(spark)).count() == 0
    own = hard_docs(spark).withColumn("parts", F.expr("array(named_struct('name', 'head', 'start', 0, 'end', 3), null, named_struct('name', 'tail', 'start', 5, 'end', 1000000000))"))
    again = token_counts.count_sections(own, "parts").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in again} == dict(expected)


def test_batches_are_bounded_by_bytes(spark):
    """Long rows come in small batches, every row once; a bound of the session's own is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    def sizes():
        texts = spark.range(0, 64, 1, 1).select(F.expr("repeat('x', 1000000)").alias("text"))
        return [tuple(r) for r in common.map_texts(texts, run, "n long, size long").collect()]

    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        got = sizes()
        assert sum(n for n, _ in got) == 64 and max(size for _, size in got) < common.BATCH_BYTES + 2_000_000
        spark.conf.set(name, "3000000")
        assert max(n for n, _ in sizes()) <= 4 and spark.conf.get(name) == "3000000"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
