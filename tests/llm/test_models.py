"""Trained operators: held-out accuracy on the supplied tables, brute force for their parts, edge cases; the pipeline's stages."""

from __future__ import annotations

import re
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelift.llm import learning, lines, quality, rules, toxicity

from .conftest import EDGE

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def area(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def judged(out, labels, label):
    got = out.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    return np.array([r.score for r in got]), np.array([r[label] for r in got]), np.array([r.predicted for r in got])


def test_toxicity(tables):
    docs, labels = tables
    out = toxicity.scored(docs, toxicity.fit(docs, labels))
    score, y, predicted = judged(out, labels, "toxic")
    assert area(score, y) > 0.85 and ((score >= 0) & (score <= 1)).all() and (predicted[y == 0] == 0).mean() > 0.95
    held = {r.doc_id: r.held_out for r in out.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in held.items())


def test_quality_learns_from_long_texts(frame, spark):
    good, bad = "This is a sentence of some length, and it ends well.\n", "$$ ## 12 !!\n"
    docs = frame([(i, (good if i % 2 else bad) * (quality.STRETCH + 1 + i)) for i in range(60)] + [(i, "") for i in range(60, 80)])
    model = quality.fit(docs, spark.createDataFrame([(i, int(i < 60 and i % 2), 0) for i in range(80)], LABELS))
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > 0.8 and max(got[i] for i in [*range(0, 60, 2), 60]) < 0.2
    # a bound on lines keeps whole texts, in their order, and a model
    few = quality.fit(docs, spark.createDataFrame([(i, int(i < 60 and i % 2), 0) for i in range(80)], LABELS), line_bound=6 * quality.STRETCH)
    assert {r.predicted for r in quality.scored(docs.where("doc_id < 60 and doc_id % 2 = 1"), few).collect()} == {1}


def test_quality(tables):
    docs, labels = tables
    score, y, predicted = judged(quality.scored(docs, quality.fit(docs, labels)), labels, "quality")
    assert area(score, y) > 0.95 and (predicted == y).mean() > 0.9


def test_rules(spark, tables):
    docs, labels = tables
    out = rules.judged(docs, rules.fit(docs, labels))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    word = re.compile("[^\x20\x09-\x0d]+")
    for r in out.collect():
        x = text[r.doc_id]
        w = word.findall(x)
        times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
        held = [line for line in x.split("\n") if word.search(line)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(held) - len(set(held)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    both = out.join(labels, "doc_id").where("not base_failed")
    assert both.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.95
    assert both.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.4


@pytest.mark.parametrize("labelled", [[], [(4, 1, 1)], [(4, 1, 1), (6, 0, 0), (7, None, None), (4, 1, 1)]])
def test_edge_cases(spark, frame, labelled):
    docs, labels = frame(EDGE).withColumns({"label": F.lit(1), "score": F.lit("s"), "x": F.lit(2)}), spark.createDataFrame(labelled, LABELS)
    for out in (toxicity.scored(docs, toxicity.fit(docs, labels)), quality.scored(docs, quality.fit(docs, labels))):
        got = out.collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert rules.judged(docs, rules.fit(docs, labels)).count() == len(EDGE)
    none = docs.limit(0)
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == quality.scored(none, quality.fit(none, labels)).count() == rules.judged(none, rules.fit(none, labels)).count() == 0
    kept = toxicity.rejected_out(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns


@pytest.mark.parametrize("stretch", [1, 2, 3, 200])
def test_forward_backward(stretch):
    rng = np.random.default_rng(3)
    gain, change, first = rng.normal(size=6), rng.normal(size=(2, 2)), np.array([0, 4, 4, 6])
    p, pairs = quality.forward_backward(gain, first, change, stretch)
    want, want_pairs = np.zeros(6), np.zeros((2, 2))
    for a, z in ((0, 4), (4, 6)):
        n, total = z - a, 0.0
        own, own_pairs = np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            weight = np.exp(sum(gain[a + i] * y[i] for i in range(n)) + sum(change[y[i], y[i + 1]] for i in range(n - 1)))
            total += weight
            own += weight * np.array(y)
            for i in range(n - 1):
                own_pairs[y[i], y[i + 1]] += weight
        want[a:z] = own / total
        want_pairs += own_pairs / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_line_figures():
    got = lines.Lines([b"", b"Ab AB Ab\n\n#x 12!", "é é".encode()])
    assert got.first.tolist() == [0, 0, 2, 3] and got.words.tolist() == [3, 2, 2] and got.chars.tolist() == [8, 6, 3]
    x = dict(zip(lines.NAMES, got.x.T, strict=True))
    assert x["capitals"].tolist() == [4 / 8, 0, 0] and x["repeats of the word before"].tolist() == [0, 0, 0.5] and np.allclose(x["different words"], [2 / 3, 1, 0.5])


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    raw = learning.Trees(rounds=60).fit(x, y, np.ones(800)).raw(x)
    assert ((raw > 0) == (y > 0)).mean() > 0.95
    iso = learning.Isotonic().fit(raw, y, np.ones(800))
    grid = iso(np.linspace(raw.min(), raw.max(), 50))
    assert (np.diff(grid) >= 0).all() and abs(iso(raw).mean() - y.mean()) < 0.05


def test_forest():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 2)), [[8.0, 8.0]]])
    forest = rules.Forest.of(x)
    assert forest.anomaly(x).argmax() == 500
    assert rules.calibrated(np.array([0.1, 0.2, 0.3, 0.9]), np.array([True, True, True, False]), 8.0, 0.02) == pytest.approx(0.6)

    def walked(t, row):  # one row down one tree, node by node
        node = 0
        while forest.inner[t, node]:
            node = 2 * node + (1 if row[forest.feature[t, node]] <= forest.cut[t, node] else 2)
        return forest.length[t, node]

    want = [np.mean([walked(t, row) for t in range(len(forest.feature))]) for row in x[:20]]
    assert np.allclose(forest.paths(x[:20]), want) and np.allclose(forest.anomaly(x[:20]), 2.0 ** (-np.array(want) / rules.expected(256)))


def test_trees_draw_from_all_rows(spark):
    few = spark.range(100).selectExpr("id AS doc_id", "'x' AS text")
    got = [r["count"] for r in rules.drawn(few, 20, 256).select(F.explode("trees").alias("tree")).groupBy("tree").count().collect()]
    assert got == [100] * 20  # fewer rows than a tree wants: each tree has all
    many = spark.range(20_000).selectExpr("id AS doc_id", "concat('x', id) AS text")
    rows = rules.drawn(many, 20, 256).select("doc_id", F.explode("trees").alias("tree")).collect()
    times = Counter(r.tree for r in rows)
    assert len(times) == 20 and all(180 < n < 340 for n in times.values()) and len({(r.doc_id, r.tree) for r in rows}) == len(rows)
    nulls = spark.createDataFrame([(None, str(i)) for i in range(600)], "doc_id long, text string")
    assert 12 < len({r.text for r in rules.drawn(nulls, 2, 20).collect()}) < 80  # rows without an id are drawn like any other


def test_forest_and_threshold_come_from_all_rows(spark, frame):
    """More rows than trees once drew, and more labels than the threshold once took; trees by recursion over all rows, the threshold from all labels."""
    rng, n = np.random.default_rng(5), 7_000
    kinds = np.array([f"{w}{j}" for w in ("word", "Word", "and", "!", "#") for j in range(60)])
    text = [" ".join(rng.choice(kinds[: 150 + i % 151], 50 + i % 30)) for i in range(n)]
    good = np.array([i % 4 != 3 or i % 8 == 3 for i in range(n)])
    docs, labels = frame(list(enumerate(text))), spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], LABELS)
    model = rules.fit(docs, labels, trees=3, depth=4)
    base, x = rules.statistics([t.encode() for t in text])
    assert model.forest.rows == n and model.forest.length.shape == (3, 31)
    growth = rules.Growth(3, 4, x.shape[1])

    def check(t, node, depth, own):
        differs = own.max(0) > own.min(0) if len(own) else np.zeros(x.shape[1], bool)
        if depth == 4 or len(own) < 2 or not differs.any():
            assert not model.forest.inner[t, node] and model.forest.length[t, node] == pytest.approx(depth + rules.expected(len(own)))
            return
        rank, share = growth.drawn(t)
        f = max(np.flatnonzero(differs), key=lambda j: rank[node, j])
        cut = own[:, f].min() + (own[:, f].max() - own[:, f].min()) * share[node]
        assert model.forest.inner[t, node] and model.forest.feature[t, node] == f and model.forest.cut[t, node] == cut
        check(t, 2 * node + 1, depth + 1, own[own[:, f] <= cut])
        check(t, 2 * node + 2, depth + 1, own[own[:, f] > cut])

    for t in range(3):
        check(t, 0, 0, x)
    some = ~rules.failed(base)
    assert some.sum() > 6_000 and model.threshold == rules.calibrated(model.forest.anomaly(x[some]), good[some], 8.0, 0.02)
    few = rules.fit(docs, labels, trees=8, rows=100)  # subsamples only when asked to
    assert 60 < few.forest.rows < 150


def test_threshold_in_ranges_is_that_of_one_list(spark):
    rng = np.random.default_rng(2)
    for n, values, rare in ((0, 1, 0.5), (400, 60, 0.5), (400, 10_000, 0.1), (60, 1, 0.5), (300, 300, 0.0), (300, 300, 1.0)):
        good = rng.random(n) >= rare
        anomaly = np.round((rng.random(n) * np.where(good, 0.6, 1.0)) * values) / values
        known = spark.createDataFrame([(float(a), bool(g)) for a, g in zip(anomaly, good)], "anomaly double, good boolean")
        for price, lost in ((8.0, 0.02), (0.5, 0.5)):
            assert rules.threshold(known, price, lost) == (rules.calibrated(anomaly, good, price, lost) if n else math.inf)


def test_verdicts_by_brute_force(spark, tables):
    """kept is the base rules, and a walk down every tree of every text against the threshold."""
    docs, labels = tables
    model = rules.fit(docs, labels)
    some = {r.doc_id: r.text or "" for r in docs.limit(40).collect()}
    got = {r.doc_id: r for r in rules.judged(docs, model).collect() if r.doc_id in some}
    _, x = rules.statistics([t.encode() for t in some.values()])
    for (doc, _), row in zip(some.items(), x, strict=True):
        total = 0.0
        for feature, cut, length, inner in zip(model.forest.feature, model.forest.cut, model.forest.length, model.forest.inner, strict=True):
            node = 0
            while inner[node]:
                node = 2 * node + (1 if row[feature[node]] <= cut[node] else 2)
            total += length[node]
        anomaly = 2.0 ** (-total / len(model.forest.feature) / rules.expected(round(model.forest.rows)))
        assert got[doc].anomaly == pytest.approx(anomaly) and got[doc].kept == (not got[doc].base_failed and got[doc].anomaly <= model.threshold)


def test_pipeline(spark, tables):
    import corpus_pipeline as pipeline

    docs, _ = tables
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        before = after
    pieces = pipeline.STAGES[-1][1](spark, before, SF).cache()
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want"))
    assert whole.count() == before.count() and whole.where("n <> want").count() == 0
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_of_edge_rows(spark):
    """Nulls in any column, empty and very long texts, repeats, a clashing extra column; then no rows at all. Each stage against what it may do, row by row."""
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    rows = [(i, t, None if (i or 0) % 2 else "en", None, None if t is None else len(t), "r") for i, t in EDGE] + [(20, "write to a.b@c.org now", "en", "s", 22, None), (21, "one two three four five six seven " * 9, "en", "s", 306, "x"), (22, "one two three four five six seven " * 9, None, "s", 306, "y")]
    before = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == before.columns, name
        kept = Counter((r.doc_id, r.lang, r.source, r.row) for r in after.collect())
        assert not kept - Counter((r.doc_id, r.lang, r.source, r.row) for r in before.collect()), name
        before = after
    got = {(r.doc_id, r.text) for r in before.collect()}
    assert (1, None) in got and (2, "") in got and (20, "write to [EMAIL] now") in got and not any(d == 22 for d, _ in got) and any(d is None for d, _ in got)
    pieces = pipeline.STAGES[-1][1](spark, before, SF)
    assert pieces.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in pieces.where("start = 0").collect())
    none = before.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def read_off(calibration, raw):
    """An isotonic step function by hand: straight lines between its points, flat beyond."""
    x, y = list(calibration.x), list(calibration.y)
    if raw <= x[0]:
        return y[0]
    for (a, p), (b, q) in zip(zip(x, y), zip(x[1:], y[1:])):
        if raw <= b:
            return p + (q - p) * (raw - a) / (b - a)
    return y[-1]


def test_toxicity_scores_by_walking_the_trees(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    marks, trees = toxicity._Marks(model.lexicon.weights(None)), model.trees
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    for doc_id, text in ((r.doc_id, r.text) for r in docs.limit(40).collect()):
        x, raw = toxicity.features(text or "", marks), trees.base
        for r in range(trees.rounds):
            node = 0
            for _ in range(trees.depth):
                j, cut = trees.feature[r, node], trees.cut[r, node]
                node = 2 * node + (2 if sum(e < x[j] for e in trees.edges[j]) > cut else 1)
            raw += trees.leaf[r][node - (2**trees.depth - 1)]
        assert abs(got[doc_id] - read_off(model.calibration, raw)) < 1e-9


def test_quality_scores_by_enumerating_labels(tables, frame):
    docs, labels = tables
    model = quality.fit(docs, labels)
    rows = [(0, "One good line of words.\n$$ ### 12 !!\nand another one"), (1, "only one line here"), (2, "a b c\n\n \nd e f\ng!!!\n%% $$"), (3, "x " * 40 + "\n" + "Y. " * 9)]
    got = {r.doc_id: r.score for r in quality.scored(frame(rows), model).collect()}
    for k, text in rows:
        found = lines.Lines([text.encode()])
        z = (found.x - model.mean) / model.scale
        n, w = len(z), model.weights
        gain = []
        for i in range(n):
            around = [*z[i], *(z[i - 1] if i else np.zeros(lines.N)), *(z[i + 1] if i < n - 1 else np.zeros(lines.N)), float(i == 0), float(i == n - 1), 1.0]
            gain.append(sum(a * b for a, b in zip(around, w, strict=True)))
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            weight = math.exp(sum(g * v for g, v in zip(gain, y)) + sum(model.change[a, b] for a, b in zip(y, y[1:])))
            total += weight
            good += weight * np.array(y)
        raw = float((good / total * found.chars).sum() / found.chars.sum())
        assert abs(got[k] - read_off(model.calibration, raw)) < 1e-9
