"""Near-duplicates, repeated units and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelift.llm import components, minhash, units

from .conftest import EDGE


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return {(k, len(sets[i]), None if k is None else least[top(i)], True if k is None else k == least[top(i)]) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [1024, 16])
def test_classes(frame, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, base = random.Random(3), [f"w{i}" for i in range(80)]
    rows = [r for r in EDGE if len(r[1] or "") < 10_000]
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(80)] = f"x{rng.random()}"
        rows.append((1000 + i, " ".join(w)))
    df = frame(rows).withColumns({"cluster": F.lit("c"), "id": F.lit(1), "label": F.lit(None)})
    assert {tuple(r) for r in minhash.classes(df, size=3, percent=85).collect()} == brute(rows, 3, 85)
    left = minhash.deduplicated(df, size=3, percent=85)
    assert left.columns == df.columns and left.where("doc_id >= 1000").count() == sum(k for d, _, _, k in brute(rows, 3, 85) if (d or 0) >= 1000)


def test_no_documents(frame):
    assert minhash.classes(frame([])).count() == 0 and units.repeats(frame([])).count() == 0


def test_banding_misses_few():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands, rows = minhash.banding(t)
        assert (1 - t**rows) ** bands <= 1e-6 * 1.01


def test_both_ends_estimate_similarity():
    """Minima and maxima agree with the chance of the sets' similarity."""
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = both[:3000], both[1000:]
    s = minhash.Signatures(400, 1)
    x, y = s.of([a])[0][0], s.of([b])[0][0]
    assert abs((x == y).mean() - 2000 / 4000) < 0.09


def test_agreement_misses_few():
    """Pairs exactly at the threshold agree in more values than are asked for, and pairs far below it in fewer."""
    for t, size in ((0.85, 3), (0.8, 5)):
        bands, rows = minhash.banding(t)
        least, rng = minhash.agreement(t, bands * rows), np.random.default_rng(size)
        s = minhash.Signatures(bands, rows)
        for same, low, high in ((t, least, bands * rows), (0.35, 0, least - 1)):
            both = round(2000 * same / (1 + same))
            for _ in range(60):
                base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
                x, y = s.of([base[:1000], np.concatenate([base[:both], base[2000 : 3000 - both]])])[1]
                assert low <= (x == y).sum() <= high


def test_chains_of_weak_candidates_are_cut(frame):
    """Sets that share bands through common text only form no cluster."""
    n = [100, 100, 100]
    sketches = [bytes([1] * 180), bytes([1] * 60 + [2] * 120), bytes([3] * 60 + [2] * 120)]
    assert minhash.alike(n, sketches, [0, 0, 0], 85, 118) == [(1, 2)] and minhash.alike([100, 70, 100], sketches, [0, 0, 0], 85, 118) == [] and minhash.alike(n, sketches, [0, 1, 1], 85, 118) == []


def test_links_across_sides_only():
    sets = [np.arange(100, dtype=np.uint64), np.arange(100, dtype=np.uint64) + np.uint64(2), np.arange(1000, 1100, dtype=np.uint64)]
    assert minhash.linked(sets, [0, 0, 0], 85) == [(0, 1)] and minhash.linked(sets, [0, 1, 1], 85) == [(0, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(100, 0), (None, 3), (5, 5)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for i in range(1, 40):
        assert got[i] == (0 if i == 0 else (i - 1) // 9 * 9 + 1)
    assert got[100] == got[0] == 0 and components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, least):
    seen, out = set(), []
    for d, t in rows:
        run, gone, total = [], [], 0
        us = list(units.units(t or ""))
        for start, end, said, words in [*us, (0, 0, None, 0)]:
            if said is not None and said in seen:
                run.append((start, end, words))
                total += 1
            else:
                if sum(w for _, _, w in run) >= least:
                    gone += [(a, z) for a, z, _ in run]
                run = []
            if said is not None:
                seen.add(said)
        out.append((d, len(us), total, [tuple(x) for x in gone]))
    return out


def test_repeats(frame):
    rng = random.Random(5)
    sentences = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(rng.randint(2, 9))) + rng.choice([".", "!", "?"]) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(sentences) + rng.choice(["", "\n"]) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(90, None), (91, ""), (92, "...  !?\n\n")]
    got = sorted((r.doc_id, r.n_units, r.n_repeats, [(s.start, s.end) for s in r.removed]) for r in units.repeats(frame(rows), unit="sentence", passage_words=12).collect())
    assert got == brute_repeats(rows, 12)
    df = frame(rows).withColumns({"removed": F.lit("old"), "row": F.lit(1)})
    clean = {r.doc_id: (r.text, r.removed) for r in units.without_repeats(df, unit="sentence", passage_words=12).collect()}
    text = dict(rows)
    for d, _, _, gone in got:
        want = text[d]
        for a, z in reversed(gone):
            want = want[:a] + want[z:]
        assert clean[d][0] == want and [(s.start, s.end) for s in clean[d][1]] == gone


def test_whole_lines_go(frame):
    rng = random.Random(9)
    sentences = [" ".join(rng.choice(["ab", "Cd", "ef", "é"]) for _ in range(rng.randint(1, 4))) + rng.choice([".", "!", "", "?!"]) for _ in range(25)]
    rows = [(i, "".join(rng.choice(sentences) + rng.choice([" ", "\n", "\n \n"]) for _ in range(rng.randint(0, 20)))) for i in range(40)] + [(90, None), (91, "\n\n")]
    plain = brute_repeats(rows, 12)
    seen, more = set(), 0
    for d, n, total, gone in plain:
        text, at, own = dict(rows)[d] or "", 0, set(gone)
        for line in text.split("\n"):
            us = list(units.units(line))
            if us and (key := tuple(x[2] for x in us)) in seen:
                own |= {(at + a, at + z) for a, z, _, _ in us}
            elif us:
                seen.add(key)
            at += len(line) + 1
        more += len(own) - len(gone)
        plain[[p[0] for p in plain].index(d)] = (d, n, total, sorted(own))
    got = sorted((r.doc_id, r.n_units, r.n_repeats, [(s.start, s.end) for s in r.removed]) for r in units.repeats(frame(rows), passage_words=12).collect())
    assert got == plain and more > 10
    assert units.repeats(frame(EDGE), passage_words=30).count() == len(EDGE) and units.repeats(frame([]), passage_words=30).count() == 0


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_repeated_units_go(frame, unit):
    rng = random.Random(15)
    said = ["One two.", "one  two. ", "Three", "é four", "\tFive six", "", " ", "seven eight nine ten", "..."]
    rows = [(i, "\n".join(rng.choice(said) for _ in range(rng.randint(0, 14)))) for i in range(50)] + [(90, None), (91, "\n\n"), (92, "\n one two.\n"), (92, "\n one two.\n"), (None, "Three"), (93, "x " * 30_000 + "\nThree")]
    seen, want, judged = set(), [], {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if (d, t) not in judged:
            us, gone = list(units.whole_units(t or "", unit)), []
            for a, z, norm, _ in us:
                gone += [(a, z)] if norm in seen else []
                seen.add(norm)
            judged[d, t] = (d, len(us), len(gone), gone)
        want.append(judged[d, t])
    want.append((None, 1, 0, []))
    got = [(r.doc_id, r.n_units, r.n_removed, [(s.start, s.end) for s in r.removed]) for r in units.repeats(frame(rows), unit=unit).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(len(w[3]) for w in want) > 20
    clean = units.without_repeats(frame(rows).withColumns({"removed": F.lit(1), "key": F.lit("k"), "row": F.lit(2)}), unit=unit).collect()
    for r in clean:
        text, spans = next((t, judged.get((d, t), (0, 0, 0, []))[3]) for d, t in rows if d == r.doc_id)
        for a, z in reversed(spans):
            text = text[:a] + text[z:]
        assert r.text == text


def test_texts_of_one_id(frame):
    """Texts with one id do not make each other's lines repeats, and are not cut at each other's places."""
    got = {r.n_units: [(s.start, s.end) for s in r.removed] for r in units.repeats(frame([(1, "a\nb"), (1, "zz\na\na")])).collect()}
    assert got == {2: [], 3: [(5, 6)]}


def test_repeats_of_edge_cases(frame):
    got = {(r.doc_id, r.n_units) for r in units.repeats(frame(EDGE)).collect()}
    assert (None, 1) in got and (1, 0) in got and units.repeats(frame(EDGE)).count() == units.repeats(frame(EDGE), unit="sentence").count() == len(EDGE)
