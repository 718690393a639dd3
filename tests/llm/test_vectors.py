"""Whitening and vector codes against plain numpy, and word codes against the tokenizers library."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelift.llm import queries, vector_codes, vectors, whitening, word_codes

from .conftest import EDGE

VECTORS = "vec_id long, embedding array<float>, label int"
BAD = [(900, None, 1), (901, [1.0, None] + [0.0] * 6, 2), (902, [float("nan")] * 8, None), (903, [float("inf")] + [0.0] * 7, 0), (904, [-float("inf")] * 8, 0), (905, [], 1)]


def drawn(n, dims=8, seed=0, scale=0.3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims))
    return [(int(i), [float(np.float32(x)) for x in scale * mix @ rng.normal(size=dims) + 0.1], int(i % 3) if i % 7 else None) for i in range(n)]


def test_whitening(spark):
    rows = drawn(300) + [drawn(300)[5]] * 150 + BAD  # a hot vector
    got = whitening.components(spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit(1), "n": F.lit("n"), "whitened": F.lit(None)}), most=5).collect()
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in kept], object)
    n, s = len(x), x.sum(0)
    apart = x * n - s
    v = (apart.T @ apart / n**3).astype(float)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == 5 * n and {r.n for r in got} == {n}
    want = (apart / n).astype(float) @ q / np.sqrt(e)
    deviation = (apart * apart).sum(1)
    by_id = {r[0]: i for i, r in enumerate(kept)}
    signs = {}
    for r in got:
        i = by_id[r.vec_id]
        w = want[i, r.component - 1]
        sign = signs.setdefault(r.component, 1 if r.whitened * w > 0 else -1)
        assert r.deviation == deviation[i] and abs(sign * r.whitened - w) < 1e-9 * max(1, abs(w)) and abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_pairs(spark):
    """Every pair of an odd and an even number of dimensions is summed."""
    for dims in (1, 2, 7, 8):
        x = np.random.default_rng(dims).integers(-50, 50, (40, dims))
        df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
        for kind in ("long", "decimal(38,0)"):
            assert np.array_equal(np.array(whitening.centred_products(df, "x", dims, list(range(dims)), kind)).astype(int), (x - np.arange(dims)).T @ (x - np.arange(dims)))


def test_whitening_of_large_values(spark):
    rows = drawn(200, scale=3e7)
    wide = whitening.fit(spark.createDataFrame(rows, VECTORS))
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows], object)
    apart = x * len(x) - x.sum(0)
    assert np.allclose(wide.values, np.linalg.eigvalsh((apart.T @ apart / len(x) ** 3).astype(float))[::-1], rtol=1e-12)
    # one value decides between 64-bit numbers and decimals; both give the same
    far = rows + [(999, [1e12] * 8, None)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in far], object)
    assert whitening.fit(spark.createDataFrame(far, VECTORS)).sums == tuple(x.sum(0))
    with pytest.raises(Exception, match="beyond 64 bits"):
        whitening.components(spark.createDataFrame(far, VECTORS))


def test_whitening_without_variance(spark):
    constant = [(i, [float(i), 5.0, 0.0, 0.0], 0) for i in range(9)]
    got = whitening.components(spark.createDataFrame(constant, VECTORS)).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and {r.explained for r in got} == {1.0}
    assert whitening.components(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, VECTORS)).collect() == []
    for rows in ([], BAD):
        assert whitening.components(spark.createDataFrame(rows, VECTORS)).collect() == []
    with pytest.raises(ValueError, match="1 to 2 components"):
        whitening.components(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], VECTORS))


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    x = [[math.floor(1024 * c) for c in v] for _, v, _ in kept]
    size = len(x[0]) // parts
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[x[i][p * size : (p + 1) * size] for i in first] for p in range(parts)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(e, part, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for v in x:
                part = v[p * size : (p + 1) * size]
                mine[nearest(books[p], part)[1]].append(part)
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(books[p], mine, strict=True)]
    out, errors = [], {}
    for (k, _, label), v in zip(kept, x, strict=True):
        found = [nearest(books[p], v[p * size : (p + 1) * size]) for p in range(parts)]
        error = sum(d for d, _ in found)
        errors[label] = errors.get(label, 0) + error
        out.append((k, "".join(f"{i:02x}" for _, i in found), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(k), c, e, errors[label], sha) for k, c, e, label in out)


@pytest.mark.parametrize("scale", [0.3, 3e5])
def test_vector_codes(spark, scale):
    rows = drawn(420, scale=scale) + [drawn(420, scale=scale)[7]] * 60 + [(None, [0.0] * 8, 1), (1000, [0.0] * 8, None), (1001, [-0.0001] * 8, 2)] + BAD
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, VECTORS).withColumns({"code": F.lit("c"), "v": F.lit(1), "_label": F.lit(2)}).repartition(3)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(df).collect()) == brute_codes(rows)


def test_annulus(monkeypatch):
    """Exact with ties and equal norms, and far fewer distances than all."""
    rng = np.random.default_rng(4)
    for entries, parts in ((rng.integers(-3, 4, (256, 4)), rng.integers(-4, 5, (700, 4))), (rng.normal(0, 400, (256, 16)).astype(np.int64), rng.normal(0, 300, (500, 16)).astype(np.int64)), (np.zeros((5, 4), np.int64), np.zeros((9, 4), np.int64))):
        book = vector_codes.Codebook(entries)
        all_of = ((parts[:, None] - entries[None]) ** 2).sum(2)
        for pairs in (1 << 18, 7):
            monkeypatch.setattr(vector_codes, "PAIRS", pairs)
            index, best, _ = book.nearest(parts)
            assert np.array_equal(index, all_of.argmin(1)) and np.array_equal(best, all_of.min(1))
    spread = (rng.normal(0, 1, (256, 4)) * np.linspace(1, 1000, 256)[:, None]).astype(np.int64)
    assert vector_codes.Codebook(spread).nearest(spread + 1)[2] < 0.35 * 256 * 256


def test_vector_codes_of_few_rows(spark):
    for rows in ([], BAD):
        assert vector_codes.compressed(spark.createDataFrame(rows, VECTORS)).collect() == []
    few = drawn(5)
    assert [(r.error, r.label_error) for r in vector_codes.compressed(spark.createDataFrame(few, VECTORS)).collect()] == [(0, 0)] * 5
    with pytest.raises(ValueError, match="6 components in 4 parts"):
        vector_codes.compressed(spark.createDataFrame([(1, [1.0] * 6, 0)], VECTORS))
    assert vectors.width(spark.createDataFrame([], VECTORS)) == 0


TEXTS = [*EDGE, (11, "Don't stop<|endoftext|>x<|STARTOFTEXT|>a<|startoftext|> it's 'S 'é"), (12, "İ ΟΔΟΣ Σ x≠y x≠y á ́b   z\u0085q"), (13, "a" * 3000 + " " + "ab" * 3000), (14, "한국 한 1234567 ²³")]


@pytest.mark.parametrize("block", [word_codes.BLOCK, 40])
def test_word_codes(frame, spark, block, monkeypatch):
    monkeypatch.setattr(word_codes, "IDS_AT_ONCE", 1 << 20 if block > 40 else 3)
    df = frame(TEXTS).withColumns({"ids": F.lit("i"), "block": F.lit(1), "decoded": F.lit(None)})
    got = word_codes.encoded(df, block=block)
    whole = word_codes.decoded(got, word_codes.pieces(spark))
    tokenizer = word_codes.tokenizer("word_bpe_49k.json")
    want = [(k, tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in TEXTS]
    want = sorted((str(k), ids, tokenizer.decode(ids, skip_special_tokens=False)) for k, ids in want)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in whole.collect()) == want
    assert sorted((str(r.doc_id), r.decoded) for r in word_codes.decoded(got, word_codes.pieces(spark), most=0).collect()) == [(k, t) for k, _, t in want]


def test_each_word_is_encoded_once(frame):
    """In a block's row every word has one number, and a slot sees each list once."""
    lists, seen, sizes, codes = word_codes._block([b"b a b", b"", b"c b"], 3)
    order, words = word_codes._order(word_codes._unpacked(seen, "u1")), []
    for _, data in sorted(lists):
        words += word_codes.zstandard.ZstdDecompressor().decompress(data).split(b"\n")
    assert [words[order[c]] for c in word_codes._unpacked(codes, "<u4")] == [b"b", b"a", b"b", b"c", b"b"] and list(word_codes._unpacked(sizes, "<u4")) == [3, 0, 2] and len(words) == 3


def test_word_codes_refuse_and_pass_over(spark, frame):
    with pytest.raises(ValueError, match="words by themselves"):
        word_codes.encoded(frame([(1, "a")]), vocabulary="byte_bpe_50k.json")
    assert word_codes.encoded(frame([])).collect() == []
    table = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (None, "n"), (3, None)], "id int, piece string")
    df = spark.createDataFrame([(1, [1, 2, 9, None, 1], "x"), (2, None, "y"), (3, [], None), (4, [3], "z")], "k int, ids array<int>, decoded string")
    for most in (0, 1 << 20):
        assert sorted((r.k, r.decoded) for r in word_codes.decoded(df, table, most=most).collect()) == [(1, "a a a"), (2, ""), (3, ""), (4, "")]
        assert word_codes.decoded(df.where("false"), table, most=most).collect() == []
        assert {r.decoded for r in word_codes.decoded(df, table.where("false"), most=most).collect()} == {""}


def test_queries(spark):
    base = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{base}/embeddings.parquet").collect()
    got = queries.op13_vector_codes(spark, base).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes([(r.vec_id, r.embedding, r.label) for r in source])
    n = len([r for r in source if r.embedding])
    turned = queries.op11_embedding_whitening(spark, base).collect()
    assert len(turned) == 32 * n and turned[0].identity_error < 1e-4
    tokenizer = word_codes.tokenizer("word_bpe_49k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    for r in queries.op12_word_bpe(spark, base).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
