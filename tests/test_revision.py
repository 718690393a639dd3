"""Revisions of formatted runs and of paged documents."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from pagelift.operators import revision
from pagelift.plans import catalog, revisions  # noqa: F401  (registers the queries)

RUNS = "k string, run_no int, text string, bold boolean, face string"


def runs(rng, text):
    out, at = [], 0
    while at < len(text):
        n = rng.randrange(1, 9)
        out.append((text[at : at + n], rng.random() < 0.4, rng.choice(["a", "b", None])))
        at += n
    return out


def by_position(rows, *kinds, was=False):
    """Every character of a revision with its format."""
    return [(c, *(r.was if was and r.change == "same" else r.format)) for r in rows if r.change in kinds for c in r.text]


def test_stretches():
    assert list(revision.changed_stretches("a b  c", "a x c ")) == [("same", 0, 0, 1), ("del", 1, None, 2), ("ins", None, 1, 2), ("del", 3, None, 2), ("ins", None, 3, 1), ("same", 5, 4, 1), ("ins", None, 5, 1)]
    assert list(revision.changed_stretches("", "")) == [] and list(revision.changed_stretches("", " ")) == [("ins", None, 0, 1)] and list(revision.changed_stretches("é 漢", "é 漢")) == [("same", 0, 0, 3)]


def test_revised_runs(spark):
    rng = random.Random(5)
    old, new = {}, {}
    for i in range(40):
        words = [rng.choice(["aa", "b", "cc", "dé", "🙂"]) + rng.choice(["", "."]) for _ in range(rng.randrange(0, 14))]
        edited = [w for w in words if rng.random() < 0.8] + rng.sample(["new", "word"], rng.randrange(0, 3))
        old[f"k{i}"], new[f"k{i}"] = "  ".join(words), rng.choice([" ", "  "]).join(edited)
    old |= {"gone": "only here", None: "null key"}
    new |= {"come": "only there", None: "null key!"}
    rows = [[(k, n, *r) for k, t in side.items() for n, r in enumerate(runs(rng, t))] for side in (old, new)]
    rows[0] += [("k1", 90, None, True, "a"), ("k1", 91, "", True, "a"), ("empty", 0, None, False, "a")]
    before, after = (spark.createDataFrame(r, RUNS).withColumns({"change": F.lit("x"), "pos": F.lit(1)}).repartition(3) for r in rows)
    got = revision.revised_runs(before, after, ("k",), ("bold", "face")).collect()
    assert {r.k for r in got} == {k for k, t in (old | new).items() if t or old.get(k)}
    for k in {*old, *new}:
        own = sorted((r for r in got if r.k == k), key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(1, len(own) + 1)) and all(r.text for r in own)
        for side, kinds, was in ((rows[0], ("same", "del"), True), (rows[1], ("same", "ins"), False)):
            assert by_position(own, *kinds, was=was) == [(c, b, f) for key, _, t, b, f in side if key == k for c in t or ""]
        assert all((r.was is None) == (r.change != "same") for r in own)
    assert revision.revised_runs(before.where("false"), after.where("false"), ("k",), ("bold",)).collect() == []


def test_document_changes(spark):
    kind = "d string, page int, seq int, key string, signature string"
    old = [("d", 1, 0, "title", "s"), ("d", 1, 1, "moves across", "s"), ("d", 1, 2, "same", "s"), ("d", 1, 3, "twice", "s"), ("d", 2, 0, "twice", "s"), ("d", 2, 1, "one two", "s"), ("d", 2, 2, None, "s"), ("d", 3, 0, "page goes", "s"), (None, None, 0, "x", "s")]
    new = [("d", 1, 0, "title", "t"), ("d", 1, 1, "same", "s"), ("d", 1, 2, "twice", "s"), ("d", 2, 0, "one three", "s"), ("d", 2, 1, "moves across", "s"), ("d", 2, 2, None, "s"), ("d", 4, 0, "page comes", "s"), (None, None, 0, "x", "s")]
    layouts = [spark.createDataFrame([("d", 1, (z, 0)), ("d", 2, ("top", 1))], "d string, page int, layout struct<zone:string,n:int>") for z in ("top", "bottom")]
    got = revision.document_changes(*(spark.createDataFrame(x, kind).withColumn("kind", F.lit(1)) for x in (old, new)), keys=("d",), pages=tuple(layouts)).orderBy("change_no").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("page", 1, None, 1, None, 0, 0), ("formatted", 1, 0, 1, 0, 0, 0), ("replaced", 2, 0, 2, 0, 1, 2), ("moved", 1, 1, 2, 1, 0, 0), ("removed", 2, 1, None, None, 2, 0), ("removed", 3, 0, None, None, 2, 0), ("added", None, None, 4, 0, 0, 2),
    ]
    assert [r.change_no for r in got] == list(range(1, len(got) + 1)) and {r.d for r in got} == {"d"}
    assert revision.document_changes(*(spark.createDataFrame([], kind) for _ in range(2)), keys=("d",)).collect() == []


def test_page_revisions_of_long_documents(spark, tmp_path):
    """From line 347 on, a line that moves across pages and one that moves within them may come to stand on one place of one page."""
    texts = ["\n".join(f"{'ab'[n % 3 % 2]} {n if d else n % 5}" for n in range(900)) for d in range(2)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(catalog.ORACLE_SQL["page_revisions"])
    got = catalog.QUERIES["page_revisions"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
