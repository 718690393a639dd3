"""Blocks to publications: the canonical body, images, chapters, archives read back."""

from __future__ import annotations

import base64
import io
import random
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from pagelift.operators import export, package

BLOCKS = "doc_id long, seq int, type string, text string, level int, format string, lines int, src string, alignment string"
PNG = base64.b64encode(b"\x89PNG\r\n\x1a\n" + bytes(range(40))).decode()


def test_canonical_is_idempotent(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.choice(["paragraph", "heading", "list_item", "break", "space", "image", "odd", None]), rng.choice([None, "", "  a  b ", "x"]), rng.choice([None, -4, 0, 3, 99]), rng.choice([None, "decimal"]), rng.choice([None, 0, 5, 40]), "s", rng.choice([None, "left", "center", "up"])) for d in range(8) for i in range(25)]
    once = export.canonical(spark.createDataFrame(rows, BLOCKS)).cache()
    assert sorted(map(tuple, export.canonical(once).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    got = once.collect()
    assert all(r.text for r in got if r.type in ("paragraph", "heading", "list_item")) and all(2 <= r.lines <= 12 for r in got if r.type == "space") and {r.alignment for r in got} == {"left", "center"}
    assert all(1 <= r.level <= 6 for r in got if r.type == "heading") and all(0 <= r.level <= 8 for r in got if r.type == "list_item")


def test_exported_archives(spark):
    def b(doc, seq, kind, text=None, level=None, src=None):
        return doc, seq, kind, text, level, None, 3, src, None

    rows = [
        b(1, 0, "paragraph", "Before & after"), b(1, 1, "heading", "One", 1), b(1, 2, "paragraph", "Text <of> one"), b(1, 3, "image", src=f"data:image/png;base64,{PNG}"), b(1, 4, "image", src=f"data:image/png;base64,{PNG}"),
        b(1, 5, "image", src="data:image/png;base64,AAAA"), b(1, 6, "heading", "Two", 1), b(1, 7, "list_item", "item", 1), b(1, 8, "space"), b(1, 9, "break"), b(2, 0, "paragraph", ""),
    ]
    rows += [b(3, i, "heading", f"H{i}", 1) for i in range(14)]
    pubs = spark.createDataFrame([(d, f"T{d}", "A", "en", f"urn:{d}") for d in (1, 2, 3)], "doc_id long, title string, author string, lang string, identifier string").withColumn("modified", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    made = export.exported(spark.createDataFrame(rows, BLOCKS), pubs).cache()
    files = {}
    for r in made.collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.archive))) as z:
            files[r.doc_id] = {n: z.read(n) for n in z.namelist()}
    one = files[1]
    chapters = sorted(n for n in one if "chapter-" in n)
    texts = ["".join(ElementTree.fromstring(one[n].replace(b"<!DOCTYPE html>", b"")).itertext()) for n in chapters]
    assert len(chapters) == 3 and "Before & after" in texts[0] and "Front matter" in texts[0] and "Text <of> one" in texts[1] and "item" in texts[2]
    assert [n for n in one if "images/" in n] == ["OEBPS/images/image-1.png"] and one[chapters[1]].count(b"image-1.png") == 2 and b"[Image left out: signature mismatch]" in one[chapters[1]]
    assert "(Empty document)" in files[2]["OEBPS/chapter-1.xhtml"].decode() and len([n for n in files[3] if "chapter-" in n]) == 1
    listed = package.listed(made).where("entry_no = 0").collect()
    assert all(r.path == "mimetype" and r.stored and r.n_bytes == 20 for r in listed) and len(listed) == 3


def test_texts_move_once(spark):
    """A document's blocks meet once, and no publication is a data frame of its own."""
    blocks = spark.createDataFrame([(1, 0, "paragraph", "text", None, None, None, None, None)], BLOCKS)
    pubs = spark.createDataFrame([(1, "T", "A", "en", "urn:1")], "doc_id long, title string, author string, lang string, identifier string").withColumn("modified", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    made = export.exported(blocks, pubs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("LogicalRDD") == 2 and plan.count("RepartitionByExpression") == 1  # only the blocks and the publications are read
    assert [r.n_bytes > 0 for r in package.listed(made).collect()] == [True] * 7
