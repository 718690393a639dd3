"""Substring de-duplication by hashing lines or paragraphs.

A unit is a line with a word, or a paragraph (lines between blank ones), normalised: A-Z lowered, white space collapsed. The earliest ranked occurrence of a unit, by id
of the document and then by place, stays; every later one goes, with its original offsets kept. With ``passage_words``, so do runs of repeated sentences of at least so
many words inside lines that are otherwise new; ``unit="sentence"`` looks for these runs alone.

One scan of the texts makes digests of 128 bits, places and word counts of all units, which are written once. Digests are grouped by an aggregate that is combined
before the shuffle. A unit that its own text has had before is a repeat without a look-up; the others meet, in an inner join that Spark splits at very common digests, with
the digests that several documents have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, saved, text_bytes
from .words import LOWERED, Words, chunks, mix

LEAST_WORDS = 30
_UNIT = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
_SPACE = " \t\n\r\x0b\x0c"
_LOWER = {c: c + 32 for c in range(65, 91)}
_SPLIT = re.compile(r"[ \t\n\r\x0b\x0c]+")


def units(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, normalised unit, its words) in order; code points, without white space at the ends."""
    for m in _UNIT.finditer(text):
        said = m[0].strip(_SPACE)
        if said:
            start = m.start() + len(m[0]) - len(m[0].lstrip(_SPACE))
            words = _SPLIT.split(said)
            yield start, start + len(said), " ".join(words).translate(_LOWER), len(words)


def whole_units(text: str, unit: str) -> Iterator[tuple[int, int, str, int]]:
    """As ``units``, for lines or paragraphs."""
    for m in (re.compile(r"[^\n]+") if unit == "line" else re.compile(r"(?:(?!\n[ \t\r\x0b\x0c]*\n).)+", re.S)).finditer(text):
        said = m[0].strip(_SPACE)
        if said:
            start = m.start() + len(m[0]) - len(m[0].lstrip(_SPACE))
            words = _SPLIT.split(said)
            yield start, start + len(said), " ".join(words).translate(_LOWER), len(words)


_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_FIRST_BYTE = np.array([not 0x80 <= b < 0xC0 for b in range(256)])
_BLANK = np.zeros(256, bool)
_BLANK[list(_SPACE.encode())] = True


def _sentences(raw: np.ndarray) -> np.ndarray:
    """Where a sentence may begin: after a line feed, and after sentence ends."""
    out = np.ones(len(raw), bool)
    out[1:] = (raw[:-1] == 10) | (_ENDS[raw[:-1]] & ~_ENDS[raw[1:]])
    return out


def _lines(raw: np.ndarray) -> np.ndarray:
    out = np.ones(len(raw), bool)
    out[1:] = raw[:-1] == 10
    return out


def _paragraphs(raw: np.ndarray) -> np.ndarray:
    """Where a paragraph may begin: after a line without a word."""
    out = np.zeros(len(raw), bool)
    out[:1] = True
    ends = np.flatnonzero(raw == 10)
    said = np.concatenate([[0], np.cumsum(~_BLANK[raw])])
    blank = ends[1:][said[ends[1:]] == said[ends[:-1]]] + 1
    out[blank[blank < len(raw)]] = True
    return out


_BEGINS = {"sentence": _sentences, "line": _lines, "paragraph": _paragraphs}


def columns_of(texts: list[bytes], unit: str = "sentence", lines_too: bool = False) -> dict[str, pa.Array]:
    """What ``units`` or ``whole_units`` gives, and digests and whether the text had the unit before, as a list for each text; with ``lines_too``, lines beside the sentences, with
    their last sentence in ``upto`` (-1 for sentences)."""
    names = ("no", "start", "end", "words", "h1", "h2", "again", "upto")
    flat: dict[str, list[np.ndarray]] = {n: [np.zeros(0, np.int64)] for n in names}
    sizes = [np.zeros(0, np.int64)]
    for _, part in chunks(texts):
        ends = np.cumsum([len(t) + 1 for t in part])

        def begins(raw: np.ndarray, ends: np.ndarray = ends) -> np.ndarray:
            out = _BEGINS[unit](raw)
            out[ends[ends < len(raw)]] = True  # a text begins
            return out

        w = Words(part, LOWERED, begins if unit == "sentence" else None)  # other units end with a word
        raw = np.frombuffer(w.data, np.uint8)
        unit_of = np.cumsum(begins(raw))[w.starts]
        begin = np.flatnonzero(np.diff(unit_of, prepend=-1))
        end = np.append(begin[1:], len(unit_of)) if len(begin) else begin
        owner = np.searchsorted(w.first, begin, side="right") - 1
        h1, h2 = w.spans(begin, end)
        no = np.arange(len(begin)) - np.searchsorted(owner, owner)
        upto = np.full(len(begin), -1)
        if lines_too and len(begin):
            line = np.cumsum(raw == 10)[w.starts[begin]]
            a = np.flatnonzero(np.diff(line, prepend=-1))  # the first sentence of each line, and the last
            z = np.append(a[1:], len(line)) - 1
            own = [x ^ _LINE for x in w.spans(begin[a], end[z])]
            order = np.argsort(np.concatenate([owner, owner[a]]), kind="stable")
            begin, end, owner, no, upto, h1, h2 = (np.concatenate(x)[order] for x in ((begin, begin[a]), (end, end[z]), (owner, owner[a]), (no, no[a]), (upto, no[z]), (h1, own[0]), (h2, own[1])))
        _, once = np.unique(h1 ^ mix(owner.astype(np.uint64)), return_index=True)
        again = np.ones(len(begin), np.int64)
        again[once] = 0
        points = np.concatenate([[0], np.cumsum(_FIRST_BYTE[raw])])
        text_at = np.concatenate([[0], ends])[owner]
        got = (no, points[w.starts[begin]] - points[text_at], points[w.ends[end - 1]] - points[text_at], end - begin, h1.view(np.int64), h2.view(np.int64), again, upto)
        for n, x in zip(names, got, strict=True):
            flat[n].append(x)
        sizes.append(np.bincount(owner, minlength=len(part)))
    count = np.concatenate(sizes)
    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
    out = {n: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x)).cast(_KINDS[n])) for n, x in flat.items()}
    if not lines_too:
        del out["upto"]
    return out


_LINE = np.uint64(0x6C696E6573)
_KINDS = {"no": pa.int32(), "upto": pa.int32(), "start": pa.int32(), "end": pa.int32(), "words": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "again": pa.bool_()}


def repeats(docs: DataFrame, *, unit: str = "line", passage_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_units, n_repeats, n_removed, removed (array of start, end: what goes, code points).

    ``unit``: line, paragraph or sentence. Of lines and paragraphs all repeats go; with ``passage_words`` units are sentences, and whole lines that were lines before go
    and, inside others, runs of repeated sentences of so many words (LEAST_WORDS, where sentences are the unit and nothing is said).

    Nulls: a null text has no units; a row with a null id cannot be ranked: nothing goes of it, and it makes nothing a repeat. Very long texts are read whole. Repeated
    rows are one document given again and judged alike; texts with the same id do not make each other's units repeats. Ties cannot arise otherwise: the least id, then the first place,
    is the earliest. Empty table: no rows. Other columns are not carried, so clashing names cannot disturb.
    """
    return _judged(docs, unit=unit, passage_words=passage_words, id_col=id_col, text_col=text_col).drop("key")


def _judged(docs: DataFrame, *, unit: str, passage_words: int | None, id_col: str, text_col: str) -> DataFrame:
    """``repeats``, and in ``key`` a digest of the row's text."""
    sentences, lines_too = unit == "sentence" or passage_words is not None, unit != "sentence" and passage_words is not None
    least = LEAST_WORDS if passage_words is None else passage_words
    if lines_too and unit != "line":
        raise ValueError("passages are looked for inside lines")
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = read.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {c: b.column(c) for c in ("doc_id", "key")} | columns_of(text_bytes(b.column("text")), "sentence" if sentences else unit, lines_too)

    upto = ["upto"] if lines_too else []
    rows = saved(map_batches(read, make, ", ".join(["no array<int>, start array<int>, end array<int>, words array<int>, h1 array<long>, h2 array<long>, again array<boolean>", *(f"{c} array<int>" for c in upto)]), ("doc_id", "key")))
    ranked = rows.where("doc_id is not null and size(no) > 0")
    each = ranked.select("doc_id", "key", F.explode(F.arrays_zip("no", "start", "end", "words", "h1", "h2", "again", *upto)).alias("u")).select("doc_id", "key", "u.*")
    first = each.where(~F.col("again")).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    several = saved(first.where("first <> last").select("h1", "h2", "first"))
    shown = ["doc_id", "key", "no", "start", "end", "words", *upto]
    later = each.where(~F.col("again")).join(several, ["h1", "h2"]).where("doc_id <> first").select(*shown)
    found = each.where("again").select(*shown).unionByName(later).distinct()
    found = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("no", "start", "end", "words", *upto))).alias("u"))  # the units of one document
    counted = rows.select("doc_id", "key", F.size(F.filter("upto", lambda x: x < 0) if lines_too else "no").cast("long").alias("n_units"))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            each, removed = [], []
            for all_ in b.column("u").to_pylist():
                us = [u for u in all_ if u.get("upto", -1) < 0]
                own, run = {i for u in all_ for i in range(u["no"], u.get("upto", -1) + 1)}, []
                for u in [*us, None]:
                    if run and (u is None or u["no"] != run[-1]["no"] + 1):
                        if sum(x["words"] for x in run) >= least:
                            own.update(x["no"] for x in run)
                        run = []
                    run.append(u)
                each.append(us)
                removed.append([u for u in us if u["no"] in own])
            yield {c: b.column(c) for c in ("doc_id", "key")} | {"n_repeats": [len(u) for u in each], "starts": [[u["start"] for u in r] for r in removed], "ends": [[u["end"] for u in r] for r in removed]}

    if sentences:
        gone = map_batches(found, passages, "n_repeats long, starts array<long>, ends array<long>", ("doc_id", "key"))
    else:
        gone = found.select("doc_id", "key", F.size("u").cast("long").alias("n_repeats"), F.col("u.start").cast("array<long>").alias("starts"), F.col("u.end").cast("array<long>").alias("ends"))
    removed = F.coalesce(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return counted.join(gone, ["doc_id", "key"], "left").select("doc_id", "n_units", F.coalesce("n_repeats", F.lit(0)).cast("long").alias("n_repeats"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), "key")


def without_repeats(docs: DataFrame, *, unit: str = "line", passage_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the text of removed units, and with a column ``removed`` of their original offsets (in place of one of that name); other columns stay as they are. Nulls,
    very long texts, repeated rows and ties: as for ``repeats``; a null text stays null. Empty table: no rows."""
    gone = _judged(docs, unit=unit, passage_words=passage_words, id_col=id_col, text_col=text_col).where("n_removed > 0").groupBy("doc_id", "key").agg(F.first("removed").alias("spans"))
    rest = [c for c in docs.columns if c not in (text_col, "removed")]
    row = docs.select(F.col(id_col).alias("own_id"), F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text")).withColumn("own_key", F.xxhash64("text"))
    both = row.join(gone, (row["own_id"] == gone["doc_id"]) & (row["own_key"] == gone["key"]), "left").select("row", "text", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            new = b.column("text").to_pylist()
            for i, spans in enumerate(b.column("removed").to_pylist()):
                if spans:
                    kept, at = [], 0
                    for s in spans:
                        kept.append(new[i][at : s["start"]])
                        at = s["end"]
                    new[i] = "".join([*kept, new[i][at:]])
            yield {"row": b.column("row"), "removed": b.column("removed"), "clean": new}

    out = map_batches(both, make, "clean string", ("row", "removed"))
    kept = {c: F.col("row")[c] for c in rest} | {text_col: F.col("clean"), "removed": F.col("removed")}
    return out.select(*[kept[c].alias(c) for c in dict.fromkeys([*docs.columns, "removed"])])


#: Lines, and passages of sentences inside new ones; lines alone; passages alone.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?]+|\n')) AS said, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?]+|\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, said, i, coalesce(sum(length(said)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, sum(CASE WHEN said = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM t),
u AS (SELECT doc_id, i, line, pos + length(said) - length(regexp_replace(said, '^[\x20\x09-\x0D]+', '')) AS start, translate(regexp_replace(regexp_replace(said, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, length(regexp_replace(said, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS chars FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no FROM u WHERE norm <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, no) > 1 AS again, len(string_split(norm, ' ')) AS words FROM n),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line) > 1 AS old FROM (SELECT doc_id, line, string_agg(norm, ' ' ORDER BY no) AS norm FROM n GROUP BY 1, 2)),
g AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM r WHERE again),
w AS (SELECT *, old OR sum(words) OVER (PARTITION BY doc_id, run) >= 30 AS gone FROM g JOIN l USING (doc_id, line)),
a AS (SELECT doc_id, count(*) AS n_repeats, count(*) FILTER (WHERE gone) AS n_removed, string_agg(CASE WHEN gone THEN CAST(start AS VARCHAR) || ':' || CAST(start + chars AS VARCHAR) END, ',' ORDER BY no) AS removed FROM w GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_units FROM n GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_repeats, 0) AS BIGINT) AS n_repeats, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)
"""
LINES_SQL = r"""
WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, said, i, coalesce(sum(length(said) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t),
u AS (SELECT doc_id, i, pos + length(said) - length(regexp_replace(said, '^[\x20\x09-\x0D]+', '')) AS start, translate(regexp_replace(regexp_replace(said, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, length(regexp_replace(said, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS chars FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1 AS again FROM u WHERE norm <> ''),
a AS (SELECT doc_id, count(*) AS n_repeats, string_agg(CAST(start AS VARCHAR) || ':' || CAST(start + chars AS VARCHAR), ',' ORDER BY i) AS removed FROM r WHERE again GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_units FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_repeats, 0) AS BIGINT) AS n_repeats, CAST(coalesce(n_repeats, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)
"""
PASSAGES_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?]+|\n')) AS said, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?]+|\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, said, i, coalesce(sum(length(said)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t),
u AS (SELECT doc_id, i, pos + length(said) - length(regexp_replace(said, '^[\x20\x09-\x0D]+', '')) AS start, translate(regexp_replace(regexp_replace(said, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, length(regexp_replace(said, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS chars FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no FROM u WHERE norm <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, no) > 1 AS again, len(string_split(norm, ' ')) AS words FROM n),
g AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM r WHERE again),
w AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) >= 30 AS gone FROM g),
a AS (SELECT doc_id, count(*) AS n_repeats, count(*) FILTER (WHERE gone) AS n_removed, string_agg(CASE WHEN gone THEN CAST(start AS VARCHAR) || ':' || CAST(start + chars AS VARCHAR) END, ',' ORDER BY no) AS removed FROM w GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_units FROM n GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_repeats, 0) AS BIGINT) AS n_repeats, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)
"""
