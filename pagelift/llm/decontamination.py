"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over every document.

Words are runs of ASCII letters and digits, lowered, and of all characters from U+0080 on. A window is n consecutive
words of an item; an item of fewer words, but not none, is one window. The scan is one pass without a shuffle. The
benchmark goes out in blocks whose broadcast object has at most ``block_bytes``: one block needs no more than the pass; more blocks take
a pass each that merges into what the row has so far, so that nothing broadcast grows with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, saved, text_bytes
from .words import ALNUM, Words, chunks

#: Bytes of a block of windows as it is broadcast, and what it needs for each word beside the text: hash, place, end, owner and where its owners begin.
BLOCK_BYTES, WORD_BYTES = 64 << 20, 28
_FILTER_BITS = 22


class Table:
    """The different windows of one size: ascending hashes, where their words stand in the text, and the items that hold them."""

    def __init__(self, w: Words, place: np.ndarray, size: int, at: np.ndarray, item: np.ndarray) -> None:
        h, other = w.windows(size)[0][at], w.spans(at, at + size)[0]
        order = np.lexsort((item, other, h))
        at, item, h, other = at[order], item[order], h[order], other[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1])
        owned = fresh.copy()
        owned[1:] |= item[1:] != item[:-1]  # an item holds a window once
        first = np.flatnonzero(fresh)
        self.hashes, self.start, self.end = h[first], place[at[first]].astype(np.int32), (place[at[first] + size] - 1).astype(np.int32)
        self.owners = item[owned].astype(np.int32)
        self.owned = np.append(np.concatenate([[0], np.cumsum(owned)])[first], owned.sum()).astype(np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.start, self.end, self.owners, self.owned))


class Windows:
    """The windows of some items in flat arrays: sorted hashes, a bit table in front of them, and the exact words behind them."""

    def __init__(self, items: list[tuple[str, bytes]], n: int) -> None:
        self.items = [item for item, _ in items]
        w = Words([text for _, text in items], ALNUM)
        words = w.data.split()
        self.text = b" ".join(words)
        place = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in words], out=place[1:])
        count = np.diff(w.first)
        owner = np.repeat(np.arange(len(items)), count)
        left = np.repeat(w.first[1:], count) - np.arange(len(words))  # words of the item from here on
        self.sizes: dict[int, Table] = {}
        for size in sorted({int(min(n, c)) for c in count if c}):
            at = np.flatnonzero(left >= n) if size == n else w.first[:-1][count == size]
            self.sizes[size] = Table(w, place, size, at, owner[at])
        self.front = np.zeros(1 << _FILTER_BITS, bool)
        for t in self.sizes.values():
            self.front[(t.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    @property
    def nbytes(self) -> int:
        return len(self.text) + self.front.nbytes + sum(t.nbytes for t in self.sizes.values())

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
        """For each text: its number of words, merged word ranges that windows cover, and the items of those windows."""
        for _, part in chunks(texts):
            w = Words(part, ALNUM)
            n_words = np.diff(w.first)
            ranges: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[int]] = {}
            for size, t in self.sizes.items():
                h, whole = w.windows(size)
                at = np.flatnonzero(self.front[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & whole)
                near = np.minimum(np.searchsorted(t.hashes, h[at]), len(t.hashes) - 1)
                same = t.hashes[near] == h[at]
                at, near = at[same], near[same]
                owner = np.searchsorted(w.first, at, side="right") - 1
                for i, g, d in zip(at.tolist(), near.tolist(), owner.tolist(), strict=True):
                    said = b" ".join(w.data[w.starts[i] : w.ends[i + size - 1]].split())
                    while g < len(t.hashes) and t.hashes[g] == h[i]:
                        if self.text[t.start[g] : t.end[g]] == said:  # equal words, not only equal hashes
                            ranges.setdefault(d, []).append((i - int(w.first[d]), i - int(w.first[d]) + size))
                            items.setdefault(d, set()).update(t.owners[t.owned[g] : t.owned[g + 1]].tolist())
                            break
                        g += 1
            for d in range(len(part)):
                yield int(n_words[d]), merged(ranges.get(d, [])), sorted(items.get(d, ()))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def needed(text: bytes) -> int:
    """The most that a text's windows take in a broadcast block."""
    words = text.translate(ALNUM).split()
    return sum(map(len, words)) + (1 + WORD_BYTES) * len(words) + 64


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, needed: Callable[[bytes], int] = needed) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size; the driver holds one block (and never less than one item)."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in rows.toLocalIterator():
        text = row.text.encode()
        own = needed(text)
        if block and size + own > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, text))
        size += own
    if block:
        yield block


def covered(df: DataFrame, benchmark: DataFrame, *, carry: tuple[str, ...], n: int = 10, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` and ``text`` of df, with n_words, starts and ends (merged word ranges that windows cover) and items (sorted ids).

    Each block of the benchmark is one narrow pass; between two passes the rows are written, so one block is in memory at a time.
    """
    context = df.sparkSession.sparkContext
    out, before = df, False
    all_blocks = blocks(benchmark, item_col, item_text_col, block_bytes)
    block: list[tuple[str, bytes]] | None = next(all_blocks, [])
    while block is not None:
        out = _pass(saved(out) if before else out, context.broadcast(Windows(block, n)), carry, before)
        before, block = True, next(all_blocks, None)
    return out


def _pass(df: DataFrame, shared: Broadcast, carry: tuple[str, ...], before: bool) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        windows = shared.value
        for b in batches:
            found = list(windows.scan(text_bytes(b.column("text"))))
            ranges = [r for _, r, _ in found]
            items = [{windows.items[i] for i in who} for _, _, who in found]
            if before:
                earlier = zip(*(b.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True)
                for i, (starts, ends, who) in enumerate(earlier):
                    ranges[i] = merged([*ranges[i], *zip(starts, ends, strict=True)])
                    items[i].update(who)
            yield {c: b.column(c) for c in (*carry, "text")} | {"n_words": [x for x, _, _ in found], "starts": [[x for x, _ in r] for r in ranges], "ends": [[x for _, x in r] for r in ranges], "items": [sorted(x) for x in items]}

    return map_batches(df, make, "n_words long, starts array<long>, ends array<long>, items array<string>", (*carry, "text"))


def decontamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: int | str) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined item ids), contaminated, and starts and ends.

    Nulls: a null text has no words; items with a null id or text are passed over. Very long texts are scanned whole. Repeated rows and ids: each row has its own
    result, which depends on its text alone; items with the same text or id all count, an id once. Empty tables: no rows, or no hits. Other columns are not carried, so clashing names cannot disturb.
    """
    found = covered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), benchmark, carry=("doc_id",), **options)
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "starts", "ends",
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.5, text_col: str = "text", **options: int | str) -> DataFrame:
    """docs without the text of benchmark passages: from the first to the last word of each covered range; a row more than
    ``max_share`` of whose words are covered goes altogether. Columns stay as they are; n_chars, where there is one, follows the text.
    Nulls, very long texts, repeats and empty tables: as for ``decontamination``; a null text stays null, nulls elsewhere are carried, and so are clashing names."""
    rest = [c for c in docs.columns if c != text_col]
    row = docs.select(F.struct(*[F.col(c) for c in rest]).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = covered(row, benchmark, carry=("row",), **options)
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.where(n_hit <= max_share * F.col("n_words"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            new = b.column("text").to_pylist()
            for i, (starts, ends) in enumerate(zip(b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True)):
                if starts:
                    raw, at, pieces = new[i].encode(), 0, []
                    w = Words([raw], ALNUM)
                    for a, z in zip(starts, ends, strict=True):
                        pieces.append(raw[at : w.starts[a]])
                        at = int(w.ends[z - 1])
                    new[i] = b"".join([*pieces, raw[at:]]).decode()
            yield {"row": b.column("row"), "clean": new}

    out = map_batches(found, make, "clean string", ("row",))
    kept = {c: F.col("row")[c] for c in rest} | {text_col: F.col("clean")}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(kept["n_chars"].isNotNull(), F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[kept[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS said FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS said FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, dw.size, i, item_id FROM dw JOIN bw USING (said) WHERE dw.size = bw.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
