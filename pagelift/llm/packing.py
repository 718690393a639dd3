"""Bounded-space online packing of documents into sequences of tokens.

Each partition keeps a fixed number of open windows. A document's full-length parts are sequences at once; its rest goes to the open
window that it fills best. Where none has room, the fullest takes as much of it as fits and is emitted full, so no emitted window
holds padding. At a partition's end the open windows are poured together until one partial window is left; those leftovers (at
most one window of token ids for each partition) are dealt to few tasks, packed in the same way, and what is left in a task then is
cut at powers of two, where a sequence needs no padding.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, saved, texts

#: Leftover windows that one task merges.
MERGED_AT_ONCE = 512
_MERGE_IDS = 1 << 61

Piece = tuple[Any, int, np.ndarray, int]  # document, start, ids, tokens of the document


@cache
def encoder(vocabulary: str, ranks: str | None = None) -> Any:
    """From a text to the ids that the tokenizer of the JSON file ``vocabulary`` gives it without adding special tokens; where a text holds the string of an
    added token, that is the token's id. ``ranks``: the same byte-level vocabulary as a file of ranks, with which the same ids take a quarter of the time. Bare
    names are looked up among the public tokenizers."""
    import public_tokenizers

    path, ranked = (x if x is None or os.sep in x else public_tokenizers.path(x) for x in (vocabulary, ranks))
    if ranked is None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    with open(ranked, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    ranked_encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=added)
    return lambda text: ranked_encoder.encode(text, allowed_special="all") if any(t in text for t in added) else ranked_encoder.encode_ordinary(text)


class Packer:
    """Windows of one task; ``add`` and ``finish`` yield (piece, sequence, offset)."""

    def __init__(self, size: int, open_windows: int, first_sequence: int) -> None:
        self.size, self.most, self.next = size, open_windows, first_sequence
        self.windows: list[list[Piece]] = []
        self.filled: list[int] = []

    def emit(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for p in pieces:
            yield p, self.next, offset
            offset += len(p[2])
        self.next += 1

    def put(self, k: int, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        self.windows[k].append(piece)
        self.filled[k] += len(piece[2])
        if self.filled[k] == self.size:
            del self.filled[k]
            yield from self.emit(self.windows.pop(k))

    def add(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        doc, start, ids, total = piece
        whole = len(ids) - len(ids) % self.size
        for a in range(0, whole, self.size):
            yield from self.emit([(doc, start + a, ids[a : a + self.size], total)])
        start, ids = start + whole, ids[whole:]
        while len(ids):
            room = [self.size - f for f in self.filled]
            fits = [k for k, r in enumerate(room) if r >= len(ids)]
            if fits:
                yield from self.put(min(fits, key=room.__getitem__), (doc, start, ids, total))
                return
            if len(self.windows) < self.most:
                self.windows.append([])
                self.filled.append(0)
                continue
            k = min(range(len(room)), key=room.__getitem__)
            cut = room[k]
            yield from self.put(k, (doc, start, ids[:cut], total))
            start, ids = start + cut, ids[cut:]

    def pour(self) -> Iterator[tuple[Piece, int, int]]:
        """Until at most one partial window is left: the emptiest goes into the others."""
        while len(self.windows) > 1:
            k = min(range(len(self.filled)), key=self.filled.__getitem__)
            pieces = self.windows.pop(k)
            del self.filled[k]
            self.most = len(self.windows)
            for p in pieces:
                yield from self.add(p)

    def powers(self) -> Iterator[tuple[Piece, int, int]]:
        """The last window, in sequences whose lengths are powers of two."""
        for pieces, left in zip(self.windows, self.filled, strict=True):
            rest = list(pieces)
            while left:
                room = 1 << (left.bit_length() - 1)
                left -= room
                own: list[Piece] = []
                while room:
                    doc, start, ids, total = rest.pop(0)
                    own.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        rest.insert(0, (doc, start + room, ids[room:], total))
                    room -= len(own[-1][2])
                yield from self.emit(own)
        self.windows, self.filled = [], []


_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _columns(placed: list[tuple[Piece, int | None, int | None]], keep: bool, doc_type: pa.DataType) -> dict:
    raw = [p[2].tobytes() for p, _, _ in placed]
    return {
        "doc_id": pa.array([p[0] for p, _, _ in placed], doc_type), "start": [p[1] for p, _, _ in placed], "length": [len(p[2]) for p, _, _ in placed], "ids_crc32": [zlib.crc32(r) for r in raw],
        "doc_tokens": [p[3] for p, _, _ in placed], "sequence_id": [s for _, s, _ in placed], "offset": [o for _, _, o in placed], "ids": [r if keep or s is None else None for r, (_, s, _) in zip(raw, placed, strict=True)],
    }


def packed(docs: DataFrame, *, size: int = 1024, open_windows: int = 16, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian 32-bit; null without
    ``keep_ids``). Each id of each document, its text's ids and then ``end_id``, lies in exactly one piece.

    Nulls: a null text is empty, so its document is ``end_id`` alone; a null id is carried. Very long texts are encoded whole and cut into sequences; a task holds
    one text's ids and its open windows. Repeated rows are packed each for itself. Of windows that a rest fills equally well the oldest takes it. Empty table: no rows. Other columns are not carried, so clashing names cannot disturb.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(vocabulary, ranks)
        packer = Packer(size, open_windows, TaskContext.get().partitionId() << 36)
        kind = None
        for b in batches:
            kind, out = b.column("doc_id").type, []
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                ids = encode(text)
                ids.append(end_id)
                out += packer.add((doc, 0, np.array(ids, "<u4"), len(ids)))
            yield _columns(out, keep_ids, kind)
        if kind is not None:
            out = list(packer.pour()) + [(p, None, None) for w in packer.windows for p in w]
            yield _columns(out, keep_ids, kind)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        packer = Packer(size, open_windows, _MERGE_IDS + (TaskContext.get().partitionId() << 36))
        kind = None
        for b in batches:
            kind, out = b.column("doc_id").type, []
            for doc, start, total, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                out += packer.add((doc, start, np.frombuffer(raw, "<u4"), total))
            yield _columns(out, keep_ids, kind)
        if kind is not None:
            yield _columns([*packer.pour(), *packer.powers()], keep_ids, kind)

    mapped = saved(map_batches(read, first, _SCHEMA, ("doc_id",)))  # both kinds of rows are used, and texts are encoded once
    left = mapped.where("sequence_id is null").repartition(max(1, -(-mapped.rdd.getNumPartitions() // MERGED_AT_ONCE)))
    return mapped.where("sequence_id is not null").unionByName(map_batches(left, last, _SCHEMA, ("doc_id",)))

