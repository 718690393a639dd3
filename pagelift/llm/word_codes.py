"""BPE encoding by a table of distinct words, and decoding by a join of ids with pieces.

Texts are split at ASCII white space, in blocks of some megabytes. A block keeps, for each place, the number of a word of its own list;
what leaves it is that list, dealt by a hash of the word into slots. A slot meets all blocks' lists of its words: each distinct word is
encoded there once, and each list goes back to its block as ids. There every place takes the ids of its word's number. So a word that
stands everywhere travels once for each block, not once for each place, and no key has more rows than there are blocks.

Decoding looks every id up in the table of pieces. That table is as large as the vocabulary: up to ``BROADCAST`` bytes of it go out to all
tasks and meet the ids in place; a larger one is joined by a shuffle.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_batches, partitions, saved, small_batches, text_bytes

#: Bytes of text in a block (one text is never cut), words that a slot remembers, ids in a batch that goes out.
BLOCK, REMEMBERED, IDS_AT_ONCE = 32 << 20, 1 << 19, 1 << 20
#: How hard what is written is compressed: blocks are written once and moved once.
LEVEL = 9
#: Words given to the tokenizer at once, which bounds what it returns.
ENCODED_AT_ONCE = 1 << 14
#: Bytes of pieces that may be sent to every task.
BROADCAST = 64 << 20
_LAST = 2**31 - 1  # the slot of a block's own row, which follows its lists


def place(vocabulary: str) -> str:
    """The file of a tokenizer; bare names are looked up among the public ones."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


@cache
def tokenizer(vocabulary: str) -> Any:
    """The tokenizer of a JSON file. It must treat what stands between white space by itself, and drop the white space; others raise ValueError."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism here
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(place(vocabulary))
    made.no_truncation()
    made.no_padding()
    whole, parts = made.encode(" a\tb1,\n c ", add_special_tokens=False).ids, [made.encode(w, add_special_tokens=False).ids for w in ("a", "b1,", "c")]
    if whole != sum(parts, []):
        raise ValueError(f"{vocabulary}: this tokenizer does not encode words by themselves")
    return made


def _packed(array: np.ndarray) -> bytes:
    """Compressed, equal bytes of the numbers beside each other."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _slot(words: list[bytes], slots: int) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(slots)


def _block(texts: list[bytes], slots: int) -> tuple[list[tuple[int, bytes]], bytes, bytes, bytes]:
    """The words of some texts by slot, how often each occurs (up to 255) in that order, the words of each text, and each place's word.

    Words are numbered by falling occurrences, so that most numbers are small; whoever knows the occurrences knows the order."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, sizes = [], np.zeros(len(texts), "<u4")
    for i, text in enumerate(texts):
        words = text.split()
        sizes[i] = len(words)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    known, codes = list(number), np.concatenate([np.zeros(0, np.int32), *parts])
    number.clear()
    parts.clear()
    slot = _slot(known, slots)
    by_word = np.array(sorted(range(len(known)), key=known.__getitem__), np.int64)
    by_slot = by_word[np.argsort(slot[by_word], kind="stable")]
    seen = np.minimum(np.bincount(codes, minlength=len(known)), 255).astype(np.uint8)[by_slot]
    rank = np.empty(len(known), "<u4")
    rank[by_slot[_order(seen)]] = np.arange(len(known))
    lists, ends = [], np.flatnonzero(np.diff(slot[by_slot].astype(np.int64), append=-1)) + 1
    for begin, end in zip([0, *ends[:-1]], ends, strict=True) if len(known) else ():
        own = by_slot[begin:end]
        lists.append((int(slot[own[0]]), zstandard.ZstdCompressor(level=LEVEL).compress(b"\n".join(known[i] for i in own))))
    return lists, _packed(seen), _packed(sizes), _packed(rank[codes])


def _order(seen: np.ndarray) -> np.ndarray:
    return np.argsort(255 - seen, kind="stable")


def encoded(docs: DataFrame, *, vocabulary: str = "word_bpe_49k.json", slots: int | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): what the tokenizer gives for the whole text without adding special tokens, unpadded and whole. The string of an added token in a text is that token.

    ``slots``: parts of the table of distinct words, half as many as shuffle partitions by default. A slot remembers REMEMBERED words at once; only beyond that may a word be encoded again.
    Nulls: a null text is empty, so it has no ids; a null id is carried. Empty and blank texts: no ids. Very long texts are encoded whole; a task holds one text or one block and its ids. Bytes
    that are no UTF-8 count as U+FFFD. Repeated rows give a row each. Empty table: no rows. Other columns are not carried, so clashing names cannot disturb.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer(vocabulary)  # refused on the driver already
    n, size = partitions(spark), block
    parts = slots or max(1, n // 2)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType
    schema = T.StructType().add("block", "long").add("slot", "integer").add("docs", T.ArrayType(kind)).add("data", "binary").add("seen", "binary").add("sizes", "binary")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, own, held = TaskContext.get().partitionId() << 32, [], [], 0
        target = None

        def out() -> pa.RecordBatch:
            lists, seen, sizes, codes = _block(own, parts)
            rows = [(at, s, None, data, None, None) for s, data in lists] + [(at, _LAST, ids, codes, seen, sizes)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        for b in batches:
            target = target or pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("docs", pa.list_(b.column("doc_id").type)), ("data", pa.binary()), ("seen", pa.binary()), ("sizes", pa.binary())])
            for doc, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), strict=True):
                if own and held + len(text) > size:
                    yield out()
                    at, ids, own, held = at + 1, [], [], 0
                ids.append(doc)
                own.append(text)
                held += len(text)
        if own:
            yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, known, now = tokenizer(vocabulary), {}, None
        for b in batches:
            out = []
            for slot, data in zip(b.column("slot").to_pylist(), b.column("data").to_pylist(), strict=True):
                words = zstandard.ZstdDecompressor().decompress(data).split(b"\n")
                if slot != now or len(known) > REMEMBERED:
                    known, now = {}, slot
                new = [w for w in words if w not in known]
                for i in range(0, len(new), ENCODED_AT_ONCE):
                    some = new[i : i + ENCODED_AT_ONCE]
                    for w, e in zip(some, encoder.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                ids = [known[w] for w in words]
                out.append((_packed(np.fromiter(map(len, ids), "<u4", len(ids)) >> 2), _packed(np.frombuffer(b"".join(ids), "<u4"))))
            yield {"block": b.column("block"), "slot": b.column("slot"), "sizes": [x for x, _ in out], "data": [x for _, x in out]}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, ids, now = [], [], None
        for b in batches:
            for at, slot, docs_of, data, seen, n_words in zip(*(b.column(c).to_pylist() if c != "docs" else b.column(c) for c in ("block", "slot", "docs", "data", "seen", "sizes")), strict=True):
                if at != now:
                    sizes, ids, now = [], [], at
                if slot != _LAST:
                    sizes.append(_unpacked(n_words, "<u4"))
                    ids.append(_unpacked(data, "<u4"))
                    continue
                lengths, flat = np.concatenate([np.zeros(0, "<u4"), *sizes]).astype(np.int64), np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
                begins = np.cumsum(lengths) - lengths
                order, codes = _order(_unpacked(seen, "u1")), _unpacked(data, "<u4")
                yield from _joined(docs_of.values, _unpacked(n_words, "<u4").astype(np.int64), codes, lengths[order], begins[order], flat)
                sizes, ids = [], []

    mapped = saved(read.mapInArrow(split, schema))  # both kinds of rows are used, and texts are split once
    lists = mapped.where(F.col("slot") != _LAST).select("block", "slot", "data").repartition(n, "slot").sortWithinPartitions("slot", "block")
    back = map_batches(lists, encode, "block long, slot int, sizes binary, data binary")
    both = back.withColumns({"docs": F.lit(None).cast(schema["docs"].dataType), "seen": F.lit(None).cast("binary")}).select(*schema.names).unionAll(mapped.where(F.col("slot") == _LAST))
    return both.repartition(n, "block").sortWithinPartitions("block", "slot").mapInArrow(join, T.StructType().add("doc_id", kind).add("ids", T.ArrayType(T.IntegerType())))


def _joined(docs: pa.Array, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray, begins: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text, some texts at once: the ids of the word of each place."""
    ends = np.cumsum(sizes)
    tokens = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lengths[codes], out=tokens[1:])
    upto, first = tokens[ends], 0
    while first < len(sizes):
        done = tokens[ends[first] - sizes[first]]
        last = max(first + 1, int(np.searchsorted(upto, done + IDS_AT_ONCE, side="right")))
        own = codes[ends[first] - sizes[first] : ends[last - 1]]
        each = lengths[own]
        at = np.repeat(begins[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        offsets = np.concatenate([[0], upto[first:last] - done]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([docs.slice(first, last - first), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[at]))], names=["doc_id", "ids"])
        first = last


def pieces(spark: SparkSession, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """id, piece: the vocabulary of a tokenizer, added tokens among it. Its decoder must put a space between pieces and nothing else; others raise ValueError."""
    made = tokenizer(vocabulary)
    if made.decoder is not None:
        raise ValueError(f"{vocabulary}: its decoder does more than to join pieces")
    return spark.createDataFrame([(i, piece) for piece, i in made.get_vocab(with_added_tokens=True).items()], "id int, piece string")


def decoded(df: DataFrame, table: DataFrame, *, ids_col: str = "ids", to: str = "decoded", most: int = BROADCAST) -> DataFrame:
    """df and ``to``: the pieces (``table``: id, piece) of its ids in order, with a space between. Special tokens stay.

    A table of up to ``most`` bytes meets the ids in each task; a larger one by a shuffle of all ids. An id that the table lacks, and a null one, gives no piece. Null or empty ids: an empty text. Two rows of
    the table with one id: the piece that sorts first. Very long lists are decoded whole, repeated rows each for itself; an empty df gives no rows. All columns of df are carried (a column named as ``to`` is replaced).
    """
    rest = [c for c in df.columns if c != to]
    table = table.where("id is not null and piece is not null").groupBy(F.col("id").cast("int").alias("id")).agg(F.min("piece").alias("piece"))
    size = table.agg(F.coalesce(F.sum(F.octet_length("piece") + 12), F.lit(0))).first()[0]
    if size > most:
        return _by_shuffle(df.select(*rest), table, ids_col, to)
    known = table.orderBy("id").toArrow()  # bounded by ``most``
    sent = df.sparkSession.sparkContext.broadcast((known.column("id").to_numpy(), known.column("piece").to_pylist()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, names = sent.value
        names = pa.array([*names, None], pa.string())
        for b in batches:
            ids = b.column(ids_col)
            flat, empty = ids.flatten(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            wanted = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(own, wanted)
            at[at == len(own)] = 0
            met = own[at] == wanted if len(own) else np.zeros(len(wanted), bool)
            kept = np.zeros(len(wanted) + 1, np.int64)
            np.cumsum(met, out=kept[1:])
            ends = kept[np.concatenate([[0], np.cumsum(empty)])]
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), names.take(pa.array(at[met]))), " ")
            yield {c: b.column(c) for c in rest} | {to: text}

    return map_batches(df.select(*rest), decode, f"{to} string", tuple(rest))


def _by_shuffle(df: DataFrame, table: DataFrame, ids_col: str, to: str) -> DataFrame:
    numbered = saved(df.withColumn("_row", F.monotonically_increasing_id()))  # written, so that a task that is run again numbers alike
    places = numbered.select("_row", F.posexplode(ids_col).alias("_at", "id"))
    texts = places.join(table, "id").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "piece"))).alias("_pieces"))
    return numbered.join(texts, "_row", "left").select(*df.columns, F.coalesce(F.array_join("_pieces.piece", " "), F.lit("")).alias(to))
