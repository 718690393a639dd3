"""Personal data: base patterns, and the spans that a character tagger adds to them.

The tagger (``tagger``) is trained on labelled spans. An added span is kept if it is well-formed for its kind (``shaped``) and overlaps nothing found before. So
overlapping windows are decoded over every stretch of the whole text that could hold such a span (``regions``), and one best path reconciles the windows of a
stretch. So base spans stay, and what their greedy patterns spoil (a
number next to another, a spelt-out address) is found. One pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, texts
from .tagger import KINDS, TAGS, WINDOW, Tagger, coded, decode_regions, spans_of

Span = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")
#: What must stand in a span of each kind that ``shaped`` accepts: a run with a digit, or a sign for at with a domain after it.
_NUMBERS = re.compile(r"[+0-9][0-9 ().+-]*")
_AT = re.compile(r"@|[\[({]\s*(?:at|@)\s*[\])}]|(?<=\s)at(?=\s)", re.I)
_DOMAIN = re.compile(r"\s*[A-Za-z0-9-]+(?:(?:\.|\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+)[A-Za-z0-9-]+)+", re.I)
_SPELT = re.compile(r"[A-Za-z0-9._%+-]+(?:@|\s*[\[({]\s*(?:at|@)\s*[\])}]\s*|\s+at\s+)[A-Za-z0-9-]+(?:(?:\.|\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\s+dot\s+)[A-Za-z0-9-]+)+", re.I)
_CONTEXT = WINDOW // 2


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_address(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def is_card(s: str) -> bool:
    d = digits_of(s)
    return 14 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[Span]:
    """By start, then kind; code points, end exclusive."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        own = text[last:at]
        start = at - (len(own) - len(own.rstrip(_LOCAL)))
        last = at + 1
        if start < at and (m := _EMAIL.match(text, start)):
            out.append(("email", *m.span()))
            last = m.end()
        at = text.find("@", last)
    if _HAS_DIGIT.search(text):
        for m in _DOTTED.finditer(text):  # every four parts in a row are one match
            parts, start = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                length = sum(map(len, parts[k : k + 4])) + 3
                if is_address(parts[k : k + 4]):
                    out.append(("ip", start, start + length))
                start += length + 1
        out += [("card", *m.span()) for m in _CARD.finditer(text) if is_card(m[0])]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=_rank)


def _rank(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


def regions(text: str) -> list[tuple[int, int]]:
    """Where a span can lie, with what stands around it, merged where they touch: whatever ``shaped`` accepts lies in one of these."""
    found = [m.span() for m in _NUMBERS.finditer(text)] if _HAS_DIGIT.search(text) else []
    for m in _AT.finditer(text):
        own = text[:m.start()] if m.start() < _CONTEXT else text[m.start() - _CONTEXT : m.start()]
        near = own.rstrip()
        if near and near[-1] in _LOCAL or not near and m.start() >= _CONTEXT:
            after = _DOMAIN.match(text, m.end())
            if after:
                end = m.start() - len(own) + len(near)
                while end and text[end - 1].isspace():
                    end -= 1
                start = end
                while start and text[start - 1] in _LOCAL:
                    start -= 1
                if start < end:
                    found.append((start, after.end()))
    out: list[tuple[int, int]] = []
    for a, z in sorted(found):
        a, z = max(0, a - _CONTEXT), min(len(text), z + _CONTEXT)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def shaped(text: str, span: Span) -> Span | None:
    """The span without loose ends, if what is left is well-formed for its kind."""
    kind, a, z = span
    said = text[a:z]
    if kind == "email":
        m = _SPELT.search(said)
        return (kind, a + m.start(), a + m.end()) if m else None
    first = "+0123456789" if kind == "phone" else "0123456789"
    while a < z and text[a] not in first:
        a += 1
    while z > a and not "0" <= text[z - 1] <= "9":
        z -= 1
    if a == z or a and "0" <= text[a - 1] <= "9" and "0" <= text[a] <= "9" or z < len(text) and "0" <= text[z] <= "9":
        return None
    said = text[a:z]
    good = {"ip": is_address(said.split(".")) if re.fullmatch(r"[0-9.]+", said) and ".." not in said else False, "card": bool(_CARD.fullmatch(said)) and is_card(said), "phone": bool(_PHONE.fullmatch(said)) and 10 <= len(digits_of(said)) <= 15}[kind]
    return (kind, a, z) if good else None


def all_spans(many: list[str], tagger: Tagger) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans."""
    base = [base_spans(t) for t in many]
    places = [(k, a, z) for k, t in enumerate(many) for a, z in regions(t)]
    tags = decode_regions(tagger, [coded(many[k][a:z]) for k, a, z in places])
    added: dict[int, list[Span]] = {}
    for (k, a, _), own in zip(places, tags, strict=True):
        for kind, x, y in spans_of(own):
            s = shaped(many[k], (kind, a + x, a + y))
            if s and all(y <= s[1] or x >= s[2] for _, x, y in base[k] + added.get(k, [])):
                added.setdefault(k, []).append(s)
    for k in range(len(many)):
        yield base[k], sorted(base[k] + added.get(k, []), key=_rank)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


# -- labelled spans ----------------------------------------------------------------------------------------------------------------


def _word(rng: random.Random) -> str:
    w = "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouäé") for _ in range(rng.randint(1, 4)))
    return w.capitalize() if rng.random() < 0.15 else w


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _name(rng: random.Random) -> str:
    w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    return w + rng.choice(["", "", _number(rng, 2), "." + _number(rng, 2), "." + w[:4], "_" + w[:3]])


def _made(rng: random.Random, kind: str) -> str:
    if kind == "email":
        at, dot = rng.choice([("@", ".")] * 5 + [(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", ".")])
        return _name(rng) + at + dot.join([_name(rng).replace(".", ""), *([_word(rng).lower().replace("ä", "a").replace("é", "e")] if rng.random() < 0.5 else []), rng.choice(["com", "org", "net", "de", "io"])])
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = _number(rng, rng.choice([13, 14, 15, 15, 15, 15, 17, 18]))
        d = body + next(x for x in "0123456789" if luhn(body + x))
        sep = rng.choice(["", "", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d
    cc = rng.choice(["1", "1", "44", "49", "33", "34", "351"])
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return "+" + rng.choice([f"{cc} ({a}) {b}-{c}", f"{cc} {a} {b} {c}", f"{cc}-{a}-{b}-{c}", f"{cc}{a}{b}{c}", f"{cc} {a}.{b}.{c}"])


def _other(rng: random.Random) -> str:
    return rng.choice([
        lambda: _number(rng, rng.randint(1, 6)), lambda: f"{rng.randint(1, 99)}.{rng.randint(1, 99)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: "@" + _word(rng), lambda: f"{rng.randint(1, 12)}:{rng.randint(0, 59):02}",
    ])()


def labelled(n: int, seed: int, size: int = 64) -> tuple[list[str], list[list[Span]]]:
    """Windows of invented text with labelled spans, some of them side by side, among numbers and marks that are none."""
    rng = random.Random(seed)
    out: tuple[list[str], list[list[Span]]] = ([], [])
    while len(out[0]) < n:
        text, spans, beside = "", [], False
        while len(text) < size + 40:
            x = rng.random()
            if x < (0.4 if beside else 0.14):
                kind = spans[-1][0] if beside and rng.random() < 0.5 else rng.choice(KINDS)
                said = _made(rng, kind)
                spans.append((kind, len(text), len(text) + len(said)))
                text += said
                beside = True
            else:
                text += _other(rng) if x > 0.9 else _word(rng)
                beside = False
            text += " " if beside else rng.choice([" "] * 12 + [", ", ". ", ".\n", " | ", "; ", " (", ") "])
        cut = rng.randint(0, 20)
        text = text[cut : cut + (size if rng.random() < 0.8 else rng.randint(size // 3, size))]
        whole = [(k, a - cut, z - cut) for k, a, z in spans]
        out[0].append(text)
        out[1].append([(k, max(0, a), min(len(text), z)) for k, a, z in whole if a < len(text) and z > 0])
    return out


@cache
def trained(n: int = 2_048, epochs: int = 10, hidden: int = 16, seed: int = 5) -> Tagger:
    """A tagger fitted to ``n`` labelled windows."""
    return fit(*labelled(n, seed), epochs=epochs, hidden=hidden, seed=seed)


def fit(windows: list[str], spans: list[list[Span]], *, epochs: int = 12, hidden: int = 16, seed: int = 5) -> Tagger:
    """A tagger fitted to short texts with their labelled spans."""
    size = max(map(len, windows))
    codes = np.stack([np.pad(coded(t), (0, size - len(t))) for t in windows])
    tags = np.zeros(codes.shape, np.int64)
    for row, own in zip(tags, spans, strict=True):
        for kind, a, z in own:
            row[a:z] = TAGS.index(f"I-{kind}")
            row[a] = TAGS.index(f"B-{kind}")
    tagger = Tagger.new(hidden, seed)
    tagger.train(codes, tags, epochs=epochs, batch=128, rate=0.04, seed=seed)
    return tagger


def found(docs: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256, spans.

    Nulls: a null text is empty; a null id is carried. Very long texts are read whole, as many stretches or one. Equal texts, and so repeated rows, have equal
    results; of spans that overlap, base ones stay, then the one that begins first. Empty table: no rows. Other columns are not carried, so
    clashing names cannot disturb.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            both = list(all_spans(texts(b.column("text")), shared.value))
            counts = {f"n_{kind}": [sum(k == kind for k, _, _ in base) for base, _ in both] for kind in KINDS}
            yield counts | {"doc_id": b.column("doc_id"), "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], "spans": [joined(every) for _, every in both]}

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string", ("doc_id",))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that overlap, as the name of its first kind in brackets."""
    parts, at = [], 0
    for kind, a, z in spans:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, tagger: Tagger, *, text_col: str = "text") -> DataFrame:
    """docs with every span masked; columns stay as they are, whatever their names; n_chars, where there is one, follows the text.

    Nulls: a null text stays null, nulls elsewhere are carried. Very long texts are read whole; equal texts are masked alike; repeated rows all stay. Empty table: no
    rows.
    """
    rest = [c for c in docs.columns if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            read = b.column("text").to_pylist()
            every = [s for _, s in all_spans([t or "" for t in read], shared.value)]
            yield {"row": b.column("row"), "clean": [masked(t, s) if s else t for t, s in zip(read, every, strict=True)]}

    out = map_batches(docs.select(F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text")), make, "clean string", ("row",))
    kept = {c: F.col("row")[c] for c in rest} | {text_col: F.col("clean")}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(kept["n_chars"].isNotNull(), F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[kept[c].alias(c) for c in docs.columns])
