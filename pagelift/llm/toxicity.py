"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is mined from labelled rows: words, and word beginnings, whose share of toxic documents is far above that of the others.
Its counts come from Spark aggregates; the driver gets every entry that is significant (at most ``bound`` labelled rows hold few of these) and one row of features for
each of these rows. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, texts
from .learning import Isotonic, Trees, crossed, held_out, sample

#: Labelled rows that are learnt from, half of them toxic where there are so many.
BOUND = 12_000
#: An entry needs so many toxic rows, such log odds, and such a score (in standard deviations) of the difference of its shares, so that of the very many rare words
#: of a small sample hardly any gets in by chance.
LEAST_ROWS, LEAST_ODDS, LEAST_SCORE = 3, 2.5, 5.5
_STEMS = (4, 5, 6)
_KEPT_WORDS = 200_000

# fixed values: words that address the reader
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros os".split())
_EDGES = ".,;:!?\"'()[]{}<>#*$%&|~^=+-_/\\`«»“”„’‘…¡¿"
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"} | dict.fromkeys("*.-_~^'|", None))
_MIXED = re.compile(r"[^\W\d_][\d@$!*_.~^|-]+[^\W\d_]")
#: Which bytes are capitals, letters (beyond ASCII by their first byte) and punctuation.
_UPPER = np.array([65 <= b <= 90 for b in range(256)], np.int64)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC3 for b in range(256)], np.int64)
_PUNCT = np.array([33 <= b <= 126 and not chr(b).isalnum() and b != 95 for b in range(256)], np.int64)
_CAPS = re.compile(r"\b[A-ZÄÖÜÉÈÊÀÇÑÍÓÁÚ]{3,}\b")

FEATURES = ("hits", "hit density", "weight density", "highest weight", "different hits", "nearness to second person", "second person density", "capitals", "capital words", "punctuation", "exclamations", "obfuscated", "obfuscated hits", "words")


@dataclass
class Lexicon:
    """Entries (a word, or a beginning with ``*``) with their numbers of toxic and other documents."""

    counts: dict[str, tuple[float, float]]
    toxic: float
    other: float
    tables: dict[int | None, dict[str, float]] = field(default_factory=dict)

    def weights(self, label: int | None) -> dict[str, float]:
        """Log odds of each entry that counts; for a row that the counts hold, without that row (its label is given)."""
        if label not in self.tables:
            minus = (float(label == 1), float(label == 0))
            toxic, other = self.toxic - minus[0], self.other - minus[1]
            left = {w: (t - minus[0], max(0.0, n - minus[1])) for w, (t, n) in self.counts.items()}
            odds = {w: odds_of(t, n, toxic, other) for w, (t, n) in left.items() if t >= LEAST_ROWS and score_of(t, n, toxic, other) >= LEAST_SCORE}
            self.tables[label] = {w: o for w, o in odds.items() if o >= LEAST_ODDS}
        return self.tables[label]


def odds_of(t: float, n: float, toxic: float, other: float) -> float:
    return math.log((t + 0.25) / (toxic + 0.5)) - math.log((n + 0.25) / (other + 0.5))


def score_of(t: float, n: float, toxic: float, other: float) -> float:
    share = (t + n) / max(toxic + other, 1)
    return (t / max(toxic, 1) - n / max(other, 1)) / math.sqrt(max(share * (1 - share), 1e-12) * (1 / max(toxic, 1) + 1 / max(other, 1)))


class _Marks(dict):
    """From a word to (weight, obfuscated hit, second person), or to None; keeps so many words at most."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def of(self, w: str) -> float:
        return max((self.weights.get(k, 0.0) for k in (w, *(w[:n] + "*" for n in _STEMS))), default=0.0)

    def __missing__(self, w: str) -> tuple[float, bool, bool] | None:
        if len(self) > _KEPT_WORDS:
            self.clear()
        weight, veiled = self.of(w), False
        if not weight and not w.isalpha() and (plain := w.translate(_LEET)) != w:
            weight = self.of(plain)
            veiled = weight > 0
        second = w in SECOND_PERSON
        self[w] = out = (weight, veiled, second) if weight or second else None
        return out


def words_of(text: str) -> list[str]:
    return [w.strip(_EDGES) for w in text.lower().split()]


def features(text: str, marks: _Marks) -> list[float]:
    words = words_of(text)
    n = max(1, len(words))
    marked = [(i, m) for i, w in enumerate(words) if (m := marks[w])]
    hits = [(i, m) for i, m in marked if m[0]]
    second = np.array([i for i, m in marked if m[2]])
    near = max((1 / (1 + float(np.abs(second - i).min())) for i, _ in hits), default=0.0) if len(second) else 0.0
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    letters, chars = max(1, int(counts @ _LETTER)), max(1, len(text))
    total = sum(m[0] for _, m in hits)
    return [
        math.log1p(len(hits)), len(hits) / n, total / n, max((m[0] for _, m in hits), default=0.0), len({words[i] for i, _ in hits}), near, len(second) / n, int(counts @ _UPPER) / letters,
        len(_CAPS.findall(text)) / n, int(counts @ _PUNCT) / chars, text.count("!") / chars, len(_MIXED.findall(text)) / n, sum(m[1] for _, m in hits), math.log1p(n),
    ]


def mined(rows: DataFrame, weight: dict[int, float]) -> Lexicon:
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = []
            for text in texts(b.column("text")):
                words = {w for w in words_of(text) if w}
                found.append(sorted(words | {w[:n] + "*" for w in words for n in _STEMS if len(w) > n}))
            yield {"label": b.column("label"), "entries": found}

    per_label = [F.count(F.when(F.col("label") == k, 1)).alias(f"n{k}") for k in (0, 1)]
    each = map_batches(rows.select("label", "text"), entries, "entries array<string>", ("label",)).select("label", F.explode("entries").alias("entry")).groupBy("entry").agg(*per_label)
    total = rows.agg(*per_label).first()
    toxic, other = max(1, total.n1), max(1, total.n0)
    odds = F.log((F.col("n1") + 0.25) / (toxic + 0.5)) - F.log((F.col("n0") + 0.25) / (other + 0.5))
    share = (F.col("n0") + F.col("n1")) / (toxic + other)
    score = (F.col("n1") / toxic - F.col("n0") / other) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / toxic + 1 / other))
    best = each.where((F.col("n1") >= LEAST_ROWS) & (odds >= LEAST_ODDS) & (score >= LEAST_SCORE - 1)).collect()
    return Lexicon({r.entry: (r.n1, r.n0) for r in best}, toxic, other)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic
    prior: float

    def score(self, all_texts: list[str], marks: _Marks) -> np.ndarray:
        if self.trees is None or not all_texts:
            return np.full(len(all_texts), self.prior)
        return self.calibration(self.trees.raw(np.array([features(t, marks) for t in all_texts])))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows, stands = sample(docs, labels, label, bound, id_col=id_col, text_col=text_col)
    lexicon = mined(rows, stands)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        marks = {k: _Marks(lexicon.weights(k)) for k in (0, 1)}
        for b in batches:
            known = b.column("label").to_pylist()
            yield {"doc_id": b.column("doc_id"), "label": b.column("label"), "x": [features(t, marks[k]) for t, k in zip(texts(b.column("text")), known, strict=True)]}

    got = sorted(map_batches(rows, extract, "x array<double>", ("doc_id", "label")).collect(), key=lambda r: (r.doc_id, r.x))
    y = np.array([r.label for r in got], float)
    weight = np.array([stands[r.label] for r in got])
    prior = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, Isotonic().fit(np.zeros(0), np.zeros(0), np.zeros(0)), prior)
    x = np.array([r.x for r in got])
    unseen = crossed(lambda *a: Trees().fit(*a), x, y, weight)
    return Model(lexicon, Trees().fit(x, y, weight), Isotonic().fit(unseen, y, weight), prior)


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Nulls: a null text is scored as an empty one; a null id is not held out. Very long texts are read whole: features are densities. Equal texts, and so repeated
    rows, have equal scores. Empty tables: no rows; without
    labels of both kinds the score is their share (0 without any). Other columns are not carried, so clashing names cannot disturb.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        marks = _Marks(shared.value.lexicon.weights(None))
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "score": shared.value.score(texts(b.column("text")), marks)}

    out = map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "score double", ("doc_id",))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def rejected_out(docs: DataFrame, model: Model, *, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """docs without the rows whose score is ``cut`` or more, in one pass; columns stay as they are, whatever their names.

    Nulls: a null text is scored as an empty one, nulls elsewhere are carried. Very long texts are read whole. Equal texts stay or go alike; repeated rows that
    stay are all kept. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        marks = _Marks(shared.value.lexicon.weights(None))
        for b in batches:
            good = shared.value.score(texts(b.column("text")), marks) < cut
            yield {"row": b.column("row").filter(pa.array(good))}

    return map_batches(rows, make, "", ("row",)).select("row.*")
