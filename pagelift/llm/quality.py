"""Document quality: a linear-chain conditional random field labels every line good or bad.

A line is described by its own figures and by those of the lines before and after it. Documents, not lines, are labelled, so a bad
document's lines start as bad and are labelled anew from the marginals between fits. A document's quality is the mean of its
lines' forward-backward marginals, weighted by length, calibrated on the labelled rows. Scoring is one pass without a shuffle; the driver
gets figures of at most ``line_bound`` lines of ``bound`` labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lines
from .batches import map_batches, saved, text_bytes
from .learning import Isotonic, held_out, sample
from .words import chunks

#: Labelled rows that are learnt from, half of them of each label where there are so many, and lines of them in all.
BOUND, LINES = 6_000, 600_000
#: Lines that are walked one after another; longer texts are walked in stretches side by side, which are then joined exactly.
STRETCH = 200


def described(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's figures, those of its neighbours in the text (zeros at its ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    begins, ends = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    before[begins], after[ends] = 0, 0
    ones = np.ones((len(x), 1))
    edge = np.zeros((len(x), 2))
    edge[begins, 0], edge[ends, 1] = 1, 1
    return np.concatenate([x, before, after, edge, ones], 1)


def forward_backward(gain: np.ndarray, first: np.ndarray, change: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected counts of each change of label, over all texts at once.

    ``gain`` is the log odds that a line's own features give to good; ``change[a, b]`` the score of label b after label a. Texts are walked in stretches, each from both labels that may stand before it
    and after it; a text's stretches are joined by these. What comes out does not depend on ``stretch``.
    """
    m, none = len(gain), -np.inf
    if not m:
        return np.zeros(0), np.zeros((2, 2))
    own = np.stack([np.zeros(m), gain], 1)
    heads = first[:-1][np.diff(first) > 0]
    cut = np.unique(np.concatenate([heads, [m], *(np.arange(a, z, stretch) for a, z in zip(first[:-1], first[1:], strict=True) if z - a > stretch)]))
    begin, end = cut[:-1], cut[1:] - 1
    order = np.argsort(begin - end, kind="stable")  # the longest first
    at, n = begin[order], (end - begin + 1)[order]
    live = [int(np.searchsorted(-n, -t, side="left")) for t in range(int(n[0]))]  # stretches with more than t lines
    is_head = np.zeros(m, bool)
    is_head[heads] = True
    ahead, behind = np.full((m, 2, 2), none), np.full((m, 2, 2), none)  # by line: label beyond the stretch, own label
    ahead[begin] = change[None] + own[begin][:, None]
    ahead[heads, 0], ahead[heads, 1] = own[heads], none
    for t in range(1, len(live)):
        i = at[: live[t]] + t
        last = ahead[i - 1]
        ahead[i] = np.logaddexp(last[..., :1] + change[0], last[..., 1:] + change[1]) + own[i][:, None]
    behind[end, 0, 0] = behind[end, 1, 1] = 0
    long = at + n - 1
    for t in range(1, len(live)):
        i = long[: live[t]] - t + 1
        later = behind[i] + own[i][:, None]
        behind[i - 1] = np.logaddexp(change[:, 0] + later[..., :1], change[:, 1] + later[..., 1:])
    # join: scores of the label before a stretch, and of what follows its last line
    text = np.cumsum(is_head[begin]) - 1
    place = np.arange(len(begin)) - np.flatnonzero(is_head[begin])[text]
    before, after = np.full((len(begin), 2), none), np.zeros((len(begin), 2))
    before[place == 0, 0] = 0
    rows = [np.flatnonzero(place == k) for k in range(1, int(place.max()) + 1)]
    for k in rows:
        last = ahead[end[k - 1]]
        before[k] = np.logaddexp(before[k - 1, :1] + last[:, 0], before[k - 1, 1:] + last[:, 1])
    for k in reversed(rows):
        then = behind[begin[k]]
        then = np.logaddexp(after[k, :1] + then[:, 0], after[k, 1:] + then[:, 1]) + own[begin[k]]
        after[k - 1] = np.logaddexp(change[:, 0] + then[:, :1], change[:, 1] + then[:, 1:])
    piece = np.repeat(np.arange(len(begin)), end - begin + 1)
    forward = np.logaddexp(before[piece, :1] + ahead[:, 0], before[piece, 1:] + ahead[:, 1])
    backward = np.logaddexp(after[piece, :1] + behind[:, 0], after[piece, 1:] + behind[:, 1])
    both = forward + backward
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    i = np.flatnonzero(~is_head)
    pair = forward[i - 1][:, :, None] + change + (own + backward)[i][:, None, :] - log_z[i][:, None, None]
    return np.exp(both[:, 1] - log_z), np.exp(pair).sum(0)


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    change: np.ndarray
    calibration: Isotonic
    prior: float

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(described((x - self.mean) / self.scale, first) @ self.weights, first, self.change)[0]

    def qualities(self, texts: list[bytes]) -> Iterator[tuple[float, list[float]]]:
        """For each text its calibrated quality and the marginals of its lines."""
        for _, part in chunks(texts):
            found = lines.Lines(part)
            p = self.marginals(found.x, found.first) if len(found.x) else np.zeros(0)
            raw = averaged(p, found.chars, found.first)
            score = self.calibration(raw) if len(self.calibration.x) > 1 else np.full(len(part), self.prior)
            for d in range(len(part)):
                own = p[found.first[d] : found.first[d + 1]]
                yield float(score[d]), own.tolist()


def averaged(p: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(p * chars)])
    length = np.concatenate([[0.0], np.cumsum(chars)])
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(length[first[1:]] - length[first[:-1]], 1)


def trained(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, *, steps: int = 60, rounds: int = 3, rate: float = 0.08, ridge: float = 1e-3) -> Field:
    """Adam on the penalised likelihood of the lines' labels; after each round but the last, lines of bad texts that look good become so."""
    n = np.diff(first)
    line_y = np.repeat(y, n).astype(float)
    bad = np.repeat(y, n) == 0
    line_weight = np.repeat(weight / np.maximum(n, 1), n)  # each text counts as much as any other of its label
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = described((x - mean) / scale, first)
    w, change = np.zeros(z.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[first[:-1][n > 0]] = False
    i = np.flatnonzero(inner)
    field = Field(mean, scale, w, change, Isotonic(), 0.0)
    for r in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (line_y[i - 1].astype(int), line_y[i].astype(int)), 1)
        m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        for step in range(1, steps + 1):
            p, pairs = forward_backward(z @ w, first, change)
            g = np.concatenate([z.T @ (line_weight * (line_y - p)) / line_weight.sum() - ridge * w, ((seen - pairs) / len(x) - ridge * change).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, change = w + move[:-4], change + move[-4:].reshape(2, 2)
        if r < rounds - 1:
            line_y = np.where(bad, (z @ w > 0).astype(float), 1.0)
            worst = np.full(len(n), np.inf)
            np.minimum.at(worst, np.repeat(np.arange(len(n)), n), z @ w)
            line_y[bad & (z @ w <= np.repeat(worst, n))] = 0  # at least one line of a bad text is bad
    field.weights, field.change = w, change
    return field


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = BOUND, line_bound: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field learnt from at most ``bound`` labelled rows, whole texts, and at most ``line_bound`` lines of them: half for each label, texts in order of a hash of the id while their lines go in.

    Null labels and labelled ids without a document are passed over, null texts have no lines; repeated rows count each. Without labels of both kinds, or without a line, the field says the share of good rows (0 without any).
    """
    rows, stands = sample(docs, labels, label, bound, id_col=id_col, text_col=text_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            xs = []
            for _, part in chunks(text_bytes(b.column("text"))):
                found = lines.Lines(part)
                for d in range(len(part)):
                    a, z = found.first[d], found.first[d + 1]
                    xs.append(np.concatenate([found.chars[a:z, None], found.x[a:z]], 1).astype("<f4").tobytes())
            yield {"doc_id": b.column("doc_id"), "label": b.column("label"), "x": xs}

    figures = saved(map_batches(rows, extract, "x binary", ("doc_id", "label")))
    upto = F.sum(F.octet_length("x") / (4 * (lines.N + 1))).over(W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "x"))
    got = figures.withColumn("upto", upto).where(F.col("upto") <= line_bound / 2).drop("upto").collect()  # windows over ``bound`` rows
    got = sorted(got, key=lambda r: (r.doc_id, r.x))
    y = np.array([r.label for r in got], int)
    weight = np.array([stands[r.label] for r in got])
    prior = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
    if not len(y) or y.min() == y.max() or not any(r.x for r in got):
        zero = np.zeros(lines.N)
        return Field(zero, zero + 1, np.zeros(3 * lines.N + 3), np.zeros((2, 2)), Isotonic().fit(np.zeros(0), np.zeros(0), np.zeros(0)), prior)
    every = [np.frombuffer(r.x, "<f4").reshape(-1, lines.N + 1).astype(float) for r in got]

    def part(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen = [every[k] for k in which]
        return np.concatenate(chosen), np.concatenate([[0], np.cumsum([len(e) for e in chosen])]), which

    raw = np.zeros(len(y))
    fold = np.arange(len(y)) % 2
    balance = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum())) * len(y) / 2
    for k in (0, 1):  # calibrated on texts that the field has not seen
        x, first, which = part(np.flatnonzero(fold != k))
        other, other_first, unseen = part(np.flatnonzero(fold == k))
        if len(set(y[which])) == 2 and len(x):
            half = trained(x[:, 1:], first, y[which], balance[which])
            raw[unseen] = averaged(half.marginals(other[:, 1:], other_first), other[:, 0], other_first)
    x, first, _ = part(np.arange(len(y)))
    out = trained(x[:, 1:], first, y, balance)
    out.calibration, out.prior = Isotonic().fit(raw, y, weight), prior
    return out


def scored(docs: DataFrame, model: Field, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, lines (P(good) of each line with a word).

    Nulls: a null text is scored as an empty one, whose score is that of no good line; a null id is not held out. Very long texts are read whole, line by line.
    Equal texts, and so repeated rows, have equal scores; a score equal to the cut is predicted 1. Empty tables: no rows; without labels of both kinds the score is their share (0 without any). Other columns are not carried, so clashing names
    cannot disturb.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = list(shared.value.qualities(text_bytes(b.column("text"))))
            yield {"doc_id": b.column("doc_id"), "score": [s for s, _ in found], "lines": [p for _, p in found]}

    out = map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "score double, lines array<double>", ("doc_id",))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "lines")
