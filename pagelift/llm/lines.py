"""Figures of every line of many texts at once (numpy over bytes)."""

from __future__ import annotations

import numpy as np

from .words import AS_IS, Words


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


#: The first byte of a character in UTF-8 counts for all of it.
_FIRST = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)], np.uint8)
_KINDS = (
    _FIRST,
    _members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _members(b"abcdefghijklmnopqrstuvwxyz") + np.array([1 if b >= 0xC0 else 0 for b in range(256)], np.uint8),
    _members(b"0123456789"),
    _members(b"#*$%&|<>"),
    _members(b"@^~=+_{}[]\\/`"),
    _members(b".,;:'\"()-"),
    _members(b"!?"),
)
NAMES = ("log characters", "capitals", "small letters", "digits", "symbols", "code marks", "punctuation", "exclamations", "word length", "log words", "different words", "repeats of the word before", "words twice in the line")
N = len(NAMES)


class Lines:
    """Lines with a word: ``x`` (N figures for each), ``chars``, ``words``, and in ``first`` where each text's lines begin."""

    def __init__(self, texts: list[bytes]) -> None:
        w = Words([*texts, b""], AS_IS)  # the last line ends too
        raw = np.frombuffer(w.data, np.uint8)
        cuts = np.flatnonzero(raw == 10)
        begin = np.concatenate([[0], cuts + 1])
        begin = begin[begin < len(raw)]
        line_of = np.searchsorted(begin, w.starts, side="right") - 1
        held, n_words = np.unique(line_of, return_counts=True)
        text_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=text_at[1:])
        if not len(held):
            self.x, self.chars, self.words = np.zeros((0, N)), np.zeros(0), np.zeros(0, np.int64)
            self.first = np.zeros(len(texts) + 1, np.int64)
            return
        sums = [np.add.reduceat(k[raw], begin, dtype=np.int64)[held].astype(float) for k in _KINDS]
        chars = np.maximum(sums[0] - 1, 1)
        at = np.searchsorted(line_of, held)
        own = np.repeat(np.arange(len(held)), n_words)
        key = w.hashes ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        order = np.zeros(len(times), np.int64)
        order[where] = own
        different = np.bincount(order, minlength=len(held))
        again = np.zeros(len(own))
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (own[1:] == own[:-1])
        twice = np.add.reduceat((times[where] > 1).astype(float), at)
        length = np.add.reduceat((w.ends - w.starts).astype(float), at)
        shares = [s / chars for s in sums[1:]]
        self.x = np.stack([np.log1p(chars), *shares, length / n_words, np.log1p(n_words), different / n_words, np.add.reduceat(again, at) / n_words, twice / n_words], 1)
        self.chars, self.words = chars, n_words
        self.first = np.searchsorted(begin[held], text_at)
