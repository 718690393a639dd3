"""Vectorised word hashing over batches of whole texts (numpy, bounded chunks)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW = U64(0xD6E8FEB86659FD93)
#: Bytes hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20

ASCII_SPACE = b" \t\n\r\x0b\x0c"
#: The identity, A-Z lowered, and A-Z lowered with all but letters, digits and bytes from 0x80 blank.
AS_IS = bytes(range(256))
LOWERED = AS_IS.lower()
ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWERED)

_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 4096)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up, self.down


_POWERS = _Powers()


class Words:
    """Words of some texts: ``hashes``, byte spans in ``data`` and, in ``first``, where each text's words begin."""

    __slots__ = ("data", "hashes", "starts", "ends", "first")

    def __init__(self, texts: list[bytes], table: bytes, cut: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        """``cut``: from the bytes to where a word begins even if none has ended."""
        self.data = b"\n".join(texts).translate(table)
        raw = np.frombuffer(self.data, np.uint8)
        n = len(raw)
        gap = np.ones(n + 2, bool)
        gap[1:-1] = _SPACE[raw]
        fresh = np.zeros(n + 1, bool)
        if cut is not None:
            fresh[:n] = cut(raw)
        self.starts = np.flatnonzero((gap[:-2] | fresh[:n]) & ~gap[1:-1])
        self.ends = np.flatnonzero(~gap[1:-1] & (gap[2:] | fresh[1:])) + 1
        up, down = _POWERS.upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
        self.first = np.searchsorted(self.starts, begin)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit digests of the words from each begin to its end."""
        up, down = _POWERS.upto(len(self.hashes) + 1)
        out = []
        for salt in (U64(0), U64(0xA5A5A5A5A5A5A5A5)):
            total = np.zeros(len(self.hashes) + 1, np.uint64)
            np.cumsum(mix(self.hashes ^ salt) * up[: len(self.hashes)], out=total[1:])
            out.append(mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        return out[0], out[1]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether all n lie in one text."""
        m = len(self.hashes)
        if m < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(m - n + 1, np.uint64)
        for j in range(n):
            h = h * _WINDOW + self.hashes[j : m - n + 1 + j]
        whole = np.ones(m - n + 1, bool)
        for j in range(1, n):
            cut = self.first[1:-1] - j
            whole[cut[(cut >= 0) & (cut < len(whole))]] = False
        if n > 1:  # a text with fewer words than n reaches over several ends
            owner = np.searchsorted(self.first, np.arange(m), side="right")
            whole &= owner[: m - n + 1] == owner[n - 1 :]
        return mix(h), whole


def phrase(words: Iterable[bytes]) -> int:
    """The hash that ``windows`` gives these words."""
    w = Words([b" ".join(words)], AS_IS)
    return int(w.windows(len(w.hashes))[0][0])


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in order; a chunk has at most ``limit`` bytes or one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]
