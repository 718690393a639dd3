"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and decoding of overlapping windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Outside, then the first and the further characters of each kind.
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE = 96, 48

_MARKS = " \n.,;:@()[]{}+-_%/\\'\"!?#*$&|<>="
PAD, FOREIGN, DIGIT, OTHER = range(4)
LETTER = 4 + len(_MARKS)
SYMBOLS = LETTER + 26
_CLASS = np.full(128, OTHER, np.int64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = DIGIT, np.arange(LETTER, SYMBOLS), np.arange(LETTER, SYMBOLS)
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 4 + _i
_CLASS[[9, 13]] = 4


def coded(text: str) -> np.ndarray:
    """The class of each character: every ASCII letter (of either case) and mark has its own, digits share one, and so do characters beyond ASCII."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], FOREIGN)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Tagger:
    """weights: ``in`` (of each direction a row per class), ``on`` and ``b``; ``out``, ``bias``; ``change[a, b]`` and ``start``. Both directions run in one pass, the second over
    the reversed window."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        k, gates = len(TAGS), 4 * hidden
        forget = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        w = {"in": rng.normal(0, 0.4, (2, SYMBOLS, gates)), "on": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, gates)), "b": np.stack([forget, forget])}
        w |= {"out": rng.normal(0, 0.3, (2 * hidden, k)), "bias": np.zeros(k), "change": np.zeros((k, k)), "start": np.zeros(k)}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, codes: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states of both directions, time first; gates: input, forget, output, candidate."""
        on = self.weights["on"]
        n, steps = codes.shape
        size = on.shape[1]
        table = self.weights["in"] + self.weights["b"][:, None]
        h = c = np.zeros((2, n, size), table.dtype)
        states = np.empty((steps, n, 2 * size), table.dtype)
        for t in range(steps):
            z = np.matmul(h, on)
            z[0] += table[0][codes[:, t]]
            z[1] += table[1][codes[:, steps - 1 - t]]
            gates, g = _sigmoid(z[:, :, : 3 * size]), np.tanh(z[:, :, 3 * size :])
            before = c
            c = gates[:, :, size : 2 * size] * c + gates[:, :, :size] * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, before, gates, g, tc))
            h = gates[:, :, 2 * size :] * tc
            states[t, :, :size], states[steps - 1 - t, :, size:] = h[0], h[1]
        return states

    def emissions(self, codes: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = self._run(codes, keep)
        return both @ self.weights["out"] + self.weights["bias"], both

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a character's tag, and its gradient."""
        w = self.weights
        keep: list = []
        e, both = self.emissions(codes, keep)
        steps, n, k = e.shape
        change, rows = w["change"], np.arange(n)
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0] + w["start"]
        for t in range(1, steps):
            a[t] = _sum_exp(a[t - 1][:, :, None] + change, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            b[t] = _sum_exp(change[None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
        log_z = _sum_exp(a[-1], 1)
        de = np.exp(a + b - log_z[None, :, None])
        d_change = np.zeros_like(change)
        for t in range(1, steps):
            d_change += np.exp(a[t - 1][:, :, None] + change + (e[t] + b[t])[:, None, :] - log_z[:, None, None]).sum(0)
        gold = e[np.arange(steps)[:, None], rows, tags.T].sum() + w["start"][tags[:, 0]].sum() + change[tags[:, :-1], tags[:, 1:]].sum()
        de[np.arange(steps)[:, None], rows, tags.T] -= 1
        d_change -= np.bincount((tags[:, :-1] * k + tags[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        total = n * steps
        out = {"change": d_change / total, "start": de[0].sum(0) / total}
        de /= total
        flat = both.reshape(-1, both.shape[2])
        out["out"], out["bias"] = flat.T @ de.reshape(-1, k), de.sum((0, 1))
        d_both = de @ w["out"].T
        size = d_both.shape[2] // 2
        on, to = w["on"], np.transpose(w["on"], (0, 2, 1))
        d_z, d_on = np.empty((steps, 2, n, 4 * size), e.dtype), np.zeros_like(on)
        next_h = next_c = np.zeros((2, n, size), e.dtype)
        for t in range(steps - 1, -1, -1):
            h, before, gates, g, tc = keep[t]
            up = next_h + np.stack([d_both[t, :, :size], d_both[steps - 1 - t, :, size:]])
            i, f, o = gates[:, :, :size], gates[:, :, size : 2 * size], gates[:, :, 2 * size :]
            dc = up * o * (1 - tc * tc) + next_c
            dz = d_z[t]
            dz[:, :, :size], dz[:, :, size : 2 * size], dz[:, :, 2 * size : 3 * size], dz[:, :, 3 * size :] = dc * g * i * (1 - i), dc * before * f * (1 - f), up * tc * o * (1 - o), dc * i * (1 - g * g)
            d_on += np.matmul(np.transpose(h, (0, 2, 1)), dz)
            next_h, next_c = np.matmul(dz, to), dc * f
        one_hot = (codes.T.reshape(-1, 1) == np.arange(SYMBOLS)).astype(e.dtype)
        d_in = np.stack([one_hot.T @ d_z[:, 0].reshape(-1, 4 * size), one_hot.T @ d_z[::-1, 1].reshape(-1, 4 * size)])
        out |= {"in": d_in, "on": d_on, "b": d_in.sum(1)}
        return float((log_z.sum() - gold) / total), out

    def train(self, codes: np.ndarray, tags: np.ndarray, *, epochs: int, batch: int, rate: float, seed: int) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order, total = rng.permutation(len(codes)), 0.0
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                loss, grad = self.gradient(codes[rows], tags[rows])
                total += loss * len(rows)
                step += 1
                now = rate * min(1.0, 2 * (1 - epoch / epochs))
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / len(order))
        return losses


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of a kind; a first character begins another run."""
    out, at = [], 0
    while at < len(tags):
        if tags[at]:
            kind = (int(tags[at]) - 1) // 2
            end = at + 1
            while end < len(tags) and tags[end] == 2 * kind + 2:
                end += 1
            out.append((KINDS[kind], at, end))
            at = end
        else:
            at += 1
    return out


def best_path(e: np.ndarray, first: np.ndarray, start: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The best tags of many stretches at once: the scores of stretch r are the rows of e from first[r] to first[r + 1]."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    at, n = first[:-1][order], n[order]
    tags, came = np.zeros(len(e), np.int8), np.zeros(e.shape, np.int8)
    best = e[at] + start
    last = np.empty((len(at), e.shape[1]), e.dtype)
    for t in range(1, int(n.max(initial=0)) + 1):
        live = int(np.searchsorted(-n, -t, side="left"))  # stretches of more than t
        last[live : len(best)] = best[live:]
        if live:
            over = best[:live, :, None] + change
            came[at[:live] + t] = over.argmax(1)
            best = over.max(1) + e[at[:live] + t]
    tag = last.argmax(1).astype(np.int8)
    for t in range(int(n.max(initial=0)) - 1, -1, -1):
        live = int(np.searchsorted(-n, -t, side="left"))
        tags[at[:live] + t] = tag[:live]
        tag[:live] = came[at[:live] + t, tag[:live]]
    return tags


def window_weights(width: int) -> np.ndarray:
    """How much a window says about each of its characters: least at its ends."""
    place = np.arange(width)
    return (np.minimum(place, width - 1 - place) + 1).astype(np.float32)


def decode_regions(tagger: Tagger, regions: list[np.ndarray], most: int = 1 << 17) -> list[np.ndarray]:
    """Tags of coded stretches of text of any length. Windows of WINDOW characters every STRIDE overlap; a character's scores are the mean over the windows that hold it,
    weighted towards their middles, and one best path over a stretch reconciles all its windows. ``most`` characters, or one stretch, are in memory at once."""
    out: list[np.ndarray] = []
    group, size = [], 0
    for r in [*regions, None]:
        if group and (r is None or size + len(r) > most):
            out += _decoded(tagger, group)
            group, size = [], 0
        if r is not None:
            group.append(r)
            size += len(r)
    return out


def _decoded(tagger: Tagger, group: list[np.ndarray], rows: int = 1024) -> list[np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(r) for r in group])])
    flat = np.concatenate([*group, np.zeros(WINDOW, np.int64)])
    starts = np.concatenate([np.arange(a, max(a + 1, z - WINDOW + STRIDE), STRIDE) for a, z in zip(first[:-1], first[1:], strict=True)])
    ends = np.minimum(starts + WINDOW, first[np.searchsorted(first, starts, side="right")])
    k = len(TAGS)
    total, weight = np.zeros((len(flat), k), np.float32), np.zeros(len(flat), np.float32)
    for a in range(0, len(starts), rows):
        at, n = starts[a : a + rows], ends[a : a + rows] - starts[a : a + rows]
        place = at[:, None] + np.arange(WINDOW)
        own = np.arange(WINDOW) < n[:, None]
        e = tagger.emissions(np.where(own, flat[np.minimum(place, len(flat) - 1)], PAD))[0].transpose(1, 0, 2)
        w = np.where(own, window_weights(WINDOW), 0)
        for half in (0, 1):  # every second window: of a stretch these do not overlap
            pick = ((at - first[np.searchsorted(first, at, side="right") - 1]) // STRIDE) % 2 == half
            mine = own[pick]
            total[place[pick][mine]] += (e[pick] * w[pick][:, :, None])[mine]
            weight[place[pick][mine]] += w[pick][mine]
    tags = best_path(total[: first[-1]] / np.maximum(weight[: first[-1], None], 1e-9), first, tagger.weights["start"], tagger.weights["change"])
    return [tags[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
