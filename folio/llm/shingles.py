"""Word-shingle sets as sorted 64-bit hashes, and SetSketch registers over them, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 21  # bytes hashed at once
#: SetSketch: registers, base of the exponential spacing, rate, largest value.
M, BASE, RATE, TOP = 160, 1.001, 20.0, 65_535


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Hashes words and shingles; holds a random word for each byte and the powers of the base
    and of its inverse modulo 2**64, so that a task makes one."""

    def __init__(self, k: int):
        self.k = k
        self.letters = mix64(np.arange(1, 257, dtype=U) * U(_BASE))
        self.powers = np.cumprod(np.full(PIECE, _BASE, U)) * U(pow(_BASE, -1, 1 << 64))
        self.inverse = np.cumprod(np.full(PIECE, pow(_BASE, -1, 1 << 64), U)) * U(_BASE)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True  # fixed values: [\x20\x09-\x0D]

    def _piece(self, raw: bytes) -> np.ndarray:
        a = np.frombuffer(raw, np.uint8)
        word = ~self.space[a]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.zeros(0, U)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(self.letters[a] * self.powers[: len(a)])])
        return mix64((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(U))

    def words(self, text: str | None) -> np.ndarray:
        """A hash of each word [^\\x20\\x09-\\x0D]+ of the whole text, A-Z lower-cased, in order."""
        raw = (text or "").encode().lower()
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            if end < len(raw):
                cut = max(raw.rfind(bytes([c]), at, end) for c in b"\t\n\v\f\r ")
                if cut < 0:  # a word of more than a piece: hashed by itself
                    stops = [x for x in (raw.find(bytes([c]), end) for c in b"\t\n\v\f\r ") if x >= 0]
                    end = min(stops, default=len(raw))
                    parts = np.concatenate([self._piece(raw[i : min(end, i + PIECE)]) for i in range(at, end, PIECE)])
                    out.append(np.bitwise_xor.reduce(mix64(parts + np.arange(len(parts), dtype=U)), keepdims=True))
                    at = end
                    continue
                end = cut
            out.append(self._piece(raw[at:end]))
            at = max(end, at + 1)
        return np.concatenate(out) if out else np.zeros(0, U)

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the k-word shingles; of a text of fewer words, that of the whole sequence."""
        w = self.words(text)
        n = len(w) - self.k + 1
        if n < 1:
            if not len(w):
                return w
            return mix64(np.array([sum(int(x) * pow(_BASE, j + 1, 1 << 64) for j, x in enumerate(w)) + len(w) & (1 << 64) - 1], U))
        h = np.zeros(n, U)
        for j in range(self.k):
            h += w[j : j + n] * U(pow(_BASE, j + 1, 1 << 64))
        return np.unique(mix64(h))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (sets x M, uint16) of sets of hashes; an empty set has zeros.

    Each element runs a Poisson process of rate RATE * M whose points fall on random
    registers, so each register sees an exponential of rate RATE from each element; a register
    keeps the least, truncated to floor(1 - log_BASE) between 0 and TOP. The element stops at
    the first point beyond all minima of its set. Registers of a union are the larger ones.
    """
    least = np.full((len(sets), M), np.inf)
    size = np.array([len(s) for s in sets])
    for low, high, draws in ((1, 16, 64), (16, 128, 8), (128, 1 << 62, 1)):
        own = np.flatnonzero((size >= low) & (size < high))
        if not len(own):
            continue
        x = np.concatenate([sets[i] for i in own])
        doc = np.repeat(own, size[own])
        time, turn = np.zeros(len(x)), 0
        while len(x):
            steps = np.arange(turn, turn + draws, dtype=U)
            r = mix64(x[:, None] + (steps + U(1)) * U(0xD1342543DE82EF95))
            gap = -np.log1p(-((r >> U(11)).astype(np.float64) / (1 << 53))) / (RATE * M)
            points = time[:, None] + np.cumsum(gap, 1)
            register = (mix64(r) % U(M)).astype(np.int64)
            np.minimum.at(least.reshape(-1), (doc[:, None] * M + register).ravel(), points.ravel())
            bound = np.zeros(len(sets))
            bound[own] = least[own].max(1)
            go = points[:, -1] < bound[doc]
            x, doc, time, turn = x[go], doc[go], points[go, -1], turn + draws
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(np.nan_to_num(value, neginf=0), 0, TOP).astype(np.uint16)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of `rows` registers (sets x bands)."""
    n, bands = len(registers), registers.shape[1] // rows
    r = registers[:, : bands * rows].reshape(n, bands, rows).astype(U)
    key = np.zeros((n, bands), U) + np.arange(1, bands + 1, dtype=U) * U(_BASE)
    for j in range(rows):
        key = mix64(key + r[:, :, j])
    return key.view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, slack: float = 14.0) -> np.ndarray:
    """Joint estimate by likelihood: whether some similarity of `least` or more is as likely as
    the likeliest one, but for a log-likelihood of `slack` (chance of a wrong no: about 1e-7).

    With D+, D-, D0 the registers in which a is larger, smaller, equal, and u, v the two sizes'
    shares, a's register is the larger with chance p(u - v J), the smaller with p(v - u J),
    where p(x) = -log_BASE(1 - x (BASE - 1) / BASE).
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, near = np.full(len(a), -np.inf), np.full(len(a), -np.inf)
    low = np.minimum(least, most)
    for f in np.linspace(0, 1, 41):
        for js, mark in ((f * low, False), (low + f * (most - low), True)):
            x, y = np.maximum(p(u - v * js), 1e-12), np.maximum(p(v - u * js), 1e-12)
            ll = more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))
            best = np.maximum(best, ll)
            if mark:
                near = np.maximum(near, ll)
    return (most >= least * (1 - 1e-9)) & (near >= best - slack)


def blocks(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of rows whose sizes add up to about `most`."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))
