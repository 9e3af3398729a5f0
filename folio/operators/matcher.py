"""Many strings looked for in many pages at once: an automaton (Aho and Corasick) that steps through a thousand stretches of text side by side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

#: Bytes of the automaton's table at most; of a string that it reads, longest tried first; of a stretch of text; of text that is read at once.
TABLE, KEYS, STRETCH, WINDOW = 32 << 20, (32, 16, 8, 4, 3), 256, 1 << 20
#: A byte that UTF-8 never has: it stands behind each page, so that nothing is found across two.
END = 0xFF


@dataclass(eq=False)
class Matcher:
    """Strings, as UTF-8, and the automaton of their keys: all of a short string, of a longer one the piece that the fewest share.

    States are numbered by their rows in `table`. `outs` are the strings whose keys end in a state, from `first` on;
    behind a key `rest` bytes of the string follow, up to its end there are `back` code points. `chars` are a string's code points. `bytes` has all strings, one behind the other, from `begin` on."""

    strings: list[bytes]
    bytes: np.ndarray
    begin: np.ndarray
    table: np.ndarray
    classes: np.ndarray
    kinds: int
    depth: int
    first: np.ndarray
    outs: np.ndarray
    rest: np.ndarray
    back: np.ndarray
    size: np.ndarray
    chars: np.ndarray
    whole: np.ndarray
    laps: np.ndarray


def matcher(strings: list[str]) -> Matcher | None:
    """For the distinct strings, none of them empty; None where its table would be too large."""
    held = [s.encode() for s in strings]
    seen = sorted(set().union(*held))
    classes = np.zeros(256, np.uint8)
    classes[seen] = range(1, len(seen) + 1)  # 0: a byte of no string
    kinds = len(seen) + 1
    for most in KEYS:
        begins = _pieces(held, most)
        keys = [s[i : i + most] for s, i in zip(held, begins, strict=True)]
        if trie := _trie(keys, TABLE // (4 * kinds)):
            break
    else:
        return None
    parents, by, levels, ends = trie
    table, fail = np.zeros((len(parents), kinds), np.int32), np.zeros(len(parents), np.int32)
    parents, by = np.array(parents), classes[by]
    for a, z in levels:
        fail[a:z] = table[fail[parents[a:z]], by[a:z]] if a > 1 else 0
        table[parents[a:z], by[a:z]] = np.arange(a, z)
        table[a:z] = table[fail[a:z]]
    outs = [[] for _ in fail]
    for i, state in enumerate(ends):
        outs[state].append(i)
    for state in range(1, len(fail)):  # that of its longest end comes before
        outs[state] += outs[fail[state]]
    # a state is the place of its row, so that a step is one sum and one look-up
    first = np.concatenate([[0], np.cumsum([len(x) for x in outs])])
    points = lambda s: sum((c & 0xC0) != 0x80 for c in s)
    size = np.array([len(s) for s in held])
    return Matcher(
        held, np.frombuffer(b"".join(held), np.uint8), np.cumsum(size) - size, (table * kinds).ravel(), classes, kinds, max(map(len, keys)), first, np.array([i for x in outs for i in x], np.int64),
        np.array([len(s) - i - len(k) for s, i, k in zip(held, begins, keys, strict=True)]), np.array([points(s[: i + len(k)]) for s, i, k in zip(held, begins, keys, strict=True)]),
        size, np.array([points(s) for s in held]), np.array([len(s) == len(k) for s, k in zip(held, keys, strict=True)]), np.array([_laps(s) for s in held]),
    )


def _pieces(strings: list[bytes], most: int) -> list[int]:
    """Where in each string the piece of so many bytes begins that the fewest strings have; of long strings some are looked at."""
    step = max(1, most // 4)
    places = [sorted({*range(0, min(len(s) - most, 64 * step) + 1, step), len(s) - most}) if len(s) > most else [0] for s in strings]
    shared = Counter(p for s, at in zip(strings, places, strict=True) for p in {s[i : i + most] for i in at})
    return [min(at, key=lambda i: (shared[s[i : i + most]], i)) for s, at in zip(strings, places, strict=True)]


def _trie(keys: list[bytes], most: int):
    """Of the tree of the keys: each state's parent and byte, the states of each depth, the state of each key, which are numbered by depth; None if there are more than so many."""
    parents, by, levels, at = [0], [0], [], [0] * len(keys)
    for depth in range(max(map(len, keys), default=0)):
        known, a = {}, len(parents)
        for i, k in enumerate(keys):
            if depth < len(k):
                if (x := (at[i], k[depth])) not in known:
                    known[x] = len(parents)
                    parents.append(at[i])
                    by.append(k[depth])
                at[i] = known[x]
        if len(parents) > most:
            return None
        levels.append((a, len(parents)))
    return parents, by, levels, at


def _laps(s: bytes) -> bool:
    """Whether a hit of a string can begin within another one: an end of the string is its beginning too."""
    fail, k = [0] * len(s), 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = fail[k - 1]
        k += s[i] == s[k]
        fail[i] = k
    return k > 0


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts with END behind each, and where each begins; nulls are empty."""
    n, wide = len(texts), pa.types.is_large_string(texts.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    begins = off - off[0] + np.arange(n + 1)
    out, there = np.full(len(data) + n, END, np.uint8), np.ones(len(data) + n, bool)
    there[begins[1:] - 1] = False
    out[there] = data
    return out, begins


def parts(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of so large a sum and so many at most, but for a larger one alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))
        yield a, (z := min(max(z, a + 1), a + rows))
        a = z


def states(m: Matcher, data: np.ndarray, a: int, z: int) -> np.ndarray:
    """The automaton's state behind each byte from a to z. Each stretch is begun as far before as a key may reach."""
    ahead = m.depth - 1
    lanes = -(-(z - a) // STRETCH)
    held = np.zeros(lanes * STRETCH + ahead, np.uint8)
    from_ = max(0, a - ahead)
    held[from_ - a + ahead : z - a + ahead] = m.classes[data[from_:z]]
    steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(held, (lanes, STRETCH + ahead), (STRETCH, 1)).T)
    out = np.empty((STRETCH, lanes), np.int32)
    state, at = np.zeros(lanes, np.int32), np.empty(lanes, np.int64)
    for i, step in enumerate(steps):
        np.add(state, step, out=at)
        state = np.take(m.table, at, out=out[i - ahead] if i >= ahead else state, mode="wrap")
    return out.T.ravel()[: z - a]


def _windows(m: Matcher, data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """For so many bytes at a time: where they begin, the first and last page there, page and state of each byte."""
    for a in range(0, len(data), WINDOW):
        z = min(a + WINDOW, len(data))
        p, q = np.searchsorted(begins, [a, z - 1], "right") - 1
        yield a, p, q, np.repeat(np.arange(p, q + 1), np.diff(np.clip(begins[p : q + 2], a, z))), states(m, data, a, z) // m.kinds


def _outs(m: Matcher, state: np.ndarray, a: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The strings whose keys end in states, and which state it is, numbered from a."""
    n = m.first[state + 1] - m.first[state]
    each = np.repeat(np.arange(len(n)), n)
    return m.outs[np.arange(len(each)) + (m.first[state] - np.cumsum(n) + n)[each]], each + a


def matches(m: Matcher, data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """String, page and place in code points from the page's beginning of all hits, overlapping ones too: at most so many at a time, by page, the places of a string in rising order."""
    chars, base = 0, np.zeros(len(begins), np.int64)
    for a, p, q, page, s in _windows(m, data, begins):
        behind = chars + np.cumsum((data[a : a + len(s)] & 0xC0) != 0x80)
        new = np.arange(p + (begins[p] < a), q + 1)
        base[new] = np.where(begins[new] > a, behind[begins[new] - a - 1], chars)
        chars = behind[-1]
        n = np.diff(m.first)[s]
        at = np.flatnonzero(n)
        n, s = n[at], s[at]
        for b, y in parts(n, WINDOW, WINDOW):
            which, each = _outs(m, s[b:y], b)
            ends = at[each]
            if not m.whole.all():
                ok = _same(m, data, which, ends + a)
                which, ends = which[ok], ends[ok]
            of = page[ends]
            yield which, of, behind[ends] - base[of] - m.back[which]


def strings_of(m: Matcher, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and page of each string that a page holds: strings are told from the states that a page has, once for each."""
    k, n, pages = len(m.strings), len(m.first) - 1, len(begins) - 1
    seen, marks = np.zeros(pages * n, bool), np.zeros(pages * k, bool)
    for _, _, _, page, s in _windows(m, data, begins):
        seen[page * n + s] = True
    of, s = np.divmod(np.flatnonzero(seen), n)
    short = narrowed(m, m.whole)
    for a, z in parts(np.diff(short.first)[s], WINDOW, WINDOW):
        which, each = _outs(short, s[a:z], a)
        marks[of[each] * k + which] = True
    if not m.whole.all():
        for which, of, _ in matches(narrowed(m, ~m.whole), data, begins):
            marks[of * k + which] = True
    of, which = np.divmod(np.flatnonzero(marks), k)
    return which, of


def narrowed(m: Matcher, these: np.ndarray) -> Matcher:
    """The same for some of the strings; they keep their numbers."""
    keep = these[m.outs]
    return replace(m, first=np.concatenate([[0], np.cumsum(keep)])[m.first], outs=m.outs[keep])


def key_counts(m: Matcher, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How often the key of each string is in the data."""
    n = len(m.first) - 1
    visits = sum((np.bincount(s, minlength=n) for *_, s in _windows(m, data, begins)), np.zeros(n, np.int64))
    return np.bincount(m.outs, np.repeat(visits, np.diff(m.first)), len(m.strings)).astype(np.int64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number; behind the end come zeros."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) - 7, np.dtype("<u8"), data, 0, (1,))


def _same(m: Matcher, data: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the whole string stands where its key ends; those that are longer than their keys are compared, eight bytes at a time."""
    ok = m.whole[which]
    i = np.flatnonzero(~ok)
    if not len(i):
        return ok
    size = m.size[which[i]]
    begin = at[i] + 1 + m.rest[which[i]] - size
    there = (begin >= 0) & (begin + size <= len(data))
    i, size, begin = i[there], size[there], begin[there]
    mine, text, words = m.begin[which[i]], _words(data), _words(m.bytes)
    step = 0
    while len(i):
        differ = text[begin + step] ^ words[mine + step]
        left = size - step
        differ &= np.where(left < 8, (np.uint64(1) << np.minimum(8 * left, 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
        ok[i[(differ == 0) & (left <= 8)]] = True
        more = (differ == 0) & (left > 8)
        i, size, begin, mine, step = i[more], size[more], begin[more], mine[more], step + 8
    return ok


def apart(m: Matcher, which: np.ndarray, of: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which hits stay when a string's hits on a page may not overlap, from left to right; sorted by string, page and place."""
    ok = np.ones(len(pos), bool)
    n = m.chars[which]
    near = np.zeros(len(pos) + 1, bool)
    near[1:-1] = m.laps[which[1:]] & (which[1:] == which[:-1]) & (of[1:] == of[:-1]) & (pos[1:] < pos[:-1] + n[1:])
    edges = np.flatnonzero(near[1:] != near[:-1])  # of runs of hits that overlap the one before
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        gaps = np.diff(pos[a : z + 1]) if z - a > 32 else []
        if len(gaps) and (gaps == gaps[0]).all():  # as in a row of one character
            ok[a : z + 1] = np.arange(z + 1 - a) % -(-n[a] // gaps[0]) == 0
            continue
        places, free = pos[a : z + 1].tolist(), 0
        for i, x in enumerate(places, a):
            if x < free:
                ok[i] = False
            else:
                free = x + int(n[a])
    return ok
