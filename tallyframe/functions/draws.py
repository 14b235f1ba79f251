"""Draws by numpy over whole matrices of keys: the md5 places of ``md5_uniform`` and the binomial
inverse at a place, with the same results as row by row."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_K = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_LEFT = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_RIGHT = 32 - _LEFT
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = tuple(np.full((1, 1), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
#: Pairs that are hashed at once: a few arrays of this size fit a core's cache.
HASH_PAIRS = 40_960


class Texts:
    """Texts as bytes: where each begins and how long it is."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray):
        self.starts, self.lengths, self.data, self._tails = starts, lengths, data, {}

    @staticmethod
    def of(array) -> "Texts":
        """Of an Arrow array of strings without nulls."""
        wide = "<i8" if "large" in str(array.type) else "<i4"
        at = np.frombuffer(array.buffers()[1], wide)[array.offset:array.offset + len(array) + 1].astype(np.int64)
        data = array.buffers()[2]
        return Texts(at[:-1], np.diff(at), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))

    def rows(self, rows) -> "Texts":
        return Texts(self.starts[rows], self.lengths[rows], self.data)

    def by_length(self):
        """Per length: the rows that have it and their bytes."""
        for n in np.unique(self.lengths):
            rows = np.flatnonzero(self.lengths == n)
            yield rows, self.data[self.starts[rows][:, None] + np.arange(n)]

    def tails(self, head: int) -> list:
        """As ends of messages that begin with ``head`` bytes, by their number of md5 blocks: the
        rows, their words (word by row), and which words are not the same in all of them."""
        if head not in self._tails:
            out, ends = [], head + self.lengths
            for blocks in np.unique((ends + 8) // 64 + 1):
                rows = np.flatnonzero((ends + 8) // 64 + 1 == blocks)
                words = np.zeros((len(rows), 64 * blocks), np.uint8)
                for here, text in self.rows(rows).by_length():
                    end = head + text.shape[1]
                    words[here, head:end] = text
                    words[here, end] = 0x80
                    words[here, -8:] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
                words = np.ascontiguousarray(words.view("<u4").T)
                out.append((rows, words, (words != words[:, :1]).any(axis=1)))
            self._tails[head] = out
        return self._tails[head]


def _md5(head: np.ndarray, words: np.ndarray, varies: np.ndarray, room: list) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of every head (row by byte) with every tail. Steps that no
    tail has entered yet are taken once a head; a word that is the same in all messages is added
    as one number. ``room`` is arrays of as many pairs or more, to work in."""
    n, tails = len(head), words.shape[1]
    own = np.zeros((n, 4 * len(words)), np.uint8)
    own[:, :head.shape[1]] = head
    own = own.view("<u4") + np.where(varies, 0, words[:, 0]).astype(np.uint32)
    same = (own == own[0]).all(axis=0) & ~varies
    word = [own[0, w] if same[w] else own[:, w, None] + words[w] if varies[w] else own[:, w, None] for w in range(len(words))]
    state, shape, free = _START, (n, 1), []
    for first in range(0, len(words), 16):
        a, b, c, d = state
        for i in range(64):
            w = first + _WORD[i]
            if varies[w] and shape[1] != tails:
                shape, free = (n, tails), [r[:n] for r in room]
            t, r = (free.pop() if free else np.empty(shape, np.uint32) for _ in range(2))
            if i < 16:
                np.bitwise_and(c ^ d if c.shape == d.shape != shape else np.bitwise_xor(c, d, out=t), b, out=t)
                np.bitwise_xor(t, d, out=t)
            elif i < 32:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_and(t, d, out=t)
                np.bitwise_xor(t, c, out=t)
            elif i < 48:
                if i % 2 == 0:
                    x = free.pop() if free else np.empty(shape, np.uint32)
                    np.bitwise_xor(b, c, out=x)
                    np.bitwise_xor(x, d, out=t)
                else:  # the last two of this step are the first two of the one before
                    np.bitwise_xor(b, x, out=t)
                    free.append(x)
            else:
                np.invert(d, out=t)
                np.bitwise_or(t, b, out=t)
                np.bitwise_xor(t, c, out=t)
            if varies[w]:
                np.add(t, word[w], out=t)
                np.add(t, _K[i], out=t)
                np.add(t, a, out=t)
            elif a.shape == shape:
                np.add(t, np.add(word[w], _K[i], dtype=np.uint32), out=t)
                np.add(t, a, out=t)
            else:
                np.add(t, a + np.add(word[w], _K[i], dtype=np.uint32), out=t)
            np.right_shift(t, _RIGHT[i], out=r)
            np.left_shift(t, _LEFT[i], out=t)
            np.bitwise_or(t, r, out=t)
            np.add(t, b, out=t)
            free.append(r)
            if a.shape == shape and not any(a is x for x in state):
                free.append(a)
            a, b, c, d = d, t, b, c
        state = tuple(x + y for x, y in zip(state, (a, b, c, d), strict=True))
    return state[0], state[1]


def md5_places(heads: Texts, tails: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The first 52 bits of the md5 of every head followed by every tail, as 32 and 20 bits."""
    high, low = (np.empty((len(heads.starts), len(tails.starts)), np.uint32) for _ in range(2))
    for rows, text in heads.by_length():
        for cols, words, varies in tails.tails(text.shape[1]):
            step = -(-len(rows) // max(1, round(len(rows) * len(cols) / HASH_PAIRS)))  # even blocks of rows
            every = len(cols) == high.shape[1]
            room = [np.empty((step, len(cols)), np.uint32) for _ in range(8)]
            for i in range(0, len(rows), step):
                a, b = _md5(text[i:i + step], words, varies, room)
                at = rows[i:i + step] if every else np.ix_(rows[i:i + step], cols)
                high[at], low[at] = a.byteswap(), b.byteswap() >> np.uint32(12)
    return high, low


def uniform(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The place in (0, 1) of 52 bits."""
    return ((high.astype(np.int64) << 20 | low).astype(float) + 0.5) / float(1 << 52)


def binomial_inverse(u: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Successes of ``n`` trials of probability p at the place u of their distribution function."""
    low = p <= 0.5
    q = np.where(low, p, 1.0 - p)  # the rarer outcome: its first term does not vanish
    nan = np.isnan(p)
    ratio = q / (1.0 - q)
    term = (1.0 - q) ** n
    below, k, rows = term.copy(), np.zeros(len(u)), np.arange(len(u))
    for j in range(n):
        more = below < u
        left = np.count_nonzero(more)
        if not left:
            break
        if 4 * left < 3 * len(rows):  # go on with the rows that are not there yet
            rows, u, below, term, ratio = rows[more], u[more], below[more], term[more], ratio[more]
            k[rows] += 1
        else:
            k[rows] += more
        term = term * ((n - j) / (j + 1)) * ratio
        below = below + term
    return np.where(nan, np.nan, np.where(low, k, n - k))


#: Cells of the table of binomial inverses along p (each side of one half) and bits along u.
P_CELLS, U_BITS = 2048, 10
_OPEN = np.iinfo(np.uint16).max


@lru_cache(maxsize=4)
def _inverse_table(n: int) -> np.ndarray:
    """Successes of ``n`` trials by cell of p and u, ``_OPEN`` where a cell has several counts.
    Row i holds p of ((i - 1) / 2 P_CELLS, i / 2 P_CELLS], row 0 no chance at all."""
    q = np.arange(P_CELLS + 1) / (2 * P_CELLS)
    term, below = (1.0 - q) ** n, np.empty((len(q), n + 1))
    below[:, 0] = term
    for j in range(n):
        term = term * ((n - j) / (j + 1)) * (q / (1.0 - q))
        below[:, j + 1] = below[:, j] + term
    u, eps = np.arange(2**U_BITS + 1) / 2**U_BITS, 1e-10  # far above the rounding of the sums
    least = np.array([np.searchsorted(row, u[:-1] - eps) for row in below])
    most = np.array([np.searchsorted(row, u[1:] + eps) for row in below])
    least, most = np.minimum(least, n), np.minimum(most, n)
    table = np.full((2 * P_CELLS + 1, 2**U_BITS), _OPEN, np.uint16)
    table[0] = 0
    sure = least[:-1] == most[1:]
    table[1:P_CELLS + 1][sure] = least[:-1][sure]
    table[P_CELLS + 1:][sure[::-1]] = n - least[:-1][::-1][sure[::-1]]
    return table.ravel()


def binomial_at(high: np.ndarray, low: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """``binomial_inverse`` at the places of ``md5_places``: most are read off a table, those in
    cells with several counts (and p that is none) are summed as there."""
    shape, high, low, p = p.shape, high.ravel(), low.ravel(), p.ravel()
    none = ~((p >= 0.0) & (p <= 1.0))
    odd = none.any()
    cell = (np.where(none, 0.0, p) if odd else p) * float(2 * P_CELLS)
    cell = np.ceil(cell, out=cell).astype(np.intp)
    cell <<= U_BITS
    cell += high >> np.uint32(32 - U_BITS)
    k = _inverse_table(n).take(cell)
    at = np.flatnonzero((k == _OPEN) | none if odd else k == _OPEN)
    k = k.astype(float)
    k[at] = binomial_inverse(uniform(high[at], low[at]), p[at], n)
    return k.reshape(shape)
