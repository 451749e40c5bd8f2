"""Vectorised splitting and hashing of words over a batch of texts.

All bytes of a batch are hashed in one pass: a prefix sum of ``byte * P**i`` modulo 2**64 gives
each word's polynomial hash as a difference, made independent of its place by ``P**-start``.
"""

from __future__ import annotations

import numpy as np

_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes that separate words: space and the five controls from tab to carriage return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(1 << 18, 1 << int(n).bit_length())
        table = np.full(size, base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if size <= 1 << 20:
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser in which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def chunks(texts: list, size: int = 1 << 17):
    """Ranges of texts of about ``size`` characters, a longer text alone."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if total and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def spans(texts: list[bytes], is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, first word of each text and the end) of a batch."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = is_word[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return buf, starts, ends, np.searchsorted(starts, at)


def blocks(starts: np.ndarray, ends: np.ndarray, size: int = 1 << 17):
    """Ranges of words that span about ``size`` bytes, a longer word alone: what is made for each byte or
    word is made for one range at a time, so a very long text needs no more memory than many short ones."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, side="right")))
        yield i, j
        i = j


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    for i, j in blocks(starts, ends):
        lo, hi = int(starts[i]), int(ends[j - 1])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * _power_table(_PRIME, hi - lo)[: hi - lo], out=sums[1:])
        h = (sums[b] - sums[a]) * _power_table(_INVERSE, hi - lo)[a]
        out[i:j] = mix(h + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` consecutive words, A-Z lower-cased.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        buf, starts, ends, first = spans([utf8(t).lower() for t in texts[a:b]])
        h = word_hashes(buf, starts, ends)
        m = max(0, len(h) - width + 1)
        rolled = np.zeros(m, np.uint64)
        for k in range(width):
            rolled += mix(h[k : k + m] + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        rolled = mix(rolled)
        for i in range(b - a):
            x, y = first[i], first[i + 1]
            if y - x >= width:
                out.append(np.unique(rolled[x : y - width + 1]))
            elif y > x:
                few = h[x:y] + np.arange(1, y - x + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
                out.append(mix(np.array([mix(few).sum(dtype=np.uint64)], np.uint64) + np.uint64(y - x)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def word_counts(texts: list) -> np.ndarray:
    return np.array([len(utf8(t).split()) if t else 0 for t in texts], np.int64)
