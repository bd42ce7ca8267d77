"""Vectorised word and shingle hashing over Arrow batches of text.

A word is a maximal run of letters and digits; ASCII and Latin-1 letters are folded to lower case, every other
non-ASCII letter is kept as it is, Latin-1 and general punctuation separates. A document with fewer words than a
shingle has its whole word list as its only shingle; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_103_515_245
_prime_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def _geometric(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime, by doubling."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, int(_PRIME))) % _PRIME
        done += step
    return out


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_prime_powers[0]) < n:
        size = max(n, 1 << 19)
        for i, b in enumerate((_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME)))):
            _prime_powers[i] = _geometric(b, size)
    return _prime_powers[0][:n], _prime_powers[1][:n]


class Prefixes:
    """Prefix sums over codes from which every span's hash follows: one modulo 2^64 and one modulo a prime.

    Texts made for it can collide in the first (its low bits repeat), not in both.
    """

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes) + 1
        c = codes.astype(np.uint64)
        up, self.down = powers(n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((c + np.uint64(1)) * up[:-1], out=self.sums[1:])
        up, self.prime_down = prime_powers(n)
        small = c if codes.dtype.itemsize < 4 else c % _PRIME
        x = (small + np.uint64(1)) * up[:-1]
        self.prime_sums = np.zeros(n, np.uint64)
        np.cumsum((x & _PRIME) + (x >> np.uint64(31)), out=self.prime_sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        """Equal spans (with equal salts) get equal hashes wherever they lie."""
        one = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        two = (self.prime_sums[ends] - self.prime_sums[starts]) % _PRIME * self.prime_down[starts] % _PRIME
        return mix(one + two * np.uint64(0xC2B2AE3D27D4EB4F) + np.asarray(salt).astype(np.uint64))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash codes[s:e] for each span by prefix sums."""
    return Prefixes(codes).hashes(starts, ends)


def text_slices(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of runs of rows with about ``limit`` bytes; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and the starts and ends of words; no word crosses a row."""
    low = _LOWER[data]
    word = _WORD[data]
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        low[capital] += 32
        for lead, second, width in ((0xC2, None, 2), (0xE2, 0x80, 3)):
            at = np.flatnonzero(data[: 1 - width] == lead) if len(data) >= width else np.zeros(0, int)
            at = at if second is None else at[data[at + 1] == second]
            for k in range(width):
                word[at + k] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]]))) if len(data) else np.zeros(0, int)
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1 if len(data) else np.zeros(0, int)
    return low, starts, ends


def shingles(texts: pa.Array, size: int, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, counts of shingles per row), for runs of rows."""
    for first, _, data, offsets in text_slices(texts, limit):
        low, starts, ends = word_spans(data, offsets)
        words = span_hashes(low, starts, ends)
        begin = np.searchsorted(starts, offsets)
        n_words = np.diff(begin)
        n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
        at = np.repeat(begin[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.minimum(size, np.repeat(n_words, n))
        h = np.zeros(len(at), np.uint64)
        padded = np.concatenate([words, np.zeros(size, np.uint64)])
        short = len(width) and width.min() < size
        for k in range(size):
            word = padded[at + k]
            if short:
                word = np.where(k < width, word, np.uint64(0))
            h *= _BASE
            h += word
        yield first, mix(h), n


def by_row(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order: (hashes, how often in the row, distinct per row)."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    h = h.copy()
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.bincount(row[at], minlength=len(n))
