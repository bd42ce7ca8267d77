"""Similarity of names: longest common subsequence in native expressions, and two Arrow UDFs where there is none."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.functions.names import sorted_tokens, token_overlap


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: rows of the table as an array, folded over the characters of ``a``."""
    right = F.filter(F.split(b, ""), lambda c: c != "")
    zero = F.transform(F.sequence(F.lit(0), F.size(right)), lambda _: F.lit(0))

    def row(previous: Column, ch: Column) -> Column:
        cell = lambda acc, x, i: F.concat(acc, F.array(F.when(x == ch, F.get(previous, i) + 1).otherwise(F.greatest(F.get(previous, i + 1), F.element_at(acc, -1)))))
        pairs = F.transform(right, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.aggregate(pairs, F.array(F.lit(0)), lambda acc, p: cell(acc, p["x"], p["i"]))

    left = F.filter(F.split(a, ""), lambda c: c != "")
    return F.element_at(F.aggregate(left, zero, row), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common_subsequence(a, b) / total)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def hybrid(a: Column, b: Column) -> Column:
    """.6 of the token-sorted ratio and .4 of the token overlap."""
    return 0.6 * token_sort_ratio(a, b) + 0.4 * token_overlap(a, b)


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; 0 where either is null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)])


def subsequence_length(x: str, y: str) -> int:
    """Length of the longest common subsequence, a bit a character of ``x`` (Hyyro 2004)."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(x) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def subsequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio of texts without nulls."""
    return pd.Series([_indel(x, y) / 100 for x, y in zip(a, b, strict=True)], dtype=float)


def _indel(x: str, y: str) -> float:
    return 200.0 * subsequence_length(x, y) / (len(x) + len(y)) if x or y else 100.0


def _token_set(x: set[str], y: set[str]) -> float:
    both = " ".join(sorted(x & y))
    one, two = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
    return max(_indel(both, one) if both else 0.0, _indel(both, two) if both else 0.0, _indel(one, two))


def _partial(x: str, y: str) -> float:
    short, long = sorted((x, y), key=len)
    if short in long:
        return 100.0
    return max((_indel(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)), default=0.0)


def weighted_ratio(x: str | None, y: str | None) -> float:
    """Best of plain, token-sorted and token-set ratios; of windows of the longer text if it is much longer. 0 to 100."""
    if not x or not y:
        return 0.0
    words = [sorted(s.split()) for s in (x, y)]
    sort, sets = _indel(*(" ".join(w) for w in words)), _token_set(*map(set, words))
    share = max(len(x), len(y)) / min(len(x), len(y))
    if share < 1.5:
        return max(_indel(x, y), 0.95 * sort, 0.95 * sets)
    scale = 0.9 if share < 8 else 0.6
    return max(_indel(x, y), scale * _partial(x, y), 0.95 * scale * sort, 0.95 * scale * sets)


@F.pandas_udf(T.DoubleType())
def best_of_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b, strict=True)])


def _tokens(name: str, generic: set[str]) -> set[str]:
    return {w for w in name.split() if len(w) > 1 and w not in generic}


def _spread(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, place and code point of every character of the texts."""
    n = np.array([len(t) for t in texts], np.int64)
    rows = np.repeat(np.arange(len(texts)), n)
    return rows, np.arange(len(rows)) - np.repeat(n.cumsum() - n, n), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def character_rows(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A name is a row of 0 and 1 for "holds the character c at least k times", for all such that both sides know."""
    sides = []
    for side in (x, y):
        rows, _, codes = _spread(side)
        order = np.lexsort((codes, rows))
        rows, codes = rows[order], codes[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])]) if len(rows) else np.zeros(0, np.int64)
        nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        sides.append((len(side), rows, codes << 32 | nth))
    known = np.intersect1d(sides[0][2], sides[1][2])
    return tuple(_marked(size, rows, keys, known) for size, rows, keys in sides)


def _marked(size: int, rows: np.ndarray, keys: np.ndarray, known: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """A matrix of ``size`` rows with the weight where a row has one of the known keys, which are sorted; else 0."""
    m = np.zeros((size, max(1, len(known))), np.float32)
    if len(known) and len(keys):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        m[rows[hit], at[hit]] = weight if np.isscalar(weight) else weight[at[hit]]
    return m


def common_characters(x: list[str], y: list[str]) -> np.ndarray:
    """How many characters each pair of names has in common, in any order: no subsequence is longer.

    The product of two rows of ``character_rows`` counts what both hold.
    """
    a, b = character_rows(x, y)
    return a @ b.T


def common_lengths(x: list[str], y: list[str], i: np.ndarray, j: np.ndarray, run: int = 1 << 15) -> np.ndarray:
    """Length of the longest common subsequence of x[i] and y[j] for arrays of row numbers: 64 pairs' columns a machine word each, all pairs at once.

    The same recurrence as ``subsequence_length``; pairs of which both names are longer than 64 go through that.
    """
    out = np.zeros(len(i), np.int64)
    nx, ny = (np.array([len(t) for t in side], np.int64) for side in (x, y))
    for rows, a, b, p, q, n in ((nx[i] <= 64, x, y, i, j, nx), ((nx[i] > 64) & (ny[j] <= 64), y, x, j, i, ny)):
        at = np.flatnonzero(rows)
        if not len(at):
            continue
        (ua, pa), (ub, qb) = (np.unique(side[at], return_inverse=True) for side in (p, q))  # only names of these pairs
        ra, ka, ca = _spread([a[r] for r in ua.tolist()])
        rb, kb, cb = _spread([b[r] for r in ub.tolist()])
        alphabet = np.unique(ca)
        masks = np.zeros((len(ua), len(alphabet) + 1), np.uint64)  # the first column for characters that no ``a`` has
        np.bitwise_or.at(masks, (ra, np.searchsorted(alphabet, ca) + 1), np.uint64(1) << ka.astype(np.uint64))
        codes = np.zeros((len(ub), int(kb.max(initial=-1)) + 1), np.int64)
        if len(alphabet) and len(cb):
            place = np.minimum(np.searchsorted(alphabet, cb), len(alphabet) - 1)
            codes[rb, kb] = np.where(alphabet[place] == cb, place + 1, 0)
        size = n[ua]
        full = np.array([(1 << int(s)) - 1 for s in size], np.uint64)
        for start in range(0, len(at), run):
            left, right = pa[start : start + run], qb[start : start + run]
            row = full[left].copy()
            for c in codes[right].T:
                hit = row & masks[left, c]
                row = (row + hit) | (row - hit)
            out[at[start : start + run]] = size[left] - np.bitwise_count(row & full[left]).astype(np.int64)
    for k in np.flatnonzero((nx[i] > 64) & (ny[j] > 64)).tolist():
        out[k] = subsequence_length(x[i[k]], y[j[k]])
    return out


def word_rows(x: list[set[str]], y: list[set[str]], weight=lambda w: 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words that both sides know; the left ones hold the words' weights, so a product sums the weights of the words that both sets hold."""
    at = {w: n for n, w in enumerate(sorted(set().union(*x) & set().union(*y)))}
    known, weights = np.arange(len(at)), np.array([weight(w) for w in at], np.float32)
    sides = []
    for side, of in ((x, weights), (y, 1.0)):
        held = [(i, at[w]) for i, words in enumerate(side) for w in words if w in at]
        rows, keys = np.array(held, np.int64).reshape(-1, 2).T
        sides.append(_marked(len(side), rows, keys, known, of))
    return tuple(sides)


def _shared(x: list[set[str]], y: list[set[str]], weight=lambda w: 1) -> np.ndarray:
    """Sum of the weights of the words that each pair of sets shares."""
    a, b = word_rows(x, y, weight)
    return (a @ b.T).astype(np.int64)


def meaningful(texts: list[str], generic: list[str]) -> list[set[str]]:
    """The tokens of each text that count."""
    stop = set(generic)
    return [_tokens(t, stop) for t in texts]


def token_overlaps(x: list[str], y: list[str], generic: list[str]) -> np.ndarray:
    """Jaccard similarity of the meaningful tokens of each pair; 1 if neither has any, 0 if one has none."""
    a, b = meaningful(x, generic), meaningful(y, generic)
    shared = _shared(a, b)
    either = np.array([len(t) for t in a])[:, None] + np.array([len(t) for t in b])[None, :] - shared
    return np.where(either > 0, shared / np.maximum(either, 1), 1.0)


class WeightedBounds:
    """The most that the weighted ratio of pairs of two lists can be, but for windows of the longer name.

    Sorted words and word sets hold no characters that the names lack, but for spaces in place of other blanks, so the common characters of
    the names bound all three ratios; the last are over the lengths of the sets' texts, which are the shorter ones. Of the words that both
    hold, each counts with a space, less one.
    """

    def __init__(self, x: list[str], y: list[str]):
        self.rows = character_rows(*([re.sub(r"\s", " ", t) for t in side] for side in (x, y)))
        sets = [[set(t.split()) for t in side] for side in (x, y)]
        self.words = word_rows(*sets, lambda w: len(w) + 1)
        self.n, self.m = (np.array([len(t) for t in side], np.float32) for side in (x, y))
        self.one, self.two = (np.array([sum(map(len, w)) + max(len(w) - 1, 0) for w in side], np.float32) for side in sets)

    def over(self, start: int, end: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers of the pairs of left rows from ``start`` to ``end`` whose bound is ``least`` or more (under 190); and the block's common characters."""
        common, r = self.rows[0][start:end] @ self.rows[1].T, least / 100
        shared = self.words[0][start:end] @ self.words[1].T
        n, one = self.n[start:end, None], self.one[start:end, None]
        hit = common >= (r / 2) * n + (r / 2) * self.m
        if (r / 2 * self.n > r / 1.9 * self.one).any() or (r / 2 * self.m > r / 1.9 * self.two).any():  # repeated words
            hit |= common >= (r / 1.9) * one + (r / 1.9) * self.two
        shared -= 1
        hit |= shared >= np.minimum(r / (1.9 - r) * one, r / (1.9 - r) * self.two)
        hit &= (common > 0) | (shared >= 0)
        i, j = np.divmod(np.flatnonzero(hit), max(1, len(self.m)))
        return i + start, j, common

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The bounds of single pairs, 0 to 100."""
        dot = lambda a, b: np.einsum("ij,ij->i", a[i], b[j], dtype=np.float64)
        common, both = dot(*self.rows), dot(*self.words) - 1
        one, two = self.one[i].astype(float), self.two[j].astype(float)
        total = self.n[i].astype(float) + self.m[j]
        inside = np.where(both > 0, both / np.maximum(both + np.minimum(one, two), 1), 0.0)
        return np.maximum.reduce([200 * common / np.maximum(total, 1), 190 * common / np.maximum(one + two, 1), 190 * inside])


def weighted_bounds(x: list[str], y: list[str]) -> np.ndarray:
    """The bounds of all pairs."""
    i, j = (m.reshape(-1) for m in np.indices((len(x), len(y))))
    return WeightedBounds(x, y).of(i, j).reshape(len(x), len(y))
