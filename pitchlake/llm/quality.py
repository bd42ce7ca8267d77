"""Quality classifier from weak labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

1. Every document is read once by nine overlapping labellers, each of which votes good, bad or abstains.
2. Documents are counted by vote pattern (at most 3^9 cells). EM on the counts, over all documents, estimates the
   class share and, for each labeller, how it votes on either class; the posterior of a pattern is its soft label.
3. A logistic scorer over hashed features is fitted to the posteriors of a bounded sample: the ``sample``
   documents with the smallest id hashes.
4. Every document is scored; one whose score is below ``threshold`` is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import words
from pitchlake.llm.common import stash, table

BUCKETS = 1 << 14
SAMPLE = 6000
#: Traits and the shares from which a labeller votes: (good if at most, bad if at least); None: it never votes so.
LABELLERS = {
    "symbols": (None, 0.06),
    "capitals": (None, 0.4),
    "repeated_words": (None, 0.25),
    "repeated_shingles": (0.15, 0.5),
    "bars": (None, 0.1),
    "exclamations": (None, 0.1),
    "odd_tokens": (0.1, 0.3),
    "long_words": (0.5, 0.75),
    "unended": (0.98, 0.999),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*<>=^{|}~\\_@+"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[48:58] = ord("0")
_CLASS[128:] = ord("a")


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def traits(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shares: rows x labellers, words per row, word starts' rows' bounds, token hashes) of the rows of a slice."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    token_start = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    token_end = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    bounds = np.searchsorted(token_start, offsets)
    n_tokens = np.diff(bounds)
    low, _, _ = words.word_spans(data, offsets)
    token = words.span_hashes(low, token_start, token_end)
    capital = (data >= 65) & (data <= 90)
    letter = capital | ((data >= 97) & (data <= 122))
    symbol = _SYMBOL[data]
    inked = np.maximum(_per_row(~space, offsets), 1)
    row = np.repeat(np.arange(len(n_tokens)), n_tokens)
    again = np.zeros(len(token), bool)
    again[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
    shingle = token.copy()
    for k in (1, 2):  # only tokens of the same row: a vote must not depend on the document before
        shingle[k:] = shingle[k:] * np.uint64(0x9E3779B97F4A7C15) + np.where(row[k:] == row[:-k], token[:-k], np.uint64(0))
    distinct = words.by_row(words.mix(shingle), n_tokens)[2]
    size = token_end - token_start
    bar = (size == 1) & (data[token_start] == ord("|")) if len(token_start) else np.zeros(0, bool)
    some = np.maximum(n_tokens, 1)
    last = data[token_end - 1] if len(token_end) else np.zeros(0, np.uint8)
    shout = last == ord("!")
    inner = np.concatenate([[0], np.cumsum(~letter & (data < 128) & (data != ord("-")) & (data != 39))])
    body_end = token_end - (~_WORDLIKE[last])
    odd = (inner[body_end] > inner[token_start]) | (size == 1) & ~_WORDLIKE[last]  # more than letters and one mark after them
    ended = (last == ord(".")) | (last == ord("?")) | shout
    shares = np.stack(
        [
            _per_row(symbol, offsets) / inked,
            _per_row(capital, offsets) / np.maximum(_per_row(letter, offsets), 1),
            _per_row(again, bounds) / some,
            1 - distinct / some,
            _per_row(bar, bounds) / some,
            _per_row(shout, bounds) / some,
            _per_row(odd, bounds) / some,
            _per_row(size > 6, bounds) / some,
            1 - _per_row(ended, bounds) / some,
        ],
        axis=1,
    )
    return shares, n_tokens, bounds, token


def votes(shares: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 abstains; documents without words get bad from all that do not measure them."""
    good, bad = (np.array([-1.0 if v[k] is None else v[k] for v in LABELLERS.values()]) for k in (0, 1))
    out = np.where(shares >= bad, -1, np.where(shares <= good, 1, 0)).astype(np.int8)
    out[n_tokens == 0] = -1
    return out


def features(data: np.ndarray, offsets: np.ndarray, shares: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): hashed word shapes with their share of the document, and its traits in steps."""
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    code = kind[keep]
    space = _SPACE[code]
    edge = np.zeros(len(code) + 1, bool)
    edge[at[offsets]] = True
    start = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    end = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    h = words.span_hashes(code, start, end)
    row = np.searchsorted(at[offsets], start, "right") - 1
    n = np.bincount(row, minlength=len(offsets) - 1)
    u, times, per = words.by_row(h, n)
    r = np.repeat(np.arange(len(n)), per)
    step = np.minimum((np.sqrt(np.maximum(shares, 0)) * 12).astype(np.uint64), 12) + (np.arange(shares.shape[1], dtype=np.uint64) * np.uint64(64))[None, :]
    trait_row = np.repeat(np.arange(len(shares)), shares.shape[1])
    bucket = np.concatenate([u, words.mix(step.reshape(-1) + np.uint64(99))]) % np.uint64(BUCKETS)
    value = np.concatenate([np.sqrt(times / np.maximum(n[r], 1)), np.ones(len(trait_row))])
    return np.concatenate([r, trait_row]), bucket.astype(np.int64), value


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(P(good | pattern), accuracies) by EM on counted vote patterns; labellers are independent given the class.

    Starts from every labeller being right in most of its votes, which decides which class is called good.
    """
    vote = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = np.clip(0.5 + patterns.mean(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        w = np.stack([(1 - good) * counts, good * counts])
        share = (w.sum(axis=1) + 1) / (w.sum() + 2)
        table_ = (np.einsum("cp,plv->clv", w, vote) + 0.5) / (w.sum(axis=1)[:, None, None] + 1.5)
        log = np.log(share)[:, None] + np.einsum("plv,clv->cp", vote, np.log(table_))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    right = share[1] * table_[1, :, 2] + share[0] * table_[0, :, 0]
    return good, right / np.maximum(right + share[1] * table_[1, :, 0] + share[0] * table_[0, :, 2], 1e-9)


def fit_scorer(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, soft: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by full-batch AdaGrad; the last weight is the intercept."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    n = len(soft)
    for _ in range(rounds):
        margin = np.bincount(rows, values * w[buckets], n) + w[-1]
        slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - soft) / max(n, 1)
        g = np.bincount(buckets, values * slope[rows], BUCKETS + 1) + decay * w / max(n, 1)
        g[-1] = slope.sum()
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the scorer, accuracies of the labellers). Votes of all documents are counted; ``sample`` documents are fitted."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 3 ** np.arange(len(LABELLERS))
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            for _, _, data, offsets in words.text_slices(b.column(0)):
                shares, n, _, _ = traits(data, offsets)
                total += np.bincount((votes(shares, n) + 1) @ powers, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    counted = base.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    powers = 3 ** np.arange(len(LABELLERS))
    decode = lambda p: (p[:, None] // powers[None, :]) % 3 - 1
    code, n = counted["pattern"].to_numpy(), counted["n"].to_numpy()
    if not len(code):
        return np.zeros(BUCKETS + 1), np.zeros(len(LABELLERS))
    good, accuracy = fit_label_model(decode(code), n)
    posterior = dict(zip(code.tolist(), good.tolist(), strict=True))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in words.text_slices(b.column(0)):
                shares, n_, bounds, _ = traits(data, offsets)
                r, k, v = features(data, offsets, shares, bounds)
                order = np.argsort(r, kind="stable")
                cut = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(n_)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x[order])) for x in (k, v)]
                yield pa.RecordBatch.from_pydict({"pattern": pa.array((votes(shares, n_) + 1) @ powers, pa.int64()), "buckets": lists[0], "values": lists[1]})

    # a bound on the hash first, for a fifth more than is wanted: else every task sends ``sample`` whole texts to one
    most = min((1 << 63) - 1, int(1.2 * sample / n.sum() * 2**64) - (1 << 63))
    near = base.select("text", F.xxhash64("doc_id", F.length("text")).alias("u"), "doc_id").where(F.col("u") <= most)
    chosen = near.orderBy("u", "doc_id").limit(sample).select("text")
    got = chosen.mapInArrow(describe, "pattern long, buckets array<long>, values array<double>").toArrow().combine_chunks()
    sizes = np.diff(got["buckets"].combine_chunks().offsets.to_numpy())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    soft = np.array([posterior[p] for p in got["pattern"].to_pylist()])
    flat = [got[k].combine_chunks().flatten().to_numpy() for k in ("buckets", "values")]
    return fit_scorer(rows, *flat, soft), accuracy


def score(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.25) -> DataFrame:
    """``docs`` with quality_score, the scorer's probability of good, and good (score at least ``threshold``).

    Defined cases: a null or empty text, or one of white space alone, scores 0 and is bad; repeated rows score alike;
    a null doc_id is scored like any other; an empty table gives an empty table; extra columns stay, quality_score and
    good are replaced.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(train(docs, sample)[0])
    names = [c for c in docs.columns if c not in ("quality_score", "good")]
    at = names.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            parts = [np.zeros(0)]
            for _, _, data, offsets in words.text_slices(b.column(at)):
                shares, n, bounds, _ = traits(data, offsets)
                r, k, v = features(data, offsets, shares, bounds)
                margin = np.bincount(r, v * w[k], len(n)) + w[-1]
                parts.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(margin, -40, 40))), 0.0))
            p = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(p >= threshold)], names=[*names, "quality_score", "good"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)
    return docs.select(names).mapInArrow(apply, f"{fields}, quality_score double, good boolean")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "good")
