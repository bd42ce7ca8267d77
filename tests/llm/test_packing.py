"""The packing plan against bounds and the tokenizer against its file."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pitchlake.llm import packing, tokens

from test_operators import prose


def checked(lengths, demand, capacity=2048):
    """Number of sequences of a plan that holds every piece once."""
    made = packing.plan(np.array(lengths), np.array(demand), capacity)
    used = Counter()
    for times, items in made:
        assert times > 0 and sum(size * often for size, often in items) <= capacity
        for size, often in items:
            used[size] += times * often
    assert used == Counter({s: d for s, d in zip(lengths, demand, strict=True) if d})
    return sum(t for t, _ in made), len(made)


@pytest.mark.parametrize(
    ("lengths", "demand", "most"),
    [([1100], [1_000_000], 1_000_000), ([700], [1_000_000], 500_000), ([1100, 1500, 1900], [4000] * 3, 12_000), ([1024, 2048], [7, 5], 9), ([1], [2049], 2), ([683, 682], [2000, 1000], 1000), ([1025, 1023], [10**6, 10**6], 10**6), ([2048], [3], 3)],
)
def test_plans_of_lengths_that_do_not_fill_a_sequence(lengths, demand, most):
    began = time.perf_counter()
    n, entries = checked(lengths, demand)
    assert n <= most and entries <= 8 * len(lengths) + 200 and time.perf_counter() - began < 20


@pytest.mark.parametrize(("kind", "over"), [("lognormal", 1.002), ("uniform", 1.015), ("four", 1.045), ("normal", 1.001)])
def test_plan_is_near_its_bound_and_does_not_grow_with_the_documents(kind, over):
    rng = np.random.default_rng(8)
    sample = {"lognormal": rng.lognormal(5.5, 1, 30_000), "uniform": rng.uniform(500, 1200, 30_000), "four": rng.choice([690, 701, 1030, 340], 30_000), "normal": rng.normal(1000, 30, 30_000)}[kind]
    lengths, demand = np.unique(np.clip(sample.astype(int), 1, 2048), return_counts=True)
    n, entries = checked(lengths.tolist(), demand.tolist())
    _, prices, bound = packing.solve_program(lengths, demand.astype(float), 2048)
    assert n <= over * bound + 2, (n, bound)
    many, more = checked(lengths.tolist(), (demand * 1000).tolist())
    assert many <= over * 1000 * bound and more <= 8 * entries + 24 * len(lengths)
    assert packing.price_patterns(prices, lengths, 2048)[0][-1] <= 1 + 1e-9  # no pattern is worth more than a sequence


@pytest.mark.parametrize(("each", "bound"), [(200, 204_900), (5, 5_123)])
def test_every_length_alike(each, bound):
    lengths = np.arange(1, 2049)
    assert (lengths * each).sum() / 2048 > bound - 1 and checked(lengths.tolist(), [each] * 2048)[0] == bound


def test_never_above_best_fit():
    rng = np.random.default_rng(2)
    for sample in (rng.uniform(700, 2048, 4000), rng.lognormal(6, 1.2, 4000), rng.integers(1, 60, 500), rng.choice([1025, 700, 690, 340, 12], 3000), rng.exponential(300, 3000)):
        lengths, demand = np.unique(np.clip(sample.astype(int), 1, 2048), return_counts=True)
        fit = sum(n for n, _ in packing.best_fit(lengths, demand.astype(np.int64), 2048))
        assert checked(lengths.tolist(), demand.tolist())[0] <= fit


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a b", "x", 1), (None, None, "y", 2), (7, "a b", "z", 3), (7, "a b", "z", 3), (7, "other words here", "z", 4), (8, "", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(3)
    got = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in got) == {None: 2, 7: 3, 8: 1} and all(r.piece == 0 and r.start == 0 for r in got)
    assert len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got) == [sum(sorted_lengths[:k]) for sorted_lengths in [[r.length for r in sorted(got, key=lambda r: r.offset)]] for k in range(len(got))]
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_equals_best_fit_piece_by_piece():
    rng = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 12))))
        left = np.array([rng.randint(0, 9) for _ in lengths])
        rooms = []
        for size, n in sorted(zip(lengths.tolist(), left.tolist(), strict=True), reverse=True):
            for _ in range(n):
                fit = min((r for r in rooms if r >= size), default=None)
                if fit is None:
                    rooms.append(50 - size)
                else:
                    rooms[rooms.index(fit)] -= size
        made = packing.best_fit(lengths, left, 50)
        assert Counter({r: rooms.count(r) for r in rooms}) == sum((Counter({50 - sum(s * o for s, o in items): n}) for n, items in made), Counter())


def test_tokens_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 30)
    monkeypatch.setattr(tokens, "SLICE_CHARS", 200)
    path = packing.vocabulary()
    whole, own = Tokenizer.from_file(path), tokens.PieceTokenizer(path)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.known) <= 30 + 400


def test_tokens_of_pieces_that_share_a_hash():
    path = packing.vocabulary()
    whole, own = Tokenizer.from_file(path), tokens.PieceTokenizer(path)
    own.hashes = lambda code, starts, ends: ((ends - starts) % 5).astype(np.uint64)
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(20)] + ["", "été à", "a" * 3000]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
