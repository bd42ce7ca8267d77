"""Near-dedup against brute force: large components, repeated and null ids, extra columns, recall of near copies."""

import random
from collections import Counter

import numpy as np
import pytest

from pitchlake.llm import near_dup

from test_operators import near_classes, prose

SHAPE = "doc_id long, text string, k1 string, component int, n int, class_id string, head int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "c", 3) for i, t in rows], SHAPE)


def edited(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"zz{rng.randrange(10**6)}"
    return " ".join(w)


def test_components_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 6)
    rng = random.Random(41)
    base, other = prose(rng, 120), prose(rng, 90)
    texts = [edited(rng, base, 1) for _ in range(25)]
    chain = [base]
    for _ in range(8):
        chain.append(edited(rng, chain[-1], 1))
    half = [edited(rng, base, rng.randint(2, 6)) for _ in range(20)]
    texts += chain + half + [edited(rng, other, 1) for _ in range(10)] + [prose(rng, 60) for _ in range(10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, rows).repartition(4)).collect()}
    assert got == near_classes(dict(rows))


def test_rows_of_repeated_and_null_ids(spark):
    rng = random.Random(42)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(5, a), (5, b), (5, b), (3, edited(rng, b, 1)), (9, a), (None, c), (None, edited(rng, c, 1)), (None, d), (8, d), (1, None), (1, None), (None, None), (2, ""), (4, ""), (6, " . "), (7, "one two")]
    df = frame(spark, rows)
    got = near_dup.near_duplicates(df)
    assert got.columns == ["doc_id", "class_id", "n_in_class", "kept"]
    want = [(5, 5), (5, 3), (5, 3), (3, 3), (9, 5), (None, None), (None, None), (None, 8), (8, 8), (1, 1), (1, 1), (None, None), (2, 2), (4, 2), (6, 6), (7, 7)]
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == Counter(want)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.collect())
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[0], rows[3], rows[5], rows[6], rows[8], rows[9], rows[10], rows[11], rows[12], rows[14], rows[15]])


@pytest.mark.parametrize(("changed", "least"), [(1, 0.99), (2, 0.97)])
def test_recall_of_near_copies(spark, changed, least):
    """Pairs of 120 words, one or two of which differ: their similarity is 0.92 or about 0.84, over the threshold."""
    rng = random.Random(43 + changed)
    texts = [prose(rng, 120) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, edited(rng, t, changed)) for i, t in enumerate(texts)]
    truth = near_classes(dict(rows[:40] + rows[150:190]))
    pairs = [i for i in range(40) if truth[1000 + i] == i]
    assert len(pairs) >= 38
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    linked = [i for i in range(150) if got[1000 + i] == got[i] == i]
    assert len(linked) / 150 >= least and len({got[i] for i in range(150)}) == 150


def test_samples_follow_the_weighted_similarity():
    """The share of equal samples of two weighted sets estimates their weighted Jaccard similarity."""
    rng = np.random.default_rng(44)
    gamma = near_dup._gamma_quantiles()
    h = np.sort(rng.integers(0, 2**63, 80, dtype=np.uint64))
    x, y = rng.integers(1, 4, 80).astype(float), rng.integers(1, 4, 80).astype(float)
    s = near_dup.icws(np.concatenate([h, h]), np.log(np.concatenate([x, y])), np.array([80, 80]), 3000, gamma, np.log(gamma))
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03
