"""The label model against EM over single rows, the scorer against the given labels, and the defined cases."""

import itertools
import math
import random

import numpy as np
import pytest

from pitchlake.llm import quality

from test_operators import prose


def em_by_rows(rows, rounds):
    """P(good) of each row and accuracies, one row and one labeller after the other."""
    labellers = len(rows[0])
    good = [min(0.95, max(0.05, 0.5 + sum(r) / labellers)) for r in rows]
    for _ in range(rounds):
        weight = [[1 - g for g in good], good]
        total = [math.fsum(w) for w in weight]
        share = [(t + 1) / (sum(total) + 2) for t in total]
        table = [[[(math.fsum(w for w, r in zip(weight[c], rows, strict=True) if r[k] == v) + 0.5) / (total[c] + 1.5) for v in (-1, 0, 1)] for k in range(labellers)] for c in (0, 1)]
        log = [[math.log(share[c]) + math.fsum(math.log(table[c][k][r[k] + 1]) for k in range(labellers)) for r in rows] for c in (0, 1)]
        good = [1 / (1 + math.exp(min(50, max(-50, a - b)))) for a, b in zip(*log, strict=True)]
    accuracy = []
    for k in range(labellers):
        right, wrong = (share[1] * table[1][k][a] + share[0] * table[0][k][b] for a, b in ((2, 0), (0, 2)))
        accuracy.append(right / max(right + wrong, 1e-9))
    return good, accuracy


def test_em_over_all_patterns_equals_em_by_rows():
    rng = random.Random(8)
    patterns = list(itertools.product((-1, 0, 1), repeat=4))
    counts = [rng.choice([0, 1, 1, 2, 5]) for _ in patterns]
    rows = [p for p, n in zip(patterns, counts, strict=True) for _ in range(n)]
    used = [(p, n) for p, n in zip(patterns, counts, strict=True) if n]
    good, accuracy = quality.fit_label_model(np.array([p for p, _ in used]), np.array([n for _, n in used]), 40)
    want, right = em_by_rows(rows, 40)
    by_pattern = dict(zip(rows, want, strict=True))
    assert good == pytest.approx([by_pattern[p] for p, _ in used], abs=1e-9) and accuracy == pytest.approx(right, abs=1e-9)


def test_em_finds_the_accuracies_of_planted_labellers():
    rng = random.Random(3)
    true = [0.95, 0.85, 0.8, 0.7, 0.9]
    rows = []
    for _ in range(8000):
        y = 1 if rng.random() < 0.7 else -1
        rows.append(tuple(0 if rng.random() < 0.3 else y if rng.random() < a else -y for a in true))
    patterns = sorted(set(rows))
    _, accuracy = quality.fit_label_model(np.array(patterns), np.array([rows.count(p) for p in patterns]))
    assert accuracy == pytest.approx(true, abs=0.04)


def test_given_labels(spark):
    """Held against labels that no step has seen."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.quality_score, labels[r.doc_id], r.good) for r in quality.op10_quality_classifier(spark, sf).collect() if r.doc_id in labels]
    good, bad = ([s for s, y, _ in got if y == k] for k in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert len(bad) > 30 and auc >= 0.999 and all(k == bool(y) for _, y, k in got)


def test_defined_cases(spark):
    rng = random.Random(1)
    clean = [prose(rng, rng.randint(30, 120)) for _ in range(60)]
    rows = [(i, t, "kept", 5, False) for i, t in enumerate(clean)]
    rows += [(None, clean[0], "kept", 5, False), (None, None, None, 5, None), (900, "", "x", 5, True), (901, " \n\t ", "x", 5, True), (902, " ".join(clean) * 60, "x", 5, True), (3, clean[3], "kept", 5, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality_score int, good boolean").repartition(4)
    out = quality.score(docs)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "source", "quality_score", "good"] and len(got) == len(rows)
    score = {}
    for r in got:
        score.setdefault(r.text, set()).add(r.quality_score)
        assert r.good == (r.quality_score >= 0.25)
    assert all(len(s) == 1 for s in score.values()) and score[None] == score[""] == score[" \n\t "] == {0.0}
    assert all(r.good for r in got if r.text and r.text.strip())
