"""The divergence audit against plain Python, and its products against single prices."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitchlake.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, ranks=200):
    """{(lang, source, part, item, value, rank)}. rows: (text, lang, source)."""
    docs = [(TERM.findall((t or "").translate(LOWER)), lang or "", s or "") for t, lang, s in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        mine = [(w, s) for w, x, s in docs if x == lang]
        held = Counter(t for w, _ in mine for t in set(w))
        kept = sorted(t for t in held if held[t] >= least)
        count = defaultdict(Counter)
        for w, s in mine:
            count[s].update(t for t in w if held[t] >= least)
        whole = sum((count[s] for s in count), Counter())
        v = len(kept)
        share = lambda c, v=v, kept=kept: {t: 1 + 1_000_000_000 * (c[t] + 1) // (c.total() + v) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: share(count[s]) for s in count}, share(whole)
        ranked = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
        for s in count:
            out |= {(lang, s, "pair", i, x, n) for n, (i, x) in enumerate(ranked([(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in count if o != s]), 1)}
            out |= {(lang, s, "term", i, x, n) for n, (i, x) in enumerate(ranked([(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]])[:ranks], 1)}
    return out


def corpus():
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "abcdeéΩ" for b in "xyzß"] + ["Ab", "AB", "don't", "x1y", "日本語", "Ä"]
    rows = [(" ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=rng.randint(0, 60))), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "S3", "é", "hot", "hot", "hot"])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", None, None), ("only here now", "xx", "a"), ("nothing kept", "xx", "b"), ("ax by", "lone", "a"), (None, None, "z")]
    return rows + [rows[0]] * 3


def held(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(6)


def test_against_plain_python(spark):
    rows = corpus()
    assert held(D.audit(frame(spark, rows))) == plain(rows)
    assert held(D.audit(frame(spark, rows), 2, 3)) == plain(rows, 2, 3)


@pytest.mark.parametrize(("terms", "block"), [(4, 2), (1000, 1), (3, 100)])
def test_blocks_do_not_matter(spark, terms, block):
    rows = corpus()
    groups, _, vocabulary, kept = D.counted(frame(spark, rows))
    got = {tuple(r) for r in D.pair_part(groups, vocabulary, kept, terms, block, 200).collect()}
    assert got == {(a, s, i, v, n) for a, s, part, i, v, n in plain(rows) if part == "pair"}


def test_products_are_exact():
    rng = np.random.default_rng(4)
    left, right = rng.zipf(1.4, (500, 5)) % 10_000 - 1, rng.zipf(1.3, (500, 4)) % 100_000_000 - 1
    t1, t2 = left.sum(axis=0), right.sum(axis=0) + 10**9
    v, absent = 700, 200
    for cells in (50, 1 << 22):
        there, back = D.joint_prices(left, right, t1, t2, v, absent, cells)
        for g in range(5):
            for h in range(4):
                p = [1 + 10**9 * (int(c) + 1) // (int(t1[g]) + v) for c in [*left[:, g], *[0] * absent]]
                q = [1 + 10**9 * (int(c) + 1) // (int(t2[h]) + v) for c in [*right[:, h], *[0] * absent]]
                assert there[g, h] == sum((a - b) ** 2 // b for a, b in zip(p, q, strict=True))
                assert back[g, h] == sum((a - b) ** 2 // a for a, b in zip(p, q, strict=True))


def test_counts_over_slices(spark):
    rows = corpus()
    docs = frame(spark, rows).coalesce(1)
    total = lambda df: {(r.lang, r.source, r.term): (r.n, r.docs) for r in df.groupBy("lang", "source", "term").agg({"n": "sum", "docs": "sum"}).toDF("lang", "source", "term", *(["n", "docs"])).collect()}
    few = total(D.term_counts(docs, 200))
    want = defaultdict(lambda: [0, 0])
    for t, lang, s in rows:
        for w, n in Counter(TERM.findall((t or "").translate(LOWER))).items():
            want[lang or "", s or "", w][0] += n
            want[lang or "", s or "", w][1] += 1
    assert {k: tuple(sorted(x)) for k, x in few.items()} == {k: tuple(sorted(x)) for k, x in want.items()}


def test_long_text_and_empty_table(spark):
    long = [("word " * 400_000 + "other", "en", "a"), ("word", "en", "b"), ("word", "en", "b")]
    assert held(D.audit(frame(spark, long))) == plain(long)
    assert D.audit(frame(spark, [])).count() == 0
