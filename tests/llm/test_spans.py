"""Substring dedup against brute force over words, and the hashes it stands on."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import substring_dedup as op
from pitchlake.llm import words

from test_operators import WORDS, prose

RULE = (3, 15, 25)


def span_words(text):
    """{(first byte, last byte): folded words} of the spans of a text; the words stand for the hash."""
    out = {}
    for _, _, data, offsets in words.text_slices(pa.array([text])):
        _, first, stop, h = op.spans(data, offsets, *RULE)
        for a, z, k in zip(first.tolist(), stop.tolist(), h.tolist(), strict=True):
            own = tuple(re.findall(r"\w+", text.encode()[a:z].decode().lower()))
            out[a, z, k] = own
    return out


def by_hand(rows):
    """(text, removed bytes) of each row: rows equal in id and text are one document, in the order of ids, then of the text's hash."""
    documents = sorted({(i is None, i or 0, u, t) for i, t, u in rows if t is not None})
    seen, cut = set(), {}
    for null, i, u, t in documents:
        gone = np.zeros(len(t.encode()), bool)
        for (a, z, k), key in sorted(span_words(t).items()):
            if (key, k) in seen:
                gone[a:z] = True
            seen.add((key, k))
        cut[null, i, u, t] = (bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g).decode(), int(gone.sum()))
    return [(i, *((None, 0) if t is None else cut[i is None, i or 0, u, t])) for i, t, u in rows]


def planted(rng):
    shared = " ".join(f"{' '.join(rng.choice(WORDS) for _ in range(11)).capitalize()}." for _ in range(6))
    accents = " ".join("Ça été déjà là où naïve façade côté élève être garçon." for _ in range(1)) + " " + " ".join(f"{rng.choice(WORDS).capitalize()} été là {rng.choice(WORDS)} ñandú {rng.choice(WORDS)} 漢字 {rng.choice(WORDS)} Öl {rng.choice(WORDS)}." for _ in range(5))
    rows = [(i, f"{prose(rng, 40)} {shared} {prose(rng, 30)}") for i in range(30)]
    rows += [(i, f"{prose(rng, 20)} {accents} {prose(rng, 30)}") for i in range(40, 48)]
    rows += [(50, rows[0][1])] * 2 + [(51, accents)] * 3 + [(51, f"é{shared}"), (51, prose(rng, 60)), (51, "Öäü " + prose(rng, 60))]
    rows += [(None, shared), (None, shared), (None, prose(rng, 50)), (None, None), (60, None), (61, ""), (62, "Short."), (63, " ".join([shared] * 3))]
    return rows


@pytest.mark.parametrize("least_hot", [2, 12, 1000])
def test_remove_repeats_by_brute_force(spark, least_hot):
    rows = planted(random.Random(21))
    df = spark.createDataFrame([(i, t, "c", 1, 2, 3) for i, t in rows], "doc_id long, text string, first string, size int, h int, removed_bytes long")
    keyed = [(r.doc_id, r.text, r.u) for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("u")).collect()]
    got = op.remove_repeats(df.repartition(5), least_hot=least_hot)
    assert got.columns == ["doc_id", "text", "first", "size", "h", "removed_bytes"]
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.text, r.removed_bytes) for r in got.collect()) == order(by_hand(keyed))


def test_one_of_equal_rows_is_not_cut(spark):
    text = prose(random.Random(3), 60)
    got = op.remove_repeats(spark.createDataFrame([(7, text), (7, text), (8, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(7, text), (7, text), (8, "")]


def test_runs_that_go_on_in_other_batches():
    def rows(h):
        n = len(h)
        return pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "doc": pa.array(range(n), pa.int64()), "uid": pa.array([0] * n, pa.int64()), "first": pa.array([0] * n, pa.int32()), "size": pa.array([1] * n, pa.int32())})

    rng = random.Random(5)
    for _ in range(60):
        h = sorted(rng.choice([1, 2, 3, 4, 5, 6]) for _ in range(rng.randint(1, 40)))
        whole, least = rows(h), rng.randint(2, 9)
        cuts = sorted({0, len(h), *(rng.randrange(len(h)) for _ in range(3))})
        got = [r for b in op.compare_runs((whole.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)), least) for r in b.to_pylist()]
        want = []
        for k in sorted(set(h)):
            own = [i for i, x in enumerate(h) if x == k]
            if len(own) >= least:
                want.append((own[0], 2))
            else:
                want += [(own[0], 1)] * (k in (h[0], h[-1])) + [(i, 0) for i in own[1:]]
        assert sorted((r["doc"], r["kind"]) for r in got) == sorted(want)


def test_spans_of_texts_that_defeat_one_hash():
    def thue_morse(a, b, n):
        return a if n == 0 else thue_morse(a, b, n - 1) + thue_morse(b, a, n - 1)

    x, y = thue_morse("a", "b", 12), thue_morse("b", "a", 12)
    data = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    n = len(x)
    h = words.span_hashes(data, np.array([0, n + 1, 2 * n + 2]), np.array([n, 2 * n + 1, 3 * n + 2]))
    assert h[0] != h[1] and h[0] == h[2]


def test_rows_alike_share_their_ranges(spark):
    """A passage of one document in 300 equal rows of another: as many ranges as one row has, not 300 times as many."""
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(words)
    rows = [(1, f"Start here. {passage}. End of it.")] + [(2, f"Other begin. {passage}. Other end now.")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    id_ = F.col("doc_id")
    found = op.repeated_spans(docs.select(id_.alias("doc"), F.xxhash64(id_, "text").alias("uid"), "text"), 3, 15, 25, op.LEAST_HOT)
    sizes = [len(r.r) for r in op.ranges_of_documents(found).collect()]
    assert found.count() > 1000 and max(sizes) <= 60
    got = Counter(r.text for r in op.remove_repeats(docs).collect())
    assert got[rows[0][1]] == 1 and len(got) == 2 and all(passage not in t for t in got if t != rows[0][1])
