"""Vector operators against brute force on tables with repeated ids, ties, null ids and columns of clashing names."""

import numpy as np
import pytest

from pitchlake.llm import embeddings, knn

from test_operators import union_find

SHAPE = "vec_id long, embedding array<float>, node long, n int, t int, cell int, x string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], 1, 2, 3, 4, "x", "k") for i, v in rows], SHAPE)


def usable(v):
    return v is not None and all(y is not None and np.isfinite(y) for y in v)


def links_by_hand(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of each row; rows are vectors whatever their ids."""
    real = [k for k, (_, v) in enumerate(rows) if usable(v) and any(v)]
    links = []
    for a in real:
        for b in real:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y >= threshold * np.linalg.norm(x) * np.linalg.norm(y):
                    links.append((a, b))
    root = union_find(range(len(rows)), links)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[k] and rows[m][0] is not None]
        component = min(ids, default=None)
        out.append((i, sum(k in p for p in links), component, component == i))
    return out


def test_links_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(31)
    base = rng.standard_normal((40, 12))
    rows = [(k % 30, v) for k, v in enumerate(base)]
    rows += [(k % 7, v + 0.04 * rng.standard_normal(12)) for k, v in enumerate(base[:25])]
    rows += [(3, base[0])] * 2 + [(None, base[1])] * 3 + [(None, rng.standard_normal(12))] * 2 + [(None, None), (4, None), (4, [0.0] * 12), (5, [1.0, None]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, []), (9, [-0.0] * 12), (10, [float("nan")] * 12)]
    got = embeddings.near_vectors(frame(spark, rows).repartition(4))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    order = lambda x: sorted(x, key=repr)
    assert order(map(tuple, got.collect())) == order(links_by_hand(rows))


def test_links_within_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(32)
    centre = rng.standard_normal(10)
    rows = [(k, centre + 0.13 * rng.standard_normal(10)) for k in range(60)] + [(100 + k, rng.standard_normal(10)) for k in range(20)]
    got = sorted(map(tuple, embeddings.near_vectors(frame(spark, rows)).collect()))
    want = sorted(links_by_hand(rows))
    assert got == want and max(n for _, n, _, _ in want) > 10


def test_share_of_pairs_at_the_threshold_that_are_found():
    """A pair exactly at the threshold is missed with a chance of about ``miss``, whatever the number of bits."""
    rng = np.random.default_rng(33)
    for n in (500, 50_000, 5_000_000):
        bits, tables, most = embeddings.tables_for(n, 0.95, 1e-3)
        a = rng.standard_normal((400, 24))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        o = rng.standard_normal((400, 24))
        o -= (o * a).sum(axis=1, keepdims=True) * a
        o /= np.linalg.norm(o, axis=1, keepdims=True)
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * o
        planes = rng.standard_normal((24, bits * tables))
        x, y = a @ planes >= 0, b @ planes >= 0
        meet = (x == y).reshape(400, tables, bits).all(axis=2).any(axis=1) & ((x != y).sum(axis=1) <= most)
        assert meet.mean() >= 0.985


@pytest.mark.parametrize(("pivots", "group"), [(None, 4096), (1, 3), (9, 2)])
def test_products_of_repeated_queries_ties_and_short_vectors(spark, monkeypatch, pivots, group):
    monkeypatch.setattr(knn, "QUERIES_A_GROUP", group)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1 << 10)
    rng = np.random.default_rng(34)
    rows = [(k, rng.integers(-3, 4, 6) / 4) for k in range(150)] + [(50, rng.integers(-3, 4, 6) / 4) for _ in range(3)] + [(200, [0.5] * 6)] * 8 + [(201, []), (250, []), (202, [1.0]), (203, [2.5, None]), (204, None), (None, [1.0] * 6), (205, [float("inf")] * 6)]
    df = frame(spark, rows).repartition(3)
    got = sorted(map(tuple, knn.top_products(df, df.where("vec_id % 50 = 0"), n_pivots=pivots).collect()))
    whole = [(i, np.array([*np.floor(256 * np.array(v, float)), *[0.0] * (6 - len(v))])) for i, v in rows if i is not None and usable(v)]
    want = []
    for q, x in whole:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and sum(r[0] == 50 and r[1] == 1 for r in got) == 4


def test_groups_of_query_cells():
    rng = np.random.default_rng(35)
    pivots, n = rng.standard_normal((20, 3)), np.array([0, 5, 17, 3, 40, 1, 2, 0, 9, 9, 1, 1, 1, 30, 4, 4, 4, 0, 0, 8])
    first, often = knn.query_groups(pivots, n, 10)
    held = np.zeros((first + often).max())
    for c in range(20):
        assert often[c] == max(1, -(-n[c] // 10))
        held[first[c] : first[c] + often[c]] += n[c] / often[c]
    assert held.max() <= 10 and held.sum() == n.sum()


def test_scores_beyond_doubles_are_whole():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**30, 3.0], [2.0**10, 1.0]])
    assert knn.exact_scores(q, x).tolist() == [[(1 << 63) - 1, (1 << 50) + 1]]
