"""Cuts of the k-d tree against medians of sorted keys, balance against the stated bound, and the defined cases."""

import random
from collections import Counter, defaultdict

import pytest

from pitchlake.llm import sharding

SHAPE = "doc_id long, text string, source string, lang string, size string, shard int, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, g, "x", 7, "y") for i, t, s, g in rows], SHAPE)


@pytest.fixture(scope="module")
def mixed(spark):
    """A source with half of the rows, a text with a third of them, small groups of copies, nulls and repeated rows."""
    rng = random.Random(5)
    words = lambda n: " ".join(str(rng.randrange(999)) for _ in range(n))
    rows = [(i, words(rng.randrange(5, 60)), "hot" if i % 2 else f"s{i % 7}", rng.choice(["en", "de", None])) for i in range(900)]
    rows += [(1000 + i, "a text that many rows hold " * 4, rng.choice(["hot", "s1"]), "en") for i in range(400)]
    rows += [(2000 + i, f"copy {i // 2} of a pair", "s2", "en") for i in range(60)]
    rows += [(3000, None, None, None), (None, "no id", "s3", "en"), (None, None, "s3", "en"), (5, "\u00e9" * 30, "s1", "fr"), (3001, "", "s1", "en")]
    return rows + [(4000, "one row again and again", "s4", "en")] * 150


def test_cuts_are_weighted_medians(spark, mixed):
    shards = 24
    keyed, large, lacks = sharding._coordinates(frame(spark, mixed), shards)
    loads = Counter({r.shard: r["sum(size)"] for r in large.groupBy("shard").sum("size").collect()})
    mean = sum(len((t or "").encode()) + 8 for _, t, _, _ in mixed) / shards
    assert len(lacks) == shards and all(abs(x - max(0, mean - loads[i])) < 1e-6 for i, x in enumerate(lacks))
    tree, rows = sharding.kd_tree(keyed, lacks), [r.asDict() for r in keyed.collect()]
    spread = {d: max(1, (max(r[d] for r in rows) >> 32) - (min(r[d] for r in rows) >> 32)) for d in sharding.DIMS}
    leaves = 0

    def walk(node, rows):
        nonlocal leaves
        if "left" not in node:
            leaves += len(node["lacks"])
            assert len(node["lacks"]) == 1 or len({r["k_id"] for r in rows}) == 1  # one unit can't be cut; its shards hold heavy ones
            return
        width = {d: ((max(r[d] for r in rows) >> 32) - (min(r[d] for r in rows) >> 32)) / spread[d] for d in sharding.DIMS}
        assert width[node["dim"]] == max(width.values())
        by_key = Counter()
        for r in rows:
            by_key[r[node["dim"]]] += r["size"]
        total = sum(by_key.values())
        half = sum(node["lacks"][: len(node["lacks"]) // 2])
        want, left, best = total * half / sum(node["lacks"]), 0, None
        for k in sorted(by_key)[:-1]:
            left += by_key[k]
            best = abs(left - want) if best is None else min(best, abs(left - want))
        parts = [[r for r in rows if (r[node["dim"]] <= node["cut"]) == side] for side in (True, False)]
        assert parts[0] and parts[1]
        got = abs(sum(r["size"] for r in parts[0]) - want)
        assert got <= best + sharding.SLACK * total / len(node["lacks"])
        walk(node["left"], parts[0])
        walk(node["right"], parts[1])

    walk(tree, rows)
    assert leaves == shards


def test_balance_and_slots(spark, mixed):
    shards = 24
    got = sharding.shard_documents(frame(spark, mixed), shards).collect()
    utf8 = lambda t: len((t or "").encode())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, utf8(t) + 8) for i, t, _, _ in mixed)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(sizes.values()) / shards
    assert set(sizes) == set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(b - mean) <= 4 * mean * (1 / sharding.HEAVY_A_SHARD / 2 + sharding.SLACK) for b in sizes.values())
    texts, of = {}, defaultdict(set)
    for i, t, _, _ in mixed:
        texts.setdefault((i, utf8(t) + 8), set()).add(t)
    weight = Counter()
    for _, t, _, _ in mixed:
        weight[t] += utf8(t) + 8
    for r in got:
        (t,) = texts[r.doc_id, r["size"]]
        of[t].add(r.shard)
    for t, where in of.items():
        assert len(where) <= max(1, -(-weight[t] // mean)) and (len(where) == 1 or weight[t] > mean)


def test_all_groups_up_to_a_shard_stay_whole_on_the_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = sharding.op2_kd_sharding(spark, sf)
    sizes = [r[1] for r in got.groupBy("shard").sum("size").collect()]
    mean = sum(sizes) / 24
    where = defaultdict(set)
    weight = Counter()
    for r in got.collect():
        where[r.text_crc32, r["size"]].add(r.shard)
        weight[r.text_crc32, r["size"]] += r["size"]
    assert max(weight.values()) < mean and all(len(s) == 1 for s in where.values())
    assert max(abs(b / mean - 1) for b in sizes) < 0.06


def test_small_tables(spark):
    none = sharding.shard_documents(frame(spark, []), 24)
    assert none.count() == 0 and none.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    three = sharding.shard_documents(frame(spark, [(1, "a", "s", "en"), (1, "a", "s", "en"), (2, None, None, None)]), 24).collect()
    assert sorted((r.doc_id, r["size"]) for r in three) == [(1, 9), (1, 9), (2, 8)]
    assert all(0 <= r.shard < 24 for r in three)
