"""Exact similarity joins and dealt pairs against brute force over all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import names as N
from pitchlake.functions import similarity as M
from pitchlake.operators import matching, pairs
from pitchlake.operators import similarity_join as J


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def indel(x, y):
    return 2 * lcs(x, y) / (len(x) + len(y)) if x or y else 1.0


def tokens(x):
    return {w for w in x.split() if len(w) > 1 and w not in N.GENERIC_TOKENS}


def hybrid(x, y):
    a, b = tokens(x), tokens(y)
    return 0.6 * indel(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) + 0.4 * (len(a & b) / len(a | b) if a or b else 1.0)


def roster(n, seed, words=("red", "blue", "fox", "foxes", "rovers", "ring", "fc", "sc", "2014", "b", "gizmo", "élan", "harbour")):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(t) + 1)
            t = rng.choice([t[:at] + t[at + 1 :], t[:at] + rng.choice("abxy ") + t[at:], t])
        out.append(" ".join(t.split()))
    return [*out, "", "a", "ab", "x" * 70, "x" * 69 + "y", "fc", "sc fc"]


@pytest.fixture(scope="module")
def lists(spark):
    left, right = roster(120, 1), roster(150, 2)
    x = spark.createDataFrame([(t,) for t in [*left, None]], "name string")
    y = spark.createDataFrame([(t, i) for i, t in enumerate([*right, None])], "match string, ord long")
    return left, right, x, y


def test_lengths_of_all_pairs():
    x, y = roster(40, 3) + ["ab" * 32, "ba" * 40], roster(50, 4) + ["ab" * 40, "b" * 64]
    i, j = (m.reshape(-1) for m in np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij"))
    want = [lcs(x[a], y[b]) for a, b in zip(i, j, strict=True)]
    assert M.common_lengths(x, y, i, j, 700).tolist() == want == [M.subsequence_length(x[a], y[b]) for a, b in zip(i, j, strict=True)]
    assert (M.common_characters(x, y)[i, j] >= want).all()
    bound = M.weighted_bounds(x, y)
    for a, b in zip(i, j, strict=True):
        if max(len(x[a]), len(y[b])) < 1.5 * min(len(x[a]), len(y[b])):
            assert M.weighted_ratio(x[a], y[b]) <= bound[a, b] + 1e-4


@pytest.mark.parametrize("least", [0.95, 0.9, 0.75, 0.6, 0.45])
def test_indel_join(lists, least):
    left, right, x, y = lists
    got = [(r.name, r.ord, round(r.ratio, 9)) for r in J.indel_join(x, y, least).collect()]
    want = {(a, i, round(indel(a, b), 9)) for a in left for i, b in enumerate(right) if a and b and indel(a, b) >= least - 1e-12}
    assert len(got) == len(set(got)) and set(got) == want


def test_high_limits_meet_few_names(lists):
    """The candidates of a limit of 0.9 are a small part of all pairs."""
    left, right, x, y = lists
    probe = J.probes(x.where("name <> ''").select("name", F.col("name").alias("s"), F.lit(0.9).alias("least")).distinct(), y.where("match <> ''").select("match", "ord", F.col("match").alias("s")))
    assert probe.where("gram = '' and length(s) > 12").count() == 0
    index = y.where("length(match) >= 2").select("ord", F.explode(J.grams(F.col("match"))).alias("g")).select("ord", "g.gram", "g.place")
    met = probe.join(index, "gram").where(F.abs(probe.place - index.place) <= 0.1 * F.length("s") + 1).select("name", "ord").distinct().count()
    assert met < 0.35 * len(set(left)) * len(right)


@pytest.mark.parametrize("least", [1.0, 0.8, 0.5, 0.2])
def test_jaccard_join(lists, least):
    left, right, x, y = lists
    score = lambda a, b: len(tokens(a) & tokens(b)) / len(tokens(a) | tokens(b)) if tokens(a) or tokens(b) else 1.0
    got = [(r.name, r.ord) for r in J.jaccard_join(x, y, least).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, i) for a in left for i, b in enumerate(right) if score(a, b) >= least - 1e-12}


@pytest.mark.parametrize(("k", "least"), [(3, 0.3), (1, 0.3), (5, 0.7)])
def test_hybrid_best(lists, k, least):
    left, right, x, y = lists
    got = {(r.name, r.nth): (r.ord, round(r.score, 9)) for r in J.hybrid_best(x, y, k, least).collect()}
    want = {}
    for a in set(left):
        top = sorted((-hybrid(a, b), i) for i, b in enumerate(right) if hybrid(a, b) > least)[:k]
        want |= {(a, n): (i, round(-s, 9)) for n, (s, i) in enumerate(top, 1)}
    assert got == want


def test_weighted_candidates_lose_no_match(lists):
    left, right, x, y = lists
    got = {(r.name, r.ord) for r in J.weighted_candidates(x, y).collect()}
    want = {(a, i) for a in left for i, b in enumerate(right) if M.weighted_ratio(a, b) >= 90}
    assert want and want <= got and len(got) < 0.5 * len(set(left)) * len(right)
    with pytest.raises(ValueError):
        J.weighted_candidates(x, y, 80)


def test_empty_lists(spark):
    x, y = spark.createDataFrame([], "name string"), spark.createDataFrame([("a b", 1)], "match string, ord long")
    for df in (J.indel_join(x, y, 0.9), J.hybrid_best(x, y), J.jaccard_join(x, y, 0.5), J.weighted_candidates(x, y)):
        assert df.count() == 0


def test_a_hot_key_is_dealt_evenly(spark):
    """A key with half of all rows gives cells of about equal pairs, and every pair meets once."""
    left = spark.range(2000).select(F.col("id").alias("l"), F.when(F.col("id") < 1000, 0).when(F.col("id") < 1990, F.col("id")).alias("k"))
    right = spark.range(3000).select(F.col("id").alias("r"), F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"))
    met = pairs.ranged_join(left, right, ["k"], 100, 100)
    assert met.count() == met.distinct().count() == 1000 * 1500 + 490
    x, y = pairs.dealt(left, right, ["k"], 100, 100)
    n = x.where("k = 0").groupBy("_i", "_j").count().join(y.where("k = 0").groupBy("_i", "_j").agg(F.count("*").alias("m")), ["_i", "_j"]).select((F.col("count") * F.col("m")).alias("p"))
    sizes = [r.p for r in n.collect()]
    assert len(sizes) == 150 and sum(sizes) == 1_500_000 and max(sizes) < 2.5 * sum(sizes) / len(sizes)


def test_strict_matcher_with_one_hot_key(spark):
    rng = random.Random(7)
    clubs = [" ".join(rng.sample(["phoenix", "silver", "golden", "lake", "owls", "hawks", "harbor", "desert", "foxes", "canyon"], 3)) for _ in range(60)]
    names = [f"2014 Boys {c.title()} Red" if i < 40 else f"201{i % 4} Girls {c.title()} Blue" for i, c in enumerate(clubs)]
    lists = [n.replace(" Boys ", " Boys The ").replace("Owls", "Owls SC") for n in names] + names[:5]
    x, y = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(lists)), "ord int, name string")
    parsed = {r.name: (r.p, r.x) for r in x.union(y.select("name")).distinct().withColumn("p", N.parsed("name")).withColumn("x", N.matcher_club(F.col("p.club"))).collect()}
    gate = spark.createDataFrame([(a, b, i, SequenceMatcher(None, parsed[a][1], parsed[b][1]).ratio()) for a in set(names) for i, b in enumerate(lists) if a != b and all(parsed[s][0].birth_year and parsed[s][0].gender for s in (a, b))], "name string, match string, ord int, ratio double")
    gate = gate.withColumn("a", N.parsed("name")).withColumn("b", N.parsed("match")).withColumn("x", N.matcher_club(F.col("a.club"))).withColumn("y", N.matcher_club(F.col("b.club")))
    scored = gate.withColumn("score", matching.similarity_gate(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.col("ratio"))).where("score >= 0.8").collect()
    want = {}
    for r in sorted(scored, key=lambda r: (-r.score, r.ord)):
        want.setdefault(r.name, (r.match, round(r.score, 9)))
    assert want and {r.name: (r.match, round(r.score, 9)) for r in matching.best_master(x, y).collect()} == want


def test_strict_matcher_compares_profiles(spark):
    """Names that the gate can't tell apart are one profile, compared once; a name is not matched with itself."""
    names = [f"Phoenix Owls Hawks FC {'' if i % 2 else ' '}2014 {b} Red{' ' * (i // 2)}" for i, b in enumerate(["Boys", "boys", "BOYS"] * 40)]
    x, y = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(names)), "ord int, name string")
    a = matching._profiled(x.distinct(), "name", 2026)
    assert a.count() == len(set(names)) > 100 and matching.gated_profiles(a, a).count() == 1
    got = {r.name: (r.match, r.score) for r in matching.best_master(x, y).collect()}
    assert got == {n: (names[1] if n == names[0] else names[0], 1.0) for n in names}


def test_floors_are_reached(spark):
    """Rows nearly alike give names a floor that their k-th score reaches."""
    words = ["red", "blue", "fox", "owl", "ring", "gear", "harbour", "lake"]
    rng = random.Random(5)
    right = [" ".join(rng.sample(words, 4)) for _ in range(300)]
    left = sorted({t[:3] + t[4:] for t in right[:60]})
    x = spark.createDataFrame([(t,) for t in left], "name string").withColumn("s", N.sorted_tokens(F.col("name")))
    y = spark.createDataFrame([(t, i) for i, t in enumerate(right)], "match string, ord long").withColumn("s", N.sorted_tokens(F.col("match")))
    floor = {r.name: r.floor for r in J.floors(x, y, 2, 0.3).collect()}
    assert len(floor) > 0.8 * len(left) and np.mean(list(floor.values())) > 0.5
    for a, f in floor.items():
        assert f <= sorted(hybrid(a, b) for b in right)[-2] + 1e-9


@pytest.mark.parametrize("pay", [0.0, 1e9])
def test_indel_join_by_grams_and_in_cells(lists, monkeypatch, pay):
    left, right, x, y = lists
    monkeypatch.setattr(J, "GRAMS_PAY", pay)
    got = sorted((r.name, r.ord) for r in J.indel_join(x, y, 0.8).collect())
    assert got == sorted({(a, i) for a in left for i, b in enumerate(right) if a and b and indel(a, b) >= 0.8 - 1e-12})


def test_frequent_tokens_do_not_make_all_sets_meet(spark):
    """Sets of seven tokens from a few words: they meet by three, where every pair shares one."""
    keys = J._chosen("h", 3)
    row = spark.createDataFrame([(["a", "b", "c", "d"],)], "h array<string>").select(keys.alias("k")).first().k
    assert sorted(map(tuple, row)) == [("a", "b", "c"), ("a", "b", "d"), ("a", "c", "d"), ("b", "c", "d")]


def test_best_weighted_candidates_hold_each_best(lists):
    left, right, x, y = lists
    got = {}
    for r in J.weighted_candidates(x, y, 90.0, best=True).collect():
        got.setdefault(r.name, set()).add(r.ord)
    for a in filter(None, set(left)):
        scores = [M.weighted_ratio(a, b) for b in right]
        if max(scores) >= 90:
            assert {i for i, s in enumerate(scores) if s == max(scores)} <= got[a]
    assert sum(map(len, got.values())) <= J.weighted_candidates(x, y).count()


def test_containment_sends_no_exploded_side(spark):
    a = spark.createDataFrame([("red fox",), ("fox ring",)], "name string")
    plan = matching.contains_either(a, spark.createDataFrame([("red fox ring",), ("ring of the fox",)], "name string"))
    assert {tuple(r) for r in plan.collect()} == {("red fox", "red fox ring", True), ("fox ring", "red fox ring", True)}
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_normalised_lists_come_from_different_names(spark):
    """The normaliser's patterns are not run over the rows of a table in which names repeat."""
    import __spark_entry__ as entry
    from pitchlake.plans import name_queries

    observed, _ = name_queries._normalised_lists(spark, entry.SMOKE_DIR)
    assert "FileScan" not in observed._jdf.queryExecution().executedPlan().toString()


def test_cells_have_partitions_of_their_own(spark):
    x, y = spark.range(100).select(F.col("id").alias("l")), spark.range(150).select(F.col("id").alias("r"))
    met = pairs.crossed(x, y, lambda a, b: a.merge(b, how="cross")[["l", "r"]], "l long, r long", 40)
    assert met.rdd.getNumPartitions() == 12 and met.count() == met.distinct().count() == 15_000


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_cells_in_blocks_of_rows(monkeypatch, block):
    """Pairs of a cell are those of all pairs, whatever rows are multiplied at a time, and weighted bounds hold for names with repeated words and other blanks."""
    import pandas as pd

    monkeypatch.setattr(J, "BLOCK", block)
    x, y = [t for t in roster(60, 8) if t] + ["red red fox", "a\tb c", "é" * 66], [t for t in roster(70, 9) if t] + ["fox red fox", "a b\tc", "é" * 65 + "x"]
    a, b = pd.DataFrame({"name": x, "s": x, "least": 0.8, "gram": "", "place": 0, "floor": 0.3}), pd.DataFrame({"match": y, "s": y, "ord": range(len(y)), "gram": "", "place": 0})
    got = J.near_cell(a, b)
    assert sorted(zip(got.name, got.ord)) == sorted((s, j) for s in x for j, t in enumerate(y) if indel(s, t) >= 0.8 - 1e-12)
    got = J.weighted_cell(90.0, False)(a, b)
    kept = set(zip(got.name, got.ord))
    assert {(s, j) for s in x for j, t in enumerate(y) if M.weighted_ratio(s, t) >= 90} <= kept
    got = J.hybrid_cell(2, 0.3)(a.drop_duplicates("name"), b)
    overlap = lambda s, t: len(tokens(s) & tokens(t)) / len(tokens(s) | tokens(t)) if tokens(s) or tokens(t) else 1.0
    score = lambda s, t: 0.6 * indel(s, t) + 0.4 * overlap(s, t)
    want = {(s, j) for s in x for _, j in sorted((-score(s, t), j) for j, t in enumerate(y) if score(s, t) > 0.3)[:2]}
    assert set(zip(got.name, got.ord)) == want
