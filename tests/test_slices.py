"""Ranks in every slice, overlap, matched histories and loads with fallbacks."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchlake.functions import names as N
from pitchlake.operators import matching, quality, serving
from pitchlake.plans import catalogue, name_queries
from pitchlake.plans import rosters as X
from pitchlake.sources import readers, sinks


def teams(spark, n=300):
    rng = random.Random(1)
    rows = [(i, rng.choice(["AZ", "AZ", "AZ", "CA", None]), rng.choice("MF"), rng.choice(["U10", "U11"]), rng.choice([None, *[round(x / 20, 2) for x in range(20)]])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "team long, state string, gender string, age string, power_score_adj double").repartition(7)


def test_ranks_in_every_slice(spark):
    rows, df = teams(spark)
    got = {(r.state, r.gender, r.age, r.team): r.slice_rank for r in serving.slice_ranks(df).collect()}
    want = {}
    for bits in range(8):
        groups = {}
        for t, s, g, a, x in rows:
            key = (s or "" if bits & 1 else "All", g if bits & 2 else "All", a if bits & 4 else "All")
            groups.setdefault(key, []).append((x is None, -(x or 0), t))
        want |= {(*key, t): n for key, members in groups.items() for n, (_, _, t) in enumerate(sorted(members), 1)}
    assert got == want
    sizes = {(r.state, r.gender, r.age): r.n_teams for r in serving.slice_sizes(df).collect()}
    assert sizes == {key: sum(k[:3] == key for k in want) for key in {k[:3] for k in want}}
    with pytest.raises(ValueError):
        serving.every_slice(df, tuple(f"c{i}" for i in range(13)))


def test_six_keys(spark):
    rows = [(t, float(p), float(a), float(d), s, g) for t, p, a, d, s, g in [(1, 1, 1, 1, 0.5, 9), (2, 1, 1, 1, 0.5, 9), (3, 1, 1, 1, None, 9), (4, 1, 1, 1, 0.5, 10), (5, 1, 1, 2, 0.1, 1), (6, 1, 2, 0, 0.1, 1), (7, 2, 0, 0, 0.0, 1)]]
    df = spark.createDataFrame(rows, "team long, power_score_adj double, sao_norm double, sad_norm double, sos_norm double, games_played long")
    assert [r.team for r in serving.ranked_without_ties(df).orderBy("rank").collect()] == [7, 6, 5, 4, 1, 2, 3]


def test_overlap(spark):
    games = spark.createDataFrame([("a", "b", "U10"), ("a", "x", "U10"), ("c", "x", "U11"), (None, "b", "U10")], "team_a string, team_b string, age_a string")
    list_ = lambda names: spark.createDataFrame([(n,) for n in names], "team string")
    got = quality.overlap(games, list_(["a", "b", "d", "d"]), list_(["x", "x"]), "U10").first().asDict()
    assert got == {"n_games": 4, "cross_age_games": 1, "teams_a": 2, "teams_b": 2, "teams_in_games": 4, "teams_in_master": 3, "in_both": 2, "master_only": 1, "games_only": 2, "cross_age_pct": 25.0}
    assert quality.overlap(games.limit(0), list_([]), list_([]), "U10").first().cross_age_pct == 0.0


def test_selector(spark):
    df = spark.createDataFrame([("Boys", "U12 (2013)", "AZ"), ("Girls", "U10", "CA")], "g string, a string, s string").select(serving.selector_params("g", "a", "s"))
    assert [r[0] for r in df.collect()] == ["gender=boys&age_group=U12&state=AZ", "gender=girls&age_group=U10&state=CA"]


def folded(games, mapping, master):
    """Histories as they are put together one team after the other. games: (game_id, date, a, b, sa, sb)."""
    named = {g[2] for g in games} | {g[3] for g in games}
    out = {}
    for team in set(master) & named:
        others = {n for n, m in mapping.items() if m == team and n != team}
        for names, matched in ((others, True), ({team}, False)):
            for side in (0, 1):
                for g in sorted(games, key=lambda g: (g[0], g[2 + side], g[4], g[5])):
                    if g[2 + side] in names:
                        a, b = (g[4], g[5]) if side == 0 else (g[5], g[4])
                        out.setdefault((team, g[3 - side], g[1]), (a, b, matched))
    return out


def test_matched_histories(spark):
    rng = random.Random(3)
    names = ["a", "a1", "a2", "b", "b1", "c", "z"]
    games = [(i, rng.randint(1, 6), *rng.sample(names, 2), rng.randint(0, 5), rng.randint(0, 5)) for i in range(150)]
    mapping = {"a1": "a", "a2": "a", "b1": "b", "c": "c", "z": "gone"}
    got = matching.matched_histories(
        spark.createDataFrame(games, "game_id long, date int, team_a string, team_b string, score_a int, score_b int"), spark.createDataFrame(list(mapping.items()), "name string, match string"), spark.createDataFrame([(n,) for n in ("a", "b", "c", "gone", "a")], "name string")
    )
    rows = got.collect()
    found = {(r.team, r.opponent, r.date): (r.gf, r.ga, r.matched) for r in rows}
    want = folded(games, mapping, ["a", "b", "c", "gone"])
    assert len(rows) == len(found) and found == want and {r[2] for r in want.values()} == {True, False}


def test_matched_histories_reads_games_once(spark):
    """A team whose own games all give way stays ranked, one that only mapped names play for does not; no second pass over the games."""
    read = spark.sparkContext.accumulator(0)

    def counted(g):
        read.add(1)
        return g

    games = [(1, 1, "a", "x", 1, 0), (2, 1, "a1", "x", 2, 0), (3, 2, "x", "b1", 3, 1), (4, 2, "b1", None, 0, 0), (5, None, "a1", "c", 4, 4)]
    mapping, master = {"a1": "a", "b1": "b"}, ["a", "b", "c"]
    df = spark.createDataFrame(spark.sparkContext.parallelize(games, 2).map(counted), "game_id long, date int, team_a string, team_b string, score_a int, score_b int")
    rows = matching.matched_histories(df, spark.createDataFrame(list(mapping.items()), "name string, match string"), spark.createDataFrame([(n,) for n in master], "name string")).collect()
    assert {(r.team, r.opponent, r.date): (r.gf, r.ga, r.matched) for r in rows} == folded(games, mapping, master) == {("a", "x", 1): (2, 0, True), ("a", "c", None): (4, 4, True), ("c", "a1", None): (4, 4, False)}
    assert len(rows) == 3 and read.value == len(games)


def test_matched_histories_query(spark):
    sf = entry.SMOKE_DIR
    games = [tuple(r) for r in name_queries.name_games(spark, sf).select("game_id", "date", "team_a", "team_b", "score_a", "score_b").collect()]
    master = [r.name for r in X.master(spark, sf).collect()]
    mapping = {r.name: r.match for r in catalogue.QUERIES["blocked_best_match"](spark, sf).collect()}
    want = folded(games, mapping, master)
    rows = catalogue.QUERIES["matched_histories"](spark, sf).collect()
    assert {(r.team, r.opponent, r.date): r.matched for r in rows} == {k: v[2] for k, v in want.items()} and len(rows) == len(want)


def test_loads_with_fallbacks(spark, tmp_path):
    root = str(tmp_path)
    assert readers.division_rankings(spark, root, "own.csv", ["other.csv"]) is None and readers.division_predictions(spark, root, None) is None
    with pytest.raises(FileNotFoundError):
        readers.served_rankings(spark, root)
    for name in ("Rankings.csv", "Rankings_v52b.csv", "Predicted_Outcomes_v52b.csv", "Rankings_v53.csv", "other.csv", "own.csv"):
        (tmp_path / name).write_text(f"﻿Team ,From\nx,{name}\n")
        if name in ("Rankings_v52b.csv", "Rankings_v53.csv", "other.csv", "own.csv"):
            path, df = readers.division_rankings(spark, root, "own.csv", ["other.csv"])
            assert path.endswith(name) and df.columns == ["Team", "From"] and df.first().From == name
    assert readers.served_rankings(spark, root)[0].endswith("Rankings.csv")
    assert readers.division_predictions(spark, root, "none.csv")[0].endswith("Predicted_Outcomes_v52b.csv")


def test_histories_come_back(spark, tmp_path):
    path = f"{tmp_path}/cache"
    schema = "date string, opponent string, gf int"
    assert readers.read_histories(spark, path, schema) is None
    rows = [("a", "d1", "b", 1), ("a", "d2", "c", 2), ("b", "d1", None, None)]
    sinks.write_histories(spark.createDataFrame(rows, "team string, date string, opponent string, gf int"), path)
    assert sorted(tuple(r) for r in readers.read_histories(spark, path, schema).collect()) == rows


def test_files_at_any_depth(spark, tmp_path):
    for p in ("u10.csv", "a/U10_x.csv", "a/b/c/d/e/u11_games.csv", "a/other.csv", "a/u10.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x\n1\n")
    found = readers.game_files(spark, str(tmp_path))
    assert [len(found["u10"]), len(found["u11"])] == [2, 1] and found["u11"][0].endswith("a/b/c/d/e/u11_games.csv")
    assert readers.game_files(spark, f"{tmp_path}/none") == {"u10": [], "u11": []}
    assert readers.newest_plot(spark, str(tmp_path), "*.csv").endswith("u10.csv") and readers.newest_plot(spark, str(tmp_path), "*.png") is None


def test_states_aliases_and_suffixes(spark, tmp_path):
    for s in ("AZ", "CA"):
        (tmp_path / f"Rankings_{s}.csv").write_text("Team\nx\n")
    assert sorted(r.state for r in readers.states_of_files(spark.read.option("header", True).csv(str(tmp_path))).collect()) == ["AZ", "CA"]
    (tmp_path / "aliases.csv").write_text("alias_name,canonical_team_id,canonical_team_name,confidence,last_seen\na,0123456789ab,A,0.9,2025\nb,x,B,bad,\n")
    assert [(r.alias_name, r.confidence) for r in readers.read_aliases(spark, f"{tmp_path}/aliases.csv").collect()] == [("a", 0.9), ("b", None)]
    df = spark.createDataFrame([("AZ", None, "U10")], "a string, b string, c string").select(N.slice_suffix(F.col("a"), F.col("b"), F.col("c")), N.division_age("a"))
    assert df.first()[0] == "AZ_U10"


def test_long_names_keep_their_end(spark):
    long = "red widget " + "x" * (1 << 20) + " end"
    got = spark.createDataFrame([(long,)], "name string").select(N.club_prefixed(F.col("name"), X.PREFIXES).alias("c"), F.length("name").alias("n")).first()
    assert got.c.endswith(" end") and got.c.startswith("red_widget") and len(got.c) == len(long)


def test_halves_in_means_and_scores(spark):
    """A mean that is a half in the seventh place goes up in any order; a double just under a half goes down, as in SQL."""
    from pyspark.sql import functions as F

    from pitchlake.functions import scores as S

    scores = [0.535001, 0.535002] * 5
    for order in (scores, scores[::-1], sorted(scores)):
        df = spark.createDataFrame([("A", "M", "U10", i, s) for i, s in enumerate(order)], "state string, gender string, age string, team long, power_score_adj double")
        assert {r.m for r in serving.slice_sizes(df).select(F.round("mean_score", 6).cast("double").alias("m")).collect()} == {0.535002}
    just_under = spark.createDataFrame([(0.5005,), (0.0625,)], "v double").select(S.rounded("v", 3).alias("v"))
    assert [r.v for r in just_under.collect()] == [0.5, 0.063]
