"""Readers, sinks and the alias stream on files of their own."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import names as N
from pitchlake.operators import quality, reshape, serving
from pitchlake.sources import readers, sinks
from pitchlake.streaming import aliases


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return str(path)


@pytest.mark.parametrize("heads", ["Team A,Team B,Score A,Score B,Date", "Home,Away,ScoreA,ScoreB,Date/Time", "Home Team , Away Team,Home Score,Away Score,Game Date"])
def test_games_of_csv_with_mark_quotes_and_synonyms(spark, tmp_path, heads):
    path = write(f"{tmp_path}/g.csv", f'{heads}\n"Foxes, ""Red""",Owls ,3,1,2025-03-01\nÉlan,,x,2,3/9/2025\n', "utf-8-sig")
    got = readers.read_games(spark, path).collect()
    assert [(r.team_a, r.team_b, r.score_a, r.score_b, str(r.date)[:10]) for r in got] == [('Foxes, "Red"', "Owls", 3.0, 1.0, "2025-03-01"), ("Élan", None, None, 2.0, "2025-03-09")]


def test_games_of_parquet_and_without_a_column(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 1, 2, "2025-01-01", "extra")], ["Home", "Away", "Score A", "Score B", "Date", "x"])
    df.write.parquet(f"{tmp_path}/g.parquet")
    assert readers.read_games(spark, f"{tmp_path}/g.parquet").count() == 1
    with pytest.raises(ValueError, match="Date"):
        readers.read_games(spark, write(f"{tmp_path}/h.csv", "Home,Away,ScoreA,ScoreB\na,b,1,2\n"))


def test_paths_and_versions(spark, tmp_path):
    root = str(tmp_path)
    assert readers.slice_paths("r", "U11", "M", "AZ")[0] == "r/Rankings_U11_AZ_M.parquet" and readers.slice_paths("r", "U11")[-1] == "r/Rankings_U11.csv"
    assert readers.history_paths("r", "U11")[0] == "r/Team_Game_Histories_U11.parquet"
    write(f"{root}/gold/az_COMPAT.csv", "a\n1\n")
    assert readers.first_existing(spark, readers.game_paths(root, "az")).endswith("gold/az_COMPAT.csv")
    assert readers.first_existing(spark, [f"{root}/none.csv"]) is None
    for v in ("v51", "v53"):
        write(f"{root}/out/Rankings_{v}.csv", "a\n1\n")
    os.utime(f"{root}/out/Rankings_v51.csv", (2_000_000_000, 2_000_000_000))
    assert readers.latest_version(spark, f"{root}/out", "Rankings", ["v60", "v53"]).endswith("Rankings_v53.csv")
    assert readers.latest_version(spark, f"{root}/out", "Rankings", ["v60"]).endswith("Rankings_v51.csv")
    write(f"{root}/deep/er/U10_games.csv", "a\n")
    assert [p.rsplit("/", 1)[-1] for p in readers.game_files(spark, root)["u10"]] == ["U10_games.csv"]
    assert [readers.cross_age(a) for a in (9, 10, 12, 13)] == [None, 11, 13, None]


def test_cache_follows_changes(spark, tmp_path):
    path, cache = f"{tmp_path}/t.csv", readers.TableCache(spark)
    write(path, "a\n1\n")
    one = cache.get(path, readers.read_csv)
    assert cache.get(path, readers.read_csv) is one and one.count() == 1
    write(path, "a\n1\n2\n")
    os.utime(path, (2_000_000_000, 2_000_000_000))
    assert cache.get(path, readers.read_csv).count() == 2


def test_json_tables(spark, tmp_path):
    index = write(f"{tmp_path}/i.json", json.dumps({"slices": [{"state": "AZ", "gender": "boys", "year": "2015"}, {"state": "AZ", "gender": "F", "year": None}]}))
    assert sorted(map(tuple, readers.slice_index(spark, index).collect())) == [("AZ", "FEMALE", "All"), ("AZ", "MALE", "2015")]
    assert list(map(tuple, readers.slice_index(spark, write(f"{tmp_path}/e.json", '{"slices": []}')).collect())) == [("All", "All", "All")]
    pairs = spark.createDataFrame([("a b", "A"), ("ç", "C \"q\"")], "alias string, name string")
    sinks.write_alias_map(pairs, f"{tmp_path}/m")
    assert sorted(map(tuple, readers.alias_map(spark, f"{tmp_path}/m").collect())) == [("a b", "A"), ("ç", 'C "q"')]
    with pytest.raises(ValueError, match="state"):
        readers.registry(spark, '{"k": {"age": 1, "gender": "m", "url": "", "active": true}}')
    assert readers.prefix_table("club_a:\n  - 'A B' # note\n  - c\nb:\n") == {"club_a": ["a b", "c"], "b": []}


def test_probes_and_logs(spark, tmp_path):
    path = write(f"{tmp_path}/r.csv", "﻿Power Score,Team \n1,a\n2,b\n")
    heads, rows = readers.headers_probe(readers.read_csv(spark, path), 1)
    assert heads == [("Power Score", "power_score"), ("Team", "team")] and rows == [{"Power Score": "1", "Team": "a"}]
    assert readers.health(spark, path)["columns"] == ["Power Score", "Team"] and not readers.health(spark, f"{tmp_path}/no.csv")["ok"]
    log = write(f"{tmp_path}/l.csv", "timestamp,auc\n2025-02-01 00:00:00,2\nx,3\n2025-01-01 00:00:00,1\n")
    assert [r.auc for r in readers.metrics_log(spark, log).collect()] == ["3", "1", "2"]


def test_name_map_refuses_misses(spark, tmp_path):
    seen = spark.createDataFrame([("Foxes SC",), ("foxes",), ("Nobody",), (None,)], "raw_name string")
    master = spark.createDataFrame([("1", "Foxes")], "team_id string, display_name string")
    with pytest.raises(readers.UnmatchedNames, match="1 names"):
        readers.name_map(seen, master, N.canonical_name, f"{tmp_path}/misses")
    assert [r.raw_name for r in readers.read_csv(spark, f"{tmp_path}/misses").collect()] == ["Nobody"]
    got = readers.name_map(seen.where("raw_name <> 'Nobody'"), master, N.canonical_name)
    assert sorted(map(tuple, got.collect())) == [("Foxes SC", "1", "Foxes"), ("foxes", "1", "Foxes")]
    maps = got.withColumn("division", F.lit("u10"))
    sinks.write_name_map(maps, f"{tmp_path}/maps")
    sinks.write_name_map(maps.withColumn("division", F.lit("u11")), f"{tmp_path}/maps")
    sinks.write_name_map(maps.limit(1), f"{tmp_path}/maps")
    assert sorted(r["division"] for r in spark.read.parquet(f"{tmp_path}/maps").collect()) == ["u10", "u11", "u11"]


def test_corrected_masters(spark):
    shape = "Team_Name string, Club string, State_Code string, GotSport_Team_ID long"
    u10 = spark.createDataFrame([("Foxes 2016", "F", "AZ", 7), ("Foxes 2015", "F", "AZ", 8)], shape)
    u11 = spark.createDataFrame([("Owls 2014", "O", "CA", 9)], shape)
    games = spark.createDataFrame([("Foxes 2016", "New 2016"), ("Owls 2014", None)], "team_a string, team_b string")
    got = {(r.Team_Name, r.Age_U): (r.Age_Group, r.Club, r.GotSport_Team_ID) for r in readers.corrected_masters(u10, u11, games).collect()}
    assert got == {("Foxes 2016", 10): (2016, "F", 7), ("New 2016", 10): (2016, "Unknown", None), ("Foxes 2016", 11): (2015, "F", 7), ("Foxes 2015", 11): (2015, "F", 8), ("Owls 2014", 12): (2014, "O", 9)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "AZ" if i % 3 else None, float(i), i) for i in range(30)], "team int, state string, power_score_adj double, n int")
    sinks.write_by_state(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("state").count().count() == 2 and "state=AZ" in os.listdir(f"{tmp_path}/s")
    sinks.write_csv(df, f"{tmp_path}/c")
    assert readers.read_csv(spark, f"{tmp_path}/c").count() == 30
    text = sinks.summary(df.withColumn("team", F.col("team").cast("long")), "Top", 3)
    assert text.split("\n")[2].split()[1:] == ["29", "29.0000"] and "AZ: 20, 29" in text
    sinks.write_histories(df, f"{tmp_path}/h")
    row = spark.read.parquet(f"{tmp_path}/h").where("key = 4").first()
    assert json.loads(row.value) == [{"state": "AZ", "power_score_adj": 4.0, "n": 4}]
    numbers = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    assert serving.as_json(numbers).first().json == '{"a":1,"b":null,"c":null}'


def test_alias_tables(spark, tmp_path):
    shape = "alias_name string, canonical_team_name string, confidence double"
    old, new = spark.createDataFrame([("a", "A", 0.9)], shape), spark.createDataFrame([("a", "Z", 0.1), ("b", "B", 0.7)], shape)
    merged = sinks.merge_reviewed(old, new, f"{tmp_path}/backup", f"{tmp_path}/log", "now")
    assert sorted(map(tuple, merged.collect())) == [("a", "A", 0.9), ("b", "B", 0.7)]
    assert spark.read.parquet(f"{tmp_path}/backup").count() == 1 and [r.alias_name for r in spark.read.parquet(f"{tmp_path}/log").collect()] == ["b"]
    sinks.append_aliases(new, f"{tmp_path}/t", f"{tmp_path}/d", "run1")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and spark.read.parquet(f"{tmp_path}/d").first().run == "run1"
    report = sinks.confidence_report(quality.confidence_bands(new), "Aliases")
    assert "under 0.8: 2 (100.0 %)" in report
    path = write(f"{tmp_path}/r.csv", "alias_name,canonical_team_name,approved\nx,X,Yes\ny,Y,no\n")
    assert [r.alias_name for r in readers.approved_aliases(spark, path).collect()] == ["x"]


def test_alias_stream_run_twice(spark, tmp_path):
    table = f"{tmp_path}/aliases"
    shape = "alias_name string, canonical_team_name string, confidence double, source string, batch int"
    known = lambda: spark.read.schema(shape).parquet(table) if os.path.isdir(table) else spark.createDataFrame([], shape)
    resolve = lambda df: df.select("name", F.upper("name").alias("canonical"), F.lit(0.9).alias("confidence"), F.lit("t").alias("source"))
    for n, names in enumerate((["foxes", "owls"], ["Owls", "hawks"])):
        spark.createDataFrame([(x,) for x in names], "name string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("name string").parquet(f"{tmp_path}/in")
        aliases.sync(stream, known, resolve, table, f"{tmp_path}/cp{n}").awaitTermination()  # a new checkpoint: all files come again
    assert sorted(r.alias_name.lower() for r in known().collect()) == ["foxes", "hawks", "owls"]


def test_views(spark):
    games = spark.createDataFrame([(1.0, 1.0, 3, 1), (1.0, 2.0, None, 4)], "team_id double, home_team_id double, home_score int, away_score int")
    assert sorted(map(tuple, games.select(*reshape.oriented_scores()).collect())) == [(3, 1), (4, 0)]
    assert serving.by_team_id(games, "1").count() == 2 and serving.by_team_id(games, "x").count() == 0
    rows = spark.createDataFrame([("a", "M", 2015), ("b", "F", 2015), ("c", "m", 2014)], "name string, gender string, year int")
    assert [r.name for r in serving.slice_of(rows, gender="boys", year="2015").collect()] == ["a"] and serving.slice_of(rows, gender="girls").count() == 1 and serving.slice_of(rows, state="AZ").count() == 3
    raw = spark.createDataFrame([("(1,200)", "5 %", 7)], ["Power Score", "gp", "TEAM"])
    got = reshape.normalised_columns(raw, {"PowerScore": ["power score"], "GamesPlayed": ["GP"], "Team": ["team"]}, ["PowerScore", "GamesPlayed"]).first()
    assert (got.PowerScore, got.GamesPlayed, got.Team) == (-1200.0, 5.0, "7")
    df = spark.range(200)
    assert reshape.sampled(df).collect() == reshape.sampled(df.repartition(7)).collect() and reshape.sampled(df).count() == 10 and reshape.sampled(df.limit(3)).count() == 3
    review = spark.createDataFrame([("x", "B", 1), ("y", "A", 1), ("z", "A", 5)], "name string, category string, appearances int")
    assert [r.name for r in quality.by_appearances(review).collect()] == ["z", "y", "x"]
    assert reshape.preferred(rows, ["year", "none", "name"]).columns == ["year", "name"]
