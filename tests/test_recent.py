"""The newest games of a team: kept by task before the shuffle, the same as by a full sort."""

import datetime as dt
import logging
import random

from pyspark.sql import functions as F

from pitchlake.operators import ratings, reshape, sos


def long_rows(spark, n=4000):
    rng = random.Random(2)
    day = dt.datetime(2025, 1, 1)
    rows = [(i // 2, day - dt.timedelta(days=rng.randint(0, 500)), 0 if rng.random() < 0.5 else rng.randint(1, 60), rng.randint(1, 60), rng.randint(0, 5), rng.randint(0, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "game_id long, date timestamp_ntz, team long, opponent long, gf int, ga int").repartition(9)
    return df.withColumn("result", F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") < F.col("ga"), "L").otherwise("T")), day


def test_newest_games_with_a_hot_team(spark):
    df, day = long_rows(spark)
    columns = ["team", "opponent", "game_id", "rn", "n", "w", "gf_capped"]
    rows = lambda d: sorted(tuple(r) for r in d.select(*columns).collect())
    assert rows(ratings.weighted_recent(df, day)) == rows(ratings.weighted(ratings.numbered_year(df, day)))


def test_tasks_keep_thirty_rows_a_team(spark):
    df, day = long_rows(spark)
    plan = ratings.weighted_recent(df, day)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_a_schedule_that_does_not_settle_is_reported(spark, caplog):
    df, day = long_rows(spark, 400)
    rows = reshape.most_recent(df).withColumns({"age": F.lit("a"), "opponent_age": F.lit("a")})
    start = df.groupBy("team").agg(F.avg(F.when(F.col("gf") > F.col("ga"), 1.0).otherwise(0.0)).alias("s"))
    with caplog.at_level(logging.WARNING):
        sos.relaxed(start, sos.edges(rows), None, 1, 0.0)
    assert "still move" in caplog.text
