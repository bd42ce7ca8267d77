"""Games of a league derived from the order tables, and the team dimension.

Every lineitem is a game between two suppliers. Scores come from quantity and price by integer arithmetic, so any
engine derives the same league.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class League:
    """``as_of`` stands for now in every trailing window, so results do not depend on the clock."""

    games: DataFrame
    teams: DataFrame
    as_of: dt.datetime


#: (number of suppliers, newest ship date) by application, directory and change times of the two tables.
_known: dict[tuple, tuple[int, dt.datetime | None]] = {}


def _changed(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def facts(spark: SparkSession, sf_dir: str) -> tuple[int, dt.datetime | None]:
    """(number of suppliers, newest ship date) from one job, kept until a table changes."""
    key = (spark.sparkContext.applicationId, sf_dir, *(_changed(spark, f"{sf_dir}/{t}.parquet") for t in ("supplier", "lineitem")))
    if key not in _known:
        newest = read(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("d"))
        _known[key] = tuple(read(spark, sf_dir, "supplier").agg(F.count("*").alias("n")).crossJoin(newest).first())
    return _known[key]


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, date, team_a, team_b, score_a, score_b, event. game_id only orders games, it is not unique."""
    n = facts(spark, sf_dir)[0]
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("game_id"),
        F.col("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("team_a"),
        ((F.col("l_suppkey") + 1 + F.col("l_partkey") % (n - 1)) % n).alias("team_b"),
        (F.floor("l_quantity") % 7).alias("score_a"),
        (F.floor("l_extendedprice") % 6).alias("score_b"),
        F.col("l_returnflag").alias("event"),
    )


def games_of_teams(g: DataFrame) -> DataFrame:
    """team, total_games_history: games of either side, counted side by side so that no game is doubled before it is counted."""
    whole = g.where("team_a is not null and team_b is not null and score_a is not null and score_b is not null")
    pairs = whole.groupBy("team_a", "team_b").agg(F.count("*").alias("n"))
    return pairs.select(F.explode(F.array("team_a", "team_b")).alias("team"), "n").groupBy("team").agg(F.sum("n").alias("total_games_history"))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team, name, state, age."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    suppliers = read(spark, sf_dir, "supplier")
    age = F.when(F.col("s_nationkey") % 2 == 0, "U10").otherwise("U11")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("team"), F.col("s_name").alias("name"), "state", age.alias("age"))


def load(spark: SparkSession, sf_dir: str) -> League:
    g = games(spark, sf_dir)
    as_of = facts(spark, sf_dir)[1]
    return League(g, teams(spark, sf_dir), as_of or dt.datetime(1970, 1, 1))


def days_before(as_of: dt.datetime, days: int) -> Column:
    """A literal, so that the comparison reaches the scan as a pushed filter."""
    return F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")
