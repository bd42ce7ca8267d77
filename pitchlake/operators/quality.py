"""Data-quality reports and alignment checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import scores as S
from pitchlake.operators.ratings import counted


def bronze_names(df: DataFrame, column: str) -> DataFrame:
    """n, numeric_share, short_share, has_letters of a name column, in one pass, and the verdict."""
    c = F.coalesce(F.col(column), F.lit(""))
    flag = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    out = df.agg(F.count("*").alias("n"), flag(c.rlike(r"^\s*[0-9]+\s*$")).alias("numeric_share"), flag(F.length(F.trim(c)) <= 3).alias("short_share"), F.max(c.rlike("[A-Za-z]")).alias("has_letters"))
    return out.withColumn("valid", (F.col("numeric_share") <= 0.10) & (F.col("short_share") <= 0.20) & F.col("has_letters"))


def gold_games(games: DataFrame, teams: DataFrame) -> DataFrame:
    """rows, distinct teams of the A side, first and last date, share of A-side teams that the master knows."""
    known = teams.select(F.col("team").alias("known")).distinct()
    per = games.groupBy("team_a").agg(F.count("*").alias("n"), F.min("date").alias("d0"), F.max("date").alias("d1"))
    joined = per.join(known, F.col("team_a") == F.col("known"), "left")
    return joined.agg(F.sum("n").alias("n_rows"), F.count("team_a").alias("n_teams"), F.min("d0").alias("first_date"), F.max("d1").alias("last_date"), F.avg(F.when(F.col("known").isNotNull(), 1.0).otherwise(0.0)).alias("coverage"))


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of either side that the other lacks: key, side."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def confidence_bands(aliases: DataFrame, column: str = "confidence") -> DataFrame:
    c = F.col(column)
    bands = aliases.agg(
        F.count("*").alias("n"), counted(c >= 0.9).alias("high"), counted((c >= 0.8) & (c < 0.9)).alias("middle"), counted(c < 0.8).alias("low"),
        F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"),
    )
    return bands.crossJoin(F.broadcast(S.percentile_row(aliases, {"median": (column, 0.5)})))  # one row each


def audit_bands(scores: DataFrame, column: str = "score") -> DataFrame:
    c = F.col(column)
    return scores.agg(F.count("*").alias("n"), counted(c > 0.9).alias("above_09"), counted((c > 0.8) & (c <= 0.9)).alias("above_08"), counted(c <= 0.8).alias("rest"), F.avg(F.when(c > 0.8, 1.0).otherwise(0.0)).alias("match_rate"))


def shares(df: DataFrame, *keys: str) -> DataFrame:
    """Count of each combination and its share in percent of the rows with the same first keys."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys[:-1])
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(w))


def top_opponents(long: DataFrame, k: int = 3) -> DataFrame:
    """team, appearances and its k most frequent opponents as an array of (opponent, n)."""
    pairs = long.groupBy("team", "opponent").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("n"), "opponent"))
    top = pairs.withColumn("nth", nth).groupBy("team").agg(F.sum("n").alias("appearances"), F.array_sort(F.collect_list(F.when(F.col("nth") <= k, F.struct("nth", "opponent", "n")))).alias("top"))
    return top.select("team", "appearances", F.transform("top", lambda s: F.struct(s["opponent"].alias("opponent"), s["n"].alias("n"))).alias("top"))


def calibration(df: DataFrame, predicted: str, actual: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_predicted, mean_actual; right-closed bins, empty ones stay."""
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.col(predicted) * bins))).cast("int")
    got = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"))
    return all_bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "mean_actual")


def prediction_scores(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Accuracy, Brier score and log loss."""
    p, y = F.col(predicted), F.col(actual)
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    return df.agg(F.count("*").alias("n"), F.avg(F.when((p >= 0.5) == (y >= 0.5), 1.0).otherwise(0.0)).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def area_under_curve(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """auc: the chance that a positive is predicted higher than a negative, ties by half; null if either is missing.

    Counts of each distinct prediction are numbered by range, so no task ranks all rows.
    """
    counts = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(F.col(predicted).alias("p")).agg(counted(F.col(actual) >= 0.5).alias("pos"), counted(F.col(actual) < 0.5).alias("neg"))
    part = counts.repartitionByRange("p").withColumn("_part", F.spark_partition_id()).persist()
    sums = part.groupBy("_part").agg(F.sum("neg").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum("neg").over(Window.partitionBy("_part").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
    ranked = part.withColumn("_below", below).join(sums.select("_part", before.alias("_before")), "_part")
    won = F.sum(F.col("pos") * (F.col("_before") + F.col("_below") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def calibration_slope(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """slope, intercept of the actual outcome on the predicted probability by least squares."""
    return df.agg(F.regr_slope(actual, predicted).alias("slope"), F.regr_intercept(actual, predicted).alias("intercept"))


def by_appearances(df: DataFrame) -> DataFrame:
    """Review rows by category, within it the most frequent first."""
    return df.orderBy(F.asc("category"), F.desc("appearances"), "name")


def mapping_audit(mapping: DataFrame, raw: str, canonical: str) -> DataFrame:
    return mapping.agg(F.count("*").alias("n"), F.count_distinct(raw).alias("n_raw"), F.count_distinct(canonical).alias("n_canonical"), (F.count("*") - F.count_distinct(raw)).alias("duplicates"))


def overlap(games: DataFrame, own: DataFrame, older: DataFrame, age: str) -> DataFrame:
    """One row: games and teams of an age group's games, their overlap with the master list, and the games against teams of the older list.

    games: team_a, team_b, age_a; own, older: team. A team without a game, or without a place in the list, counts on its side.
    """
    sides = games.select(F.explode(F.array(F.struct(F.col("team_a").alias("team"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("team_b").alias("team"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("s")).select("s.*").where("team is not null")
    seen = sides.groupBy("team").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = seen.join(own.select("team").distinct().withColumn("listed", F.lit(1)), "team", "full")
    has = lambda c: F.col(c).isNotNull()
    teams = both.agg(
        counted(F.col("a") == 1).alias("teams_a"), counted(F.col("b") == 1).alias("teams_b"), counted(has("a")).alias("teams_in_games"), counted(has("listed")).alias("teams_in_master"),
        counted(has("a") & has("listed")).alias("in_both"), counted(~has("a")).alias("master_only"), counted(~has("listed")).alias("games_only"),
    )
    against = games.join(older.select(F.col("team").alias("team_b"), F.lit(True).alias("older")).distinct(), "team_b", "left")
    counts = against.agg(F.count("*").alias("n_games"), counted((F.col("age_a") == age) & F.col("older")).alias("cross_age_games"))
    return counts.crossJoin(F.broadcast(teams)).withColumn("cross_age_pct", F.coalesce(F.try_divide(100.0 * F.col("cross_age_games"), F.col("n_games")), F.lit(0.0)))  # two rows of counts
