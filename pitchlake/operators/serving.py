"""Slices of ratings as a serving layer asks for them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators import reshape as R
from pitchlake.operators.numbering import numbered
from pitchlake.sources.league import days_before


def sorted_safely(df: DataFrame, column: str, ascending: bool = False, fallback: str = "power_score_adj", key: str = "team") -> DataFrame:
    """Order by the column, or by the fallback if there is no such column; nulls last, ties by key."""
    c = F.col(column if column in df.columns else fallback)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), key)


def slice_of(df: DataFrame, state: str | None = None, age: str | None = None, q: str | None = None, gender: str | None = None, year: str | int | None = None) -> DataFrame:
    """Rows of a slice. M, MALE and BOYS ask for M, any other gender for F; filters whose column is missing are ignored."""
    sex = None if not gender else "M" if gender.upper() in ("M", "MALE", "BOYS") else "F"
    for column, value in (("state", state), ("age", age), ("gender", sex), ("year", year)):
        if value and column in df.columns:
            df = df.where((F.upper(column) if column == "gender" else F.col(column).cast("string")) == str(value))
    return df.where(R.search("name", q)) if q else df


def by_team_id(df: DataFrame, team_id: str, column: str = "team_id") -> DataFrame:
    """Rows of a team whose id is asked for as text: compared as a number where it is one, else as text."""
    try:
        return df.where(F.col(column).try_cast("double") == float(team_id))
    except ValueError:
        return df.where(F.col(column).cast("string") == team_id)


def rankings(ratings: DataFrame, as_of: dt.datetime, least: int = 8, hide_days: int = 180, include_inactive: bool = False, sort: str = "power_score_adj", limit: int | None = None, **where) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(active with ranks, provisional, counts). Rows without games_played are in neither list.

    ratings: team, name, state, age, games_played, last_game_date, power_score, ...
    """
    df = slice_of(ratings, **where)
    df = df.withColumns({"gp_mult": R.games_step("games_played"), "status": R.status_by_games("games_played")}).withColumn("power_score_adj", F.col("power_score") * F.col("gp_mult"))
    fresh = F.col("last_game_date") >= days_before(as_of, hide_days)
    shown = df if include_inactive else df.where(fresh)
    active, provisional = shown.where(F.col("games_played") >= least), shown.where(F.col("games_played") < least)
    order = Window.orderBy(F.col(sort).desc_nulls_last(), "team")
    active = active.withColumn("rank", F.row_number().over(order))
    if limit:
        active = active.where(F.col("rank") <= max(1, min(limit, 5000)))
    sources = [F.coalesce(F.sum(F.when(F.col("sos_source") == k, 1)), F.lit(0)).alias(f"sos_{k}") for k in ("iterative", "baseline")] if "sos_source" in df.columns else []
    meta = df.agg(*sources, F.count("*").alias("total"), F.coalesce(F.sum(F.when(~fresh, 1)), F.lit(0)).alias("inactive"), F.coalesce(F.sum(F.when(fresh & (F.col("games_played") >= least), 1)), F.lit(0)).alias("active"), F.coalesce(F.sum(F.when(fresh & (F.col("games_played") < least), 1)), F.lit(0)).alias("provisional"))
    return active, provisional, meta


def history(rows: DataFrame, team, limit: int = 100) -> DataFrame:
    """Newest games of a team with the label of each; rows: team, date, opponent, gf, ga, gd_delta."""
    mine = rows.where(F.col("team") == team).withColumn("performance", R.performance_label("gd_delta"))
    return mine.orderBy(F.desc("date"), "opponent", "gf", "ga").limit(limit)


def as_json(df: DataFrame) -> DataFrame:
    """A row of JSON per row, nulls and NaN written as null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(clean).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def kpis(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.count("*").alias("n_teams"), F.avg("power_score").alias("mean_power"), F.sum("cross_age_games").alias("cross_age_games"), F.sum("cross_state_games").alias("cross_state_games"), F.avg("sos_score").alias("mean_sos"))


def by_state(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("state").agg(F.count("*").alias("n_teams"), F.max_by("team", F.struct("power_score_adj", -F.col("team"))).alias("best_team"))


#: Sort keys of the first engine's ranking, all falling, then the team: no two teams share a rank.
SIX_KEYS = ("power_score_adj", "sao_norm", "sad_norm", "sos_norm", "games_played")


def ranked_without_ties(ratings: DataFrame, keys: tuple[str, ...] = SIX_KEYS, team: str = "team") -> DataFrame:
    """``rank`` from 1 by the keys, best first, nulls last, then by team. Teams are dealt by range, none sees all."""
    return numbered(ratings, [*[F.col(k).desc_nulls_last() for k in keys], F.col(team)], "rank", 1)


def every_slice(ratings: DataFrame, by: tuple[str, ...] = ("state", "gender", "age"), most: int = 12) -> DataFrame:
    """Each row once for every slice that holds it: the columns of ``by`` hold its value or 'All'. slice_bits says which are set.

    A row is copied 2 ^ len(by) times, at most ``most`` columns apart; a null is a value of its own, ''.
    """
    if len(by) > most:
        raise ValueError("too many columns to slice by")
    bits = F.explode(F.sequence(F.lit(0), F.lit((1 << len(by)) - 1)))
    out = ratings.withColumn("slice_bits", bits)
    return out.withColumns({c: F.when(F.col("slice_bits").bitwiseAND(F.lit(1 << i)) != 0, F.coalesce(F.col(c).cast("string"), F.lit(""))).otherwise("All") for i, c in enumerate(by)})


def slice_ranks(ratings: DataFrame, by: tuple[str, ...] = ("state", "gender", "age"), score: str = "power_score_adj", team: str = "team") -> DataFrame:
    """The rank of every team in every slice that holds it, from one sort.

    Rows are sorted by slice and score over range partitions and numbered over all; a rank is the distance to the first number of its
    slice, and there is a row a slice of these. So the slice of all teams is not numbered by one task. Columns: slice_bits, ``by``, team, score, slice_rank.
    """
    rows = every_slice(ratings.select(*by, team, score), by)
    keys = ["slice_bits", *by]
    number = numbered(rows, [*keys, F.col(score).desc_nulls_last(), F.col(team)], "_n")
    first = number.groupBy(*keys).agg(F.min("_n").alias("_first"))
    return number.join(first, keys).select(*keys, team, score, (F.col("_n") - F.col("_first") + 1).alias("slice_rank"))


def slice_sizes(ratings: DataFrame, by: tuple[str, ...] = ("state", "gender", "age"), score: str = "power_score_adj", team: str = "team") -> DataFrame:
    """One row a slice, of all combinations of ``by``: n_teams, mean_score, best_team. Counted by a cube, summed before the shuffle.

    The mean is a decimal: scores are summed to 18 places, so that it does not depend on the order and a half can be rounded.
    """
    values = ratings.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by], team, score)
    best = F.max_by(team, F.struct(F.col(score), -F.col(team)))
    cube = values.cube(*by).agg(F.count("*").alias("n_teams"), F.avg(F.col(score).cast("decimal(28,18)")).alias("mean_score"), best.alias("best_team"), *[F.grouping(c).alias(f"_{c}") for c in by])
    return cube.select(*[F.when(F.col(f"_{c}") == 1, "All").otherwise(F.col(c)).alias(c) for c in by], "n_teams", "mean_score", "best_team")


def selector_params(gender: str, age_label: str, state: str) -> Column:
    """The query string that a selection of gender, age label ('U12 (2013)') and state stands for."""
    sex = F.when(F.col(gender) == "Boys", "boys").otherwise("girls")
    return F.format_string("gender=%s&age_group=%s&state=%s", sex, F.split(age_label, " ")[0], F.col(state))
