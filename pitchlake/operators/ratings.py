"""Team records, metrics and ratings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import scores as S
from pitchlake.operators.reshape import most_recent, recency_window, status_by_games, trailing


def counted(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("long")


def record(long: DataFrame, tie: float = 0.5) -> DataFrame:
    """Record of each team; a tie counts ``tie`` of a win."""
    won, lost = F.col("gf") > F.col("ga"), F.col("gf") < F.col("ga")
    return long.groupBy("team").agg(
        F.count("*").alias("games_played"), counted(won).alias("wins"), counted(lost).alias("losses"), counted(F.col("gf") == F.col("ga")).alias("ties"),
        F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"), F.sum(F.col("gf") - F.col("ga")).alias("goal_diff"),
        F.avg(F.when(won, 1.0).when(lost, 0.0).otherwise(tie)).alias("win_pct"),
    )


def ranked(df: DataFrame, order: list[Column], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Consecutive ranks; ``order`` must end with a unique key. Runs on rows of teams, never of games."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def recent(long: DataFrame, as_of: dt.datetime, days: int = 365, n: int = 30) -> DataFrame:
    return most_recent(trailing(long, as_of, days), n)


def with_sides(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """Rows with age and state of the team and of its opponent; rows of unknown teams go."""
    mine = teams.select(F.col("team"), F.col("age").alias("age"), F.col("state").alias("state"))
    theirs = teams.select(F.col("team").alias("opponent"), F.col("age").alias("opponent_age"), F.col("state").alias("opponent_state"))
    return rows.join(mine, "team").join(theirs, "opponent")


def team_stats(long: DataFrame, teams: DataFrame, as_of: dt.datetime, days: int = 365, n: int = 30, total: DataFrame | None = None) -> DataFrame:
    """The cross-age engine's metrics: the newest n games in the window, the total over all games, tiers of 15, 10 and 5 games."""
    total = long.groupBy("team").agg(F.count("*").alias("total_games_history")) if total is None else total
    return stats_of(with_sides(recent(long, as_of, days, n), teams), total)


def stats_of(rows: DataFrame, total: DataFrame) -> DataFrame:
    """team_stats of rows with sides. total: team, total_games_history."""
    win = F.when(F.col("result") == "W", 1.0).otherwise(0.0)
    tier = lambda a, b: F.coalesce(F.avg(F.when(F.col("rn").between(a, b), win)), F.lit(0.0))
    cross_age, cross_state = F.col("age") != F.col("opponent_age"), F.col("state") != F.col("opponent_state")
    stats = rows.groupBy("team").agg(
        F.count("*").alias("games_played"), counted(F.col("result") == "W").alias("wins"), counted(F.col("result") == "L").alias("losses"), counted(F.col("result") == "T").alias("ties"),
        F.avg(win).alias("win_percentage"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"), F.sum(S.capped_margin()).alias("goal_differential"),
        (0.50 * tier(1, 15) + 0.35 * tier(16, 25) + 0.15 * tier(26, 30)).alias("recent_win_pct"),
        counted(cross_age).alias("cross_age_games"), counted(cross_state).alias("cross_state_games"), F.max("date").alias("last_game_date"),
    )
    stats = stats.withColumns({"cross_age_pct": F.col("cross_age_games") / F.col("games_played"), "cross_state_pct": F.col("cross_state_games") / F.col("games_played"), "offense": F.col("goals_for") / F.col("games_played"), "defense": F.col("goals_against") / F.col("games_played")})
    return stats.join(total, "team")


def power_e2(stats: DataFrame, schedule: DataFrame) -> DataFrame:
    """Shrunk offense and defense, logistic norms, .2/.2/.6, square-root penalty. schedule: team, sos_score."""
    df = stats.join(schedule, "team")
    df = S.shrunk(df, {"offense_adj": "offense", "defense_adj": "defense"}, "games_played")
    df = S.logistic(df, {"offense_norm": "offense_adj", "defense_high": "defense_adj", "sos_norm": "sos_score"})
    df = df.withColumn("defense_norm", 1 - F.col("defense_high")).drop("defense_high")
    df = df.withColumn("power_score", S.power_score(F.col("offense_norm"), F.col("defense_norm"), F.col("sos_norm")))
    df = df.withColumn("games_penalty", S.penalty(F.col("games_played"), 0.5))
    return df.withColumn("power_score_adj", F.col("power_score") * F.col("games_penalty"))


def numbered_year(long: DataFrame, as_of: dt.datetime, days: int = 365) -> DataFrame:
    """Games of the window with ``rn`` (1 newest) and ``used``, the team's games in it, from one sort."""
    return trailing(long, as_of, days).withColumns({"rn": F.row_number().over(recency_window()), "used": F.count(F.lit(1)).over(Window.partitionBy("team"))})


def weighted(year: DataFrame, n: int = 30) -> DataFrame:
    """The newest n games with n and the weight w; goals for are goals against plus the capped margin."""
    rows = year.where(F.col("rn") <= n).withColumn("n", F.least(F.col("used"), F.lit(n)))
    return rows.withColumns({"w": S.recency_weight(), "gf_capped": F.col("ga") + S.capped_margin()})


def weighted_recent(long: DataFrame, as_of: dt.datetime, days: int = 365, n: int = 30) -> DataFrame:
    """weighted(numbered_year(...)) without its full sort: every task keeps its newest n games of a team before they are shuffled.

    A team with half of all games sends n rows a task; its games are counted side by side.
    """
    year = trailing(long, as_of, days)
    used = year.groupBy("team").agg(F.count("*").alias("used"))
    return weighted(most_recent(year, n).join(used, "team"), n)


def off_def(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("team").agg(F.sum(F.col("w") * F.col("gf_capped")).alias("off_raw"), F.sum(F.col("w") * F.col("ga")).alias("def_raw"), F.count("*").alias("games_played"))


def strengths(base: DataFrame) -> DataFrame:
    """team, off_norm, def_norm (three digits), opp_off, opp_def: multipliers that the team gives to others."""
    df = S.minmax(base, {"off_norm": "off_raw", "def_norm": "def_raw"}, 3)
    return df.withColumns({"opp_off": S.opponent_strength(F.col("off_norm")), "opp_def": S.opponent_strength(F.col("def_norm"))})


def adjusted_games(year: DataFrame, base: DataFrame) -> DataFrame:
    """Games of numbered_year with adjusted goals: opponent strength, adaptive factor, performance layer. One join carries all metrics."""
    power = strengths(base).persist()  # a row a team, read by three joins
    means = power.agg(F.avg("opp_off").alias("m_off"), F.avg("opp_def").alias("m_def"))
    me = power.select("team", F.col("off_norm").alias("t_off"))
    you = power.select(F.col("team").alias("opponent"), F.col("off_norm").alias("o_off"), F.col("opp_off"), F.col("opp_def"))
    rows = year.withColumns({"games_ago": F.col("rn") - 1, "games_used": F.col("used")}).drop("rn", "used")
    rows = rows.join(me, "team", "left").join(you, "opponent", "left").crossJoin(F.broadcast(means))
    od, oo = F.coalesce("opp_def", "m_def"), F.coalesce("opp_off", "m_off")
    t_off = F.coalesce("t_off", F.lit(0.5))
    k = S.adaptive_multiplier(t_off, F.coalesce("o_off", F.lit(0.5)), F.col("games_used"))
    delta = (F.col("gf") - F.col("ga")) - (F.col("t_off") - od)
    rows = rows.withColumns({"adaptive_k": k, "perf_delta": delta, "adj_gf_base": F.col("gf") * od * k, "adj_ga_base": F.col("ga") * oo * k})
    factor = 1 + 0.15 * F.signum("perf_delta") * S.decay(F.col("games_ago")) * F.when(F.abs("perf_delta") >= 1, 1.0).otherwise(0.0)
    rows = rows.withColumn("perf_factor", factor)
    return rows.withColumns({"adj_gf": F.col("adj_gf_base") * F.col("perf_factor"), "adj_ga": F.col("adj_ga_base") * (2 - F.col("perf_factor"))})


def sao_sad(adjusted: DataFrame) -> DataFrame:
    """Weighted adjusted goals of the newest 30 games after the outlier guard: SAO = sum w gf, SAD = 1 / (sum w ga + .25)."""
    guarded = S.z_clipped(adjusted, "team", {"gf_z": "adj_gf", "ga_z": "adj_ga"})
    rows = guarded.withColumns({"rn": F.col("games_ago") + 1, "n": F.least(F.col("games_used"), F.lit(30))}).where("rn <= 30").withColumn("w", S.recency_weight())
    return rows.groupBy("team").agg(F.sum(F.col("w") * F.col("gf_z")).alias("sao_raw"), (1 / (F.sum(F.col("w") * F.col("ga_z")) + 0.25)).alias("sad_raw"), F.count("*").alias("games_played"))


def base_strength(long: DataFrame) -> DataFrame:
    """team, off_strength, def_strength (goals per game), base_strength: mean of both scaled to [0, 1]; high goals against count up, as coded."""
    per = long.groupBy("team").agg((F.sum("gf") / F.count("*")).alias("off_strength"), (F.sum("ga") / F.count("*")).alias("def_strength"))
    scaled = S.minmax(per, {"o": "off_strength", "d": "def_strength"})
    return scaled.withColumn("base_strength", 0.5 * (F.col("o") + F.col("d"))).drop("o", "d")


def distinct_history(long: DataFrame, as_of: dt.datetime, days: int = 540) -> DataFrame:
    """One row per (team, date, opponent), the first in file order."""
    w = Window.partitionBy("team", "date", "opponent").orderBy("game_id", F.col("is_home").desc(), "gf", "ga")
    return trailing(long, as_of, days).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def enriched_history(long: DataFrame, as_of: dt.datetime) -> DataFrame:
    """distinct_history with expected goal difference and impact."""
    rows = distinct_history(long, as_of)
    power = base_strength(rows)
    me = power.select("team", "off_strength")
    you = power.select(F.col("team").alias("opponent"), F.col("def_strength").alias("opp_def"), F.col("base_strength").alias("opponent_base_strength"))
    mean = power.agg(F.avg("off_strength").alias("m_off"), F.avg("def_strength").alias("m_def"))
    rows = rows.join(me, "team", "left").join(you, "opponent", "left").crossJoin(F.broadcast(mean))
    rows = rows.withColumn("expected_gd", F.coalesce("off_strength", "m_off") - F.coalesce("opp_def", "m_def"))
    rows = rows.withColumns({"gd_delta": F.col("gf") - F.col("ga") - F.col("expected_gd"), "opponent_base_strength": F.coalesce("opponent_base_strength", F.lit(0.5))})
    return rows.select("team", "opponent", "date", "gf", "ga", "opponent_base_strength", "expected_gd", "gd_delta")


def performance_adjustment(rows: DataFrame, power: DataFrame) -> DataFrame:
    """team, adjustment: sum of learning rate times tanh of half the boosted shortfall, streaks counted over known opponents. power: team, power_score, games_played."""
    me = power.select("team", F.col("power_score").alias("p"), F.col("games_played").alias("gp"))
    you = power.select(F.col("team").alias("opponent"), F.col("power_score").alias("q"))
    known = rows.join(me, "team").join(you, "opponent").withColumn("delta", S.capped_margin() - 6 * (F.col("p") - F.col("q")))
    order = [F.col("date"), F.col("game_id"), F.col("opponent").desc(), F.col("gf").desc(), F.col("ga").desc()]
    running = Window.partitionBy("team").orderBy(*order)
    known = known.withColumn("island", F.sum(F.when(F.col("delta") >= 0, 1).otherwise(0)).over(running.rowsBetween(Window.unboundedPreceding, 0)))
    under = F.when(F.col("delta") < 0, 1).otherwise(0)
    streak = F.sum(under).over(Window.partitionBy("team", "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("streak", streak)
    rate = 0.02 + 0.01 * F.least(F.lit(1.0), F.col("gp") / 30)
    return known.groupBy("team").agg(F.sum(rate * F.tanh(F.col("delta") * S.streak_multiplier(F.col("streak")) / 2)).alias("adjustment"), F.max("streak").alias("longest_streak"))


def power_e1(scaled: DataFrame, baseline: DataFrame, iterative: DataFrame | None = None) -> DataFrame:
    """power_score (four digits), gp_mult, sos_source, status. The schedule is the iterative one where a team has it, else the baseline.

    scaled: team, games_played, sao_norm, sad_norm; baseline: team, baseline; iterative: team, sos_norm.
    """
    df = scaled.join(baseline, "team")
    df = df.withColumn("sos_norm", F.lit(None).cast("double")) if iterative is None else df.join(iterative.select("team", "sos_norm"), "team", "left")
    power = S.rounded(S.power_score(F.col("sao_norm"), F.col("sad_norm"), F.coalesce("sos_norm", "baseline")), 4)
    return df.select("*", power.alias("power_score"), S.penalty(F.col("games_played"), 1.5).alias("gp_mult"), F.when(F.col("sos_norm").isNotNull(), "iterative").otherwise("baseline").alias("sos_source"), status_by_games("games_played").alias("status"))
