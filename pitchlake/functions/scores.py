"""Scores of games and teams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded as binary doubles, like SQL's round on doubles: a value just under a half goes down. Spark's own reads the shortest decimal form."""
    of = 10.0**digits
    return F.round((F.col(c) if isinstance(c, str) else c) * of) / of


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def capped_margin(gf: str = "gf", ga: str = "ga", cap: int = 6) -> Column:
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col(gf) - F.col(ga)))


def adaptive_multiplier(team: Column, opponent: Column, games: Column, least: float = 8, alpha: float = 0.5, beta: float = 0.6) -> Column:
    """Less weight for weak opponents and short records."""
    return 1 / (1 + F.pow(F.greatest(F.lit(0.0), team - opponent), F.lit(alpha))) * F.least(F.lit(1.0), F.pow(games / least, F.lit(beta)))


def recency_weight(rn: str = "rn", n: str = "n") -> Column:
    """Weight of the rn-th newest of n <= 30 games; the weights of a team sum to 1.

    Up to 10 games are alike. Up to 25, the ten newest share 70 %. Beyond, the newest n - 25 are dampened.
    """
    r, m = F.col(rn), F.col(n)
    e = m - 25
    share = F.when(e == 1, 0.8).otherwise(0.6 * e)
    step = F.when(e == 1, 0.8).otherwise(0.8 - 0.4 * F.try_divide(e - r, e - 1))
    raw = F.when(r <= e, 0.07 * step).when(r <= e + 10, 0.07).otherwise(0.02)
    return F.when(m <= 10, 1.0 / m).when(m <= 25, F.when(r <= 10, 0.07).otherwise(F.try_divide(F.lit(0.30), m - 10))).otherwise(raw / (1 + 0.07 * share))


def decay(games_ago: Column, rate: float = 0.08, most: int = 30) -> Column:
    return F.exp(-rate * F.greatest(F.lit(0), F.least(F.lit(most), games_ago)))


def opponent_strength(norm: Column) -> Column:
    return clip(1 / clip(norm, 0.15, 0.95), 0.67, 1.5)


def result_weight(result: str = "result", margin: Column | None = None) -> Column:
    d = capped_margin() if margin is None else margin
    return F.when(F.col(result) == "W", F.least(F.lit(1.6), 1 + 0.1 * d)).when(F.col(result) == "L", F.greatest(F.lit(0.4), 1 - 0.1 * F.abs(d))).otherwise(1.0)


def cross_age_boost(strength: Column, mean: Column) -> Column:
    return F.when(strength > mean, strength * F.least(1 + 0.05 * (strength - mean) / mean, F.lit(1.10))).otherwise(strength)


def streak_multiplier(streak: Column) -> Column:
    """2 games 1.2, 3 games 1.5, 5 and more 2; 4 games 1, as the rule is coded."""
    return F.when(streak == 2, 1.2).when(streak == 3, 1.5).when(streak >= 5, 2.0).otherwise(1.0)


def penalty(games: Column, power: float) -> Column:
    return F.least(F.lit(1.0), F.pow(games / 20, F.lit(power)))


def power_score(offense: Column, defense: Column, schedule: Column) -> Column:
    return 0.2 * offense + 0.2 * defense + 0.6 * schedule


def with_global(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Each row with aggregates of the whole table: a one-row aggregate (partial per task) and a broadcast of that row."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in aggregates.items()])))


def shrunk(df: DataFrame, columns: dict[str, str], games: str, tau: float = 8.0) -> DataFrame:
    """Bayesian shrinkage of each column to the mean of the table: {new name: column}."""
    out = with_global(df, **{f"_mu_{c}": F.avg(c) for c in columns.values()})
    return out.withColumns({new: (F.col(games) * F.col(c) + tau * F.col(f"_mu_{c}")) / (F.col(games) + tau) for new, c in columns.items()}).drop(*[f"_mu_{c}" for c in columns.values()])


def logistic(df: DataFrame, columns: dict[str, str], spread: float = 1.5) -> DataFrame:
    """Logistic of the z-score (sample deviation times ``spread``): {new name: column}."""
    aggregates = {}
    for c in columns.values():
        aggregates |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_samp(c)}
    out = with_global(df, **aggregates)
    made = {new: 1 / (1 + F.exp(-F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}") * spread))) for new, c in columns.items()}
    return out.withColumns(made).drop(*aggregates)


def minmax(df: DataFrame, columns: dict[str, str], digits: int | None = None) -> DataFrame:
    """To [0, 1]; a flat column gives 0.5; rounded if ``digits`` is given. {new name: column}."""
    aggregates = {}
    for c in columns.values():
        aggregates |= {f"_lo_{c}": F.min(c), f"_hi_{c}": F.max(c)}
    out = with_global(df, **aggregates)
    made = {}
    for new, c in columns.items():
        lo, hi = F.col(f"_lo_{c}").cast("double"), F.col(f"_hi_{c}").cast("double")
        x = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)
        made[new] = rounded(x, digits) if digits is not None else x
    return out.withColumns(made).drop(*aggregates)


#: Rows up to which one aggregate may hold the values of a percentile; beyond it they are found by counted bins.
HELD_VALUES = 500_000


def percentile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of interpolated percentiles of the whole table: {name: (column, share)}."""
    from pitchlake.operators.quantiles import quantile_row

    if df.limit(HELD_VALUES + 1).count() <= HELD_VALUES:
        return df.agg(*[F.percentile(c, F.lit(s)).alias(name) for name, (c, s) in wanted.items()])
    return quantile_row(df, wanted)


def _winsorised(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    wanted = {f"_p{n}_{c}": (c, s) for c in columns.values() for n, s in ((5, 0.05), (95, 0.95))}
    cuts = percentile_row(df, wanted)
    return df.crossJoin(F.broadcast(cuts)).withColumns({f"_w_{c}": F.when(F.col(c).isNotNull(), F.greatest(F.col(f"_p5_{c}"), F.least(F.col(f"_p95_{c}"), F.col(c)))) for c in columns.values()})  # one row


def robust_scale(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Winsorise at the 5th and 95th percentile, z-score (population deviation), logistic; a flat column gives 0.5."""
    out = _winsorised(df, columns)
    aggregates = {}
    for c in columns.values():
        aggregates |= {f"_wm_{c}": F.avg(f"_w_{c}"), f"_ws_{c}": F.stddev_pop(f"_w_{c}")}
    out = with_global(out, **aggregates)
    made = {new: F.when(F.col(f"_ws_{c}") > 0, 1 / (1 + F.exp(-F.try_divide(F.col(f"_w_{c}") - F.col(f"_wm_{c}"), F.col(f"_ws_{c}"))))).otherwise(0.5) for new, c in columns.items()}
    return out.withColumns(made).select(*df.columns, *columns)


def robust_minmax(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Clip to the 5th and 95th percentile and scale; a flat column gives 0.5, a null stays null."""
    out = _winsorised(df, columns)
    made = {}
    for new, c in columns.items():
        lo, hi = F.col(f"_p5_{c}"), F.col(f"_p95_{c}")
        made[new] = F.when(F.col(c).isNotNull(), F.when(hi > lo, (F.col(f"_w_{c}") - lo) / (hi - lo)).otherwise(0.5))
    return out.withColumns(made).select(*df.columns, *columns)


def z_clipped(df: DataFrame, key: str, columns: dict[str, str], z: float = 2.5) -> DataFrame:
    """Clip to mean +- z deviations of the group; a group of one row, or without spread, counts a deviation of 1."""
    w = Window.partitionBy(key)
    made = {}
    for new, c in columns.items():
        sd = F.stddev_samp(c).over(w)
        sd = F.when(sd > 0, sd).otherwise(1.0)
        mean = F.avg(c).over(w)
        made[new] = F.when(F.count(F.lit(1)).over(w) > 1, F.greatest(mean - z * sd, F.least(mean + z * sd, F.col(c)))).otherwise(F.col(c))
    return df.withColumns(made)


def percent_rank_average(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rank over the table as a share, ties at their average place."""
    below = Window.orderBy(column)
    n = df.agg(F.count(column).alias("_n"))
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_p"))
    ranked = counted.withColumn("_upto", F.sum("_p").over(below.rowsBetween(Window.unboundedPreceding, 0)))
    share = ranked.crossJoin(F.broadcast(n)).select(F.col(column).alias("_v"), ((F.col("_upto") - F.col("_p") + 1 + (F.col("_p") - 1) / 2) / F.col("_n")).alias(name))
    return df.join(share, df[column] == share["_v"], "left").drop("_v")
