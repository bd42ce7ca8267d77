"""Strength of schedule: means over opponents and the relaxation over the opponent graph."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import scores as S

UNKNOWN = 0.35


def opponent_mean(rows: DataFrame, strength: DataFrame) -> DataFrame:
    """team, sos_raw: mean strength of recent opponents; unknown ones count the median. strength: team, strength."""
    strength = strength.persist()  # read for the median and for the join
    median = S.percentile_row(strength, {"median": ("strength", 0.5)})
    known = strength.select(F.col("team").alias("opponent"), "strength")
    joined = rows.join(known, "opponent", "left").crossJoin(F.broadcast(median))
    return joined.groupBy("team").agg(F.avg(F.coalesce("strength", "median")).alias("sos_raw"))


def edges(rows: DataFrame) -> DataFrame:
    """team, opponent, cross_age, w: weights of the recent games, summed per pair so that a step sees each pair once. rows: with sides."""
    return rows.groupBy("team", "opponent", (F.col("age") != F.col("opponent_age")).alias("cross_age")).agg(F.sum(S.result_weight()).alias("w"))


def looped(edge: DataFrame, initial: DataFrame) -> DataFrame:
    """Edges and one loop a team, each with the mean of the initial strengths: a step then reads the strengths once.

    A team's rows stay with the team from step to step, so only the strengths are moved.
    """
    mean = initial.agg(F.coalesce(F.avg("s"), F.lit(0.5)).alias("mean"))
    own = initial.select("team", F.col("team").alias("opponent"), F.lit(False).alias("cross_age"), F.lit(0.0).alias("w"), F.lit(True).alias("own"))
    return edge.withColumn("own", F.lit(False)).unionByName(own).crossJoin(F.broadcast(mean))


def step(strength: DataFrame, edge: DataFrame) -> DataFrame:
    """One Jacobi step: .7 of the own strength and .3 of the weighted mean of the opponents'. strength: team, s; edge: looped."""
    theirs = strength.select(F.col("team").alias("opponent"), F.col("s").alias("o"))
    raw = F.coalesce("o", F.lit(UNKNOWN))
    effective = F.when(F.col("cross_age"), S.cross_age_boost(raw, F.col("mean"))).otherwise(raw)
    weight = F.when(~F.col("own"), F.col("w"))
    pulled = edge.join(theirs, "opponent", "left").groupBy("team").agg(F.sum(weight * effective).alias("num"), F.sum(weight).alias("den"), F.max(F.when(F.col("own"), F.col("o"))).alias("s"))
    return pulled.select("team", F.when(F.col("den") > 0, 0.7 * F.col("s") + 0.3 * F.col("num") / F.col("den")).otherwise(F.col("s")).alias("s"))


def relaxed(initial: DataFrame, edge: DataFrame, steps: int | None = None, most: int = 10, tolerance: float = 0.01) -> DataFrame:
    """team, sos_score: z-score (population) after a fixed number of steps, or when no strength moves by ``tolerance``.

    The edges are cached. A fixed number of steps is one plan; else every step is cut, as its change is looked at.
    """
    edge = looped(edge, initial).persist()
    now = initial
    for _ in range(steps if steps is not None else most):
        new = step(now, edge)
        if steps is None:
            new = cut(new)
            moved = new.withColumnRenamed("s", "t").join(now, "team").agg(F.max(F.abs(F.col("t") - F.col("s")))).first()[0]
            if moved is None or moved < tolerance:
                now = new
                break
        now = new
    else:
        if steps is None:
            logging.getLogger(__name__).warning("strengths still move by %s after %d steps", moved, most)
    now = cut(now)  # read for the rows and for their mean; what follows plans over a small table
    z = S.with_global(now, m=F.avg("s"), d=F.stddev_pop("s"))
    return z.select("team", F.coalesce(F.try_divide(F.col("s") - F.col("m"), F.col("d")), F.lit(0.0)).alias("sos_score"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in spark.checkpoint.dir; without one the rows are cached and the lineage stays."""
    configured = df.sparkSession.sparkContext.getCheckpointDir()
    return df.checkpoint() if configured else df.persist()
