"""Exact quantiles of several columns and groups at once, without a task or an aggregate that holds the values.

A quantile q of n values lies at place q (n - 1): between two order statistics. Every wanted statistic starts with the range of its
group's values. A round counts the values of each open range in at most ``BINS`` equal bins, with the least and greatest value of each
bin, and goes on with the bin that holds the statistic, until a bin's least and greatest value are one: that is the statistic. Only
counts are shuffled, at most ``BINS`` + 3 rows a range; values far apart take a few rounds, as a bin's range is its values', not its edges'.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators.sos import cut

BINS = 1024


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = (), bins: int = BINS, most: int = 250) -> DataFrame:
    """``by``, column, share, value: the interpolated quantiles, as percentile_cont has them. Null and NaN values do not count; a column of a group without values has no row."""
    keys = [*by, "column"]
    values = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select(*by, "v.column", "v.x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    groups = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.col("share") * (F.col("n") - 1)
    wanted = groups.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("at", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    state = cut(wanted.select(*keys, "n", "at", "lo", "hi", F.lit(0).cast("long").alias("below")).distinct())
    done = None
    for _ in range(most):
        found = state.where("lo = hi").select(*keys, "at", F.col("lo").alias("value"))
        done = found if done is None else done.union(found)
        state = state.where("lo < hi")
        if not state.limit(1).count():
            break
        wide = F.col("hi") - F.col("lo")
        inner = F.when(wide < float("inf"), F.floor(F.least(F.lit(bins - 1.0), (F.col("x") - F.col("lo")) / wide * bins))).when(F.col("x") < 0, 0).otherwise(1)  # a range over half of all doubles is cut at 0
        held = F.when(F.col("x") == float("-inf"), -1).when(F.col("x") == float("inf"), bins).otherwise(inner)
        counted = values.join(state, keys).where("x between lo and hi").groupBy(*keys, "at", "n", "below", held.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "at").orderBy("bin"))
        state = cut(counted.withColumn("upto", F.col("below") + upto).where("upto > at and upto - c <= at").select(*keys, "n", "at", "lo", "hi", (F.col("upto") - F.col("c")).alias("below")))
    else:
        raise RuntimeError("quantiles did not settle")
    exact = cut(done)
    low, high = (exact.select(*keys, F.col("at").alias(a), F.col("value").alias(v)) for a, v in (("at_low", "low"), ("at_high", "high")))
    asked = groups.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumns({"at_low": F.floor(place), "at_high": F.ceil(place), "part": place - F.floor(place)})
    joined = asked.join(low, [*keys, "at_low"]).join(high, [*keys, "at_high"])
    value = F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    return joined.select(*keys, "share", value.alias("value"))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of quantiles of the whole table: {name: (column, share)}; null where a column has no values."""
    rows = quantiles(df, sorted({c for c, _ in wanted.values()}), sorted({s for _, s in wanted.values()}))
    pick = lambda c, s: F.max(F.when((F.col("column") == c) & (F.col("share") == s), F.col("value")))
    return rows.agg(*[pick(c, s).alias(name) for name, (c, s) in wanted.items()])
