"""Connectivity of the opponent graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.operators.numbering import numbered
from pitchlake.operators.sos import cut


def undirected(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v) in both directions. pairs: a, b."""
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return pairs.where("a is not null and b is not null").select(both.alias("e")).select("e.u", "e.v").distinct()


def degrees(pairs: DataFrame) -> DataFrame:
    """team, degree: distinct neighbours; a loop counts two."""
    return undirected(pairs).groupBy(F.col("u").alias("team")).agg(F.sum(F.when(F.col("u") == F.col("v"), 2).otherwise(1)).alias("degree"))


def components(pairs: DataFrame, most: int = 50) -> DataFrame:
    """team, component (smallest team of it), component_size: least labels spread along edges, then jump to the label's label."""
    edge = undirected(pairs).cache()
    label = cut(edge.groupBy(F.col("u").alias("team")).agg(F.least(F.min("v"), F.min("u")).alias("label")))
    for _ in range(most):
        near = edge.join(label.withColumnRenamed("team", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        spread = label.join(near, label["team"] == near["u"]).select("team", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = spread.select(F.col("team").alias("mid"), F.col("mid").alias("far"))
        new = spread.join(jump, "mid", "left").select("team", "old", F.least("mid", F.coalesce("far", "mid")).alias("label"))
        new = cut(new)
        moved = new.where("label <> old").limit(1).count()
        label = new.select("team", "label")
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still move after {most} rounds")
    size = label.groupBy("label").agg(F.count("*").alias("component_size"))
    return label.join(size, "label").select("team", F.col("label").alias("component"), "component_size")


def connectivity(pairs: DataFrame) -> DataFrame:
    """team, component_id (0, 1, ... by first appearance), component_size, degree."""
    found = components(pairs)
    ids = numbered(found.select("component").distinct(), ["component"], "component_id")
    return found.join(ids, "component").join(degrees(pairs), "team").select("team", "component_id", "component_size", "degree")
