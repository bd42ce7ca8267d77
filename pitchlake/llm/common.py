"""Helpers shared by the training-data operators: shared storage, grouping of sorted batches, gapless numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders that this process has written by ``stash``, the oldest first.
_stashes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local master may do without and gets a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pitchlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pitchlake/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    _stashes.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stashed() -> int:
    """How many folders ``stash`` has written; a mark for ``forget``."""
    return len(_stashes)


def forget(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Delete the folders that ``stash`` wrote after the mark, but the last ones; DataFrames that read them end here."""
    gone = _stashes[since : len(_stashes) - but_last]
    del _stashes[since : len(_stashes) - but_last]
    for path in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = 200_000) -> DataFrame:
    """Join with a side that is broadcast only if it counts at most ``rows`` rows; give it narrow and stashed."""
    return left.join(F.broadcast(right) if right.limit(rows + 1).count() <= rows else right, on, how)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Cut a stream of batches, sorted by ``keys``, into batches that hold whole groups only.

    The last group of a batch waits for the next batch, so memory holds one batch and one group.
    Keys are integers without nulls.
    """
    held: list[pa.RecordBatch] = []

    def last_key(b: pa.RecordBatch) -> tuple:
        return tuple(b.column(b.schema.get_field_index(k))[-1].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows, bool)
        for k, v in zip(keys, last_key(b), strict=True):
            same &= b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) == v
        first = int(np.argmax(same))
        if first or (held and last_key(held[-1]) != last_key(b)):
            out = [*held, b.slice(0, first)]
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Row numbers where a new group starts, and the number of rows at the end."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    if n > 1:
        new[1:n] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest row number of each row's component, for a symmetric boolean matrix of links."""
    n = len(linked)
    label = np.arange(n)
    adj = linked.copy()
    np.fill_diagonal(adj, True)
    while True:
        low = np.where(adj, label[None, :], n).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Number rows from 0 in ``order`` without a task that sees them all: sort by range, count per part, add offsets."""
    cut = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered")
    counts = cut.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_row")) - 1
    return cut.withColumn("_within", within).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_row", "_rows", "_before", "_within")


def distributed_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (src, dst: long) as (node, component), component being the smallest node.

    Alternates large-star and small-star steps. Each is a minimum per node (pre-aggregated before the shuffle)
    and an equi-join, so a hub with many neighbours is neither collected nor expanded into pairs. Every round is
    written to the shared folder. Loops and repeated edges are ignored; nodes without edges are not returned.
    """
    pair = lambda a, b: [F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")]
    now = stash(edges.where("src is not null and dst is not null and src <> dst").select(*pair("src", "dst")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(now.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("child"), F.col("low").alias("parent")).distinct()
        large = stash(large, "large-star")
        least = large.groupBy("child").agg(F.min("parent").alias("least"))
        small = large.join(least, "child").select(F.explode(F.array(F.struct(F.col("child").alias("a"), F.col("least").alias("b")), F.struct(F.col("parent").alias("a"), F.col("least").alias("b")))).alias("e")).where("e.a <> e.b").select(F.col("e.a").alias("child"), F.col("e.b").alias("parent")).distinct()
        now = stash(small, "small-star")
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("parent").distinct()
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(roots.select(F.col("parent").alias("node"), F.col("parent").alias("component")))
