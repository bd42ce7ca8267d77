"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors become one class first. The number of sign bits follows the number of classes, so that a bucket holds
a few hundred vectors at every scale, and the number of tables follows from the bits and ``miss``, the chance that a
pair exactly at the threshold meets in no table. Buckets are pre-counted and large ones cut into pairs of blocks.

Blocks are met twice. First only ids and all sign bits of the vectors travel: a pair goes on if its bits differ in no
more places than a pair at the threshold can (but for a chance of ``miss``), and only in the first table where it meets.
Then the vectors of rows that have such a pair are fetched, and cosines are exact. Links are counted and spanned inside
the task, pairs never leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import distributed_components, group_bounds, join_small, local_components, sorted_groups, stash, table

BUCKET_ROWS = 256
BLOCK_ROWS = 1024  # of a bucket that is cut into pairs of blocks


def finite(vector: str) -> Column:
    """The vector is neither null nor empty and holds neither null, NaN nor an infinity."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(good, F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of equal length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def tables_for(n: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """(bits, tables, most) for n vectors: the bits of all tables in which a pair may differ."""
    bits = max(4, min(60, round(math.log2(max(n, 1) / BUCKET_ROWS)))) if n > BUCKET_ROWS else 4
    turned = math.acos(threshold) / math.pi
    tables = math.ceil(math.log(miss) / math.log1p(-((1 - turned) ** bits)))
    total, most, rest = bits * tables, 0, 1.0
    for most in range(total + 1):
        rest -= math.comb(total, most) * turned**most * (1 - turned) ** (total - most)
        if rest < miss / 10:
            break
    return bits, tables, most


def near_pairs(signs: np.ndarray, left: int, t: int, bits: int, most: int) -> np.ndarray:
    """Symmetric matrix of the pairs of a block that are close in all bits and meet in table ``t`` first.

    signs: rows of 0 and 1. ``left`` rows meet the rest; 0 stands for a block met with itself.
    """
    s = signs.astype(np.float32) * 2 - 1
    near = (signs.shape[1] - s @ s.T) / 2 <= most
    if left:
        near[:left, :left] = near[left:, left:] = False
    np.fill_diagonal(near, False)
    for e in range(t):
        if not near.any():
            break
        part = s[:, e * bits : (e + 1) * bits]
        near &= part @ part.T < bits
    return near


def near_vectors(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-3, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors of one length are linked if the cosine of their double values is ``threshold`` or more.

    Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing and
    is its own component; equal vectors link with each other; rows that repeat a vec_id are vectors each: every row counts
    its own links and has its own component, they are not linked by their id; a row with a null vec_id is a vector too, but
    names no component: component_id is the smallest id that is not null, or null if there is none, and kept is true where
    component_id and vec_id are equal or both null; an empty table gives an empty table; extra columns are ignored.
    """
    usable = finite("v") & F.exists("v", lambda x: x != 0)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    base = base.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))))
    base = base.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(3), "v", F.lit(5))})
    classes = base.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("head"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = stash(classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "head", "n", F.size("v").alias("dims"), "v"), "vector-classes")
    bits, tables, most = tables_for(classes.count(), threshold, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, bits * tables))
                x = matrix(part.column(2), d)
                x /= np.abs(x).max(axis=1, keepdims=True)
                side = x @ planes[d] >= 0
                bucket = (side.reshape(len(x), tables, bits) * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)
                yield pa.RecordBatch.from_pydict({"node": part.column(0), "dims": part.column(1), "buckets": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(bucket.reshape(-1))), "signs": pa.array([r.tobytes() for r in np.packbits(side, axis=1)], pa.binary())})

    signed = stash(classes.select("node", "dims", "v").mapInArrow(sign, "node long, dims int, buckets array<long>, signs binary"), "vector-signs")
    met = signed.select("node", "dims", "signs", F.posexplode("buckets").alias("t", "bucket"))
    sizes = stash(met.groupBy("t", "bucket", "dims").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK_ROWS), "large-buckets")
    met = join_small(met, sizes, ["t", "bucket", "dims"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK_ROWS), F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks"))
    met = met.withColumns({"_own": own, "_other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    keys = ["t", "bucket", "dims", "lo", "hi"]
    met = met.select("t", "bucket", "dims", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), "node", "signs")

    def blocks(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first row, end, rows of the left side or 0, pairs) of each block of a batch that has near pairs."""
        col = lambda k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
        parts, side = [col(k) for k in keys], col("side")
        packed = b.column(b.schema.get_field_index("signs"))
        bounds = group_bounds(*parts)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            one = parts[3][a] == parts[4][a]
            left = 0 if one else int((side[a:z] == 0).sum())
            if z - a < 2 or not one and left in (0, z - a):
                continue
            raw = np.frombuffer(b"".join(packed.slice(a, z - a).to_pylist()), np.uint8).reshape(z - a, -1)
            near = near_pairs(np.unpackbits(raw, axis=1, count=bits * tables), left, int(parts[0][a]), bits, most)
            if near.any():
                yield a, z, left, near

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_groups(batches, keys):
            keep = np.zeros(b.num_rows, bool)
            for a, z, _, near in blocks(b):
                keep[a:z] = near.any(axis=1)
            yield b.filter(pa.array(keep))

    shape = "t int, bucket long, dims int, lo long, hi long, side int, node long, signs binary"
    close = met.repartition(*keys).sortWithinPartitions(*keys, "side", "node").mapInArrow(screen, shape)
    cut = stash(close, "near-signs").join(classes.select("node", "n", "v"), "node").repartition(*keys).sortWithinPartitions(*keys, "side", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_groups(batches, keys):
            node, n, dims = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("node", "n", "dims"))
            vectors_ = b.column(b.schema.get_field_index("v"))
            out: list[list[np.ndarray]] = [[], [], []]
            for a, z, _, near in blocks(b):
                x = matrix(vectors_.slice(a, z - a), int(dims[a]))
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                linked = near & (x @ x.T >= threshold)
                links = linked @ n[a:z]
                at = np.flatnonzero(links)
                root = local_components(linked)
                for o, y in zip(out, (node[a:z][at], links[at], node[a:z][root[at]]), strict=True):
                    o.append(y)
            if out[0]:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(o), pa.int64()) for k, o in zip(("src", "links", "dst"), out, strict=True)})

    found = stash(cut.select(*keys, "side", "signs", "node", "n", "v").mapInArrow(link, "src long, links long, dst long"), "vector-links")
    component = distributed_components(found)
    links = found.groupBy("src").agg(F.sum("links").alias("links"))
    known = classes.select("k1", "k2", "node", "head", "n").join(links, F.col("node") == F.col("src"), "left").join(component, "node", "left")
    known = stash(known.select("k1", "k2", F.coalesce("component", "node").alias("component"), "head", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-components")
    least = known.groupBy("component").agg(F.min("head").alias("component_id"))
    known = known.join(least, "component").select("k1", "k2", "component_id", "n_links", F.lit(True).alias("known"))
    out = base.select("vec_id", "k1", "k2", F.col("v").isNotNull().alias("known")).join(known, ["k1", "k2", "known"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
with recursive x as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
n as (select r, v, sqrt(list_dot_product(v, v)) as norm from x
  where v is not null and len(v) > 0
    and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (select a.r as src, b.r as dst from n a, n b
  where a.r <> b.r and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) >= 0.95 * a.norm * b.norm),
reach(src, dst) as (select src, dst from links union select r.src, l.dst from reach r join links l on r.dst = l.src),
low as (select src, min(vec_id) as low from reach join x on x.r = dst group by src),
deg as (select src, count(*) as n from links group by src)
select x.vec_id, coalesce(deg.n, 0) as n_links, least(x.vec_id, low.low) as component_id, least(x.vec_id, low.low) is not distinct from x.vec_id as kept
from x left join deg on deg.src = x.r left join low on low.src = x.r
"""
