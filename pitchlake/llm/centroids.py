"""Centroid clustering on integer vectors, assignments pruned by Ptolemy's inequality.

For four points, d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|. With fixed pairs of pivots (p, s) this bounds the distance
of a vector x to a centroid c from below by distances to pivots: those of a vector never change and are cached beside it, those of
the few centroids are taken once a round. A vector is compared with the centroid whose bound is least, and then only with centroids
whose bound does not exceed the distance found.

Everything that decides is exact: components are integers, squared distances 64-bit integers, cached too as squared integers. Bounds are
doubles, rounded down by more than their error, so a pruned centroid is truly farther. Pivots are ``PIVOTS`` vectors chosen far from each
other among the ``PIVOT_SAMPLE`` with the smallest hashes; they only decide how much is pruned, never the result.

A round is one pass over the cached table; a task sends sums and a count for each cluster, so a cluster of any size meets as a few rows.

Defined cases: vectors that are null, of another length than ``dims``, or with null or non-finite components, or with one whose
integer exceeds 2^26 (its squared distances need not fit in 64 bits), take no part and are not returned. Fewer than ``k``
vectors: each starts a centroid. Rows that repeat an id are vectors each; where starting hashes tie, the smaller vector
comes first; a null id is clustered and starts a centroid only after all others. Of equal distances the smaller centroid wins. An
empty centroid stays. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import stash, table

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
PIVOTS, PIVOT_SAMPLE = 6, 256
LARGEST = 1 << 26
#: More than the relative error of a bound: two roots, two products, a difference and a quotient in doubles.
SLACK = 32 * 2.0**-53


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>): floor(scale * x) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = F.forall(x, lambda c: F.abs(F.floor(c * scale).cast("double")).between(0, LARGEST))
    return vectors.where((F.size("embedding") == dims) & whole & fits).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def start_hash(seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` (n x d) and ``b`` (m x d); one column of b at a time."""
    out = np.empty((len(a), len(b)), np.int64)
    for j, c in enumerate(b):
        d = a - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` distinct vectors, each the farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    near = squared(sample, sample[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def ptolemaic(to_pivots: np.ndarray, centroid_pivots: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of vectors (rows) to centroids (columns), rounded down. All arguments are squared distances.

    to_pivots: vectors by pivots; centroid_pivots: centroids by pivots; between: pivots by pivots.
    """
    x, c, p = (np.sqrt(m.astype(np.float64)) for m in (to_pivots, centroid_pivots, between))
    best = np.zeros((len(x), len(c)))
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            if between[i, j]:
                one, two = x[:, i, None] * c[None, :, j], x[:, j, None] * c[None, :, i]
                np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / p[i, j] * (1 - SLACK), out=best)
    return best


def assign(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each vector, and how many distances were computed."""
    bound = ptolemaic(to_pivots, centroid_pivots, between)
    near = bound.argmin(axis=1)
    d = v - centroids[near]
    best = np.einsum("ij,ij->i", d, d)
    open_ = bound * bound * (1 - SLACK) <= (best.astype(np.float64) * (1 + SLACK))[:, None]
    open_[np.arange(len(v)), near] = False
    done = len(v)
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        rows = rows[bound[rows, c] ** 2 * (1 - SLACK) <= best[rows].astype(np.float64) * (1 + SLACK)]  # by what is known by now
        d = v[rows] - centroids[c]
        found = np.einsum("ij,ij->i", d, d)
        better = (found < best[rows]) | ((found == best[rows]) & (c < near[rows]))
        near[rows[better]], best[rows[better]] = c, found[better]
        done += len(rows)
    return near, best, done


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class Clustering:
    """Vectors with their cached pivot distances, and centroids that move by rounds."""

    def __init__(self, vectors: DataFrame, k: int = K, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> None:
        whole = stash(integers(vectors, dims, scale), "integer-vectors")
        first = whole.withColumn("h", start_hash(seed)).orderBy(F.asc_nulls_last("h"), "v").limit(max(k, sample)).collect()
        points = np.array([r.v for r in first], np.int64).reshape(-1, dims)
        self.dims, self.centroids, self.pivots = dims, points[:k].copy(), far_apart(points[:sample], pivots)
        self.between = squared(self.pivots, self.pivots)
        pivot = self.pivots

        def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches):
                near = squared(_matrix(b.column(1), dims), pivot)
                of = pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1], pa.array(near.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), of], names=["vec_id", "v", "to_pivots"])

        id_type = whole.schema["vec_id"].dataType.simpleString()
        self.cached = stash(whole.mapInArrow(cache, f"vec_id {id_type}, v array<int>, to_pivots array<bigint>"), "pivot-distances") if len(first) else whole
        self.id_type = id_type

    def _solver(self):
        centroids, between, dims, width = self.centroids, self.between, self.dims, len(self.pivots)
        centroid_pivots = squared(centroids, self.pivots)

        def solve(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
            v = _matrix(b.column(1), dims)
            return v, *assign(v, _matrix(b.column(2), width), centroids, centroid_pivots, between)

        return solve

    def move(self) -> None:
        """One round: assign all vectors, then put every centroid that has some at the floor of their mean."""
        solve, k, dims = self._solver(), len(self.centroids), self.dims

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
            for b in _pieces(batches):
                v, near, _, _ = solve(b)
                for c in np.unique(near):
                    total[c] += v[near == c].sum(axis=0)
                count += np.bincount(near, minlength=k)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dims)), pa.array(np.tile(np.arange(dims), len(used))), pa.array(total[used].reshape(-1)), pa.array(np.repeat(count[used], dims))], names=["c", "at", "s", "n"])

        wide = F.sum(F.col("s").cast("decimal(38,0)"))
        for r in self.cached.mapInArrow(sums, "c long, at long, s long, n long").groupBy("c", "at").agg(wide.alias("s"), F.sum("n").alias("n")).collect():  # k x dims rows
            self.centroids[r.c, r.at] = int(r.s) // r.n

    def assigned(self) -> DataFrame:
        """vec_id, cluster, distance."""
        solve = self._solver()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches):
                _, near, best, _ = solve(b)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

        return self.cached.mapInArrow(run, f"vec_id {self.id_type}, cluster int, distance long")

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 after ``rounds`` rounds and one more assignment."""
    found = Clustering(vectors, k, dims, scale, seed)
    if not len(found.centroids):
        return found.cached.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        found.move()
    last = stash(found.assigned(), "assigned")
    sums = {r.cluster: int(r.d) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)
    return last.withColumns({
        "cluster_inertia": of([sums.get(i, 0) for i in range(len(found.centroids))]).cast("long"), "inertia": F.lit(sum(sums.values())).cast("long"), "centroid_sha256": of(found.digests()),
    })


def op11_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all ``embeddings`` of 64 components after ten rounds. Cases: those of this module."""
    return clusters(table(spark, sf_dir, "embeddings"))


_ROUND = """, a{k} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d from (select x.r, m.c, list_sum(list_transform(list_zip(x.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from x, m{k} m) group by r),
u{k} as (select c, list(f order by i) as v from (select c, i, ((s - ((s % n) + n) % n) // n)::bigint as f from (select c, i, sum(e)::hugeint as s, count(*)::hugeint as n from (select c, unnest(v) as e, generate_subscripts(v, 1) as i from x join a{k} using (r)) group by all)) group by c),
m{n} as materialized (select m.c, coalesce(u.v, m.v) as v from m{k} m left join u{k} u on u.c = m.c)"""
OP11_SQL = (
    f"""with e as (select vec_id, list_transform(embedding, lambda c: c::double) as x from embeddings where len(embedding) = {DIMS}),
x as materialized (select row_number() over () as r, vec_id, list_transform(x, lambda c: floor({SCALE} * c)::bigint) as v from e
  where coalesce(list_bool_and(list_transform(x, lambda c: c is not null and isfinite(c) and abs(floor({SCALE} * c)) <= {LARGEST})), false)),
m0 as materialized (select c, v from (select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, v) - 1 as c, v from x) where c < {K})"""
    + "".join(_ROUND.format(k=k, n=k + 1) for k in range(ROUNDS))
    + f""", z as (select r, arg_min(c, (d, c)) as c, min(d) as d from (select x.r, m.c, list_sum(list_transform(list_zip(x.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from x, m{ROUNDS} m) group by r)
select vec_id, z.c::int as cluster, d::bigint as distance, (sum(d) over (partition by z.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(m.v, ',')) as centroid_sha256 from z join x using (r) join m{ROUNDS} m on m.c = z.c"""
)
