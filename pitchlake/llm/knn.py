"""Exact top-k by inner product as a Voronoi join (after Lu et al. 2012, "Efficient processing of k nearest neighbor joins").

1. Pivots, rows with the smallest id hashes, cut the space into Voronoi cells; their number grows with the root of the
   rows up to a bound. Queries and data go to the cell of their nearest pivot.
2. Summaries: of each data cell its radius and the k + 1 ids nearest to its pivot, an id at its nearest row; of each
   query cell its radius, its largest norm and the least score with which its queries reach k pivots of other ids. With
   q = p + d and x = c + e, p and c pivots, the product q.x is at least p.c - |d| |c| - |q| |e|. With one bound an id, its
   largest, the (k + 1)-th largest is a score that every query of the cell reaches with k ids other than its own, however
   often an id is repeated. The larger of the two bounds counts.
3. Neighbouring query cells are put into groups of a few thousand queries, large cells cut into several. A row is sent to a
   group, once, only if for one of its cells p.x + |d| |x|, the most that any query of the cell can score with it, reaches
   that cell's bound; whole cells are tested first, with their radius. No row is left out by a guess.
4. Each (group, block of rows) is solved by matrix products; the best k of each block meet in a ranked window per query row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from pitchlake.llm.common import stash, table
from pitchlake.llm.embeddings import finite, matrix

BLOCK_BYTES = 32 << 20  # of the rows of a block, as doubles
QUERIES_A_GROUP = 4096
LEAST_PIVOTS, MOST_PIVOTS = 16, 512
LONG = (1 << 63) - 1


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    d2 = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None, :]
    cell = d2.argmin(axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while every partial sum is exact, else in Python integers, held to a long."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
    return np.array([[max(-LONG - 1, min(LONG, s)) for s in row] for row in whole(q) @ whole(x).T], dtype=np.int64).reshape(len(q), len(x))


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k largest scores of a row with other ids than ``own``, ties to the smaller id."""
    other = np.flatnonzero(ids != own)
    if len(other) > k:
        least = np.partition(scores[other], len(other) - k)[len(other) - k]
        other = other[scores[other] >= least]
    return other[np.lexsort((ids[other], -scores[other]))][:k]


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: 32-bit integers where all components are such, else doubles."""
    small = (np.abs(x) < 2.0**31).all(axis=1) if x.shape[1] else np.ones(len(x), bool)
    return [(r.astype(np.int32) if s else r).tobytes() for r, s in zip(x, small, strict=True)]


def _unpacked(rows, dims: int) -> np.ndarray:
    """The matrix of ``_packed`` rows."""
    out = np.empty((len(rows), dims))
    small = np.fromiter((len(r) == 4 * dims for r in rows), bool, len(rows))
    for kind, at in ((np.int32, np.flatnonzero(small)), (np.float64, np.flatnonzero(~small))):
        if len(at):
            out[at] = np.frombuffer(b"".join([rows[i] for i in at]), kind).reshape(len(at), dims)
    return out


def _chain(pivots: np.ndarray) -> list[int]:
    """Pivots in an order that goes on to the nearest one that is left."""
    left, order = set(range(1, len(pivots))), [0]
    while left:
        at = np.array(sorted(left))
        order.append(int(at[((pivots[at] - pivots[order[-1]]) ** 2).sum(axis=1).argmin()]))
        left.remove(order[-1])
    return order


def query_groups(pivots: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each cell: cells along the chain share a group of up to ``most`` queries."""
    first, often = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    group, room = -1, 0
    for c in _chain(pivots):
        if n[c] > room:
            group, room = group + 1, most
        first[c], often[c] = group, max(1, -(-int(n[c]) // most))
        group, room = group + int(often[c]) - 1, room - int(n[c]) if often[c] == 1 else 0
    return first, often


def top_products(data: DataFrame, queries: DataFrame, k: int = 5, n_pivots: int | None = None, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query row its k best rows: query_id, rank (from 1), vec_id, score. Scores are inner products of floor(scale * x).

    Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; a
    shorter vector, the empty one included, counts as padded with zeros; a query is never paired with rows of its own id, so
    repeated rows of an id are candidates of other queries each; every query row of a repeated id gets its own k rows; ties
    go to the smaller id; fewer than k candidates give fewer rows; empty tables give an empty table; extra columns are
    ignored. Scores beyond a long are held to it.
    """
    spark = data.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v")).where(finite("v") & F.col("vec_id").isNotNull())
    rows, asks = clean(data), clean(queries)
    count = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    (n, dims), (n_queries, dims_q) = count(rows), count(asks)
    dims = max(1, dims, dims_q)
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_pivots = n_pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, n**0.5 / 2)))
    pad = F.slice(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v"))), 1, dims)
    rows, asks = rows.withColumn("v", pad), asks.withColumn("v", pad)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).toArrow()
    pivots, kept = np.unique(np.floor(scale * matrix(picked["v"].combine_chunks(), dims)), axis=0, return_index=True)
    pivot_ids = picked["vec_id"].to_numpy()[kept]
    sent = spark.sparkContext.broadcast((pivots, pivot_ids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cell, distance to its pivot, norm and packed vector; ``reached``: the score reached with k pivots of other ids."""
        p, p_ids = sent.value
        for b in batches:
            ids, x = b.column(0).to_numpy(), np.floor(scale * matrix(b.column(1), dims))
            cell, away = _nearest(x, p)
            scores = np.where(p_ids[None, :] == ids[:, None], -np.inf, x @ p.T)
            scores = scores[:, np.unique(p_ids, return_index=True)[1]]  # an id counts once
            reached = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), -np.inf)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "cell": pa.array(cell, pa.int64()), "away": pa.array(away), "norm": pa.array(np.sqrt((x * x).sum(axis=1))), "reached": pa.array(reached), "x": pa.array(_packed(x), pa.binary())})

    shape = "vec_id long, cell long, away double, norm double, reached double, x binary"
    placed = stash(rows.mapInArrow(place, shape), "knn-cells")
    asked = stash(asks.mapInArrow(place, shape).withColumn("ask", F.monotonically_increasing_id()), "knn-queries")
    by_cell = Window.partitionBy("cell").orderBy("away")
    once = placed.groupBy("cell", "vec_id").agg(F.min("away").alias("away"))
    nearest = once.withColumn("nth", F.row_number().over(by_cell)).where(F.col("nth") <= k + 1).select("cell", "vec_id", "away").toPandas()
    radius = placed.groupBy("cell").agg(F.max("away").alias("radius")).toPandas()
    groups = asked.groupBy("cell").agg(F.max("away").alias("reach"), F.max("norm").alias("norm"), F.count("*").alias("n"), F.min("reached").alias("reached")).toPandas()

    centre, slack = np.sqrt((pivots * pivots).sum(axis=1)), 1e-6
    bound = np.full(len(pivots), np.inf)  # cells without queries are closed
    for g in groups.itertuples():
        least = pd.Series(pivots[g.cell] @ pivots[nearest.cell].T - g.reach * centre[nearest.cell] - g.norm * nearest.away.to_numpy())
        least = least.groupby(nearest.vec_id).max().to_numpy()
        bound[g.cell] = max(np.sort(least)[::-1][k] if len(least) > k else -np.inf, g.reached)
    reach, most, wide, asking = (np.zeros(len(pivots)) for _ in range(4))
    reach[groups.cell], most[groups.cell], asking[groups.cell], wide[radius.cell] = groups.reach, groups.norm, groups.n, radius.radius
    bound = np.where(np.isfinite(bound), bound - slack * (1 + np.abs(np.nan_to_num(bound))), bound)
    open_cells = pivots @ pivots.T + reach[:, None] * centre[None, :] + most[:, None] * wide[None, :] >= bound[:, None]  # query cell, data cell
    open_cells &= asking[:, None] > 0
    row_blocks = -(-n // max(1024, BLOCK_BYTES // (8 * dims)))
    first_group, cell_groups = query_groups(pivots, asking, QUERIES_A_GROUP)
    plan = spark.sparkContext.broadcast((pivots, bound, reach, open_cells, first_group, cell_groups))

    def emit(ids: np.ndarray, group: np.ndarray, block: np.ndarray, asks_: np.ndarray, x: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "grp": pa.array(group, pa.int64()), "block": pa.array(block, pa.int64()), "ask": pa.array(asks_, pa.int64()), "x": pa.array(x, pa.binary())})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, low, far, cells, first, often = plan.value
        n_groups = int((first + often).max())
        member = np.zeros((len(p), n_groups), np.float32)
        for c in range(len(p)):
            member[c, first[c] : first[c] + often[c]] = 1
        seen = TaskContext.get().partitionId() * 7919  # deals the task's rows over the blocks, those of one id too
        for b in batches:
            ids, own, packed = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            x = _unpacked(packed, dims)
            top = x @ p.T + np.sqrt((x * x).sum(axis=1))[:, None] * far[None, :]
            at, group = np.nonzero(((top >= low[None, :]) & cells[:, own].T).astype(np.float32) @ member > 0)
            block = (seen + np.arange(len(ids))) % row_blocks
            seen += len(ids)
            for s in range(0, len(at), 20_000):
                w = at[s : s + 20_000]
                yield emit(ids[w], group[s : s + 20_000], block[w], np.zeros(len(w), np.int64), [packed[i] for i in w])

    def ask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, _, first, often = plan.value
        for b in batches:
            ids, cell, packed, ask = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_numpy()
            group = first[cell] + (ask.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)).astype(np.int64) % often[cell]
            for block in range(row_blocks):
                yield emit(ids, group, np.full(len(ids), block), ask, packed)

    shape, keys = "vec_id long, grp long, block long, ask long, x binary", ["grp", "block"]
    left = asked.select("vec_id", "cell", "x", "ask").mapInArrow(ask_all, shape).groupBy(*keys)
    right = placed.select("vec_id", "cell", "x").mapInArrow(send, shape).groupBy(*keys)

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(x):
            ids, data_ = x.vec_id.to_numpy(), _unpacked(x.x.tolist(), dims)
            for s in range(0, len(q), 64):
                part = q.iloc[s : s + 64]
                scores = exact_scores(_unpacked(part.x.tolist(), dims), data_)
                for ask, qid, row in zip(part.ask.tolist(), part.vec_id.tolist(), scores, strict=True):
                    best = _best(row, ids, qid, k)
                    out += [(ask, qid, int(ids[i]), int(row[i])) for i in best]
        return pd.DataFrame(out, columns=["ask", "query_id", "vec_id", "score"]).astype("int64")

    found = left.cogroup(right).applyInPandas(solve, "ask long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_products(rows, rows.where(F.col("vec_id") % 50 == 0))


OP4_SQL = """
with e as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select r, vec_id, list_resize(v, (select greatest(1, max(len(v))) from e), 0.0::double) as v from e),
s as (
  select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from p q join p c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
k as (select *, row_number() over (partition by r order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from k where rank <= 5
"""
