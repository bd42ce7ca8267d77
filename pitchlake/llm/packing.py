"""Best-fit packing of token sequences by the configuration linear program of bin packing.

The histogram of piece lengths (at most ``capacity`` cells, whatever the number of documents) goes to the driver. The
program "cover every length with patterns that fit a sequence, using as few as possible" is solved by multiplicative
weights on the lengths; the pricing step, the pattern of the largest total weight, is an unbounded knapsack solved by
dynamic programming. Every round's weights are a solution of the dual, so they bound the number of sequences from below;
patterns whose price under the best of them falls short of a sequence's are not used. The fractional solution is rounded
down, the rest is a smaller program, and what is left in the end is packed best fit decreasing, equal sequences at once:
the plan has a few entries a length, not a piece. Pieces are numbered within their length in parallel and look up their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from pitchlake.llm.common import stash, table
from pitchlake.llm.tokens import PieceTokenizer

CAPACITY = 2048
END_ID = 0


@cache
def _tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def price_patterns(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of the best pattern for each room, the length it takes first or 0, index of each length), by unbounded knapsack."""
    worth, index = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth[lengths], index[lengths] = value, np.arange(len(lengths))
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = worth[1 : c + 1] + best[c - 1 :: -1][:c]
        i = int(gain.argmax())
        if gain[i] > best[c - 1] + 1e-15:
            best[c], take[c] = gain[i], i + 1
        else:
            best[c] = best[c - 1]
    return best, take, index


def pattern(first: int, take: np.ndarray, index: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """{number of a length: how often} of the best pattern that holds length number ``first``."""
    counts, c = {first: 1}, capacity - int(lengths[first])
    while c > 0:
        size = int(take[c])
        if size:
            counts[int(index[size])] = counts.get(int(index[size]), 0) + 1
        c -= size or 1
    return counts


def dual_prices(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """(prices, bound): the best of the step functions floor((k + 1) x) / k of x = length / capacity (Fekete and Schepers 2001), and of x itself."""
    x = lengths / capacity
    tried = [x, *(np.where((k + 1) * lengths % capacity == 0, x, (k + 1) * lengths // capacity / k) for k in range(1, 21))]
    return max(((p, float((p * demand).sum())) for p in tried), key=lambda t: t[1])


def solve_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 30, step: float = 0.35, near: float = 0.02) -> tuple[list[tuple[dict[int, int], float]], np.ndarray, float]:
    """(patterns and how often each is used, dual prices, lower bound): a fractional cover of ``demand``, by multiplicative weights on the lengths.

    One pricing gives the best pattern that holds each length; those within ``near`` of the best are used together.
    Prices are such that no pattern is worth more than 1, so the worth of all pieces bounds the number of sequences.
    """
    prices, bound = dual_prices(lengths, demand, capacity)
    weight = np.maximum(prices, 0.05 * lengths / capacity) * demand
    found: dict[tuple, list] = {}
    covered = np.zeros(len(lengths))
    for _ in range(rounds):
        value = weight / demand
        best, take, index = price_patterns(value, lengths, capacity)
        if weight.sum() / best[-1] > bound:
            prices, bound = value / best[-1], float(weight.sum() / best[-1])
        with_it = value + best[capacity - lengths]
        fresh = np.zeros(len(lengths))
        for i in np.argsort(-with_it, kind="stable"):
            if with_it[i] < (1 - near) * best[-1]:
                break
            if fresh[i]:
                continue
            counts = pattern(int(i), take, index, lengths, capacity)
            at, n = np.fromiter(counts, np.int64), np.fromiter(counts.values(), np.int64)
            if (n > demand[at]).any():
                n = np.minimum(n, demand[at]).astype(np.int64)
                counts = dict(zip(at.tolist(), n.tolist(), strict=True))
            times = step * float((demand[at] / n).min())  # the width of a step: no length is covered at once
            found.setdefault(tuple(sorted(counts.items())), [counts, 0.0])[1] += times
            fresh[at] += n * times
        covered += fresh
        weight = weight * np.exp(-step * fresh / demand)
        weight /= (weight / demand).max()
    scale = float(np.max(demand / covered)) if (covered > 0).all() else 1.0
    return [(p, x * min(scale, 1.0)) for p, x in found.values()], prices, bound


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing of ``left`` pieces of each length, all sequences with the same room at once.

    A piece goes to the sequence with the least room that holds it; the next of its length goes on there while it fits. A
    length splits at most one kind of sequence and adds two, so the number of kinds follows the lengths, not the pieces.
    """
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def put(count: int, items: dict[int, int], room: int, size: int, often: int) -> None:
        if count:
            by_room.setdefault(room - size * often, []).append((count, items | {size: often} if often else items))

    for i in np.argsort(-lengths, kind="stable"):
        size, n = int(lengths[i]), int(left[i])
        for room in [r for r in sorted(by_room) if r >= size]:
            often = room // size
            for count, items in by_room.pop(room) if n else []:
                full = min(count, n // often)
                some = 1 if full < count and n > full * often else 0
                rest = n - full * often if some else 0
                put(full, items, room, size, often)
                put(some, items, room, size, rest)
                put(count - full - some, items, room, size, 0)
                n -= full * often + rest
        often = capacity // size
        put(n // often, {}, capacity, size, often)
        put(1 if n % often else 0, {}, capacity, size, n % often)
    return [(count, sorted(items.items())) for kinds in by_room.values() for count, items in kinds]


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, loose: float = 0.01, passes: int = 4) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of sequences, [(length, how often)])] that hold every piece of the histogram once.

    A pattern is used if its pieces are worth 1 - ``loose`` or more at the prices of the program, the dearest first; fractions
    of patterns that are rounded off are carried on to the next. The rest of a rounded cover is a smaller program, up to
    ``passes`` times; the rest after the pass from which the fewest sequences follow is packed best fit. The rest before
    the first pass is everything: where best fit alone reaches the bound, as on lengths that are all there, no cover is better.
    """
    left = demand.astype(np.int64).copy()
    used_up: list[tuple[int, list[tuple[int, int]]]] = []
    made = best_fit(lengths, left, capacity)
    for _ in range(passes):
        open_ = np.flatnonzero(left)
        if not open_.size:
            break
        before, carry = left.sum(), 0.0
        patterns, prices, _ = solve_program(lengths[open_], left[open_].astype(float), capacity)
        worth = [sum(prices[i] * n for i, n in p.items()) for p, _ in patterns]
        for k in sorted(range(len(patterns)), key=lambda k: (-worth[k], -patterns[k][1])):
            if worth[k] < 1 - loose:
                break
            counts, times = patterns[k]
            used, each = open_[np.fromiter(counts, np.int64)], np.fromiter(counts.values(), np.int64)
            whole = int(min(np.floor(times + carry), (left[used] // each).min()))
            carry = min(1.0, times + carry - whole)
            if whole > 0:
                left[used] -= each * whole
                used_up.append((whole, list(zip(lengths[used].tolist(), each.tolist(), strict=True))))
        now = used_up + best_fit(lengths, left, capacity)
        if sum(n for n, _ in now) < sum(n for n, _ in made):
            made = now
        if left.sum() > 0.7 * before:
            break
    return made


def tokenized(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, and the task and the number of the piece among equals of the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1)), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                start, piece, stop = 0, 0, (len(ids) - 1) % capacity + 1
                while start < len(ids):
                    n = stop - start
                    rows.append((doc, piece, start, n, zlib.crc32(ids[start:stop]), part, int(seen[n])))
                    seen[n] += 1
                    start, piece, stop = stop, piece + 1, stop + capacity
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([*c] for c in zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in names}, schema=schema)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    schema = pa.schema([(k, pa.int32() if k in ("piece", "part") else pa.int64()) for k in names])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of the tokenizer file, special strings in the text included, and one END_ID. Documents
    longer than ``capacity`` are cut into pieces of ``capacity`` ids, the first of which may be shorter.

    Defined cases: a null or empty text is END_ID alone; a null doc_id is kept; rows that repeat a doc_id are packed each;
    an empty table gives an empty table; extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stash(tokenized(docs, path or vocabulary(), capacity), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths = np.array(sorted(histogram), np.int64)
    starts: dict[int, list[tuple[int, int, int, int]]] = {}  # length: (first number, first sequence, how often in one, offset)
    used = dict.fromkeys(histogram, 0)
    sequence = 0
    for times, items in plan(lengths, np.array([histogram[k] for k in lengths.tolist()]), capacity) if len(lengths) else []:
        offset = 0
        for size, often in items:
            starts.setdefault(size, []).append((used[size], sequence, often, offset))
            used[size] += times * often
            offset += size * often
        sequence += times
    places = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in starts.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, number = (b.column(b.schema.get_field_index(k)).to_numpy() for k in ("length", "number"))
            sequence_id, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(size[order]) != 0)) if len(size) else []
            for a, z in zip(cuts, [*cuts[1:], len(size)], strict=True):
                at = order[a:z]
                p = places.value[int(size[at[0]])]
                q = p[np.searchsorted(p[:, 0], number[at], "right") - 1]
                k = number[at] - q[:, 0]
                sequence_id[at], offset[at] = q[:, 1] + k // q[:, 2], q[:, 3] + k % q[:, 2] * size[at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(sequence_id), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
