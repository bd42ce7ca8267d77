"""Pairs of two tables that agree in a key, met in blocks of bounded size however many rows share the key.

The rows of each side are counted by key. A key with n left and m right rows is cut into ceil(n / rows) times ceil(m / rows) cells;
each row of a side is dealt to one part of its side and copied to the cells of that part, so every pair meets in exactly one cell and
all cells of a hot key hold about as many pairs. Keys that only one side has are dropped before anything is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.operators.sos import cut

LEFT_ROWS, RIGHT_ROWS = 512, 2048
#: Rows of a narrow table up to which it is broadcast.
SENT_ROWS = 200_000
#: The most partitions of cells.
CELLS = 2_000


def join_counted(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a narrow table, a row a key: it is counted, and sent to all tasks up to SENT_ROWS rows, else sorted and merged.

    Left to the planner, rows that an explode has multiplied pass for small, and the wide side can be sent.
    """
    right = cut(right)
    return left.join(F.broadcast(right) if right.limit(SENT_ROWS + 1).count() <= SENT_ROWS else right.hint("merge"), list(on), how)


def cells(left: DataFrame, right: DataFrame, on: Sequence[str], left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> DataFrame:
    """The key columns, n and m (rows of either side), _a and _b (parts of either side): one row for each key that both sides have."""
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    return count(left, "n").join(count(right, "m"), list(on)).withColumns({"_a": parts("n", left_rows), "_b": parts("m", right_rows)})


def dealt(left: DataFrame, right: DataFrame, on: Sequence[str], left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns _i and _j: rows that agree in the key, _i and _j are the pairs. Null keys meet nothing."""
    of = cut(cells(left, right, on, left_rows, right_rows).select(*on, "_a", "_b"))
    part = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c not in on]), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = join_counted(left, of, on).withColumn("_i", part(left, "_a")).withColumn("_j", every("_b"))
    y = join_counted(right, of, on).withColumn("_j", part(right, "_b")).withColumn("_i", every("_a"))
    return x.drop("_a", "_b"), y.drop("_a", "_b")


def ranged_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> DataFrame:
    """The inner join on ``on``, a hot key's pairs dealt evenly."""
    x, y = dealt(left, right, on, left_rows, right_rows)
    return x.join(y.hint("merge"), [*on, "_i", "_j"]).drop("_i", "_j")


def solved(left: DataFrame, right: DataFrame, on: Sequence[str], solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS) -> DataFrame:
    """What ``solve`` makes of the rows of each cell; a cell holds about ``left_rows`` by ``right_rows`` rows at most."""
    x, y = dealt(left, right, on, left_rows, right_rows)
    keys = [*on, "_i", "_j"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(solve, schema)


def crossed(left: DataFrame, right: DataFrame, solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rows: int = 4096) -> DataFrame:
    """What ``solve`` makes of all pairs, in cells of about ``rows`` by ``rows`` rows; a row is copied once for each part of the other side.

    Cells take long for their bytes, so they are dealt over as many partitions (up to CELLS), which are not merged by size.
    """
    left, right = cut(left), cut(right)
    a, b = (max(1, -(-df.count() // rows)) for df in (left, right))
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = left.withColumn("_i", part(left, a)).withColumn("_j", every(b))
    y = right.withColumn("_j", part(right, b)).withColumn("_i", every(a))
    x, y = (df.repartition(min(a * b, CELLS), "_i", "_j").groupBy("_i", "_j") for df in (x, y))
    return x.cogroup(y).applyInPandas(solve, schema)
