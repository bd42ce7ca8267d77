"""Quantiles by counted bins against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import quantiles as Q

SHARES = [0.0, 0.05, 0.5, 0.95, 1.0]


def held(df):
    return {tuple(r[c] for c in df.columns[:-1]): r.value for r in df.collect()}


def test_groups_and_columns(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, "one"]) if i else "single", rng.choice([None, float("nan"), 0.0, -1.5, 1e-300, 1e300, rng.gauss(0, 1), rng.gauss(0, 1) * 1e-9]), rng.randint(0, 3)) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, x double, k int").repartition(6)
    got = held(Q.quantiles(df.where("g is not null"), ["x", "k"], SHARES, ["g"], bins=7))
    want = {}
    for g in {r[0] for r in rows} - {None}:
        for c, at in (("x", 1), ("k", 2)):
            v = [float(r[at]) for r in rows if r[0] == g and r[at] is not None and not math.isnan(r[at])]
            want |= {(g, c, s): np.quantile(v, s) for s in SHARES} if v else {}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-300) for k in want)


def test_extremes(spark):
    v = [float("-inf"), -1.7e308, -1.0, -0.0, 5e-324, 1.0, 1.7e308, float("inf")]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = held(Q.quantiles(df, ["x"], [i / 7 for i in range(8)]))
    assert [got["x", i / 7] for i in range(8)] == v
    assert Q.quantiles(df.limit(0), ["x"], [0.5]).count() == 0
    same = spark.createDataFrame([(2.5,)] * 50, "x double")
    assert set(held(Q.quantiles(same, ["x"], SHARES)).values()) == {2.5}
    row = Q.quantile_row(df.limit(0), {"a": ("x", 0.5)}).first()
    assert row.a is None


def test_a_million_distinct_values(spark):
    """Bins that are shuffled do not follow the rows."""
    df = spark.range(1_000_000).select(F.pow(F.lit(1.00002), F.col("id") % 999_983).alias("x"), (F.xxhash64("id") % 1000).alias("h"))
    got = held(Q.quantiles(df, ["x", "h"], [0.05, 0.37, 0.95]))
    pdf = df.toPandas()
    for c in ("x", "h"):
        for s in (0.05, 0.37, 0.95):
            assert got[c, s] == pytest.approx(np.quantile(pdf[c].astype(float), s), rel=1e-12)


def test_both_ways_of_a_percentile_agree(spark, monkeypatch):
    from pitchlake.functions import scores as S

    df = spark.createDataFrame([(i, float((i * 37) % 101) if i % 7 else None) for i in range(300)], "team long, v double")
    want = [S.robust_scale(df, {"y": "v"}), S.robust_minmax(df, {"y": "v"})]
    want = [sorted(map(tuple, d.collect())) for d in want]
    monkeypatch.setattr(S, "HELD_VALUES", 10)
    for made, rows in zip((S.robust_scale, S.robust_minmax), want, strict=True):
        for a, b in zip(sorted(map(tuple, made(df, {"y": "v"}).collect())), rows, strict=True):
            assert a[:2] == b[:2] and (a[2] == b[2] or a[2] == pytest.approx(b[2], abs=1e-12))
