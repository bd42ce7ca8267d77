"""Budgets that end among rows that repeat an id, a text or both."""

import pytest
from pyspark.sql import functions as F

from pitchlake.llm import mixing


def held(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, source string, copies string, target double").repartition(5)
    return docs, mixing.mix(docs).withColumn("taken", F.col("copies") * F.col("size")).collect()


@pytest.mark.parametrize("kind", ["one id", "null id", "equal rows", "own ids"])
def test_targets_are_met(spark, kind):
    def row(i):
        text = "same words in all of these ten rows of text" if kind == "equal rows" else " ".join([f"w{i}", *"abcdefghi"])
        return ({"one id": 5, "null id": None, "equal rows": 5, "own ids": i}[kind], text, "hot")

    rows = [row(i) for i in range(200)] + [(1000 + i, "one two three four", s) for i in range(60) for s in ("other", None)]
    docs, got = held(spark, rows)
    for source in ("hot", "other", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1e-6
        assert all(r.taken <= 2 * r.size and r.source_size == sum(x.size for x in mine) for r in mine)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id or -1, r.text, str(r.source), r.copies)
    assert sorted(map(key, again)) == sorted(map(key, got)) and len(got) == len(rows)
    assert mixing.repeat_rows(docs).count() == sum(r.copies for r in got)


def test_empty_texts_and_ties(spark):
    _, got = held(spark, [(i % 3, t, s) for i in range(30) for t, s in (("", "a"), (None, "a"), ("x y", "b"), ("x y", "c"))])
    assert all(r.size == 0 and r.target == 0 for r in got if r.source == "a")
    for s in "bc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
