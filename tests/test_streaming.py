"""The alias sync with a state a key, and sinks keyed by run."""

import os
import time

import pytest
from pyspark.sql import functions as F

from pitchlake.sources import sinks
from pitchlake.streaming import aliases

SHAPE = "alias_name string, canonical_team_name string, confidence double, source string, batch int"


def resolve(df):
    known = F.when(~F.col("name").startswith("zz"), F.upper("name"))
    return df.select("name", known.alias("canonical"), F.lit(0.9).alias("confidence"), F.lit("t").alias("source"))


def feed(spark, path, names):
    spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("append").parquet(path)


def test_the_state_gives_the_table_of_the_batch_cascade(spark, tmp_path):
    table, plain, source = f"{tmp_path}/state", f"{tmp_path}/plain", f"{tmp_path}/in"
    start = spark.createDataFrame([("Known Team", "K", 1.0, "old", -1)], SHAPE)
    read = lambda path: start.union(spark.read.schema(SHAPE).parquet(path)) if os.path.isdir(path) else start
    for names in (["foxes", "owls", "known team", None], ["Owls", "hawks", "zz none"], ["KNOWN TEAM", "foxes", "bears", "zz none"]):
        feed(spark, source, names)
        stream = spark.readStream.schema("name string").parquet(source)
        before = spark.conf.get(aliases.STORE)
        aliases.sync_stateful(stream, start, resolve, table, f"{tmp_path}/cp").awaitTermination()  # every round restarts the query
        assert spark.conf.get(aliases.STORE) == before
        aliases.sync(stream.where("name is not null"), lambda: read(plain), resolve, plain, f"{tmp_path}/cp-plain").awaitTermination()
    rows = lambda path: sorted((r.alias_name.lower(), r.canonical_team_name) for r in spark.read.schema(SHAPE).parquet(path).collect())
    assert rows(table) == rows(plain) == [("bears", "BEARS"), ("foxes", "FOXES"), ("hawks", "HAWKS"), ("owls", "OWLS")]


def test_a_key_expires(spark, tmp_path):
    source, seen = f"{tmp_path}/in", []
    for wait, names in ((0, ["zz a", "b"]), (3, ["zz a"])):
        time.sleep(wait)
        feed(spark, source, names)
        spark.conf.set(aliases.STORE, aliases.ROCKS)
        stream = aliases.first_names(spark.readStream.schema("name string").parquet(source), spark.createDataFrame([], SHAPE), 2000)
        stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.name for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start().awaitTermination(60)
        spark.conf.unset(aliases.STORE)
    assert [s for s in seen if s] == [["b", "zz a"], ["zz a"]]


def test_a_run_is_there_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "alias_name string")
    held = lambda: sorted((r.run, r.alias_name) for r in spark.read.parquet(path).collect())
    sinks.append_aliases(frame("ab"), path, f"{tmp_path}/log", "r1")
    sinks.append_aliases(frame("c"), path, f"{tmp_path}/log", "r2")
    sinks.append_aliases(frame("abd"), path, f"{tmp_path}/log", "r1")
    assert held() == [("r1", "a"), ("r1", "b"), ("r1", "d"), ("r2", "c")] and spark.read.parquet(f"{tmp_path}/log").count() == 4
    bad = frame("xyz").repartition(3).select(F.when(F.col("alias_name") == "z", F.raise_error(F.lit("lost"))).otherwise(F.col("alias_name")).alias("alias_name"))
    with pytest.raises(Exception, match="lost"):
        sinks.append_aliases(bad, path, f"{tmp_path}/log", "r1")
    assert held() == [("r1", "a"), ("r1", "b"), ("r1", "d"), ("r2", "c")]
    sinks.write_run(frame("q"), f"{tmp_path}/csv", "r1", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().alias_name == "q"
