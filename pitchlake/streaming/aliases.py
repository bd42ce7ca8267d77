"""Incremental alias sync and trailing activity over streams: an extension, the batch operators in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pitchlake.functions.names import team_name


def new_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names whose key is not in the alias table: a stream-static anti-join when ``names`` is a stream."""
    known = aliases.select(team_name("alias_name").alias("key")).distinct()
    return names.withColumn("key", team_name("name")).join(known, "key", "left_anti")


def sync(names: DataFrame, read_aliases: Callable[[], DataFrame], resolve: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Resolve the new names of each micro-batch against the table as it is then, and write what was found to the table's folder of the batch.

    Rows are those of the alias table: alias_name, canonical_team_name, confidence, source, and the number of the batch; of new
    names with one key a batch takes the first. A batch
    that runs again after a failure replaces its own folder: it neither appends twice nor counts its own rows as known.
    """

    def batch(df: DataFrame, number: int) -> None:
        known = read_aliases()
        if "batch" in known.columns:
            known = known.where(F.col("batch") != number)
        fresh = new_names(df.select("name").distinct(), known).groupBy("key").agg(F.min("name").alias("name"))
        found = resolve(fresh.select("name")).where("canonical is not null")
        rows = found.select(F.col("name").alias("alias_name"), F.col("canonical").alias("canonical_team_name"), "confidence", "source")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FirstOfKey(StatefulProcessor):
    """Hands on the least name of a key once: when the key is first seen, and again when its state has expired."""

    def __init__(self, expire_ms: int | None = None) -> None:
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "name string", self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [df["name"].min() for df in rows]
        if names and not self.seen.exists():
            self.seen.update((min(names),))
            yield pd.DataFrame({"key": [key[0]], "name": [min(names)]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((initialState["name"].iloc[0],))

    def close(self) -> None:
        pass


#: The state of single keys needs this store.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_names(names: DataFrame, aliases: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """(key, name) of a stream's names whose key is neither in ``aliases`` nor was seen before, each once.

    The alias table is read once, as the state that the stream starts with; a batch then touches the keys it holds and no others. With
    ``expire_ms`` a key counts as new again so long after it was handed on, so that names that found no match are tried again.
    """
    keyed = names.select(team_name("name").alias("key"), "name").where("name is not null")
    known = aliases.groupBy(team_name("alias_name").alias("key")).agg(F.min("alias_name").alias("name"))
    return keyed.groupBy("key").transformWithStateInPandas(FirstOfKey(expire_ms), "key string, name string", "append", "processingtime" if expire_ms else "none", known.groupBy("key"))


def sync_stateful(names: DataFrame, aliases: DataFrame, resolve: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, expire_ms: int | None = None) -> StreamingQuery:
    """``sync`` with a state for each key in place of the alias table: every new name is resolved once, over all batches and restarts.

    A batch that runs again gets the same new names, as its state is that of its start, and replaces its own folder. With
    ``expire_ms`` the query goes on until it is stopped, as keys expire without new data; else it ends with what is there.
    """

    def batch(df: DataFrame, number: int) -> None:
        found = resolve(df.select("name")).where("canonical is not null")
        rows = found.select(F.col("name").alias("alias_name"), F.col("canonical").alias("canonical_team_name"), "confidence", "source")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    conf = names.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKS)
    try:  # a query keeps the settings with which it starts
        return first_names(names, aliases, expire_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**({"processingTime": "1 minute"} if expire_ms else {"availableNow": True})).start()
    finally:
        conf.set(STORE, before)


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and value of each type in tumbling windows; rows later than the watermark are dropped by the stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
