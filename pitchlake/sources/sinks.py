"""Sinks: CSV, per-state partitions, alias deltas, text summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.operators.matching import keep_first

FILES_A_STATE = 8


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_by_state(df: DataFrame, path: str, column: str = "state", mode: str = "overwrite") -> None:
    """One folder per state, of FILES_A_STATE files at most: a state is spread over a few tasks, not all of them, and never one."""
    df.repartition(F.col(column), F.floor(F.rand(7) * FILES_A_STATE)).write.mode(mode).partitionBy(column).parquet(path)


def write_run(df: DataFrame, path: str, run: str, kind: str = "parquet") -> None:
    """The rows of a run in a folder of their own. A run that is repeated replaces its rows; one that fails leaves those that were there."""
    writer = df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def append_aliases(new: DataFrame, table: str, log: str, run: str) -> None:
    """Add to the alias table and keep the delta of the run; a run that is repeated is in both once."""
    write_run(new, table, run)
    write_run(new, log, run)


def merged_aliases(existing: DataFrame, approved: DataFrame) -> DataFrame:
    """Existing aliases and approved ones; of an alias in both the existing row stays."""
    both = existing.withColumn("_ord", F.lit(0)).unionByName(approved.withColumn("_ord", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, ["alias_name"], ["_ord"]).drop("_ord")


def merge_reviewed(existing: DataFrame, approved: DataFrame, backup: str, log: str, stamp: str) -> DataFrame:
    """merged_aliases, after a backup of the table and a log of the aliases that are new."""
    existing.write.mode("overwrite").parquet(backup)
    new = approved.join(existing.select("alias_name").distinct(), "alias_name", "left_anti")
    write_run(diff_log(new, "merged", stamp), log, stamp)
    return merged_aliases(existing, approved)


def write_alias_map(df: DataFrame, path: str) -> None:
    """A JSON object of alias and name as one line; the map is that of a league's names, of a size for one file."""
    entries = df.select(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "name")))).alias("m")) if "alias" in df.columns else df
    entries.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_name_map(df: DataFrame, path: str) -> None:
    """Maps of all divisions in one table, a folder a division; a run replaces the divisions it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("division").parquet(path)


def write_histories(df: DataFrame, path: str) -> None:
    """Histories as ``key`` and one JSON ``value`` a team."""
    rows = F.struct(*[c for c in df.columns if c != "team"])
    df.groupBy(F.col("team").alias("key")).agg(F.to_json(F.sort_array(F.collect_list(rows))).alias("value")).write.mode("overwrite").parquet(path)


def confidence_report(bands: DataFrame, title: str) -> str:
    """Text of the row that quality.confidence_bands gives."""
    r = bands.first()
    share = lambda n: f"{n} ({100 * n / r['n'] if r['n'] else 0:.1f} %)"
    return "\n".join([title, "=" * len(title), f"Aliases: {r['n']}", f"0.9 and more: {share(r['high'])}", f"0.8 to 0.9: {share(r['middle'])}", f"under 0.8: {share(r['low'])}", f"Mean {r['mean']:.3f}, median {r['median']:.3f}, {r['least']:.3f} to {r['most']:.3f}" if r["n"] else "No aliases"])


def diff_log(new: DataFrame, action: str, stamp: str) -> DataFrame:
    return new.withColumns({"action": F.lit(action), "timestamp": F.lit(stamp)})


def summary(ratings: DataFrame, title: str, top: int = 10) -> str:
    """Text report: the best teams and the count and best team of each state. The driver sees ``top`` rows and the states."""
    from pitchlake.operators.serving import by_state

    best = ratings.orderBy(F.desc_nulls_last("power_score_adj"), "team").limit(top).collect()
    states = by_state(ratings).orderBy(F.desc("n_teams"), "state").collect()
    lines = [title, "=" * len(title), *(f"{i:>3}. {r['team']}  {r['power_score_adj']:.4f}" for i, r in enumerate(best, 1)), "", "State: teams, best"]
    return "\n".join([*lines, *(f"{r['state']}: {r['n_teams']}, {r['best_team']}" for r in states)])
