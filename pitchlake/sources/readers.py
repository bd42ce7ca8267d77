"""Readers and registries: CSV and Parquet with header repair, JSON and YAML tables, path choice."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators.reshape import canonical_header, first_present, require

GAME_COLUMNS = ["Team A", "Team B", "Score A", "Score B", "Date"]
# Names under which source files hold the columns of a game; the first that a file has wins.
GAME_ALIASES = {
    "Team A": ["Team A", "Home", "Home Team", "team_a", "TeamA"], "Team B": ["Team B", "Away", "Away Team", "team_b", "TeamB"],
    "Score A": ["Score A", "ScoreA", "Home Score", "score_a"], "Score B": ["Score B", "ScoreB", "Away Score", "score_b"],
    "Date": ["Date", "Date/Time", "Game Date", "date", "Match Date"],
}


def clean_headers(df: DataFrame) -> DataFrame:
    """Byte-order marks and outer blanks off the column names."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    return clean_headers((reader.schema(schema) if schema else reader).csv(path))


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix; columns of a game under their common names, others dropped by the select."""
    df = clean_headers(spark.read.parquet(path)) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)
    df = require(first_present(df, GAME_ALIASES), GAME_COLUMNS)
    date = F.coalesce(F.try_to_timestamp(F.col("Date"), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.col("Date"), F.lit("M/d/yyyy"))) if dict(df.dtypes)["Date"] == "string" else F.col("Date")
    return df.select(F.trim("Team A").alias("team_a"), F.trim("Team B").alias("team_b"), F.col("Score A").try_cast("double").alias("score_a"), F.col("Score B").try_cast("double").alias("score_b"), date.cast("timestamp_ntz").alias("date"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, candidates: Iterable[str]) -> str | None:
    return next((p for p in candidates if exists(spark, p)), None)


def game_paths(root: str, division: str) -> list[str]:
    """Places where a division's games may be, the best first: clean, silver, gold, and names of older runs."""
    layers = [("clean", "_CLEAN.csv"), ("silver", ".parquet"), ("silver", ".csv"), ("gold", ".parquet"), ("gold", ".csv"), ("gold", "_COMPAT.csv")]
    return [f"{root}/{layer}/{division}{suffix}" for layer, suffix in layers] + [f"{root}/Matched_Games_{division}.csv", f"{root}/Matched_Games.csv"]


def history_paths(root: str, age: str, gender: str | None = None, state: str | None = None) -> list[str]:
    """Files of team histories of a slice, from the most specific name to the plain one."""
    return [p.replace("Rankings_", "Team_Game_Histories_") for p in slice_paths(root, age, gender, state)]


def list_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, change time) of the files that match a glob pattern, in name order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted((f.getPath().toString(), f.getModificationTime()) for f in found or [])


def latest_version(spark: SparkSession, root: str, stem: str, versions: Iterable[str], suffix: str = ".csv") -> str | None:
    """The file of the first version in the list that exists; without any, the newest file of the stem."""
    found = first_existing(spark, [f"{root}/{stem}_{v}{suffix}" for v in versions])
    return found or max(((t, p) for p, t in list_files(spark, f"{root}/{stem}*{suffix}")), default=(0, None))[1]


def game_files(spark: SparkSession, root: str, ages: Iterable[str] = ("u10", "u11")) -> dict[str, list[str]]:
    """CSV files of games by age, wherever they lie under ``root``: the age is part of the name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listing = fs.listFiles(p, True) if fs.exists(p) else None
    files = []
    while listing is not None and listing.hasNext():
        path = listing.next().getPath().toString()
        files += [path] if path.lower().endswith(".csv") else []
    return {age: sorted(p for p in files if age in p.rsplit("/", 1)[-1].lower()) for age in ages}


class TableCache:
    """Tables by path, read again when a file has changed; tables of older changes are released."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: dict[str, tuple[int, DataFrame]] = {}

    def get(self, path: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
        changed = max((t for _, t in [*list_files(self.spark, path), *list_files(self.spark, f"{path}/*")]), default=0)
        if path in self.held and self.held[path][0] != changed:
            self.held.pop(path)[1].unpersist()
        if path not in self.held:
            self.held[path] = changed, read(self.spark, path).persist()
        return self.held[path][1]


def slice_paths(root: str, age: str, gender: str | None = None, state: str | None = None, year: str | None = None) -> list[str]:
    """Ranking files of a slice, from the most specific name to the plain one."""
    parts = [p for p in (state, gender, year) if p]
    names = [f"Rankings_{age}_{'_'.join(parts[:n])}" if n else f"Rankings_{age}" for n in range(len(parts), -1, -1)]
    return [f"{root}/{n}{x}" for n in names for x in (".parquet", ".csv")]


def cross_age(age: int) -> int | None:
    """The age whose teams a team of this age also meets."""
    return age + 1 if 10 <= age <= 12 else None


REGISTRY_FIELDS = ("age", "gender", "state", "url", "active")


def registry_rows(texts: DataFrame, column: str) -> DataFrame:
    """division, age, gender, state, url, active, canonical of JSON registries, one a row; an entry that lacks a field fails the query."""
    one = texts.select(F.explode(F.from_json(column, "map<string, map<string, string>>")).alias("division", "d"))
    missing = F.array_except(F.array(*[F.lit(f) for f in REGISTRY_FIELDS]), F.map_keys("d"))
    checked = one.where(F.when(F.size(missing) == 0, F.lit(True)).otherwise(F.raise_error(F.concat("division", F.lit(" has no "), F.array_join(missing, ", "))).cast("boolean")))
    kinds = {"age": "int", "active": "boolean"}
    rows = checked.select("division", *[F.col("d")[f].cast(kinds.get(f, "string")).alias(f) for f in REGISTRY_FIELDS])
    return rows.withColumn("canonical", F.concat_ws("_", "state", F.when(F.lower("gender") == "m", "Boys").otherwise("Girls"), F.concat(F.lit("U"), "age")))


def registry(spark: SparkSession, text: str) -> DataFrame:
    """The rows of one JSON registry; refuses entries without a field."""
    for key, entry in json.loads(text).items():
        missing = [f for f in REGISTRY_FIELDS if f not in entry]
        if missing:
            raise ValueError(f"{key} has no {', '.join(missing)}")
    return registry_rows(spark.createDataFrame([(text,)], "j string"), "j")


def prefix_table(text: str) -> dict[str, list[str]]:
    """Clubs and their name variations from a two-level YAML list, in file order."""
    out: dict[str, list[str]] = {}
    club = None
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        if m := re.fullmatch(r"([^\s:-][^:]*):", body):
            club = m[1].strip()
            out[club] = []
        elif (m := re.fullmatch(r"\s*-\s*(.+)", body)) and club:
            out[club].append(m[1].strip().strip("'\"").lower())
    return out


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    df = require(read_csv(spark, path), ["alias_name", "canonical_team_id", "canonical_team_name", "confidence", "last_seen"])
    return df.withColumn("confidence", F.col("confidence").try_cast("double"))


def distinct_names(games: DataFrame, a: str = "team_a", b: str = "team_b") -> DataFrame:
    return games.select(F.explode(F.array(a, b)).alias("name")).where("name is not null").distinct()


def master_from_games(games: DataFrame, a: str = "team_a", b: str = "team_b") -> DataFrame:
    """Trimmed distinct names of both sides, sorted."""
    return games.select(F.explode(F.array(F.col(a).cast("string"), F.col(b).cast("string"))).alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct().orderBy("name")


def states_of_files(df: DataFrame, pattern: str = r"_([A-Z]{2})\.csv$") -> DataFrame:
    """Distinct states in the names of the files a table was read from."""
    return df.select(F.regexp_extract(F.input_file_name(), pattern, 1).alias("state")).where("state <> ''").distinct()


def alias_map(spark: SparkSession, path: str) -> DataFrame:
    """alias, name of a JSON object {alias: name}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, string>")).alias("alias", "name"))


def slice_index(spark: SparkSession, path: str) -> DataFrame:
    """state, gender, year of a JSON index {"slices": [...]}; genders are MALE or FEMALE; an empty index is one slice of all."""
    kind = "struct<slices: array<struct<state: string, gender: string, year: string>>>"
    found = spark.read.text(path, wholetext=True).select(F.explode_outer(F.from_json("value", kind)["slices"]).alias("s")).select("s.*")
    return found.select(F.coalesce("state", F.lit("All")).alias("state"), normal_gender("gender", "MALE", "FEMALE", "All").alias("gender"), F.coalesce("year", F.lit("All")).alias("year")).distinct()


def normal_gender(column: str, male: str = "M", female: str = "F", missing: str | None = None) -> Column:
    """M, MALE and BOYS in any case are male, every other value is female; a null is ``missing``."""
    return F.when(F.col(column).isNull(), F.lit(missing)).when(F.upper(F.trim(column)).isin("M", "MALE", "BOYS"), male).otherwise(female)


def metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a metrics log in the order of time; rows whose time cannot be read come first."""
    df = require(read_csv(spark, path), ["timestamp"])
    return df.withColumn("timestamp", F.try_to_timestamp("timestamp").cast("timestamp_ntz")).orderBy(F.col("timestamp").asc_nulls_first())


def headers_probe(df: DataFrame, rows: int = 5) -> tuple[list[tuple[str, str]], list[dict]]:
    """(raw and canonical header of each column, the first rows)."""
    return [(c, canonical_header(c)) for c in df.columns], [r.asDict() for r in df.limit(rows).collect()]


def health(spark: SparkSession, path: str, most: int = 50) -> dict:
    """Whether a table is there and the names of its first columns."""
    if not exists(spark, path):
        return {"ok": False, "path": path, "columns": []}
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)
    return {"ok": True, "path": path, "columns": df.columns[:most]}


def approved_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed aliases that were approved, in any spelling of yes."""
    df = require(read_csv(spark, path), ["alias_name", "canonical_team_name", "approved"])
    return df.where(F.lower(F.trim("approved")).isin("yes", "y", "true", "1", "approved")).drop("approved")


class UnmatchedNames(ValueError):
    """Observed names that the master list lacks."""


def name_map(observed: DataFrame, master: DataFrame, normalise: Callable[[str], Column], log: str | None = None) -> DataFrame:
    """raw_name, team_id, display_name of every observed name; refuses if any has no master, after writing these to ``log``.

    observed: raw_name; master: team_id, display_name. The check is one count over the names; nothing is collected.
    """
    keyed = observed.where("raw_name is not null").select("raw_name").distinct().withColumn("norm", normalise("raw_name"))
    mapped = keyed.join(master.select("team_id", "display_name", normalise("display_name").alias("norm")), "norm", "left").persist()
    misses = mapped.where("team_id is null")
    if n := misses.count():
        if log:
            misses.select("raw_name", "norm").write.mode("overwrite").option("header", True).csv(log)
        raise UnmatchedNames(f"{n} names have no master" + (f", see {log}" if log else ""))
    return mapped.select("raw_name", "team_id", "display_name").distinct()


def corrected_masters(u10: DataFrame, u11: DataFrame, games: DataFrame, season: int = 2026) -> DataFrame:
    """The master lists an age up, and the youngest made anew of the names in games that hold its birth year.

    Lists: Team_Name, Club, State_Code, GotSport_Team_ID; result: these, Age_Group, Age_U, Team_ID. Ids are hashes of the name.
    """
    keep = ["Team_Name", "Club", "State_Code", "GotSport_Team_ID"]
    older = [df.select(*keep, F.lit(season - age).alias("Age_Group"), F.lit(age).alias("Age_U")) for df, age in ((u10, 11), (u11, 12))]
    names = distinct_names(games).where(F.contains(F.lower("name"), F.lit(str(season - 10)))).select(F.col("name").alias("Team_Name"))
    known = u10.select(*keep).groupBy("Team_Name").agg(*[F.first(c).alias(c) for c in keep[1:]])
    young = names.join(known, "Team_Name", "left").select("Team_Name", *[F.coalesce(c, F.lit("Unknown")).alias(c) for c in keep[1:3]], keep[3], F.lit(season - 10).alias("Age_Group"), F.lit(10).alias("Age_U"))
    every = young.unionByName(older[0]).unionByName(older[1])
    return every.withColumn("Team_ID", F.concat(F.lit("u"), "Age_U", F.lit("_"), F.substring(F.sha1("Team_Name"), 1, 12)))


# Files that stand in for a division's rankings or predictions.
GENERAL_RANKINGS = ["Rankings_v53_enhanced.csv", "Rankings_v53.csv", "Rankings_v52b.csv"]
SERVED_RANKINGS = ["Rankings_v53_enhanced.csv", "Rankings_AZ_M_U12_2025_v53e.csv", "Rankings.csv"]
GENERAL_PREDICTIONS = ["Predicted_Outcomes_v52b.csv"]


def load_first(spark: SparkSession, root: str, names: Iterable[str]) -> tuple[str, DataFrame] | None:
    """(path, table) of the first name that exists under ``root``, CSV or Parquet by suffix; None if there is none."""
    path = first_existing(spark, [f"{root}/{n}" for n in names if n])
    return path and (path, clean_headers(spark.read.parquet(path)) if path.endswith(".parquet") else read_csv(spark, path))


def division_rankings(spark: SparkSession, root: str, own: str | None, fallbacks: Iterable[str] = ()) -> tuple[str, DataFrame] | None:
    """A division's ranking file, else one of its fallbacks, else a general one."""
    return load_first(spark, root, [own or "", *fallbacks, *GENERAL_RANKINGS])


def division_predictions(spark: SparkSession, root: str, own: str | None) -> tuple[str, DataFrame] | None:
    return load_first(spark, root, [own or "", *GENERAL_PREDICTIONS])


def served_rankings(spark: SparkSession, root: str) -> tuple[str, DataFrame]:
    """What the service starts with; it does not start without."""
    found = load_first(spark, root, SERVED_RANKINGS)
    if found is None:
        raise FileNotFoundError(f"no ranking files under {root}")
    return found


def read_histories(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows that sinks.write_histories wrote, a row a game again with ``team``; None without a cache. schema: that of a game."""
    if not exists(spark, path):
        return None
    return spark.read.parquet(path).select(F.col("key").alias("team"), F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("g")).select("team", "g.*")


def newest_plot(spark: SparkSession, root: str, pattern: str = "*.png") -> str | None:
    """The newest file of a pattern; of equal times the last by name."""
    return max(((t, p) for p, t in list_files(spark, f"{root}/{pattern}")), default=(0, None))[1]
