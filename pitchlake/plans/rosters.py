"""Team names of the tables: a master list from ``part``, observed names with slips, and aliases.

Every expression below is read alike by Spark and by DuckDB, so the queries and their SQL run over the same rows. A part gives a master
name of club, place, suffix, birth year, gender, colour and, for a third of them, a coach. The observed names are those of all parts, each
with one of eight slips by its key, and those of all suppliers, which no master has. Every fifth part gives an alias in the form
that the aggressive normaliser makes of its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.sources.league import read

_pick = lambda of, words: "case " + " ".join(f"when {of} % {len(words)} = {i} then '{w}'" for i, w in enumerate(words)) + " end"

BRAND = "cast(substr(p_brand, 7) as int)"
PIECES = {
    "k": "p_partkey",
    "club": "upper(substr(p_name, 1, 1)) || substr(p_name, 2)",
    "place": "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))",
    "suffix": _pick(BRAND, ["FC", "SC", "United", "Academy", "Rovers", "Soccer Club"]),
    "born": "2006 + p_size % 12",
    "girls": "p_partkey % 2 = 1",
    "colour": _pick(BRAND, ["Red", "Blue", "Gold", "Black", "White", "II", "Elite"]),
    "coach": "case when p_partkey % 3 = 0 then " + _pick(BRAND, ["Garcia", "Lopez", "Smith", "Ramirez"]) + " end",
}
_JOINED = "club || ' ' || place || ' ' || suffix || ' ' || {years} || ' ' || colour || coalesce(' ' || coach, '')"
_LETTER = "case when girls then '{}' else '{}' end"
NAME = _JOINED.format(years="cast(born as varchar(4)) || ' ' || " + _LETTER.format("Girls", "Boys"))
_AGED = _JOINED.format(years="'U' || cast(2026 - born as varchar(2)) || ' ' || " + _LETTER.format("Girls", "Boys"))
_SHORT = _JOINED.format(years="substr(cast(born as varchar(4)), 3) || " + _LETTER.format("G", "B"))
#: What was observed for a part, by its key.
SLIPS = [
    "name", "lower(name)", _AGED, _SHORT, "substr(name, 1, 2 + cast(k % 12 as int)) || substr(name, 4 + cast(k % 12 as int))", "replace(club, ' ', '') || substr(name, length(club) + 1)",
    "'  ' || replace(replace(name, 'o', 'ö'), ' ', '  ')", "name || ' (H)'",
]
OBSERVED = "case when k % 89 = 0 then '' " + " ".join(f"when k % {len(SLIPS)} = {i} then {s}" for i, s in enumerate(SLIPS)) + " end"
ALIAS = "lower(" + _JOINED.format(years="substr(cast(born as varchar(4)), 3)") + ")"
CONFIDENCE = "cast(60 + k % 41 as double) / 100"
#: Clubs and the variations with which their names start, the canonical one first in the name of the club.
PREFIXES = {"small_ring": ["small ring economy", "small ring"], "red_widget": ["red widget"], "old_anvil": ["the old anvil", "old anvil"], "hot_gear": ["hotgear", "hot gear"]}

TEAMS_SQL = f"teams_of_parts as (select *, {NAME} as name from (select {', '.join(f'{e} as {c}' for c, e in PIECES.items())} from part))"
MASTER_SQL = f"{TEAMS_SQL}, master as (select min(k) as ord, name from teams_of_parts group by name)"
OBSERVED_SQL = f"observed as (select k as ord, {OBSERVED} as name from teams_of_parts union all select -1 - s_suppkey, s_name from supplier)"
ALIASES_SQL = f"aliases as (select alias_name, min(name) as canonical_team_name, max(confidence) as confidence from (select {ALIAS} as alias_name, name, {CONFIDENCE} as confidence from teams_of_parts where k % 5 = 0) group by alias_name)"
ALL_SQL = f"{MASTER_SQL}, {OBSERVED_SQL}, {ALIASES_SQL}"


def teams_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*[f"{e} as {c}" for c, e in PIECES.items()]).withColumn("name", F.expr(NAME))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, name: distinct names, the first part's key."""
    return teams_of_parts(spark, sf_dir).groupBy("name").agg(F.min("k").alias("ord")).select("ord", "name")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, name; names repeat."""
    suppliers = read(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("ord"), F.col("s_name").alias("name"))
    return teams_of_parts(spark, sf_dir).selectExpr("k as ord", f"{OBSERVED} as name").union(suppliers)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alias_name, canonical_team_name, confidence."""
    rows = teams_of_parts(spark, sf_dir).where("k % 5 = 0").selectExpr(f"{ALIAS} as alias_name", "name", f"{CONFIDENCE} as confidence")
    return rows.groupBy("alias_name").agg(F.min("name").alias("canonical_team_name"), F.max("confidence").alias("confidence"))
