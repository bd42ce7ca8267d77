"""Projections, predicates and reshaping of match records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators.numbering import numbered
from pitchlake.sources.league import days_before

RECENCY = (F.desc, F.desc, F.asc, F.asc, F.asc)
RECENCY_KEYS = ("date", "game_id", "opponent", "gf", "ga")


def outcome(gf: str = "gf", ga: str = "ga") -> Column:
    return F.when(F.col(gf) > F.col(ga), "W").when(F.col(gf) < F.col(ga), "L").when(F.col(gf) == F.col(ga), "T")


def unpivot(games: DataFrame) -> DataFrame:
    """Two rows per game, one for each side, from a single scan; rows without team, opponent or score are dropped."""
    side = lambda me, you, home: F.struct(F.col(f"team_{me}").alias("team"), F.col(f"team_{you}").alias("opponent"), F.col(f"score_{me}").alias("gf"), F.col(f"score_{you}").alias("ga"), F.lit(home).alias("is_home"))
    both = games.withColumn("_s", F.explode(F.array(side("a", "b", True), side("b", "a", False))))
    long = both.select("game_id", "_s.*", "date", "event").where("team is not null and opponent is not null and gf is not null and ga is not null")
    return long.withColumn("result", outcome())


def invert_result(result: str) -> Column:
    return F.when(F.col(result) == "W", "L").when(F.col(result) == "L", "W").when(F.col(result) == "T", "T")


def trailing(df: DataFrame, as_of: dt.datetime, days: int, column: str = "date") -> DataFrame:
    return df.where(F.col(column) >= days_before(as_of, days))


def recency_window() -> Window:
    return Window.partitionBy("team").orderBy(*[f(F.col(k)) for f, k in zip(RECENCY, RECENCY_KEYS, strict=True)])


def most_recent(long: DataFrame, n: int = 30) -> DataFrame:
    """The n newest rows of each team, ``rn`` = 1 newest. Ties beyond the keys are equal rows."""
    return long.withColumn("rn", F.row_number().over(recency_window())).where(F.col("rn") <= n)


def numeric(column: str) -> Column:
    """A number from text: blanks, % and thousands commas go, (n) is negative, what is left over is null."""
    c = F.regexp_replace(F.trim(column), "[%,]", "")
    return F.regexp_replace(c, r"^\((.*)\)$", "-$1").try_cast("double")


def canonical_header(name: str) -> str:
    """Lower case, anything but letters and digits to one underscore, without byte-order mark or outer underscores."""
    out = "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in name.replace("﻿", "").strip().lower())
    return "_".join(p for p in out.split("_") if p)


def rename_headers(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Rename columns to canonical names through their synonyms; the first of several synonyms wins, the rest keep their names."""
    wanted = {canonical_header(v): k for k, vs in synonyms.items() for v in (k, *vs)}
    taken: set[str] = set()
    names = []
    for c in df.columns:
        new = wanted.get(canonical_header(c), c)
        names.append(c if new in taken else new)
        taken.add(names[-1])
    return df.toDF(*names)


def first_present(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One column per target: the first alias that exists."""
    found = {t: next((a for a in names if a in df.columns), None) for t, names in aliases.items()}
    missing = [t for t, a in found.items() if a is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return df.select(*[F.col(f"`{a}`").alias(t) for t, a in found.items()])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def preferred(df: DataFrame, order: list[str]) -> DataFrame:
    return df.select([c for c in order if c in df.columns])


def status(games_played: str, last_game: str, as_of: dt.datetime, least: int = 5, days: int = 180) -> Column:
    """Inactive overrides Provisional, which overrides Active."""
    return F.when(F.col(last_game) < days_before(as_of, days), "Inactive").when(F.col(games_played) < least, "Provisional").otherwise("Active")


def status_by_games(games_played: str, least: int = 6) -> Column:
    return F.when(F.col(games_played) >= least, "Active").otherwise("Provisional")


def impact_bucket(delta: str) -> Column:
    return F.when(F.col(delta) > 1, "good").when(F.col(delta) < -1, "weak").otherwise("neutral")


def performance_label(delta: str) -> Column:
    return F.when(F.col(delta) >= 1, "overperformed").when(F.col(delta) <= -1, "underperformed").otherwise("neutral")


def games_step(games_played: str) -> Column:
    return F.when(F.col(games_played) >= 20, 1.0).when(F.col(games_played) >= 10, 0.9).otherwise(0.75)


def age_from_text(text: str) -> Column:
    low = F.lower(text)
    return F.when(low.contains("2015") | low.contains("u10"), "U10").when(low.contains("2014") | low.contains("u11"), "U11").otherwise("U11")


def search(column: str, pattern: str) -> Column:
    """Case-insensitive regular expression; a null is no hit."""
    return F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))


def age_group_games(games: DataFrame, primary: DataFrame, any_master: DataFrame, age: str) -> DataFrame:
    """Distinct games whose A side is a primary team of the age, or whose B side is primary and A side known at all."""
    p, m = primary.select("team").distinct(), any_master.select("team").distinct()
    own = games.where(F.col("age") == age).join(p, games["team_a"] == p["team"], "left_semi")
    cross = games.join(p, games["team_b"] == p["team"], "left_semi").join(m, games["team_a"] == m["team"], "left_semi")
    return own.unionByName(cross).distinct()


def tail_remainder(df: DataFrame, order: list[str], n_first: int) -> DataFrame:
    """Rows after the first ``n_first`` in file order, which must be total."""
    return numbered(df, order, "_n", 1).where(F.col("_n") > n_first).drop("_n")


def leading_words(column: str) -> Column:
    """Words before the first one that holds a digit: the club part of a team name."""
    words = F.split(F.trim(column), r"\s+")
    first = F.array_position(F.transform(words, lambda w: w.rlike("[0-9]")), True)
    return F.array_join(F.when(first > 0, F.slice(words, F.lit(1), (first - 1).cast("int"))).otherwise(words), " ")


def advice(offense: str, defense: str, schedule: str, low: float = 0.4, high: float = 0.6) -> Column:
    """Remarks whose condition holds, as an array."""
    rules = [
        (F.col(offense) >= high, "strong offense"), (F.col(offense) < low, "offense needs work"),
        (F.col(defense) >= high, "strong defense"), (F.col(defense) < low, "defense needs work"),
        (F.col(schedule) >= high, "tough schedule"), (F.col(schedule) < low, "easy schedule"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))


# The patterns of names that cannot belong to the division.
OTHER_AGE = r"\b(2013|2015|13|15|u13|u15|14g|girls)\b"
OTHER_STATE = r"\b(ca|nv|tx|nm|co|wa|ut|or|dc|pr|hi|ak|can|mexico|bc|ab)\b"


def unmatched_category(name: str) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(f"(?U){OTHER_AGE}"), "AGE_MISMATCH").when(low.rlike(f"(?U){OTHER_STATE}"), "OUT_OF_STATE").otherwise("UNKNOWN_MISC")


def oriented_scores(team: str = "team_id", home: str = "home_team_id") -> list[Column]:
    """our_score, opponent_score of a game as the team saw it; a score that is missing counts 0."""
    at_home = F.col(team) == F.col(home)
    mine, theirs = F.when(at_home, F.col("home_score")).otherwise(F.col("away_score")), F.when(at_home, F.col("away_score")).otherwise(F.col("home_score"))
    return [F.coalesce(mine, F.lit(0)).alias("our_score"), F.coalesce(theirs, F.lit(0)).alias("opponent_score")]


def normalised_columns(df: DataFrame, synonyms: dict[str, list[str]], numbers: list[str], text: str = "Team") -> DataFrame:
    """Canonical headers, then numbers out of their texts and the team as text; other columns stay."""
    out = rename_headers(df, synonyms)
    made = {c: numeric(c) for c in numbers if c in out.columns and dict(out.dtypes)[c] == "string"} | {c: F.col(c).try_cast("double") for c in numbers if c in out.columns and dict(out.dtypes)[c] != "string"}
    return out.withColumns(made | ({text: F.col(text).cast("string")} if text in out.columns else {}))


#: Columns of the national match format, in order.
NATIONAL = ["Date", "Team A", "Team B", "Team A State", "Team B State", "Team A Division", "Team B Division", "Team A Club", "Team B Club", "Score A", "Score B", "Result A", "Result B", "Event", "Competition", "Division", "Venue", "Location", "Match ID", "Original Team A ID", "Original Team B ID", "Cross_State", "Event_Type", "Venue_State"]


def national(df: DataFrame, age: int, order: list[str]) -> DataFrame:
    """Matched games of an age in the 24 columns of the national format; match ids follow ``order``, which must be total.

    df: the format's columns of dates, teams, states, clubs, scores, Event, Team A Result and the two ids.
    """
    first = 1_000_000 + (age - 10) * 1_000_000
    other = F.when(F.col("Team A Result") == "W", "L").when(F.col("Team A Result") == "L", "W").when(F.col("Team A Result") == "T", "T").otherwise("")
    made = {
        "Team A Division": F.lit(f"U{age}B"), "Team B Division": F.lit(f"U{age}B"), "Result A": F.col("Team A Result"), "Result B": other, "Competition": F.col("Event"), "Division": F.lit(f"U{age}B U{age} Boys Elite"),
        "Venue": F.col("Event"), "Location": F.lit(""), "Original Team A ID": F.col("Gotsport Team id # Team A"), "Original Team B ID": F.col("Team B GotSport ID"),
        "Cross_State": ~F.col("Team A State").eqNullSafe(F.col("Team B State")), "Event_Type": F.lit("League"), "Venue_State": F.col("Team A State"),
    }
    return numbered(df, order, "Match ID", first).withColumns(made).select(*NATIONAL)


def sampled(df: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """At most n rows by chance, the same for a seed: the rows with the least hashes."""
    return df.withColumn("_u", F.xxhash64(F.lit(seed), *df.columns)).orderBy("_u", *df.columns).limit(n).drop("_u")
