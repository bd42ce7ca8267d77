"""Matching of observed names with master lists and the alias cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import names as N
from pitchlake.functions import similarity as M
from pitchlake.operators import similarity_join
from pitchlake.operators.pairs import join_counted, ranged_join
from pitchlake.operators.sos import cut

# Words that do not make two clubs alike.
GENERIC_CLUB = [*N.CLUB_SUFFIXES, "15b", "16b", "17b", "18b", "15g", "16g", "17g", "18g", "south", "north", "east", "west", "central", "metro", "valley", "ridge", "hills", "park", "field", "stadium", "center", "centre"]


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in file order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def best(df: DataFrame, key: str, score: str, order: str, k: int = 1) -> DataFrame:
    """The k best candidates of each key; of equal scores the earliest."""
    w = Window.partitionBy(key).orderBy(F.desc(score), order)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def similarity_gate(a: Column, b: Column, x: Column, y: Column, ratio: Column) -> Column:
    """Score of two parsed names, 0 where a rule rejects them; x and y are their normalised clubs, ``ratio`` the block ratio of these."""
    inside = F.contains(x, y) | F.contains(y, x)
    common = F.array_intersect(F.split(x, " "), F.split(y, " "))
    telling = F.size(F.filter(common, lambda w: (F.length(w) > 2) & ~w.isin(N.CLUB_SUFFIXES)))
    words = F.size(F.filter(common, lambda w: (F.length(w) > 1) & ~w.isin(GENERIC_CLUB)))
    score = F.when(inside, F.greatest(ratio, F.lit(0.9))).when(telling >= 2, F.greatest(ratio, F.lit(0.8))).otherwise(ratio)
    clash = lambda f: (a[f] != "") & (b[f] != "") & (a[f] != b[f])
    same = lambda f: F.when((a[f] == b[f]) & (a[f] != ""), 1).otherwise(0)
    criteria = same("birth_year") + same("gender") + same("designation") + same("coach") + F.when(words >= 2, 1).otherwise(0)
    ab = (F.contains(x, F.lit("team a")) & F.contains(y, F.lit("team b"))) | (F.contains(x, F.lit("team b")) & F.contains(y, F.lit("team a")))
    lengths = F.array_sort(F.array(F.length(x), F.length(y)))
    much_shorter = (x != y) & (F.get(lengths, F.lit(0)) < 0.7 * F.get(lengths, F.lit(1))) & inside & (score < 0.95)
    rejected = (
        (a["birth_year"] != b["birth_year"]) | (a["gender"] != b["gender"]) | (a["designation"] != b["designation"]) | clash("coach") | clash("state")
        | (x == "") | (y == "") | (score < 0.8) | ((x != y) & ~inside & (score < 0.9)) | ab | much_shorter | (words < 2) | (criteria < 3)
    )
    return F.when(rejected, 0.0).otherwise(score)


#: Parsed fields that the gate reads beside the club; the first three must be equal.
GATED = ("birth_year", "gender", "designation", "coach", "state")
SAME = GATED[:3]


def _profiled(names: DataFrame, name: str, season: int) -> DataFrame:
    """The names that have a birth year and a gender, with the fields of GATED and the normalised club: all that the gate reads."""
    parsed = cut(names.withColumn("p", N.parsed(name, season)))  # read several times
    return cut(parsed.where("p.birth_year <> '' and p.gender <> ''").select(*names.columns, *[f"p.{f}" for f in GATED], N.matcher_club(F.col("p.club")).alias("club")))


def _profiles(named: DataFrame, p: str, club: str) -> DataFrame:
    """The different profiles of names: SAME, the fields as a struct, the club, and ``w``, its words that can count as common ones."""
    words = F.array_sort(F.array_distinct(F.filter(F.split("club", " "), lambda w: (F.length(w) > 1) & ~w.isin(GENERIC_CLUB))))
    return named.select(*GATED, "club").distinct().select(*SAME, F.struct(*GATED).alias(p), F.col("club").alias(club), words.alias(f"{club}_w"))


def _two_words(df: DataFrame, words: str) -> DataFrame:
    """A row for each two of the words, as ``two``."""
    two = F.flatten(F.transform(words, lambda v, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda u: F.array(v, u))))
    return df.withColumn("two", F.explode(two))


def gated_profiles(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b (fields), x, y (clubs): the pairs of profiles that the gate lets through if their clubs are alike enough.

    Birth year, gender and designation must be equal and two words of the clubs common, so these are the join keys; a pair meets by the
    first two of its common words only. A hot key's pairs are dealt evenly over cells. A ratio of 0.9 leaves a tenth of both clubs'
    characters to be changed at most, which the native edit distance bounds before the ratio is computed.
    """
    pairs = ranged_join(_two_words(_profiles(left, "a", "x"), "x_w"), _two_words(_profiles(right, "b", "y"), "y_w"), [*SAME, "two"])
    x, y = F.col("x"), F.col("y")
    pairs = pairs.where(F.slice(F.array_sort(F.array_intersect("x_w", "y_w")), 1, 2) == F.col("two"))
    alike = (x == y) | F.contains(x, y) | F.contains(y, x) | (F.levenshtein(x, y) <= 0.1 * (F.length(x) + F.length(y)) + 1e-9)
    return pairs.where(alike).where(similarity_gate(F.col("a"), F.col("b"), x, y, F.lit(1.0)) > 0).select("a", "b", "x", "y")


def best_master(observed: DataFrame, master: DataFrame, threshold: float = 0.8, season: int = 2026) -> DataFrame:
    """name, match, score: the best master name under the gate. observed: name; master: name, ord.

    The gate reads a name's profile only, so profiles are compared, not names. A name is never matched with itself: of each profile
    the two first master names are kept, of which one at least is another name.
    """
    a = _profiled(observed.select("name").where("name is not null").distinct(), "name", season)
    b = _profiled(master.where("name is not null").groupBy(F.col("name").alias("match")).agg(F.min("ord").alias("ord")), "match", season)
    ratio = F.when(F.col("x") == F.col("y"), 1.0).otherwise(M.block_ratio(F.when(F.col("x") != F.col("y"), F.col("x")), "y"))
    gate = similarity_gate(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.col("ratio"))
    scored = gated_profiles(a, b).withColumn("ratio", ratio).withColumn("score", gate).where(F.col("score") >= threshold)
    of = lambda df, p, club: df.select(F.struct(*GATED).alias(p), F.col("club").alias(club), *[c for c in ("name", "match", "ord") if c in df.columns])
    nth = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = of(b, "b", "y").withColumn("nth", nth(["b", "y"], "ord", "match")).where("nth <= 2").drop("nth")
    met = scored.select("a", "x", "b", "y", "score").join(first.hint("merge"), ["b", "y"])
    top = met.withColumn("nth", nth(["a", "x"], F.desc("score"), "ord", "match")).where("nth <= 2").select("a", "x", "match", "ord", "score")
    return best(of(a, "a", "x").join(top.hint("merge"), ["a", "x"]).where("name <> match"), "name", "score", "ord").select("name", "match", "score")


def hybrid_candidates(observed: DataFrame, master: DataFrame, k: int = 3, least: float = 0.3) -> DataFrame:
    """name, match, score, nth: the k best by the hybrid score, with or without a shared token. Both lists hold normalised names."""
    return similarity_join.hybrid_best(observed, master.select(F.col("name").alias("match"), "ord"), k, least).select("name", "match", "score", "nth")


def review_rows(candidates: DataFrame) -> DataFrame:
    """name, top_candidates as ``match (0.000) | ...``, best_score."""
    text = F.format_string("%s (%.3f)", "match", "score")
    rows = candidates.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("nth", text.alias("t")))).alias("c"), F.max("score").alias("best_score"))
    return rows.select("name", F.array_join(F.col("c.t"), " | ").alias("top_candidates"), "best_score")


def exact_or_fuzzy(observed: DataFrame, master: DataFrame, threshold: float = 90.0) -> DataFrame:
    """name, match, match_type (EXACT, FUZZY, NO_MATCH, EMPTY), score 0 to 100. Only names without an exact match are compared."""
    o = cut(observed.select("name").distinct().withColumn("key", N.basic_name("name")))
    m = cut(keep_first(master.withColumn("key", N.basic_name("name")), ["key"], ["ord"]).select("key", F.col("name").alias("match"), "ord"))
    exact = o.join(m.select("key", "match"), "key", "left")
    open_ = exact.where("match is null and key <> ''").select(F.col("key").alias("name")).distinct()
    pairs = similarity_join.weighted_candidates(open_, m.select(F.col("key").alias("match"), "ord"), threshold, best=True)
    scored = best(pairs.withColumn("score", M.best_of_ratio("name", "match")).where(F.col("score") >= threshold), "name", "score", "ord")
    fuzzy = scored.select(F.col("name").alias("key"), F.col("match").alias("fuzzy_key"), "score").join(m.select(F.col("key").alias("fuzzy_key"), F.col("match").alias("fuzzy")), "fuzzy_key")
    kind = F.when(F.col("key") == "", "EMPTY").when(F.col("match").isNotNull(), "EXACT").when(F.col("fuzzy").isNotNull(), "FUZZY").otherwise("NO_MATCH")
    joined = exact.join(fuzzy, "key", "left")
    return joined.select("name", F.coalesce("match", "fuzzy").alias("match"), kind.alias("match_type"), F.when(F.col("match").isNotNull(), 100.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def replaced(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """The canonical name in place of an alias; others stay. aliases: alias_name, canonical_team_name."""
    known = aliases.select(F.col("alias_name").alias("_alias"), F.col("canonical_team_name").alias("_canonical"))
    return df.join(known, F.col(column) == F.col("_alias"), "left").withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def conflicts(a_side: DataFrame, b_side: DataFrame) -> DataFrame:
    """Names that were matched differently as A and as B side. Both: name, match, ord."""
    first = lambda df, new: df.groupBy("name").agg(F.min_by("match", "ord").alias(new))
    return first(a_side, "match_a").join(first(b_side, "match_b"), "name").where(~F.col("match_a").eqNullSafe(F.col("match_b")))


def resolve(observed: DataFrame, aliases: DataFrame, master: DataFrame, approve: float = 0.9, overlap: float = 0.6) -> DataFrame:
    """name, canonical, confidence, source: alias table, strict matcher, hybrid score, or unmatched. Each stage sees what the one before left.

    The key of the alias table is the aggressive normalisation of both sides.
    """
    o = cut(observed.select("name").distinct().withColumn("key", N.team_name("name")))
    cache = keep_first(aliases.withColumn("key", N.team_name("alias_name")), ["key"], ["alias_name"]).select("key", F.col("canonical_team_name").alias("cached"), F.col("confidence").alias("cached_score"))
    stage = o.join(cache, "key", "left")
    strict = best_master(stage.where("cached is null"), master).select("name", F.col("match").alias("strict"))
    stage = cut(stage.join(strict, "name", "left"))
    m = cut(master.withColumn("key", N.team_name("name")))
    left = stage.where("cached is null and strict is null and key <> ''").select(F.col("key").alias("name")).distinct()
    near = hybrid_candidates(left, m.select(F.col("key").alias("name"), "ord"), 1, approve - 1e-9)
    near = near.where((F.col("score") >= approve) & (N.token_overlap(F.col("name"), F.col("match")) >= overlap)).select(F.col("name").alias("key"), F.col("match").alias("near_key"), F.col("score").alias("near_score"))
    near = near.join(keep_first(m, ["key"], ["ord"]).select(F.col("key").alias("near_key"), F.col("name").alias("near")), "near_key")
    stage = stage.join(near, "key", "left")
    source = F.when(F.col("cached").isNotNull(), "alias").when(F.col("strict").isNotNull(), "strict").when(F.col("near").isNotNull(), "hybrid").otherwise("unmatched")
    confidence = F.coalesce("cached_score", F.when(F.col("strict").isNotNull(), 0.9), "near_score", F.lit(0.0))
    return stage.select("name", F.coalesce("cached", "strict", "near").alias("canonical"), confidence.alias("confidence"), source.alias("source"))


GRAM = 3


def _holders(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s, l) where the name l holds the name s. s meets l by its rarest gram of up to three characters, of which l has all.

    Exploded sides are never sent whole: the planner takes them for small.
    """
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n))))
    size = F.least(F.lit(GRAM), F.length("s"))
    of_long = long.select("l", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[grams(F.col("l"), n) for n in range(1, GRAM + 1)]))).alias("g"))
    often = of_long.groupBy("g").agg(F.count("*").alias("n"))
    of_short = short.select("s", F.explode(F.when(F.length("s") == 0, F.array(F.lit(""))).when(size == 1, grams(F.col("s"), 1)).when(size == 2, grams(F.col("s"), 2)).otherwise(grams(F.col("s"), GRAM))).alias("g"))
    rarest = of_short.join(often.hint("merge"), "g", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0").select("s", F.col("r.g").alias("g"))
    return rarest.join(of_long.hint("merge"), "g").where(F.contains("l", F.col("s"))).select("s", "l")


def contains_either(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, match, inside) where one name holds the other, in any case; names that have no such match get those with which they share two words.

    Null names have no match; the empty name is held by all.
    """
    x, y = (cut(df.select("name").where("name is not null").distinct().withColumn("low", F.lower("name"))) for df in (a, b))
    down = _holders(x.select(F.col("low").alias("s")).distinct(), y.select(F.col("low").alias("l")).distinct()).select(F.col("s").alias("x"), F.col("l").alias("y"))
    up = _holders(y.select(F.col("low").alias("s")).distinct(), x.select(F.col("low").alias("l")).distinct()).select(F.col("l").alias("x"), F.col("s").alias("y"))
    held = cut(down.union(up).distinct())
    words = lambda df, c: df.select(F.col("low").alias(c), F.array_sort(F.array_distinct(F.filter(F.split("low", r"\s+"), lambda w: w != ""))).alias("w")).distinct()
    pairs = lambda df, c: df.select(c, F.explode(F.flatten(F.transform("w", lambda v, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda u: F.struct(v.alias("v"), u.alias("u")))))).alias("p"))
    rest = words(x, "x").join(held.select("x").distinct().hint("merge"), "x", "left_anti")
    common = pairs(rest, "x").join(pairs(words(y, "y"), "y").hint("merge"), "p").select("x", "y").distinct()
    both = held.withColumn("inside", F.lit(True)).union(common.withColumn("inside", F.lit(False)))
    named = both.join(x.select("name", F.col("low").alias("x")).hint("merge"), "x").join(y.select(F.col("name").alias("match"), F.col("low").alias("y")).hint("merge"), "y")
    return named.select("name", "match", "inside")


def any_term(column: str, terms: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(column), t))


def matched_histories(games: DataFrame, mapping: DataFrame, master: DataFrame) -> DataFrame:
    """team, opponent, date, gf, ga, matched: games of the master's teams, also those under a name that is mapped to one of them.

    games: game_id, date, team_a, team_b, score_a, score_b; mapping: name, match; master: name. Of games alike in date, team and opponent one
    stays: of mapped names before the own one, side A before side B, then by game_id. Teams that no game names themselves are not ranked.

    The games are read once, with the names of all listed teams: whether a game names a team itself is kept beside the game that stays.
    """
    side = lambda me, you, mine, theirs, nth: F.struct(F.col(me).alias("name"), F.col(you).alias("opponent"), F.col(mine).alias("gf"), F.col(theirs).alias("ga"), F.lit(nth).alias("side"))
    sides = games.select("game_id", "date", F.explode(F.array(side("team_a", "team_b", "score_a", "score_b", 0), side("team_b", "team_a", "score_b", "score_a", 1))).alias("s")).select("game_id", "date", "s.*")
    listed = master.select("name").distinct()
    other = mapping.where("name <> match").join(listed.withColumnRenamed("name", "match"), "match", "left_semi").select("name", F.col("match").alias("team"), F.lit(False).alias("own"))
    rows = join_counted(sides, other.union(listed.select("name", F.col("name").alias("team"), F.lit(True))), ["name"])
    first = F.min(F.struct("own", "side", "game_id", "name", "gf", "ga")).alias("g")
    kept = cut(rows.groupBy("date", "team", "opponent").agg(first, F.max("own").alias("named")).select("team", "opponent", "date", "g.gf", "g.ga", (~F.col("g.own")).alias("matched"), "named"))
    return join_counted(kept.drop("named"), kept.where("named").select("team").distinct(), ["team"], "left_semi").select("team", "opponent", "date", "gf", "ga", "matched")
