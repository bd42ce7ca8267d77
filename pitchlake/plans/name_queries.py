"""Queries over names, master lists and aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pitchlake.functions import names as N
from pitchlake.functions import similarity as M
from pitchlake.operators import matching, quality, reshape, similarity_join
from pitchlake.operators.numbering import numbered
from pitchlake.operators.pairs import join_counted
from pitchlake.operators.sos import cut
from pitchlake.plans import rosters as X
from pitchlake.plans.league_queries import BASE, QUERIES, SQL, query, r6
from pitchlake.sources import readers
from pitchlake.sources.league import read

__all__ = ["QUERIES", "SQL"]

SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _nested(inner: str, pairs) -> str:
    for a, b in pairs:
        inner = f"replace({inner}, '{a}', '{b}')"
    return inner


def _regex(inner: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        inner = f"regexp_replace({inner}, '{a}', '{b}', 'g')"
    return inner


def _guarded(inner: str) -> str:
    """Letters and digits beyond ASCII between marks that are ASCII letters: no word ends beside them, as for Spark's (?U)."""
    return f"regexp_replace(regexp_replace({inner}, '([^\\x00-\\x7F])', 'qzq\\1qzq', 'g'), 'qzq([^\\p{{L}}\\p{{N}}])qzq', '\\1', 'g')"


def _bare(inner: str) -> str:
    return f"replace({inner}, 'qzq', '')"


BASIC = SQUEEZE.format(_regex("lower(coalesce(name, ''))", ("[^a-z0-9 ]", "")))
_LETTERS = _nested("coalesce(name, '')", N.LIGATURES)
LIGHT = SQUEEZE.format(_regex(f"lower(regexp_replace(translate({_LETTERS}, '{N.ACCENTED}', '{N.PLAIN}'), '[^\\x00-\\x7F]', '', 'g'))", ("[^a-z0-9 ]", " ")))
_WHOLE = "trim(lower(name))"
_CANON = SQUEEZE.format(_nested(_regex(_guarded(_WHOLE), ("\\s+\\((h|a)\\)$", ""), ("\\bsc\\b|\\bfc\\b|\\bacademy\\b", "")), [("boys", ""), ("girls", ""), ("b14", "2014"), ("b15", "2015")]))
CANON = f"case when {_WHOLE} in ({', '.join(repr(c) for c in N.COLOUR_TEAMS)}) then {_WHOLE} else {_bare(f"trim(regexp_replace({_CANON}, '\\s+(blue|red|white|black|gold|maroon|green|navy|silver|grey|gray)$', ''))")} end"


def _division_sql() -> str:
    s = _WHOLE
    for p in ("fc ", "sc ", "soccer club ", "football club "):
        s = f"regexp_replace({s}, '^{p}', '')"
    return SQUEEZE.format(_nested(s, [(w, "") for w in (" boys", " girls", " fc", " sc", " academy")]))


def _team_sql(column: str = "name", prefixes: dict | None = None, season: int = 2026) -> str:
    s = f"trim(lower({column}))"
    if prefixes:
        s = "case " + " ".join(f"when starts_with({s}, '{v}') then '{club}' || substr({s}, {len(v) + 1})" for club, vs in prefixes.items() for v in vs) + f" else {s} end"
    s = _regex(_nested(_guarded(s), N.SUBSTITUTIONS), ("\\b20(\\d{2})\\b", "\\1"), *[(f"\\bu{a}\\b", str(season - a)[2:]) for a in range(10, 20)], ("\\b(\\d{2})[bg]\\b", "\\1"), ("\\b20(\\d{2})[bg]\\b", "\\1"), ("\\b(boys?|girls?|male|female|men|women|b|g)\\b", ""), ("[^\\p{L}\\p{N}_\\s]", " "))
    return _bare(SQUEEZE.format(s))


def _matcher_club_sql() -> str:
    s = "trim(lower(name))"
    for suffix in N.CLUB_SUFFIXES:
        s = f"trim(regexp_replace({s}, ' {suffix}$', ''))"
    for p in ("the ", "fc ", "sc "):
        s = f"trim(regexp_replace({s}, '^{p}', ''))"
    return SQUEEZE.format(_regex(s, ("[^\\p{L}\\p{N}_\\s]", "")))


for _name, _column, _sql in (
    ("norm_basic", lambda: N.basic_name("name"), BASIC),
    ("norm_light", lambda: N.light_name("name"), LIGHT),
    ("norm_canonical", lambda: N.canonical_name("name"), CANON),
    ("norm_u11", lambda: N.division_name("name"), _division_sql()),
    ("norm_aggressive", lambda: N.team_name("name"), _team_sql()),
    ("norm_prefixed", lambda: N.team_name("name", X.PREFIXES), _team_sql(prefixes=X.PREFIXES)),
    ("norm_club", lambda: N.club_name("name"), _bare(SQUEEZE.format(_regex(_nested(_guarded("trim(lower(name))"), N.CLUB_SUBSTITUTIONS), ("\\b(fc|sc|ac|acad|prem|elite|sel|united|city|assoc|ath)\\b", ""))))),
    ("club_norm", lambda: N.matcher_club(F.col("name")), _matcher_club_sql()),
):
    def _normalised(spark, sf_dir, column=_column):
        names = X.observed(spark, sf_dir).union(X.master(spark, sf_dir).withColumn("ord", F.lit(-1).cast("long")))
        return names.select("ord", "name", column().alias("normalised"))

    query(_name, f"with {X.ALL_SQL}, n as (select * from observed union all select -1, name from master) select ord, name, {_sql} as normalised from n")(_normalised)


_LOW = SQUEEZE.format(_guarded("lower(name)"))
_PAD = "' ' || s || ' '"
_YEAR2 = "case when {0} = '' then null when {0}::int <= 30 then '20' || {0} when {0}::int between 80 and 99 then '19' || {0} end"
_U = "regexp_extract(s, '\\bu(\\d{1,2})\\b', 1)"
_BIRTH = f"coalesce(nullif(regexp_extract(s, '\\b(20\\d{{2}})(?:[a-zA-Z]|\\b)', 1), ''), case when {_U} <> '' and {_U}::int between 10 and 19 then (2026 - {_U}::int)::varchar end, " + _YEAR2.format("regexp_extract(s, '\\b(\\d{2})\\b', 1)") + ", " + _YEAR2.format("regexp_extract(s, '\\b(\\d{2})[bg]\\b', 1)") + ", '')"
_WORDS = lambda words: "(" + " or ".join(f"contains({_PAD}, ' {w} ')" for w in words) + ")"
_MARK = "regexp_extract(s, '\\b\\d{2,4}([bg])\\b', 1)"
_GENDER = f"case when {_WORDS(['boys', 'b', 'male', 'm'])} then 'boys' when {_WORDS(['girls', 'g', 'female', 'f'])} then 'girls' when {_MARK} = 'b' then 'boys' when {_MARK} = 'g' then 'girls' else '' end"
_ROMAN = "regexp_extract(s, '\\b(i|ii|iii|iv|v|vi|vii|viii|ix|x)\\b', 1)"
_LETTER, _NUMBER = "regexp_extract(s, '\\b([a-z])\\b', 1)", "regexp_extract(s, '\\b(\\d+)\\b', 1)"
_FIRST = lambda words: "case " + " ".join(f"when contains({_PAD}, ' {w} ') then '{w}'" for w in words) + " end"
_DESIGNATION = f"coalesce(case {_ROMAN} " + " ".join(f"when '{k}' then '{v}'" for k, v in N.ROMAN.items()) + f" end, case when {_LETTER} not in ('', 'b', 'g') then {_LETTER} end, case when {_NUMBER} <> '' and length({_NUMBER}) <> 4 and not (length({_NUMBER}) = 2 and {_NUMBER}::int <= 30) then {_NUMBER} end, {_FIRST(N.DESIGNATIONS)}, '')"


@query("extract_fields", f"with {X.ALL_SQL}, n as (select ord, name, {_LOW} as s from observed) select ord, name, {_BIRTH} as birth_year, {_GENDER} as gender, {_DESIGNATION} as designation, coalesce({_FIRST(N.STATES)}, '') as state from n")
def extract_fields(spark, sf_dir):
    rows = X.observed(spark, sf_dir).withColumn("p", N.parsed("name"))
    return rows.select("ord", "name", "p.birth_year", "p.gender", "p.designation", "p.state")


@query("parse_team_name")
def parse_team_name(spark, sf_dir):
    return X.observed(spark, sf_dir).select("ord", N.parsed("name").alias("p")).select("ord", "p.*")


def _normalised_lists(spark, sf_dir):
    """Distinct observed names and the master list, both normalised.

    Names repeat, and a small file is one task's, so the different names are cut first: the planner drops a distinct below another one.
    """
    different = cut(X.observed(spark, sf_dir).select("name").distinct())
    return different.select(N.team_name("name").alias("name")).distinct(), X.master(spark, sf_dir).select("ord", N.team_name("name").alias("name"))


_STOP = "[" + ", ".join(f"'{w}'" for w in N.GENERIC_TOKENS) + "]"
_TOKENS = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: length(w) > 1 and not list_contains({_STOP}, w)))"


#: The share of meaningful tokens from which the resolver takes two names for alike.
OVERLAP = 0.75


@query("token_jaccard", f"with {X.ALL_SQL}, o as (select distinct {_team_sql()} as name from observed), m as (select ord, {_team_sql()} as match from master), t as (select *, {_TOKENS('name')} as x, {_TOKENS('match')} as y from o, m), j as (select *, len(list_intersect(x, y)) as i from t) select name, match, ord, round(case when len(x) + len(y) = 0 then 1.0::double else i::double / (len(x) + len(y) - i) end, 6) as jaccard from j where i >= {OVERLAP} * (len(x) + len(y) - i)")
def token_jaccard(spark, sf_dir):
    o, m = _normalised_lists(spark, sf_dir)
    return similarity_join.jaccard_join(o, m.withColumnRenamed("name", "match"), OVERLAP).select("name", "match", "ord", F.round("overlap", 6).alias("jaccard"))


@query("indel_ratio")
def indel_ratio(spark, sf_dir):
    """Pairs with a token-sorted ratio of 0.9 and more."""
    o, m = _normalised_lists(spark, sf_dir)
    return similarity_join.indel_join(o, m.withColumnRenamed("name", "match"), 0.9, N.sorted_tokens).select("name", "match", "ord", *r6("ratio"))


@query("hybrid_topk")
def hybrid_topk(spark, sf_dir):
    o, m = _normalised_lists(spark, sf_dir)
    return matching.hybrid_candidates(o, m).select("name", "match", F.round("score", 6).alias("score"), "nth")


@query("unmatched_review")
def unmatched_review(spark, sf_dir):
    o, m = _normalised_lists(spark, sf_dir)
    return matching.review_rows(matching.hybrid_candidates(o, m)).select("name", "top_candidates", *r6("best_score"))


@query("blocked_best_match")
def blocked_best_match(spark, sf_dir):
    return matching.best_master(X.observed(spark, sf_dir), X.master(spark, sf_dir)).select("name", "match", *r6("score"))


@query("audit_match_bands")
def audit_match_bands(spark, sf_dir):
    return quality.audit_bands(matching.best_master(X.observed(spark, sf_dir), X.master(spark, sf_dir)))


def named_parts(spark, sf_dir):
    """ord, name: the observed names that can play."""
    return X.observed(spark, sf_dir).where("ord >= 0 and name <> ''")


def name_games(spark, sf_dir, names=None):
    """game_id, date, team_a, team_b, score_a, score_b: games between observed names; a part's name plays that of the part l_suppkey + 1 further.

    names: ord, name; what stands for the name of each part, if not the observed name.
    """
    names = named_parts(spark, sf_dir) if names is None else names
    parts = read(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("n"))
    lines = read(spark, sf_dir, "lineitem").crossJoin(F.broadcast(parts))  # one row
    other = F.pmod(F.col("l_partkey") + F.col("l_suppkey") + 1, F.col("n"))
    rows = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("game_id"), F.col("l_shipdate").alias("date"), F.col("l_partkey").alias("ka"), other.alias("kb"), (F.floor("l_quantity") % 7).alias("score_a"), (F.floor("l_extendedprice") % 6).alias("score_b"))
    side = lambda c, k: names.select(F.col("ord").alias(k), F.col("name").alias(c))
    return rows.join(side("team_a", "ka"), "ka").join(side("team_b", "kb"), "kb").drop("ka", "kb")


@query("matched_histories")
def matched_histories(spark, sf_dir):
    """Histories of master teams over their own games and those under names that the strict matcher maps to them.

    Games are shuffled with the names' numbers, which are in the order of the names; the names come back to the games that stay.
    """
    names, master = cut(named_parts(spark, sf_dir)), cut(X.master(spark, sf_dir))
    mapping = matching.best_master(X.observed(spark, sf_dir), master)
    number = cut(numbered(names.select("name").union(master.select("name")).where("name is not null").distinct(), ["name"], "id"))
    of = lambda c: number.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    coded = lambda df, *cs: reduce(lambda d, c: d.join(of(c), c), cs, df).select(*[F.col(f"{c}_id").alias(c) if c in cs else c for c in df.columns])
    games = name_games(spark, sf_dir, cut(coded(names, "name")))
    rows = matching.matched_histories(games, coded(mapping.select("name", "match"), "name", "match"), coded(master.select("name"), "name"))
    for c in ("team", "opponent"):
        rows = join_counted(rows.withColumnRenamed(c, "id"), number, ["id"]).drop("id").withColumnRenamed("name", c)
    return rows.select("team", "opponent", "date", "gf", "ga", "matched")


@query("exact_or_fuzzy")
def exact_or_fuzzy(spark, sf_dir):
    return matching.exact_or_fuzzy(X.observed(spark, sf_dir), X.master(spark, sf_dir)).select("name", "match", "match_type", *r6("score"))


@query("alias_resolve")
def alias_resolve(spark, sf_dir):
    return matching.resolve(X.observed(spark, sf_dir), X.aliases(spark, sf_dir), X.master(spark, sf_dir)).select("name", "canonical", *r6("confidence"), "source")


@query("alias_cache", f"with {X.ALL_SQL}, o as (select distinct name, {_team_sql()} as key from observed), a as (select {_team_sql('alias_name')} as key, canonical_team_name, confidence from aliases) select name, canonical_team_name as canonical, confidence from o join a using (key)")
def alias_cache(spark, sf_dir):
    o = X.observed(spark, sf_dir).select("name", N.team_name("name").alias("key")).distinct()
    a = X.aliases(spark, sf_dir).select(N.team_name("alias_name").alias("key"), F.col("canonical_team_name").alias("canonical"), "confidence")
    return o.join(a, "key").select("name", "canonical", "confidence")


@query("alias_replace", f"with {X.ALL_SQL}, n as (select alias_name as name from aliases union all select name from observed) select n.name as raw, coalesce(canonical_team_name, n.name) as name from n left join aliases on alias_name = n.name")
def alias_replace(spark, sf_dir):
    a = X.aliases(spark, sf_dir)
    n = a.select(F.col("alias_name").alias("name")).union(X.observed(spark, sf_dir).select("name")).withColumn("raw", F.col("name"))
    return matching.replaced(n, "name", a).select("raw", "name")


@query("anti_join_new", f"with {X.ALL_SQL}, o as (select distinct name, {_team_sql()} as key from observed) select name, key from o where key not in (select {_team_sql('alias_name')} from aliases)")
def anti_join_new(spark, sf_dir):
    o = X.observed(spark, sf_dir).select("name").distinct().withColumn("key", N.team_name("name"))
    return o.join(X.aliases(spark, sf_dir).select(N.team_name("alias_name").alias("key")).distinct(), "key", "left_anti").select("name", "key")


@query("name_map_left", f"with {X.ALL_SQL}, o as (select name, {CANON} as key from observed), m as (select name as canonical, {CANON} as key from master) select o.name, canonical from o left join m using (key)")
def name_map_left(spark, sf_dir):
    o = X.observed(spark, sf_dir).select("name", N.canonical_name("name").alias("key"))
    return o.join(X.master(spark, sf_dir).select(F.col("name").alias("canonical"), N.canonical_name("name").alias("key")), "key", "left").select("name", "canonical")


@query("alignment", f"with {X.ALL_SQL}, o as (select distinct {CANON} as key from observed), m as (select distinct {CANON} as key from master) select key, 'left' as side from o where key not in (select key from m) union all select key, 'right' from m where key not in (select key from o)")
def alignment(spark, sf_dir):
    return quality.alignment(X.observed(spark, sf_dir).select(N.canonical_name("name").alias("key")), X.master(spark, sf_dir).select(N.canonical_name("name").alias("key")), "key")


@query("mapping_audit", "select count(*) as n, count(distinct p_name) as n_raw, count(distinct p_brand) as n_canonical, count(*) - count(distinct p_name) as duplicates from part")
def mapping_audit(spark, sf_dir):
    return quality.mapping_audit(read(spark, sf_dir, "part"), "p_name", "p_brand")


@query("team_id", "select s_suppkey as team, substr(sha1('az_boys_u11:' || s_name), 1, 12) as team_id, true as valid from supplier")
def team_id(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team"), N.team_id("az_boys_u11", "s_name").alias("team_id"))
    return s.withColumn("valid", N.is_team_id("team_id"))


@query("unmatched_categories", f"with {X.ALL_SQL}, c as (select case when regexp_matches({_guarded('lower(name)')}, '{reshape.OTHER_AGE}') then 'AGE_MISMATCH' when regexp_matches({_guarded('lower(name)')}, '{reshape.OTHER_STATE}') then 'OUT_OF_STATE' else 'UNKNOWN_MISC' end as category from observed) select category, count(*) as n from c group by 1")
def unmatched_categories(spark, sf_dir):
    return X.observed(spark, sf_dir).groupBy(reshape.unmatched_category("name").alias("category")).agg(F.count("*").alias("n"))


@query("confidence_hist", f"with {X.ALL_SQL} select count(*) as n, count(*) filter (confidence >= 0.9) as high, count(*) filter (confidence >= 0.8 and confidence < 0.9) as middle, count(*) filter (confidence < 0.8) as low, round(avg(confidence), 6) as mean, round(quantile_cont(confidence, 0.5), 6) as median, min(confidence) as least, max(confidence) as most from aliases")
def confidence_hist(spark, sf_dir):
    return quality.confidence_bands(X.aliases(spark, sf_dir)).select("n", "high", "middle", "low", *r6("mean", "median"), "least", "most")


@query("low_confidence", f"with {X.ALL_SQL} select * from aliases where confidence < 0.8 order by confidence")
def low_confidence(spark, sf_dir):
    return X.aliases(spark, sf_dir).where("confidence < 0.8").orderBy("confidence")


@query("keep_first_dedupe", "select p_name, p_partkey, p_brand from (select *, row_number() over (partition by p_name order by p_partkey) as n from part) where n = 1")
def keep_first_dedupe(spark, sf_dir):
    return matching.keep_first(read(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], ["p_partkey"])


_SPLIT = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"


_TERMS_SQL = "terms as (select distinct club as name from teams_of_parts union select distinct place || ' ' || club from teams_of_parts union select s_name from supplier)"


@query("containment_search", f"with {X.ALL_SQL}, {_TERMS_SQL}, p as (select o.name, m.name as match, contains(lower(o.name), lower(m.name)) or contains(lower(m.name), lower(o.name)) as inside, len(list_intersect({_SPLIT('lower(o.name)')}, {_SPLIT('lower(m.name)')})) as n from terms o, master m), q as (select *, bool_or(inside) over (partition by name) as found from p) select name, match, inside from q where inside or not found and n >= 2")
def containment_search(spark, sf_dir):
    """Search terms, a club or a place and a club, in the master list."""
    t = X.teams_of_parts(spark, sf_dir)
    terms = t.select(F.col("club").alias("name")).union(t.select(F.concat_ws(" ", "place", "club"))).union(read(spark, sf_dir, "supplier").select("s_name"))
    return matching.contains_either(terms, X.master(spark, sf_dir).select("name"))


@query("any_term_search", "select p_partkey, p_name from part where contains(lower(p_name), 'ring') or contains(lower(p_name), 'bolt')")
def any_term_search(spark, sf_dir):
    return read(spark, sf_dir, "part").where(matching.any_term("p_name", ["ring", "bolt"])).select("p_partkey", "p_name")


@query("age_detection", f"with {X.ALL_SQL} select name, case when contains(lower(name), '2015') or contains(lower(name), 'u10') then 'U10' else 'U11' end as age from observed")
def age_detection(spark, sf_dir):
    return X.observed(spark, sf_dir).select("name", reshape.age_from_text("name").alias("age"))


@query("club_heuristic", f"with {X.ALL_SQL}, w as (select name, regexp_split_to_array(trim(name), '\\s+') as ws from observed), p as (select *, list_position(list_transform(ws, lambda x: regexp_matches(x, '[0-9]')), true) as pos from w) select name, array_to_string(case when pos > 0 then ws[1:pos - 1] else ws end, ' ') as club from p")
def club_heuristic(spark, sf_dir):
    return X.observed(spark, sf_dir).select("name", reshape.leading_words("name").alias("club"))


@query("distinct_names", BASE + "select distinct t.name from (select team_a as team from games union select team_b from games) join teams t using (team)")
def distinct_names(spark, sf_dir):
    from pitchlake.sources import league

    lg = league.load(spark, sf_dir)
    ids = readers.distinct_names(lg.games).select(F.col("name").alias("team"))
    return ids.join(lg.teams, "team").select("name")


@query("master_from_games", BASE + "select distinct team_a::varchar as name from games union select distinct team_b::varchar from games")
def master_from_games(spark, sf_dir):
    from pitchlake.sources import league

    return readers.master_from_games(league.games(spark, sf_dir))


_AGES = "(values (10), (11), (12)) a(age)"


@query("division_registry", f"select lower(n_name) || '_' || (case when n_nationkey % 2 = 0 then 'boys' else 'girls' end) || '_u' || age as division, age, case when n_nationkey % 2 = 0 then 'm' else 'f' end as gender, n_name as state, n_regionkey > 0 as active, n_name || '_' || (case when n_nationkey % 2 = 0 then 'Boys' else 'Girls' end) || '_U' || age as canonical from nation, {_AGES}")
def division_registry(spark, sf_dir):
    """A registry file for each nation, written as JSON text and scanned."""
    boys = F.col("n_nationkey") % 2 == 0
    entry = F.struct("age", F.when(boys, "m").otherwise("f").alias("gender"), F.col("n_name").alias("state"), F.concat(F.lit("https://example.org/"), "n_nationkey").alias("url"), (F.col("n_regionkey") > 0).alias("active"))
    key = F.concat_ws("_", F.lower("n_name"), F.when(boys, "boys").otherwise("girls"), F.concat(F.lit("u"), "age"))
    rows = read(spark, sf_dir, "nation").withColumn("age", F.explode(F.array(F.lit(10), F.lit(11), F.lit(12))))
    texts = rows.groupBy("n_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, entry)))).alias("text"))  # three ages a nation
    return readers.registry_rows(texts, "text").select("division", "age", "gender", "state", "active", "canonical")
