"""Queries over the league, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.functions import scores as S
from pitchlake.operators import elo, graph, quality, ratings, reshape, serving, sos
from pitchlake.operators.numbering import numbered
from pitchlake.sources import league
from pitchlake.sources.league import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = """with recursive ns as (select count(*)::bigint as c from supplier),
games as (select l_orderkey * 10 + l_linenumber as game_id, l_shipdate as date, l_suppkey as team_a, (l_suppkey + 1 + l_partkey % (c - 1)) % c as team_b,
  floor(l_quantity)::bigint % 7 as score_a, floor(l_extendedprice)::bigint % 6 as score_b, l_returnflag as event from lineitem, ns),
teams as (select s_suppkey as team, s_name as name, n_name as state, case when s_nationkey % 2 = 0 then 'U10' else 'U11' end as age from supplier left join nation on s_nationkey = n_nationkey),
today as (select max(l_shipdate) as d from lineitem),
long as (select game_id, team_a as team, team_b as opponent, score_a as gf, score_b as ga, true as is_home, date, event from games
  union all select game_id, team_b, team_a, score_b, score_a, false, date, event from games),
res as (select *, case when gf > ga then 'W' when gf < ga then 'L' else 'T' end as result from long),
win as (select res.* from res, today where date >= d - interval 365 day),
ranked as (select *, row_number() over (partition by team order by date desc, game_id desc, opponent, gf, ga) as rn, count(*) over (partition by team) as used from win),
rec as (select *, least(used, 30) as n from ranked where rn <= 30),
margin as (select *, greatest(-6, least(6, gf - ga)) as m from rec)
"""
#: Further steps, appended where a query needs them.
STATS = """, stats as (select r.team, count(*) as games_played, count(*) filter (result = 'W') as wins, count(*) filter (result = 'L') as losses, count(*) filter (result = 'T') as ties,
  avg(case when result = 'W' then 1.0::double else 0.0::double end) as win_percentage, sum(gf)::bigint as goals_for, sum(ga)::bigint as goals_against, sum(m)::bigint as goal_differential,
  0.5::double * coalesce(avg(case when result = 'W' then 1.0::double else 0.0::double end) filter (rn <= 15), 0) + 0.35::double * coalesce(avg(case when result = 'W' then 1.0::double else 0.0::double end) filter (rn between 16 and 25), 0)
   + 0.15::double * coalesce(avg(case when result = 'W' then 1.0::double else 0.0::double end) filter (rn between 26 and 30), 0) as recent_win_pct,
  count(*) filter (a.age <> b.age) as cross_age_games, count(*) filter (a.state <> b.state) as cross_state_games, max(date) as last_game_date,
  sum(gf)::double / count(*) as offense, sum(ga)::double / count(*) as defense
  from margin r join teams a on a.team = r.team join teams b on b.team = r.opponent group by r.team),
hist as (select team, count(*) as total_games_history from res group by team)
"""
SOS_EDGES = """, edge as (select r.team, r.opponent, a.age <> b.age as cross_age,
  sum(case result when 'W' then least(1.6::double, 1 + 0.1::double * m) when 'L' then greatest(0.4::double, 1 - 0.1::double * abs(m)) else 1.0::double end) as w
  from margin r join teams a on a.team = r.team join teams b on b.team = r.opponent group by all),
mu as (select avg(win_percentage) as mu from stats), s0 as (select team, win_percentage as s from stats)
"""


def _steps(n: int) -> str:
    return "".join(
        f""", p{k} as (select e.team, sum(w * case when cross_age and coalesce(s, 0.35::double) > mu then coalesce(s, 0.35::double) * least(1 + 0.05::double * (coalesce(s, 0.35::double) - mu) / mu, 1.10::double) else coalesce(s, 0.35::double) end) as num, sum(w) as den
  from edge e left join s{k} o on o.team = e.opponent, mu group by e.team),
s{k + 1} as (select x.team, case when den > 0 then 0.7::double * s + 0.3::double * num / den else s end as s from s{k} x left join p{k} p on p.team = x.team)"""
        for k in range(n)
    )


_Z = ", sos as (select team, coalesce((s - avg(s) over ()) / nullif(stddev_pop(s) over (), 0), 0) as sos_score from {})\n"
SOS = SOS_EDGES + _steps(3) + _Z.format("s3")
#: Ten steps at most; the first after which no strength moved by 0.01 counts.
SOS_SETTLED = SOS_EDGES + _steps(10).replace(" as (select", " as materialized (select") + ", moved as (" + " union all ".join(f"select {k} as k, max(abs(a.s - b.s)) as m from s{k} a join s{k - 1} b using (team)" for k in range(1, 11)) + "), chosen as (select coalesce(min(k) filter (m < 0.01), 10) as k from moved), settled as (" + " union all ".join(f"select team, s from s{k}, chosen where k = {k}" for k in range(1, 11)) + ")" + _Z.format("settled")
POWER = """, sh as (select *, (games_played * offense + 8 * avg(offense) over ()) / (games_played + 8) as offense_adj, (games_played * defense + 8 * avg(defense) over ()) / (games_played + 8) as defense_adj from stats join sos using (team)),
nm as (select *, 1 / (1 + exp(-(offense_adj - avg(offense_adj) over ()) / (1.5::double * stddev_samp(offense_adj) over ()))) as offense_norm,
  1 - 1 / (1 + exp(-(defense_adj - avg(defense_adj) over ()) / (1.5::double * stddev_samp(defense_adj) over ()))) as defense_norm,
  1 / (1 + exp(-(sos_score - avg(sos_score) over ()) / (1.5::double * stddev_samp(sos_score) over ()))) as sos_norm from sh),
pw as (select *, 0.2::double * offense_norm + 0.2::double * defense_norm + 0.6::double * sos_norm as power_score, least(1.0::double, sqrt(games_played / 20.0::double)) as games_penalty from nm),
power as (select *, power_score * games_penalty as power_score_adj from pw)
"""
WEIGHTED = """, wt as (select *, ga + m as gf_capped, case when n <= 10 then 1.0::double / n
  when n <= 25 then case when rn <= 10 then 0.07::double else 0.30::double / (n - 10) end
  else case when rn <= n - 25 then 0.07::double * case when n = 26 then 0.8::double else 0.8::double - 0.4::double * (n - 25 - rn) / (n - 26) end when rn <= n - 15 then 0.07::double else 0.02::double end
   / (1 + 0.07::double * case when n = 26 then 0.8::double else 0.6::double * (n - 25) end) end as w from margin),
od as (select team, sum(w * gf_capped) as off_raw, sum(w * ga) as def_raw, count(*) as games_played from wt group by team)
"""
STRENGTH = """, mm as (select *, round((off_raw - min(off_raw) over ()) / (max(off_raw) over () - min(off_raw) over ()), 3) as off_norm, round((def_raw - min(def_raw) over ()) / (max(def_raw) over () - min(def_raw) over ()), 3) as def_norm from od),
st as (select *, greatest(0.67::double, least(1.5::double, 1 / greatest(0.15::double, least(0.95::double, off_norm)))) as opp_off, greatest(0.67::double, least(1.5::double, 1 / greatest(0.15::double, least(0.95::double, def_norm)))) as opp_def from mm)
"""
ADJUSTED = """, ad0 as (select g.*, coalesce(o.opp_def, (select avg(opp_def) from st)) as odef, coalesce(o.opp_off, (select avg(opp_off) from st)) as ooff, t.off_norm as t_off,
  1 / (1 + sqrt(greatest(0.0::double, coalesce(t.off_norm, 0.5::double) - coalesce(o.off_norm, 0.5::double)))) * least(1.0::double, pow(used / 8.0::double, 0.6::double)) as adaptive_k
  from ranked g left join st t on t.team = g.team left join st o on o.team = g.opponent),
ad1 as (select *, (gf - ga) - (t_off - odef) as perf_delta, gf * odef * adaptive_k as adj_gf_base, ga * ooff * adaptive_k as adj_ga_base from ad0),
ad2 as (select *, 1 + 0.15::double * sign(perf_delta) * exp(-0.08::double * least(30, rn - 1)) * case when abs(perf_delta) >= 1 then 1.0::double else 0.0::double end as perf_factor from ad1),
ad as (select *, adj_gf_base * perf_factor as adj_gf, adj_ga_base * (2 - perf_factor) as adj_ga from ad2)
"""
GUARD = """, zs as (select *, avg(adj_gf) over (partition by team) as mg, avg(adj_ga) over (partition by team) as ma, stddev_samp(adj_gf) over (partition by team) as sg, stddev_samp(adj_ga) over (partition by team) as sa from ad),
z as (select *, case when used > 1 then greatest(mg - 2.5::double * case when sg > 0 then sg else 1 end, least(mg + 2.5::double * case when sg > 0 then sg else 1 end, adj_gf)) else adj_gf end as gf_z,
  case when used > 1 then greatest(ma - 2.5::double * case when sa > 0 then sa else 1 end, least(ma + 2.5::double * case when sa > 0 then sa else 1 end, adj_ga)) else adj_ga end as ga_z from zs)
"""
SAO = """, sao as (select z.team, sum(wt.w * gf_z) as sao_raw, 1 / (sum(wt.w * ga_z) + 0.25::double) as sad_raw, count(*) as games_played from z join (select distinct team, rn, w from wt) wt on wt.team = z.team and wt.rn = z.rn group by z.team)
"""
BASE_STRENGTH = """, h0 as (select res.* from res, today where date >= d - interval 540 day),
h1 as (select * from (select *, row_number() over (partition by team, date, opponent order by game_id, is_home desc, gf, ga) as nth from h0) where nth = 1),
bs0 as (select team, sum(gf)::double / count(*) as off_strength, sum(ga)::double / count(*) as def_strength from h1 group by team),
bs as (select *, 0.5::double * ((off_strength - min(off_strength) over ()) / (max(off_strength) over () - min(off_strength) over ()) + (def_strength - min(def_strength) over ()) / (max(def_strength) over () - min(def_strength) over ())) as base_strength from bs0),
he as (select h1.team, h1.opponent, date, gf, ga, coalesce(o.base_strength, 0.5::double) as opponent_base_strength, coalesce(t.off_strength, (select avg(off_strength) from bs)) - coalesce(o.def_strength, (select avg(def_strength) from bs)) as expected_gd
  from h1 left join bs t on t.team = h1.team left join bs o on o.team = h1.opponent),
hist_rows as (select *, gf - ga - expected_gd as gd_delta from he)
"""


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def r6(*names: str) -> list[Column]:
    """Rounded as binary doubles: a value just under a half in the seventh place goes down."""
    return [S.rounded(n, 6).alias(n) for n in names]


def _long(spark: SparkSession, sf_dir: str) -> tuple[league.League, DataFrame]:
    lg = league.load(spark, sf_dir)
    return lg, reshape.unpivot(lg.games)


def _recent(spark: SparkSession, sf_dir: str) -> tuple[league.League, DataFrame]:
    lg, long = _long(spark, sf_dir)
    return lg, ratings.recent(long, lg.as_of)


@query("rank_by_record", BASE + """, t as (select team, count(*) as games_played, count(*) filter (result = 'W') as wins, count(*) filter (result = 'L') as losses, count(*) filter (result = 'T') as ties, sum(gf)::bigint as goals_for, sum(ga)::bigint as goals_against,
  sum(gf - ga)::bigint as goal_diff, avg(case result when 'W' then 1.0::double when 'L' then 0.0::double else 0.5::double end) as win_pct from rec group by team)
select row_number() over (order by win_pct desc, goal_diff desc, t.team) as rank, t.team, name, games_played, wins, losses, ties, goals_for, goals_against, goal_diff, round(win_pct, 6) as win_pct from t join teams using (team)""")
def rank_by_record(spark, sf_dir):
    lg, recent = _recent(spark, sf_dir)
    table = ratings.ranked(ratings.record(recent), [F.desc("win_pct"), F.desc("goal_diff"), F.col("team")]).join(lg.teams.select("team", "name"), "team")
    return table.select(F.col("rank").cast("long").alias("rank"), "team", "name", "games_played", "wins", "losses", "ties", "goals_for", "goals_against", "goal_diff", *r6("win_pct"))


@query("unpivot_long", BASE + "select game_id, team, opponent, gf, ga, is_home, date, event, result from res")
def unpivot_long(spark, sf_dir):
    return _long(spark, sf_dir)[1].select("game_id", "team", "opponent", "gf", "ga", "is_home", "date", "event", "result")


@query("perspective_results", BASE + "select team, is_home, result, case result when 'W' then 'L' when 'L' then 'W' else 'T' end as opponent_result, count(*) as n from res group by all")
def perspective_results(spark, sf_dir):
    return _long(spark, sf_dir)[1].groupBy("team", "is_home", "result", reshape.invert_result("result").alias("opponent_result")).agg(F.count("*").alias("n"))


for _days in (365, 540, 180):
    def _window(spark, sf_dir, days=_days):
        lg = league.load(spark, sf_dir)
        return reshape.trailing(lg.games, lg.as_of, days).groupBy("team_a").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))

    query(f"window_{_days}", BASE + f"select team_a, count(*) as n, min(date) as first_date, max(date) as last_date from games, today where date >= d - interval {_days} day group by team_a")(_window)


@query("inactive_180", BASE + "select l.team, max(date) as last_game_date, max(date) < (select d from today) - interval 180 day as inactive from res l group by l.team")
def inactive_180(spark, sf_dir):
    lg, long = _long(spark, sf_dir)
    last = long.groupBy("team").agg(F.max("date").alias("last_game_date"))
    return last.withColumn("inactive", F.col("last_game_date") < league.days_before(lg.as_of, 180))


@query("age_group_games", BASE + """, prim as (select team from teams where age = 'U10'), known as (select team from teams where state is not null)
select distinct game_id, date, team_a, team_b, score_a, score_b, event, age from games g join teams on team = team_a where (age = 'U10' and team_a in (select team from prim)) or (team_b in (select team from prim) and team_a in (select team from known))""")
def age_group_games(spark, sf_dir):
    lg = league.load(spark, sf_dir)
    ages = lg.teams.select(F.col("team").alias("team_a"), "age")
    g = lg.games.join(ages, "team_a").select("game_id", "date", "team_a", "team_b", "score_a", "score_b", "event", "age")
    return reshape.age_group_games(g, lg.teams.where("age = 'U10'"), lg.teams.where("state is not null"), "U10")


STATS_OUT = ["team", "games_played", "wins", "losses", "ties", "goals_for", "goals_against", "goal_differential", "cross_age_games", "cross_state_games", "last_game_date", "total_games_history"]


@query("team_stats_e2", BASE + STATS + f"select {', '.join('stats.team' if c == 'team' else c for c in STATS_OUT)}, round(win_percentage, 6) as win_percentage, round(recent_win_pct, 6) as recent_win_pct, round(cross_age_games / games_played, 6) as cross_age_pct, round(cross_state_games / games_played, 6) as cross_state_pct, round(offense, 6) as offense, round(defense, 6) as defense from stats join hist using (team)")
def team_stats_e2(spark, sf_dir):
    lg, long = _long(spark, sf_dir)
    return ratings.team_stats(long, lg.teams, lg.as_of, total=league.games_of_teams(lg.games)).select(*STATS_OUT, *r6("win_percentage", "recent_win_pct", "cross_age_pct", "cross_state_pct", "offense", "defense"))


for _name, _tie in (("record_sql_variant", 0.5), ("record_fallback_variant", 0.0)):
    def _record(spark, sf_dir, tie=_tie):
        return ratings.record(_recent(spark, sf_dir)[1], tie).select("team", "games_played", "wins", "losses", "ties", "goal_diff", *r6("win_pct"))

    query(_name, BASE + f"select team, count(*) as games_played, count(*) filter (result = 'W') as wins, count(*) filter (result = 'L') as losses, count(*) filter (result = 'T') as ties, sum(gf - ga)::bigint as goal_diff, round(avg(case result when 'W' then 1.0::double when 'L' then 0.0::double else {_tie}::double end), 6) as win_pct from rec group by team")(_record)


@query("recency_weights", BASE + """select team, n, rn, round(case when n <= 10 then 1.0::double / n when n <= 25 then case when rn <= 10 then 0.07::double else 0.30::double / (n - 10) end
  else case when rn <= n - 25 then 0.07::double * case when n = 26 then 0.8::double else 0.8::double - 0.4::double * (n - 25 - rn) / (n - 26) end when rn <= n - 15 then 0.07::double else 0.02::double end / (1 + 0.07::double * case when n = 26 then 0.8::double else 0.6::double * (n - 25) end) end, 6) as w
  from (select team, rn, (team % 30 + 1)::bigint as want, least(n, want) as n from rec) where rn <= n""")
def recency_weights(spark, sf_dir):
    """Weights of each team's newest games; a team looks at 1 to 30 games by its key, so that every length occurs."""
    lg, long = _long(spark, sf_dir)
    year = ratings.weighted_recent(long, lg.as_of)
    recent = year.select("team", "rn", F.least("used", F.col("team") % 30 + 1).alias("n")).where("rn <= n")
    return recent.select("team", "n", "rn", F.round(S.recency_weight(), 6).alias("w"))


@query("off_def_raw", BASE + WEIGHTED + "select team, games_played, round(off_raw, 6) as off_raw, round(def_raw, 6) as def_raw from od")
def off_def_raw(spark, sf_dir):
    lg, long = _long(spark, sf_dir)
    return ratings.off_def(ratings.weighted_recent(long, lg.as_of)).select("team", "games_played", *r6("off_raw", "def_raw"))


def _base(spark, sf_dir):
    """(league, numbered games of the year, offense and defense): the year is sorted once and kept for what follows."""
    lg, long = _long(spark, sf_dir)
    year = ratings.numbered_year(long, lg.as_of).persist()
    return lg, year, ratings.off_def(ratings.weighted(year)).persist()


@query("opp_strength", BASE + WEIGHTED + STRENGTH + "select team, off_norm, def_norm, round(opp_off, 6) as opp_off, round(opp_def, 6) as opp_def from st")
def opp_strength(spark, sf_dir):
    return ratings.strengths(_base(spark, sf_dir)[2]).select("team", "off_norm", "def_norm", *r6("opp_off", "opp_def"))


@query("adjusted_goals", BASE + WEIGHTED + STRENGTH + ADJUSTED + "select team, count(*) as n, round(sum(adaptive_k), 6) as adaptive_k, round(sum(adj_gf_base), 6) as adj_gf_base, round(sum(adj_ga_base), 6) as adj_ga_base from ad group by team")
def adjusted_goals(spark, sf_dir):
    _, year, base = _base(spark, sf_dir)
    return ratings.adjusted_games(year, base).groupBy("team").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 6).alias(c) for c in ("adaptive_k", "adj_gf_base", "adj_ga_base")])


@query("performance_layer", BASE + WEIGHTED + STRENGTH + ADJUSTED + "select team, opponent, game_id, gf, ga, rn - 1 as games_ago, round(perf_delta, 6) as perf_delta, round(perf_factor, 6) as perf_factor, round(adj_gf, 6) as adj_gf, round(adj_ga, 6) as adj_ga from ad")
def performance_layer(spark, sf_dir):
    _, year, base = _base(spark, sf_dir)
    return ratings.adjusted_games(year, base).select("team", "opponent", "game_id", "gf", "ga", F.col("games_ago").cast("long").alias("games_ago"), *r6("perf_delta", "perf_factor", "adj_gf", "adj_ga"))


@query("zclip", BASE + WEIGHTED + STRENGTH + ADJUSTED + GUARD + "select team, count(*) as n, count(*) filter (gf_z <> adj_gf) as clipped_gf, round(sum(gf_z), 6) as gf_z, round(sum(ga_z), 6) as ga_z from z group by team")
def zclip(spark, sf_dir):
    _, year, base = _base(spark, sf_dir)
    z = S.z_clipped(ratings.adjusted_games(year, base), "team", {"gf_z": "adj_gf", "ga_z": "adj_ga"})
    return z.groupBy("team").agg(F.count("*").alias("n"), ratings.counted(F.col("gf_z") != F.col("adj_gf")).alias("clipped_gf"), *[F.round(F.sum(c), 6).alias(c) for c in ("gf_z", "ga_z")])


def _sao(spark, sf_dir):
    lg, year, base = _base(spark, sf_dir)
    return lg, year, base, ratings.sao_sad(ratings.adjusted_games(year, base)).persist()


@query("sao_sad", BASE + WEIGHTED + STRENGTH + ADJUSTED + GUARD + SAO + "select team, games_played, round(sao_raw, 6) as sao_raw, round(sad_raw, 6) as sad_raw from sao")
def sao_sad(spark, sf_dir):
    return _sao(spark, sf_dir)[3].select("team", "games_played", *r6("sao_raw", "sad_raw"))


SHRUNK = ", shr as (select *, (games_played * sao_raw + 8 * avg(sao_raw) over ()) / (games_played + 8) as sao, (games_played * sad_raw + 8 * avg(sad_raw) over ()) / (games_played + 8) as sad from sao)\n"


@query("shrink_e1", BASE + WEIGHTED + STRENGTH + ADJUSTED + GUARD + SAO + SHRUNK + "select team, round(sao, 6) as sao, round(sad, 6) as sad from shr")
def shrink_e1(spark, sf_dir):
    return S.shrunk(_sao(spark, sf_dir)[3], {"sao": "sao_raw", "sad": "sad_raw"}, "games_played").select("team", *r6("sao", "sad"))


METRIC = "with x as (select s_suppkey as team, s_acctbal as v from supplier)\n"


def _metric(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team"), F.col("s_acctbal").alias("v"))


@query("robust_scale", METRIC + ", q as (select quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from x), w as (select team, greatest(lo, least(hi, v)) as w from x, q) select team, round(1 / (1 + exp(-(w - avg(w) over ()) / stddev_pop(w) over ())), 6) as y from w")
def robust_scale(spark, sf_dir):
    return S.robust_scale(_metric(spark, sf_dir), {"y": "v"}).select("team", *r6("y"))


@query("robust_minmax", METRIC + ", q as (select quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from x) select team, round((greatest(lo, least(hi, v)) - lo) / (hi - lo), 6) as y from x, q")
def robust_minmax(spark, sf_dir):
    return S.robust_minmax(_metric(spark, sf_dir), {"y": "v"}).select("team", *r6("y"))


@query("minmax", METRIC + "select team, round((v - min(v) over ()) / (max(v) over () - min(v) over ()), 3) as y from x")
def minmax(spark, sf_dir):
    return S.minmax(_metric(spark, sf_dir), {"y": "v"}, 3).select("team", "y")


@query("logistic_norm", METRIC + "select team, round(1 / (1 + exp(-(v - avg(v) over ()) / (1.5::double * stddev_samp(v) over ()))), 6) as y from x")
def logistic_norm(spark, sf_dir):
    return S.logistic(_metric(spark, sf_dir), {"y": "v"}).select("team", *r6("y"))


@query("percent_rank_average", METRIC + "select team, round((rank() over (order by floor(v / 1000)) + (count(*) over (partition by floor(v / 1000)) - 1) / 2.0::double) / count(*) over (), 6) as y from x")
def percent_rank_average(spark, sf_dir):
    return S.percent_rank_average(_metric(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 1000)), "v", "y").select("team", *r6("y"))


HISTORY_OUT = "team, opponent, date, gf, ga, round(opponent_base_strength, 6) as opponent_base_strength, round(expected_gd, 6) as expected_gd, round(gd_delta, 6) as gd_delta"


@query("history_enriched", BASE + BASE_STRENGTH + f"select {HISTORY_OUT}, case when gd_delta > 1 then 'good' when gd_delta < -1 then 'weak' else 'neutral' end as impact_bucket from hist_rows")
def history_enriched(spark, sf_dir):
    lg, long = _long(spark, sf_dir)
    rows = ratings.enriched_history(long, lg.as_of)
    return rows.select("team", "opponent", "date", "gf", "ga", *r6("opponent_base_strength", "expected_gd", "gd_delta"), reshape.impact_bucket("gd_delta").alias("impact_bucket"))


@query("history_summary", BASE + BASE_STRENGTH + "select team, count(*) as n, min(date) as first_date, max(date) as last_date, sum(gf)::bigint as goals_for, sum(ga)::bigint as goals_against from hist_rows group by team order by n desc, team limit 5")
def history_summary(spark, sf_dir):
    lg, long = _long(spark, sf_dir)
    rows = ratings.enriched_history(long, lg.as_of).groupBy("team").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"))
    return rows.orderBy(F.desc("n"), "team").limit(5)


SOS_RAW = BASE_STRENGTH + """, os as (select opponent as team, avg(opponent_base_strength) as strength from hist_rows group by opponent),
sr as (select r.team, avg(coalesce(strength, (select quantile_cont(strength, 0.5) from os))) as sos_raw from rec r left join os on os.team = r.opponent group by r.team)
"""


def _sos_raw(lg, long, recent=None):
    """Strength of an opponent: the mean base strength of its rows in the history, which is its own base strength."""
    strength = ratings.base_strength(ratings.distinct_history(long, lg.as_of)).select("team", F.col("base_strength").alias("strength"))
    return sos.opponent_mean(ratings.recent(long, lg.as_of) if recent is None else recent, strength).persist()


@query("sos_baseline", BASE + SOS_RAW + "select team, round(sos_raw, 6) as sos_raw from sr")
def sos_baseline(spark, sf_dir):
    return _sos_raw(*_long(spark, sf_dir)).select("team", *r6("sos_raw"))


@query("sos_pct_rank_proxy", BASE + WEIGHTED + ", q as (select team, round(off_raw, 6) as v from od) select team, round((rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double) / count(*) over (), 6) as sos_raw from q")
def sos_pct_rank_proxy(spark, sf_dir):
    return S.percent_rank_average(_base(spark, sf_dir)[2].select("team", S.rounded("off_raw", 6).alias("v")), "v", "sos_raw").select("team", *r6("sos_raw"))


def _stats_and_schedule(spark, sf_dir, steps=3):
    """(league, recent rows, stats, schedule): the recent rows are made once and kept for both."""
    lg, long = _long(spark, sf_dir)
    rows = ratings.with_sides(ratings.recent(long, lg.as_of), lg.teams).persist()
    stats = ratings.stats_of(rows, league.games_of_teams(lg.games)).persist()
    return lg, rows, stats, sos.relaxed(stats.select("team", F.col("win_percentage").alias("s")), sos.edges(rows), steps)


@query("sos_relax_3", BASE + STATS + SOS + "select team, round(sos_score, 6) as sos_score from sos")
def sos_relax_3(spark, sf_dir):
    return _stats_and_schedule(spark, sf_dir)[3].select("team", *r6("sos_score"))


@query("sos_relax_converged", BASE + STATS + SOS_SETTLED + "select team, round(sos_score, 6) as sos_score from sos")
def sos_relax_converged(spark, sf_dir):
    return _stats_and_schedule(spark, sf_dir, None)[3].select("team", *r6("sos_score"))


def _power(spark, sf_dir):
    lg, rows, stats, schedule = _stats_and_schedule(spark, sf_dir)
    return lg, rows, ratings.power_e2(stats, schedule)


POWER_OUT = ("offense_adj", "defense_adj", "offense_norm", "defense_norm", "sos_norm", "power_score", "games_penalty", "power_score_adj")


@query("power_e2", BASE + STATS + SOS + POWER + "select team, games_played, " + ", ".join(f"round({c}, 6) as {c}" for c in POWER_OUT) + " from power")
def power_e2(spark, sf_dir):
    return _power(spark, sf_dir)[2].select("team", "games_played", *r6(*POWER_OUT))


@query("status_e2", BASE + STATS + "select team, games_played, last_game_date, case when last_game_date < d - interval 180 day then 'Inactive' when games_played < 5 then 'Provisional' else 'Active' end as status from stats, today")
def status_e2(spark, sf_dir):
    lg, long = _long(spark, sf_dir)
    stats = ratings.team_stats(long, lg.teams, lg.as_of)
    return stats.select("team", "games_played", "last_game_date", reshape.status("games_played", "last_game_date", lg.as_of).alias("status"))


@query("rank_national", BASE + STATS + SOS + POWER + "select team, row_number() over (order by round(power_score_adj, 6) desc, team) as national_rank, round(power_score_adj, 6) as power_score_adj from power")
def rank_national(spark, sf_dir):
    power = _power(spark, sf_dir)[2].select("team", *r6("power_score_adj"))
    return ratings.ranked(power, [F.desc("power_score_adj"), F.col("team")], "national_rank").withColumn("national_rank", F.col("national_rank").cast("long"))


@query("rank_state", BASE + STATS + SOS + POWER + "select power.team, state, row_number() over (partition by state order by round(power_score_adj, 6) desc, power.team) as state_rank from power join teams using (team)")
def rank_state(spark, sf_dir):
    lg, _, power = _power(spark, sf_dir)
    rows = power.select("team", *r6("power_score_adj")).join(lg.teams.select("team", "state"), "team")
    return ratings.ranked(rows, [F.desc("power_score_adj"), F.col("team")], "state_rank", ["state"]).select("team", "state", F.col("state_rank").cast("long").alias("state_rank"))


@query("perf_adjust", BASE + STATS + SOS + POWER + """, kd as (select g.*, p.games_played as gp, g.m - 6 * (p.power_score - q.power_score) as delta from margin g join power p on p.team = g.team join power q on q.team = g.opponent),
isl as (select *, sum(case when delta >= 0 then 1 else 0 end) over (partition by team order by rn desc) as island from kd),
stk as (select *, sum(case when delta < 0 then 1 else 0 end) over (partition by team, island order by rn desc) as streak from isl)
select team, round(sum((0.02::double + 0.01::double * least(1.0::double, gp / 30.0::double)) * tanh(delta * case when streak = 2 then 1.2::double when streak = 3 then 1.5::double when streak >= 5 then 2.0::double else 1.0::double end / 2)), 6) as adjustment, max(streak)::bigint as longest_streak from stk group by team""")
def perf_adjust(spark, sf_dir):
    _, rows, power = _power(spark, sf_dir)
    return ratings.performance_adjustment(rows, power).select("team", *r6("adjustment"), "longest_streak")


_E1_NORMS = BASE + WEIGHTED + STRENGTH + ADJUSTED + GUARD + SAO + SHRUNK + SOS_RAW + """, q as (select quantile_cont(sao, 0.05) as l1, quantile_cont(sao, 0.95) as h1, quantile_cont(sad, 0.05) as l2, quantile_cont(sad, 0.95) as h2 from shr), q3 as (select quantile_cont(sos_raw, 0.05) as l3, quantile_cont(sos_raw, 0.95) as h3 from sr),
wz as (select shr.team, games_played, greatest(l1, least(h1, sao)) as a, greatest(l2, least(h2, sad)) as b, (greatest(l3, least(h3, sos_raw)) - l3) / (h3 - l3) as c from shr join sr using (team), q, q3),
nz as (select *, 1 / (1 + exp(-(a - avg(a) over ()) / stddev_pop(a) over ())) as sao_norm, 1 / (1 + exp(-(b - avg(b) over ()) / stddev_pop(b) over ())) as sad_norm from wz)"""


@query("power_e1", _E1_NORMS + """ select team, games_played, round(0.2::double * sao_norm + 0.2::double * sad_norm + 0.6::double * c, 4) as power_score, round(least(1.0::double, pow(games_played / 20.0::double, 1.5::double)), 6) as gp_mult, 'baseline' as sos_source, case when games_played >= 6 then 'Active' else 'Provisional' end as status from nz""")
def power_e1(spark, sf_dir):
    lg, year, _, sao = _sao(spark, sf_dir)
    df = S.robust_scale(S.shrunk(sao, {"sao": "sao_raw", "sad": "sad_raw"}, "games_played"), {"sao_norm": "sao", "sad_norm": "sad"})
    schedule = S.robust_minmax(_sos_raw(lg, reshape.unpivot(lg.games), year.where("rn <= 30")), {"baseline": "sos_raw"}).select("team", "baseline")
    return ratings.power_e1(df, schedule).select("team", "games_played", "power_score", S.rounded("gp_mult", 6).alias("gp_mult"), "sos_source", "status")


@query("rank_six_keys", _E1_NORMS + """, pw as (select team, games_played, round(0.2::double * sao_norm + 0.2::double * sad_norm + 0.6::double * c, 4) as power_score, least(1.0::double, pow(games_played / 20.0::double, 1.5::double)) as gp_mult, round(sao_norm, 6) as sao_norm, round(sad_norm, 6) as sad_norm, round(c, 6) as sos_norm from nz),
fin as (select *, round(power_score * gp_mult, 3) as power_score_adj from pw) select row_number() over (order by power_score_adj desc, sao_norm desc, sad_norm desc, sos_norm desc, games_played desc, team) as rank, team, power_score_adj, sao_norm, sad_norm, sos_norm, games_played from fin""")
def rank_six_keys(spark, sf_dir):
    """The first engine's final order: adjusted score, offense, defense, schedule, games, team."""
    lg, year, _, sao = _sao(spark, sf_dir)
    df = S.robust_scale(S.shrunk(sao, {"sao": "sao_raw", "sad": "sad_raw"}, "games_played"), {"sao_norm": "sao", "sad_norm": "sad"})
    schedule = S.robust_minmax(_sos_raw(lg, reshape.unpivot(lg.games), year.where("rn <= 30")), {"baseline": "sos_raw"}).select("team", "baseline")
    rows = ratings.power_e1(df, schedule).select("team", "games_played", S.rounded(F.col("power_score") * F.col("gp_mult"), 3).alias("power_score_adj"), *r6("sao_norm", "sad_norm"), S.rounded("baseline", 6).alias("sos_norm"))
    return serving.ranked_without_ties(rows).select("rank", "team", "power_score_adj", "sao_norm", "sad_norm", "sos_norm", "games_played")


_SLICED = ", sl as (select p.team, t.state, case when p.team % 2 = 0 then 'M' else 'F' end as gender, t.age, round(power_score_adj, 6) as power_score_adj from power p join teams t using (team))\n"


def _sliced(spark, sf_dir):
    lg, _, power = _power(spark, sf_dir)
    rows = power.select("team", *r6("power_score_adj")).join(lg.teams.select("team", "state", "age"), "team")
    return sos.cut(rows.withColumn("gender", F.when(F.col("team") % 2 == 0, "M").otherwise("F")))


@query("slice_rankings", BASE + STATS + SOS + POWER + _SLICED + """, ev as (select bits::int as slice_bits, case when bits & 1 = 0 then 'All' else state end as state, case when bits & 2 = 0 then 'All' else gender end as gender, case when bits & 4 = 0 then 'All' else age end as age, team, power_score_adj from sl, range(8) b(bits))
select *, row_number() over (partition by slice_bits, state, gender, age order by power_score_adj desc, team) as slice_rank from ev""")
def slice_rankings(spark, sf_dir):
    """Ranks of all teams in the slices of state, gender and age that hold them, all slices in one plan."""
    return serving.slice_ranks(_sliced(spark, sf_dir))


@query("slice_index", BASE + STATS + SOS + POWER + _SLICED + """ select case when grouping(state) = 1 then 'All' else state end as state, case when grouping(gender) = 1 then 'All' else gender end as gender, case when grouping(age) = 1 then 'All' else age end as age,
  count(*) as n_teams, round(avg(power_score_adj), 6) as mean_score, arg_max(team, (power_score_adj, -team)) as best_team from sl group by cube (state, gender, age)""")
def slice_index(spark, sf_dir):
    return serving.slice_sizes(_sliced(spark, sf_dir)).select("state", "gender", "age", "n_teams", F.round("mean_score", 6).cast("double").alias("mean_score"), "best_team")


@query("selector_params", BASE + "select team, 'gender=' || (case when team % 2 = 0 then 'boys' else 'girls' end) || '&age_group=' || age || '&state=' || state as params from teams")
def selector_params(spark, sf_dir):
    teams = league.teams(spark, sf_dir).withColumns({"gender": F.when(F.col("team") % 2 == 0, "Boys").otherwise("Girls"), "label": F.concat("age", F.lit(" (2013)"))})
    return teams.select("team", serving.selector_params("gender", "label", "state").alias("params"))


@query("overlap_analysis", BASE + """, ga as (select g.*, a.age as age_a from games g left join teams a on a.team = g.team_a where event <> 'N' and a.age = 'U10'), own as (select team from teams where age = 'U10' and team % 3 > 0), older as (select team from teams where age = 'U11'),
seen as (select distinct team_a as team from ga union select distinct team_b from ga)
select count(*) as n_games, count(*) filter (age_a = 'U10' and team_b in (select team from older)) as cross_age_games, (select count(distinct team_a) from ga) as teams_a, (select count(distinct team_b) from ga) as teams_b, (select count(*) from seen) as teams_in_games, (select count(*) from own) as teams_in_master,
  (select count(*) from own where team in (select team from seen)) as in_both, (select count(*) from own where team not in (select team from seen)) as master_only, (select count(*) from seen where team not in (select team from own)) as games_only,
  round(100.0::double * count(*) filter (age_a = 'U10' and team_b in (select team from older)) / count(*), 6) as cross_age_pct from ga""")
def overlap_analysis(spark, sf_dir):
    """U10 games that are no friendlies against a master list that lacks a third of the teams."""
    lg = league.load(spark, sf_dir)
    ages = lg.teams.select(F.col("team").alias("team_a"), F.col("age").alias("age_a"))
    games = lg.games.where("event <> 'N'").join(ages, "team_a").where("age_a = 'U10'")
    out = quality.overlap(games, lg.teams.where("age = 'U10' and team % 3 > 0"), lg.teams.where("age = 'U11'"), "U10")
    return out.withColumn("cross_age_pct", F.round("cross_age_pct", 6))


def _division_games(lg):
    ages = lg.teams.select(F.col("team").alias("team_a"), F.col("age").alias("division"))
    return lg.games.join(ages, "team_a")


@query("elo_sequential")
def elo_sequential(spark, sf_dir):
    return elo.sequential(_division_games(league.load(spark, sf_dir))).select("division", "team", *r6("rating"))


@query("elo_schedule")
def elo_schedule(spark, sf_dir):
    lg, long = _long(spark, sf_dir)
    games = lg.games.withColumn("division", F.lit("all"))
    return elo.schedule(long, elo.sequential(games)).select("team", *r6("sos_iterative", "sos_norm"))


_ELO = ", g as (select team_a, team_b, score_a - score_b as gd from games, today where date >= d - interval 365 day), r0 as (select distinct team, 1500.0::double as r from (select team_a as team from g union all select team_b from g))" + "".join(
    f""", c{k} as (select team_a, team_b, 24 * (1 + 0.2::double * least(abs(gd), 6)) * (case when gd > 0 then 1.0::double when gd < 0 then 0.0::double else 0.5::double end - 1 / (1 + pow(10.0::double, (b.r - a.r) / 400))) as c from g join r{k} a on a.team = team_a join r{k} b on b.team = team_b),
d{k} as (select team, avg(c) as d from (select team_a as team, c from c{k} union all select team_b, -c from c{k}) group by team), r{k + 1} as (select r.team, r + coalesce(d, 0) as r from r{k} r left join d{k} d on d.team = r.team)"""
    for k in range(3)
)


@query("elo_batched_3", BASE + _ELO + " select team, round(r, 6) as rating from r3")
def elo_batched_3(spark, sf_dir):
    lg = league.load(spark, sf_dir)
    return elo.batched(reshape.trailing(lg.games, lg.as_of, 365), 3).select("team", *r6("rating"))


@query("elo_schedule_batched", BASE + _ELO + ", m as (select x.team, avg(r3.r) as v from win x join r3 on r3.team = x.opponent group by x.team) select team, round(v, 6) as sos_iterative, round((v - min(v) over ()) / (max(v) over () - min(v) over ()), 6) as sos_norm from m")
def elo_schedule_batched(spark, sf_dir):
    """Mean opponent rating from the variant that no task folds alone."""
    lg = league.load(spark, sf_dir)
    year = reshape.trailing(lg.games, lg.as_of, 365)
    return elo.schedule(reshape.unpivot(year), elo.batched(year, 3)).select("team", *r6("sos_iterative", "sos_norm"))


POWER_ITERATIVE = """, q as (select quantile_cont(sao, 0.05) as l1, quantile_cont(sao, 0.95) as h1, quantile_cont(sad, 0.05) as l2, quantile_cont(sad, 0.95) as h2 from shr),
wz as (select shr.team, games_played, greatest(l1, least(h1, sao)) as a, greatest(l2, least(h2, sad)) as b from shr, q),
nz as (select *, 1 / (1 + exp(-(a - avg(a) over ()) / stddev_pop(a) over ())) as sao_norm, 1 / (1 + exp(-(b - avg(b) over ()) / stddev_pop(b) over ())) as sad_norm from wz),
m as (select x.team, avg(r3.r) as v from win x join r3 on r3.team = x.opponent group by x.team),
it as (select team, case when team % 5 > 0 then (v - min(v) over ()) / (max(v) over () - min(v) over ()) end as c from m),
q3 as (select quantile_cont(sos_raw, 0.05) as l3, quantile_cont(sos_raw, 0.95) as h3 from sr), bl as (select team, (greatest(l3, least(h3, sos_raw)) - l3) / (h3 - l3) as c from sr, q3)
select nz.team, round(0.2::double * sao_norm + 0.2::double * sad_norm + 0.6::double * coalesce(it.c, bl.c), 4) as power_score, case when it.c is null then 'baseline' else 'iterative' end as sos_source from nz join bl using (team) left join it using (team)
"""


@query("power_e1_iterative", BASE + WEIGHTED + STRENGTH + ADJUSTED + GUARD + SAO + SHRUNK + SOS_RAW + _ELO + POWER_ITERATIVE)
def power_e1_iterative(spark, sf_dir):
    """The first engine's score with an iterative schedule that lacks a fifth of the teams: these fall back to the baseline."""
    lg, year, _, sao = _sao(spark, sf_dir)
    df = S.robust_scale(S.shrunk(sao, {"sao": "sao_raw", "sad": "sad_raw"}, "games_played"), {"sao_norm": "sao", "sad_norm": "sad"})
    games = reshape.trailing(lg.games, lg.as_of, 365)
    rated = elo.schedule(reshape.unpivot(games), elo.batched(games, 3)).where("team % 5 > 0").select("team", "sos_norm")
    schedule = S.robust_minmax(_sos_raw(lg, reshape.unpivot(lg.games), year.where("rn <= 30")), {"baseline": "sos_raw"})
    return ratings.power_e1(df, schedule.select("team", "baseline"), rated).select("team", "power_score", "sos_source")


PAIRS = "with recursive p as (select o_custkey as a, o_custkey - o_custkey % 7 + o_orderkey % 3 as b from orders),\n"


def _pairs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") - F.col("o_custkey") % 7 + F.col("o_orderkey") % 3).alias("b"))


COMPONENTS = "e as (select distinct a as u, b as v from p union select b, a from p), reach(u, v) as (select u, v from e union select r.u, e.v from reach r join e on r.v = e.u), l as (select u as team, least(u, min(v)) as component from reach group by u)\n"


@query("components", PAIRS + COMPONENTS + "select team, component, count(*) over (partition by component) as component_size from l")
def components(spark, sf_dir):
    return graph.components(_pairs(spark, sf_dir))


@query("degree", PAIRS + "e as (select distinct a as u, b as v from p union select b, a from p) select u as team, sum(case when u = v then 2 else 1 end)::bigint as degree from e group by u")
def degree(spark, sf_dir):
    return graph.degrees(_pairs(spark, sf_dir)).select("team", F.col("degree").cast("long").alias("degree"))


@query("connectivity_report", PAIRS + COMPONENTS + ", e2 as (select u, sum(case when u = v then 2 else 1 end)::bigint as degree from e group by u) select team, dense_rank() over (order by component) - 1 as component_id, count(*) over (partition by component) as component_size, degree from l join e2 on e2.u = l.team")
def connectivity_report(spark, sf_dir):
    return graph.connectivity(_pairs(spark, sf_dir)).select("team", F.col("component_id").cast("long").alias("component_id"), "component_size", F.col("degree").cast("long").alias("degree"))


@query("semi_join_master", BASE + "select team_a, count(*) as n from games where team_a in (select team from teams where age = 'U10') group by team_a")
def semi_join_master(spark, sf_dir):
    lg = league.load(spark, sf_dir)
    m = lg.teams.where("age = 'U10'").select(F.col("team").alias("team_a"))
    return lg.games.join(m, "team_a", "left_semi").groupBy("team_a").agg(F.count("*").alias("n"))


@query("team_lookup", BASE + "select r.team, a.name, coalesce(b.state, 'unknown') as opponent_state, count(*) as n from rec r left join teams a on a.team = r.team left join (select * from teams where age = 'U11') b on b.team = r.opponent group by all")
def team_lookup(spark, sf_dir):
    lg, recent = _recent(spark, sf_dir)
    b = lg.teams.where("age = 'U11'").select(F.col("team").alias("opponent"), F.col("state").alias("os"))
    rows = recent.join(lg.teams.select("team", "name"), "team", "left").join(b, "opponent", "left")
    return rows.groupBy("team", "name", F.coalesce("os", F.lit("unknown")).alias("opponent_state")).agg(F.count("*").alias("n"))


for _name, _op, _sqlop in (("set_union", "union", "union"), ("set_intersect", "intersect", "intersect"), ("set_except", "subtract", "except")):
    def _sets(spark, sf_dir, op=_op):
        lg = league.load(spark, sf_dir)
        a = reshape.trailing(lg.games, lg.as_of, 30).select(F.col("team_a").alias("team"))
        b = reshape.trailing(lg.games, lg.as_of, 30).where("score_b > score_a").select(F.col("team_b").alias("team"))
        return getattr(a, op)(b).distinct()

    query(_name, BASE + f"select team_a as team from games, today where date >= d - interval 30 day {_sqlop} select team_b from games, today where date >= d - interval 30 day and score_b > score_a")(_sets)


@query("full_row_distinct", BASE + "select distinct team_a, score_a, score_b, event from games")
def full_row_distinct(spark, sf_dir):
    return league.games(spark, sf_dir).select("team_a", "score_a", "score_b", "event").distinct()


@query("match_type_report", BASE + ", k as (select case when score_a = score_b then 'NO_MATCH' when score_a > 3 then 'EXACT' else 'FUZZY' end as match_type, event from games), c as (select event, match_type, count(*) as n from k group by all) select event, match_type, n, round(100.0::double * n / sum(n) over (partition by event), 6) as percent from c")
def match_type_report(spark, sf_dir):
    kind = F.when(F.col("score_a") == F.col("score_b"), "NO_MATCH").when(F.col("score_a") > 3, "EXACT").otherwise("FUZZY")
    g = league.games(spark, sf_dir).select("event", kind.alias("match_type"))
    return quality.shares(g, "event", "match_type").select("event", "match_type", "n", *r6("percent"))


@query("top3_opponents", BASE + ", c as (select team, opponent, count(*) as n from res group by all), x as (select *, row_number() over (partition by team order by n desc, opponent) as nth from c), a as (select team, sum(n)::bigint as appearances from c group by team) select x.team, appearances, nth, opponent, n from x join a using (team) where nth <= 3")
def top3_opponents(spark, sf_dir):
    top = quality.top_opponents(_long(spark, sf_dir)[1])
    return top.select("team", "appearances", F.posexplode("top").alias("p", "o")).select("team", "appearances", (F.col("p") + 1).cast("long").alias("nth"), "o.opponent", "o.n")


@query("conflicts", BASE + ", a as (select team_a as name, arg_min(score_a, game_id * 100 + score_a) as match_a from games group by 1), b as (select team_b as name, arg_min(score_b, game_id * 100 + score_b) as match_b from games group by 1) select name, match_a, match_b from a join b using (name) where match_a is distinct from match_b")
def conflicts(spark, sf_dir):
    from pitchlake.operators import matching

    g = league.games(spark, sf_dir)
    side = lambda s: g.select(F.col(f"team_{s}").alias("name"), F.col(f"score_{s}").alias("match"), (F.col("game_id") * 100 + F.col(f"score_{s}")).alias("ord"))
    return matching.conflicts(side("a"), side("b"))


@query("national_format", BASE + """select strftime(date, '%Y-%m-%d') as date, team_a, team_b, a.state as team_a_state, b.state as team_b_state, score_a, score_b, case when score_a > score_b then 'W' when score_a < score_b then 'L' else 'T' end as result_a,
  case when score_a > score_b then 'L' when score_a < score_b then 'W' else 'T' end as result_b, event, 'League' as competition, a.age as division, a.state <> b.state as cross_state, row_number() over (order by game_id, team_a, team_b, score_a, score_b, date) - 1 + 1000000 as match_id
from games, today, teams a, teams b where date >= d - interval 30 day and a.team = team_a and b.team = team_b""")
def national_format(spark, sf_dir):
    lg = league.load(spark, sf_dir)
    side = lambda s: lg.teams.select(F.col("team").alias(f"team_{s}"), F.col("state").alias(f"team_{s}_state"), F.col("age").alias(f"age_{s}"))
    g = reshape.trailing(lg.games, lg.as_of, 30).join(side("a"), "team_a").join(side("b"), "team_b").withColumn("result_a", reshape.outcome("score_a", "score_b"))
    g = numbered(g, ["game_id", "team_a", "team_b", "score_a", "score_b", "date"], "number", 1_000_000)
    return g.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "team_a", "team_b", "team_a_state", "team_b_state", "score_a", "score_b", "result_a", reshape.invert_result("result_a").alias("result_b"), "event", F.lit("League").alias("competition"), F.col("age_a").alias("division"), (F.col("team_a_state") != F.col("team_b_state")).alias("cross_state"), F.col("number").cast("long").alias("match_id"))


@query("national_columns", BASE + """, g as (select strftime(date, '%Y-%m-%d') as d, g.*, a.state as sa, b.state as sb, case when score_a > score_b then 'W' when score_a < score_b then 'L' when date < today.d - interval 15 day then 'T' end as ra from games g, today, teams a, teams b where date >= today.d - interval 30 day and a.team = team_a and b.team = team_b)
select d as "Date", team_a as "Team A", team_b as "Team B", sa as "Team A State", sb as "Team B State", 'U11B' as "Team A Division", 'U11B' as "Team B Division", 'Club ' || team_a as "Team A Club", 'Club ' || team_b as "Team B Club", score_a as "Score A", score_b as "Score B",
  ra as "Result A", case ra when 'W' then 'L' when 'L' then 'W' when 'T' then 'T' else '' end as "Result B", event as "Event", event as "Competition", 'U11B U11 Boys Elite' as "Division", event as "Venue", '' as "Location",
  row_number() over (order by game_id, team_a, team_b, score_a, score_b, d) - 1 + 2000000 as "Match ID", team_a as "Original Team A ID", team_b as "Original Team B ID", sa is distinct from sb as "Cross_State", 'League' as "Event_Type", sa as "Venue_State" from g""")
def national_columns(spark, sf_dir):
    lg = league.load(spark, sf_dir)
    side = lambda s: lg.teams.select(F.col("team").alias(f"team_{s}"), F.col("state").alias(f"Team {s.upper()} State"))
    g = reshape.trailing(lg.games, lg.as_of, 30).join(side("a"), "team_a").join(side("b"), "team_b")
    tie = F.when(F.col("date") < league.days_before(lg.as_of, 15), "T")
    named = g.select(F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("team_a").alias("Team A"), F.col("team_b").alias("Team B"), "Team A State", "Team B State", F.concat(F.lit("Club "), "team_a").alias("Team A Club"), F.concat(F.lit("Club "), "team_b").alias("Team B Club"),
                     F.col("score_a").alias("Score A"), F.col("score_b").alias("Score B"), F.when(F.col("score_a") > F.col("score_b"), "W").when(F.col("score_a") < F.col("score_b"), "L").otherwise(tie).alias("Team A Result"), F.col("event").alias("Event"), F.col("team_a").alias("Gotsport Team id # Team A"), F.col("team_b").alias("Team B GotSport ID"), "game_id")
    return reshape.national(named, 11, ["game_id", "Team A", "Team B", "Score A", "Score B", "Date"]).withColumn("Match ID", F.col("Match ID").cast("long"))


def _ratings_table(spark, sf_dir):
    lg, _, power = _power(spark, sf_dir)
    return lg, power.join(lg.teams, "team").withColumn("power_score", S.rounded("power_score", 6))


API = BASE + STATS + SOS + POWER + """, rt as (select power.*, name, state, age, round(power_score, 6) * case when games_played >= 20 then 1.0::double when games_played >= 10 then 0.9::double else 0.75::double end as adj, last_game_date >= d - interval 180 day as fresh from power join teams using (team), today)
"""


@query("api_rankings", API + "select row_number() over (order by adj desc, team) as rank, team, name, state, games_played, round(adj, 6) as power_score_adj, case when games_played >= 6 then 'Active' else 'Provisional' end as status from rt where age = 'U10' and fresh and games_played >= 8 qualify rank <= 50")
def api_rankings(spark, sf_dir):
    lg, table = _ratings_table(spark, sf_dir)
    active, _, _ = serving.rankings(table, lg.as_of, limit=50, age="U10")
    return active.select(F.col("rank").cast("long").alias("rank"), "team", "name", "state", "games_played", *r6("power_score_adj"), "status")


@query("api_meta", API + "select count(*) as total, count(*) filter (not fresh) as inactive, count(*) filter (fresh and games_played >= 8) as active, count(*) filter (fresh and games_played < 8) as provisional from rt")
def api_meta(spark, sf_dir):
    lg, table = _ratings_table(spark, sf_dir)
    return serving.rankings(table, lg.as_of)[2].select(*[F.col(c).cast("long").alias(c) for c in ("total", "inactive", "active", "provisional")])


@query("api_search", API + "select team, name, state from rt where regexp_matches(name, '(?i)0[1-5]$')")
def api_search(spark, sf_dir):
    return serving.slice_of(_ratings_table(spark, sf_dir)[1], q="0[1-5]$").select("team", "name", "state")


@query("api_history", BASE + BASE_STRENGTH + "select team, opponent, date, gf, ga, round(gd_delta, 6) as gd_delta, case when gd_delta >= 1 then 'overperformed' when gd_delta <= -1 then 'underperformed' else 'neutral' end as performance from hist_rows where team = 1 order by date desc, opponent, gf, ga limit 20")
def api_history(spark, sf_dir):
    lg, long = _long(spark, sf_dir)
    return serving.history(ratings.enriched_history(long, lg.as_of), 1, 20).select("team", "opponent", "date", "gf", "ga", *r6("gd_delta"), "performance")


@query("api_sorted_limit", API + "select team, round(sos_score, 6) as sos_score from rt order by round(sos_score, 6) desc nulls last, team limit 25")
def api_sorted_limit(spark, sf_dir):
    table = _ratings_table(spark, sf_dir)[1].select("team", *r6("sos_score"))
    return serving.sorted_safely(table, "sos_score").limit(25)


@query("dashboard_kpis", API + "select count(*) as n_teams, round(avg(round(power_score, 6)), 6) as mean_power, sum(cross_age_games)::bigint as cross_age_games, sum(cross_state_games)::bigint as cross_state_games, round(avg(sos_score), 6) as mean_sos from rt")
def dashboard_kpis(spark, sf_dir):
    return serving.kpis(_ratings_table(spark, sf_dir)[1]).select("n_teams", *r6("mean_power"), "cross_age_games", "cross_state_games", *r6("mean_sos"))


@query("state_breakdown", API + "select state, count(*) as n_teams, arg_max(team, (round(power_score_adj, 6), -team)) as best_team from rt group by state")
def state_breakdown(spark, sf_dir):
    return serving.by_state(_ratings_table(spark, sf_dir)[1].withColumn("power_score_adj", S.rounded("power_score_adj", 6)))


@query("running_win_pct", BASE + "select team, rn, round(sum(case when result = 'W' then 1.0::double else 0.0::double end) over (partition by team order by rn) / rn, 6) as running_win_pct from rec where rn <= 20")
def running_win_pct(spark, sf_dir):
    w = Window.partitionBy("team").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = _recent(spark, sf_dir)[1].where("rn <= 20")
    return rows.select("team", F.col("rn").cast("long").alias("rn"), F.round(F.sum(F.when(F.col("result") == "W", 1.0).otherwise(0.0)).over(w) / F.col("rn"), 6).alias("running_win_pct"))


PRED = "with p as (select (event_id % 1000 + 0.5::double) / 1000 as p, case when value > 50 then 1 else 0 end as y, event_type, ts, event_id from events)\n"


def _predictions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(((F.col("event_id") % 1000 + 0.5) / 1000).alias("p"), F.when(F.col("value") > 50, 1).otherwise(0).alias("y"), "event_type", "ts", "event_id")


@query("calibration_bins", PRED + ", b as (select unnest(range(1, 11))::int as bin), g as (select greatest(1, least(10, ceil(p * 10)))::int as bin, count(*) as n, avg(p) as mp, avg(y) as my from p group by 1) select bin, coalesce(n, 0) as n, round(mp, 6) as mean_predicted, round(my, 6) as mean_actual from b left join g using (bin)")
def calibration_bins(spark, sf_dir):
    return quality.calibration(_predictions(spark, sf_dir), "p", "y").select("bin", "n", *r6("mean_predicted", "mean_actual"))


@query("prediction_scores", PRED + "select count(*) as n, round(avg(case when (p >= 0.5) = (y >= 0.5) then 1.0::double else 0.0::double end), 6) as accuracy, round(avg((p - y) * (p - y)), 6) as brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss from p")
def prediction_scores(spark, sf_dir):
    return quality.prediction_scores(_predictions(spark, sf_dir), "p", "y").select("n", *r6("accuracy", "brier", "log_loss"))


@query("prediction_auc", PRED + ", s as (select sum(y)::double as pos, sum(1 - y)::double as neg from p), r as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as r from p), w as (select sum(case when y = 1 then r end) as w from r) select round((w - pos * (pos + 1) / 2) / (pos * neg), 6) as auc from w, s")
def prediction_auc(spark, sf_dir):
    return quality.area_under_curve(_predictions(spark, sf_dir), "p", "y").select(*r6("auc"))


@query("calibration_fit", PRED + "select round(regr_slope(y, p), 6) as slope, round(regr_intercept(y, p), 6) as intercept from p")
def calibration_fit(spark, sf_dir):
    return quality.calibration_slope(_predictions(spark, sf_dir), "p", "y").select(*r6("slope", "intercept"))


@query("metric_lag", PRED + ", d as (select event_type, ts::date as day, avg(p) as m from p group by all) select event_type, day, round(m, 6) as m, round(m - lag(m) over (partition by event_type order by day), 6) as delta from d")
def metric_lag(spark, sf_dir):
    d = _predictions(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("p").alias("m"))
    return d.select("event_type", "day", F.round("m", 6).alias("m"), F.round(F.col("m") - F.lag("m").over(Window.partitionBy("event_type").orderBy("day")), 6).alias("delta"))


@query("latest_metrics", PRED + "select event_id, event_type, round(p, 6) as p from p order by ts desc, event_id desc limit 10")
def latest_metrics(spark, sf_dir):
    return _predictions(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type", *r6("p"))


@query("config_compare", PRED + "select event_type, round(avg(p), 6) as p_mean, round(stddev_samp(p), 6) as p_std, count(p) as p_count, round(avg(y), 6) as y_mean, round(stddev_samp(y), 6) as y_std from p group by event_type")
def config_compare(spark, sf_dir):
    g = _predictions(spark, sf_dir).groupBy("event_type")
    return g.agg(F.round(F.avg("p"), 6).alias("p_mean"), F.round(F.stddev_samp("p"), 6).alias("p_std"), F.count("p").alias("p_count"), F.round(F.avg("y"), 6).alias("y_mean"), F.round(F.stddev_samp("y"), 6).alias("y_std"))


@query("quality_bronze", "select count(*) as n, round(avg(case when regexp_matches(text, '^\\s*[0-9]+\\s*$') then 1.0::double else 0.0::double end), 6) as numeric_share, round(avg(case when length(trim(text)) <= 3 then 1.0::double else 0.0::double end), 6) as short_share, bool_or(regexp_matches(text, '[A-Za-z]')) as has_letters from documents")
def quality_bronze(spark, sf_dir):
    return quality.bronze_names(read(spark, sf_dir, "documents"), "text").select("n", *r6("numeric_share", "short_share"), "has_letters")


@query("quality_gold", BASE + ", k as (select team_a, count(*) as n, min(date) as d0, max(date) as d1 from games group by team_a) select sum(n)::bigint as n_rows, count(*) as n_teams, min(d0) as first_date, max(d1) as last_date, round(avg(case when t.team is not null then 1.0::double else 0.0::double end), 6) as coverage from k left join teams t on t.team = k.team_a")
def quality_gold(spark, sf_dir):
    lg = league.load(spark, sf_dir)
    return quality.gold_games(lg.games, lg.teams).select("n_rows", "n_teams", "first_date", "last_date", *r6("coverage"))


@query("numeric_coercion", "select event_id, try_cast(regexp_replace(regexp_replace(trim(raw), '[%,]', '', 'g'), '^\\((.*)\\)$', '-\\1') as double) as v from (select event_id, case event_id % 4 when 0 then ' ' || event_id::varchar || '%' when 1 then '(' || event_id::varchar || ')' when 2 then '1,' || lpad((event_id % 1000)::varchar, 3, '0') else 'n/a' end as raw from events)")
def numeric_coercion(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("id", F.col("event_id").cast("string"))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), "id", F.lit("%"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("("), "id", F.lit(")"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))).otherwise("n/a")
    return e.withColumn("raw", raw).select("event_id", reshape.numeric("raw").alias("v"))


@query("tail_split", "select o_orderkey, o_custkey from (select *, row_number() over (order by o_orderkey) as n from orders) where n > (select count(*) * 9 // 10 from orders)")
def tail_split(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return reshape.tail_remainder(o, ["o_orderkey"], o.count() * 9 // 10)


@query("advice_rules", METRIC + ", m as (select team, (v - min(v) over ()) / (max(v) over () - min(v) over ()) as x from x) select team, array_to_string(list_filter([case when x >= 0.6 then 'strong offense' end, case when x < 0.4 then 'offense needs work' end, case when 1 - x >= 0.6 then 'strong defense' end, case when 1 - x < 0.4 then 'defense needs work' end, case when x * x >= 0.6 then 'tough schedule' end, case when x * x < 0.4 then 'easy schedule' end], lambda s: s is not null), '; ') as advice from m")
def advice_rules(spark, sf_dir):
    m = S.minmax(_metric(spark, sf_dir), {"x": "v"}).withColumns({"y": 1 - F.col("x"), "z": F.col("x") * F.col("x")})
    return m.select("team", F.array_join(reshape.advice("x", "y", "z"), "; ").alias("advice"))


@query("cross_age_win_share", BASE + "select team_a as team, round(avg(case when score_a > score_b then 1.0::double else 0.0::double end), 6) as share, count(*) as n from games join teams a on a.team = team_a join teams b on b.team = team_b where a.age <> b.age group by 1")
def cross_age_win_share(spark, sf_dir):
    lg = league.load(spark, sf_dir)
    age = lambda s: lg.teams.select(F.col("team").alias(f"team_{s}"), F.col("age").alias(f"age_{s}"))
    g = lg.games.join(age("a"), "team_a").join(age("b"), "team_b").where("age_a <> age_b")
    return g.groupBy(F.col("team_a").alias("team")).agg(F.round(F.avg(F.when(F.col("score_a") > F.col("score_b"), 1.0).otherwise(0.0)), 6).alias("share"), F.count("*").alias("n"))


@query("games_per_team", BASE + "select team, count(*) as n, max(date) as last_game_date, min(date) as first_game_date from res group by team")
def games_per_team(spark, sf_dir):
    return _long(spark, sf_dir)[1].groupBy("team").agg(F.count("*").alias("n"), F.max("date").alias("last_game_date"), F.min("date").alias("first_game_date"))


@query("events_hourly", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_hourly(spark, sf_dir):
    from pitchlake.streaming.aliases import activity

    rows = activity(read(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
