"""The registered name queries that SQL cannot express, over the smallest tables, against plain Python."""

import re
from difflib import SequenceMatcher

import pytest

import __spark_entry__ as entry
from pitchlake.functions import names as N
from pitchlake.functions import similarity as M
from pitchlake.plans import catalogue
from pitchlake.plans import rosters as X

SF = entry.SMOKE_DIR
Q = catalogue.QUERIES


def parsed(name, season=2026):
    """Fields of a name by the rules, one after the other."""
    s = " ".join((name or "").lower().split())
    padded = f" {s} "
    hit = lambda p: (re.search(p, s) or [None, None])[1]

    def century(two):
        return None if two is None else f"20{two}" if int(two) <= 30 else f"19{two}" if 80 <= int(two) <= 99 else None

    age = hit(r"\bu(\d{1,2})\b")
    year = hit(r"\b(20\d{2})(?:[a-zA-Z]|\b)") or (str(season - int(age)) if age and 10 <= int(age) <= 19 else None) or century(hit(r"\b(\d{2})\b")) or century(hit(r"\b(\d{2})[bg]\b")) or ""
    mark = hit(r"\b\d{2,4}([bg])\b")
    has = lambda words: any(f" {w} " in padded for w in words)
    gender = "boys" if has(["boys", "b", "male", "m"]) else "girls" if has(["girls", "g", "female", "f"]) else {"b": "boys", "g": "girls"}.get(mark, "")
    roman, letter, number = hit(r"\b(i|ii|iii|iv|v|vi|vii|viii|ix|x)\b"), hit(r"\b([a-z])\b"), hit(r"\b(\d+)\b")
    if number and (len(number) == 4 or len(number) == 2 and int(number) <= 30):
        number = None
    designation = N.ROMAN.get(roman) or (letter if letter not in (None, "b", "g") else None) or number or next((w for w in N.DESIGNATIONS if f" {w} " in padded), "")
    fits = lambda w: w.lower() if w and len(w) > 3 and w.lower() not in N.NOT_COACHES else None
    last = re.search(r"\b([A-Za-z]+(?:\.[A-Za-z])?)\s*(?:\d+\s*)?$", s)
    before = re.findall(r"\b([A-Za-z]+(?:\.[A-Za-z])?)\s+\d+", s)
    coach = next((w for w in N.COACHES if s.endswith(f" {w}")), None) or fits(last and last[1]) or fits(before[-1] if before else None) or ""
    state = next((w for w in N.STATES if f" {w} " in padded), "")
    club = s
    for word in (year, year[2:] if len(year) == 4 else ""):
        club = re.sub(rf"\b{re.escape(word)}\b", "", club).strip() if word else club
    for sex, terms in (("boys", "boys|b|male|m"), ("girls", "girls|g|female|f")):
        club = re.sub(rf"\b(?:{terms})\b", "", club).strip() if gender == sex else club
    for word in (designation, coach):
        club = re.sub(rf"\b{re.escape(word)}\b", "", club).strip() if word else club
    club = " ".join(re.sub(r"\bu\d{1,2}\b", "", club).split())
    return (club, year, gender, designation, coach, state, name, s)


@pytest.fixture(scope="module")
def tables(spark):
    observed, master = X.observed(spark, SF), X.master(spark, SF)
    normal = lambda df: {(r.ord, r.name): r.key for r in df.withColumn("key", N.team_name("name")).collect()}
    return normal(observed), normal(master)


def test_rosters_follow_the_tables(tables):
    observed, master = tables
    assert len(observed) > 200 and len(master) > 150 and len({n for _, n in master}) == len(master)


def test_parse_team_name(spark, tables):
    got = {(r.ord, r.original): tuple(r)[1:] for r in Q["parse_team_name"](spark, SF).collect()}
    assert got == {(o, n): parsed(n) for o, n in tables[0]}


def test_indel_ratio_and_jaccard(spark, tables):
    ordered = lambda s: " ".join(sorted(s.split()))
    ratio = lambda x, y: 2 * M.subsequence_length(x, y) / (len(x) + len(y))
    names, masters = set(tables[0].values()), [(o, k) for (o, _), k in tables[1].items()]
    want = {(a, o): ratio(ordered(a), ordered(b)) for a in names for o, b in masters if a and b}
    got = {(r.name, r.ord): r.ratio for r in Q["indel_ratio"](spark, SF).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items() if v >= 0.9 - 1e-12}


def hybrid(x, y):
    a, b = ({w for w in t.split() if len(w) > 1 and w not in N.GENERIC_TOKENS} for t in (x, y))
    u, v = " ".join(sorted(x.split())), " ".join(sorted(y.split()))
    return 0.6 * (2 * M.subsequence_length(u, v) / (len(u) + len(v)) if u or v else 1.0) + 0.4 * (len(a & b) / len(a | b) if a or b else 1.0)


def test_hybrid_topk_and_review(spark, tables):
    masters = sorted((o, k) for (o, _), k in tables[1].items())
    want = {}
    for a in set(tables[0].values()):
        top = sorted((-hybrid(a, b), o, b) for o, b in masters if hybrid(a, b) > 0.3)[:3]
        want[a] = [(b, -s) for s, _, b in top]
    got = {}
    for r in sorted(Q["hybrid_topk"](spark, SF).collect(), key=lambda r: r.nth):
        got.setdefault(r.name, []).append((r.match, r.score))
    assert got == {a: [(b, pytest.approx(s, abs=1e-6)) for b, s in top] for a, top in want.items() if top}
    review = {r.name: (r.top_candidates, r.best_score) for r in Q["unmatched_review"](spark, SF).collect()}
    assert review.keys() == got.keys()
    for a, (text, best) in review.items():
        assert best == pytest.approx(want[a][0][1], abs=1e-6)
        shown = [re.fullmatch(r"(.*) \((\d\.\d{3})\)", part).groups() for part in text.split(" | ")]
        assert [(b, pytest.approx(float(s), abs=1e-3)) for b, s in shown] == [(b, s) for b, s in want[a]]


def clubs(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "name string").withColumn("p", N.parsed("name")).withColumn("c", N.matcher_club(N.F.col("p.club")))
    return {r.name: (r.p, r.c) for r in rows.collect()}


def strict(a, b, x, y):
    """The gate for two parsed names and their clubs."""
    from pitchlake.operators.matching import GENERIC_CLUB

    if not (a.birth_year and a.gender) or (a.birth_year, a.gender, a.designation) != (b.birth_year, b.gender, b.designation):
        return 0.0
    ratio = SequenceMatcher(None, x, y).ratio()
    common = set(x.split(" ")) & set(y.split(" "))
    inside = x in y or y in x
    telling = sum(len(w) > 2 and w not in N.CLUB_SUFFIXES for w in common)
    words = sum(len(w) > 1 and w not in GENERIC_CLUB for w in common)
    score = max(ratio, 0.9) if inside else max(ratio, 0.8) if telling >= 2 else ratio
    clash = any(a[f] and b[f] and a[f] != b[f] for f in ("coach", "state"))
    criteria = sum(bool(a[f]) and a[f] == b[f] for f in ("birth_year", "gender", "designation", "coach")) + (words >= 2)
    teams = ("team a" in x and "team b" in y) or ("team b" in x and "team a" in y)
    short = x != y and min(len(x), len(y)) < 0.7 * max(len(x), len(y)) and inside and score < 0.95
    if clash or not x or not y or score < 0.8 or (x != y and not inside and score < 0.9) or teams or short or words < 2 or criteria < 3:
        return 0.0
    return score


def test_strict_matches_and_their_bands(spark, tables):
    masters = sorted(tables[1])
    names = {n for _, n in tables[0]}
    of = clubs(spark, names | {n for _, n in masters})
    want = {}
    for n in names:
        found = sorted((-s, o, m) for o, m in masters if m != n and (s := strict(of[n][0], of[m][0], of[n][1], of[m][1])) >= 0.8)
        if found:
            want[n] = (found[0][2], pytest.approx(-found[0][0], abs=1e-6))
    assert len(want) > 20 and {r.name: (r.match, r.score) for r in Q["blocked_best_match"](spark, SF).collect()} == want
    scores = [s.expected for _, s in want.values()]
    band = Q["audit_match_bands"](spark, SF).first()
    assert (band.n, band.above_09, band.above_08, band.rest) == (len(scores), sum(s > 0.9 for s in scores), sum(0.8 < s <= 0.9 for s in scores), sum(s <= 0.8 for s in scores))


def test_exact_or_fuzzy(spark, tables):
    key = lambda s: " ".join(re.sub("[^a-z0-9 ]", "", s.lower()).split())
    masters = {}
    for o, m in sorted(tables[1]):
        masters.setdefault(key(m), m)
    got = {r.name: (r.match, r.match_type, r.score) for r in Q["exact_or_fuzzy"](spark, SF).collect()}
    kinds = set()
    for n in {n for _, n in tables[0]}:
        k = key(n)
        best = max(((M.weighted_ratio(k, m), -i, name) for i, (m, name) in enumerate(masters.items())))
        if not k:
            want = (None, "EMPTY", 0.0)
        elif k in masters:
            want = (masters[k], "EXACT", 100.0)
        else:
            want = (best[2], "FUZZY", pytest.approx(best[0], abs=1e-6)) if best[0] >= 90 else (None, "NO_MATCH", 0.0)
        kinds.add(want[1])
        assert got[n] == want
    assert kinds == {"EMPTY", "EXACT", "FUZZY", "NO_MATCH"}


def test_alias_resolve(spark, tables):
    observed, master = tables
    aliases = {r.key: (r.canonical_team_name, r.confidence) for r in X.aliases(spark, SF).withColumn("key", N.team_name("alias_name")).orderBy("alias_name").collect()[::-1]}
    exact = {r.name: (r.match, r.score) for r in Q["blocked_best_match"](spark, SF).collect()}
    masters = sorted((o, k, m) for (o, m), k in master.items())
    got = {r.name: (r.canonical, r.confidence, r.source) for r in Q["alias_resolve"](spark, SF).collect()}
    kinds = {}
    for (_, n), k in observed.items():
        near = [(-hybrid(k, b), o, b, m) for o, b, m in masters] if k and k not in aliases and n not in exact else []
        score, _, b, m = min(near, default=(0, 0, "", ""))
        a, c = ({w for w in t.split() if len(w) > 1 and w not in N.GENERIC_TOKENS} for t in (k, b))
        overlap = len(a & c) / len(a | c) if a or c else 1.0
        if k in aliases:
            want = (*aliases[k], "alias")
        elif n in exact:
            want = (exact[n][0], 0.9, "strict")
        elif -score >= 0.9 and overlap >= 0.6:
            want = (min((o, m) for o, kk, m in masters if kk == b)[1], -score, "hybrid")
        else:
            want = (None, 0.0, "unmatched")
        kinds[want[2]] = kinds.get(want[2], 0) + 1
        assert got[n] == (want[0], pytest.approx(want[1], abs=1e-6), want[2]), n
    assert {"strict", "hybrid", "unmatched"} <= kinds.keys()


def test_queries_read_given_tables(spark):
    """No query builds over a folder that is not there."""
    for name, build in Q.items():
        with pytest.raises(Exception):  # noqa: B017
            build(spark, "/nowhere/at/all").count()
            print(name)
