"""Names: parsing, the gate of the strict matcher, similarity against plain Python."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import names as N
from pitchlake.functions import similarity as M
from pitchlake.operators import matching


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_parse(spark):
    texts = ["Phoenix Rovers 2014 Boys Red Garcia", "Desert Owls 16g II", "Harbor FC U12 Girls", "", None, "x" * 20_000]
    got = spark.createDataFrame([(t,) for t in texts], "name string").select(N.parsed("name").alias("p")).select("p.*").collect()
    assert [(r.birth_year, r.gender, r.designation) for r in got[:3]] == [("2014", "boys", "red"), ("2016", "girls", "2"), ("2014", "girls", "")]
    assert got[0].coach == "garcia" and got[0].club == "phoenix rovers"
    assert got[4].normalized == "" and got[4].original is None


def test_parse_on_empty_table(spark):
    assert spark.createDataFrame([], "name string").select(N.parsed("name").alias("p")).count() == 0


def test_common_subsequence(spark):
    pairs = [("riptide black 16", "16 team black"), ("", "abc"), ("abc", ""), ("same", "same"), ("abcdef", "badcfe")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(M.common_subsequence(F.col("a"), F.col("b"))).collect()]
    assert got == [lcs(*p) for p in pairs]


def test_hybrid_score_of_a_known_pair(spark):
    row = spark.createDataFrame([("riptide black 16", "16 team black")], "a string, b string").select(M.token_sort_ratio(F.col("a"), F.col("b")).alias("r")).first()
    assert row.r == pytest.approx(22 / 29)


def test_block_ratio(spark):
    pairs = [("rovers", "rover"), ("a", None), ("north star", "star north")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(M.block_ratio("a", "b")).collect()]
    assert got == pytest.approx([SequenceMatcher(None, a, b).ratio() if b else 0.0 for a, b in pairs])


def test_strict_matcher(spark):
    # "rovers 2014" makes rovers the coach, so that pair's clubs are "phoenix rising" and "phoenix rising rovers": 14 of 21 characters, under the 0.7 that the gate asks for
    names = ["2014 Boys Phoenix Rising Rovers Red", "2013 Boys Phoenix Rising Rovers Red", "Phoenix Rising Rovers 2014 Boys Red", "Silver Lake Owls 2014 Boys", None]
    lists = ["2014 Boys Phoenix Rising Rovers SC Red", "Phoenix Rising Rovers SC 2014 Boys Red", "Golden Lake Hawks 2014 Boys", None]
    observed = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.match for r in matching.best_master(observed, spark.createDataFrame(list(enumerate(lists)), "ord int, name string")).collect()}
    assert got.get(names[0]) == lists[0]
    assert names[1] not in got and names[3] not in got and got.get(names[2]) != lists[1]


def test_keep_first_and_best(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "b", 2.0), (3, "a", 3.0)], "ord int, k string, score double")
    assert sorted(r.ord for r in matching.keep_first(df, ["k"], ["ord"]).collect()) == [0, 2]
    assert sorted(r.ord for r in matching.best(df, "k", "score", "ord").collect()) == [1, 2]


def test_matching_of_names_without_a_shared_token(spark):
    observed = spark.createDataFrame([("desertfoxes",), ("oaklnd rovrs",), ("zzz",), ("",), (None,)], "name string")
    master = spark.createDataFrame([(0, "desert foxes"), (1, "oakland rovers"), (2, "silver owls"), (3, None)], "ord int, name string")
    got = {(r.name, r.match): r.nth for r in matching.hybrid_candidates(observed, master).collect()}
    assert got["desertfoxes", "desert foxes"] == 1 and got["oaklnd rovrs", "oakland rovers"] == 1 and not any(n == "zzz" for n, _ in got)
    fuzzy = {r.name: (r.match, r.match_type) for r in matching.exact_or_fuzzy(observed.where("name is not null"), master.where("name is not null")).collect()}
    assert fuzzy["desertfoxes"] == ("desert foxes", "FUZZY") and fuzzy["oaklnd rovrs"] == ("oakland rovers", "FUZZY") and fuzzy["zzz"][1] == "NO_MATCH" and fuzzy[""][1] == "EMPTY"


def test_containment_in_either_direction(spark):
    a = ["Foxes2016", "Oak", "", "red blue x", "Alpha Beta Gamma", "ab", "é", None, "OAK"]
    b = ["Foxes", "Oakland", "blue  red y", "beta gamma delta", "xaby", "Café", None, "Oak"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    want = set()
    for x in filter(lambda v: v is not None, a):
        held = {(x, y, True) for y in b if y is not None and (x.lower() in y.lower() or y.lower() in x.lower())}
        want |= held or {(x, y, False) for y in b if y is not None and len(set(x.lower().split()) & set(y.lower().split())) >= 2}
    assert {tuple(r) for r in matching.contains_either(frame(a), frame(b)).collect()} == want


def test_names_in_other_scripts(spark):
    texts = ["Águilas SC 2016 Boys", "Élan fc Négro Academy", "ﬁne Ǆ Ｆｕｌｌ ½", "Ñandú-b 16b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "n string").select(N.canonical_name("n")).collect()]
    assert got == ["águilas 2016", "élan négro", "ﬁne ǆ ｆｕｌｌ ½", "ñandú-b 16b"]
    light = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "n string").select(N.light_name("n")).collect()]
    assert light[0] == "aguilas sc 2016 boys" and light[2].startswith("fine dz full") and light[3] == "nandu b 16b"
