"""Normalising and parsing of team names as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substitutions of the aggressive normaliser, applied in this order, also inside words.
SUBSTITUTIONS = [
    ("soccer club", "sc"), ("football club", "fc"), ("futbol club", "fc"), ("futbol", "fc"), ("academy", "acad"), ("athletic club", "ac"),
    ("sports club", "sc"), ("youth soccer", "ys"), ("premier", "prem"), ("select", "sel"), ("association", "assoc"), ("athletic", "ath"),
    ("under", "u"), ("u-", "u"), ("boys", "b"), ("girls", "g"), ("male", "b"), ("female", "g"), ("men", "b"), ("women", "g"),
]
# Substitutions of club names.
CLUB_SUBSTITUTIONS = [
    ("soccer club", "sc"), ("football club", "fc"), ("futbol club", "fc"), ("academy", "acad"), ("athletic club", "ac"), ("sports club", "sc"),
    ("youth soccer", "ys"), ("premier", "prem"), ("select", "sel"), ("association", "assoc"), ("athletic", "ath"),
]
# Tokens without meaning for a comparison.
GENERIC_TOKENS = ["fc", "sc", "ac", "acad", "prem", "elite", "sel", "united", "city", "town", "assoc", "ath", "sports", "soccer", "football", "youth", "club", "team", "b", "g", "boys", "girls", "male", "female", "men", "women"]
# Names whose colour is part of them.
COLOUR_TEAMS = ["southeast 2014 boys black", "sffa 2014 boys white", "sffa 2014 boys blue", "doral sc white 2014", "miami skies fc 2014 black", "2014 cyclones boys black"]
# Club suffixes, team designations, coach names and state abbreviations, each tried in this order.
CLUB_SUFFIXES = ["fc", "sc", "united", "city", "town", "academy", "club", "association", "athletic", "sports", "soccer", "football", "youth", "premier", "elite"]
DESIGNATIONS = [
    "red", "blue", "green", "white", "black", "gold", "silver", "orange", "purple", "yellow", "navy", "maroon", "gray", "grey", "pink",
    "premier", "elite", "select", "academy", "pre", "development", "travel", "recreation", "rec", "competitive", "comp",
]
COACHES = [
    "chacon", "perez", "garcia", "rodriguez", "martinez", "hernandez", "lopez", "gonzalez", "wilson", "smith", "johnson", "brown", "jones", "miller", "davis",
    "castro", "mendoza", "cisneros", "delta", "alpha", "beta", "gamma", "anderson", "thomas", "taylor", "moore", "jackson", "martin", "lee",
    "thompson", "white", "harris", "sanchez", "clark", "ramirez", "lewis", "robinson",
]
STATES = [
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny",
    "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy",
    "ala", "alaska", "ariz", "ark", "calif", "colo", "conn", "del", "fla", "geo", "hawaii", "idaho", "ill", "ind", "iowa", "kans", "kent", "maine", "mass", "mich", "minn", "miss", "mont", "neb", "nev",
    "ohio", "okla", "ore", "tenn", "tex", "utah", "wash", "wis",
]
# Words that are no coach, and Roman numerals.
NOT_COACHES = ["team", "club", "fc", "sc", "united", "boys", "girls", "male", "female", "premier", "elite", "select", "academy"]
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
#: Words, digits and blanks of any script, as names are written in many.
U = "(?U)"


def _decomposed() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters that a compatibility decomposition turns into one ASCII letter or digit, these, and ligatures with their letters."""
    ascii_of = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x.isascii()) for c in range(0x80, 0x1_0000)}
    single = [(a, b) for a, b in ascii_of.items() if len(b) == 1 and b.isalnum()]
    return "".join(a for a, _ in single), "".join(b for _, b in single), [(a, b) for a, b in ascii_of.items() if len(b) > 1 and b.isalpha() and unicodedata.category(a) in ("Ll", "Lu", "Lt")]


ACCENTED, PLAIN, LIGATURES = _decomposed()


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{U}\s+", " "))


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), pairs, c)


def basic_name(c: str) -> Column:
    return _squeezed(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9 ]", ""))


def light_name(c: str) -> Column:
    """Accents off by compatibility decomposition, lower case, punctuation to blanks; every word stays."""
    plain = F.regexp_replace(F.translate(_replaced(_text(c), LIGATURES), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return _squeezed(F.regexp_replace(F.lower(plain), "[^a-z0-9 ]", " "))


def canonical_name(c: str, keep_colours: bool = True) -> Column:
    whole = F.trim(F.lower(_text(c)))
    s = F.regexp_replace(whole, U + r"\s+\((h|a)\)$", "")
    s = F.regexp_replace(s, U + r"\bsc\b|\bfc\b|\bacademy\b", "")
    s = _squeezed(_replaced(s, [("boys", ""), ("girls", ""), ("b14", "2014"), ("b15", "2015")]))
    s = F.trim(F.regexp_replace(s, U + r"\s+(blue|red|white|black|gold|maroon|green|navy|silver|grey|gray)$", ""))
    s = F.when(whole.isin(COLOUR_TEAMS), whole).otherwise(s) if keep_colours else s
    return F.when(F.col(c).isNotNull(), s)


def division_name(c: str) -> Column:
    """One leading prefix of each kind goes, then boys, girls, fc, sc and academy after a blank."""
    s = F.trim(F.lower(_text(c)))
    for prefix in ("fc ", "sc ", "soccer club ", "football club "):
        s = F.when(s.startswith(prefix), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)
    s = _replaced(s, [(w, "") for w in (" boys", " girls", " fc", " sc", " academy")])
    return F.when(F.col(c).isNotNull(), _squeezed(s))


def club_prefixed(c: Column, prefixes: dict[str, list[str]]) -> Column:
    """The canonical club in place of its first matching variation, in the order of the table."""
    tried = [F.when(c.startswith(v), F.concat(F.lit(club), F.substr(c, F.lit(len(v) + 1)))) for club, vs in prefixes.items() for v in vs]
    return F.coalesce(*tried, c) if tried else c


def team_name(c: str, prefixes: dict[str, list[str]] | None = None, season: int = 2026) -> Column:
    """Aggressive normalisation: substitutions, years to two digits, U-ages to birth years, gender marks and punctuation off."""
    s = club_prefixed(F.trim(F.lower(_text(c))), prefixes or {})
    s = _replaced(s, SUBSTITUTIONS)
    s = F.regexp_replace(s, U + r"\b20(\d{2})\b", "$1")
    for age in range(10, 20):
        s = F.regexp_replace(s, rf"{U}\bu{age}\b", f"{season - age}"[2:])
    s = F.regexp_replace(s, U + r"\b(\d{2})[bg]\b", "$1")
    s = F.regexp_replace(s, U + r"\b20(\d{2})[bg]\b", "$1")
    s = F.regexp_replace(s, U + r"\b(boys?|girls?|male|female|men|women|b|g)\b", "")
    return _squeezed(F.regexp_replace(s, U + r"[^\w\s]", " "))


def club_name(c: str) -> Column:
    s = _replaced(F.trim(F.lower(_text(c))), CLUB_SUBSTITUTIONS)
    return _squeezed(F.regexp_replace(s, U + r"\b(fc|sc|ac|acad|prem|elite|sel|united|city|assoc|ath)\b", ""))


def matcher_club(c: Column) -> Column:
    """Suffixes in list order, then prefixes, then punctuation."""
    s = F.trim(F.lower(c))
    for suffix in CLUB_SUFFIXES:
        s = F.trim(F.regexp_replace(s, f" {suffix}$", ""))
    for prefix in ("the ", "fc ", "sc "):
        s = F.trim(F.regexp_replace(s, f"^{prefix}", ""))
    return _squeezed(F.regexp_replace(s, U + r"[^\w\s]", ""))


def meaningful_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(GENERIC_TOKENS))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the meaningful tokens; 1 if neither has any, 0 if one has none."""
    x, y = F.array_distinct(meaningful_tokens(a)), F.array_distinct(meaningful_tokens(b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _century(two: Column) -> Column:
    n = two.try_cast("int")
    return F.when(n <= 30, F.concat(F.lit("20"), two)).when(n.between(80, 99), F.concat(F.lit("19"), two))


def birth_year(c: Column, season: int = 2026) -> Column:
    """A four-digit year, a U-age, a two-digit year, or a two-digit year with a gender letter; the first kind that is there."""
    age = _group(c, U + r"\bu(\d{1,2})\b").try_cast("int")
    of_age = F.when(age.between(10, 19), (F.lit(season) - age).cast("string"))
    return F.coalesce(_group(c, U + r"\b(20\d{2})(?:[a-zA-Z]|\b)"), of_age, _century(_group(c, U + r"\b(\d{2})\b")), _century(_group(c, U + r"\b(\d{2})[bg]\b")), F.lit(""))


def _words(c: Column) -> Column:
    """The words of a name between blanks; the parser reads names whose white space is single blanks."""
    return F.split(c, " ")


def _list(words: list[str]) -> Column:
    """A constant array from one literal, so that a plan does not grow with the list."""
    return F.split(F.lit(" ".join(words)), " ")


def _first_word(words: Column, listed: list[str]) -> Column:
    """The word of the list that comes first in the list among those that the name holds: the least place of its words."""
    places = F.map_from_arrays(_list(listed), F.sequence(F.lit(1), F.lit(len(listed))))
    return F.get(_list(listed), F.array_min(F.transform(words, lambda w: F.element_at(places, w))) - 1)


def _any_word(words: Column, listed: list[str]) -> Column:
    return F.arrays_overlap(words, _list(listed))


def gender(c: Column, words: Column | None = None) -> Column:
    w = _words(c) if words is None else words
    mark = F.regexp_extract(c, U + r"\b\d{2,4}([bg])\b", 1)
    return F.when(_any_word(w, ["boys", "b", "male", "m"]), "boys").when(_any_word(w, ["girls", "g", "female", "f"]), "girls").when(mark == "b", "boys").when(mark == "g", "girls").otherwise("")


def designation(c: Column, words: Column | None = None) -> Column:
    """Roman numeral, single letter but b and g, number that is no year, or a word of the list; only the first hit of a kind counts."""
    low = F.lower(c)
    numerals = F.map_from_arrays(_list(list(ROMAN)), _list(list(ROMAN.values())))
    roman = _group(low, U + r"\b(i|ii|iii|iv|v|vi|vii|viii|ix|x)\b")
    letter = _group(low, U + r"\b([a-z])\b")
    number = _group(c, U + r"\b(\d+)\b")
    named = lambda n: F.when(~((F.length(n) == 4) | ((F.length(n) == 2) & (n.try_cast("int") <= 30))), n)
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a pattern is searched once for all uses
    return F.coalesce(F.element_at(numerals, roman), once(letter, lambda x: F.when(~x.isin("b", "g"), x)), once(number, named), _first_word(_words(c) if words is None else words, DESIGNATIONS), F.lit(""))


def coach(c: Column, words: Column | None = None) -> Column:
    """A known name at the end, else the last word, else the last word before a number; short and generic words do not count."""
    w = _words(c) if words is None else words
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    known = F.when((F.size(w) > 1) & F.array_contains(_list(COACHES), F.element_at(w, -1)), F.element_at(w, -1))
    fits = lambda word: once(word, lambda x: F.when((F.length(x) > 3) & ~F.array_contains(_list(NOT_COACHES), x), x))
    last = F.lower(_group(c, U + r"\b([A-Za-z]+(?:\.[A-Za-z])?)\s*(?:\d+\s*)?$"))
    before = F.regexp_extract_all(c, F.lit(U + r"\b([A-Za-z]+(?:\.[A-Za-z])?)\s+\d+"), F.lit(1))
    return F.coalesce(known, fits(last), fits(F.lower(once(before, lambda b: F.get(b, F.size(b) - 1)))), F.lit(""))


def state(c: Column, words: Column | None = None) -> Column:
    return F.coalesce(_first_word(_words(F.lower(c)) if words is None else words, STATES), F.lit(""))


def club(c: Column, year: Column, sex: Column, mark: Column, trainer: Column) -> Column:
    """What is left of the name without the other fields."""
    word = lambda w: F.concat(F.lit(U + r"\b"), F.regexp_replace(w, r"([.\\+*?\[^\]$(){}=!<>|:#-])", r"\\\\$1"), F.lit(r"\b"))
    drop = lambda s, pattern, when: F.trim(F.regexp_replace(s, F.when(when, pattern).otherwise(F.lit("(?!)")), F.lit("")))  # noqa: E731  names s once, else the tree doubles with every step
    s = drop(c, word(year), year != "")
    s = drop(s, word(F.substring(year, 3, 2)), F.length(year) == 4)
    for name, terms in (("boys", "boys|b|male|m"), ("girls", "girls|g|female|f")):
        s = drop(s, F.lit(rf"{U}\b(?:{terms})\b"), sex == name)
    s = drop(s, word(mark), mark != "")
    s = drop(s, word(trainer), trainer != "")
    return _squeezed(F.regexp_replace(s, U + r"\bu\d{1,2}\b", ""))


def parsed(c: str, season: int = 2026) -> Column:
    """Struct of the fields of a name. The name is read in lower case, so that gender marks are still there."""
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  computes a value once for all its uses

    def fields(s: Column) -> Column:
        low, words = s["low"], s["words"]
        return F.struct(birth_year(low, season).alias("y"), gender(low, words).alias("g"), designation(low, words).alias("d"), coach(low, words).alias("t"), state(low, words).alias("s"), low.alias("low"))

    def assembled(p: Column) -> Column:
        y, g, d, t, low = (p[k] for k in ("y", "g", "d", "t", "low"))
        return F.struct(club(low, y, g, d, t).alias("club"), y.alias("birth_year"), g.alias("gender"), d.alias("designation"), t.alias("coach"), p["s"].alias("state"), F.col(c).alias("original"), low.alias("normalized"))

    read = bound(_squeezed(F.lower(_text(c))), lambda low: F.struct(low.alias("low"), _words(low).alias("words")))
    return bound(bound(read, fields), assembled)


def team_id(division: Column | str, canonical: str) -> Column:
    d = F.lit(division) if isinstance(division, str) else division
    return F.substring(F.sha1(F.concat_ws(":", d, F.col(canonical)).cast("binary")), 1, 12)


def is_team_id(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("^[0-9a-fA-F]{12}$"), F.lit(False))


def division_age(c: str) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.translate(F.col(c), "-", "_"), r"(?:^|_)([uU]\d+)(?:_|$)", 1)), F.lit(""))


def slice_suffix(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)
