"""Exact similarity joins of two lists of names: no pair over the limit is lost, and only pairs that can be over it meet.

Indel ratio, 2 L / (|x| + |y|) with L the longest common subsequence. If it is r or more, L is at least r (|x| + |y|) / 2, so x keeps all
but d_x = |x| - L of its characters and y gains d_y = |y| - L. A character that goes spoils two of x's 2-grams, one that
comes in spoils one: all but 2 d_x + d_y of x's grams stand in y as well, at most max(d_x, d_y) places away. So x meets y
through one of its 2 d_x + d_y + 1 rarest grams (prefix filter), if the places (position filter) and the lengths (length filter) agree.
Names for which so many grams are not there, as the limit is low, meet all names of fitting length instead, in cells.

Cells are cut by pairs.dealt, so a gram or token that most names hold is spread evenly. In a cell a pair is first bounded by the
characters that the names have in common (a product of 0/1 matrices), then the subsequence is computed in bits for all pairs at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.functions import names as N
from pitchlake.functions import similarity as M
from pitchlake.operators.pairs import crossed, join_counted, ranged_join, solved
from pitchlake.operators.sos import cut

EPS = 1e-9
#: For bounds in single precision.
SLACK = 1e-5
#: Left rows of a cell that are multiplied with all right ones at a time.
BLOCK = 256


def grams(text: Column) -> Column:
    """Array of (place, gram) of a text's 2-grams."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.struct(i.alias("place"), F.substr(text, i, F.lit(2)).alias("gram")))


def _long_enough(df: DataFrame) -> DataFrame:
    return df.where(F.length("s") >= 2)


def spoilt() -> Column:
    """The most grams of ``s`` that a name with an Indel ratio of ``least`` to it can lack; the worse end of the fitting lengths."""
    n, r = F.length("s").cast("double"), F.col("least")
    of = lambda m: 2 * n + m - 1.5 * r * (n + m)
    return F.floor(F.greatest(of(n * r / (2 - r)), of(n * (2 - r) / r)) + EPS).cast("int")


def probes(left: DataFrame, right: DataFrame) -> DataFrame:
    """name, s, least, gram, place: the rarest grams of each name, by which it must meet; an empty gram where that needs more than it has."""
    often = _long_enough(right).select(F.explode(grams(F.col("s"))).alias("g")).groupBy(F.col("g.gram").alias("gram")).agg(F.count("*").alias("n"))
    x = left.withColumn("need", spoilt() + 1)
    few = x.where(F.col("need") > F.length("s") - 1).select("name", "s", "least", F.lit("").alias("gram"), F.lit(0).alias("place"))
    each = x.where(F.col("need") <= F.length("s") - 1).withColumn("g", F.explode(grams(F.col("s")))).select("name", "s", "least", "need", "g.gram", "g.place")
    held = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "place")))  # as long as the name
    rare = join_counted(each, often, ["gram"], "left").groupBy("name", "s", "least", "need").agg(held.alias("h")).withColumn("h", F.explode(F.slice("h", F.lit(1), F.col("need")))).where("h.n > 0")
    return rare.select("name", "s", "least", "h.gram", "h.place").union(few)


def _blocks(n: int):
    """Runs of left rows, so that the products of a run with the right rows stay small."""
    return ((at, min(at + BLOCK, n)) for at in range(0, n, BLOCK))


def near_cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """name, match, ord, ratio of the pairs of a cell that reach the left name's ``least``.

    Rows of characters carry the lengths as well, so one product gives the common characters less those that the limit asks for.
    """
    found = pd.DataFrame({"name": pd.Series(dtype=str), "match": pd.Series(dtype=str), "ord": pd.Series(dtype="int64"), "ratio": pd.Series(dtype=float)})
    if not len(a) or not len(b):
        return found
    x, y = a.s.tolist(), b.s.tolist()
    n, m = (np.array([len(t) for t in side]) for side in (x, y))
    r = a.least.to_numpy()
    u, v = M.character_rows(x, y)
    u = np.column_stack([u, -r / 2 * n, -r / 2]).astype(np.float32)
    v = np.column_stack([v, np.ones(len(y)), m]).astype(np.float32).T.copy()
    slack = -SLACK * (1 + n.max() + m.max())
    hits = [np.divmod(np.flatnonzero(u[s:e] @ v >= slack) + s * len(y), len(y)) for s, e in _blocks(len(x))]
    i, j = (np.concatenate(side) for side in zip(*hits, strict=True))
    total = n[i] + m[j]
    least = np.ceil(r[i] * total / 2 - EPS)  # common characters that the limit asks for
    close = least <= np.minimum(n[i], m[j])
    if a.gram.iloc[0]:
        apart = a.place.to_numpy()[i] - b.place.to_numpy()[j]
        close &= (apart <= n[i] - least) & (-apart <= m[j] - least)
    i, j, total = i[close], j[close], total[close]
    ratio = 2.0 * M.common_lengths(x, y, i, j) / np.maximum(total, 1)
    keep = ratio >= r[i] - EPS
    i, j = i[keep], j[keep]
    return pd.DataFrame({"name": a.name.to_numpy()[i], "match": b.match.to_numpy()[j], "ord": b.ord.to_numpy()[j], "ratio": ratio[keep]}) if len(i) else found


def near(left: DataFrame, right: DataFrame) -> DataFrame:
    """name, match, ord, ratio of all pairs with an Indel ratio of s and s of ``least`` or more (0 < least), each once.

    left: name, s, least; right: match, ord, s. Texts without characters meet nothing.
    """
    probe = probes(left.where("s <> '' and least <= 1"), right).dropDuplicates(["name", "s", "gram", "place"])
    index = _long_enough(right).select("match", "ord", "s", F.explode(grams(F.col("s"))).alias("g")).select("match", "ord", "s", "g.gram", "g.place")
    whole = right.where("s <> ''").select("match", "ord", "s", F.lit("").alias("gram"), F.lit(0).alias("place"))
    return solved(probe, index.union(whole), ["gram"], near_cell, "name string, match string, ord long, ratio double").distinct()


#: Pairs of all texts for one pair met by a gram, from which texts are met by grams.
GRAMS_PAY = 16


def _few_met(x: DataFrame, y: DataFrame) -> bool:
    """Whether the pairs that share a gram are few beside all pairs. A text and its grams are counted, nothing is met."""
    of = lambda df, n: _long_enough(df).select(F.explode(grams(F.col("s"))).alias("g")).groupBy("g.gram").agg(F.count("*").cast("double").alias(n))
    met = of(x, "n").join(of(y, "m").hint("merge"), "gram").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0)).alias("met"))
    every = x.agg(F.count("*").alias("p")).crossJoin(F.broadcast(y.agg(F.count("*").alias("q"))))
    return met.crossJoin(F.broadcast(every)).select(F.col("met") * GRAMS_PAY < F.col("p") * F.col("q")).first()[0]


def indel_join(left: DataFrame, right: DataFrame, least: float, text=lambda c: c) -> DataFrame:
    """name, match, ord, ratio of the pairs whose texts have an Indel ratio of ``least`` or more. left: name; right: match, ord.

    Equal texts are compared once. They meet by grams if few share one; in rosters most grams are frequent, and copying the texts for
    each costs more than all pairs in cells do.
    """
    x = cut(left.where("name is not null").select("name", text(F.col("name")).alias("s")).distinct())
    y = cut(right.where("match is not null").select("match", F.col("ord").cast("long").alias("ord"), text(F.col("match")).alias("s")).distinct())
    a = cut(x.where("s <> ''").select("s").distinct())
    b = cut(y.where("s <> ''").select("s").distinct())
    probe = a.select(F.col("s").alias("name"), "s", F.lit(float(least)).alias("least"))
    index = b.select(F.col("s").alias("match"), F.lit(0).cast("long").alias("ord"), "s")
    if _few_met(a, b):
        met = near(probe, index)
    else:
        met = crossed(probe.withColumn("gram", F.lit("")), index, near_cell, "name string, match string, ord long, ratio double")
    pairs = met.select(F.col("name").alias("s"), F.col("match").alias("t"), "ratio")
    named = x.join(pairs.hint("merge"), "s")
    return named.join(y.withColumnRenamed("s", "t").hint("merge"), "t").select("name", "match", "ord", "ratio")


def _chosen(column: str, n: int) -> Column:
    """Each choice of n entries of an array, in its order, as an array of arrays."""
    at = lambda i: F.slice(column, i + 2, F.size(column))
    if n == 1:
        return F.transform(column, lambda v: F.array(v))
    if n == 2:
        return F.flatten(F.transform(column, lambda v, i: F.transform(at(i), lambda u: F.array(v, u))))
    return F.flatten(F.transform(column, lambda v, i: F.flatten(F.transform(at(i), lambda u, j: F.transform(F.slice(column, i + j + 3, F.size(column)), lambda w: F.array(v, u, w))))))


def jaccard_join(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """name, match, ord, overlap of the pairs whose meaningful tokens agree to ``least`` or more (0 < least), by their rarest tokens.

    Names of the same tokens are compared once. Two sets of n and m tokens with that Jaccard similarity share c = least (n + m) / (1 + least)
    tokens, rounded up, so the first l of those they share are among the n - c + l rarest of the one and the m - c + l rarest of
    the other, in one order of rarity for both. They meet by these l, up to three, so that frequent tokens don't make everything meet.
    """
    sets = lambda c: F.array_sort(F.array_distinct(N.meaningful_tokens(F.col(c))))
    x = cut(left.select("name").where("name is not null").distinct().withColumn("x", sets("name")))
    y = cut(right.select("match", "ord").where("match is not null").withColumn("y", sets("match")).distinct())
    a, b = cut(x.select(F.col("x").alias("t")).distinct()), cut(y.select(F.col("y").alias("t")).distinct())
    often = a.select(F.explode("t").alias("w")).union(b.select(F.explode("t").alias("w"))).groupBy("w").agg(F.count("*").alias("f"))

    def rare(df: DataFrame) -> DataFrame:
        """With ``h``, the tokens from the rarest."""
        each = join_counted(df.select("t", F.explode("t").alias("w")), often, ["w"])
        return cut(each.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("h")).select("t", F.col("h.w").alias("h"), F.size("t").alias("n")))

    def keyed(df: DataFrame, sizes: DataFrame, h: str, mine: str, other: str) -> DataFrame:
        n, m = F.col("n"), F.col("m")
        fit = df.join(F.broadcast(sizes), F.least(n, m) >= least * F.greatest(n, m) - EPS)  # a row a size
        c = F.ceil(least * (n + m) / (1 + least) - EPS).cast("int")
        spare = F.greatest(n, m) - c
        some = F.least(c, F.when(spare <= 4, 3).when(spare <= 12, 2).otherwise(1))
        p = fit.withColumn("l", some).withColumn("p", F.slice("h", F.lit(1), n - c + F.col("l")))
        keys = F.when(F.col("l") == 3, _chosen("p", 3)).when(F.col("l") == 2, _chosen("p", 2)).otherwise(_chosen("p", 1))
        return p.select(n.alias(mine), m.alias(other), F.col("h").alias(h), F.col("t").alias(f"{h}_t"), F.explode(keys).alias("key"))

    u, v = rare(a), rare(b)
    sizes = lambda df: df.select(F.col("n").alias("m")).distinct()
    pairs = ranged_join(keyed(u, sizes(v), "x", "nx", "ny"), keyed(v, sizes(u), "y", "ny", "nx"), ["nx", "ny", "key"])
    common = F.array_intersect("x", "y")  # in the order of rarity
    pairs = pairs.where(F.slice(common, F.lit(1), F.size("key")) == F.col("key")).withColumn("shared", F.size(common))
    alike = pairs.withColumn("overlap", F.col("shared") / (F.col("nx") + F.col("ny") - F.col("shared"))).where(F.col("overlap") >= least - EPS).select(F.col("x_t").alias("x"), F.col("y_t").alias("y"), "overlap")
    none = a.where("size(t) = 0").select(F.col("t").alias("x")).crossJoin(F.broadcast(b.where("size(t) = 0").select(F.col("t").alias("y")))).withColumn("overlap", F.lit(1.0))  # one row at most
    named = x.join(alike.union(none).hint("merge"), "x")
    return named.join(y.hint("merge"), "y").select("name", "match", "ord", "overlap")


def hybrid_cell(k: int, least: float):
    """For a cell of any names: of each left name, the k best right ones by the hybrid score among those over ``least`` that can reach its ``floor``; ties to the smaller ord."""

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"name": pd.Series(dtype=str), "match": pd.Series(dtype=str), "ord": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        if not len(a) or not len(b):
            return out
        b = b.sort_values("ord", kind="stable")
        x, y = a.s.tolist(), b.s.tolist()
        n, m = (np.array([len(t) for t in side], np.float32) for side in (x, y))
        u, v = M.character_rows(x, y)
        sets = [M.meaningful(side.tolist(), N.GENERIC_TOKENS) for side in (a.name, b.match)]
        p, q = M.word_rows(*sets)
        nw, mw = (np.array([len(w) for w in side], np.float32) for side in sets)
        floor = np.maximum(a.floor.to_numpy(), least)
        found = []

        def scores(i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> np.ndarray:
            t = (n[i] + m[j]).astype(np.int64)
            either = nw[i].astype(float) + mw[j] - shared
            overlap = np.where(either > 0, shared / np.maximum(either, 1), 1.0)
            return 0.6 * np.where(t > 0, 2.0 * M.common_lengths(x, y, i, j) / np.maximum(t, 1), 1.0) + 0.4 * overlap

        for s, e in _blocks(len(x)):
            total, shared = n[s:e, None] + m, p[s:e] @ q.T
            most = u[s:e] @ v.T
            most *= 1.2
            most /= np.maximum(total, 1)
            most[total == 0] = 0.6
            either = (nw[s:e, None] + mw) - shared
            part = shared / np.maximum(either, 1)
            part[either == 0] = 1
            part *= np.float32(0.4)
            most += part
            near = most >= (floor[s:e, None] - SLACK).astype(np.float32)
            many = np.flatnonzero(near.sum(axis=1) > 8 * k) if len(y) > k else []
            if len(many):  # the k-th score of those that promise most raises the floor
                first = np.argpartition(-most[many], k - 1, axis=1)[:, :k]
                i, j = np.repeat(many, k), first.reshape(-1)
                kth = scores(i + s, j, shared[i, j]).reshape(-1, k).min(axis=1)
                floor[many + s] = np.maximum(floor[many + s], kth)
                near[many] = most[many] >= (floor[many + s, None] - SLACK).astype(np.float32)
            i, j = np.nonzero(near)
            found.append((i + s, j, shared[i, j]))
        i, j, shared = (np.concatenate(side) for side in zip(*found, strict=True))
        got = pd.DataFrame({"i": i, "j": j, "score": scores(i, j, shared)})
        got = got[got.score > least].sort_values(["i", "score", "j"], ascending=[True, False, True], kind="stable").groupby("i").head(k)
        return pd.DataFrame({"name": a.name.to_numpy()[got.i], "match": b.match.to_numpy()[got.j], "ord": b.ord.to_numpy()[got.j], "score": got.score.to_numpy()}) if len(got) else out

    return solve


#: Names of more meaningful tokens give no keys of two tokens less.
MOST_TOKENS = 12


def _nearly(df: DataFrame, column: str) -> DataFrame:
    """With ``w``, the meaningful tokens, and ``key``: a row for all of them and for each choice of one or two to leave out, if any are left."""
    w, at = F.col("w"), F.sequence(F.lit(0), F.size("w") - 1)
    joined = lambda drop: F.array_join(F.filter(w, lambda _, p: ~drop(p)), " ")
    one = F.transform(at, lambda i: joined(lambda p: p == i))
    two = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: joined(lambda p: (p == i) | (p == j)))))
    keys = F.concat(F.array(F.array_join(w, " ")), one, F.when(F.size("w") <= MOST_TOKENS, two).otherwise(F.array().cast("array<string>")))
    held = df.withColumn("w", F.array_sort(F.array_distinct(N.meaningful_tokens(F.col(column))))).where(F.size("w") > 0)
    return held.withColumn("key", F.explode(F.array_distinct(keys))).where("key <> ''")


def floors(x: DataFrame, y: DataFrame, k: int, least: float) -> DataFrame:
    """name, floor: a score that k rows of y reach for sure, if so many are found that lack at most two of the name's tokens. It only saves work.

    x: name, s; y: match, ord, s. Of the rows that share a key the k first are looked at, of these the k of the largest token overlap.
    """
    from pitchlake.operators.matching import best

    few = best(_nearly(y, "match").withColumn("one", F.lit(1)), "key", "one", "ord", k).select("key", "match", "ord", F.col("s").alias("t"), F.col("w").alias("v"))
    met = _nearly(x, "name").select("name", "s", "w", "key").join(few.hint("merge"), "key").drop("key").distinct()
    shared = F.size(F.array_intersect("w", "v"))
    tried = best(met.withColumn("overlap", shared / (F.size("w") + F.size("v") - shared)), "name", "overlap", "ord", k)
    scored = tried.withColumn("score", 0.6 * M.subsequence_ratio("s", "t") + 0.4 * F.col("overlap"))
    return scored.groupBy("name").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("name", "floor")


def hybrid_best(left: DataFrame, right: DataFrame, k: int = 3, least: float = 0.3) -> DataFrame:
    """name, match, ord, score, nth: the k best of every name by the hybrid score over ``least``; ties to the smaller ord. left: name; right: match, ord.

    Most tokens of a roster are frequent, so all pairs meet, but in cells that bound a pair by common characters and tokens
    (products of 0/1 matrices). Only pairs that can reach the name's floor, the k-th score of rows nearly alike, are computed.
    Rows of one match score alike: it is compared once and the k first of its rows are taken up again at the end.
    """
    from pitchlake.operators.matching import best

    x = cut(left.select("name").where("name is not null").distinct().withColumn("s", N.sorted_tokens(F.col("name"))))
    rows = best(right.where("match is not null").select("match", F.col("ord").cast("long").alias("ord"), F.lit(1).alias("one")).distinct(), "match", "one", "ord", k)
    rows = cut(rows.select("match", "ord", N.sorted_tokens(F.col("match")).alias("s"), "nth"))
    y = rows.where("nth = 1").select("match", "ord", "s")
    floored = x.join(floors(x, rows.drop("nth"), k, least).hint("merge"), "name", "left").withColumn("floor", F.coalesce("floor", F.lit(float(least))))
    met = crossed(cut(floored), y, hybrid_cell(k, least), "name string, match string, ord long, score double")
    top = best(met, "name", "score", "ord", k).select("name", "match", "score")
    return best(top.join(rows.select("match", "ord").hint("merge"), "match"), "name", "score", "ord", k).select("name", "match", "ord", "score", "nth")


def weighted_cell(least: float, best: bool):
    """For a cell of any names: the pairs whose weighted ratio can reach ``least``, or those that can be a left name's best with it."""

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"name": pd.Series(dtype=str), "match": pd.Series(dtype=str), "ord": pd.Series(dtype="int64")})
        if not len(a) or not len(b):
            return out
        x, y = a.name.tolist(), b.match.tolist()
        n, m = (np.array([len(t) for t in side], np.float32) for side in (x, y))
        bounds = M.WeightedBounds(x, y)
        like, held = [], []
        for s, e in _blocks(len(x)):
            i, j, common = bounds.over(s, e, least - SLACK * 100)
            fit = np.maximum(n[i], m[j]) < 1.5 * np.minimum(n[i], m[j])
            like.append((i[fit], j[fit]))
            rows, columns = n[s:e, None], m[None, :]
            if max(n[s:e].max(), m.max()) >= 1.5 * min(n[s:e].min(), m.min()):  # one name must hold the other, so its characters too
                far = (common >= np.minimum(rows, columns)) & ((columns >= 1.5 * rows) | (rows >= 1.5 * columns)) & (columns < 8 * rows) & (rows < 8 * columns)
                p, q = np.nonzero(far)
                inside = np.array([x[c + s] in y[d] or y[d] in x[c + s] for c, d in zip(p.tolist(), q.tolist(), strict=True)], bool)
                held.append((p[inside] + s, q[inside]))
        i, j = (np.concatenate(side) for side in zip(*like, strict=True))
        if best and len(i):
            reached = np.full(len(x), float(least))
            np.maximum.at(reached, i, 200.0 * M.common_lengths(x, y, i, j) / (n[i] + m[j]))
            keep = bounds.of(i, j) >= reached[i] - SLACK * 100
            i, j = i[keep], j[keep]
        i, j = (np.concatenate(side) for side in zip((i, j), *held, strict=True))
        return pd.DataFrame({"name": a.name.to_numpy()[i], "match": b.match.to_numpy()[j], "ord": b.ord.to_numpy()[j]}) if len(i) else out

    return solve


def weighted_candidates(left: DataFrame, right: DataFrame, least: float = 90.0, best: bool = False) -> DataFrame:
    """name, match, ord: every pair with a weighted ratio of ``least`` or more is among them; with ``best``, every pair of a name's highest ratio. left: name; right: match, ord.

    The ratio is the best of four: the plain one; 0.95 of that of the sorted words; 0.95 of that of the word sets; and, where one
    name is 1.5 to 8 times as long, 0.9 of its best window. The first three are bounded by common characters and words, in cells of all
    pairs, as most words of a roster are frequent; the last must be 100 for a limit above 0.9 x 99 and then one name holds the other.
    """
    if least < 90:
        raise ValueError("a limit under 90 admits names whose windows are merely alike")
    x = cut(left.select("name").where("name <> ''").distinct())
    y = cut(right.where("match <> ''").select("match", F.col("ord").cast("long").alias("ord")).distinct())
    return crossed(x, y, weighted_cell(least, best), "name string, match string, ord long")
