"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

1. Terms are counted by (lang, source) and by lang in one pass over the texts, summed in each task before the shuffle. A
   language keeps the terms that at least ``LEAST_DOCS`` of its documents hold.
2. The smoothed share of a term in a group depends on the group and on the term's count there, its *level*, alone. So for two
   groups g and h of a language everything is in the joint table J[a, b] = number of kept terms with level a in g and level b in h.
3. Indicator columns Z[term, (group, level)] for the groups of a block, times the transpose of those of another block, give all
   joint tables of the two blocks at once: J = Z_I' Z_J. Terms are dealt into blocks of about ``TERMS`` rows and groups into
   blocks of about ``GROUPS``; the products of term blocks add up. Counts below 2^24 are exact in the product's float32.
4. A joint table is priced, J[a, b] * f(p_g(a), p_h(b)) summed over its cells, in integers, in both directions from the one product.

Everything is exact: shares are integers, 1 + floor(1e9 (count + 1) / (N + V)), prices floor((p - q)^2 / q). What a task holds is
bounded by the block sizes, and within a task by ``CELLS`` cells of a product.

Defined cases: null text, lang and source are ''; repeated rows count as often as they are there; a group without terms has count
0 of every kept term; a language that keeps no term (V = 0) has pairs of value 0 and no term rows; a language of one source has no
pairs; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import join_small, stash, table
from pitchlake.llm.words import text_slices

LEAST_DOCS = 3
RANKS = 200
SCALE = 1_000_000_000
TERMS, GROUPS = 1024, 16
CELLS = 1 << 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of the rows of a slice in order, dictionary-encoded, and the row bounds among them."""
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])[: len(data)]))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])[: len(data)])) + 1
    bytes_ = np.ascontiguousarray(_FOLD[data[inside]])
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(bytes_)])
    return words.dictionary_encode(), np.searchsorted(starts, offsets)


def term_counts(docs: DataFrame, limit: int = 1 << 24) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); sums of slices of ``limit`` bytes of text, several rows for a key."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_slices(b.column(2), limit):
                words, bounds = terms_of(data, offsets)
                if not len(words):
                    continue
                lang, source = (b.column(i).slice(first, end - first) for i in (0, 1))
                group, _ = pd.factorize(pd.MultiIndex.from_arrays([lang.to_pandas(), source.to_pandas()]))
                at = np.unique(group, return_index=True)[1]  # a row of each group
                code = words.indices.to_numpy().astype(np.int64)
                width, row = len(words.dictionary), np.repeat(np.arange(end - first), np.diff(bounds))
                place, keys = pd.factorize(group[row] * width + code)
                once = ~pd.Series(row * width + code).duplicated().to_numpy()
                of = pa.array(at[keys // width])
                yield pa.RecordBatch.from_arrays([
                    lang.take(of).cast(pa.string()), source.take(of).cast(pa.string()), words.dictionary.take(pa.array(keys % width)).cast(pa.large_string()).cast(pa.string()),
                    pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64)), pa.array(np.bincount(place[once], minlength=len(keys)).astype(np.int64)),
                ], schema=schema)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 (count + 1) / (total + kept)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + kept)) + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) for each p (rows) and q (columns)."""
    d = p[:, None] - q[None, :]
    return d * d // q[None, :]


def counted(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(groups, langs, vocabulary, kept): lang, source, total, v; lang, lang_total, v; lang, term, lang_n; lang, source, term, n, lang_n."""
    counts = stash(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    vocabulary = stash(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "vocabulary")
    kept = stash(counts.drop("docs").join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    every = docs.select(blank("lang"), blank("source")).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = vocabulary.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    langs = stash(every.select("lang").distinct().join(of_lang, "lang", "left").select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lang_total", "v")]), "langs")
    groups = stash(every.join(of_group, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "v"), "groups")
    return groups, langs, vocabulary, kept


def term_part(groups: DataFrame, langs: DataFrame, kept: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item, q, value, rank: the terms that a group holds above its language's share, the dearest first."""
    both = join_small(join_small(kept, groups, ["lang", "source"]), langs.drop("v"), "lang")
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    over = both.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return over.withColumn("value", value).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ranks).select("lang", "source", "item", "q", "value", "rank")


def _chunks(levels: list[np.ndarray], cells: int) -> Iterator[slice]:
    """Runs of rows for which the indicator columns of either side make at most ``cells`` cells, 32 rows at least."""
    rows = len(levels[0])
    start, last = 0, rows
    while start < rows:
        size = min(rows - start, 2 * last)
        while size > 32:
            columns = [sum(len(np.unique(c)) for c in side[start : start + size].T) for side in levels]
            if columns[0] * columns[-1] <= cells:
                break
            size = max(32, size // 2)
        yield slice(start, start + size)
        start, last = start + size, size


def _indicators(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Z, level of each column, first column of each group) of a block: terms by groups, each cell the level."""
    rows, groups = levels.shape
    found = [np.unique(levels[:, g], return_inverse=True) for g in range(groups)]
    first = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
    z = np.zeros((rows, first[-1]), np.float32)
    for g, (_, at) in enumerate(found):
        z[np.arange(rows), first[g] + at.reshape(-1)] = 1
    return z, np.concatenate([f[0] for f in found]), first


def joint_prices(left: np.ndarray, right: np.ndarray, of_left: np.ndarray, of_right: np.ndarray, v: int, absent: int = 0, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(sums over terms of f(p_g, p_h), of f(p_h, p_g)) for all groups g of the left and h of the right block.

    left, right: levels, terms by groups; of_left, of_right: totals of the groups; absent: further terms, on level 0 in every
    group, which are one cell of each joint table. Sums are exact: a language's shares add up to
    about 1e9, so the prices of all its terms together stay below (1e9 + V)^2.
    """
    there, back = (np.zeros((left.shape[1], right.shape[1]), np.int64) for _ in range(2))
    shares = lambda level, first, totals: 1 + _scaled(level + 1, np.repeat(totals, np.diff(first)) + v)
    if absent:
        p, q = (shares(np.zeros(len(t), np.int64), np.arange(len(t) + 1), t) for t in (of_left, of_right))
        there, back = there + absent * price(p, q), back + absent * price(q, p).T
    order = np.argsort(left.sum(axis=1) + right.sum(axis=1), kind="stable")  # rare terms have few levels: they share columns
    left, right = left[order], right[order]
    for run in _chunks([left, right], cells):
        (a, la, fa), (b, lb, fb) = _indicators(left[run]), _indicators(right[run])
        joint = (a.T @ b).astype(np.int64)
        p, q = shares(la, fa, of_left), shares(lb, fb, of_right)
        there += np.add.reduceat(np.add.reduceat(joint * price(p, q), fa[:-1], axis=0), fb[:-1], axis=1)
        back += np.add.reduceat(np.add.reduceat(joint * price(q, p).T, fa[:-1], axis=0), fb[:-1], axis=1)
    return there, back


def _scaled(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """floor(1e9 * above / below) without leaving 64 bits: above <= below, both below 2^62 / 10^3, three digits at a time."""
    out, rest = np.zeros(len(above), np.int64), above.astype(np.int64)
    out, rest = rest // below, rest % below
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return out


def _block(column: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(column), F.col(blocks)).cast("int")


def pair_part(groups: DataFrame, vocabulary: DataFrame, kept: DataFrame, terms: int = TERMS, block: int = GROUPS, cells: int = CELLS) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language, the farthest first."""
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("g"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    g = groups.join(of_lang, "lang").withColumns({"nb": blocks("g", block), "nt": blocks("v", terms)})
    g = stash(g.withColumn("b", _block("source", "nb")).drop("g"), "group-blocks")
    # an entry goes to every pair of blocks with its own: block b is the left one of (b, j >= b) and the right one of (i <= b, b)
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"))))
    entries = join_small(kept, g, ["lang", "source"]).withColumn("t", _block("term", "nt"))
    sizes = join_small(vocabulary, g.select("lang", "nt").distinct(), "lang").groupBy("lang", _block("term", "nt").alias("t")).agg(F.count("*").alias("in_block"))
    columns = ["lang", "source", "b", "t", "m.i", "m.j", "total", "v"]
    filled = entries.withColumn("m", meets).select(*columns, "term", "n")
    # a row for each group in each of its products, without a term: it is there even if the group has none of the block's terms
    heads = g.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("nt") - 1))).join(sizes, ["lang", "t"], "left").withColumn("m", meets)
    empty = heads.select(*columns, F.lit(None).cast("string").alias("term"), F.coalesce("in_block", F.lit(0)).alias("n"))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, _, i, j = key
        v = int(pdf.v.iloc[0])
        head = pdf[pdf.term.isna()].drop_duplicates("source")
        body = pdf[pdf.term.notna()]
        row, present = pd.factorize(body.term)
        absent = int(pdf.n[pdf.term.isna()].iloc[0]) - len(present)  # kept terms that no group of either block holds
        sides = []
        for b in (i, j):
            mine = head[head.b == b]
            place = pd.Index(mine.source)
            at = place.get_indexer(body.source)
            level = np.zeros((len(present), len(place)), np.int64)
            level[row[at >= 0], at[at >= 0]] = body.n.to_numpy()[at >= 0]
            sides.append((mine.source.to_numpy(), level, mine.total.to_numpy(np.int64)))
        (one, left, t1), (two, right, t2) = sides
        out = pd.DataFrame(columns=["lang", "source", "item", "value"])
        if len(one) and len(two):
            there, back = joint_prices(left, right, t1, t2, v, absent, cells)
            x, y = (k.reshape(-1) for k in np.meshgrid(np.arange(len(one)), np.arange(len(two)), indexing="ij"))
            out = pd.DataFrame({"lang": lang, "source": one[x], "item": two[y], "value": there[x, y]})
            if i != j:
                out = pd.concat([out, pd.DataFrame({"lang": lang, "source": two[y], "item": one[x], "value": back[x, y]})])
        return out[out.source != out["item"]]

    parts = filled.union(empty).groupBy("lang", "t", "i", "j").applyInPandas(solve, "lang string, source string, item string, value long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(w))


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    groups, langs, vocabulary, kept = counted(docs, least)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return pair_part(groups, vocabulary, kept).select(*columns("pair")).union(term_part(groups, langs, kept, ranks).select(*columns("term")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of ``documents`` from each other and from their language. Cases: those of this module."""
    return audit(table(spark, sf_dir, "documents"))


_SHARE = "1 + {scale}::hugeint * (({n}) + 1) // (({t}) + v)"
_P = lambda n, t: _SHARE.format(scale=SCALE, n=n, t=t)
OP13_SQL = f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as x from documents),
w as (select r, lang, source, translate(unnest(regexp_extract_all(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
l as (select lang, term, count(*) as ln from w group by all having count(distinct r) >= {LEAST_DOCS}),
lt as (select lang, sum(ln) as lt from l group by lang),
vs as (select d.lang, coalesce(v, 0) as v from (select distinct lang from d) d left join (select lang, count(*) as v from l group by lang) l on l.lang = d.lang),
c as (select w.lang, source, term, count(*) as n from w semi join l on l.lang = w.lang and l.term = w.term group by all),
g as (select x.lang, x.source, v, coalesce(t, 0) as t from (select distinct lang, source from d) x join vs on vs.lang = x.lang left join (select lang, source, sum(n) as t from c group by all) c on c.lang = x.lang and c.source = x.source),
p as (select g.lang, g.source, l.term, coalesce(n, 0) as n, {_P("coalesce(n, 0)", "t")} as p, ln from g join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = l.term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all select a.lang, a.source, b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source where a.v = 0),
q as (select p.lang, p.source, p.term as item, p, {_P("ln", "lt")} as q from p join vs on vs.lang = p.lang join lt on lt.lang = p.lang where n > 0),
terms as (select lang, source, item, (p - q) * (p - q) // q as value from q where p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {RANKS}"""
