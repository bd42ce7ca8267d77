"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key -ln(u) / quality, u from a hash of its id and text, so a rerun draws the same keys.
Rows that are equal in id and text share a key; where a budget ends among them, as many of them as it holds are taken.
A source whose target is e full passes and a fraction takes every document e times and then, in ascending key
order, documents until the prefix sum of their words comes nearest to the rest of its budget.

No source is sorted in one task: keys are 50-bit integers, and the key at which a source's budget ends is found by
three rounds of 1024 bins for each source (sums only), then among the few documents of the last bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import numbered, stash, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
KEY_BITS, BIN_BITS, ROUNDS = 50, 10, 3
#: Stands for a null id where ids are compared.
NULL_ID = -(1 << 62)
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "!#$%&*<>=^{|}~"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """Share of characters that are not symbols, at least 0.1; 1 for an empty text."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.char_length(body)
    return F.greatest(F.lit(0.1), 1 - F.coalesce(F.try_divide(n - F.char_length(F.translate(body, SYMBOLS, "")), n), F.lit(0.0)))


def text_hash(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def uniform(seed: int) -> Column:
    """A number strictly between 0 and 1 from the id, the text and the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text_hash(), F.lit(f":{seed}")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def sampling_key(weight: Column, seed: int) -> Column:
    e = -F.log(uniform(seed)) / weight
    return F.floor(e / (1 + e) * F.lit(float(1 << KEY_BITS))).cast("long")


def _source_key() -> Column:
    """Sorts as the source does by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """skey, source_size, target. Budget by weight; what exceeds ``most`` times a source is reshared among the rest."""
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    s = stash(numbered(sizes, [F.col("skey")]).withColumn("weight", cycle).drop("n"), "sources")
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap = F.col("source_size") * F.lit(most)
    level = 0.0
    while True:  # each round caps at least one more source or ends
        full = cap <= F.col("weight") * F.lit(level)
        spent, rest = s.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not rest or (new := (share * total - spent) / rest) <= level:
            break
        level = new
    return s.select("skey", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def thresholds(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each source: epochs, the last (key, doc_id, hash) of which the fractional pass takes rows, and how many of its rows (end_rows of end_of).

    rows: skey, k, doc_id, h, size.
    """
    want = sizes.withColumn("epochs", F.floor(F.try_divide("target", "source_size"))).fillna(0, ["epochs"])
    want = want.withColumn("need", F.col("target") - F.col("epochs") * F.col("source_size"))
    state = stash(want.withColumn("prefix", F.lit(0).cast("long")), "state")
    shift = KEY_BITS
    running = Window.partitionBy("skey").orderBy("prefix")
    for _ in range(ROUNDS):
        last, shift = shift, shift - BIN_BITS
        within = rows.withColumn("up", F.shiftright("k", last)).join(state.select("skey", F.col("prefix").alias("up")), ["skey", "up"])
        bins = within.groupBy("skey", F.shiftright("k", shift).alias("prefix")).agg(F.sum("size").alias("bytes"))
        bins = bins.join(state.drop("prefix"), "skey").withColumn("upto", F.sum("bytes").over(running))
        hit = bins.where(F.col("upto") >= F.col("need")).withColumn("nth", F.row_number().over(running)).where("nth = 1")
        state = stash(hit.withColumn("need", F.col("need") - F.col("upto") + F.col("bytes")).select(state.columns), "state")
    leaf = rows.withColumn("prefix", F.shiftright("k", shift)).join(state, ["skey", "prefix"])
    leaf = leaf.groupBy("skey", "k", "doc_id", "h").agg(F.sum("size").alias("sum"), F.max("size").alias("size"), F.count("*").alias("n"), F.first("need").alias("need"))
    before = F.sum("sum").over(Window.partitionBy("skey").orderBy("k", F.col("doc_id").asc_nulls_first(), "h")) - F.col("sum")
    # a row is taken if half of it lies within the budget; those of a key are alike
    room = F.col("need") - F.col("before")
    most = F.when(F.col("size") == 0, F.when(room >= 0, F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.floor(F.try_divide(room, "size") + 0.5)))
    chosen = leaf.withColumn("before", before).withColumn("m", most).where("m > 0")
    end = chosen.groupBy("skey").agg(F.max(F.struct("k", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "h", F.col("m").cast("long").alias("m"), "n")).alias("end"))
    cut = state.select("skey", F.shiftleft("prefix", shift).alias("from")).join(end, "skey", "left")
    last = [F.coalesce(F.col("end.k"), F.col("from") - 1).alias("end_k"), F.coalesce(F.col("end.id"), F.lit(-NULL_ID)).alias("end_id"), F.coalesce(F.col("end.h"), F.lit("~")).alias("end_h"), F.col("end.m").alias("end_rows"), F.col("end.n").alias("end_of")]
    return stash(want.join(cut, "skey", "left").select("skey", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), *last), "thresholds")


def _drawn(docs: DataFrame, weight: Column | None, seed: int, **shares) -> DataFrame:
    """``docs`` and, under names of their own, size, source_size, target and copies."""
    sized = docs.withColumns({"_mix_s": _source_key(), "_mix_size": word_count(), "_mix_k": sampling_key(weight if weight is not None else quality_weight(), seed), "_mix_h": text_hash()})
    rows = stash(sized.select(F.col("_mix_s").alias("skey"), F.col("_mix_k").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_mix_h").alias("h"), F.col("_mix_size").alias("size")), "mix-rows")
    per = stash(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), "source-sizes")
    cut = thresholds(rows, targets(per, **shares)).withColumnRenamed("skey", "s")
    joined = sized.join(cut.select(*[F.col(c).alias(f"_mix_{c}") for c in cut.columns]), "_mix_s")
    mine, last = (F.struct(F.col("_mix_k").alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("i"), F.col("_mix_h").alias("h")), F.struct(F.col("_mix_end_k").alias("k"), F.col("_mix_end_id").alias("i"), F.col("_mix_end_h").alias("h")))
    done = lambda df, inside: df.withColumn("_mix_copies", F.col("_mix_epochs") + F.coalesce(inside, F.lit(False)).cast("long")).drop("_mix_s", "_mix_k", "_mix_h", "_mix_epochs", "_mix_end_k", "_mix_end_id", "_mix_end_h", "_mix_end_rows", "_mix_end_of")
    if not cut.where("end_rows < end_of").limit(1).count():
        return done(joined, mine <= last)
    tied = F.coalesce((mine == last) & (F.col("_mix_end_rows") < F.col("_mix_end_of")), F.lit(False))
    part = stash(joined.where(tied).withColumn("_mix_part", F.spark_partition_id()), "tied-rows")  # numbered by part, so no task holds all rows of a key
    counts = part.groupBy("_mix_s", "_mix_part").agg(F.count("*").alias("_mix_n"))
    earlier = Window.partitionBy("_mix_s").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_mix_s", "_mix_part", F.coalesce(F.sum("_mix_n").over(earlier), F.lit(0)).alias("_mix_before"))
    nth = F.row_number().over(Window.partitionBy("_mix_s", "_mix_part").orderBy("_mix_k")) + F.col("_mix_before")
    some = part.join(offsets, ["_mix_s", "_mix_part"]).withColumn("_mix_nth", nth)
    return done(joined.where(~tied), mine < last).unionByName(done(some, F.col("_mix_nth") <= F.col("_mix_end_rows")).drop("_mix_part", "_mix_before", "_mix_nth"))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 7, **shares) -> DataFrame:
    """Rows of ``docs`` with size (words), source_size, target and copies (how often the mix takes the document).

    A source's target is its share of ``share`` times all words; a document is taken whole, epochs times or once more.
    The budget is met up to half of the document at which it ends.

    Defined cases: a null text has no words and is never counted; a null source is a source of its own, sorted last;
    rows that share an id draw keys of their own by their texts; rows equal in id and text are taken one by one, any of them;
    a source without words has target 0 and its
    documents are taken once for no words if its key order reaches them; an empty table gives an empty table. Extra
    columns are kept; names that the result adds replace columns of the same name.
    """
    added = ["size", "source_size", "target", "copies"]
    return _drawn(docs, weight, seed, **shares).drop(*added).withColumnsRenamed({f"_mix_{c}": c for c in added})


def repeat_rows(docs: DataFrame, weight: Column | None = None, seed: int = 7, **shares) -> DataFrame:
    """The mix as rows: each document as often as it is taken, with the columns of ``docs``."""
    taken = _drawn(docs, weight, seed, **shares).where("_mix_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
with base as (
  select doc_id, source, coalesce('s' || source, 'z') as skey, md5(coalesce(text, '')) as h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         greatest(0.1, 1 - coalesce((length(text) - length(translate(text, '!#$%&*<>=^{|}~', ''))) / nullif(length(text), 0)::double, 0)) as quality,
         (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, '')) || ':7'), 1, 12))::bigint + 0.5) / 281474976710656.0::double as u
  from documents),
keyed as (select *, (-ln(u) / quality) as e from base),
ks as (select *, floor(e / (1 + e) * 1125899906842624.0::double)::bigint as k from keyed),
sources as (
  select skey, sum(size)::bigint as source_size,
         case (row_number() over (order by skey) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight
  from ks group by skey),
levels as (
  select *, 1.5::double * sum(source_size) over () as budget,
         coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / weight, skey rows between unbounded preceding and 1 preceding), 0) as spent,
         sum(weight) over (order by 2.0::double * source_size / weight, skey rows between current row and unbounded following) as rest
  from sources),
lam as (select max((budget - spent) / rest) as level from levels where (budget - spent) / rest < 2.0::double * source_size / weight),
t as (select skey, source_size, least(2.0::double * source_size, weight * level) as target from sources, lam),
want as (select *, floor(target / source_size) as epochs, target - floor(target / source_size) * source_size as need from t),
run as (
  select ks.*, source_size, target, epochs, need,
         sum(size) over (partition by ks.skey order by k, doc_id nulls first, h rows between unbounded preceding and current row) as upto
  from ks join want on ks.skey = want.skey)
select doc_id, size, source_size, target, (epochs::bigint + case when upto - size / 2.0::double <= need then 1 else 0 end) * size as taken
from run
"""
