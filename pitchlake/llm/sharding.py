"""K-d tree partitioning of documents into byte-balanced shards, in DataFrame operations only.

The tree is cut at weighted medians: a node that stands for a run of shards is split so that its left side gets the bytes
that the first half of them still wants, along the metadata dimension (size, source, language, id) that is widest in it
relative to the whole table. A median is found without sorting: one pass counts the bytes of at most 1024 equal
bins of every dimension for all nodes of a level, which gives their bounds too; further passes count within the
bin that holds the median until it is light enough. The driver sees bins of nodes only, never rows.

Equal texts are one unit of weight and share their coordinates, so they stay together. Units that weigh more than a 16th of a
shard, at most 16 times the shards whatever the table, would make a cut coarse: they are dealt first, the heaviest to the lightest
shard, and the tree gives every shard the bytes that it lacks. Only a unit heavier than a shard is split, into as few parts as
shards would hold it. So a shard misses the mean by what the cuts miss: half of a 16th of a shard each at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import stash, table

BIN_BITS = 10
LOW_BITS = 32
COORD_BITS = 30
HEAVY_A_SHARD = 16
SLACK = 0.0005
ROWS_A_BUCKET = 5000
DIMS = ("k_size", "k_source", "k_lang", "k_id")


def _coordinates(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """(light rows, rows of heavy units with their shard, bytes that each shard lacks beside them).

    Light rows: doc_id, size, crc and one sortable long per dimension: the coordinate above, a hash of the text below.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = stash(narrow, "shard-rows")
    total, low_id, high_id = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    units = narrow.groupBy("text_hash").agg(F.sum("size").alias("g_bytes"), F.count("*").alias("g_rows"), F.min("doc_id").alias("g_id"), F.min("source").alias("g_source"), F.min("lang").alias("g_lang"))
    heavy = stash(units.where(F.col("g_bytes") > F.lit(total / shards / HEAVY_A_SHARD)).select("text_hash", F.ceil(F.col("g_bytes") / F.lit(max(1.0, total / shards))).cast("int").alias("parts")), "heavy-units")
    large = narrow.join(F.broadcast(heavy), "text_hash").withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")))  # at most HEAVY_A_SHARD * shards units
    dealt, loads = _deal(large.groupBy("text_hash", "part").agg(F.sum("size").alias("bytes")), shards)
    large = large.join(F.broadcast(dealt), ["text_hash", "part"]).select("doc_id", "size", "text_crc32", "shard")
    groups = units.where("g_rows > 1").drop("g_bytes", "g_rows").withColumn("grouped", F.lit(True))
    light = narrow.join(F.broadcast(heavy), "text_hash", "left_anti").join(groups, "text_hash", "left")
    own = F.col("grouped").isNull()
    light = light.withColumns({c: F.when(own, F.col(mine)).otherwise(F.col(g)) for c, mine, g in (("place_id", "doc_id", "g_id"), ("source", "source", "g_source"), ("lang", "lang", "g_lang"))})
    top = float((1 << COORD_BITS) - 1)
    name = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - COORD_BITS)
    coords = {
        "k_size": F.floor(F.least(F.lit(1.0), F.log2(F.col("size").cast("double")) / 40) * top),
        "k_source": name("source"),
        "k_lang": name("lang"),
        "k_id": F.floor((F.coalesce(F.col("place_id"), F.lit(low_id)).cast("double") - low_id) / max(1, high_id - low_id) * top),
    }

    tie = F.shiftrightunsigned(F.xxhash64("text_hash", F.lit(5)), 64 - LOW_BITS)
    keys = light.select("doc_id", "size", "text_crc32", *[(F.shiftleft(c.cast("long"), LOW_BITS) + tie).alias(k) for k, c in coords.items()])
    lacks = [max(0.0, total / shards - x) for x in loads]
    return stash(keys, "shard-keys"), large, lacks


def _deal(units: DataFrame, shards: int) -> tuple[DataFrame, list[int]]:
    """(text_hash, part, shard; bytes by shard): the heaviest unit first, each to the lightest shard. A bounded number of units."""
    loads = [0] * shards
    rows = []
    for r in sorted(units.collect(), key=lambda r: (-r["bytes"], r["text_hash"], r["part"])):
        shard = min(range(shards), key=lambda i: (loads[i], i))
        loads[shard] += r["bytes"]
        rows.append((r["text_hash"], r["part"], shard))
    return units.sparkSession.createDataFrame(rows, "text_hash long, part int, shard int"), loads


def _leaf_expr(node: dict) -> Column:
    """Number of the leaf that a row falls into, as nested conditions on the cuts."""
    if "left" not in node:
        return F.lit(node["name"])
    return F.when(F.col(node["dim"]) <= node["cut"], _leaf_expr(node["left"])).otherwise(_leaf_expr(node["right"]))


def _scan(rows: DataFrame, root: dict, spans: dict[int, dict[str, tuple[int, int]]]) -> dict[tuple[int, str], list[tuple[int, int, int]]]:
    """One pass over ``rows`` for the ranges of keys (least, greatest) by node and dimension that ``spans`` names.

    Returns bytes, least and greatest key of each bin that holds rows, in the order of the keys."""
    node, wanted = F.col("_node"), None
    for name, dims in spans.items():
        entries = [F.struct(F.lit(d).alias("dim"), F.col(d).alias("key"), *[F.lit(v).cast("long").alias(k) for k, v in (("lo", lo), ("hi", hi), ("width", ((hi - lo) >> BIN_BITS) + 1))]) for d, (lo, hi) in dims.items()]
        wanted = F.when(node == name, F.array(*entries)) if wanted is None else wanted.when(node == name, F.array(*entries))
    at = rows.withColumn("_node", _leaf_expr(root)).where(node.isin(list(spans))).select("_node", "size", F.inline(wanted)).where("key between lo and hi")
    binned = at.groupBy("_node", "dim", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
    found: dict[tuple[int, str], list[tuple[int, int, int]]] = {}
    for r in binned.collect():
        found.setdefault((r["_node"], r["dim"]), []).append((r["bytes"], r["first"], r["last"]))
    return {k: sorted(bins, key=lambda b: b[1]) for k, bins in found.items()}


def _narrow_down(node: dict, bins: list[tuple[int, int, int]]) -> tuple[int, int] | None:
    """The range of keys to look into for the node's median, or None once its ``cut`` is set.

    The cut is the key at which the left part's bytes come nearest to the wanted share; no side is left empty."""
    for size, first, last in bins:
        if node["below"] + size >= node["want"]:
            break
        node["below"], node["before"] = node["below"] + size, last
    if first < last and size > SLACK * node["bytes"] / len(node["lacks"]):
        return first, last
    over, under = node["below"] + size - node["want"], node["want"] - node["below"]
    after = node["before"] is None or (over <= under and last < node["box"][node["dim"]][1])
    node["cut"] = last if after else node["before"]
    return None


def kd_tree(rows: DataFrame, lacks: list[float]) -> dict:
    """Cuts of the tree over ``rows`` (size and one long per dimension) into a leaf for each of ``lacks``, in proportion to it."""
    bounds = rows.agg(*[f(d).alias(f"{k}_{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))]).first()
    root = {"name": 0, "lacks": lacks}
    if len(lacks) < 2 or bounds["lo_k_id"] is None:
        return root
    root["box"] = {d: (bounds[f"lo_{d}"], bounds[f"hi_{d}"]) for d in DIMS}
    range_ = lambda box, d: (box[d][1] >> LOW_BITS) - (box[d][0] >> LOW_BITS)
    spread = {d: max(1, range_(root["box"], d)) for d in DIMS}
    level, names = [root], 1
    while level:
        found = _scan(rows, root, {n["name"]: n["box"] for n in level})
        ready, open_ = [], {}
        for n in level:
            bins = {d: found[n["name"], d] for d in DIMS}
            n["bytes"] = sum(b[0] for b in bins[DIMS[0]])
            n["box"] = {d: (bins[d][0][1], bins[d][-1][2]) for d in DIMS}
            n["dim"] = max(DIMS, key=lambda d, n=n: range_(n["box"], d) / spread[d])
            if n["box"][n["dim"]][0] == n["box"][n["dim"]][1]:
                continue  # equal in the widest dimension: one group of rows that no key tells apart
            half = sum(n["lacks"][: len(n["lacks"]) // 2])
            n |= {"below": 0, "before": None, "want": n["bytes"] * half / (sum(n["lacks"]) or 1)}
            ready.append(n)
            if span := _narrow_down(n, bins[n["dim"]]):
                open_[n["name"]] = {n["dim"]: span}
        by_name = {n["name"]: n for n in ready}
        while open_:
            within = _scan(rows, root, open_)
            spans = {name: _narrow_down(by_name[name], within[name, dim]) for name, dims in open_.items() for dim in dims}
            open_ = {name: {by_name[name]["dim"]: span} for name, span in spans.items() if span}
        for n in ready:
            lo, hi = n["box"][n["dim"]]
            middle = len(n["lacks"]) // 2
            n["left"] = {"name": names, "lacks": n["lacks"][:middle], "box": n["box"] | {n["dim"]: (lo, n["cut"])}}
            n["right"] = {"name": names + 1, "lacks": n["lacks"][middle:], "box": n["box"] | {n["dim"]: (n["cut"] + 1, hi)}}
            names += 2
        level = [x for n in ready for x in (n["left"], n["right"]) if len(x["lacks"]) > 1]
    return root


def _number_leaves(node: dict, first: int = 0) -> int:
    if "left" in node:
        return _number_leaves(node["right"], _number_leaves(node["left"], first))
    node["name"] = first
    return first + len(node["lacks"])


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every row of ``docs`` with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sizes (UTF-8 bytes plus 8) of the shards are near equal. Rows of one text share a shard unless they weigh
    more than one. slot numbers the rows of a shard from 0 without gaps.

    Defined cases: a null text weighs 8 bytes and has CRC 0, like an empty one, but is a group of its own; null
    source, language or id take part with a coordinate of their own; repeated rows each get a slot; a table with
    fewer rows than shards leaves shards empty; an empty table gives an empty table; extra columns are ignored.
    """
    rows, large, lacks = _coordinates(docs, shards)
    root = kd_tree(rows, lacks)
    _number_leaves(root)
    placed = stash(rows.select("doc_id", "size", "text_crc32", _leaf_expr(root).cast("int").alias("shard")).union(large), "placed")
    n = placed.count()
    buckets = max(1, -(-n // (shards * ROWS_A_BUCKET)))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size"))
    slotted = placed.withColumn("_rank", rank).join(counts, ["shard", "_bucket"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_base") + F.col("_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
