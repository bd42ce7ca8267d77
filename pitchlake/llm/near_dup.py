"""MinHash near-dedup by improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles.

1. Document frequencies over all documents: a fixed-size counter sketch finds the shingles that may be frequent,
   a second pass counts those exactly. A shingle in at most 1/256 of the documents has idf 1; above that the idf
   falls with log(N / df), not below ``idf_floor``. The floor is a choice against the plain idf: copies of one text
   that a third of all documents hold would weigh a tenth of the few words in which they differ, and be lost.
2. Every text gets ``bands * rows`` consistent weighted samples of its tf * idf vector; samples are banded. Equal
   texts become one class (grouped by two 64-bit hashes), signed once a task, so copies are never compared.
3. Texts in one bucket whose whole signatures agree in half their places become candidate links. Large buckets are
   counted and cut into pairs of blocks. Only spanning links leave a task.
4. Texts of one candidate component are verified by exact weighted Jaccard similarity. In a component of one block all
   pairs are; in a larger one every text meets the component's first, then only the texts that are not linked to it
   meet the others, in blocks. Links to one text join its neighbours' classes, so no class is lost, and a group of near
   copies costs a comparison a text. Spanning links of the verified graph give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import words
from pitchlake.llm.common import distributed_components, group_bounds, join_small, local_components, sorted_groups, stash, table

SKETCH_BITS = 18
FREQUENT_SHARE = 256
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 400_000
SMALL_GROUP = 8
REMEMBERED = 500_000  # keys of texts that a task has signed
APART = 1 << 40  # numbers of blocks of texts apart from their component's first


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at (i + 1/2) / n, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.maximum(np.sqrt(2 * p), 1e-4)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 4)
    return x


def icws(h: np.ndarray, log_weight: np.ndarray, counts: np.ndarray, n_hashes: int, gamma: np.ndarray, log_gamma: np.ndarray) -> np.ndarray:
    """Samples of each row, shape (rows, n_hashes), rows with at least one element. h: element hashes, row after row."""
    out = np.zeros((len(counts), n_hashes), np.uint64)
    begin = np.cumsum(counts) - counts
    heavy = np.flatnonzero(log_weight)
    lw = log_weight[heavy]
    row = np.repeat(np.arange(len(counts)), counts)
    for k in range(n_hashes):
        u = (h ^ np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
        u ^= u >> np.uint64(32)
        u *= np.uint64(0xC4CEB9FE1A85EC53)
        u ^= u >> np.uint64(29)
        r = gamma[(u & np.uint64(0xFFFF)).astype(np.int64)]
        log_c = log_gamma[((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (u >> np.uint64(32)).astype(np.float64) * 2.0**-32
        log_a = log_c - r * (1 - beta)  # where the weight is 1, t is 0
        t_heavy = np.floor(lw / r[heavy] + beta[heavy])
        log_a[heavy] = log_c[heavy] - r[heavy] * (t_heavy - beta[heavy] + 1)
        low = np.minimum.reduceat(log_a, begin)
        hit = np.flatnonzero(log_a == low[row])
        first = hit[np.searchsorted(hit, begin)]
        sample = h[first].copy()
        if len(heavy):
            t = np.zeros(len(h), np.int64)
            t[heavy] = t_heavy.astype(np.int64)
            sample ^= t[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = words.mix(sample)
    return out


def _idf_of(h: np.ndarray, keys: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """idf of each shingle: of the frequent ones as counted, 1 for the rest."""
    if not len(keys) or not len(h):
        return np.ones(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, idf[at], 1.0)


def document_frequencies(texts: DataFrame, size: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, idf) of the frequent shingles, hashes ascending.

    At most ``FREQUENT_SHARE`` times the mean number of shingles a document can be frequent, which bounds what the
    driver receives and the tasks are sent by the mean document length, not by the number of documents.
    """
    spark = texts.sparkSession
    width = 1 << SKETCH_BITS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(width, np.int64), 0
        for b in batches:
            docs += b.num_rows
            for _, h, n in words.shingles(b.column(0), size):
                u, _, _ = words.by_row(h, n)
                counts += np.bincount((u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=width)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.append(at, -1).astype(np.int32)), "n": pa.array(np.append(counts[at], docs))})

    cells = stash(texts.select("text").mapInArrow(sketch, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "sketch")
    n_docs = cells.where("cell = -1").select("n").first()
    if not n_docs or not n_docs[0]:
        return np.zeros(0, np.uint64), np.zeros(0)
    at_least = max(1, -(-n_docs[0] // FREQUENT_SHARE))
    full = np.zeros(width, bool)
    full[[r[0] for r in cells.where((F.col("cell") >= 0) & (F.col("n") >= at_least)).select("cell").collect()]] = True
    if not full.any():
        return np.zeros(0, np.uint64), np.zeros(0)
    wanted = spark.sparkContext.broadcast(full)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value
        for b in batches:
            parts = []
            for _, h, n in words.shingles(b.column(0), size):
                u, _, _ = words.by_row(h, n)
                parts.append(u[keep[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]])
            u, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_pydict({"h": pa.array(u.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    counted = texts.select("text").mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least).toArrow()
    h, df = counted["h"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    order = np.argsort(h)
    idf = np.clip(np.log(n_docs[0] / np.maximum(df, 1)) / np.log(FREQUENT_SHARE), floor, 1.0)
    return h[order].copy(), idf[order]


def signatures(docs: DataFrame, frequent, size: int, bands: int, rows: int) -> DataFrame:
    """One row per distinct text: node, k1, k2, head (smallest doc_id), n_shingles, bands, places (one byte a sample; both null without words).

    docs: doc_id, k1, k2, text. A task signs equal texts once, as far as it remembers their keys.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, idf = frequent.value
        gamma = _gamma_quantiles()
        log_gamma = np.log(gamma)
        salt = np.arange(1, bands + 1).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        signed: set[tuple[int, int]] = set()
        for b in batches:
            own = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            fresh = np.zeros(len(own), bool)
            for i, key in enumerate(own):
                if key not in signed:
                    fresh[i] = True
                    signed.add(key)
            if len(signed) > REMEMBERED:
                signed.clear()
            again = b.select([0, 1, 2]).filter(pa.array(~fresh))
            yield pa.RecordBatch.from_pydict({**{k: again.column(j) for j, k in enumerate(names[:3])}, **{k: pa.nulls(again.num_rows, t) for k, t in zip(names[3:], types, strict=True)}})
            part = b if fresh.all() else b.filter(pa.array(fresh))
            for first, h, n in words.shingles(part.column(3), size):
                u, tf, counts = words.by_row(h, n)
                has = np.flatnonzero(counts)
                here = part.select([0, 1, 2]).slice(first, len(n))
                none = here.filter(pa.array(counts == 0))
                yield pa.RecordBatch.from_pydict({**{k: none.column(j) for j, k in enumerate(names[:3])}, "n_shingles": pa.array(np.zeros(none.num_rows, np.int64)), **{k: pa.nulls(none.num_rows, t) for k, t in zip(names[4:], types[1:], strict=True)}})
                if not len(has):
                    continue
                log_weight = np.log(tf * _idf_of(u, keys, idf))
                s = icws(u, log_weight, counts[has], bands * rows, gamma, log_gamma)
                key = np.zeros((len(has), bands), np.uint64)
                for r in range(rows):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + s[:, r::rows]
                key = words.mix(key ^ salt).view(np.int64)
                places = (s >> np.uint64(56)).astype(np.uint8)
                some = here.take(pa.array(has))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1)))
                yield pa.RecordBatch.from_pydict({**{k: some.column(j) for j, k in enumerate(names[:3])}, "n_shingles": pa.array(counts[has].astype(np.int64)), "bands": lists, "places": pa.array([x.tobytes() for x in places], pa.binary())})

    names, types = ["doc_id", "k1", "k2", "n_shingles", "bands", "places"], [pa.int64(), pa.list_(pa.int64()), pa.binary()]
    signed = docs.select("doc_id", "k1", "k2", "text").mapInArrow(sign, "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>, places binary")
    first = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("head"), *[F.first(c, ignorenulls=True).alias(c) for c in names[3:]])
    return first.withColumn("node", F.monotonically_increasing_id())


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})


def _spanning(nodes: np.ndarray, linked: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a block (left = 0) or between the first ``left`` rows and the rest."""
    if left:
        full = np.zeros((len(nodes), len(nodes)), bool)
        full[:left, left:] = linked
        full[left:, :left] = linked.T
        linked = full
    root = local_components(linked)
    at = np.flatnonzero(root != np.arange(len(root)))
    return nodes[at], nodes[root[at]]


def _block_pairs(df: DataFrame, key: str, node: str, blocks: str) -> DataFrame:
    """Each row with the pairs of blocks (lo <= hi) of its group that need it; groups of one block get one pair."""
    own = F.pmod(F.xxhash64(node, F.lit(17)), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    return df.withColumn("_own", own).withColumn("_other", other).withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other"), "_side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_other", "_own", blocks)


def candidate_links(signed: DataFrame, least_agree: int, hashes: int) -> DataFrame:
    """Spanning links (src, dst) among the texts of each bucket whose signatures agree in ``least_agree`` places."""
    rows = signed.select("node", "places", F.explode("bands").alias("bucket"))
    sizes = stash(rows.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK_ROWS), "large-bands")
    shared = join_small(rows, sizes, "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK_ROWS), F.lit(1))).drop("size")
    cut = _block_pairs(shared, "bucket", "node", "blocks").repartition("bucket", "_lo", "_hi").sortWithinPartitions("bucket", "_lo", "_hi", "_side", "node")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_groups(batches, ["bucket", "_lo", "_hi"]):
            col = lambda k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            node, bucket, lo, hi, side = (col(k) for k in ("node", "bucket", "_lo", "_hi", "_side"))
            s = np.frombuffer(b"".join(b.column(b.schema.get_field_index("places")).to_pylist()), np.uint8).reshape(len(node), hashes)
            bounds = group_bounds(bucket, lo, hi)
            width = np.diff(bounds)
            small = np.repeat((width <= SMALL_GROUP) & (lo[bounds[:-1]] == hi[bounds[:-1]]), width)
            group = np.repeat(np.arange(len(width)), width)
            for d in range(1, SMALL_GROUP):
                at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if d < len(node) else []
                if not len(at):
                    break
                at = at[(s[at] == s[at + d]).sum(axis=1) >= least_agree]
                yield _links(node[at + d], node[at])
            for g in np.flatnonzero((width > SMALL_GROUP) | (lo[bounds[:-1]] != hi[bounds[:-1]])):
                a, z = bounds[g], bounds[g + 1]
                left = 0 if lo[a] == hi[a] else int((side[a:z] == 0).sum())
                x, y = (s[a:z], s[a:z]) if not left else (s[a : a + left], s[a + left : z])
                if not len(x) or not len(y):
                    continue
                same = np.zeros((len(x), len(y)), np.uint8)
                for k in range(hashes):
                    same += x[:, k][:, None] == y[:, k][None, :]
                yield _links(*_spanning(node[a:z], same >= least_agree, left))

    return cut.select("node", "bucket", "_lo", "_hi", "_side", "places").mapInArrow(agree, "src long, dst long")


def _overlap(els: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Matrix of the summed weights of common elements. els: element hashes, row: who has it; each pair once."""
    order = np.argsort(els, kind="stable")
    els, row, weight = els[order], row[order], weight[order]
    bounds = group_bounds(els)
    size = np.diff(bounds)
    out = np.zeros((n, n))
    for p in np.unique(size[(size > 1) & (size <= 48)]):
        at = bounds[:-1][size == p]
        members = row[at[:, None] + np.arange(p)]
        for i in range(p):
            for j in range(i + 1, p):
                np.add.at(out, (members[:, i], members[:, j]), weight[at])
    out += out.T
    wide = np.flatnonzero(size > 48)
    for c in range(0, len(wide), 512):
        part = wide[c : c + 512]
        x = np.zeros((n, len(part)))
        for k, g in enumerate(part):
            x[row[bounds[g] : bounds[g + 1]], k] = np.sqrt(weight[bounds[g]])
        out += x @ x.T
    return out


def _weighted(texts: pa.Array, size: int, keys: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, who has it, weight): the n-th copy of a shingle in a text is an element of its own."""
    els, rows, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for first, h, n in words.shingles(texts, size):
        u, tf, counts = words.by_row(h, n)
        row = first + np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        els.append(np.repeat(u, tf) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows.append(np.repeat(row, tf))
        weights.append(np.repeat(_idf_of(u, keys, idf), tf))
    return np.concatenate(els), np.concatenate(rows), np.concatenate(weights)


def star_links(pairs: DataFrame, frequent, size: int, threshold: float) -> DataFrame:
    """Links (src, dst) of texts with the first text of their component. pairs: node, component, text, centre."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, idf = frequent.value
        for b in batches:
            node, centre = (b.column(k).to_numpy() for k in (0, 1))
            own, theirs = _weighted(b.column(2), size, keys, idf), _weighted(b.column(3), size, keys, idf)
            n = b.num_rows
            total = np.bincount(own[1], own[2], n) + np.bincount(theirs[1], theirs[2], n)
            el, row, weight = (np.concatenate(x) for x in zip(own, theirs, strict=True))
            order = np.lexsort((el, row))
            el, row, weight = el[order], row[order], weight[order]
            twice = np.flatnonzero((el[1:] == el[:-1]) & (row[1:] == row[:-1]))
            both = np.bincount(row[twice], weight[twice], n)
            at = np.flatnonzero((both >= threshold * (total - both) - 1e-9) & (total > both))
            yield _links(node[at], centre[at])

    return pairs.select("node", "component", "text", "centre").mapInArrow(meet, "src long, dst long")


def verified_links(candidates: DataFrame, frequent, size: int, threshold: float) -> DataFrame:
    """Links whose graph has the classes of all pairs with weighted Jaccard >= threshold inside each component.

    candidates: node, component (its smallest node), blocks, text.
    """
    columns = ["node", "component", "_lo", "_hi", "_side", "text"]
    zero = lambda *names: [F.lit(0).cast("int" if c == "_side" else "long").alias(c) for c in names]
    small = candidates.where("blocks = 1").select("node", "component", *zero("_lo", "_hi", "_side"), "text")
    large = stash(candidates.where("blocks > 1"), "large-components")
    centres = large.where("node = component").select("component", F.col("text").alias("centre"))
    star = stash(star_links(large.where("node <> component").join(centres, "component"), frequent, size, threshold), "star-links")
    apart = stash(large.where("node <> component").select("node", "component").join(star.select(F.col("src").alias("node")), "node", "left_anti"), "apart")
    counts = stash(apart.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("others")), "apart-counts")
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit(17)), n)
    every = join_small(large, counts, "component")  # components of which all texts are linked are done
    left = every.select("node", "component", dealt(F.col("blocks")).alias("_lo"), F.explode(F.sequence(F.lit(APART), F.col("others") + (APART - 1))).alias("_hi"), *zero("_side"), "text")
    right = every.join(apart.select("node"), "node", "left_semi").select("node", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_lo"), (dealt(F.col("others")) + APART).alias("_hi"), F.lit(1).alias("_side"), "text")
    cut = small.union(left).union(right).repartition("component", "_lo", "_hi").sortWithinPartitions("component", "_lo", "_hi", "_side", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, idf = frequent.value
        for b in sorted_groups(batches, ["component", "_lo", "_hi"]):
            node, comp, lo, hi, side = (b.column(k).to_numpy() for k in range(5))
            bounds = group_bounds(comp, lo, hi)
            out_a, out_b = [], []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                left = 0 if lo[a] == hi[a] else int((side[a:z] == 0).sum())
                if z - a < 2 or left == z - a or (lo[a] != hi[a] and not left):
                    continue
                els, rows, weights = _weighted(b.column(5).slice(a, z - a), size, keys, idf)
                total = np.bincount(rows, weights, z - a)
                both = _overlap(els, rows, weights, z - a)
                union = total[:, None] + total[None, :] - both
                linked = both >= threshold * union - 1e-9
                linked &= union > 0
                pair = _spanning(node[a:z], linked[:left, left:] if left else linked, left)
                out_a.append(pair[0])
                out_b.append(pair[1])
            if out_a:
                yield _links(np.concatenate(out_a), np.concatenate(out_b))

    return cut.select(*columns).mapInArrow(verify, "src long, dst long").union(star)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and two hashes of the text; both are null for a null text."""
    text = F.col(text_col).cast("string")
    key = lambda *c: F.when(text.isNotNull(), F.xxhash64(*c))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), key(text).alias("k1"), key(F.lit(3), text, F.lit(5)).alias("k2"))


def text_classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 10, rows: int = 3, idf_floor: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, class_id of every distinct text of ``docs``."""
    spark = docs.sparkSession
    base = _keyed(docs, id_col, text_col).where("text is not null")
    frequent = spark.sparkContext.broadcast(document_frequencies(base, size, idf_floor))
    signed = stash(signatures(base, frequent, size, bands, rows), "signatures")
    hashes = bands * rows
    rough = distributed_components(candidate_links(signed.where("places is not null"), hashes // 2, hashes))
    rough = stash(rough.join(signed.select("node", "n_shingles", "k1", "k2", "head"), "node"), "candidates")
    sizes = rough.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES))
    sizes = stash(sizes.select("component", blocks.alias("blocks")).where("blocks > 1"), "large-sizes")
    rough = join_small(rough, sizes, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    texts = base.join(rough.select("k1", "k2", "node", "component", "blocks", "head"), ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("head")))
    texts = texts.groupBy("node").agg(F.first("component").alias("component"), F.first("blocks").alias("blocks"), F.first("text").alias("text"))
    classes = distributed_components(verified_links(stash(texts, "candidate-texts"), frequent, size, threshold))
    known = signed.select("node", "k1", "k2", "head").join(classes, "node", "left").select("k1", "k2", "head", F.coalesce("component", "node").alias("component"))
    known = stash(known, "classes")
    least = known.groupBy("component").agg(F.min("head").alias("class_id"))
    return known.join(least, "component").select("k1", "k2", "class_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Classes of near copies: one row per row of ``docs`` as (doc_id, class_id, n_in_class, kept).

    Two texts are linked if the weighted Jaccard similarity of their tf * idf vectors of ``size``-word shingles is
    ``threshold`` or more; equal texts always are; classes are connected components. class_id is the smallest doc_id
    of the class and that document is kept.

    Defined cases: a null text is a class of its own; texts without words are alike only if equal; a text shorter than a
    shingle counts as one shingle. A null doc_id names no class: class_id is the smallest id that is not null, or null if
    the class has none, and then all its rows are kept. Rows that repeat a doc_id belong to the classes of their own texts
    each, which may bear the same class_id if that id is the smallest of both; equal rows are returned each. n_in_class
    counts the rows with the class_id, 1 where it is null. An empty table gives an empty table; extra columns are ignored.
    """
    found = _keyed(docs, id_col, text_col).select("doc_id", "k1", "k2").join(text_classes(docs, id_col=id_col, text_col=text_col, **options), ["k1", "k2"], "left")
    found = stash(found.select("doc_id", F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")), "members")
    n = found.groupBy("class_id").agg(F.count("*").alias("n_in_class"))
    return found.join(n, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_in_class", F.lit(1)).alias("n_in_class"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with all their columns: one document of each class.

    Of rows that are equal in doc_id and text one is kept, whichever; rows with a null text are all kept.
    """
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    classes = text_classes(docs, **options).select(F.col("k1").alias("_near_k1"), F.col("k2").alias("_near_k2"), F.col("class_id").alias("_near_class"))
    keyed = docs.where("text is not null").withColumns({"_near_k1": F.xxhash64(text), "_near_k2": F.xxhash64(F.lit(3), text, F.lit(5)), "_near_id": id_})
    kept = keyed.join(classes, ["_near_k1", "_near_k2"]).where(F.col("_near_id").eqNullSafe(F.col("_near_class")))
    return kept.dropDuplicates(["_near_k1", "_near_k2", "_near_id"]).select(docs.columns).union(docs.where("text is null"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
