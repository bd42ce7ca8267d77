"""Substring dedup by sliding sentence spans.

A text is cut into sentences; every run of ``sentences`` consecutive ones is hashed over its words. A run of fewer than
``least_words`` words is lengthened until it has them, once to the right and once to the left, so that short sentences
at either end of a repeated passage are covered too; a run of fewer sentences is hashed as well, both ways, once it has
``window`` words. A passage without sentence marks, or cut inside its sentences, is found by word windows: of the runs
of ``window`` words that start at ``window`` places in a row the one with the least hash is taken (Schleimer et al.
2003, "Winnowing"), so that any two copies of 2 * window - 1 words have a window in common, windows of a long copy leave
no gap, and less than a window is left of it at either end. The hashes of all documents are joined globally by one
range sort on (hash, document): equal hashes lie side by side, even those of a span that a third of all documents
share, because the range may be cut between its documents. Every occurrence but the first (smallest document, then
smallest place) is a repeat, and the sentences or words it covers are removed. The most frequent hashes do not pass
through the sort's output: their first occurrences are broadcast, and each document finds its own repeats of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import words
from pitchlake.llm.common import group_bounds, stash, table

SPAN = "h long, doc long, uid long, first int, size int"
#: A hash is hot if its occurrences fill a part's share of spans divided by RUNS_A_PART, and LEAST_HOT at least.
RUNS_A_PART, LEAST_HOT = 4, 1000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]"]] = True


def sentence_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where sentences start, for rows at ``offsets``.

    A sentence starts at a row, after white space that holds a line feed or follows a stop mark (and closing quotes),
    and before a capital (ASCII or Latin-1) after white space: text that was spliced into a sentence starts anew.
    """
    n = len(data)
    space = _SPACE[data]
    head = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if n else np.zeros(0, int)
    if not len(head):
        return np.unique(offsets[:-1][np.diff(offsets) > 0])
    b = data[head]
    capital = (b >= 65) & (b <= 90)
    two = np.flatnonzero((b == 0xC3) & (head + 1 < n))
    follow = data[np.minimum(head[two] + 1, n - 1)]
    capital[two] = (follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97)
    tail = np.concatenate([[0], np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1])[: len(head)]  # end of the word before
    last = np.where(tail > 0, data[np.maximum(tail - 1, 0)], 0).astype(np.uint8)
    last = np.where(_CLOSE[last], data[np.maximum(tail - 2, 0)], last)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = capital | _STOP[last] | (lines[head] > lines[tail])
    return np.union1d(head[new & (head > 0)], offsets[:-1][np.diff(offsets) > 0])


def _running(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``f`` over each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def windows(prefix: words.Prefixes, row_stop: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows of ``size`` words that have the least hash of ``size`` windows in a row.

    ``row_stop`` is the number of the word after the row's last, for each word. The ends of a row count as windows of the
    largest hash, so rows do not touch each other.
    """
    n = len(row_stop)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - size + 1)
    h = prefix.hashes(at, at + size, ~np.uint64(size))  # never the hash of a sentence span at the same place
    inside = at + size <= row_stop[at]
    most = np.full(size - 1, np.iinfo(np.uint64).max, np.uint64)
    least = _running(np.minimum, np.concatenate([most, np.where(inside, h, most[0]), most]), size)
    taken = np.flatnonzero(inside & (_running(np.maximum, least, size) == h))
    return taken, h[taken]


def spans(data: np.ndarray, offsets: np.ndarray, sentences: int, least_words: int, window: int) -> tuple[np.ndarray, ...]:
    """(row, first byte, last byte + 1, hash) of each span; bytes count from the start of the row."""
    low, w_start, w_end = words.word_spans(data, offsets)
    prefix = words.Prefixes(words.span_hashes(low, w_start, w_end))
    starts = sentence_starts(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    edge = np.append(starts, len(data))
    row_end = np.searchsorted(row, row, "right")  # number of the sentence after the row's last
    row_begin = np.searchsorted(row, row, "left")
    word_at = np.searchsorted(w_start, edge)  # words before each sentence
    i = np.arange(len(starts))
    # to the right: the least end with enough sentences and words; to the left: the largest start with both
    end = np.maximum(i + sentences, np.searchsorted(word_at, word_at[:-1] + least_words, "left"))
    begin = np.minimum(i + 1 - sentences, np.searchsorted(word_at, word_at[1:] - least_words, "right") - 1)
    right = end <= row_end
    left = (begin >= row_begin) & (begin >= 0)
    left[left] = end[begin[left]] != i[left] + 1  # else it is the same span
    # the same for fewer sentences with more words
    full_end = np.searchsorted(word_at, word_at[:-1] + window, "left")
    full_begin = np.searchsorted(word_at, word_at[1:] - window, "right") - 1
    full_right = (full_end < end) & (full_end <= row_end)
    full_left = (full_begin > begin) & (full_begin >= row_begin)
    full_left[full_left] = full_end[full_begin[full_left]] != i[full_left] + 1
    a = np.concatenate([i[right], begin[left], i[full_right], full_begin[full_left]])
    z = np.concatenate([end[right], i[left] + 1, full_end[full_right], i[full_left] + 1])
    wa, wz = word_at[a], word_at[z]
    h = prefix.hashes(wa, wz, wz - wa)
    base = offsets[row[a]] if len(a) else np.zeros(0, np.int64)
    stop = np.where(z == row_end[a], offsets[row[a] + 1], edge[z]) if len(a) else np.zeros(0, np.int64)
    # windows of words, to the start of the next word or the end of the row
    w_row = np.searchsorted(offsets, w_start, "right") - 1
    row_stop = np.searchsorted(w_row, w_row, "right")
    first, w_hash = windows(prefix, row_stop, window)
    w_base = offsets[w_row[first]]
    w_stop = np.where(first + window == row_stop[first], offsets[w_row[first] + 1], np.append(w_start, len(data))[first + window])
    return np.concatenate([row[a], w_row[first]]), np.concatenate([edge[a] - base, w_start[first] - w_base]), np.concatenate([stop - base, w_stop - w_base]), np.concatenate([h, w_hash])


def span_rows(docs: DataFrame, sentences: int, least_words: int, window: int) -> DataFrame:
    """(h, doc, uid, first, size) of every span. docs: doc, uid, text."""

    def hash_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, uid = (b.column(k).to_numpy() for k in (0, 1))
            for first, _, data, offsets in words.text_slices(b.column(2)):
                row, a, z, h = spans(data, offsets, sentences, least_words, window)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "doc": pa.array(doc[first + row]), "uid": pa.array(uid[first + row]), "first": pa.array(a.astype(np.int32)), "size": pa.array((z - a).astype(np.int32))})

    return docs.where("text is not null").select("doc", "uid", "text").mapInArrow(hash_spans, SPAN)


def _flagged(b: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return b.append_column("kind", pa.array(np.full(b.num_rows, kind, np.int32)))


def _later(b: pa.RecordBatch, head: np.ndarray) -> np.ndarray:
    """Rows that are not the same occurrence as row ``head``: rows equal in id and text are one document."""
    return np.logical_or.reduce([(c := b.column(k).to_numpy()) != c[head] for k in (1, 2, 3)])


def compare_runs(batches: Iterator[pa.RecordBatch], hot_rows: int) -> Iterator[pa.RecordBatch]:
    """Runs of equal hashes in a part that is sorted by (h, doc, uid, first), as rows with a ``kind``.

    0: a repeat, an occurrence that is not the first of its run in the part; 1: the first of a run at an edge of the part,
    which may go on in another; 2: the first of a run of ``hot_rows`` or more, whose repeats are not listed.
    Memory holds a batch and fewer than ``hot_rows`` rows.
    """
    held: list[pa.RecordBatch] = []
    size, at_edge = 0, True

    def hold(part: pa.RecordBatch) -> None:
        nonlocal size
        held.append(part)
        size += part.num_rows
        if size >= hot_rows:
            held[:] = [held[0].slice(0, 1)]

    def close(edge: bool) -> Iterator[pa.RecordBatch]:
        nonlocal size
        run = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if size >= hot_rows:
            yield _flagged(run, 2)
        else:
            if edge:
                yield _flagged(run.slice(0, 1), 1)
            yield _flagged(run.filter(pa.array(_later(run, np.zeros(run.num_rows, int)))), 0)
        held.clear()
        size = 0

    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy()
        bounds = group_bounds(h)
        at = 0
        if held and held[0].column(0)[0].as_py() == h[0] or at_edge and not held:
            hold(b.slice(0, bounds[1]))
            at = 1
            if len(bounds) == 2:
                continue
        if held:
            yield from close(at_edge)
            at_edge = False
        a, z = int(bounds[at]), int(bounds[-2])
        if z > a:
            inner = b.slice(a, z - a)
            starts, width = bounds[at:-2] - a, np.diff(bounds[at:-1])
            head = np.repeat(starts, width)
            hot = width >= hot_rows
            if hot.any():
                yield _flagged(inner.take(pa.array(starts[hot])), 2)
            yield _flagged(inner.filter(pa.array(_later(inner, head) & ~np.repeat(hot, width))), 0)
        hold(b.slice(int(bounds[-2])))
    if held:
        yield from close(True)


def merged_ranges(group: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching ranges of a group as one: (group, first, last)."""
    order = np.lexsort((first, group))
    far = group[order].astype(np.int64) << 40
    a, z = first[order] + far, np.maximum.accumulate(last[order] + far)
    at = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]])) if len(a) else np.zeros(0, int)
    stop = z[np.append(at[1:] - 1, len(z) - 1)] if len(a) else a
    return group[order][at], a[at] - far[at], stop - far[at]


def repeated_spans(docs: DataFrame, sentences: int, least_words: int, window: int, least_hot: int = LEAST_HOT) -> DataFrame:
    """(doc, uid, first, last): byte ranges of every span that an earlier document, or an earlier place, has. docs: doc, uid, text.

    Hashes that fill a quarter of a part or more are few (at most four times the parts): their first occurrences are
    sent to all tasks, which mark the others document by document, so a passage that a third of all documents share
    is neither shuffled again nor listed occurrence by occurrence.
    """
    spark = docs.sparkSession
    every = stash(span_rows(docs, sentences, least_words, window), "spans")
    hot_rows = max(least_hot, every.count() // (RUNS_A_PART * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = ["h", "doc", "uid", "first"]
    dealt = every.repartitionByRange(*keys[:3]).sortWithinPartitions(*keys)
    found = stash(dealt.mapInArrow(lambda batches: compare_runs(batches, hot_rows), f"{SPAN}, kind int"), "repeats")
    heads = found.where("kind > 0").groupBy("h").agg(F.min(F.struct(*keys[1:])).alias("head"), F.max("kind").alias("most"))
    late = found.where("kind = 1").join(heads, "h").where(F.struct(*keys[1:]) > F.col("head"))
    out = ["doc", "uid", "first", (F.col("first") + F.col("size")).alias("last")]
    repeats = found.where("kind = 0").select(*out).union(late.select(*out))
    hot = heads.where("most = 2").select("h", "head.*").toArrow()
    if not hot.num_rows:
        return repeats
    table_ = np.stack([hot[k].to_numpy() for k in keys])
    sent = spark.sparkContext.broadcast(table_[:, np.argsort(table_[0])])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            h, doc, uid, first, size = (b.column(k).to_numpy() for k in range(5))
            at = np.minimum(np.searchsorted(known[0], h), known.shape[1] - 1)
            again = (known[0][at] == h) & ((known[1][at] != doc) | (known[2][at] != uid) | (known[3][at] != first))
            doc, uid, first, size = (x[again] for x in (doc, uid, first, size))
            bounds = group_bounds(doc, uid) if len(doc) else np.zeros(1, int)
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            g, a, z = merged_ranges(group, first.astype(np.int64), first.astype(np.int64) + size)
            yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[bounds[g]]), "uid": pa.array(uid[bounds[g]]), "first": pa.array(a.astype(np.int32)), "last": pa.array(z.astype(np.int32))})

    return repeats.union(every.mapInArrow(mark, "doc long, uid long, first int, last int"))


def ranges_of_documents(ranges: DataFrame) -> DataFrame:
    """doc, uid, r: the different ranges of each document, at most as many as its text has; rows alike find the same ones, which tasks merge before the shuffle."""
    return ranges.groupBy("doc", "uid").agg(F.collect_set(F.struct("first", "last")).alias("r"))


def _cut(text: str | None, first: list[int] | None, last: list[int] | None) -> tuple[str | None, int]:
    """The text without the byte ranges, and the bytes removed."""
    if text is None or first is None or not len(first):
        return text, 0
    data = text.encode()
    a, z = np.asarray(first, np.int64), np.asarray(last, np.int64)
    _, begin, stop = merged_ranges(np.zeros(len(a), np.int64), a, z)
    kept = [data[p:q] for p, q in zip([0, *stop.tolist()], [*begin.tolist(), len(data)], strict=True)]
    return b"".join(kept).decode(), int((stop - begin).sum())


def remove_repeats(docs: DataFrame, sentences: int = 3, least_words: int = 15, window: int = 25, least_hot: int = LEAST_HOT) -> DataFrame:
    """``docs`` with the repeated sentences and windows of words taken out of ``text`` and a column removed_bytes.

    Defined cases: documents are ordered by doc_id, nulls last, then by a hash of the text; rows that are equal in doc_id
    and text are one document: they are compared with others once and all cut alike, so that the first of them keeps its
    text in every row; rows that have a doc_id and different texts are documents of their own, each cut by its own ranges;
    a null text stays null; a document whose sentences are all repeats keeps its row with an empty text; a text with fewer
    words than ``least_words``, or than ``window`` if it has fewer sentences than a span, is left alone; an empty table
    gives an empty table; extra columns stay, a column removed_bytes is replaced.
    """
    id_ = F.col("doc_id").cast("long")
    doc, uid = F.coalesce(id_, F.lit((1 << 63) - 1)), F.xxhash64(id_, F.col("text").cast("string"))
    ranges = repeated_spans(docs.select(doc.alias("doc"), uid.alias("uid"), F.col("text").cast("string").alias("text")), sentences, least_words, window, least_hot)
    merged = ranges_of_documents(ranges).select(F.col("doc").alias("_cut_doc"), F.col("uid").alias("_cut_uid"), F.col("r.first").alias("_cut_first"), F.col("r.last").alias("_cut_last"))
    names = [c for c in docs.columns if c != "removed_bytes"]
    joined = docs.select(names).join(merged, (doc == F.col("_cut_doc")) & (uid == F.col("_cut_uid")), "left").drop("_cut_doc", "_cut_uid")
    at = names.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, first, last = (b.column(k) for k in (at, b.num_columns - 2, b.num_columns - 1))
            done = [_cut(t.as_py(), f.as_py(), e.as_py()) if f.is_valid else (t.as_py(), 0) for t, f, e in zip(texts, first, last, strict=True)]
            columns = [pa.array([t for t, _ in done], pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], names=[*names, "removed_bytes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)
    return joined.mapInArrow(apply, f"{fields}, removed_bytes long")


def op5_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_bytes")
