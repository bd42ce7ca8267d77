"""Quality rules as a ledger of bitmasks: every rule is evaluated once, policies and ablations are bitwise arithmetic on what it stored.

1. One pass over the whole texts takes the measurements (words, symbols, repeated lines, repeated 8-word windows, ...).
2. Every rule is evaluated once on them; bit i of ``failed`` says that rule i fails. Measurements and bits are written as a table.
3. A policy is a version with a set of rules: a mask. A document is kept if ``failed & mask`` is 0. An ablation counts documents by
   mask first (at most 2 ^ rules rows, summed before they are shuffled), so any number of policies or rules is weighed without
   reading a text again.

Words are runs of characters other than the six ASCII blanks. Words, lines and windows are compared exactly, by dictionary codes
and not by hashes. A task holds about 1 MB of text at a time, or one text if that is longer.

Defined cases: a null or empty text has no words and fails ``few_words``; a text of blanks likewise; a text of fewer than 8 words
has no window; a null doc_id stays null; repeated rows are measured row by row; an empty table gives an empty ledger; extra
columns, those named like a measurement too, are not read and not returned unless they are asked for in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.common import stash, table
from pitchlake.llm.words import text_slices

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letters", "n_marks")
#: Name of a rule and the condition on the measurements under which a document fails it; bit i belongs to the i-th rule.
#: New rules are added at the end, so that stored bits keep their meaning.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
    "capitals": "10 * n_capitals > 4 * n_letters",
    "marks": "10 * n_marks > 2 * n_words",
}
#: The rules of each version of the policy.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"),
    3: tuple(RULES),
}
LATEST = max(POLICIES)


def _member(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_SPACE = _member(" \t\n\x0b\x0c\r")
_SYMBOL = _member("#*$%&|<>")
_CAPITAL = _member("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _CAPITAL | _member("abcdefghijklmnopqrstuvwxyz")
_MARK = _member("!?")


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span of bytes, equal for equal spans only. Spans ascend and do not overlap."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # an end may be the next start
    body = data[np.cumsum(inside[:-1]).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, equal for equal pairs only. Numbers are below the count of what is in memory."""
    return pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0].astype(np.int64)


def repeated_words(words: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """How many words of each row lie in a window of ``size`` words that its row holds twice or more. ``size`` is a power of two."""
    n, rows = len(words), len(bounds) - 1
    if n < size:
        return np.zeros(rows, np.int64)
    window, width = words, 1
    while width < size:
        window = _pairs(window[:-width], window[width:])
        width *= 2
    row = np.repeat(np.arange(rows), np.diff(bounds))
    at = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    if not len(at):
        return np.zeros(rows, np.int64)
    code = _pairs(row[at], window[at])
    start = at[np.bincount(code)[code] > 1]
    cover = np.zeros(n + 1, np.int64)
    cover[start] += 1
    cover[start + size] -= 1
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those of them that equal an earlier line) of each row. words: where words start."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    full = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(offsets, starts, "right") - 1
    rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    again = pd.Series(_pairs(row, _codes(data, starts, ends))).duplicated().to_numpy()
    return np.bincount(row, minlength=rows), np.bincount(row[again], minlength=rows)


def measured(texts: pa.Array, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """MEASURES of each text, as a table of rows by measures for each slice of texts."""
    for _, _, data, offsets in text_slices(texts, limit):
        space = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])[: len(data)]))
        ends = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]])[: len(data)])) + 1
        bounds = np.searchsorted(starts, offsets)

        def count(hit: np.ndarray, offsets=offsets) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
            return total[offsets[1:]] - total[offsets[:-1]]

        lines, again = repeated_lines(data, offsets, starts)
        words = _codes(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        yield np.column_stack([
            np.diff(bounds), count(~space & ((data & 0xC0) != 0x80)), count(_SYMBOL[data]), lines, again,
            repeated_words(words, bounds), count(_CAPITAL[data]), count(_LETTER[data]), count(_MARK[data]),
        ]).astype(np.int64)


def measurements(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry`` and the MEASURES of every row's whole text."""
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(m, T.LongType()) for m in MEASURES])
    text = "_text_of_row"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [*measured(b.column(b.schema.get_field_index(text)))]
            values = np.concatenate(found) if found else np.zeros((0, len(MEASURES)), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), *(pa.array(v) for v in values.T)], names=[*carry, *MEASURES])

    return docs.select(*carry, F.col("text").cast("string").alias(text)).mapInArrow(run, schema)


@dataclass(frozen=True)
class Policy:
    """A version and the mask of its rules."""

    version: int
    mask: int

    @classmethod
    def of(cls, version: int = LATEST, rules: Sequence[str] | None = None) -> Policy:
        names = POLICIES[version] if rules is None else rules
        return cls(version, sum(1 << list(RULES).index(r) for r in names))

    def hits(self) -> Column:
        return F.col("failed").bitwiseAND(F.lit(self.mask).cast("long"))


def bits() -> Column:
    """The mask of the rules that a row's measurements fail."""
    return sum((F.when(F.expr(f"({when})"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, when in enumerate(RULES.values())), F.lit(0).cast("long"))


def ledger(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry``, MEASURES and ``failed``, written once; policies and ablations read this table and no text."""
    return stash(measurements(docs, carry).withColumn("failed", bits()), "rule-ledger")


def judged(book: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The ledger with ``policy`` (version), ``kept``, and ``sole_rule``: the rule without which a document that is not kept would be."""
    policy = policy or Policy.of()
    hits = policy.hits()
    sole = F.coalesce(*[F.when(hits == F.lit(1 << i), F.lit(name)) for i, name in enumerate(RULES)])
    return book.withColumns({"policy": F.lit(policy.version), "kept": hits == 0, "sole_rule": sole})


def ablations(book: DataFrame, policy: Policy | None = None, by: Sequence[str] = ()) -> DataFrame:
    """For each rule of the policy (and value of ``by``): rule, documents, failing, failing_alone, kept, kept_without.

    Documents are counted by their masked bits before anything is shuffled; a rule's figures are sums over these counts.
    """
    policy = policy or Policy.of()
    patterns = book.groupBy(*by, policy.hits().alias("hits")).agg(F.count("*").alias("n"))
    rules = [(name, 1 << i) for i, name in enumerate(RULES) if policy.mask >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in rules]))
    of = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    hit, bit = F.col("hits"), F.col("r.bit")
    return (
        patterns.select(*by, "hits", "n", each.alias("r")).groupBy(*by, "r.rule")
        .agg(
            F.sum("n").alias("documents"), of(hit.bitwiseAND(bit) != 0).alias("failing"), of(hit == bit).alias("failing_alone"),
            of(hit == 0).alias("kept"), of(hit.bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"),
        )
    )


def op12_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest policy over all documents, with the measurements and bits of the ledger.

    A null or empty text has no words: base_failed, not kept. Repeated rows and null ids are rows each.
    """
    book = judged(ledger(table(spark, sf_dir, "documents")))
    base = Policy.of(1).hits() != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "n_lines", "n_capitals", "n_letters", "n_marks", "failed", "policy", "sole_rule")


_WORD = "[^\\x20\\x09-\\x0D]+"
_COUNT = lambda pattern: f"len(regexp_extract_all(x, '{pattern}'))"
_CASES = ", ".join(f"({1 << i}, '{name}')" for i, name in enumerate(RULES))
OP12_SQL = f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as x from documents),
w as (select *, regexp_extract_all(x, '{_WORD}') as ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as ls from d),
g as (select r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as win from (select r, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) as i from w where len(ws) >= {WINDOW})),
h as (select r, i from g qualify count(*) over (partition by r, win) > 1),
p as (select r, count(distinct i + k) as n from h, (select unnest(generate_series(0, {WINDOW - 1})) as k) group by r),
m as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, {_COUNT("[#*$%&|<>]")} as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
  {_COUNT("[A-Z]")} as n_capitals, {_COUNT("[A-Za-z]")} as n_letters, {_COUNT("[!?]")} as n_marks from w left join p using (r)),
f as (select *, {" + ".join(f"case when {when} then {1 << i} else 0 end" for i, when in enumerate(RULES.values()))} as failed from m)
select f.*, failed & 3 <> 0 as base_failed, failed = 0 as kept, {LATEST} as policy, rule as sole_rule from f left join (values {_CASES}) t(bit, rule) on bit = failed"""
