"""Measurements, bits, policies and ablations against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pitchlake.llm import rule_ledger as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = lambda pattern: len(re.findall(pattern, text))
    return (len(words), sum(map(len, words)), count(r"[#*$%&|<>]"), len(lines), len(lines) - len(set(lines)), len(repeated), count("[A-Z]"), count("[A-Za-z]"), count("[!?]"))


def failed(m):
    n, chars, symbols, lines, again, repeated, capitals, letters, marks = m
    rules = [n < 20, 100 * repeated > 30 * n, 10 * symbols > n, 2 * again > lines, chars < 2 * n or chars > 12 * n, 10 * capitals > 4 * letters, 10 * marks > 2 * n]
    return sum(1 << i for i, x in enumerate(rules) if x)


def texts():
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "Ω", "x" * 30, "#", "||", "YES", "why?", "日本"]
    out = [None, "", " ", "\n\n", " ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "a\tb\x0bc\x0cd\re f g h\na b c d e f g h", "x\r\nx\nx ", "\x1fa b\x00c"]
    for _ in range(200):
        words = [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\n", "\t"]) for w in words))
    block = " ".join(f"w{i}" for i in range(40))
    out += [block, block + " " + block, block + "\n" + " ".join(f"v{i}" for i in range(70)) + "\n" + block, "long " * 300_000, "".join(f"u{i} " for i in range(200_000))]
    return out


def test_measurements_and_bits(spark):
    rows = [(None if i == 3 else i // 2, t, 1, "other") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, failed string").repartition(5)
    book = R.ledger(docs)
    assert book.columns == ["doc_id", *R.MEASURES, "failed"]
    want = Counter((i, *plain(t), failed(plain(t))) for i, t, *_ in rows)
    assert Counter(map(tuple, book.collect())) == want


def test_slices_do_not_matter():
    import numpy as np
    import pyarrow as pa

    all_ = [t for t in texts() if t is None or len(t) < 1000]
    whole = [*R.measured(pa.array(all_), 1 << 30)]
    small = np.concatenate([*R.measured(pa.array(all_), 50)])
    assert len(whole) == 1 and (whole[0] == small).all() and [tuple(r) for r in small.tolist()] == [plain(t) for t in all_]


def test_policies_and_ablations(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts())]
    book = R.ledger(spark.createDataFrame(rows, "doc_id long, text string, source string"), ("doc_id", "source"))
    bits = {i: failed(plain(t)) for i, t, _ in rows}
    for version in R.POLICIES:
        policy = R.Policy.of(version)
        got = {r.doc_id: (r.kept, r.sole_rule) for r in R.judged(book, policy).collect()}
        names = list(R.RULES)
        hit = {i: b & policy.mask for i, b in bits.items()}
        assert got == {i: (b == 0, names[b.bit_length() - 1] if b and b & (b - 1) == 0 else None) for i, b in hit.items()}
        for by in ((), ("source",)):
            table = {(tuple(r[c] for c in by), r.rule): tuple(r[c] for c in ("documents", "failing", "failing_alone", "kept", "kept_without")) for r in R.ablations(book, policy, by).collect()}
            want = {}
            for key in {tuple([r[2]] if by else []) for r in rows}:
                mine = [hit[i] for i, _, s in rows if not by or (s,) == key]
                for name in R.POLICIES[version]:
                    bit = 1 << names.index(name)
                    want[key, name] = (len(mine), sum(b & bit > 0 for b in mine), sum(b == bit for b in mine), sum(b == 0 for b in mine), sum(b & ~bit == 0 for b in mine))
            assert table == want


def test_kept_is_false_where_the_base_fails(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op12_rule_ledger(spark, str(tmp_path))
    for r in got.collect():
        m = plain(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (m[0], m[1], m[2], m[4], m[5])
        assert r.base_failed == (m[0] < 20 or 100 * m[5] > 30 * m[0]) and r.kept == (failed(m) == 0) and not (r.kept and r.base_failed)


def test_empty(spark):
    book = R.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert book.count() == 0 and R.judged(book).count() == 0 and R.ablations(book).count() == 0


def test_labelled_documents(spark):
    """Good rows of 20 words and more stay, nearly all bad ones go."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = R.op12_rule_ledger(spark, sf).join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.1 * sum(v for (q, _), v in n.items() if q == 0)
