"""The corpus pipeline, stage by stage, against plain Python on a small planted table."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pitchlake.llm import packing

from test_operators import WORDS, near_classes

JUNK = ["$$", "##", "=>", "BUY", "NOW!", "|", "<<x>>", "%%%"]


def sentence(rng, n):
    w = [rng.choice(WORDS) for _ in range(n)]
    return " ".join([w[0].capitalize(), *w[1:]]) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """(directory, {doc_id: text}, ids of junk, the shared sentences)."""
    rng = random.Random(11)
    shared = [sentence(rng, 12) for _ in range(5)]
    texts = [[sentence(rng, rng.randint(7, 14)) for _ in range(rng.randint(8, 16))] for _ in range(60)]
    for i in range(50, 56):
        texts[i][4:4] = shared
    flat = [" ".join(t) for t in texts]
    flat += flat[:4] + [t.replace(t.split()[20], "xylo", 1) for t in flat[4:8]]
    flat.append(" ".join(sentence(rng, 10) for _ in range(500)))
    junk = set(range(len(flat), len(flat) + 25))
    flat += [" ".join(rng.choice(JUNK) for _ in range(60)) for _ in junk]
    rows = [(i, t, "en", [None, "web", "web", "books"][i % 4], len(t)) for i, t in enumerate(flat)]
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, dict(enumerate(flat)), junk, shared


def unrepeated(texts, run=3, least_words=15):
    """Texts without the sentences that a repeated run of sentences covers; every run here has the words it needs."""
    seen, gone = set(), defaultdict(set)
    cut = {i: re.findall(r"[^.]+\.", t) for i, t in sorted(texts.items())}
    for i, sentences in cut.items():
        own = [re.sub(r"\W+", " ", s.lower()).strip() for s in sentences]
        for a in range(len(own) - run + 1):
            key = tuple(own[a : a + run])
            assert len(" ".join(key).split()) >= least_words
            if key in seen:
                gone[i] |= set(range(a, a + run))
            seen.add(key)
    return {i: "".join(s for k, s in enumerate(sentences) if k not in gone[i]) for i, sentences in cut.items()}


def test_stages_and_run(spark, planted):
    path, texts, junk, shared = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, path), name)
        held[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns

    clean = {r.doc_id: r.text for r in held["quality_classifier"]}
    assert clean == {i: t for i, t in texts.items() if i not in junk}

    classes = near_classes(clean)
    single = {r.doc_id: r.text for r in held["minhash_near_dedup"]}
    assert single == {i: clean[i] for i in set(classes.values())} and len(single) <= len(clean) - 8

    whole = {r.doc_id: r.text for r in held["substring_dedup"]}
    plain = lambda t: t.split()  # noqa: E731  white space at a cut is free
    assert {i: plain(t) for i, t in whole.items()} == {i: plain(t) for i, t in unrepeated(single).items()}
    assert sum(shared[2] in t for t in whole.values()) == 1
    assert all(r.n_chars == len(r.text) for r in held["substring_dedup"])

    mixed = Counter(r.doc_id for r in held["source_mixing"])
    assert all(r.text == whole[r.doc_id] for r in held["source_mixing"]) and max(mixed.values()) <= 2
    words = {i: len(t.split()) for i, t in whole.items()}
    assert abs(sum(n * words[i] for i, n in mixed.items()) - 1.5 * sum(words.values())) <= 3 * max(words.values())

    whole_tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for i, n in mixed.items():
        ids = np.array([*whole_tokenizer.encode(whole[i], add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())] += n
    pieces = held["best_fit_packing"]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        assert all(o == sum(n for p, n in places if p < o) for o, _ in places) and sum(n for _, n in places) <= 2048

    again = corpus_pipeline.run(spark, path)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, again.select(*key).collect())) == want
