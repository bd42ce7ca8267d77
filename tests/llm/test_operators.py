"""Training-data operators against brute force and on awkward tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitchlake.llm import common, embeddings, html_text, knn, mixing, near_dup, packing, quality, sharding, substring_dedup, tokens, warc

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size string, epochs int, h string, good string, target string"
WORDS = [a + b + c for a in ("ba", "re", "mi", "lo", "tu") for b in ("na", "so", "ri", "ke") for c in ("", "m", "st", "la")]


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS)
        out.append((w.capitalize() if i % 9 == 0 else w) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = [prose(rng, rng.randint(60, 120)) for _ in range(40)]
    near = [t.replace(t.split()[30], "xylo", 1) for t in base[:8]]
    texts = base + base[:6] + near + [None, None, "", "", " \n ", "one two", "x" * 60_000, prose(rng, 6000), "é ü 漢字 — ok"]
    rows = [(i, t, None if i % 7 == 0 else "en", [None, "web", "web", "books"][i % 4], None, "s", 1, "h", "g", "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    nodes = {x for p in links for x in p}
    want = {n: r for n, r in union_find(nodes, links).items() if any(n in p and p[0] != p[1] for p in links)}
    got = {r.node: r.component for r in common.distributed_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == want


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, 4).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    slots = defaultdict(list)
    for r in got:
        body = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(body) + 8 and r.text_crc32 == zlib.crc32(body) and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.shard_documents(none, 4).count() == 0


def shingle_bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near_classes(texts):
    """Class of each id by the definition: weighted Jaccard of tf * idf five-word shingles of all pairs, then components."""
    bags = {i: shingle_bag(t) for i, t in texts.items()}
    df = Counter(s for b in bags.values() for s in b)
    least = max(1, math.ceil(len(texts) / 256))
    idf = {s: min(1.0, max(0.75, math.log(len(texts) / n) / math.log(256))) if n >= least else 1.0 for s, n in df.items()}
    total = {i: sum(n * idf[s] for s, n in b.items()) for i, b in bags.items()}
    links = []
    for a in texts:
        for b in texts:
            if a < b and texts[a] is not None and texts[b] is not None:
                both = sum(min(n, bags[b][s]) * idf[s] for s, n in bags[a].items() if s in bags[b])
                top = total[a] + total[b] - both
                if texts[a] == texts[b] or top and both >= 0.8 * top:
                    links.append((a, b))
    return union_find(sorted(texts), links)


def test_near_duplicates(docs, none):
    want = near_classes({r.doc_id: r.text for r in docs.collect()})
    got = near_dup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert near_dup.near_duplicates(none).count() == 0


def test_substring_dedup(spark, none):
    rng = random.Random(5)
    shared = " ".join(" ".join(rng.choice(WORDS).capitalize() if k == 0 else rng.choice(WORDS) for k in range(12)) + "." for _ in range(5))
    rows = [(i, f"{prose(rng, 45)} {shared} {prose(rng, 45)}") for i in range(5)] + [(9, None), (10, ""), (11, "Short."), (12, shared), (13, prose(rng, 90))]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, first string, size int")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert len(got) == len(rows)
    assert got[0].text == rows[0][1] and got[13].text == dict(rows)[13] and got[9].text is None and got[10].text == "" and got[11].text == "Short."
    for i in range(1, 5):
        assert shared not in got[i].text and got[i].text.startswith(rows[i][1][:150]) and got[i].removed_bytes >= len(shared) - 2
    assert got[12].text == "" and got[12].first == "f"
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_few_sentences(spark):
    rng = random.Random(12)
    low = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    one, two, bare, halves = f"{low(60).capitalize()}.", f"{low(12).capitalize()}. {low(48).capitalize()}.", low(60), f"{low(30)}. {low(30).capitalize()}"
    rows = [(k * 10 + i, f"{low(40)} {passage} {low(40)}") for k, passage in enumerate((one, two, bare, halves)) for i in range(3)]
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        before = " ".join(text.split()[:40])
        assert got[i].startswith(before) and got[i].endswith(" ".join(text.split()[-40:]))
        assert got[i] == text if i % 10 == 0 else len(got[i].split()) == 80 if i < 20 else len(got[i].split()) <= 80 + 2 * 24
    again = substring_dedup.remove_repeats(spark.createDataFrame([(1, low(24) + "\n" + bare), (2, low(24)), (3, bare)], "doc_id long, text string"))
    assert {r.doc_id: len(r.text.split()) for r in again.collect()} == {1: 84, 2: 24, 3: 0}


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    per, taken, target = Counter(), Counter(), {}
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r["size"] == n and 0 <= r.copies <= 2
        per[r.source] += n
        taken[r.source] += r.copies * n
        target[r.source] = r.target
    largest = max(r["size"] for r in got)
    for s in per:
        assert target[s] <= 2 * per[s] + 1e-6 and abs(taken[s] - target[s]) <= largest
    assert sum(target.values()) == pytest.approx(1.5 * sum(per.values()))
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(docs).collect()) == sorted((r.doc_id, r.copies) for r in got)
    repeated = mixing.repeat_rows(docs)
    assert repeated.columns == docs.columns and {r.target for r in repeated.collect()} == {"t"}
    assert mixing.mix(none).count() == 0 and mixing.repeat_rows(none).count() == 0


def test_tokens_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    whole, own = Tokenizer.from_file(path), tokens.PieceTokenizer(path)
    texts = ["it's they'll 'S  two  blanks\n\n x", "", "été 漢字 ½ ٣   tab\t", "a<|endoftext|>b", "we've 'd'", "  lead", "trail  ", "͸ unassigned", "x" * 3000, "'re'llve  y"]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert set(pieces) == {r.doc_id for r in docs.collect()}
    for p in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(p)):
            assert piece == k and start == at and 0 < length <= 2048 and (k == 0 or length == 2048)
            at += length
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 2048) + 2
    assert packing.pack(none).count() == 0


def test_pack_plan_keeps_every_piece():
    rng = np.random.default_rng(2)
    lengths, demand = np.unique(np.minimum(2048, rng.lognormal(5.5, 1, 20_000).astype(int) + 1), return_counts=True)
    used, n = Counter(), 0
    for times, items in packing.plan(lengths, demand):
        assert sum(size * often for size, often in items) <= 2048
        n += times
        for size, often in items:
            used[size] += times * often
    assert used == Counter(dict(zip(lengths.tolist(), demand.tolist(), strict=True)))
    assert n <= 1.02 * (lengths * demand).sum() / 2048 + 1


def test_quality(spark, none):
    rng = random.Random(8)
    good = [prose(rng, 80) for _ in range(150)]
    bad = [" ".join(rng.choice(["$$", "##", "=>", "BUY", "NOW!", "|", "<<x>>", "%%%"]) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate([*good, *bad, None, "", "  "])]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, good string")).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].good for i in range(150)]) >= 0.98 and np.mean([got[150 + i].good for i in range(60)]) <= 0.02
    assert not any(got[i].good for i in range(210, 213))
    assert quality.score(none).count() == 0


def test_votes_do_not_depend_on_other_documents():
    import pyarrow as pa

    def vote(texts):
        return [v.tolist() for _, _, data, offsets in quality.words.text_slices(pa.array(texts)) for v in np.column_stack(quality.traits(data, offsets)[:2])]

    rng = random.Random(9)
    texts = [prose(rng, 12), "a b a b a b", "", "!", "a b a b a b", prose(rng, 3), " ", "one"]
    assert vote(texts) == [vote([t])[0] for t in texts]


def test_top_products(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, []), (50, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_products(df, df.where("vec_id % 50 = 0 and vec_id <> 50")).collect()}
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all()]
    want = {}
    for q, x in good:
        if q % 50 == 0 and q != 50:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert knn.top_products(empty, empty).count() == 0


def test_top_products_of_a_repeated_id(spark):
    rng = np.random.default_rng(14)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(40)] + [(50, [9.0] * 8)] * 7
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in knn.top_products(df, spark.createDataFrame(rows[-1:], df.schema), n_pivots=len(rows)).orderBy("rank").collect()]
    x = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    best = sorted((-int(x[-1] @ y), i) for (i, _), y in zip(rows, x, strict=True) if i != 50)[:5]
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("inf")] * 16), (103, [])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    links = [(a, b) for a in range(len(x)) for b in range(a) if close[a, b]]
    root = union_find([i for i, _ in rows], links)
    degree = Counter(v for p in links for v in p)
    assert got == {i: (degree[i], root[i], root[i] == i) for i, _ in rows}
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a> <a>News</a></nav>
    <article><h1>A   title</h1><p>First &amp; longest paragraph of the article, with <b>bold</b> words.</p><p>Second&nbsp;one.</p></article>
    <aside>Other</aside><div class="comments"><p>Reader says a long thing about it, longer than the text itself is, on and on.</p></div><footer>(c)</footer><script>var x</script></body></html>"""
    assert html_text.main_text(page) == "A title\nFirst & longest paragraph of the article, with bold words.\nSecond one."
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("plain  text <") .startswith("plain text")


def test_html_of_open_head_wrappers_and_sibling_parts():
    say = lambda k: f"Paragraph {k} of the article says enough to be taken for the text of a page, and not for its menu."
    p = lambda *ks: "".join(f"<p>{say(k)}</p>" for k in ks)
    want = lambda *ks: "\n".join(say(k) for k in ks)
    menu = "<ul class=nav><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>"
    for start in ("<html><head><title>T</title><meta charset=x><body>", "<head><title>T</title><style>p{}</style>", "<head><noscript><img src=x></noscript></head><body>"):
        assert html_text.main_text(f"{start}<article>{p(1, 2)}</article>") == want(1, 2)
    assert html_text.main_text("<head><title>T</title>Bare text.") == "Bare text."
    for wrapper in ("<div class='layout has-sidebar'>", "<div class='search-results'>", "<form id=aspnet>", "<div class='sidebar'>", "<div class=ad><div>"):
        page = f"<body>{menu}<div>Note that is here.</div>{wrapper}<article>{p(1, 2)}<div class=share>Share</div></article></div></form><p>More at the end.</p></body>"
        assert html_text.main_text(page) == want(1, 2), wrapper
    links = "<ul>" + "<li><a href=x>Home</a></li>" * 20 + "</ul>"
    teasers = f"<div class=related><article>{p(8)}</article></div><aside><article>{p(9)}</article></aside><div hidden><main>{p(7)}</main></div>"
    assert html_text.main_text(f"<body><div class='page search'><main>{p(1, 2)}</main></div>{teasers}</body>") == want(1, 2)
    assert html_text.main_text(f"<body>{links}<div id=a><div>{p(1, 2)}</div><div>{p(*range(3, 19))}</div><div>{p(19, 20)}</div></div></body>") == want(*range(1, 21))


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (4, "u", ""), (5, "u", "x" * 200_000), (None, "u", "<p>é</p>")]
    archives = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    got = {r["headers"]["x-page-id"]: r for r in warc.read_archives(archives).collect()}
    assert {k: r.record_type for k, r in got.items()} == {"1": "response", "3": "revisit", "2": "response", "4": "revisit", "5": "response", "": "revisit"}
    assert got["3"]["headers"]["x-refers-to-page"] == "1" and bytes(got["1"].payload).decode() == "<p>é</p>" and len(got["5"].payload) == 200_000
    assert got["1"]["headers"]["warc-payload-digest"] == f"sha1:{warc.digest('<p>é</p>'.encode())}"
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_dictionary_and_faults():
    import io

    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    records = [warc.record("response", i, f"http://a/{i}", f"<html><p>page {i} of many</p></html>".encode() * 40, "A", None, 0) for i in range(400)]
    for r in records:
        writer.write(r)
    writer.close()
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    assert list(warc.read_frames(io.BytesIO(data))) == records
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(data[:-7])))
    with pytest.raises(warc.WarcError):
        warc.parse_record(records[0].replace(b"Content-Length: ", b"Content-Length: 9", 1))


def test_warc_payload_is_checked():
    data = warc.record("response", 1, "http://a/1", b"<p>one</p>", warc.digest(b"<p>one</p>"), None, 0)
    head, block = warc.parse_record(data)
    warc.check_payload(head, block[len(warc.HTTP_OK) :])
    for changed in ({"warc-payload-digest": f"sha1:{warc.digest(b'other')}"}, {"x-payload-length": "9"}):
        with pytest.raises(warc.WarcError):
            warc.check_payload(head | changed, block[len(warc.HTTP_OK) :])


def test_warc_repeated_ids_and_clashing_columns(spark):
    rows = [(3, "u", "<p>a</p>", "x", 1), (3, "u", "<p>a</p>", "y", 2), (5, None, "<p>a</p>", None, 3), (None, "v", "<p>a</p>", "z", 4), (7, "w", None, None, 5), (2, "w", "", None, 6), (9, "w", "x" * 300_000, None, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, first int")
    back = warc.read_archives(warc.archive_pages(pages)).collect()
    kinds = sorted((r["headers"]["x-page-id"], r["record_type"], r["headers"].get("x-refers-to-page"), len(r["payload"])) for r in back)
    assert kinds == [("", "revisit", "3", 0), ("2", "response", None, 0), ("3", "response", None, 8), ("3", "response", None, 8), ("5", "revisit", "3", 0), ("7", "revisit", "2", 0), ("9", "response", None, 300_000)]
