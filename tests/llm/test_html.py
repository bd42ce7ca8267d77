"""HTML extraction: labelled pages, what the ratios decide, implied ends, awkward tables."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from pitchlake.llm import html_text

from test_operators import WORDS


def say(rng, n):
    w = [rng.choice(WORDS) for _ in range(n)]
    return " ".join([w[0].capitalize(), *w[1:]]) + "."


def labelled(seed):
    """(html, text): an article between menus, adverts and footers, marked up in one of many ways, without telling names in half of them."""
    rng = random.Random(seed)
    title = say(rng, 6)
    blocks = [("p", say(rng, rng.choice([5, 30, 60, 90]))) for _ in range(rng.randint(4, 12))]
    blocks.insert(0, ("p", say(rng, 40)))
    blocks.append(("p", say(rng, 40)))
    for _ in range(rng.randint(0, 2)):
        blocks.insert(rng.randint(1, len(blocks) - 1), ("h2", say(rng, 3)))
    body = f"<h1>{title}</h1>" + "".join(f"<{t}>{x}" + ("" if t == "p" and rng.random() < 0.3 else f"</{t}>") for t, x in blocks)
    links = "".join(f"<li><a href='/{k}'>{rng.choice(WORDS)}</a></li>" for k in range(rng.randint(6, 14)))
    menu = rng.choice([f"<nav><ul>{links}</ul></nav>", f"<ul>{links}</ul>", f"<div class='menu'><ul>{links}</ul></div>", f"<table><tr>{links.replace('li>', 'td>')}</tr></table>"])
    foot = rng.choice([f"<footer>{say(rng, 5)}</footer>", f"<div>{''.join(f'<a href=/{k}>{rng.choice(WORDS)}</a> | ' for k in range(8))}</div>", f"<div id=footer>{say(rng, 30)}</div>"])
    extra = rng.choice(["", f"<div class='ad'>{say(rng, 20)}</div>", f"<aside>{say(rng, 25)}</aside>", "<form><input><button>Send it now</button></form>", f"<div class=comments><p>{say(rng, 50)}</p></div>"])
    wrap = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div>{}</div>", "<div><div><div>{}</div></div></div>", "<table><tr><td>{}</td></tr></table>", "<div class='layout has-sidebar'><article>{}</article></div>"])
    head = rng.choice(["<html><head><title>T</title></head>", "<head><title>T", "<!doctype html><title>T</title><style>p{}</style>", ""])
    return f"{head}<body>{menu}{extra}{wrap.format(body)}{foot}<script>var x = '<p>';</script>", "\n".join([title, *(x for _, x in blocks)])


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


def test_labelled_pages():
    scores = [f1(html_text.main_text(page), text) for page, text in map(labelled, range(300))]
    assert np.mean(scores) >= 0.985 and np.mean([s == 1 for s in scores]) >= 0.85


def test_what_ratios_decide_without_names():
    """Pages without class names or article elements: with all lines in one cluster the menus and link lists stay."""
    rng = random.Random(4)
    ablated = lambda ratio: np.ones(len(ratio), bool)
    plain, without = [], []
    for k in range(60):
        paragraphs = [say(rng, rng.choice([4, 40, 80])) for _ in range(8)]
        paragraphs[0] = paragraphs[-1] = say(rng, 50)
        links = "".join(f"<li><a href='/{i}'>{rng.choice(WORDS)}</a></li>" for i in range(15))
        page = f"<body><ul>{links}</ul><div><h1>{say(rng, 5)}</h1>{''.join(f'<p>{x}</p>' for x in paragraphs)}</div><div>{''.join(f'<a href=/{i}>{rng.choice(WORDS)}</a> ' for i in range(9))}</div></body>"
        want = "\n".join(paragraphs)
        plain.append(f1(html_text.main_text(page), want))
        without.append(f1(html_text.main_text(page, cluster=ablated), want))
    assert np.mean(plain) >= 0.98 and np.mean(without) <= np.mean(plain) - 0.03
    inner = f"<article><p>{say(rng, 60)}</p><ul>{''.join(f'<li><a href=/{i}>{rng.choice(WORDS)}</a></li>' for i in range(20))}</ul><p>{say(rng, 60)}</p></article>"
    assert len(html_text.main_text(inner).split("\n")) < 10 < len(html_text.main_text(inner, cluster=ablated).split("\n"))


@pytest.mark.parametrize("start", ["<html><head><title>T</title><body>", "<title>T", "<head><title>T", "<select><option>A<option>B", "<textarea>x", "<select><optgroup><option>A"])
def test_implied_ends(start):
    text = "Long enough a text for the article of a page."
    assert html_text.main_text(f"{start}<p>{text}<p>{text}<div>") == f"{text}\n{text}"


def test_pages_without_an_article():
    assert html_text.main_text("<body><nav>Home and so on</nav><footer>The foot of a page</footer></body>") == ""
    assert html_text.main_text("<body><p hidden>Text that nobody sees</p><form>Name</form></body>") == ""
    assert html_text.main_text("<p>A text with a <button>Share</button> in it.</p>") == "A text with a in it."


def test_time_does_not_grow_with_depth():
    began = time.perf_counter()
    page = "<div>some words of text " * 8000 + "</div>" * 8000
    assert len(html_text.main_text(page)) == 8000 * 19 - 1
    html_text.main_text("<b>x" * 20_000 + "</i>" * 20_000)
    assert time.perf_counter() - began < 4


def test_pages_in_a_table(spark):
    text = "Paragraph that is long enough for an article of its own, as it seems."
    page = f"<body><nav>Menu</nav><article><p>{text}</p></article></body>"
    rows = [(1, "u", page, "a", 1), (1, "u", page, "a", 1), (2, None, None, "b", 2), (None, "v", "", "c", 3), (3, "w", f"<p>é &lt;b&gt; {text * 4000}", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = html_text.extract_articles(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    long_ = f"é <b> {text * 4000}"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", long_, len(long_))], key=repr)
    assert html_text.extract_articles(df.limit(0)).count() == 0
