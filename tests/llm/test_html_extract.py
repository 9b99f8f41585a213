"""Marginals against enumeration, extraction against the articles of the table and odd pages."""

from __future__ import annotations

import html
import itertools
import re
import time

import numpy as np
import pytest

from panelwright.llm.html_extract import Model, extract, fit, main_text, marginals, parse, train, tree


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return train(pages)


def article(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", body)
    lines = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in blocks]
    return "\n".join(x for x in lines if x)


def test_marginals_are_exact():
    rng = np.random.default_rng(5)
    model = Model(node=rng.normal(size=1 << 12), pair=rng.normal(size=(2, 2, 2)))
    t = tree(parse("<div class=ad><p>one two.<b>x</b></p>tail</div><nav>n</nav>"))
    n = len(t.parent)
    own = np.bincount(t.owner, model.node[t.slots], n)
    weights = np.zeros(n)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(own[k] for k in range(n) if labels[k])
        score += sum(model.pair[t.kind[k], labels[t.parent[k]], labels[k]] for k in range(1, n))
        total += np.exp(score)
        weights += np.exp(score) * np.array(labels)
    assert np.allclose(marginals(t, model)[0], weights / total)


def test_whole_table(pages, model):
    wanted = {r.page_id: article(r.html) for r in pages.collect()}
    for r in extract(pages, model).collect():
        assert r.text == wanted[r.page_id] and r.n_chars == len(r.text)


LONG = "This is a sentence of the story, with several words in it. " * 4


@pytest.mark.parametrize("noise", [
    '<div class="sidebar"><p>Related things to read, and more.</p></div>', '<section id="comments"><p>Nice one, I think!</p></section>',
    "<aside>By the way.</aside>", '<div class="cookie-notice">We use cookies. Accept.</div>', "<form><p>Your name</p><input></form>",
    "<script>var a = '<p>';</script>", "<style>p{}</style>", '<div class="ad-slot">Buy now.</div>', "<nav><a href=x>Home</a></nav>",
    '<footer>&copy; us</footer>', "<!-- <p>no</p> -->", '<div role="banner"><h2>Site</h2></div>', '<ul class="menu"><li>One<li>Two</ul>',
])
def test_noise_goes_and_article_stays(model, noise):
    for where in ("<html><body>{n}<article><h1>Head</h1><p>{t}</p></article></body>", "<body><article><h1>Head</h1><p>{t}</p>{n}</article>",
                  "<body><main><h1>Head</h1><p>{t}</p></main>{n}"):
        assert main_text(where.format(n=noise, t=LONG), model) == "Head\n" + LONG.strip(), where


def test_odd_pages(spark, model):
    assert main_text("", model) == main_text("<nav>x</nav>", model) == main_text("<", model) == ""
    text = main_text(f"<article><p>a &amp;&nbsp;b&#33;\n  c &lt;p&gt; {LONG}<p>é &unknown; &copy {LONG}", model)
    assert text == f"a & b! c <p> {LONG.strip()}\né &unknown; © {LONG.strip()}"
    df = spark.createDataFrame(
        [(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (None, "u", f"<article><p>{LONG}</article>", "t")],
        "page_id long, url string, html string, text string",
    )
    rows = extract(df, model).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, 0, len(LONG.strip())]
    assert extract(df.limit(0), model).collect() == []
    assert isinstance(train(df.limit(0)), Model) and isinstance(fit([]), Model)


def test_depth_attributes_and_topics(model):
    """Furniture below hundreds of elements, attributes of any length, topics that are called like furniture."""
    deep = "<div>" * 400 + "<nav><a href=x>Home</a> <a href=y>Other places to go</a></nav>" + "</div>" * 400
    wanted = "Head\n" + LONG.strip()
    assert main_text(f"<body>{deep}<article><h1>Head</h1><p>{LONG}</p></article>{deep}", model) == wanted
    assert main_text("<div>" * 300 + f"<article><h1>Head</h1><p>{LONG}</p></article>" + "</div>" * 500 + "<footer>Us</footer>", model) == wanted
    alt = "an attribute > with a sign " * 500
    many = " ".join(f'data-{i}="{i} > 1"' for i in range(200))
    for tag in (f'<img alt="{alt}">', f"<span title='{alt}'></span>", f"<img {many}>"):
        assert main_text(f"<article><h1>Head</h1><p>{tag}{LONG}</p></article>", model) == wanted
    for name in ("social-science", "form follows", "meta legal", "search-engines"):
        assert main_text(f'<body><nav>a</nav><article class="{name}"><h1>Head</h1><p>{LONG}</p></article>', model) == wanted
    assert main_text(f'<main><h1>Head</h1><p>{LONG}</p></main><article class="related-story"><p>Another story, to be read.</p></article>', model) == wanted


def test_broken_markup_is_cheap():
    start = time.process_time()
    for source in ('<a "' * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 50_000, "<p title='>" * 50_000, "<div>" * 50_000 + "x",
                   "<i><h2>" * 50_000, "<p>" + "<div><i><h2>" * 20_000, "<li><option>" * 30_000, "<a b='" + '"' * 100_000, '<a b="x" ' * 60_000):
        parse(source)
    assert time.process_time() - start < 20
