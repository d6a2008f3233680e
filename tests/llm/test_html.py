"""HTML extraction: exact inference, held-out labelled pages, the given pages, and broken markup."""

import html
import itertools
import re

import numpy as np
import pytest

from lexweave.llm import html_extract as H


def test_marginals_are_exact():
    r = np.random.default_rng(0)
    nodes = H.Nodes([-1, 0, 0, 1, 1, -1, 5], [0, 1, 1, 2, 2, 0, 1], [1, 2, 3, H.LEAF, 4, 2, H.LEAF], [[0], [1], [2, 3], [4], [5], [1], [6]], [""] * 7, [""] * 7)
    model = H.Model(r.standard_normal(H.N_FEATURES), r.standard_normal((H.LEAF + 1, 2, 2)))
    content, edge, log_z = H.sum_product(H._Tree.of(nodes), model)
    total, marginal, pair = 0.0, np.zeros(7), np.zeros((7, 2, 2))
    for y in itertools.product((0, 1), repeat=7):
        score = sum(sum(model.unary[f] for f in nodes.features[i]) * y[i] for i in range(7))
        score += sum(model.pair[nodes.kind[i], y[p], y[i]] for i, p in enumerate(nodes.parent) if p >= 0)
        w = np.exp(score)
        total += w
        marginal += w * np.array(y)
        for i, p in enumerate(nodes.parent):
            if p >= 0:
                pair[i, y[p], y[i]] += w
    assert content == pytest.approx(marginal / total)
    assert log_z == pytest.approx(np.log(total))
    for i, p in enumerate(nodes.parent):
        if p >= 0:
            assert edge[i] == pytest.approx(pair[i] / total)


def test_held_out_labelled_pages():
    nodes, labels = H.labelled(H.sample_pages(200, seed=123))
    content, _, _ = H.sum_product(H._Tree.of(nodes), H.default_model())
    leaf = np.array(nodes.kind) == H.LEAF
    assert ((content >= 0.5) == labels)[leaf].mean() > 0.99


def article(page):
    """The blocks of the one article of a given page, which holds nothing but headings and paragraphs."""
    a, b = page.find("<article>"), page.find("</article>")
    parts = re.split(r"</?(?:p|h1)>", page[a + 9 : b if b > 0 else len(page)])
    blocks = [" ".join(html.unescape(re.sub(r"</?(?:b|br|a|i)\b[^>]*>", " ", x)).split()) for x in parts]
    return "\n".join(x for x in blocks if x)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(pages).collect()}
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


PROSE = "This is the first of several sentences, and it says something. Another one follows here, with more words in it. A third one ends it."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><nav><a href=x>Home</a> <a href=y>News</a></nav><main><h1>Title of it</h1><p>{PROSE}</p><p>A &lt; B &amp;&nbsp; C&#33; {PROSE}</p></main><footer>&copy; Us</footer>", f"Title of it\n{PROSE}\nA < B & C! {PROSE}"),
        (f'<div class="menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class="post"><p>{PROSE}<p>{PROSE}</div><div class="comments"><div class="comment"><p>{PROSE}</p></div></div>', f"{PROSE}\n{PROSE}"),
        (f'<article><p>{PROSE}<script>var a = "</p><p>no";</script></p><style>p {{}}</style><!-- <p>no</p> --><p>{PROSE}</article><aside><h3>More</h3><p>{PROSE}</p></aside>', f"{PROSE}\n{PROSE}"),
        (f'<div class="cookie-notice"><p>{PROSE}</p></div><article><h1>T</h1><p>{PROSE}</p></article><form><p>Sign up here now.</p></form>', f"T\n{PROSE}"),
    ],
)
def test_layouts(page, want):
    assert H.extract_many([page], H.default_model()) == [want]


@pytest.mark.parametrize("page", [None, "", " ", "<", "<!--", "<p", "</p></div>", "<script>", "a < b", "<div>" * 3000, '<a b="c', "<p a='" * 500, "&amp", "<![CDATA[x]]>", "<!doctype html>"])
def test_broken_markup(page):
    assert len(H.extract_many([page, page], H.default_model())) == 2


@pytest.mark.parametrize(
    "page,held",
    [
        (f"<article><p>{PROSE} <button>Go</p><p>{PROSE}</p></article>", [f"{PROSE} Go", PROSE]),
        (f"<article><p>Before <svg><p>{PROSE}</p></article>", ["Before", PROSE]),
        (f"<article><p>{PROSE}<iframe src=x></p><p>{PROSE}</p></article>", [PROSE, PROSE]),
        (f"<article><p>{PROSE}</p><noscript><p>{PROSE}</p><noscript>no</noscript></article>", [PROSE, PROSE]),
        (f"<article><p>The area is <math><mi>x</mi></math> square metres. {PROSE}</p></article>", ["The area is x square metres. " + PROSE]),
        (f"<article><p>{PROSE} <xmp>a &lt; <b></xmp> {PROSE}</p></article>", [f"{PROSE} a &lt; <b> {PROSE}"]),
        (PROSE, [PROSE]),
        (f"<body>{PROSE}<br>{PROSE}</body>", [f"{PROSE} {PROSE}"]),
    ],
)
def test_no_text_is_lost_to_open_elements(page, held):
    assert H.extract_many([page], H.default_model()) == ["\n".join(held)]


@pytest.mark.parametrize("page", [f"<article><p>{PROSE} <button>Send it</button> {PROSE}</p></article>", f"<article><p>{PROSE} <svg viewBox='0'><text>Send it</text></svg> {PROSE}<iframe>Send it</iframe></p></article>", f"<article><p>{PROSE} <select><option>Send it</select> {PROSE}</p></article>"])
def test_closed_controls_go(page):
    assert H.extract_many([page], H.default_model()) == [f"{PROSE} {PROSE}"]


@pytest.mark.parametrize("part", ["<button>", "</section>", "<noscript>", "<svg></object>", "<p><button>", "<li><ul></li>", "<iframe><b>", "</p>", "<td><table>"])
def test_parsing_is_linear(part):
    import time

    took = []
    for n in (20_000, 100_000):
        began = time.perf_counter()
        nodes = H.Nodes.empty()
        H.parse("<div>x" + part * n + "a b</div>", nodes)
        took.append(time.perf_counter() - began)
    assert took[1] < 15 * took[0] + 0.5


def test_odd_tables(spark):
    long = "<article>" + f"<p>{PROSE}</p>" * 3000 + "</article>"
    rows = [(1, "u", None, 1, "t"), (None, None, "", 1, "t"), (2, "v", long, 1, "t"), (2, "v", long, 1, "t")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()
    text = "\n".join([PROSE] * 3000)
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", "", 0), (None, None, "", 0), (2, "v", text, len(text)), (2, "v", text, len(text))], key=repr)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
