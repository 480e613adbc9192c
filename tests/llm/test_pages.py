"""HTML extraction: the tree model against brute force, and page shapes."""

import itertools
import re

import pytest

from corpusflow.llm import html_text
from corpusflow.llm.html_pages import labelled_pages
from corpusflow.llm.html_text import Page

MODEL = html_text.default_model()
LONG = "Some words that make a paragraph of text that goes on and on for a while to look like content. " * 3


def test_marginals_match_enumeration():
    p = Page("<body><nav><a href=x>Menu</a></nav><article><p>Some text here, quite long.</p></article><aside class=ad>ad</aside></body>")
    n = len(p.tag)
    unary = MODEL.unary(p)
    total, on = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        w = MODEL.root[y[0]] * unary[0][y[0]]
        for i in range(1, n):
            w *= unary[i][y[i]] * MODEL.edge.get(html_text._kind(p, i, MODEL.known), MODEL.default)[y[p.parent[i]]][y[i]]
        total += w
        for i in range(n):
            on[i] += w * y[i]
    got = MODEL.marginals(p)
    assert all(abs(on[i] / total - got[i]) < 1e-9 for i in range(n))


def test_labelled_pages_of_another_seed():
    wrong = total = 0
    for page in labelled_pages(200, seed=2):
        p = Page(page)
        wrong += MODEL._misjudged(p, html_text.labels(p))
        total += sum(len(t.strip()) for _, t in p.runs if t)
    assert wrong <= 0.02 * total


SHORT = "Plain paragraph one with text."
MENU = "<nav><a href=a>Home</a> <a href=b>News</a></nav>"
SHAPES = {
    f"<html><body><p>{SHORT}</p></body></html>": SHORT,
    f"<body><div><p>{LONG}</p></div></body>": LONG,
    f"<div class='zzz'><p>{LONG}</p></div>": LONG,
    "<b>inline only</b> text": "inline only text",
    "<body>words direct in body</body>": "words direct in body",
    f"<article><header><h2>Head</h2></header><p>{LONG}</p><div class='message'>a message</div></article>": f"Head {LONG} a message",
    f"<html><body>{MENU}<h1>T</h1><p>{LONG}</p><footer>&copy; me</footer></body></html>": f"T {LONG}",
    f"<body><table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td><p>{LONG}</p></td></tr></table></body>": LONG,
    f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div>{LONG}</div><div>{LONG}<br>{LONG}</div></body>": f"{LONG} {LONG} {LONG}",
    f"<body>{MENU}<main><p>{LONG}</p><aside><p>Aside {LONG}</p></aside></main></body>": LONG,
    f"<body><div id=wrapper><div class=row><section><h2>One</h2><p>{LONG}</p></section></div></div><div class=footer>All rights reserved</div></body>": f"One {LONG}",
    f"<body><center><font>{LONG}<br>{LONG}</font></center></body>": f"{LONG} {LONG}",
    f"<body><div class='cookie-banner'>We use cookies</div><article><p>{LONG}</p><div class='ad'>Buy</div><p>{SHORT}</p></article><div class=comments><p>{LONG}</p></div></body>": f"{LONG} {SHORT}",
    f"<body><form><label>Mail</label><button>Go</button></form><div class='post'><h1>T</h1><ul><li>{SHORT}</li><li>{LONG}</li></ul></div></body>": f"T {SHORT} {LONG}",
}


@pytest.mark.parametrize("page", list(SHAPES))
def test_shapes_of_pages(page):
    assert MODEL.text(page) == re.sub(r"\s+", " ", SHAPES[page]).strip()


def test_no_page_with_a_paragraph_comes_back_empty():
    for page in labelled_pages(200, seed=3):
        p = Page(page)
        y = html_text.labels(p)
        if sum(len(t.strip()) for node, t in p.runs if t and y[node]) >= 100:  # not a few words alone
            assert MODEL.text(page)


def test_extracts_the_article():
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- x --><div class=ad>Buy</div><article><h1>Head</h1><p><b>One\n two<br><p>{LONG}&amp; <i>a</i>b&nbsp;c</p><script>var t='</p>'</script></article><footer>&copy; me</footer>"
    assert MODEL.text(page) == f"Head One two {LONG}& ab c".replace("  ", " ").strip()


def test_leaves_boilerplate_out():
    page = f"<html><body><header><a href=/>Site</a></header><div class='cookie'>We use cookies</div><main><article><h1>Title</h1><p>{LONG}</p><section class='comments'><h2>Comments</h2><p>Nope {LONG}</p></section></article></main><aside><h3>X</h3><p>Nope {LONG}</p></aside><form><p>Nope</p></form><footer><p>Nope {LONG}</p></footer>"
    got = MODEL.text(page)
    assert got.startswith("Title Some words") and "Nope" not in got and "cookies" not in got


def test_odd_pages():
    assert MODEL.text(None) == "" == MODEL.text("")
    assert MODEL.text("plain &lt; words") == "plain < words"
    assert MODEL.text("<article>cut <b>off</b> <p clas") == "cut off"
    assert MODEL.text("<article><p>1 < 2 </div></p> x</article") .startswith("1 < 2")
    assert MODEL.text("<article>" * 50 + "deep" + "</article>" * 50) == "deep"
    assert len(MODEL.text("<article><p>" + "word " * 200_000 + "</p></article>")) == 999_999


def test_query_on_rows(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "x"), (1, "u", "<article><p>a</p></article>", "x"), (2, None, None, None), (None, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert html_text.extract_text(df.limit(0)).count() == 0
