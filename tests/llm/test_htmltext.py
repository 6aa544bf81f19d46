import random
import time
from html.parser import HTMLParser

import pytest

from cinegraph.llm import htmltext as h

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><article>";</script></head><body class="nav-open">
<header class=top><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href='/a>b'>More</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>One&nbsp;  two
three<br>four<p>five <i>si</i>x &lt;b&gt;</p><div class="ad">Buy now</div><table><tr><td>cell<td>next</table><form>Name <input></form><p>Of.</p>
<div id="comments"><p>First!</p></div></article><aside>Related</aside><footer>&copy; all</footer></body></html>"""


def test_best_region_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(rng.randint(0, 12))]
        best = max([0.0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        a, b = h.best_region(s)
        assert sum(s[a:b]) == best


def test_article(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p><a", "x"), (5, "u", "plain &eacute;", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in h.main_texts(pages).collect()}
    assert got[1].text == "Title & more\nOne two three\nfour\nfive six <b>\ncell\nnext\nOf."
    assert got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[3].text, got[4].text) == ("", 0, "", "")
    assert got[5].text == "plain é"
    assert h.main_texts(pages).count() == 6
    assert h.main_texts(pages.limit(0)).count() == 0


def test_page_without_article_uses_the_best_region():
    weights = {"wp": 2.0, "wdiv": 1.0, "wnav!": -3.0, "wa": -2.0, "tli": -1.0}
    text = h.extract("<nav>a b c d</nav><div><p>one two three</p><p>four</p></div><ul><li><a href=x>y</a></ul>", weights)
    assert text == "one two three\nfour"


def test_long_page():
    text = h.extract("<article>" + "<p>w</p>" * 30_000 + "<b>" * 2000, {})
    assert text.count("\n") == 29_999


@pytest.mark.parametrize("cut", [PAGE[:k] for k in range(0, len(PAGE), 37)])
def test_cut_off_pages(cut):
    assert "Buy" not in h.extract(cut, {})


class Article(HTMLParser):
    """Another reading of simple pages: the text of the article element, a block for each p, h1 or br."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "br"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in ("p", "h1"):
            self.blocks.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_labelled_pages_equal_another_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in h.main_texts(pages).collect():
        a = Article()
        a.feed(html[r.page_id] or "")
        assert r.text == "\n".join(x for x in (" ".join(b.split()) for b in a.blocks) if x)


def test_region_decides_within_an_article():
    page = "<article><p>one two three four</p><ul><li><a href=x>menu like link</a></li></ul></article>"
    assert h.extract(page, {"wp": 2.0, "wa": -2.0}) == "one two three four"
    assert h.extract(page, {"wp": 2.0, "wa": 1.0}) == "one two three four\nmenu like link"
    assert h.extract(page, {"wp": -2.0, "wa": 3.0}) == "menu like link"


def test_marks_are_whole_names():
    page = '<article><div class="header"><h1>Title</h1></div><p id="related-work">Related work.</p><p class="social-history">History.</p><div class="ad-box top">Buy</div><div class="share_buttons">Share</div></article>'
    assert h.extract(page, {}) == "Title\nRelated work.\nHistory."


@pytest.mark.parametrize("page", ["<b>" * 40_000 + "</b>" * 40_000, '<a "' * 40_000, "<div>" * 40_000, "<p><td>" + "<div>" * 40_000, "<p><table>" + "<b>" * 40_000 + "</p>" * 40_000, "<" * 100_000, "<!--" * 40_000])
def test_bad_pages_take_linear_time(page):
    began = time.time()
    h.extract(page, {})
    assert time.time() - began < 3


def test_comment_mark_inside_a_script():
    assert h.extract("<script>var x = '<!--';</script><p>text stays", {}) == "text stays"
