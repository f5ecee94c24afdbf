"""Main text of pages."""

import html
import re

import pytest

from tidemark.llm import html_extract as H

ARTICLE = "<p>First long paragraph of the article, with many words in it.</p><p>Short.</p><ul><li>one item<li>two &amp; three</ul><p>A <b>last</b>\n paragraph&nbsp;with<br>a break.</p>"
BLOCKS = ["First long paragraph of the article, with many words in it.", "Short.", "one item", "two & three", "A last paragraph with a break."]


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a>x</a></ul></nav><article>{ARTICLE}</article><footer>f</footer></body></html>",
        f"<body><div class='menu'><a>a</a><a>b</a></div><div id=content>{ARTICLE}</div><div class='comments'><p>A very long reader comment that goes on and on, longer than the rest.</p></div></body>",
        f"<body><header><h1>Site</h1></header><main><aside>side</aside>{ARTICLE}<form><label>Mail</label><input></form></main>",
        f"<body><div class='cookie-notice'>We use cookies and say so at some length here, dear reader.</div><article>{ARTICLE}<script>var x='<p>no</p>';</script><div class='ad'>Buy this now</div></article>",
    ],
)
def test_only_the_article_is_left(page):
    assert H.main_text(page) == "\n\n".join(BLOCKS)


@pytest.mark.parametrize("page", [None, "", "   ", "<nav>only a menu</nav>", "<script>x</script>", "<!-- c -->"])
def test_no_text(page):
    assert H.main_text(page) == ""


def test_odd_markup_does_not_crash():
    assert H.main_text("plain text &lt;no tags") == "plain text <no tags"
    assert H.main_text("</p></div>a<div>b<p>c").endswith("b\n\nc")
    assert H.main_text("<article><p>x" + "<b>" * 3000 + "deep").startswith("x")
    assert H.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>").count("word") == 40_000


def test_pages_of_the_test_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(out) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert out[r.page_id].text == "\n\n".join(b for b in blocks if b) and out[r.page_id].n_chars == len(out[r.page_id].text)


LONG = [f"Paragraph {i} of a story that goes on for a good while, with one clause after another until it ends." for i in range(8)]
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(12)) + "</ul>"
LURE = "<div><p><a href='/x'>More</a></p><p><a>Go</a></p><p><span><b>One</b> <i>remark</i> stands <u>between</u> links here.</span></p><p><a>Up</a></p><p><a>Top</a></p></div>"


def plain_page(blocks):
    """A page without an article element or a telling class name."""
    return f"<html><body><div><div>{MENU}</div></div><div><div>{LURE}</div><div>{blocks}</div></div><div>{MENU}<div>All rights kept.</div></div></body></html>"


def test_content_decides_without_names():
    blocks = "<h2>A heading</h2>" + "".join(f"<p>{x}</p>" for x in LONG[:4]) + "<p>Short.</p><ul><li>one<li>two<li>three<li>four<li>five<li>six<li>seven</ul>" + "".join(f"<p>{x}</p>" for x in LONG[4:]) + "<p>The end.</p>"
    want = ["A heading", *LONG[:4], "Short.", "one", "two", "three", "four", "five", "six", "seven", *LONG[4:], "The end."]
    assert H.main_text(plain_page(blocks)) == "\n\n".join(want)


def test_smoothing_and_threshold_decide(monkeypatch):
    # one long line among links, and short paragraphs among long ones
    lure = "<div><p><a href='/x'>More</a></p><p><a>Go</a></p><p>A lone remark of sixty-two characters that stands between links.</p><p><a>Up</a></p><p><a>Top</a></p></div>"
    page = f"<body><div>{lure}{MENU}</div><div>" + "".join(f"<p>{x}</p>" for x in LONG) + f"</div><div>{MENU}</div></body>"
    want = "\n\n".join(LONG)
    assert H.main_text(page) == want
    with monkeypatch.context() as m:
        m.setattr(H, "smooth", lambda values, sigma=0: values)
        assert H.main_text(page) != want
    with monkeypatch.context() as m:
        m.setattr(H, "threshold", lambda values: 0.0)
        assert H.main_text(page) != want


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'>{}</div>",
        "<article class='post no-comments'>{}</article>",
        "<div class='page with-sidebar'><main class='header-less'>{}</main></div>",
        "<div class='widget ad'>{}</div><div><p>tiny</p></div>",
        "<div class='modal'><h1>Title</h1>{}</div>",
        "<form id=aspnet class='form'>{}<input><label>x</label></form>",
        "<div id='comments'><main>{}</main></div>",
        "<svg/>{}",
        "<p><math/></p>{}",
    ],
)
def test_a_word_never_drops_the_article(page):
    assert "\n\n".join(LONG) in H.main_text("<body>" + page.format("".join(f"<p>{x}</p>" for x in LONG)) + "</body>")


def test_comments_go_even_if_longer_than_the_article():
    comments = "".join(f"<article class='comment'><p>{x} And so says reader {i}.</p></article>" for i, x in enumerate(LONG))
    for wrap in ("<article>{}</article>", "<div><h1>Title</h1>{}</div>", "<div>{}</div>"):
        page = "<body>" + wrap.format(f"<p>{LONG[0]}</p><p>{LONG[1]}</p>") + f"<section id='comments'>{comments}</section></body>"
        assert H.main_text(page).endswith(f"{LONG[0]}\n\n{LONG[1]}") and "reader" not in H.main_text(page)


def test_sibling_articles_all_stay():
    page = "<body><nav>x</nav>" + "".join(f"<article><h2>Title {i}</h2><p>{x}</p></article>" for i, x in enumerate(LONG)) + "<footer>f</footer></body>"
    assert H.main_text(page) == "\n\n".join(y for i, x in enumerate(LONG) for y in (f"Title {i}", x))


def test_inline_elements_part_no_words():
    assert H.main_text("<article><p>super<wbr>cali<b>fragi</b>lis<img src=x>tic and<br>more</article>") == "supercalifragilistic and more"


def test_deep_and_unclosed_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 100_000 + "text", "<b>" * 100_000 + "x" + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000 + "text", "<ul>" + "<div>" * 50_000 + "<dt><li>" * 50_000 + "text", "<p>" * 100_000 + "text", "<td>a" * 50_000):
        assert H.main_text(page)
    assert time.time() - began < 30


def test_empty_table_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a b", "y"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in H.extract(rows).collect()) == [(0, "a b", 3), (1, "", 0), (1, "", 0)]
    assert H.extract(rows.limit(0)).count() == 0


def test_smoothing_and_threshold():
    import numpy as np

    assert np.allclose(H.smooth(np.ones(9)), 1)
    assert 1 < H.threshold(np.array([1.0, 1, 1, 50, 52])) < 50
