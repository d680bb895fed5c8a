"""Main text of built pages, whose articles are known, and of broken ones."""

import html
import random
import re
import time

import numpy as np
import pytest

from landsift.llm import html_text
from landsift.llm.html_text import main_text

R = random.Random(3)
WORDS = "the land of a river & its banks <was> surveyed in “early” spring, über Straße añejo 日本 and sold later".split()


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


def article(k):
    """Blocks of an article and its markup."""
    blocks = [prose(R.randrange(3, 9)), *[prose(R.randrange(1, 120)) for _ in range(R.randrange(2, 9))]]
    e = [html.escape(b) for b in blocks]
    body = f"<h1>{e[0]}</h1>" + "".join(
        f"<p>{x.replace(' ', '  <em>x</em>'[:2], 1)}</p>\n" if (i + k) % 3 else f"<p>{x.replace(' a ', ' <b>a</b> ')}" for i, x in enumerate(e[1:])
    )
    return [" ".join(b.split()) for b in blocks], body


AROUND = {
    "head": "<!DOCTYPE html><html><head><title>T & more</title><style>p{x:0}</style><script>var t='</p><p>no</p>';</script></head><body class=\"page has-sidebar\">",
    "top": "<header><h1>Site</h1><p>All about land, for everybody who cares for it.</p></header><nav><ul><li><a href=/>Home</a><li><a href=/a>About us and more</a></ul></nav>",
    "notice": '<div class="cookie-notice">We use cookies to make this long sentence longer than many an article on this site is.</div>',
    "ad": '<!-- <p>ad</p> --><div class="ad">Buy land now, the best land there is, at prices you will not see again this year.</div>',
    "side": "<aside><h2>More</h2><p>A long teaser of another article that has nothing to do with this one at all, but is long.</p></aside>",
    "form": "<form><label>Your mail</label><p>Subscribe to our letter and get all the news about land every week.</p><button>Go</button></form>",
    "readers": '<section id="comments"><h3>2 comments</h3><article class="comment"><p>I disagree with all of it, and at length, since nobody stops me from writing here.</p></article></section>',
    "foot": "<footer>&copy; 2020 Site &middot; all rights reserved by those who own them</footer>",
}


def wrap(body, layout):
    a = AROUND
    if layout == "article":
        return a["head"] + a["top"] + a["notice"] + f"<main><article>{body}</article>{a['readers']}</main>" + a["side"] + a["ad"] + a["form"] + a["foot"]
    if layout == "inside":  # boilerplate within the article, end tags missing
        return a["head"] + a["top"] + f"<article>{a['ad']}{body}{a['form']}{a['side']}{a['readers']}</article>" + a["foot"]
    if layout == "main":
        return a["head"] + a["notice"] + a["top"] + f'<div role="main"><main>{body}</main></div>' + a["readers"] + a["foot"] + "</body></html>"
    return (
        a["head"] + '<div id="top-menu"><a href=/>Home</a> | <a href=/b>Business</a></div>' + a["notice"]
        + f'<div id="content"><div class="text">{body}</div></div>' + '<div><ul><li><a href=1>One more link</a></li><li><a href=2>Two links</a></li></ul></div>'
        + a["readers"] + a["foot"] + "</body></html>"
    )


@pytest.mark.parametrize("layout", ["article", "inside", "main", "plain"])
def test_articles_come_whole_and_alone(layout):
    for k in range(60):
        blocks, body = article(k)
        if layout == "plain":  # without elements that say so, the cluster must find some long line
            blocks, body = [*blocks, x := prose(150).replace("<was>", "was").replace("&", "and")], f"{body}<p>{x}</p>"
        assert main_text(wrap(body, layout)) == "\n".join(blocks), (layout, k)


def test_awkward_pages():
    assert main_text(None) == main_text("") == main_text("  \n") == main_text("<p></p>") == main_text("<nav>only a menu</nav>") == ""
    assert main_text("just text &amp; more") == "just text & more"
    assert main_text("<article><p>a&nbsp;b\t\n c<br>d &#x41;&eacute;&bogus; &amp") == "a b c d Aé&bogus; &"
    assert main_text("<article>kept <!-- never closed <p>gone") == "kept"
    assert main_text("<article>kept <a href='x") == "kept"
    assert main_text("<article>a <![if x]> b <![CDATA[c]]> <?php d ?> e < f </article>").split()[:2] == ["a", "b"]
    assert main_text("<article><p>one<p>two</div></p></b>three<script>no") == "one\ntwo\nthree"
    assert main_text('<div class="menu">told by class alone</div>') == "told by class alone"
    assert main_text("<article><header><h1>Title</h1><p>by me</p></header><p>text</p></article>") == "Title\ntext"
    assert main_text('<article><p>in <span class="ad">not <span>this</span></span> out</p></article>') == "in\nout"
    assert main_text("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table></article>") == "a\nb\nc\nd\ne\nf\ng"


@pytest.mark.parametrize("piece", ["<p>", "<b>", "<span>", "<div>", "</p>", "</div>", "<li><div>", "<!--", "<a ", "&", "<", "x ", "<td>", "</span><b>", "<ul><li>"])
def test_very_long_pages_take_time_in_proportion(piece):
    start = time.time()
    main_text("<article>" + piece * 60_000)
    assert time.time() - start < 5


def test_smoothing_is_a_mean_of_neighbours():
    x = np.array([3.0, 0, 8, 1, 1, 40, 2])
    for i, got in enumerate(html_text.smoothed(x)):
        near = [(np.exp(-((i - j) ** 2) / 2), x[j]) for j in range(len(x)) if abs(i - j) <= 2]
        assert got == pytest.approx(sum(w * v for w, v in near) / sum(w for w, _ in near))
    assert html_text.smoothed(np.array([5.0])) == pytest.approx([5.0])


def test_query_over_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    pages = [(k, f"u{k}", wrap(article(k)[1], "article"), "x", "y") for k in range(20)] + [(None, None, None, "x", "y"), (3, "again", "<p>A &amp; B</p>", None, None)]
    pages += [(50, "long", "<article>" + "<p>word</p>" * 50_000, None, None)] * 2
    got = html_text.extract(spark.createDataFrame(pages, schema)).collect()
    want = [(p, u, t := main_text(h), len(t)) for p, u, h, *_ in pages]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert max(r.n_chars for r in got) == 50_000 * 5 - 1
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


def test_pages_of_the_small_table(spark):
    """Every article of the synthetic pages, by a pattern instead of a parser."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    for r in rows.collect():
        inner = re.sub("<br>", " ", re.search("<article>(.*)</article>", r.html, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
