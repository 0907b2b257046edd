import html
import re

import numpy as np

from millrace.llm import html_text as H


def article(page):
    """Blocks of the table's pages: the article's text cut at block tags."""
    a = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    a = re.sub(r"<br>", " ", a)
    parts = re.split(r"</?(?:p|h1|ul|li|div)>", a)
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts]
    return "\n\n".join(x for x in parts if x)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = H.op9_html_text(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def test_boilerplate_of_many_kinds():
    body = "<p>First paragraph with a good many words in it, and more.</p><p>Short.</p><blockquote>Said &amp; done &eacute; &#x41;</blockquote><ul><li>one<li>two</ul><p>Last long paragraph of the article with <b>bold <i>text</b> inside it.</p>"
    want = "Title\n\nFirst paragraph with a good many words in it, and more.\n\nShort.\n\nSaid & done é A\n\none\n\ntwo\n\nLast long paragraph of the article with bold text inside it."
    junk = '<nav><a>Home</a></nav><div class="sidebar"><p>Side text that is long enough to look like content, maybe longer.</p></div><div id="cookieNotice">We use cookies</div><form><p>Name</p><input></form><aside>See also</aside><!-- c --><script>if (a < b) "</p>";</script><style>p{}</style>'
    comments = '<section class="comments"><article class="comment"><p>I think that this is a reader comment of some length, really long in fact, longer than all.</p></article></section>'
    for page in (
        f"<html><head><title>T</title></head><body><header>Site</header>{junk}<article><h1>Title</h1>{body}</article>{comments}<footer>(c)</footer></body></html>",
        f"<body>{junk}<main><h1>Title</h1>{body}{comments}</main><footer>x</footer>",
        f'<div class="page has-sidebar"><div class="menu"><ul><li><a>x</a></ul></div><div class="post"><h1>Title</h1>{body}<div class="ad">Buy</div></div>{comments}<div role="contentinfo">legal words</div></div>',
    ):
        assert H.main_text(page) == want


def test_odd_pages(spark):
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p><nav>x</nav>") == ""
    assert H.main_text("just  text\n here &bogus; <b>x") == "just text here &bogus; x"
    assert H.main_text("<p>a<p>b</div></span><p>c") == "a\n\nb\n\nc"
    assert H.main_text("<div>" * 3000 + "deep") == "deep"
    rows = [(1, "u", "<p>x", "t"), (1, None, None, None), (None, "v", "<p>é😀</p>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [tuple(r) for r in H.extract(df).collect()] == [(1, "u", "x", 1), (1, None, "", 0), (None, "v", "é😀", 2)]
    assert H.extract(df.limit(0)).collect() == []


def test_smoothing_keeps_constants():
    assert np.allclose(H.smooth(np.full(9, 3.0)), 3.0)
    assert H.content_region(np.array([5.0, 300, 280, 310, 4]), np.array([9.0, 2, 2, 2, 9]))[1:4].all()


def stripped(page):
    """A page of the table without any element or class that names its parts."""
    for a, b in (("<article>", "<div>"), ("</article>", "</div>"), ('<div class="ad">', "<div>"), ("<nav>", "<div>"), ("</nav>", "</div>"), ("<footer>", "<div>"), ("</footer>", "</div>")):
        page = page.replace(a, b)
    return page


def test_ratios_alone_find_the_text(spark):
    """Without article, nav, footer or classes, the ratios decide; other widths and thresholds give other texts."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [article(p) for p in pages]
    plain = [stripped(p) for p in pages]
    right = lambda **kw: sum(H.main_text(p, **kw) == w for p, w in zip(plain, want, strict=True))
    assert right() >= 0.9 * len(pages)
    assert right(sigma=4.0) < 0.6 * len(pages) and right(level=0.2) < 0.8 * len(pages)
    no_article = [H.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>")) for p in pages]
    assert no_article == want


def test_single_words_of_names_do_not_decide():
    body = "<p>First paragraph with a good many words in it, and more.</p><p>Short.</p><p>Last long paragraph of the article with enough text inside it.</p>"
    want = "First paragraph with a good many words in it, and more.\n\nShort.\n\nLast long paragraph of the article with enough text inside it."
    assert H.main_text(f'<body><nav>x</nav><div class="search-engines-explained">{body}</div><footer>f</footer>') == want
    assert H.main_text(f"<body><header>Site</header><article><header><h1>Title</h1></header>{body}</article>") == "Title\n\n" + want
    legal = "These terms are a part of what is told here about the law, and are long."
    assert H.main_text(f'<article>{body}<div class="legal"><p>{legal}</p></div></article>') == want + "\n\n" + legal
    for junk in ('<div class="ad-slot">Buy</div>', '<div id="cookieNotice"><p>We use cookies</p></div>', '<ul class="site-menu"><li><a>x</a></ul>', "<ul>" + "<li><a>Home</a><li><a>News</a>" * 4 + "</ul>", '<div class="post-comments"><p>I do think that this is a long and winding comment of a reader.</p></div>', '<p>a <span class="ad">b</span></p>'):
        got = H.main_text(f"<body><article>{body}{junk}</article>")
        assert got == want + ("\n\na" if "span" in junk else "")


def test_very_long_pages():
    p = "<p>" + "A sentence of some words. " * 40 + "</p>"
    page = "<body><nav>" + "<a>x</a>" * 5000 + "</nav><div>" + p * 2000 + "</div></body>"
    got = H.main_text(page)
    assert got.count("\n\n") == 1999 and got.count("A sentence") == 80_000
    assert H.main_text("<p>" + "y" * 3_000_000) == "y" * 3_000_000
    assert H.main_text("</b></i>" * 100_000 + "<p>z" + "<i>" * 20_000) == "z"
