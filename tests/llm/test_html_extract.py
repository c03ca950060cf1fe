import html
import re
import time

import pyarrow.parquet as pq

from tessera.llm import html_extract as h
from tessera.llm import queries


def article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("<p>|</p>|<h1>|</h1>", inside)]
    return "\n".join(b for b in blocks if b)


def test_query(spark):
    want = {r["page_id"]: r for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()}
    got = queries.op10_html(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == article(want[r.page_id]["html"]) and r.n_chars == len(r.text) and r.url == want[r.page_id]["url"]


def test_marginals_are_those_of_all_labellings():
    m = h.model()
    root = h.parse('<div class="post"><p>some words here<a href="x">link</a></p><aside>other</aside></div><nav><a>x</a></nav>')
    order, got = m.marginals(root)
    place = {id(e): i for i, e in enumerate(order)}
    own = [(1.0, 2.718281828459045 ** max(-30, min(30, sum(m.feature.get(f, 0) for f in fs)))) for fs in h._features(order)]
    total, ones = 0.0, [0.0] * len(order)
    for mask in range(1 << len(order)):
        y = [mask >> i & 1 for i in range(len(order))]
        w = 1.0 if mask else h.EMPTY
        for i, e in enumerate(order):
            w *= own[i][y[i]] * (m.pair[y[place[id(e.parent)]]][y[i]] if i else 1)
        total += w
        for i, v in enumerate(y):
            ones[i] += w * v
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(got, ones, strict=True))


def test_labelled_pages_held_out():
    m, hit, total = h.model(), 0, 0
    for page, bare in h.training_pages(100, 99):
        order, share = m.marginals(h.parse(page))
        labels, hard = {}, h._hard(order)
        for e, s in zip(order, share, strict=True):
            y = int(e.label == "1") if e.label else labels[id(e.parent)] if e.parent is not None else int(bare)
            labels[id(e)] = y = 0 if id(e) in hard else y
            total += e.chars
            hit += e.chars * ((s >= h.CONTENT) == bool(y))
    assert hit / total > 0.9


def test_parts_of_a_page():
    page = (
        '<html><body><header class="site-header"><h1>Site</h1></header><nav class=menu><ul><li><a href=/>Home</a></ul></nav>'
        '<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First  <i>para</i>\n graph.<p>Second<script>x</script> one'
        '<form class="subscribe-form"><input><button>Go</button></form><p>Third &lt;3</p></article>'
        '<section class="comments"><h3>Comments</h3><p>Nice post</p></section><aside class="sidebar"><p>Other posts</p></aside><footer>&copy; me</footer></body></html>'
    )
    assert h.model().text(page) == "A & B\nFirst para graph.\nSecond one\nThird <3"


PARAGRAPH = "<p>The council met on Tuesday to discuss the budget for the coming year and agreed on several points.</p>"


def test_forms_comments_and_unread_markup_stay_out():
    inside = [
        '<noscript><img src="x"><p>no <b>js</b></p></noscript>',
        "<form><p>Sign up for our letters today</p><input><button>Go</button></form>",
        '<section class="story-comments"><h3>Comments</h3><p>I do not agree with this at all.</p><p>Nor do I, my friend.</p></section>',
        '<div class="article-sidebar"><p>Read also this and that</p></div>',
        "<select><option>one<option>two</select>",
    ]
    for x in inside:
        page = f"<html><body><nav><a href=/>Home</a></nav><article class='story'><h1>Title</h1>{PARAGRAPH * 3}{x}{PARAGRAPH * 2}</article><footer>&copy; x</footer></body></html>"
        assert h.model().text(page).split("\n") == ["Title", *[PARAGRAPH[3:-4]] * 5], x


def test_pages_without_wrapper_keep_their_text():
    text, own = h.model().text, PARAGRAPH[3:-4]
    assert text("<body>text one here<br>text two here</body>") == "text one here text two here"
    assert text("<p>only a paragraph of text</p>") == "only a paragraph of text" and text("plain text only") == "plain text only"
    assert text(f"<html><body>{PARAGRAPH * 3}</body></html>") == "\n".join([own] * 3) == text(f"<div>{PARAGRAPH * 3}</div>")
    assert text(f"<html><body><form id=aspnet><div class='article'><h1>T</h1>{PARAGRAPH * 3}</div></form></body></html>") == "\n".join(["T", *[own] * 3])


def test_short_pages_keep_their_text_and_others_have_none():
    text, own = h.model().text, PARAGRAPH[3:-4]
    for n in (1, 2, 3):
        assert text(f"<div>{PARAGRAPH * n}</div>") == text(f"<html><body><div>{PARAGRAPH * n}</div></body></html>") == "\n".join([own] * n)
    assert text(f"<body><div><a href=/>Home</a> <a href=/>News</a></div><div>{PARAGRAPH * 2}</div></body>") == "\n".join([own] * 2)
    for page in ("<nav><ul><li><a href=/>Home</a><li><a href=/>About</a></ul></nav><footer>&copy; 2020 Someone</footer>", "<div class=cookie-notice>We use cookies on this site to make it work well for you</div>", "<form><p>Sign in please</p><input></form>"):
        assert text(f"<html><body>{page}</body></html>") == ""


def test_time_is_linear_in_depth():
    began = time.process_time()
    h.model().text("<i>" * 8000 + "<p>x</p>" * 8000 + "<div><li><td>" * 3000)
    assert time.process_time() - began < 2


def test_edges(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    pages = [None, "", "plain", "<", "<article><p>cut <b>off", "<article><!-- x", "<article><p>a</p></nav></p><p>b &am", "<script>", "</p></div>", deep, "<article><p>" + "word " * 40_000 + "</p></article>", "<p" * 5000, "<![CDATA[x]]><article><p>y</p></article>", "<article><p title=\"a>b\">q</p></article>"]
    df = spark.createDataFrame([(i, p, "t", 3) for i, p in enumerate(pages)], "page_id long, html string, text string, n_chars int")
    got = {r.page_id: r.text for r in h.extract(df, ["page_id"]).collect()}
    assert len(got) == len(pages) and got[0] == got[1] == ""
    assert h.extract(df, ["page_id", "text", "n_chars"]).columns == ["page_id", "text", "n_chars"]
    assert got[4] == "cut off" and got[6] == "a\nb &am" and got[10] == ("word " * 40_000).strip() and got[12] == "y" and got[13] == "q"
    assert h.extract(df.where("false"), ["page_id"]).count() == 0
