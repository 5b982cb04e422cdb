import re
from html import unescape

from tidewatch.llm import html

PAGES = "page_id long, url string, html string, text string"


def text(page):
    return html.main_texts([page], html.model())[0]


def test_article_without_what_surrounds_it():
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><header class="masthead"><p>Site name</p></header>'
        '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-banner"><p>We use cookies, accept them all please.</p></div>'
        "<main><article><h1>A title</h1><p>First   <b>bold</b> &amp; more<br>line, with some words.</p>"
        '<div class="ad">Buy this now, it is cheap.</div><ul><li>point one of the list.</li></ul><script>var a="<p>no</p>";</script>'
        '<p>Last paragraph of the article, long enough.</p></article><section id="comments"><p>A reader said that this is nice, very nice.</p></section></main>'
        '<aside class="sidebar"><p>Related reading for you.</p></aside><form><label>Name</label><input></form><footer>&copy; 2024</footer></body></html>'
    )
    assert text(page) == "A title\nFirst bold & more line, with some words.\npoint one of the list.\nLast paragraph of the article, long enough."


def test_whole_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html.op2_html(spark, sf).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1).replace("<br>", " ")
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inner))
        want = "\n".join(p for p in parts if p)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "", "", "x"), (3, "u", "no markup at all", "x"), (4, "u", "<p>cut <b", "x"), (5, "u", "<<>>&&amp;&#x41;<p", "x"), (None, "u", "<article><p>" + "word " * 50_000, "x"), (5, "u", "</div></p><li>", "x")]
    got = html.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 7 and all(r.text is not None for r in got)
    assert {r.page_id: len(r.text) for r in got}[None] == 5 * 50_000 - 1
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_held_out_layouts():
    chain, right, total = html.model(), 0, 0
    for page in html.training_pages(seed=123, count=150):
        rows = html.features([(t, b) for t, b, _ in page])
        labels = chain.viterbi(chain.scores([chain.numbers(list(r)) for r in rows]), html.np.array([len(page)]))
        right += sum(html.LABELS[n] == y for n, (_, _, y) in zip(labels, page, strict=True))
        total += len(page)
    assert right > 0.98 * total


def test_head_without_an_end_and_closed_drawings_keep_the_article():
    body = "<article><h1>A title</h1><p>First line, with some more words in it.</p>{}<p>Last paragraph of the article, long enough.</p></article>"
    want = "A title\nFirst line, with some more words in it.\nLast paragraph of the article, long enough."
    assert text(f"<html><head><title>t</title><meta charset=utf-8><body>{body.format('')}</body></html>") == want
    assert text(f"<html><head><style>p{{}}</style><template><p>no</p></template>\n{body.format('')}</html>") == want
    for drawing in ('<svg class="icon" />', "<math/>", "<svg><title/><path d='x'/></svg>", "<svg><style/>x</svg>"):
        assert text(f"<html><head></head><body>{body.format(drawing)}</body></html>") == want
    found = lambda page: [t for t, _ in html.blocks(page)]
    assert found("<p><svg/>a<p>b") == ["a", "b"] and found("<p><svg>x<p>b<p>c") == ["b", "c"]
    assert found("<div><p>a<template>x<p>y</p></template>z<p>b</div>c") == ["a", "z", "b", "c"]
    assert found("<head><title>t</title>a<p>b") == ["a", "b"] and found("<head><link rel=x> <!-- c --> </head>a") == ["a"]


def test_quotes_count_after_an_equals_sign_only():
    found = lambda page: [t for t, _ in html.blocks(page)]
    assert found("<p class=it's>Hello there, it's fine</p>") == ["Hello there, it's fine"]
    assert found("<p title=O'Brien>First</p><p>Second, it's late</p>") == ["First", "Second, it's late"]
    assert found('<p title="a > b">x</p><p title = \'c > d\'>y') == ["x", "y"]
    assert found('<p>x</p><p title="no end>y</p><p>z</p>') == ["x", "y", "z"]


def test_long_broken_markup_takes_time_in_proportion():
    import time

    for piece, tail in (("<a", ""), ("<a", ">x"), ('<p a="', ""), ('<p a="', ">x"), ("x i<n ", ""), ("<!x ", ""), ("""<p a='">""", "'"), ("< ", "")):
        page = piece * (1_000_000 // len(piece)) + tail
        start = time.perf_counter()
        html.blocks(page)
        assert time.perf_counter() - start < 10, piece
