from leafmill.operators import extract as x
from leafmill.operators.dom import parse

PAGE = """<html><head><title> A  Story </title><link rel="canonical" href="https://a.example/x"><meta property="og:image" content="i.png">
<script type="application/ld+json">{"@graph": [{"datePublished": "2024-01-02"}]}</script></head><body><nav>Menu</nav>
<article><h1>A Story</h1><p class="byline">By B</p><div class="pull-quote">Quoted</div><p onclick="x()">""" + "Words " * 130 + """<a href="/rel" style="x">link</a></p>
<img srcset="s.png 100w, l.png 800w"><img src="data:x"><p> </p><script>bad()</script><p><span itemprop="caption">Cap</span></p></article><footer>Foot</footer></body></html>"""


def test_attempt():
    a = x.attempt(PAGE, "https://www.a.example/dir/p")
    assert a["ok"] and a["title"] == "A Story" and a["site_name"] == "a.example" and a["published_at"] == "2024-01-02" and a["canonical_url"] == "https://a.example/x"
    html = a["content_html"]
    assert "Menu" not in a["text_content"] and "Foot" not in a["text_content"] and "bad()" not in html and "onclick" not in html and "style" not in html
    assert 'href="https://www.a.example/rel"' in html and "l.png" in html and "data:x" not in html
    assert '<blockquote class="pullquote">Quoted</blockquote>' in html and "speech-info" in html and "speech-caption" in html


def test_short_and_empty_pages():
    assert x.attempt("<p>few words</p>", "https://a.example")["reason"] == "too short"
    assert x.attempt("", "https://a.example")["ok"] is False
    assert x.attempt("<article><p>Already a subscriber? " + "w " * 200 + "</p></article>", "u")["reason"] == "already a subscriber"


def test_article_rows_with_nulls(spark):
    rows = x.article_rows(spark.createDataFrame([("https://a.example", None), (None, "<p>x")], "url string, html string")).collect()
    assert [r["ok"] for r in rows] == [False, False]


def test_unclosed_tags_nest():
    root = parse("<ul><li>a<li>b</ul><p>c<p>d<table><tr><td>1<td>2<tr><td>3</table>")
    assert [n.text() for n in root.find("li")] == ["a", "b"] and [n.text() for n in root.find("td")] == ["1", "2", "3"] and len(list(root.find("p"))) == 2


def test_largest_source_is_stable():
    assert x.largest_source("a 1x, b 2x, c 2x") == "b" and x.largest_source("") is None
    assert x.trimmed("<p>a</p><div><p>b</p></div>", {1, 2}) == "<p>a</p>"
