import html
import re

import pytest

from consensa.llm import html_extract as h

CASES = [
    (None, ""), ("", ""), ("   ", ""), ("text only", "text only"), ("<p>a<p>b", "a\nb"), ("<p></p>", ""),
    ("<div><div class=sidebar>x y z</div><div id=content><p>Hello &amp; good <b>bye</b> you</p><p>more words</p></div></div>",
     "Hello & good bye you\nmore words"),
    ("<body><header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>Text a b.</p>"
     "<section class='comments'><p>nice</p></section></main><aside>zz</aside></body>", "Title\nText a b."),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>x &nbsp; y &lt;z&gt; &#39;", "x y <z> '"),
    ("<article><p>one</p><form>f</form><p>two", "one\ntwo"), ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut<b", "cut"), ("<article><p>a<!-- <p>no --></p><script>var t='</p>';</script><p>b</p></article>", "a\nb"),
    ("<article><p><b>one\n two<br><p>three</p></article><footer>x</footer>", "one two\nthree"),
    ("<nav><ul><li>a<li>b</ul></nav><article><p>t</p></article>", "t"),
    ("<div class='cookie-banner'>c</div><article><div class='share'>s</div><p>t</p></article>", "t"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert h.main_text(page) == text


LONG = "<h1>Title</h1><p>" + "Plain words of the article, one after the other. " * 6 + "</p><p>The end of it.</p>"
BESIDE = "<div class='site-footer'><a href=x>Imprint</a></div><div class=sidebar><p>Older posts here</p></div>"


@pytest.mark.parametrize("name", ["content has-sidebar", "post comments-open", "layout-with-nav", "related-articles-enabled",
                                  "content-widget", "story social-enabled", "contentWidget", "widget"])
def test_marked_wrapper_keeps_the_article(name):
    want = h.main_text(f"<body><div>{LONG}</div></body>")
    assert want.startswith("Title\nPlain words") and want.endswith("The end of it.")
    beside = BESIDE if name != "widget" else ""
    assert h.main_text(f"<body><div class='{name}'>{LONG}</div>{beside}</body>") == want
    assert h.main_text(f"<body><form action=x><div class='{name}'>{LONG}</div>{beside}</form></body>") == want


def test_marked_parts_go_where_density_agrees():
    want = h.main_text(f"<body><div>{LONG}</div></body>")
    for part in ("<div class=comments><p>" + "Long comment. " * 99 + "</p></div>", "<form><p>Your name</p></form>",
                 "<div class='related-posts'>" + "<a href=x>Another long headline of the site</a> " * 30 + "</div>"):
        assert h.main_text(f"<body><div>{LONG}</div>{part}</body>") == want


def test_deep_page_without_recursion():
    assert h.main_text("<div>" * 20_000 + "<p>deep text</p>") == "deep text"


def expected(page):
    """The article of the synthetic pages, by their known layout."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    body = re.sub(r"<[^>]*\Z", "", re.sub(r"<!--.*?-->", "", m[1], flags=re.S)) if m else ""
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body))
    return "\n".join(x for x in parts if x)


def test_query_against_the_known_layout(spark):
    page = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = h.q_html_extract(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(page)
    for r in rows:
        assert r.text == expected(page[r.page_id].html) and r.n_chars == len(r.text) and r.url == page[r.page_id].url


def test_table_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>a", None)], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in h.extract(df).collect()) == [(0, "a"), (1, ""), (1, "")]
    assert h.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
