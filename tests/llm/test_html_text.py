import html
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kurzwerk.llm import html_text as H

LONG = "This paragraph is long enough to be a surge of text in any window of lines around it."

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=a>Home</a></li></ul></nav>
<header><p>Site of all sites with a long slogan that goes on and on for ever</p></header>
<article><header><h1>Head &amp; line</h1></header><p class="x">First <b>para</b>graph&nbsp;here,
 with more.<p>To.<p>Last one<br>goes on <script>var t="</p>"</script>&#65;&lt;b&gt;
<div class="advert">Buy it now, buy it cheap, buy it all the time</div>
<section id='comments'><p>A reader thinks that this article is very good indeed</p></section></article>
<aside><p>Aside text that is long enough to look like a paragraph of text</p></aside><footer>(c)</footer>"""

SOUP = """<div id="top-menu"><a href=a>Home</a></div><ul><li><a>One</a><li><a>Two</a><li><a>Three</a><li><a>Four</a></ul>
<div class=content><h2>Title here</h2><p>A long paragraph with enough text to be seen as main text of it all.
<p>Short.<p>Another long paragraph with enough text to be seen, <a href="x>y">a link</a> too.</div>
<div><a>x</a></div><div><a>y</a></div><div><a>z</a></div><form>Your name <input> please and thank you very much</form>"""


def test_named_article():
    assert H.main_text(PAGE) == "Head & line\nFirst paragraph here, with more.\nTo.\nLast one goes on A<b>"


def test_page_without_names():
    want = ["Title here", "A long paragraph with enough text to be seen as main text of it all.", "Short.",
            "Another long paragraph with enough text to be seen, a link too."]
    assert H.main_text(SOUP) == "\n".join(want)


def test_teaser_article_beside_the_text():
    page = f"<div class=content><p>{LONG}<p>{LONG}<p>{LONG}</div><article><a href=x>Next one</a></article>"
    assert H.main_text(page) == "\n".join([LONG] * 3)


def test_wrappers_whose_class_names_what_they_hold():
    inner = f"<article><h1>Head</h1><p>{LONG}</p></article><div class=sidebar><p>{LONG}</p></div>"
    want = f"Head\n{LONG}"
    assert H.main_text(f'<div class="layout has-sidebar">{inner}</div>') == want
    assert H.main_text(f'<div class="ad-free"><div class="has-comments">{inner}</div></div>') == want
    assert H.main_text(f'<article class="post-with-comments"><p>{LONG}</p></article>') == LONG
    assert H.main_text(f"<form action=x>{inner}</form>") == want
    comments = f"<div class=comments>{f'<p>{LONG}</p>' * 9}</div>"
    assert H.main_text(f"<div class=has-sidebar>{inner}{comments}</div>") == want
    related = f"<div class=related><article><p>{LONG}</p></article></div>"
    assert H.main_text(f"<div class=with-related><article><p>{LONG}<p>{LONG}</article>{related}</div>") == f"{LONG}\n{LONG}"


def test_linked_headline_and_last_paragraph():
    for tag in ("article", "div"):
        page = f"<{tag}><h1><a href=x>Head</a></h1><p>{LONG}</p><p><a href=y>Read on</a></p></{tag}>"
        assert H.main_text(page) == f"Head\n{LONG}\nRead on"


def test_text_outside_of_the_article_element_has_to_surge():
    long = " ".join([LONG] * 9)
    page = f"<div>Short one outside</div><article>{f'<p>{long}</p>' * 3}</article><div>{long}</div>"
    assert H.main_text(page) == "\n".join([long] * 4)


def test_unmatched_tags_take_linear_time():
    for page in ("<b>" * 20_000 + "</i>" * 20_000, "<p><td>" + "<b>" * 20_000 + "<pre></pre>" * 20_000):
        begun = time.perf_counter()
        assert H.main_text(page) == ""
        assert time.perf_counter() - begun < 1


def stretches(weights):
    """The rule read literally, line by line and window by window."""
    n, w = len(weights), H.WINDOW_LINES
    window = {s: sum(weights[max(s, 0) : s + w]) for s in range(1 - w, n)}
    least = max(1, min(H.SURGE_CHARS, H.SURGE_SHARE * max(window.values(), default=0)))
    dive = [any(window[s] == 0 for s in range(k - w + 1, k + 1) if 0 <= s <= n - w) for k in range(n)]
    keep, k = [False] * n, 0
    while k < n:
        end = k
        while end < n and not dive[end]:
            end += 1
        text = [i for i in range(k, end) if weights[i]]
        if text and any(window[s] >= least for i in text for s in range(i - w + 1, i + 1)):
            keep[text[0] : text[-1] + 1] = [True] * (text[-1] + 1 - text[0])
        k = max(end, k + 1)
    return keep


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.just(0), st.integers(0, 90), st.integers(0, 2000)), max_size=40))
def test_stretches_follow_the_rule(weights):
    assert H.chosen(np.array(weights, np.int64)).tolist() == stretches(weights)


def test_torn_and_empty_pages():
    assert [H.main_text(p) for p in (None, "", "<p>", "<!-- x", "<p>a<p", "a < b<br>c")] == ["", "", "", "", "a", "a < b c"]
    assert H.main_text("<article><p>one<p>two") == "one\ntwo"
    assert len(H.main_text("<p>" + "word " * 400_000)) == 5 * 400_000 - 1


def test_pages_of_the_table_equal_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumnRenamed("url", "url")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1)>|<br>", inner)]
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_edge_rows(spark):
    rows = [(1, None, None, 0), (None, "u", "<p>x</p>", 0), (2, "u", "", 0), (2, "u", "", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    assert sorted(r.text for r in H.extract(df).collect()) == ["", "", "", "x"]
    assert H.extract(df.limit(0)).collect() == []
