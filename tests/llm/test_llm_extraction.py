"""Main text of pages: planted layouts, recovery from broken markup, the whole pages table."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest

from lumenseek.llm import extraction
from lumenseek.llm.common import table

SF = "/root/testdata/sf0.01"
P = ["First paragraph, with a comma and more than a few words in it.", "Second one; it is about as long as the first was, really.",
     "Short."]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in P)
BODY = " ".join(P)
LONG = " ".join(P * 4)


def whole(body: str) -> str:
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


LAYOUTS = {
    "article": ("<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1>" + PARAGRAPHS + "</article><footer>c</footer>", "Title " + BODY),
    "divs": ("<div class=top>Site name</div><div id=content><h2>Head</h2>" + PARAGRAPHS + "<ul><li>item one</li><li>item two</li></ul></div><div class=right><p>Buy</p></div>",
             "Head " + BODY + " item one item two"),
    "plain body": ("<h1>Title</h1>" + PARAGRAPHS + "<div>tail</div>", "Title " + BODY),
    "comments": ("<div class=story>" + PARAGRAPHS + "</div><section id=comments><article class=comment><p>" + LONG + "</p></article></section>", BODY),
    "comment form": ("<main>" + PARAGRAPHS + "<form><label>Name</label><textarea>say</textarea></form><div class=respond>Leave a reply</div></main>", BODY),
    "notices": ("<div class='cookie-notice'>We use cookies, as all do, to serve you better. Accept, or go.</div><main><h1>A</h1>" + PARAGRAPHS + "</main>", "A " + BODY),
    "adverts inside": ("<article><p>" + P[0] + "</p><div class='ad-slot banner'>Buy, buy now!</div><aside>See also this.</aside><p>" + P[1] + "</p></article>", P[0] + " " + P[1]),
    "links menu": ("<div><ul><li><a>one</a></li><li><a>two</a></li></ul></div><div>" + PARAGRAPHS + "</div>", BODY),
    "words about": ("<div class='page has-sidebar'>" + PARAGRAPHS + "</div>", BODY),
    "label around the article": ("<form id=form1><div class=widget><article>" + PARAGRAPHS + "</article></div></form>", BODY),
    "script traps": ("<script>var t='</p><article>x';</script><article><p>a<script>if (a<b) '<p>'</script>b</p><noscript>no</noscript></article>", "ab"),
    "inline": ("<article><p>a<b>b</b> <i>c</i>d<br>e &amp;amp; &lt;i&gt; &eacute;&#233;&nbsp;x</p></article>", "ab cd e &amp; <i> éé x"),
    "split reference": ("<article><p>&am<b>p; x</b></p></article>", "&amp; x"),
    "hidden": ("<article><p>seen</p><p hidden>not</p><div style='display: none'>nor this</div></article>", "seen"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl></article>", "a b c d e"),
    "unclosed": ("<nav><ul><li><a>m</a><article><p><b>one<br><p>two<li>three</article><footer>f", "one two three"),
    "quotes": ("<article title='a > b' data-x=\"</article>\"><p class=\"x>y\">text</p></article>", "text"),
    "broken tag": ("<article><p class=\"x>text one</p><p>1 < 2 and a<b</p><p>end</article", None),
    "header in an article": ("<header>Site</header><article><header><h1>T</h1></header>" + PARAGRAPHS + "</article>", "T " + BODY),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    html, expected = LAYOUTS[name]
    for page in (whole(html), html):
        got = extraction.main_text(page)
        if expected is None:
            assert "<p" not in got and "article" not in got
        else:
            assert got == expected


def test_upper_case_tags_and_comments():
    assert extraction.main_text("<BODY><!-- <p>no</p> --><ARTICLE><P>a<!-->b--></P><!-- x") == "ab-->"


def test_nothing_to_find():
    for html in (None, "", " ", "<p></p>", "<nav>a</nav>", "<!-- only", "<script>x", "<", "<article", "</p></article>"):
        assert extraction.main_text(html) == ("<" if html == "<" else "")
    assert extraction.main_text("just text") == "just text"


def test_unquoted_ends_take_linear_time():
    import time
    def took(n):
        start = time.perf_counter()
        extraction.main_text("<p>" + "<a href=\"x" * n)
        extraction.main_text("<div>" * n + "x")
        extraction.main_text("<!-- " * n + "< " * n)
        return time.perf_counter() - start
    took(100)
    assert took(8000) < 40 * max(took(1000), 0.01)


def test_ratios_are_those_of_the_paths():
    path, chars, marks = np.array([1, 1, 2, 2, 1, 3]), np.array([90.0, 110, 2, 2, 100, 5]), np.array([3.0, 5, 0, 0, 4, 0])
    smooth = lambda v: [(0.15 * (v[i - 1] if i else 0) + 0.7 * v[i] + 0.15 * (v[i + 1] if i < len(v) - 1 else 0))
                        / (1 - 0.15 * (i == 0) - 0.15 * (i == len(v) - 1)) for i in range(len(v))]
    text = {1: 100.0, 2: 2.0, 3: 5.0}
    mark = {1: 4.0, 2: 0.0, 3: 0.0}
    fused = [a * (1 + b) for a, b in zip(smooth([text[p] for p in path]), smooth([mark[p] for p in path]))]
    score = {p: np.mean([f for f, q in zip(fused, path) if q == p]) for p in (1, 2, 3)}
    limit = min(np.std(fused), max(score.values()) / 4)
    assert extraction.content_paths(path, chars, marks).tolist() == [bool(score[p] >= limit) for p in path]


def test_whole_table(spark):
    """Pages of the test data have their text in the article element, with headings, paragraphs and line breaks."""
    pages = table(spark, SF, "pages")
    out = {r.page_id: r for r in extraction.op11_extraction(pages).collect()}
    for row in pages.collect():
        inner = re.search("<article>(.*?)(?:</article>|$)", row.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inner)]
        text = " ".join(b for b in blocks if b)
        assert (out[row.page_id].url, out[row.page_id].text, out[row.page_id].n_chars) == (row.url, text, len(text))


def test_edge_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<article>a \U0001f600</article>"), (3, "w", "<p>x " * 60_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "html AS text", "1 AS n_chars")
    out = extraction.op11_extraction(pages)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    found = sorted(((r.page_id or 0, r.n_chars) for r in out.collect()))
    assert found == [(0, 0), (1, 0), (1, 0), (2, 3), (3, 2 * 60_000 - 1)]
    assert extraction.op11_extraction(pages.limit(0)).count() == 0
