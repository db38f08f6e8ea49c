import pytest

from seglattice.sources.html import page_text, visible_text

PAGES = {
    "": "",
    "plain  text": "plain text",
    "<p>a</p><p>b": "a\nb",
    "x<br>y<BR/>z": "x\ny\nz",
    "<H2 class='k'>Head</H2>tail": "Head\ntail",
    "<b>bo</b>ld <i>it</i>alic": "bold italic",
    "<pre>kept</pre><param>": "kept",  # names that only begin like a block's
    "a<script>x < y; '</p>'</script>b": "ab",
    "a<noscript>n <style>p{}</style> m</noscript>b": "ab",
    "a<style>never closed <p>b": "a",
    "a</script></style>b": "ab",
    "a<!-- <p> --b>c --><!---->d": "ad",
    "a<!-- open <p>b": "a",
    "1 &lt; 2 &amp;amp; &#233;&eacute; &copy;": "1 < 2 &amp; éé ©",
    "&lt;p&gt;no tag": "<p>no tag",
    "1 < 2 <3": "1 < 2 <3",
    "cut <a href='x": "cut",
    "<tr><td>a</td><td>b</td></tr><tr><td>\t \n</td></tr><li>c  d": "ab\nc d",
    "l1\r\nl2\n\n\n l3 ": "l1\nl2\nl3",
}


@pytest.mark.parametrize("html", PAGES)
def test_visible_text(html):
    assert visible_text(html) == PAGES[html]


def test_column(spark):
    rows = [(h,) for h in PAGES] + [(None,), ("<p>" * 50_000 + "<!--" * 50_000,), ("<p " * 50_000 + "<script " * 50_000 + ">",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").coalesce(1).select(page_text("h")).collect()]
    assert got == [*PAGES.values(), None, "", ("<p " * 50_000 + "<script " * 49_998).strip()]
