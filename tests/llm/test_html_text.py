import html as entities
import re

import pyarrow.parquet as pq

from lodestone.llm.html_text import extract, main_text


def test_articles_of_the_test_pages():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        body = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", body)
        clean = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert main_text(page) == "\n".join(b for b in clean if b)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and you should know it.</div>
<main><header><h1>Title &amp; more</h1></header><p>First   paragraph of&nbsp;text
 goes <b>on</b>.<p>Second<br>line &#233;&lt;tag&gt;</p><div id="ad-1">Buy now</div>
<blockquote>Quoted words</blockquote><!-- <p>hidden</p> --><ul><li>one<li>two</ul>
<section class="comments"><p>Great post, thanks a lot for it, really.</p></section></main>
<aside>Related things</aside><form>Name <input></form><footer>&copy; 2020</footer></body></html>"""


def test_variants():
    assert main_text(PAGE) == "Title & more\nFirst paragraph of text goes on.\nSecond line é<tag>\nQuoted words\none\ntwo"
    long = "A sentence that is long enough to be an article of its own kind. " * 3
    plain = f"<div><a href=x>Menu entry</a></div><div>{long}</div><div>short</div><div>{long}</div><div><a>Next page</a></div>"
    assert main_text(plain) == f"{long.strip()}\nshort\n{long.strip()}"
    assert main_text("just words & more") == "just words & more"
    assert main_text("<article><p>tiny</article>") == "tiny"
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<nav>a</nav>") == ""
    assert main_text("<p>a</p><script>never ends") == "a" and main_text('<p>x</p><a href="never') == "x"
    assert main_text("<p>1 < 2</p>") == "1 < 2"


def test_query(spark):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 1), (None, "v", "", 1), (3, "w", "<p>" + "word " * 200000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    out = {(r["page_id"], r["url"]): r for r in extract(pages).collect()}
    assert len(out) == 4 and out[(2, None)]["text"] == "" and out[(3, "w")]["n_chars"] == 999999
    assert extract(pages).count() == 5 and extract(pages.limit(0)).count() == 0
