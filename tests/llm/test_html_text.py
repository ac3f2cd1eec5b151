import random

import pytest
from pyspark.sql import functions as F

from lotwise.llm import html_text

SCHEMA = "page_id long, url string, html string, site string, text string"


def texts(spark, pages):
    frame = spark.createDataFrame([(*p, "site", "text") for p in pages], SCHEMA)
    return {r.page_id: r for r in html_text.extract(frame).collect()}


@pytest.mark.parametrize(("page", "want"), [
    ("<article><h1>A &amp; B</h1><p>one\n  two&nbsp;three<p>four</article><footer>f</footer>", "A & B\n\none two three\n\nfour"),
    ("<body><nav>menu</nav><div class=\"main-ad ad\">buy</div><article><p><b>bold<br><p>x&ltY &#233;&#x1F600;</p></article></body>",
     "bold\n\nx<Y é😀"),
    ("<header>site</header><main><header><h1>T</h1></header><p>a <i>b</i>c</p><aside>no</aside><form>no<p>no</p></form></main>",
     "T\n\na bc"),
    ("<div><p>a</p><script>if (a<b) '</p>'</script><style>p{}</style><!-- c <p>no</p> --><p>b</p></div>", "a\n\nb"),
    ("<article><p>a</p><section id='comments'><p>c</p></section><div class=\"share\">s</div><ul><li>x<li>y</ul></article>", "a\n\nx\n\ny"),
    ("<p title='a > b'>t</p><p title=\"it's\">u</p><a href=x>v</a>", "t\n\nu\n\nv"),
    ("plain text only", "plain text only"), ("a < b <p>c", "a < b\n\nc"), ("<p>cut off <b", "cut off <b"), ("", ""), (None, ""),
    ("<article></article><p>a</p>", "a"), ("<script>never closed <p>a</p>", ""), ("<div>" * 3000 + "deep", "deep"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
])
def test_single_pages(spark, page, want):
    assert html_text.main_text(page or "", set()) == want


def test_site_tree_removes_what_pages_repeat(spark):
    """Boxes without telling names: the ones that repeat go, the ones that differ stay, whatever the site."""
    dice = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    pages = []
    for i in range(60):
        host = ["a.example", "b.example"][i % 3 == 0]
        text = [" ".join(dice.choice(words) for _ in range(20)) for _ in range(3)]
        body = f"<div class='xa'><p>{host} welcomes you</p><ul><li>one</li><li>two</li></ul></div><div class='xb'>" + "".join(
            f"<p>{t}</p>" for t in text) + f"</div><div class='xc n{i}'>Made by {host}</div>"
        pages.append((i, f"HTTPS://u@{host}:80/{i}", f"<html><body>{body}</body></html>", "\n\n".join(text)))
    got = texts(spark, [p[:3] for p in pages])
    for i, url, _, want in pages:
        assert (got[i].text, got[i].url, got[i].n_chars) == (want, url, len(want))


def test_few_pages_and_copies_lose_nothing(spark):
    article = "<body><article><p>the same article</p></article></body>"
    got = texts(spark, [(i, "http://c.example/", article) for i in range(40)] + [
        (100 + i, f"http://d{i}.example/", "<div><p>only page</p></div>") for i in range(3)] + [
        (200, None, None), (201, "no url", ""), (202, "", "<p>x</p>")])
    assert {got[i].text for i in range(40)} == {"the same article"}
    assert {got[100 + i].text for i in range(3)} == {"only page"}
    assert (got[200].text, got[200].n_chars, got[201].text, got[202].text) == ("", 0, "", "x")


def test_importance(spark):
    """Four pages: one text on all, one on two of them, and four of their own."""
    pages = [("h", f"<div><h2>all</h2><p>{'ab'[i // 2]}</p><p class='q'>{i}</p></div>") for i in range(4)]
    tree = html_text.style_tree(spark.createDataFrame(pages, "site string, html string"))
    found = sorted(round(r.importance, 6) for r in tree.where(F.col("limit") > 0).collect())
    # h2: 0; p: 1 - log_4 2; p.q: 1; div, all its pages alike: 0.1 * the mean
    assert found == [0.0, 0.05, 0.5, 1.0]


def test_empty(spark):
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_that_unnamed_siblings_repeat_go(spark):
    """Menu and notice share a node with the article or its cells; a notice in the article has no name either."""
    made = {
        "div": "<body><div>menu</div><div>text {0}</div><div>notice</div></body>",
        "cell": "<table><tr><td>menu<td>text {0}<td>notice</table>",
        "p": "<article><p>text {0}</p><p>notice</p></article>", "other": "<main><p>text {0}</p><div>notice</div></main>",
        "body": "<body>menu<div>text {0}</div><hr>notice {0}</body>",
    }
    pages = [(100 * n + i, f"http://{kind}.example/{i}", page.format(i)) for n, (kind, page) in enumerate(made.items()) for i in range(40)]
    got = texts(spark, pages)
    for i in range(40):
        assert [got[100 * n + i].text for n in range(5)] == [f"text {i}"] * 4 + [f"text {i}\n\nnotice {i}"]
