"""op11: the article of the sample pages by a plain pattern, and pages of other make."""

import html
import re

import pytest
from pyspark.sql import functions as F

from stayline.llm import articles
from stayline.llm.queries import REGISTRY


def plain_text(page):
    """What stands in the sample pages' one article element, cut at paragraphs and headings."""
    inside = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = [re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p) for p in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_query_against_plain_pattern(spark):
    folder = "/root/testdata/sf0.1"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    out = REGISTRY["op11_articles"](spark, folder).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == plain_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


TEXT = "Long sentences of an article, with commas, and with many words in a row so that it is dense."
OTHERS = {
    "": "",
    "no markup &amp; two\n lines": "no markup & two lines",
    f"<body><div class='sidebar'>{TEXT}</div><div><p>{TEXT}</p><p>Sh&nbsp;is.</p></div>": f"{TEXT}\nSh is.",
    f"<div><p>{TEXT}</p><p>two</p></div><div id=comments><p>{TEXT}</p><p>{TEXT}</p></div>": f"{TEXT}\ntwo",
    f"<main><section><p>{TEXT}</p><p>{TEXT}</p></section><section><p>{TEXT}</p><p>b</p></section></main>": f"{TEXT}\n{TEXT}\n{TEXT}\nb",
    f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{TEXT}</p></article>": f"Title\n{TEXT}",
    f"<nav><a href=x>menu</a><article><p>{TEXT}</article>": TEXT,
    f"<form action=all><div><p>{TEXT}</p><p>{TEXT}</p></div><select><option>a</select></form>": f"{TEXT}\n{TEXT}",
    f"<p>{TEXT}</p><form><p>Mail</p><button>Send</button></form><p>{TEXT}</p>": f"{TEXT}\n{TEXT}",
    f"<article><p>{TEXT}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>": TEXT,
    f"<article><p>{TEXT}</p><ul><li>one<li>two</ul><div hidden>x</div><div style='display: none'>y</div></article>": f"{TEXT}\none\ntwo",
    f"<article><p>{TEXT} 1 < 2 <b>bo</b>ld<!-- <p> --></p><script>'<p>no</p>'</script><style>p</style></article>": f"{TEXT} 1 < 2 bold",
    "<nav><a href=1>only</a> <a href=2>menus</a></nav><footer>end</footer>": "",
    f"<table><tr><td>{TEXT}<td>b<tr><td>menu</table>": f"{TEXT}\nb",
    "<script>never closed <p>a</p>": "",
    "<a href=\"never closed>text</a><p>": "text",
    "<!-- never closed": "",
    "&#xD800;&#65;&unknown;": "�A&unknown;",
}


@pytest.mark.parametrize("page", OTHERS)
def test_other_pages(page):
    assert articles.main_text(page) == OTHERS[page]


def test_deep_and_long_pages():
    assert articles.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    paragraphs = [f"{TEXT} {i}" for i in range(20_000)]
    page = "<article>" + "".join(f"<p>{p}" for p in paragraphs) + "</article>"
    assert articles.main_text(page) == "\n".join(paragraphs)


def test_density_of_a_small_tree():
    """Figures of the formula by hand: two links of three letters beside a paragraph of ten letters."""
    nodes = articles.parse("<div><p>abcdefghij</p><p><a>abc</a><a>abc</a></p></div>")
    articles.weigh(nodes)
    root, div, text, links = nodes
    assert [(n.chars, n.tags, n.link_chars, n.link_tags) for n in nodes] == [(16, 5, 6, 2), (16, 4, 6, 2), (10, 0, 0, 0), (6, 2, 6, 2)]
    from math import e, log

    r = 6 / 16
    assert text.density == pytest.approx(10 * log(10) / log(log(r * 10 + e)))
    assert links.density == 0
    assert div.density == pytest.approx(4 * log(16 / 6 * 4 / 2) / log(log(16 / 10 * 6 + r * 16 + e)))
    assert div.total == text.density + links.density and root.total == div.density
    assert articles.chosen(nodes) == [div]


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", ""), (3, "w", " ")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted(map(str, (tuple(r) for r in articles.page_texts(pages).collect())))
    assert out == sorted(map(str, [(1, "u", "a", 1)] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", "", 0)]))
    assert articles.page_texts(pages.limit(0)).count() == 0
    clash = pages.withColumn("text", F.lit("t")).withColumn("a.b", F.lit(1))
    assert articles.main_texts(clash).columns == ["page_id", "url", "html", "text", "a.b", "_text"]
    assert articles.page_texts(clash).count() == 5
