"""Block rules on pages that do not say where their article is."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marklane.llm import html
from marklane.llm.entry import QUERIES

SF = "/root/testdata/sf0.01"
SECTIONS = "article|main|nav|footer|aside|header|section|form|menu|dialog|fieldset"


def divs(page):
    return re.sub(rf"<(/?)({SECTIONS})\b", r"<\1div", page)


def test_first_pass_decides_on_pages_of_divs(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    articles = [html.main_text(p) for p in pages]
    right = [html.main_text(divs(p)) == a for p, a in zip(pages, articles, strict=True)]
    assert sum(right) >= 0.6 * len(pages)
    monkeypatch.setattr(html, "alone", lambda b, stops: "bad" if b.barred else "good")
    idle = [html.main_text(divs(p)) == a for p, a in zip(pages, articles, strict=True)]
    assert sum(r and not i for r, i in zip(right, idle, strict=True)) >= 0.1 * len(pages)


def test_menus_and_footers_in_plain_divs_vanish():
    text = "It was the end of the day, and they had not been on the road for more than an hour when the rain came over the hills. " * 3
    menu = "<div><ul><li><a href=/a>Home and garden</a></li><li><a href=/b>All of the news</a></li></ul></div>"
    page = f"<body>{menu}<div><h1>The road</h1><p>{text}</p><p>So it was.</p><p>{text}</p></div><div>© site.example · All that is on this site is for the members of it.</div><div>Back to the top</div></body>"
    assert html.main_text(page).split("\n") == ["The road", text.strip(), "So it was.", text.strip()]


def test_edges_do_not_cut_a_marked_article():
    text = "It was the end of the day, and they had not been on the road for more than an hour when the rain came over the hills. " * 3
    page = f"<article><p>Alone</p><p>© said the sign</p><p>{text}</p><p>The end</p></article>"
    assert html.main_text(page).split("\n") == ["Alone", "© said the sign", text.strip(), "The end"]


def test_query_op2_reads_every_article(spark):
    """The query's rows against the text of the article element, blocks joined by line breaks."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = QUERIES["op2_block_rules"](spark, SF).orderBy(F.col("page_id")).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<(article|main)\b[^>]*>(.*)</\1>", pages[r["page_id"]]["html"], re.S)
        words = lambda t: re.sub(r"\W+", "", t)
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert words(r["text"]) in words(html.unescaped(re.sub(r"<[^>]*>", "", inner[2])))
