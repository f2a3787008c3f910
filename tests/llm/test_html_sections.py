"""Sections of an article whose names look like markup's: kept, unless the host's suffix array finds them repeated."""

from __future__ import annotations

import pytest

from verdance.llm import html

PAGE = "<html><body><nav>Menu</nav><article><h1>Title of {0}</h1><p>First of {0}.</p>{1}<p>Last of {0}.</p></article><footer>Foot</footer></body></html>"
KEPT = [
    '<section id="market-share"><h2>Inside</h2><p>words {0}.</p></section>', '<h2 id="advertising-in-1920">Inside</h2><p>words {0}.</p>', '<section id="ad-1066"><h2>Inside</h2><p>words {0}.</p></section>',
    '<section id="cookies"><h2>Inside</h2><p>words {0}.</p></section>', '<section class="search"><h2>Inside</h2><p>words {0}.</p></section>', '<section class="reply"><h2>Inside</h2><p>words {0}.</p></section>',
    '<section id="banner"><h2>Inside</h2><p>words {0}.</p></section>', '<h2>Inside<svg class="i"/></h2><p>words {0}.</p>', "<h2>Inside</h2><p>words <math><mi>{0}</mi><annotation>TeX</annotation></math>.</p>",
]
GONE = [
    "<div class=commentlist><p>Gone {0}</p></div>", '<div id="comments"><p>Gone {0}</p></div>', '<div class="notice"><p>Gone {0}</p></div>', "<svg><text>Gone {0}</text></svg>", '<div class="ad"><p>Gone {0}</p></div>',
    '<div id="sidebar"><p>Gone {0}</p></div>', '<section class="related-posts"><p>Gone {0}</p></section>', '<section class="comments"><article class="comment"><p>Gone {0}</p></article></section>', '<section class="advert"><p>Gone {0}</p></section>',
]


@pytest.mark.parametrize("part", KEPT)
def test_named_sections_stay(part):
    assert html.joined(html.blocks(PAGE.format("x", part.format("y")))).split("\n") == ["Title of x", "First of x.", "Inside", "words y.", "Last of x."]


@pytest.mark.parametrize("part", GONE)
def test_what_is_not_the_article_goes(part):
    assert html.joined(html.blocks(PAGE.format("x", part.format("y")))).split("\n") == ["Title of x", "First of x.", "Last of x."]


def test_the_array_decides_doubtful_sections(spark):
    """A section that only may be a notice goes where its run stands on three pages of the host, and stays where it is the page's own."""
    same, own = "accept all of our terms before you read any further here today", "banners {0} of crusaders {0} stood over {0} towns until year {0} ended"
    rows = [(k, f"http://h/{k}", PAGE.format(k, f'<section id="banner"><p>{same}</p></section><section id="ad-1066"><p>{own.format(k)}</p></section>')) for k in range(3)]
    rows.append((9, "http://other/9", PAGE.format(9, f'<section id="banner"><p>{same}</p></section>')))
    got = {r.page_id: r.text.split("\n") for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(3):
        assert got[k] == [f"Title of {k}", f"First of {k}.", own.format(k), f"Last of {k}."]
    assert got[9] == ["Title of 9", "First of 9.", same, "Last of 9."]
