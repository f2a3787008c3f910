from __future__ import annotations

import numpy as np

from verdance.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">Cookies</div>
<article><header><h1>Title&nbsp; here</h1></header><p>First <b>bo</b>ld
 line &lt;3<br>after<p>unclosed <span class="ad">buy</span> text<form><input value="a>b">Name</form><aside>side</aside><div class="comments"><p>nice</p></div></article>
<footer>&copy; me</footer>"""


def test_declared_article():
    assert html.joined(html.blocks(PAGE)) == "Title here\nFirst bold line <3\nafter\nunclosed text"


def test_markup_traps():
    assert html.joined(html.blocks("<article><p>a<script>if (1<2) '</article>'")) == "a"
    assert html.joined(html.blocks("<main><p title='x>y'>a</p></main><p>b</p>")) == "a"
    assert html.joined(html.blocks("<div role=main><p>a &eacute;&#233;&#x1F642; 1 < 2</p></div>")) == "a éé🙂 1 < 2"
    assert html.joined(html.blocks("</div></p>plain <i>te</i>xt")) == "plain text"
    assert html.joined(html.blocks("<p>a</p><div class='ad'><div>b</div></div><p>c")) == "a\nc"
    assert html.blocks("") == [] and html.blocks("<p></p>  ") == []


def test_repeats_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        pages = [rng.integers(1, 4, rng.integers(0, 40)) * 2 + 1 for _ in range(5)]
        stream = np.concatenate([np.append(p, 1000 + 2 * k) for k, p in enumerate(pages)])
        page = np.repeat(np.arange(5), [len(p) + 1 for p in pages])
        got = html.repeated(stream.astype(np.uint64), page, 4, 3)
        grams: dict = {}
        for i in range(len(stream) - 3):
            grams.setdefault(tuple(stream[i : i + 4]), []).append(i)
        want = np.zeros(len(stream), bool)
        for at in grams.values():
            if len({page[i] for i in at}) >= 3:
                for i in at:
                    want[i : i + 4] = True
        assert (got == want).all()


def test_host_repeats_go_and_unique_runs_stay(spark):
    rows = []
    for k in range(12):
        body = f"<div>Home</div><div>About us all</div><div>Contact the team of this place</div><div>Terms</div><p>Story {k} tells of number {k * 7} and {k * 13} more</p><div>All rights reserved by the owners of this fine place for ever</div>"
        rows.append((k, f"http://h.example/{k}", body))
    rows += [(50, "http://other.example/", "<div>Home</div><p>Alone</p>"), (51, None, "<p>x</p>"), (52, "http://h.example/a", None), (53, "odd url", ""), (54, "http://h.example/b", PAGE), (54, "http://h.example/b", PAGE), (None, None, PAGE)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html.main_text(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[k] == f"Story {k} tells of number {k * 7} and {k * 13} more" for k in range(12))
    assert text[50] == "Home\nAlone" and text[51] == "x" and text[52] == "" and text[53] == "" and text[54].startswith("Title here") and text[None] == text[54]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.main_text(pages.limit(0)).count() == 0
