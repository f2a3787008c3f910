from __future__ import annotations

import random
import time

from conftest import prose

from verdance.llm import html

AGAIN = "Read more of our partners and their fine offers today"


def test_array_sees_declared_pages_and_roles_veto(spark):
    shared = "a passage that many articles of this host share word for word"
    rows = [(k, f"http://h.example/{k}", f"<article><div>{AGAIN}</div><p>{shared}</p><p>Story {k} of {k * 7}</p></article>") for k in range(6)]
    rows += [(10, "http://h.example/10", f"<!-- <article> --><script>'<main'</script><div>{AGAIN}</div><p>Plain story of ten</p>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{shared}\nStory {k} of {k * 7}" for k in range(6))
    assert got[10] == "Plain story of ten"


def test_result_does_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for k in range(120):
        body = f"<p>{prose(rng, 30)}</p>" + (f"<div>{AGAIN}</div>" if k % 20 == 3 else "") + ("<div>only two pages of this host have these words here</div>" if k in (4, 5) else "")
        rows.append((k, f"http://big.example/{k}", body))
    rows += [(200, "http://big.example/200", "<p>one page that comes in three rows of the same id</p>")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted((r.page_id, r.text) for r in html.main_text(pages).collect())
    assert not any(AGAIN in t for _, t in one) and sum("only two pages" in t for _, t in one) == 2
    assert [t for k, t in one if k == 200] == ["one page that comes in three rows of the same id"] * 3
    for shard, part in ((10, 16), (7, 2)):
        monkeypatch.setattr(html, "PAGES_OF_SHARD", shard)
        monkeypatch.setattr(html, "SHARDS_OF_PART", part)
        assert sorted((r.page_id, r.text) for r in html.main_text(pages).collect()) == one


def plain(pages: dict[int, list[str]], run: int, least: int) -> dict[int, str]:
    """Without arrays: pages of every run of words and breaks, words covered by repeated ones, blocks without them."""
    streams = {k: [x for b in p for x in [*b.split(" "), None]] for k, p in pages.items()}
    stands: dict[tuple, set] = {}
    for k, w in streams.items():
        for i in range(len(w) - run + 1):
            stands.setdefault(tuple(w[i : i + run]), set()).add(k)
    out = {}
    for k, p in pages.items():
        w, kept, at = streams[k], [], 0
        gone = {j for i in range(len(w) - run + 1) if len(stands[tuple(w[i : i + run])]) >= least for j in range(i, i + run)}
        for b in p:
            own = b.split(" ")
            off = [at + i in gone for i in range(len(own))]
            at += len(own) + 1
            if all(off):
                continue
            left, i = [], 0
            while i < len(own):
                j = i
                while j < len(own) and off[j]:
                    j += 1
                left += own[i:j] if j - i < run else []
                left += own[j : j + 1]
                i = j + 1
            if left:
                kept.append(" ".join(left))
        out[k] = "\n".join(kept)
    return out


def test_final_text_equals_a_plain_version(spark, monkeypatch):
    rng = random.Random(11)
    pieces = [prose(rng, rng.randrange(1, 14)) for _ in range(12)]
    pages = {}
    for k in range(90):
        pages[k] = [" ".join([prose(rng, rng.randrange(0, 6)), rng.choice(pieces), prose(rng, rng.randrange(0, 4))]).strip() if rng.random() < 0.6 else rng.choice(pieces) for _ in range(rng.randrange(0, 7))]
    want = plain(pages, html.RUN, html.LEAST)
    assert sum(want[k] != "\n".join(p) for k, p in pages.items()) > 40
    df = spark.createDataFrame([(k, f"https://h.example/{k}", "".join(f"<div>{b}</div>" for b in p)) for k, p in pages.items()], "page_id long, url string, html string")
    for shard in (400, 9):
        monkeypatch.setattr(html, "PAGES_OF_SHARD", shard)
        assert {r.page_id: r.text for r in html.main_text(df).collect()} == want


def test_a_megabyte_of_unclosed_markup():
    n = 1 << 20
    for part in ("<script ", "<script>", '<a "', "<a '>\"", "<!--", "<div class=ad>", "</div>", "<", "<p", "<a href='>", "<style", '<a ">x" <', "<div><p>", "<article><nav>"):
        began = time.perf_counter()
        html.blocks(part * (n // len(part)))
        html.blocks("<main>" + part * (n // len(part)) + ">")
        assert time.perf_counter() - began < 30, part


def test_sections_of_the_article_stay():
    page = "<article><section class='discussion'><p>We discuss</p></section><section id='related-work'><p>Others did</p></section><div class='related-posts'><p>More</p></div><div class='related'>x</div><section class='comments'><p>nice</p></section><div class='ad'>buy</div></article>"
    assert html.joined(html.blocks(page)) == "We discuss\nOthers did"
    assert html.joined(html.blocks("<!-- <article> --><div>Home</div><p>x</p>")) == "Home\nx"
