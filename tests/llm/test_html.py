"""Extraction of main texts: the windows decide, on marked pages and on pages without any mark."""

import re
import time

import numpy as np
import pytest

from graphspark.llm import html_extract

BODY = "Words of an article without any mark of its own, long enough to be taken for the text of the page. "


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]


def unmarked(page):
    page = re.sub(r"<(/?)(article|main)\b", r"<\1div", page or "")
    return re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_pages_without_marks_give_the_text_of_the_marked_page(pages, monkeypatch):
    want = [html_extract.main_text(p) for p in pages]
    bare = [unmarked(p) for p in pages]
    assert sum(a == html_extract.main_text(b) for a, b in zip(want, bare)) >= 0.99 * len(pages)
    monkeypatch.setattr(html_extract, "stretches", lambda row: [(0, len(row))])  # no surge and dive points: all lines are one stretch
    assert sum(a == html_extract.main_text(b) for a, b in zip(want, bare)) <= 0.1 * len(pages)


def test_windows_decide_on_marked_pages(pages, monkeypatch):
    want = [html_extract.main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "stretches", lambda row: [(0, len(row))])
    assert sum(a == html_extract.main_text(p) for a, p in zip(want, pages)) <= 0.01 * len(pages)


def test_surge_and_dive_equal_plain_sums():
    """Stretches and what surges, against sums taken window by window."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        row = rng.choice([0.0, 0.0, 5.0, 30.0, 90.0], rng.integers(1, 30))
        w = html_extract.WINDOW
        sums = [sum(row[max(0, k - w + 1) : k + 1]) for k in range(len(row) + w - 1)]
        want, k = [], 0
        while k < len(sums):
            if sums[k] > 0:
                end = k
                while end < len(sums) and sums[end] > 0:
                    end += 1
                want.append((k, min(end - w + 1, len(row))))
                k = end
            k += 1
        assert html_extract.stretches(row) == want and np.allclose(html_extract.windows(row), sums)


@pytest.mark.parametrize("page", [
    "<form><main><p>{}</p></main></form>", "<form id=f><div><article><p>{}</p></article></div></form>", '<article><div class="elementor-widget"><p>{}</p></div></article>',
    '<main><div class="elementor-element elementor-widget elementor-widget-text-editor"><p>{}</p></div></main>', '<main><section class="related-work"><p>{}</p></section></main>', "<form><div><p>{}</p><p>{}</p><input><label>Name</label></div></form>",
])
def test_articles_in_forms_and_boxes_are_kept(page):
    text = html_extract.main_text(page.format(BODY, BODY))
    assert text.startswith(BODY.strip()) and text.count(BODY.strip()) == page.count("{}")


def test_forms_and_boxes_beside_articles_go():
    boxes = f'<form><p>{BODY}</p><label>Name</label></form><div class="widget">{BODY}</div><div class="related-posts"><p>{BODY}</p></div><div class="share-buttons">Share</div>'
    assert html_extract.main_text(f"<main><p>{BODY}</p>{boxes}<p>End.</p></main>") == f"{BODY.strip()}\n\nEnd."


@pytest.mark.parametrize("page", ["<i>" * 120_000 + "</x>" * 120_000, "<x><article>" + "<i>" * 120_000 + "</x>" * 120_000, "<head>" * 150_000, "<b>" * 100_000 + "</b></i>" * 100_000, "<div class=a>" * 60_000 + "</p>" * 60_000])
def test_broken_nesting_is_read_once(page):
    began = time.time()
    html_extract.main_text(page + f"<p>{BODY}</p>")
    assert time.time() - began < 10


def test_marked_articles_are_whole(pages):
    """Of the given pages, whose articles hold nothing foreign: every paragraph and heading of the article, in order."""
    for page in pages:
        article = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page or "", re.S)
        if article:
            blocks = [" ".join(re.sub(r"<[^>]*>", " " if "br" in x else "", x).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<br\s*/?>", " ", article[1]))]
            want = html_extract.references.unescape("\n\n".join(b for b in blocks if b))
            assert re.sub(r"\s+", " ", html_extract.main_text(page)) == re.sub(r"\s+", " ", want)


@pytest.mark.parametrize("name", ["page has-sidebar", "with-header", "search-page", "layout-social", "sidebar-layout", "no-banner", "header"])
def test_names_around_a_main_part(name):
    for tag in ("main", "article"):
        assert html_extract.main_text(f'<div class="{name}"><nav><a href=x>Home</a></nav><{tag}><p>Short.</p><p>{BODY}</p></{tag}></div>') == f"Short.\n\n{BODY.strip()}"


def test_comments_and_cards_are_no_articles():
    comments = f'<section id="comments"><article><p>{BODY * 3}</p></article><article class="comment">{BODY}</article></section>'
    assert html_extract.main_text(f"<main><p>{BODY}</p></main>{comments}") == BODY.strip()
    cards = '<article><a href="/a">Teaser one</a></article><article><a href="/b">Teaser two</a></article>'
    assert html_extract.main_text(f"<div><h2>Head</h2><p>{BODY}</p><p>{BODY}</p></div><div>{cards}</div>") == f"Head\n\n{BODY.strip()}\n\n{BODY.strip()}"


def test_an_article_in_parts_keeps_all_of_them():
    links = "<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>"
    page = f"<div><p>{BODY * 9}</p></div><div class=ad>Buy</div>{links}<div><p>{BODY}</p><p>See <a href=x>a reference</a></p><p><a href=y>another one alone</a></p><p>End.</p></div>"
    assert html_extract.main_text(page) == "\n\n".join([(BODY * 9).strip(), BODY.strip(), "See a reference", "another one alone", "End."])
    assert html_extract.main_text("<p>Short page</p>") == "Short page"


def test_edges(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "<p>x", 3), (3, "u", "<p>x", 3), (None, "u", "<article><p>a &amp; b</p>", 4), (5, "u", f"<article>{f'<p>{BODY}</p>' * 12_000}</article>", 5), (6, "u", "<" * 200_000, 6), (7, "u", "<div>" * 3_000 + BODY, 7)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    began = time.time()
    got = sorted((r.page_id or 0, r.n_chars) for r in html_extract.extract(frame).collect())
    assert [x for x in got if x[0] not in (5, 6)] == [(0, 5), (1, 0), (2, 0), (3, 1), (3, 1), (7, len(BODY.strip()))]
    assert dict(got)[5] == 12_000 * (len(BODY.strip()) + 2) - 2 and time.time() - began < 60
    assert html_extract.extract(frame.limit(0)).count() == 0
