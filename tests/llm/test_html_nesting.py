"""Names on inline elements and chapters, odd comments, and pages that nest deeply."""

import time

import pytest

from cirrostrat.llm.html import main_text

LONG = "The river took its old stones down to a quiet bay where boats lay still and gulls cried over the drying nets. " * 2
LONG = LONG.strip()


def page(x):
    return f"<nav><a href=#>Home</a> <a href=#>News</a></nav><article><h1>Head</h1><p>{LONG}</p>{x}<p>{LONG}</p></article><footer>Imprint</footer>"


KEPT = {
    "inline names": ('<p>Choose <b class="menu">File</b> and then <span class="widget">Save</span> it.</p>', "Choose File and then Save it."),
    "chapter on cookies": (f'<section id="cookies"><h2>Baking cookies</h2><p>{LONG}</p></section>', f"Baking cookies\n{LONG}"),
    "chapter on pagination": (f'<section id="pagination"><h2>How pagination works</h2><p>{LONG}</p></section>', f"How pagination works\n{LONG}"),
    "chapter on comments": (f'<div id="comments"><h2>Comments in Java</h2><p>{LONG}</p></div>', f"Comments in Java\n{LONG}"),
    "empty comments": ("<!--><p>one</p><!---><p>two</p>", "one\ntwo"),
    "comments that end oddly": ("<!-- a --!><p>one</p><!-- b > -- > --><p>two</p>", "one\ntwo"),
}
GONE = {
    "readers' comments": f'<div id="comments"><h2>3 Comments</h2><p>{LONG}</p></div>',
    "leave a reply": f'<section id="respond"><h3>Leave a reply</h3><p>{LONG}</p></section>',
    "share line": '<p><span class="share">Share this with all your friends</span></p>',
    "stories": f'<div class="related-stories"><p>{LONG}</p></div>',
    "promotion": f'<div class="promo-box">{LONG}</div>',
    "German comments": f'<div class="kommentare"><p>{LONG}</p></div>',
    "German advert": f'<div class="werbung">{LONG}</div>',
    "hidden words": '<p hidden>gone <b>too</b></p>',
}


@pytest.mark.parametrize("name", KEPT)
def test_article_text_stays(name):
    x, want = KEPT[name]
    assert main_text(page(x)) == f"Head\n{LONG}\n{want}\n{LONG}"


@pytest.mark.parametrize("name", GONE)
def test_the_rest_goes(name):
    assert main_text(page(GONE[name])) == f"Head\n{LONG}\n{LONG}"


@pytest.mark.parametrize("html", ["<nav>" * 100_000, '<div class="nav">' * 60_000 + "</div>" * 60_000, "<i>" * 30_000 + "</b>" * 30_000 + "</i>" * 30_000, "<b>" * 30_000 + "<i>" * 30_000 + "</b>" * 30_000, "<div><p>" * 30_000 + "</span></section>" * 30_000, '<p class="nav"><b class="menu">x' * 30_000])
def test_nesting_takes_time_in_proportion(html):
    start = time.process_time()
    main_text(page(html))
    assert time.process_time() - start < 10
