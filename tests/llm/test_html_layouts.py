"""Hand-labelled pages of many layouts: the article's blocks in order, everything else must go."""

import pytest

from cirrostrat.llm.html import TREE, FEATURES, main_text

A, B, C = ("alpha " * 60).strip(), ("beta, " * 45).strip(), ("gamma " * 20).strip()
P = f"<p>{A}</p><p>{B}</p>"
MENU = "<ul><li><a href=/>Home</a><li><a href=/n>News today</a><li><a href=/c>Contact</a></ul>"
AB = f"{A}\n{B}"

PAGES = {
    "state classes": (f'<div class="content with-sidebar">{P}</div>', AB),
    "fixed header class": (f'<div class="container header-fixed">{P}</div>', AB),
    "blog body classes": (f'<div id="page" class="single-post comments-open">{P}</div>', AB),
    "nav, article, footer": (f"<nav>{MENU}</nav><article><h1>Head line</h1>{P}</article><footer>Imprint and more</footer>", f"Head line\n{AB}"),
    "header inside and outside": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{P}</article>", f"Title\n{AB}"),
    "blog": (f'<div id="masthead" class="site-header">Blog of X</div><div class="entry-content"><h1>T one</h1>{P}</div><div id="comments" class="comments-area"><h2>2 comments</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>{A} {B} {A}</p></article></li></ol></div><div id="secondary" class="widget-area"><p>{C}</p></div>', f"T one\n{AB}"),
    "no hints": (f"<div>{MENU}</div><h1>Title of it</h1>{P}<h2>Sub heading</h2><p>{B}</p><div><a href=1>One link</a> <a href=2>Two links</a></div>", f"Title of it\n{AB}\nSub heading\n{B}"),
    "page in a form": (f'<form action="/" id="aspnetForm"><div class="nav">{MENU}</div><h1>Title</h1>{P}</form>', f"Title\n{AB}"),
    "sections named like boxes": (f'<article><h1>On it</h1><section id="related-work"><h2>Related work</h2><p>{A}</p></section><section id="side-effects"><p>{B}</p></section><section id="search"><p>{A}</p></section></article>', f"On it\nRelated work\n{AB}\n{A}"),
    "names in other attributes": (f'<article data-title="The hidden valley" aria-hidden="false" data-id="menu">{P}</article>', AB),
    "hidden blocks": (f'<main><p hidden>{C}</p><div style="display: none">{C}</div>{P}</main>', AB),
    "hidden and commenting words": (f'<article><p>{A} <span hidden>gone</span><span style="display:none">gone</span><span class="comment">reader comment</span></p><p>{B}</p></article>', AB),
    "comment colours in code": (f'<article>{P}<pre><code>x = 1 <span class="comment"># note</span></code></pre></article>', f"{AB}\nx = 1 # note"),
    "unended quote": (f"<article>{P}<p title=\"unclosed>{C}</p></article>".replace("gamma", "gamma"), f"{AB}\n{C}"),
    "notice, form, advert": (f'<main><h1>Head</h1><div class="notice">Please note our new terms of use today</div><p>{A}</p><form><label>Mail</label><p>Sign up for more</p></form><div class="ad-slot">Buy {C}</div><p>{B}</p></main>', f"Head\n{AB}"),
    "cookie layer": (f'<div id="cookieConsent"><p>{C}</p></div><div class="post-body">{P}</div>', AB),
    "sidebar": (f'<div class="left-sidebar"><p>{C}</p></div><div id="content">{P}</div><div class="sidebar">{MENU}<p>{C}</p></div>', AB),
    "article classes": (f'<article class="post tag-search category-news sidebar-none">{P}</article>', AB),
    "short article": ("<nav><a href=/>Home</a></nav><article><h1>Tiny</h1><p>One.</p></article><footer>x</footer>", "Tiny\nOne."),
    "links in the text": (f"<article><p>{A} <a href=1>a link</a></p><ul><li><a href=2>further reading</a></li></ul><p>{B}</p></article>", f"{A} a link\nfurther reading\n{B}"),
    "roles": (f'<div role="navigation">{MENU}</div><div role="main">{P}</div><div role="contentinfo">{C}</div>', AB),
    "table": (f"<article>{P}<table><tr><td>One<td>Two</table></article>", f"{AB}\nOne\nTwo"),
    "references": ("<article><p>Fish &amp; chips &lt;b&gt; &#8364;5 &copy 2020 &nbsp; end</p></article>", "Fish & chips <b> €5 © 2020 end"),
    "scripts": (f'<script>var x = "<p>no</p>";</script><style>p{{}}</style><article>{P}<script>more()</script></article><noscript>{C}</noscript>', AB),
    "unclosed": (f"<article><p>{A}<p>{B}", AB),
    "hidden inline around blocks": (f"<article><p>{A}</p><span hidden><p>{C}</p></span><p>{B}</p></article>", AB),
    "share line": (f'<article><p>{A}</p><p>{B}</p><div class="share-buttons">Share this now</div></article>', AB),
}


@pytest.mark.parametrize("name", PAGES)
def test_layout(name):
    page, want = PAGES[name]
    assert main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == want


def test_tree_uses_neighbours():
    used = set()

    def walk(tree):
        if isinstance(tree, tuple):
            used.add(FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(TREE)
    assert {"words", "boiler", "body", "weak"} <= used and used & {"words_before", "links_before"} and used & {"words_after", "links_after"}, used


def test_pathological_pages_are_fast():
    for page in ("<" * 200_000, "<a " * 60_000, "<p " + "x='" * 50_001, "<div>" * 50_000 + "word", "</p>" * 100_000, "&" * 200_000):
        main_text(page)
