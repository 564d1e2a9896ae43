"""Whole pages of common shapes, most without an <article>: exactly the article's text comes out."""

import pytest

from atlaskb.llm.html_extract import extract, suspicion

A = "The council met on Tuesday, after a long pause, and decided that the old bridge will be rebuilt next year."
B = "Work begins in spring, the mayor said, and the road stays open, although some lanes are closed at night."
C = "Residents had asked for a new crossing, since the old one is narrow, and lorries often have to turn back."
T = f"<p>{A}</p><p>{B}</p>"
TEXT = f"{A}\n{B}"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul>'
FOOT = "<footer>Copyright, all rights reserved</footer>"
SIDE = '<div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">A story, with commas, of others</a></li></ul></div>'
TALK = '<div class="comments"><h3>2 comments</h3><p>I think, and I say so often, that this bridge should have been rebuilt, at last, years and years ago.</p></div>'


@pytest.mark.parametrize(
    ("body", "text"),
    [
        # A form around the page, and forms that are none of it.
        (f"<form id=aspnetForm><div class=content>{T}</div></form>", TEXT),
        (f"<form id=aspnetForm>{NAV}<div class=content>{T}</div><div class=footer>Imprint</div></form>", TEXT),
        (f"<div class=content>{T}<form><label>Mail</label><input><button>Send</button></form></div>", TEXT),
        (f"<div class=content>{T}<form>Write to us <input> now</form></div>", TEXT),
        (f"<article><h1>Bridge</h1>{T}<fieldset><p>{C}</p></fieldset></article>", f"Bridge\n{TEXT}\n{C}"),
        # Names that tell of a layout, not of the element.
        (f"<div class='page-with-sidebar'><div class=content>{T}</div></div>", TEXT),
        (f"<div class='page-with-sidebar'><div class=content>{T}</div>{SIDE}</div>", TEXT),
        (f"<div class='layout sidebar-left'><div class=content>{T}</div></div>", TEXT),
        (f"<div class='layout sidebar-left'>{SIDE}<div class=content>{T}</div></div>", TEXT),
        (f"<div class='post type-post comments-open'>{T}</div>", TEXT),
        (f"<div class='post type-post comments-open'>{T}{TALK}</div>", TEXT),
        (f"<article><p>a, b</p><div class='social-history'>{T}</div></article>", f"a, b\n{TEXT}"),
        (f"<article>{T}<div class='social-links'><a href=x>Share</a> <a href=y>Post</a></div></article>", TEXT),
        (f"<body class='has-sidebar no-comments'><div id=main>{T}</div>{SIDE}</body>", TEXT),
        (f"<article><p>{A}</p><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", f"{A}\nIf x=2 holds."),
        # Headings beside and above the container.
        (f"<div class=content><header><h1>Title</h1></header>{T}</div>", f"Title\n{TEXT}"),
        (f"<div id=page><h2>Title</h2><div class=content>{T}</div></div>", f"Title\n{TEXT}"),
        (f"<div id=page><h1>Title</h1><div class=row><div class=content>{T}</div>{SIDE}</div></div>", f"Title\n{TEXT}"),
        (f"<body><header>Our paper {NAV}</header><div class=content><h1>Title</h1>{T}</div>{FOOT}</body>", f"Title\n{TEXT}"),
        (f"<div id=wrap><div class=header>Our paper</div><div id=content><h1>Title</h1>{T}</div><div id=footer>Imprint</div></div>", f"Title\n{TEXT}"),
        # What surrounds the text.
        (f"{MENU}<div id=story>{T}</div>{SIDE}{TALK}{FOOT}", TEXT),
        (f"<div class='cookie-banner'><p>{C}</p></div><div class=entry>{T}</div>", TEXT),
        (f"<div class=notice>We use cookies</div><main>{T}</main>{FOOT}", TEXT),
        (f"<div class='ad-slot'>Buy now, pay later</div><div>{T}</div><div class='ads_box'>Buy</div>", TEXT),
        (f"<div>{T}<div class='related-posts'><p><a href=x>Other story, with a rather long name, of which much is said</a></p></div></div>", TEXT),
        (f"<table><tr><td>{MENU}</td><td>{T}</td></tr></table>", TEXT),
        (f"<div id=c>{T}<h2>More</h2><ul><li>one</li><li>two</li></ul><blockquote>Said so</blockquote><pre>code</pre></div>", f"{TEXT}\nMore\none\ntwo\nSaid so\ncode"),
        (f"<body><h1>Title</h1><p>{A}</p><h2>Next</h2><ul><li>one</li></ul><p>{B}</p>{FOOT}</body>", f"Title\n{A}\nNext\none\n{B}"),
        (f"<div><section><p>{A}</p><p>{B}</p></section><h2>Next</h2><section><p>Short.</p></section><section><p>{C}</p></section></div>", f"{A}\n{B}\nNext\nShort.\n{C}"),
        (f"<div class=post>{T}</div><section id=comment-list><article class=comment><p>{C}</p></article><article class=comment><p>{C}</p></article><article class=comment><p>{C}</p></article></section>", TEXT),
        (f"<div class=entry>{A}<br><br>{B}</div>{SIDE}", f"{A} {B}"),
        (f"<center><font size=2>{T}</font></center>{MENU}", TEXT),
        (f"<div role=banner>Paper</div><div role=main>{T}</div><div role=contentinfo>Imprint</div>", TEXT),
        (f"<div class='widget widget-text'>{T}</div>", TEXT),
        (f"<div class='elementor-widget elementor-text'><p>{A}</p></div><div class='elementor-widget elementor-text'><p>{B}</p></div>", TEXT),
        (f"<div class=comments>{T}</div>", TEXT),  # nothing else is there
    ],
)
def test_pages(body, text):
    page = body if "<body" in body else f"<body>{body}</body>"
    assert extract(f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head>{page}</html>") == text


def test_suspicion():
    clear = "content page-with-sidebar no-comments warning-signs story top-story main section-2 entry-header".split()
    assert [n for n in clear if suspicion(n)] == []
    assert all(suspicion(n) for n in "sidebar sidebar-left comments comment-list postComments ad ads_box site-footer cookie-banner social-history comments-open".split())
