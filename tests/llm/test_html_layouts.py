"""Main texts of common page layouts, by literal expected texts."""

import pytest

from turnstream.llm.html_extract import main_text

LONG = "A sentence that is the body of this page and says a little more than its neighbours do."
NOTE = "A reader wrote this line under the page, and it is not short either, as readers like to write."


@pytest.mark.parametrize(
    "page, text",
    [
        # a form around the whole page
        (f"<body><form id=aspnetForm><div><p>{LONG}</p></div></form></body>", LONG),
        (f"<form id=f><nav>Home</nav><article><p>{LONG}</p></article><footer>f</footer></form>", LONG),
        (f"<fieldset><p>{LONG}</p></fieldset>", LONG),
        (f"<form><p>{LONG}</p></form><div id=comments><p>{NOTE}</p></div>", LONG),
        (f"<header><h1>Title</h1><p>{LONG}</p></header>", f"Title\n{LONG}"),
        # a form beside the text
        (f"<article><p>{LONG}</p></article><form><p>Write to us, we answer every letter that we get.</p></form>", LONG),
        ("<article><p>Short.</p></article><form><p>Write to us, we answer every letter that we get.</p></form>", "Short."),
        # comments and teasers that are articles
        (f"<article><p>{LONG}</p></article><div id=comments><ol><li class=comment><article class='comment-body'><p>{NOTE}</p></article></ol></div>", LONG),
        (f"<article><p>{LONG}</p><section id=comments><article><p>{NOTE}</p></article></section></article>", LONG),
        (f"<article><p>{LONG}</p></article><section class='related'><article><p>{NOTE}</p></article></section>", LONG),
        (f"<article><p>{LONG}</p></article><div class=sidebar><article><p>{NOTE}</p></article></div>", LONG),
        (f"<div class=post><p>{LONG}</p></div><div id=comments><article><p>{NOTE}</p></article></div>", LONG),
        ("<article><p>A short text.</p></article><div id=comments>" + f"<div><p>{NOTE}</p></div>" * 30 + "</div>", "A short text."),
        ("<div class=post><p>A short text, but the only one that counts here.</p></div><div id=comments>" + f"<article><p>{NOTE}</p></article>" * 30 + "</div>", "A short text, but the only one that counts here."),
        # names of containers that hold the page
        (f"<div class='sidebar-right'><nav>n</nav><article><p>{LONG}</p></article><div class=comments><article><p>{NOTE}</p></article></div></div>", LONG),
        (f"<div class='site comments-open'><article><h1>T</h1><p>{LONG}</p></article></div>", f"T\n{LONG}"),
        (f"<article><div class=widget><p>{LONG}</p></div></article>", LONG),
        # names written together
        (f"<div class=cookieConsentBanner><p>{NOTE}</p></div><article><p>{LONG}</p></article><div class=siteFooter><p>{NOTE}</p></div>", LONG),
        # ends of comments
        ("<article><p>a</p><!--><p>b</p><!---><p>c</p><!-- no --!><p>d</p><!-- no --><p>e</p></article>", "a\nb\nc\nd\ne"),
        # short articles and leads beside a long one
        (f"<article><p>{LONG * 8}</p></article><article><p>A second, short one.</p></article>", f"{LONG * 8}\nA second, short one."),
        (f"<p>A lead paragraph that stands before its article.</p><article><p>{LONG * 20}</p></article>", f"A lead paragraph that stands before its article.\n{LONG * 20}"),
        # nothing but navigation
        ("<nav><p>All about us and what we do for you every day.</p></nav>", ""),
        (f"<main><h1>T</h1><p>{LONG}</p><aside><p>{NOTE}</p></aside><div class='share-buttons'><p>{NOTE}</p></div></main>", f"T\n{LONG}"),
    ],
)
def test_layouts(page, text):
    assert main_text(page) == text
