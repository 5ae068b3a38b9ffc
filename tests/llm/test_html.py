"""The HTML operator against a plain reading of whole test pages, and on pages that mislead it."""

import html
import re
import time

from tessera.llm.common import table
from tessera.llm.html_text import extract, main_text

PROSE = "<p>" + "A long paragraph of plain prose that says something. " * 5 + "</p>"


def n(page):
    return main_text(f"<body>{page}</body>").count("plain prose") / 5


def plain(page):
    """The text of a page of the test data: what is inside its article, adverts and scripts left out."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r'<(script|style|form|aside)\b.*?</\1>|<!--.*?-->|<div class="ad">.*?</div>', "", inner, flags=re.S)
    blocks = re.split(r"</?(?:p|h1|h2|ul|li|div)>", inner.replace("<br>", " "))
    return "\n\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split())))


def test_every_page_of_the_test_data(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract(pages).collect()}
    assert got == {r.page_id: (r.url, plain(r.html), len(plain(r.html))) for r in pages.collect()}


def test_words_of_a_state_mark_nothing():
    for a in ("id=content class='no-sidebar'", "class='post comments-open'", "class='layout has-sidebar'", "class='content-sidebar-wrap'", "class='left-sidebar'", "id='comments'"):
        assert n(f"<div {a}>{PROSE * 2}</div>") == 2, a
    assert n(f"<form>{PROSE * 2}<input></form>") == 2  # a page inside a form


def test_marked_elements_go():
    for a in ("class='left-sidebar'", "class='commentList'", "id=cookie-notice", "role=navigation", "class='amazon-ad-x'", "style='display: none'", "hidden", "aria-hidden=true"):
        assert n(f"<div class=content>{PROSE * 3}</div><div {a}><p>Not this.</p></div>") == 3 and "Not" not in main_text(f"<body><div class=content>{PROSE * 3}</div><div {a}><p>Not this.</p></div></body>"), a
    assert n(f"<div class=content>{PROSE * 2}</div><div class=comments>{PROSE * 9}</div>") == 2


def test_inline_elements_go_on_through_blocks():
    got = main_text(f"<body><article>{PROSE}<span class='ad'><div>Advert</div></span><p>end</p></article></body>")
    assert "Advert" not in got and got.endswith("\n\nend")
    links = "<a href=x><div>a block of link text</div></a>" * 40
    assert n(f"<div>{links}</div><div>{PROSE * 2}</div>") == 2 and "link" not in main_text(f"<body><div>{links}</div><div>{PROSE * 2}</div></body>")


def test_the_content_is_whole():
    assert n(f"<main><article>{PROSE * 2}</article><article>{PROSE}</article></main>") == 3
    got = main_text(f"<body><nav>menu</nav><div><h1>Title</h1><div>{PROSE * 2}<p>Short.</p></div></div></body>")
    assert got.startswith("Title\n\nA long") and got.endswith("\n\nShort.")
    got = main_text(f"<body><article>{PROSE}<ul class=tags><li><a href=x>one</a><li><a href=y>two</a></ul></article></body>")
    assert got.endswith("something.")
    sections = "".join(f"<section><h2>Part {k}</h2>{PROSE * 3}</section>" for k in range(4))
    assert n(f"<nav><a href=x>menu</a></nav><div>{sections}</div>") == 12  # by density alone


def test_long_and_malformed_pages():
    began = time.time()
    for page in ('<a "' * 20_000, '<div "a' * 20_000 + "x>", "<div>" * 50_000 + "deep", "<div>" * 20_000 + "</p></b>" * 20_000, "<li><span>" * 20_000, "<a><b>" * 20_000 + "</i>" * 20_000, "<!--" * 50_000):
        main_text(page)
    words = "some words of a very long page " * 40
    long = "".join(f"<p>{words}{k}" for k in range(4500))
    got = main_text(f"<html><body><div>{long}")  # over 5 MB, nothing closed
    assert len(got) > 5_000_000 and got.endswith("page 4499") and got.count("\n\n") == 4499
    assert time.time() - began < 60
    assert main_text("a < b <c") == "a < b"
