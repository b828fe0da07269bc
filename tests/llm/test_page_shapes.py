"""The main text of pages whose elements and names say nothing, or something else: what counts is density."""

import re

import pyarrow.parquet as pq
import pytest

from tidemark.llm.html_density import main_text

SAID = "The council met on Tuesday to discuss the new plan for the harbour. Nobody had expected that the vote would be so close."
TEXT = "".join(f"<p>{SAID} Part {k}.</p>" for k in range(12))


@pytest.fixture(scope="module")
def pages():
    html = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    return [(p, main_text(p)) for p in html if p]


def divs(page):
    return re.sub(r"(</?)article\b", r"\1div", page)


def in_a_form(page):
    page = re.sub(r"(</?)h1\b", r"\1h2", divs(page))
    return re.sub(r"(<body[^>]*>)", r'\1<form method="post">', page).replace("</body>", "</form></body>")


def nameless(page):
    page = re.sub(r"(</?)(article|main|header|footer|nav|aside|section)\b", r"\1div", page)
    return re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


@pytest.mark.parametrize("rewritten", [divs, in_a_form])
def test_pages_without_an_article_element_keep_their_text(pages, rewritten):
    assert [k for k, (p, text) in enumerate(pages) if main_text(rewritten(p)) != text] == []


def test_nameless_pages_lose_nothing(pages):
    """Where a nameless advert says as much as a one-paragraph article, both stay (5 of 250 pages); no text is lost."""
    more = 0
    for p, text in pages:
        found = main_text(nameless(p)).split("\n")
        assert not set(text.split("\n")) - set(found)
        more += found != text.split("\n")
    assert more <= 5


@pytest.mark.parametrize("where", ["article", "main"])
@pytest.mark.parametrize("name", ["promo-video-text", "reply-to-critics", "login-required-content", "comment-on-policy", "share-of-votes"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_a_name_of_the_articles_own_cuts_no_running_text(where, name, kind):
    page = f'<body><{where}><h1>T</h1>{TEXT}<div {kind}="{name}">{SAID} Own part.</div></{where}></body>'
    assert "Own part." in main_text(page)


@pytest.mark.parametrize("name", ["comments", "comment-list", "comments-area", "sidebar-left", "site-footer", "newsletter-signup", "cookie-banner",
    "promo-box", "ad-container", "comment-body"])
def test_a_name_of_the_layout_still_cuts(name):
    page = f'<body><article><h1>T</h1>{TEXT}<div class="{name}"><p>{SAID} Not this.</p></div></article></body>'
    assert "Not this." not in main_text(page) and main_text(page).count("Part") == 12


def test_repeated_small_parts_are_no_second_article():
    """Eight comments without a name, each about a twelfth of the article, in one wrapper beside it."""
    remarks = "".join(f"<div><b>user{k}</b><p>I think this is a good plan, as the harbour needs it. Remark {k}</p></div>" for k in range(8))
    for page in (f"<body><div><h1>T</h1>{TEXT}</div><div>{remarks}</div></body>", f"<body><div><div><h1>T</h1>{TEXT}</div><div>{remarks}</div></div></body>"):
        assert main_text(page).count("Part") == 12 and "Remark" not in main_text(page)


def test_forms():
    fields = "<input name=q><select><option>one</select><textarea>typed</textarea><button>Send</button>"
    around = main_text(f"<body><form>{fields}<div><h2>T</h2>{TEXT}</div></form></body>")
    assert around.count("Part") == 12 and not {"one", "typed", "Send"} & set(around.split("\n"))
    beside = main_text(f"<body><div><h1>T</h1>{TEXT}</div><form><p>{SAID} Sign up.</p>{fields}</form></body>")
    assert beside.count("Part") == 12 and "Sign up." not in beside


def test_paragraphs_of_one_container_belong_together():
    assert main_text("<body><div><h1>T</h1><p><b>A long and bold opening line of the piece.<br></b></p><p>Short.</p></div></body>").endswith("Short.")
