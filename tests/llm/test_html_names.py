"""Names of layout are votes; pages of several layouts and languages keep their text."""

import time

import pytest

from lodestone.llm.html_text import main_text

TEXT = "This is the text of an article that was written for the reader and it is long enough to be running text of the page in the end. " * 2
PARAGRAPH, WANT = f"<p>{TEXT}</p>", TEXT.strip()
COMMENT = "<p>" + "I do not like this at all, and it is what all of us think about it in the end, so there you have it. " * 3 + "</p>"
CHINESE = "这是一个没有主要部分的中文页面的正文内容。" * 12


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post hentry category-advertising tag-search">{PARAGRAPH}</article>',
        f'<main id="search-results">{PARAGRAPH}</main>',
        f'<div id=wrapper class="nav-open"><article>{PARAGRAPH}</article></div>',
        f'<div class="page header-fixed"><div class="site sidebar-right"><article>{PARAGRAPH}</article></div></div>',
        f'<div class="banner-page"><h1>A</h1>{PARAGRAPH}</div>'.replace("<h1>A</h1>", ""),
        f'<article>{PARAGRAPH}</article><div id="comments"><article class="comment">{COMMENT}</article></div>',
        f'<div class="sidebar">{COMMENT}</div><div class="content">{PARAGRAPH * 2}</div>'.replace(PARAGRAPH * 2, PARAGRAPH + COMMENT.replace("<p>", "<p class=x>")),
        f'<div class="share"><div class="share"><div class="share">{PARAGRAPH}',
    ],
)
def test_articles_inside_named_elements(page):
    text = main_text(f"<html><body><ul class=menu><li><a href=/>Home</a></ul>{page}")
    assert text.startswith(WANT) and "Home" not in text
    assert text.count("I do not like") == (3 if "class=x" in page else 0)


def test_a_title_in_a_named_element_with_text():
    page = f'<body><div class="search"><h1>Title of it</h1>{PARAGRAPH}</div><div class="sidebar">{COMMENT * 3}</div>'
    assert main_text(page) == f"Title of it\n{WANT}"


def test_languages_without_known_stop_words():
    assert main_text(f"<body><p>{CHINESE}</p><p><a href=/>链接</a></p>") == CHINESE
    assert main_text(f"<body><main><p>{CHINESE}</p></main><div class=footer>{CHINESE}</div>") == CHINESE


def test_unmatched_tags_take_linear_time():
    began = time.process_time()
    assert main_text("<div>" * 50_000 + "</li>" * 100_000 + PARAGRAPH) == WANT
    assert time.process_time() - began < 4
