"""Pages whose markup once hid the text of an article."""

import time

import pytest

from hiresift.llm.html_text import main_text

TEXT = "This is the text of the article and it is long enough to be kept by the rules of the blocks."
BODY = f"<p>{TEXT}</p>"


@pytest.mark.parametrize(
    "tag",
    [
        'div style="overflow:hidden"', 'section title="a hidden place"', 'div data-hidden="false"', "div data-x='class=\"footer\"'",
        'div title=" id=sidebar "', 'p data-class="footer"', 'div aria-hidden="false"', 'div alt="aria-hidden=true"',
    ],
)
def test_values_and_longer_names_are_no_attributes(tag):
    name = tag.split()[0]
    assert main_text(f"<html><body><{tag}>{TEXT}</{name}></body></html>") == TEXT


@pytest.mark.parametrize("tag", ["div hidden", "div HIDDEN=''", "div class=footer", 'div title="x" id="sidebar"', "div aria-hidden = 'true'", "div a=b hidden"])
def test_real_attributes_count(tag):
    assert main_text(f"<html><body>{BODY}<{tag}>{TEXT.upper()}</div></body></html>") == TEXT


@pytest.mark.parametrize("root", ["html class='has-sidebar sidebar'", "html hidden"])
def test_root_is_never_boilerplate(root):
    assert main_text(f"<{root}><body>{BODY}</body></html>") == TEXT


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><body>{BODY}</body></html>",
        f"<html><head><meta charset=utf-8><title>T</title>{BODY}</html>",
        f"<head><title>T</title><h1></h1>{TEXT}",
        f"<head><title>T</title><br>{TEXT}",
        f"<head><title>T</title> {TEXT}",
        f"<head><title>The <p> tag and text of it that is long enough to stay</title><link rel=x>{BODY}",
        f"<head><title>T<body>{BODY}</body>",
    ],
)
def test_head_without_end_tag(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page", [f"<svg width='1' d=\"a>b\"/>{BODY}", f"<math/>{BODY}<svg><text>x</text></svg>", f"<svg />{BODY}<svg><path/></svg>"])
def test_self_closed_drawings_are_empty(page):
    assert main_text(page) == TEXT


LONG = "The end of the day was near and it was time for all of us to go home, as we had been at work for too long in the heat of the sun."


@pytest.mark.parametrize(
    "name",
    [
        "content has-sidebar", "no-sidebar", "with-sidebar", "post comments-open", "entry share-enabled", "post-content nav-open", "page widget-area",
        "main-banner-layout", "sidebar-layout content", "comments",
    ],
)
def test_names_of_layout_leave_the_body(name):
    page = f'<body><nav><a href=a>Home</a></nav><div class="{name}"><h1>Title</h1><p>{LONG}</p><p>So it is.</p><p>{LONG}</p></div><footer>{LONG}</footer></body>'
    assert main_text(page) == f"Title\n\n{LONG}\n\nSo it is.\n\n{LONG}"


@pytest.mark.parametrize("name", ["widget-guide", "share-price", "alert-level", "login-tutorial", "menu_planning"])
def test_names_that_begin_like_boilerplate_stay(name):
    assert main_text(f'<body><article><p>{LONG}</p><div class="{name}"><p>{LONG} x</p></div></article></body>') == f"{LONG}\n\n{LONG} x"


def test_a_named_body_still_loses_the_named_containers_inside():
    inside = f'<div class="comments"><p>{LONG} c</p></div><div class="sidebar"><p>{LONG} s</p></div>'
    assert main_text(f'<body><div class="widget-area"><p>{LONG}</p><p>{LONG}</p>{inside}</div></body>') == f"{LONG}\n\n{LONG}"


def test_comments_longer_than_the_text_go():
    comments = f"<p>{LONG}</p>" * 9
    assert main_text(f'<body><div><p>{LONG} x</p></div><section class="comments">{comments}</section></body>') == f"{LONG} x"
    assert main_text(f'<body><article><p>Short.</p></article><section class="comment-list">{comments}</section></body>') == "Short."


def test_article_cards_do_not_outlaw_a_larger_body():
    page = f'<body><div class="post"><p>{LONG}</p><p>{LONG}</p></div><article><p>{LONG} card</p></article></body>'
    assert main_text(page).startswith(f"{LONG}\n\n{LONG}")


@pytest.mark.parametrize(
    ("shape", "after", "seconds"),
    [
        ("<p", "", 1), ('<a "', "", 1), ("<svg ", "", 1), ("<!--", "", 1), ("<![CDATA[", "", 1), ("</", "", 1), ("<a =", ">", 1), ("<script>", "", 1), ("&", "", 1),
        ('<a ">" ', '"', 9), ("<a \"'>", "", 9), ("<svg>", "", 9), ("<", "", 9), ("<i><p></p>", "", 9), ("</svg ", "<svg>", 9), ("<head><body>", "", 9),
    ],
)
def test_hostile_pages_cost_time_in_proportion(shape, after, seconds):
    page = shape * (1_000_000 // len(shape)) + after
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < seconds


def test_deep_inline_nesting_and_endless_references():
    began = time.process_time()
    assert main_text("<b><div>" + "<i>" * 100_000 + "</b>" * 100_000 + f"<p>{LONG}</p>" * 3) == "\n\n".join([LONG] * 3)
    assert main_text("<div>" + "<i>" * 100_000 + f"<p>{LONG}</p>" * 1000) == "\n\n".join([LONG] * 1000)
    assert main_text(f"<p>&#{'9' * 100_000}; {LONG}</p>") == f"\ufffd {LONG}"
    assert time.process_time() - began < 15


@pytest.mark.parametrize("page", [f'<p title="x>{TEXT}</p>', f"<div><svg><path d=x>{BODY}</div>{BODY}", f"{BODY}<p>{TEXT}</p><div class=\"x", f"{BODY}<script>{TEXT}"])
def test_markup_that_does_not_close_keeps_the_text(page):
    assert TEXT in main_text(page) and "<" not in main_text(page) and "class" not in main_text(page)
