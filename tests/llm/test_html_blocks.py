"""The two passes of the block rules against a plain version of them, and pages that need either."""

import random

import pytest

from hiresift.llm import html_text
from hiresift.llm.html_text import BAD, GOOD, OPEN, STOP_WORDS, blocks, classify, first_pass, main_text

LONG = "The end of the day was near and it was time for all of us to go home, as we had been at work for too long in the heat of the sun."


def pages(seed, n, article):
    rng = random.Random(seed)
    sentence = lambda k: " ".join(rng.choice(["the", "of", "and", "to", "in", "stone", "river", "amber", "walks", "seldom"]) for _ in range(k))
    out = []
    for _ in range(n):
        body = [f"<h1>{sentence(5)}</h1>"]
        for _ in range(rng.randrange(1, 9)):
            kind = rng.random()
            if kind < 0.5:
                body.append(f"<p>{sentence(rng.randrange(12, 60))}</p>")
            elif kind < 0.75:
                body.append(f"<p>{sentence(rng.randrange(1, 4))}</p>")
            elif kind < 0.85:
                body.append(f"<h2>{sentence(3)}</h2>")
            else:
                body.append("<ul>" + "".join(f"<li><a href=x>{sentence(3)}</a></li>" for _ in range(4)) + "</ul>")
        tag = rng.choice(["article", "main"]) if article else "div"
        out.append(
            f"<html><head><title>t</title></head><body><nav><a href=a>{sentence(2)}</a></nav><div>{sentence(2)}</div>"
            f"<{tag}>{''.join(body)}</{tag}><div class='ad'>{sentence(20)}</div><div>{sentence(30)}</div><footer>{sentence(9)}</footer></body></html>"
        )
    return out


def plain_first(block):
    words = block.text.lower().split()
    stops = len([w for w in words if w.strip(".,;:!?") in STOP_WORDS]) / len(words)
    share = block.linked / len(block.text)
    if block.bad or share > 0.5:
        return BAD
    if block.heading or len(block.text) < 40:
        return OPEN
    if share <= 0.2 and (stops >= 0.25 or (len(block.text) >= 120 and stops >= 0.08)):
        return GOOD
    return BAD if share > 0.2 and stops == 0 else OPEN


def plain_labels(own):
    first = [plain_first(b) for b in own]
    good = [(b.main > 0, len(b.text)) for b, label in zip(own, first) if label == GOOD]
    within = sum(n for main, n in good if main)
    if within > 0 and within >= sum(n for main, n in good if not main):
        first = [label if b.main else BAD for b, label in zip(own, first)]
    out = []
    for i, b in enumerate(own):
        if first[i] != OPEN:
            out.append(first[i])
            continue

        def side(places):
            for j in places:
                if b.main and own[j].main != b.main:
                    return None
                if first[j] != OPEN and not own[j].bad:
                    return j
            return None

        left, right = side(range(i - 1, -1, -1)), side(range(i + 1, len(own)))
        known = [j for j in (left, right) if j is not None]
        if not known:
            out.append(GOOD if b.main or len(b.text) >= 40 else BAD)
        elif len(known) == 1:
            out.append(first[known[0]])
        elif b.heading:
            out.append(first[right])
        elif first[left] == first[right] or i - left != right - i:
            out.append(first[min(known, key=lambda j: abs(i - j))])
        else:
            out.append(BAD)
    return out


@pytest.mark.parametrize("article", [True, False])
def test_passes_equal_a_plain_version(article):
    by_first = by_second = 0
    for page in pages(3, 150, article):
        own, containers = blocks(page)
        assert classify(own, containers) == plain_labels(own)
        first = [first_pass(b) for b in own]
        by_first += sum(label == GOOD for label in first) + sum(label == BAD and not b.bad for label, b in zip(first, own))
        by_second += sum(label == OPEN for label in first)
    assert by_first > 300 and by_second > 200


def test_density_decides_without_an_article_element():
    page = (
        "<body><div><a href=a>Home</a> <a href=b>News of the day</a></div><div><h1>Title</h1><div>"
        f"{LONG}</div><div>So it is.</div><div>{LONG}</div><ul><li><a href=x>More of the same</a></li><li><a href=y>And of that</a></li></ul></div>"
        "<div>stone | river | <a href=z>amber and much more of it</a></div></body>"
    )
    assert main_text(page) == f"Title\n\n{LONG}\n\nSo it is.\n\n{LONG}"


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<div class="entry-header"><h1>Its title</h1></div>', "Its title"),
        ("<header><h1>Its title</h1></header>", "Its title"),
        (f'<p class="related-work">{LONG}</p>', LONG),
        ("<p>One line<br>and the next</p>", "One line and the next"),
        ("<p>One line<br/> <br>and the next</p>", "One line\n\nand the next"),
        ("<p>Fr&eacute;d&#233;ric &amp;&nbsp;co</p>", "Frédéric & co"),
        ("<p>Twice.</p><p>Twice.</p>", "Twice.\n\nTwice."),
    ],
)
def test_text_inside_an_article_stays(inside, text):
    assert main_text(f"<body><article>{inside}<p>{LONG}</p></article></body>") == f"{text}\n\n{LONG}"


@pytest.mark.parametrize(
    "outside",
    [
        f'<div class="site-header">{LONG}</div>', f'<div id="sidebar-left">{LONG}</div>', f'<section class="comments">{LONG}</section>',
        f'<div class="related-posts">{LONG}</div>', f"<form><p>{LONG}</p></form>", f'<div class="cookie-notice">{LONG}</div>', f"<aside>{LONG}</aside>",
    ],
)
def test_named_boilerplate_goes(outside):
    assert main_text(f"<body><article><p>{LONG}</p>{outside}</article></body>") == LONG
    assert main_text(f"<body>{outside}<div><p>{LONG} x</p></div></body>") == f"{LONG} x"


def test_tables_with_clashing_columns_and_very_long_pages(spark):
    schema = "page_id long, text string, html string, label string"
    empty = html_text.extract(spark.createDataFrame([], schema))
    assert empty.count() == 0 and set(empty.columns) == {"page_id", "html", "label", "text"}
    long_page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "old", long_page, "x"), (2, None, None, None), (None, "old", "<p>a", "x"), (3, "old", "<p>" + "a" * 1_000_000, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == "\n\n".join([LONG] * 20_000) and got[2] == "" and got[None] == "" and len(got[3]) == 1_000_000
