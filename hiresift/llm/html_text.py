"""Main text of HTML pages by two-pass block rules.

The markup is cut into blocks at block-level tags and at two line breaks in a
row; one line break is white space. Scripts, styles, comments of the markup,
forms' controls and the head are no blocks.

First pass, each block for itself: one that is mostly links, or that stands in an
element for boilerplate (nav, footer, ...), is boilerplate; a long one with some
stop words, or a shorter one with many, and few links is main text; a long one
without any stop word and with links is boilerplate. Short and undecided blocks
stay open. Class and id names that consist of words for boilerplate (menu, advert,
comments, ...) and of words for layout make the blocks inside boilerplate too, as no
density tells a comment from a paragraph. But where by density the page's body can
only stand in such a container, as it holds all main text or all but a small part and
no article or main element stands outside, its name does not count; comments are taken
for the body only where they hold all main text.

Second pass: an open block inherits the label of its nearest decided neighbour, a
heading that of the one after it; between two unlike ones at one distance it is
boilerplate. Blocks that a container names say nothing of those beside it. An
article or main element only sets the reach of neighbours: a block inside one
looks for neighbours inside, and counts as main text where none is decided. Where
the first pass has found at least as much main text inside such elements as outside,
what stands outside of all of them is boilerplate.

The markup is read forward only, each character a bounded number of times, so a page
costs time in proportion to its length whatever stands in it. A tag whose quotes do
not close ends at its first ">"; one that no ">" follows is dropped with what is
behind it. Numeric references of more digits than any character has become U+FFFD.

Stop words are the most frequent short words of the languages that pages are
written in. A null or empty page, and one without main blocks, gives the empty
text. Repeated rows give equal texts, equal blocks of a page are all kept. All
other columns are kept, but for one named like the result, which is replaced.
"""

from __future__ import annotations

import html as html_library
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from .common import map_texts

# Names of HTML.
SILENT = frozenset("script style noscript template svg math head iframe object canvas audio video textarea select button option".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
#: Tags that leave an open head open; its end tag is optional, so any other start tag and any text end it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_PEER = HEADINGS | frozenset("p li td th tr dt dd".split())
# Words of class and id names that name boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner banners promo promos promoted promotion promotions sponsor sponsors sponsored "
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar sidebars widget widgets "
    "comment comments commentlist discuss discussion replies respond cookie cookies consent gdpr alert alerts newsletter newsletters subscribe subscription "
    "popup modal overlay share sharing login signup copyright pagination pager toolbar".split()
)
#: Those of them that name what readers wrote.
COMMENT_WORDS = frozenset("comment comments commentlist discuss discussion replies respond".split())
# Words that name boilerplate only beside no others than words for layout.
BOILERPLATE_WHOLE = frozenset("header side notice notices social related recommend recommended recommendations search skip hidden reply".split())
# Words for layout, which say nothing of what is inside.
LAYOUT_WORDS = frozenset(
    "site page top bottom main global blog legal privacy box bar link links post posts article articles stories item items news content form list lists icon "
    "icons media button buttons btn left right to wrapper wrap container inner outer area section block row col column panel group region zone slot unit "
    "header title heading body text message info primary secondary fixed sticky mobile desktop small large first last inline thread tree count author meta "
    "field fields input label image img close policy settings notice strip level1 level2".split()
)
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on as with by be are this at from an not or he they "
    "le la les de des du un une et en est que qui dans pour sur pas par au avec ou elle il se "
    "der die das und in zu den von mit ist des im für auf ein eine nicht dem sich als auch es an "
    "el los las de la que y en un una por con para su al lo como del se no es".split()
)

# Elements whose content is no markup, and others that are skipped up to their end tag if they have one.
RAW = frozenset("script style textarea iframe".split())
SKIPPED = frozenset("noscript template svg math".split())
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW | SKIPPED}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile("[\"'>]")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_SPACE = re.compile(r"\s+")

#: Share of a block's characters in links from which it is boilerplate, and from which it is no main text by itself.
LINKED, SOME_LINKS = 0.5, 0.2
#: Characters of a long block, and of one that many stop words can decide.
LONG, SHORT = 120, 40
#: Share of stop words of which a block holds many, and some.
STOP_HIGH, STOP_LOW = 0.25, 0.08
#: A named container is the page's body where it holds so many times the main text outside of named containers.
DOMINANT = 4

GOOD, BAD, OPEN = 1, 0, -1


class _Block:
    __slots__ = ("parts", "linked", "main", "bad", "named", "heading", "text")

    def __init__(self, main: int, bad: bool, named: int, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        #: numbers of the outermost article or main element and of the innermost named container around it, 0 for none
        self.main, self.named = main, named
        self.bad, self.heading = bad, heading
        self.text = ""


def _attributes(rest: str) -> Iterator[tuple[str, str]]:
    for match in _ATTRIBUTE.finditer(rest):
        yield match[1].lower(), (match[2] or match[3] or match[4] or "").lower()


def _hidden_or_aside(attributes: list[tuple[str, str]]) -> bool:
    """Attributes that say outright that an element is not shown or not the content."""
    for name, value in attributes:
        if name == "role":
            if value in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form"):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def name_words(attributes: list[tuple[str, str]]) -> frozenset[str]:
    """The words of the first class or id name that names boilerplate; empty if none does.

    All words of such a name are for boilerplate or layout: "sidebar-left" names it, "has-sidebar" and "share-price" do not.
    """
    for name, value in attributes:
        if name in ("class", "id"):
            for own in value.split():
                words = frozenset(w for w in re.split(r"[_\-]+", own.strip("_-")) if not w.isdigit())
                found = words & BOILERPLATE_WORDS or words & BOILERPLATE_WHOLE
                if found and words <= BOILERPLATE_WORDS | BOILERPLATE_WHOLE | LAYOUT_WORDS:
                    return found
    return frozenset()


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", data, ""), ("open", name, rest of the tag) and ("close", name, "") in page order.

    Comments and declarations give nothing, nor do elements without markup inside;
    of these only the line of blocks that they interrupt is told, by ("skip", name, "").
    """
    at, size = 0, len(page)
    last_end = page.rfind(">")
    #: places of quotes and ends of tags, met outside of quotes, from which no end can be reached
    endless: set[int] = set()
    unended: set[str] = set()

    def end_of_tag(begin: int) -> int:
        met, place = [], begin
        while (special := _QUOTE_OR_END.search(page, place)) and special.start() not in endless:
            place = special.start()
            if page[place] == ">":
                return place
            met.append(place)
            place = page.find(page[place], place + 1) + 1
            if not place:
                break
        endless.update(met)
        return page.find(">", begin)

    text_from = at
    while (begin := page.find("<", at)) >= 0:
        following = page[begin + 1 : begin + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                after = size if end < 0 else end + 3
                data = ""
            elif page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin + 9)
                after = size if end < 0 else end + 3
                data = html_library.escape(page[begin + 9 : size if end < 0 else end])
            else:
                after, data = (page.find(">", begin) + 1 if begin < last_end else size), ""
            yield "text", page[text_from:begin], ""
            yield "text", data, ""
            at = text_from = after
            continue
        close = following == "/"
        named = _NAME.match(page, begin + 1 + close)
        if not named:
            at = begin + 1
            continue
        yield "text", page[text_from:begin], ""
        if begin > last_end:
            return
        end = end_of_tag(named.end())
        name, rest = named[0].lower(), page[named.end() : end]
        at = text_from = end + 1
        if close:
            yield "close", name, ""
        elif name in _END and not (name in ("svg", "math") and rest.endswith("/")):
            found = None if name in unended else _END[name].search(page, at)
            if found:
                at = text_from = found.end()
                yield "skip", name, ""
            elif name in RAW:
                yield "skip", name, ""
                return
            else:
                unended.add(name)
                yield "open", name, rest
        else:
            yield "open", name, rest
    yield "text", page[text_from:], ""


def blocks(page: str) -> tuple[list[_Block], list[tuple[int, bool]]]:
    """Blocks of a page in page order, each with what stands around it.

    Beside them the named containers, each with the next one around it and whether it
    is for comments; the first place of the list is taken by no container.
    """
    found: list[_Block] = []
    containers: list[tuple[int, bool]] = [(0, False)]
    #: name, place of the innermost block element, number of the main element and named container around it,
    #: then counts over it and all around it: boilerplate, silent, link, heading
    stack: list[tuple[str, int, int, int, int, int, int, int]] = []
    outside = ("", -1, 0, 0, 0, 0, 0, 0)
    places: defaultdict[str, list[int]] = defaultdict(list)
    block: _Block | None = None
    mains = 0
    broken = False

    def add(data: str) -> None:
        nonlocal block, broken
        if stack and stack[-1][0] == "head" and data.strip():
            leave(len(stack) - 1)
        _, _, main, named, bad, silent, links, headings = stack[-1] if stack else outside
        if silent or not data:
            return
        data = html_library.unescape(_LONG_REFERENCE.sub("\ufffd", data))
        solid = not data.isspace()
        if block is None:
            if not solid:
                return
            block = _Block(main, bad > 0, named, headings > 0)
            found.append(block)
        block.parts.append(data)
        if solid:
            broken = False
        if links:
            block.linked += len(data.strip())

    def leave(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()[0]].pop()

    for kind, name, rest in tokens(page):
        if kind == "text":
            add(name)
            continue
        if kind == "skip":
            continue
        if name == "br":
            if block is not None:
                block.parts.append(" ")
                block = None if broken else block
            broken = True
        elif name not in INLINE:
            block = None
        if kind == "close":
            # An inline end tag never closes a block.
            if places[name] and not (name in INLINE and places[name][-1] < stack[-1][1]):
                leave(places[name][-1])
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            leave(len(stack) - 1)
        elif name == "body" and places["head"]:
            leave(places["head"][0])
        if name not in VOID and not rest.endswith("/"):
            if name in CLOSES_PEER and stack and stack[-1][1] >= 0:
                peer = "p" if name in HEADINGS else name
                if stack[stack[-1][1]][0] == peer:
                    leave(stack[-1][1])
            around = stack[-1] if stack else outside
            main, named = around[2:4]
            if name in MAIN and not main:
                mains += 1
                main = mains
            attributes = list(_attributes(rest)) if name not in MAIN and name not in ("html", "body") else []
            # The header of an article holds its title.
            boilerplate = (name in BOILERPLATE and not (name == "header" and main)) or _hidden_or_aside(attributes)
            words = name_words(attributes)
            if words:
                containers.append((named, words <= COMMENT_WORDS))
                named = len(containers) - 1
            own = (boilerplate, name in SILENT, name == "a", name in HEADINGS)
            place = len(stack) if name not in INLINE else around[1]
            places[name].append(len(stack))
            stack.append((name, place, main, named, *(a + b for a, b in zip(around[4:], own, strict=True))))
    for own_block in found:
        own_block.text = _SPACE.sub(" ", "".join(own_block.parts)).strip()
    return [b for b in found if b.text], containers


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: _Block) -> int:
    """Label of a block by its elements, link density, length and stop-word density; OPEN where these leave it."""
    size = len(block.text)
    linked = block.linked / max(1, size)
    if block.bad or linked > LINKED:
        return BAD
    if size < SHORT or block.heading:
        return OPEN
    stops = stop_density(block.text)
    if linked <= SOME_LINKS and (stops >= STOP_HIGH or size >= LONG and stops >= STOP_LOW):
        return GOOD
    return BAD if linked > SOME_LINKS and stops == 0 else OPEN


def heed_names(own: list[_Block], labels: list[int], containers: list[tuple[int, bool]]) -> list[int]:
    """The labels, with blocks in named containers marked boilerplate, but for a container that holds the page's body."""
    main_in: Counter = Counter()
    all_in: Counter = Counter()
    in_main: dict[int, bool] = defaultdict(bool)
    for b, label in zip(own, labels, strict=True):
        if label != BAD:
            main_in[b.named] += len(b.text) * (label == GOOD)
            all_in[b.named] += len(b.text)
            in_main[b.named] |= b.main > 0
    free, free_all = main_in.pop(0, 0), all_in[0]
    body = max(main_in, key=lambda c: (main_in[c], -c), default=0)
    holds_all = free == 0 if containers[body][1] else free * DOMINANT <= main_in[body]
    if not (holds_all and main_in[body] and all_in[body] > free_all and in_main[body] >= in_main[0]):
        body = 0
    counts_not = {0}
    while body:
        counts_not.add(body)
        body = containers[body][0]
    named = [False] * len(containers)
    for c in range(1, len(containers)):
        named[c] = named[containers[c][0]] or c not in counts_not
    for b in own:
        b.bad = b.bad or named[b.named]
    return [BAD if named[b.named] else label for b, label in zip(own, labels, strict=True)]


def second_pass(own: list[_Block], labels: list[int]) -> list[int]:
    """The labels, with those of open blocks inherited from their nearest decided neighbours."""
    held = Counter()
    for b, label in zip(own, labels, strict=True):
        if label == GOOD:
            held[b.main > 0] += len(b.text)
    confirmed = held[True] > 0 and held[True] >= held[False]
    labels = [BAD if confirmed and not b.main else label for b, label in zip(own, labels, strict=True)]
    size = len(labels)
    before: list[int | None] = [None] * size
    after: list[int | None] = [None] * size
    for places, side in ((range(size), before), (range(size - 1, -1, -1), after)):
        last: int | None = None
        for i in places:
            last = i if labels[i] != OPEN and not own[i].bad else last
            # A block inside a main element has its neighbours inside.
            if last is not None and own[i].main in (0, own[last].main):
                side[i] = last
    decided = []
    for i, label in enumerate(labels):
        left, right = before[i], after[i]
        if label != OPEN:
            decided.append(label)
        elif left is None and right is None:
            decided.append(GOOD if own[i].main or len(own[i].text) >= SHORT else BAD)
        elif left is None or right is None:
            decided.append(labels[right if left is None else left])
        elif own[i].heading or labels[left] == labels[right]:
            decided.append(labels[right])
        elif right - i != i - left:
            decided.append(labels[right if right - i < i - left else left])
        else:
            decided.append(BAD)
    return decided


def classify(own: list[_Block], containers: list[tuple[int, bool]]) -> list[int]:
    """Label of each block: main text or boilerplate."""
    return second_pass(own, heed_names(own, [first_pass(b) for b in own], containers))


def main_text(page: str) -> str:
    """Main blocks of a page joined by blank lines."""
    own, containers = blocks(page)
    return "\n\n".join(b.text for b, label in zip(own, classify(own, containers), strict=True) if label == GOOD)


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """The rows with the main text of the whole page."""

    def start():
        return lambda texts: pa.array([main_text(t) for t in texts], pa.string())

    return map_texts(pages, column, into, StringType(), start)
