"""Very many terms found in one pass over a text, and regular expressions that are tried only where they can match."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from operator import itemgetter
from re import _constants as codes
from re import _parser as parser

import ahocorasick

ASCII_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def word_guard(text: str, begin: int, end: int) -> bool:
    """No ASCII letter or digit before; after a term that ends in a letter or digit no word character, else no ASCII one."""
    if begin and text[begin - 1] in ASCII_WORD:
        return False
    if end == len(text):
        return True
    after = text[end]
    return after not in ASCII_WORD if not text[end - 1].isalnum() else not (after.isalnum() or after == "_")


def no_guard(text: str, begin: int, end: int) -> bool:
    return True


#: A guard by name, and whether the automaton itself wants spaces around its terms.
GUARDS = {"word": (word_guard, False), "space": (no_guard, True), "none": (no_guard, False)}


class Terms:
    """An automaton over distinct terms, each known by its place in the list; ``spaced`` ones stand between spaces or ends."""

    def __init__(self, terms: Iterable[str], spaced: bool = False):
        self.terms = list(terms)
        self.edge = " " if spaced else ""
        self.automaton = ahocorasick.Automaton()
        for place, term in enumerate(self.terms):
            if term:
                self.automaton.add_word(self.edge + term + self.edge, (place, len(term)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> set[int]:
        """Places of the terms that stand anywhere in the text."""
        return {place for _, (place, _) in self.automaton.iter(self.edge + text + self.edge)} if len(self.automaton) else set()

    def spans(self, text: str, guard=no_guard) -> list[tuple[int, int, int]]:
        """(begin, end, place) of every occurrence between guards, overlapping ones too, by where they end."""
        if not len(self.automaton):
            return []
        # With a space before the text, an occurrence and the space behind it end one place later each.
        back = 2 * len(self.edge) - 1
        every = ((last - back - size, last - back, place) for last, (place, size) in self.automaton.iter(self.edge + text + self.edge))
        return [s for s in every if guard(text, s[0], s[1])]


#: Marks of a text's places, lone surrogates, which no valid text holds: a term may begin, a term without a letter at its end may end, any term may end.
_BEGIN, _SOFT_END, _END = "\ud800", "\ud801", "\ud802"
#: Distinct characters beyond ASCII letters and digits up to which a text is marked by one replacement each.
_REPLACED = 40


class _Marks(dict):
    """Characters with their marks: an end before and a beginning behind all but ASCII letters and digits."""

    def __missing__(self, code: int) -> str:
        x = chr(code)
        self[code] = x if x in ASCII_WORD else (_SOFT_END if x.isalnum() or x == "_" else _END) + x + _BEGIN
        return self[code]


class WordTerms:
    """Occurrences of distinct terms between the guards of words, counted in one pass over a marked text.

    What ``word_guard`` asks about the characters around an occurrence is told by marks
    that terms hold too, so the automaton itself reports only what stands between guards.
    """

    def __init__(self, terms: Iterable[str]):
        self.marks = _Marks()
        self.automaton = ahocorasick.Automaton()
        for place, term in enumerate(terms):
            for end in ((_END,) if term[-1:].isalnum() else (_SOFT_END, _END)) if term else ():
                self.automaton.add_word(_BEGIN + term.translate(self.marks) + end, place)
        if len(self.automaton):
            self.automaton.make_automaton()

    def marked(self, text: str) -> str:
        others = set(text) - ASCII_WORD
        if len(others) > _REPLACED:
            return _BEGIN + text.translate(self.marks) + _END
        for x in others:
            text = text.replace(x, self.marks[ord(x)])
        return _BEGIN + text + _END

    def counts(self, text: str) -> Counter[int]:
        """Occurrences by the terms' places, overlapping ones too."""
        return Counter(map(itemgetter(1), self.automaton.iter(self.marked(text)))) if len(self.automaton) else Counter()


def counter(terms: list[str], guard: str) -> Callable[[str], Counter[int]]:
    """A function that counts the occurrences of terms in a text by their places, between guards of that name."""
    if guard == "word":
        return WordTerms(terms).counts
    check, spaced = GUARDS[guard]
    spans = Terms(terms, spaced).spans
    return lambda text: Counter(p for _, _, p in spans(text, check))


def leftmost_longest(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans from left to right, of those with one begin the longest, without any that overlaps one taken before."""
    taken, end = [], 0
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        if span[0] >= end:
            taken.append(span)
            end = span[1]
    return taken


def required(pattern: str, flags: int = re.I) -> frozenset[str] | None:
    """Lower-case literals of which every match of the pattern has one; None where none is sure.

    A match is looked for in a lower-cased text, so only literals without case of
    their own or in ASCII are trusted.
    """
    best = _required(parser.parse(pattern, flags))
    return best and frozenset(best)


def _score(literals: frozenset[str]) -> tuple[int, int]:
    return min(map(len, literals)), -len(literals)


def _required(items) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        if op is codes.LITERAL and chr(value).isascii():
            run += chr(value).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = None
        if op is codes.SUBPATTERN:
            inner = _required(value[-1])
        elif op is codes.ATOMIC_GROUP:
            inner = _required(value)
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _required(value[2])
        elif op is codes.BRANCH:
            branches = [_required(b) for b in value[1]]
            inner = frozenset().union(*branches) if all(branches) else None
        if inner:
            found.append(inner)
    return max(found, key=_score, default=None)


class FirstPattern:
    """The first of an ordered list of patterns that matches a text, tried only where a literal that it needs is there."""

    def __init__(self, patterns: Iterable[str]):
        self.patterns = [re.compile(p, re.I) for p in patterns]
        needed = [required(p.pattern) for p in self.patterns]
        self.always = [i for i, n in enumerate(needed) if not n]
        literals = sorted({x for n in needed if n for x in n})
        self.literals = Terms(literals)
        self.of_literal: list[list[int]] = [[] for _ in literals]
        at = {x: i for i, x in enumerate(literals)}
        for i, n in enumerate(needed):
            for x in n or ():
                self.of_literal[at[x]].append(i)
        self.tried = 0

    def first(self, text: str) -> int | None:
        possible = {i for literal in self.literals.found(text.lower()) for i in self.of_literal[literal]}
        for i in sorted(possible.union(self.always)):
            self.tried += 1
            if self.patterns[i].search(text):
                return i
        return None
