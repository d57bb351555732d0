"""Repair of text taken from PDF files: lost accents and line breaks, broken and glued words.

Words are rejoined by a vocabulary with counts: a run of words becomes the sequence of
known words that costs least, by one pass over its fragments. Only fragments that are no
words themselves are touched, so a text of known words stays as it is.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hiresift.functions.arrow import map_strings

#: Words of a vocabulary that are shipped to the tasks, the most frequent; more than a language's common ones.
MOST_WORDS = 300_000
#: Fragments that one word is broken into at most, and characters of a piece of a glued word at least.
MOST_FRAGMENTS, LEAST_PIECE = 4, 3
#: Cost of an unknown fragment: so much, and so much a character, in natural logarithms; and of each join and cut.
UNKNOWN, UNKNOWN_CHARACTER, JOIN = 12.0, 1.5, 0.5

# Accents that stand apart from their letters, and the letters together.
ACCENTS = {
    "´": {"e": "é", "E": "É", "a": "á", "A": "Á", "o": "ó", "O": "Ó", "u": "ú", "U": "Ú", "i": "í", "I": "Í"},
    "`": {"e": "è", "E": "È", "a": "à", "A": "À", "o": "ò", "O": "Ò", "u": "ù", "U": "Ù"},
    "ˆ": {"e": "ê", "E": "Ê", "a": "â", "A": "Â", "o": "ô", "O": "Ô", "u": "û", "U": "Û"},
    "ˇ": {"e": "ě", "c": "č", "s": "š", "z": "ž"},
    "¸": {"c": "ç", "C": "Ç"},
}
# Titles of sections that stand on a line of their own when they are in capitals.
SECTIONS = (
    "EXPERIENCES?", "EXPÉRIENCES?", "FORMATIONS?", "DIPL[OÔ]MES?", "[EÉ]TUDES?", "COMP[EÉ]TENCES?", "SKILLS", "LANGUES?", "CERTIFICATIONS?", "PROJETS?", "PARCOURS", "PROFIL",
    "[EÉ]DUCATION", "SCOLARIT[EÉ]", "CONTACT", "R[EÉ]F[EÉ]RENCES?", "PUBLICATIONS?",
)

_RUN = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)*")
_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zà-öø-ÿ"


def structured(text: Column) -> Column:
    """A text with composed accents and with line breaks before section titles, years, names behind years and bullets; null stays null."""
    out = text
    for accent, letters in ACCENTS.items():
        for letter, whole in letters.items():
            out = F.regexp_replace(out, rf"{accent}\s*{letter}", whole)
    steps = (
        (f"\ufffd(?=[{_UPPER}])", " - "),
        (rf"(?<!\n)\s+({'|'.join(SECTIONS)})(?![\p{{L}}\p{{N}}_])", "\n\n$1\n"),
        (rf"(\d{{4}}|[Pp]resent|[Aa]ctuel)([{_UPPER}][{_LOWER}])", "$1\n$2"),
        (rf"([{_LOWER}])(\d{{4}})\b", "$1\n$2"),
        ("[║╔╗╚╝═╠╣╬◆→]", ""),
        (r"[^\S\n]{2,}", " "),
        ("\\s*([•●►▪✓\u007f])\\s*", "\n• "),
        (r"\s+—\s+", "\n— "),
        (r"\n{3,}", "\n\n"),
    )
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def vocabulary(texts: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """(word, n): lower-case words of letters that occur at least so often."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Joiner:
    """Known words with what they cost."""

    def __init__(self, counts: dict[str, int]):
        total = math.log(max(1, sum(counts.values())))
        self.cost = {w: total - math.log(n) for w, n in counts.items()}

    def word(self, fragments: list[str]) -> tuple[float, str] | None:
        """Cost and text of fragments as one word, None where they are none."""
        joined = "".join(fragments)
        low = joined.lower()
        known = self.cost.get(low)
        if len(fragments) > 1:
            if known is None or all(f.lower() in self.cost for f in fragments):
                return None
            return known + JOIN * (len(fragments) - 1), joined
        if known is not None:
            return known, joined
        best = (UNKNOWN + UNKNOWN_CHARACTER * len(joined), joined)
        for at in range(LEAST_PIECE, len(joined) - LEAST_PIECE + 1):
            a, b = self.cost.get(low[:at]), self.cost.get(low[at:])
            if a is not None and b is not None:
                best = min(best, (a + b + JOIN, f"{joined[:at]} {joined[at:]}"))
        return best

    def run(self, fragments: list[str]) -> str:
        """The cheapest sequence of words that the fragments make; of equals the one with the later last cut."""
        best: list[tuple[float, int, str]] = [(0.0, 0, "")]
        costs = [self.cost.get(f.lower()) for f in fragments]
        unknown = -1
        for end in range(1, len(fragments) + 1):
            found, known = None, costs[end - 1]
            if known is None:
                unknown = end - 1
            else:
                found = (best[end - 1][0] + known, end - 1, fragments[end - 1])
            # Known words alone are never joined, so only stretches that hold an unknown one are looked up.
            last = end - 1 if known is None else min(end - 2, unknown)
            for begin in range(last, max(-1, end - 1 - MOST_FRAGMENTS), -1):
                own = self.word(fragments[begin:end])
                if own and (found is None or best[begin][0] + own[0] < found[0]):
                    found = (best[begin][0] + own[0], begin, own[1])
            best.append(found)
        out, at = [], len(fragments)
        while at:
            _, begin, text = best[at]
            out.append(text)
            at = begin
        return " ".join(reversed(out))

    def repaired(self, text: str) -> str:
        def fixed(match: re.Match) -> str:
            fragments = match[0].split(" ")
            return match[0] if all(f.lower() in self.cost for f in fragments) else self.run(fragments)

        return _RUN.sub(fixed, text)


def rejoined(texts: DataFrame, words: DataFrame, text: str = "text", into: str = "repaired", most: int = MOST_WORDS) -> DataFrame:
    """The rows with their texts' broken words rejoined and glued ones cut, by a vocabulary (word, n); null stays null."""
    counts = {r.word: r.n for r in words.orderBy(F.col("n").desc(), "word").limit(most).collect()}

    def start():
        joiner = Joiner(counts)
        return lambda values: [None if v is None else joiner.repaired(v) for v in values]

    return map_strings(texts, [text], into, StringType(), start)
