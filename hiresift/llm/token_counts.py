"""Token counts of whole texts, huge ones by overlap resynchronisation.

Texts up to ``CHUNK`` characters are encoded by the library as they are. A longer
one is encoded in chunks that overlap, with the offsets of the tokens, and two
neighbouring chunks are spliced at a common boundary in their overlap. Where an
overlap has none it is widened, up to the last proven boundary; where even that
leaves none (one pre-token fills the whole chunk) the chunk itself grows to twice
its length, so that any text costs a bounded multiple of one encoding.

A boundary is a place where both chunks end a pre-token and begin another. It is
proven stable:

* the pre-tokens are the matches of a pattern without look-behind, found from
  left to right, so that two scans that begin a match at one place find the same
  ones from there on, and merges never cross pre-tokens;
* it lies further from the ends of the overlap than the longest added token is
  long, so that neither chunk has cut one in two there;
* no character composes with one before it across the boundary, and the one there
  does not become several in lower case, which would blur the offsets; the other
  normalisations (white space, lower case) work on each character alone.

That holds for vocabularies whose settings say so, which is checked when the file
is loaded; with any other the whole text is encoded at once.

Null and empty texts have no tokens. Repeated rows get equal counts. All other
columns are kept, but for one named like the result, which is replaced.
"""

from __future__ import annotations

import json
import os
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

from .bpe import vocabulary_path
from .common import map_texts

CHUNK = 32_768
OVERLAP = 256
#: Fixed value: end-of-word suffix by which a token tells that it ends a pre-token.
WORD_END = "</w>"


@dataclass(frozen=True)
class Tokens:
    """Where the tokens of a span start in the text, and whether each follows the end of a pre-token."""

    starts: list[int]
    fresh: list[bool]

    def since(self, place: int) -> Tokens:
        return Tokens(self.starts[place:], self.fresh[place:])


class LibraryTokenizer:
    """The library's encoder of one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = settings.get("added_tokens") or []
        self.margin = max([len(t["content"]) for t in added], default=0) + 1
        self.cuttable = has_stable_boundaries(settings)
        self.last = {i for t, i in settings["model"].get("vocab", {}).items() if t.endswith(WORD_END)} if self.cuttable else set()
        self.last |= {t["id"] for t in added}

    def counts(self, texts: list[str]) -> list[int]:
        return [len(found) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, text: str, begin: int, end: int) -> Tokens:
        """Tokens of the span from begin to end, by one call of the library."""
        found = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        ends = [i in self.last for i in found.ids]
        return Tokens([begin + start for start, _ in found.offsets], [True, *ends[:-1]] if ends else [])


def has_stable_boundaries(settings: dict) -> bool:
    """Whether the settings are those that the proof of the module is about."""

    def parts(of: dict | None, kind: str) -> list[dict]:
        return [] if of is None else of[kind] if of["type"] == "Sequence" else [of]

    def known(part: dict) -> bool:
        if part["type"] == "Split":
            pattern = part["pattern"].get("Regex", "(?")
            return part["behavior"] == "Removed" and part["invert"] and not any(x in pattern for x in ("(?", "\\b", "\\B", "\\G", "^|", "$"))
        if part["type"] == "ByteLevel":
            return not part["add_prefix_space"] and not part["use_regex"]
        if part["type"] == "Replace":
            return part["pattern"] == {"Regex": "\\s+"} and part["content"] == " "
        return part["type"] in ("NFC", "Lowercase")

    model, added = settings["model"], settings.get("added_tokens") or []
    pre_tokens = parts(settings.get("pre_tokenizer"), "pretokenizers")
    return (
        model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == WORD_END
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and settings.get("post_processor") is None
        and [p["type"] for p in pre_tokens[:1]] == ["Split"]
        and all(map(known, [*parts(settings.get("normalizer"), "normalizers"), *pre_tokens]))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
    )


def stands_alone(text: str, place: int) -> bool:
    """Whether the character at a place composes with none before it, and none of the two becomes several characters."""
    a, b = text[place - 1], text[place]
    if max(a, b) < "\u0130":
        return True
    normal = unicodedata.normalize
    return (
        not unicodedata.combining(b)
        and normal("NFC", a + b) == normal("NFC", a) + normal("NFC", b)
        and all(len(normal("NFC", c).lower()) == 1 for c in (a, b))
    )


def common_boundary(text: str, left: Tokens, right: Tokens, low: int, high: int) -> tuple[int, int] | None:
    """Places in both of the tokens that start at the last stable boundary from low to high."""
    # Only the first of the tokens that start in one character can lie on a boundary of the text.
    ours: dict[int, int] = {}
    for i in range(1, len(right.starts)):
        place = right.starts[i]
        if low <= place <= high and right.fresh[i] and right.starts[i - 1] < place:
            ours[place] = i
    for i in range(len(left.starts) - 1, 0, -1):
        place = left.starts[i]
        if place < low:
            return None
        if place in ours and left.fresh[i] and left.starts[i - 1] < place and stands_alone(text, place):
            return i, ours[place]
    return None


def count_tokens(text: str, tokenizer: LibraryTokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, chunk by chunk."""
    total, begin, end = 0, 0, min(chunk, len(text))
    left = tokenizer.tokens(text, begin, end)
    while end < len(text):
        # The overlap reaches back to the left chunk's last boundary at least.
        last = next((s for s, f in zip(reversed(left.starts), reversed(left.fresh)) if f and s <= end - tokenizer.margin), begin)
        width, step = max(overlap, end - last + tokenizer.margin), chunk
        while True:
            start = max(begin, end - width)
            if start == begin:  # a chunk that reaches back to the last boundary is right as it is; it grows with what it holds
                step = max(chunk, end - begin)
            next_end = min(len(text), end + step)
            right = tokenizer.tokens(text, start, next_end)
            if start == begin:
                left = right
                break
            found = common_boundary(text, left, right, start + tokenizer.margin, end - tokenizer.margin)
            if found is not None:
                total += found[0]
                begin, left = left.starts[found[0]], right.since(found[1])
                break
            width *= 4
        end = next_end
    return total + len(left.starts)


_LOADED: dict[str, LibraryTokenizer] = {}


def loaded(name: str) -> LibraryTokenizer:
    if name not in _LOADED:
        _LOADED[name] = LibraryTokenizer(vocabulary_path(name))
    return _LOADED[name]


def counts(texts: list[str], tokenizer: LibraryTokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Tokens of each text: huge ones in chunks, the others together."""
    huge = [tokenizer.cuttable and len(t) > chunk for t in texts]
    short = iter(tokenizer.counts([t for t, h in zip(texts, huge, strict=True) if not h]))
    return [count_tokens(t, tokenizer, chunk, overlap) if h else next(short) for t, h in zip(texts, huge, strict=True)]


def with_counts(
    docs: DataFrame, vocabulary: str, column: str = "text", into: str = "n_tokens", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """The rows with the number of tokens of the whole text."""

    def start():
        tokenizer = loaded(vocabulary)
        return lambda texts: pa.array(counts(texts, tokenizer, chunk, overlap), pa.int64())

    return map_texts(docs, column, into, LongType(), start)
