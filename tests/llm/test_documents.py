"""The document operators against brute force on small fixtures, and their edge cases."""

import hashlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hiresift.llm import bpe, fingerprints, html_text, minhash, mixing, substring, token_counts
from hiresift.llm.fmindex import FmIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, mark string, _k string, repeats string, _mark string"


def frame(spark, rows):
    """Documents from (id, text) or (id, text, source); the last columns clash with names that operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, "m", "k", "r", "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    passage = prose(rng, 70)
    line = prose(rng, 12)
    for i in range(60):
        text = prose(rng, rng.randrange(20, 200))
        if i % 4 == 0:
            text += " " + passage + " " + prose(rng, 30)
        if i % 3 == 0:
            text = line + "\n" + text
        rows.append((i, text))
    base = rows[7][1].split(" ")
    for i in range(60, 80):  # near copies of one document
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(own)))
    rows += [(80, rows[3][1]), (81, rows[3][1]), (82, None), (83, ""), (84, " \n"), (85, "one"), (86, "ONE"), (87, "one"), (90, rows[3][1]), (90, rows[3][1])]
    return rows


def jaccard_groups(rows):
    def shingles(text):
        own = WORD.findall((text or "").translate(str.maketrans(minhash.UPPER, minhash.LOWER)))
        return frozenset(zip(own, own[1:])) if len(own) > 1 else frozenset([tuple(own)] if own else [])

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300 * block)
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_duplicates(frame(spark, corpus), size=2).collect()
    want = jaccard_groups(corpus)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_round_two_links_what_no_hub_does(spark):
    """A chain of documents, each near to the next only, is one component."""
    rng = random.Random(8)
    words = prose(rng, 120, 10**6).split(" ")
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(len(words))] = f"y{i}_{rng.random()}"
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), size=2).collect()}
    assert got == {i: c for i, (_, c) in jaccard_groups(rows).items()}


def brute_repeats(rows, window):
    first = {}
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, own in docs:
        for s in range(len(own) - window + 1):
            key = tuple(own[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, own in docs:
        gone = set()
        for s in range(len(own) - window + 1):
            if first[tuple(own[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(w for p, w in enumerate(own) if p not in gone)
        out.append((i, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [(2000, 500), (2, 2)])
def test_substring_removal(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT_DOCUMENTS", hot[0])
    monkeypatch.setattr(substring, "HOT_SHARE", hot[1])
    monkeypatch.setattr(substring, "SHARD_WORDS", 2000)
    got = substring.remove_repeats(frame(spark, corpus)).select("doc_id", "repeats.*", "mark").collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(corpus, substring.WINDOW)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and r.mark == "m" for r in got)


def test_fm_index_finds_least_owner():
    import numpy as np

    rng = np.random.default_rng(3)
    pieces = [rng.integers(1, 4, rng.integers(5, 40)) for _ in range(30)]
    depth = 5
    text = np.concatenate([np.append(p, 0) for p in pieces])
    sizes = np.array([len(p) for p in pieces])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(30), sizes + 1)
    index = FmIndex(text, owner, depth)
    least = index.least_owners(text, begins, begins + sizes)
    seen = {}
    for i, p in enumerate(pieces):
        for s in range(len(p) - depth + 1):
            seen.setdefault(tuple(p[s : s + depth]), i)
    for b, p in zip(begins, pieces):
        for s in range(len(p) - depth + 1):
            assert least[b + s] == seen[tuple(p[s : s + depth])]
    foreign = np.array([1, 2, 9, 1, 1, 2, 3, 1])  # symbol 9 is not in the index
    del foreign


def test_fingerprints(spark, corpus):
    rows = [r for r in corpus if r[0] < 90]
    got = {r.doc_id: r for r in fingerprints.edited_pairs(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    for place, (i, t) in enumerate(ordered):
        following = ordered[(place + 1) % len(ordered)][1]
        half = len(t) // 2
        assert got[i].edited == t[: len(t) - half] + following[:half]
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).add(tuple(got[i].hashes))
    assert all(len(x) == 1 for x in by_text.values())
    same = fingerprints.edited_pairs(frame(spark, [(1, "a b c d"), (1, "a b c d")])).select(
        fingerprints.likeness(F.col("hashes"), F.col("next_hashes")).alias("l")
    )
    assert [r.l for r in same.collect()] == [1.0, 1.0]


def test_fingerprint_ranges_have_the_same_order(spark, corpus, monkeypatch):
    rows = frame(spark, [(i * 7, t or "") for i, t in corpus if i < 90]).select("doc_id", "text")
    whole = {r.doc_id: r.n for r in fingerprints.with_next(rows, {"text": "n"}).collect()}
    monkeypatch.setattr(fingerprints, "ID_RANGE_ROWS", 4)
    assert {r.doc_id: r.n for r in fingerprints.with_next(rows, {"text": "n"}).collect()} == whole


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 120)), ["a", "b", "c", "d", None][i % 5] if i % 3 else "a") for i in range(3000)]
    docs = frame(spark, rows)
    got = mixing.sample(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    again = {(r.doc_id, r.times) for r in mixing.sample(docs).collect()}
    assert again == {(r.doc_id, r.times) for r in got} and len(got) == 3000
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.times * r["size"]
        assert 0 <= r.times <= 3
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6 * total
    for taken, target, size in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 0.02 * target + 60
    expected = target_by_rounds({s: v[2] for s, v in by.items()}, total)
    assert all(abs(by[s][1] - expected[s]) < 1e-6 * total for s in by)


def target_by_rounds(sizes, total):
    """Excess over the cap is shared again, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets_stop_at_the_cap(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 3), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    want = target_by_rounds({"a": 10, "b": 1000, "c": 500, "d": 3, None: 0}, 1513)
    assert got == pytest.approx(want)


def test_apply_mix_repeats_rows(spark):
    docs = frame(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "d e", "y"), (4, "f " * 50, "y")])
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns and got.where("doc_id = 1").count() % 2 == 0


TEXTS = ["", None, "Hello world's  end", "été  naïve<|endoftext|>x", "  \n\t ", "x" * 5000, "日本語 text 😀‍", "á <|startoftext|>", "\x1c\x85 b"]


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, list(enumerate(TEXTS)))
    rows = bpe.decode(bpe.encode(docs, "byte_bpe_50k.json"), "byte_bpe_50k.json").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    for r in bpe.round_trip(docs, "byte_bpe_50k.json").select("doc_id", "bpe.*").collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest() and r.n_tokens == len(ids)


@pytest.mark.parametrize("chunk", [(32768, 256), (40, 4)])
def test_token_counts_equal_the_library(spark, chunk):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = [*TEXTS, prose(rng, 300), "word" * 60 + " " + prose(rng, 50)]
    docs = frame(spark, list(enumerate(texts)))
    got = token_counts.with_counts(docs, "word_bpe_49k.json", chunk=chunk[0], overlap=chunk[1]).collect()
    for r in got:
        assert r.n_tokens == len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="sidebar"><p>Popular the of and</p></div>
<article><h1>Title &amp; more</h1><p>First  <b>bold</b> paragraph.<p>Short.</p><form><input><label>Mail</label></form>
<script>var x = "<p>no</p>";</script><!-- <p>hidden</p> --><section id="comments"><p>Nice post of the day!</p></section><p>Last&#233;</p></article>
<footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst bold paragraph.\n\nShort.\n\nLasté"
    plain = "<body><div class='menu'><a href=x>One</a></div><p>" + "the end of a long and quiet day for all of us in the town " * 4 + "</p><p>So be it.</p></body>"
    assert html_text.main_text(plain).endswith("So be it.") and "One" not in html_text.main_text(plain)
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<"), (4, "u", "<")], "page_id long, url string, html string")
    got = html_text.extract(pages).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    deep = "<div>" * 20_000 + "x" + "</p>" * 1000
    assert html_text.main_text(deep) in ("", "x")


@pytest.mark.parametrize(
    "run",
    [
        lambda d: minhash.near_duplicates(d),
        lambda d: substring.remove_repeats(d),
        lambda d: fingerprints.edited_pairs(d),
        lambda d: mixing.sample(d),
        lambda d: mixing.apply_mix(d),
        lambda d: bpe.round_trip(d, "byte_bpe_50k.json"),
        lambda d: token_counts.with_counts(d, "word_bpe_49k.json"),
    ],
)
def test_empty_tables_and_null_columns(spark, run):
    empty = frame(spark, [])
    assert run(empty).count() == 0
    nulls = spark.createDataFrame([(None,) * 10] * 2 + [(1, "a b") + (None,) * 8], SCHEMA)
    assert run(nulls).count() >= 1
