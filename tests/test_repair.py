"""Repair of broken words against exhaustive search, and of whole documents broken by rule."""

import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hiresift.operators import repair
from hiresift.plans import all_queries

DATA = Path("/root/testdata/sf0.01")


def cheapest(joiner, fragments):
    """Least cost over all ways to put the fragments into words."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(fragments) - 1):
        groups, own = [], [fragments[0]]
        for cut, f in zip(cuts, fragments[1:], strict=True):
            if cut:
                groups.append(own)
                own = [f]
            else:
                own.append(f)
        words = [joiner.word(g) if len(g) <= repair.MOST_FRAGMENTS else None for g in [*groups, own]]
        if all(words):
            cost = sum(w[0] for w in words)
            best = cost if best is None else min(best, cost)
    return best


def test_the_pass_over_fragments_finds_the_cheapest_words():
    rng = random.Random(2)
    counts = {"".join(rng.choices("abc", k=rng.randrange(1, 7))): rng.randrange(1, 50) for _ in range(60)}
    joiner = repair.Joiner(counts)
    for _ in range(300):
        fragments = ["".join(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 7))]
        out = joiner.run(fragments)
        assert out.replace(" ", "") == "".join(fragments)
        cost, best = 0.0, cheapest(joiner, fragments)
        begin = 0
        for size in _sizes(out, fragments, joiner):
            cost += joiner.word(fragments[begin : begin + size])[0]
            begin += size
        assert cost == pytest.approx(best)


def _sizes(out, fragments, joiner):
    """Numbers of fragments in each word of a result, by walking both."""

    def walk(at, rest):
        if at == len(fragments):
            return [] if not rest else None
        for size in range(1, repair.MOST_FRAGMENTS + 1):
            own = joiner.word(fragments[at : at + size]) if at + size <= len(fragments) else None
            if own and (rest == own[1] or rest.startswith(own[1] + " ")):
                more = walk(at + size, rest[len(own[1]) + 1 :])
                if more is not None:
                    return [size, *more]
        return None

    return walk(0, out)


def test_joins_cuts_and_known_words():
    joiner = repair.Joiner({"django": 5, "internship": 5, "managed": 9, "and": 50, "the": 90, "re": 4, "there": 8, "web": 7, "développeur": 3})
    assert joiner.repaired("Djang o Inter nship, Managedand the re 2020 Djangoweb") == "Django Internship, Managed and the re 2020 Django web"
    assert joiner.repaired("Dévelop peur\nxyzzy the") == "Développeur\nxyzzy the"
    assert joiner.repaired("") == ""


def test_structure(spark):
    text = "Zo´ e cr` eme\ufffdAtelier 2015Master Intelligence2024 ok FORMATIONS Licence • un ● deux\n\n\n\nfin"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(repair.structured(F.col("t"))).collect()
    assert got[0][0] == "Zoé crème - Atelier 2015\nMaster Intelligence\n2024 ok\n\nFORMATIONS\n Licence\n• un\n• deux\n\nfin" and got[1][0] is None


def test_documents_broken_by_rule_are_restored(spark):
    if not DATA.exists():
        pytest.skip("no test data here")
    rows = all_queries()["repaired_words"](spark, str(DATA)).collect()
    docs = [r for r in rows if r.n_broken is not None]
    broken, left, words = (sum(getattr(r, c) for r in docs) for c in ("n_broken", "n_left", "n_words"))
    assert all(r.unchanged for r in docs) and broken > 0.02 * words
    assert left < 0.5 * broken and left < 0.05 * words and 0 <= left


def test_known_words_of_a_run_are_not_looked_up_again(monkeypatch):
    counts = {w: 5 for w in "the quick brown fox jumps over a lazy dog and then some more words follow".split()}
    joiner, asked, own = repair.Joiner(counts), [], repair.Joiner.word
    monkeypatch.setattr(repair.Joiner, "word", lambda self, f: asked.append(f) or own(self, f))
    assert joiner.repaired("the quick bro wn fox jumps over a lazy dog and then some more words follow") == "the quick brown fox jumps over a lazy dog and then some more words follow"
    assert len(asked) <= 16
