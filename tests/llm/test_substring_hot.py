"""Repeats of hot anchors inside and across documents."""

import random

import pytest

from hiresift.llm import substring

from test_documents import brute_repeats, frame, prose


@pytest.mark.parametrize("sizes", [(3, 2, 50), (2_000, 500, 1_000)])
def test_runs_of_one_phrase_and_hot_passages(spark, sizes, monkeypatch):
    """Long runs of a phrase, inside one document too, are a few stretches; hot stretches of equal content are searched once."""
    monkeypatch.setattr(substring, "HOT_DOCUMENTS", sizes[0])
    monkeypatch.setattr(substring, "HOT_SHARE", sizes[1])
    monkeypatch.setattr(substring, "RUN", sizes[2])
    monkeypatch.setattr(substring, "SHARD_WORDS", 800)
    rng = random.Random(9)
    passage = prose(rng, 90).split(" ")
    rows = [(1, "ha " * 700), (2, "x " + "ha " * 400 + "y"), (3, "ho hi " * 150 + "ha " * 90), (4, "z ho hi " + "ho hi " * 90), (9, "ho hi ho " * 70)]
    for i in range(20, 60):
        own = list(passage)
        if i % 2:
            own[rng.randrange(90)] = f"e{i}"
        rows.append((i, f"{prose(rng, i % 7)} {' '.join(own)} {prose(rng, 20)}" + (f" {' '.join(passage)}" if i % 5 == 0 else "")))
    rows += [(60, rows[6][1] + " end"), (60, rows[6][1] + " fin"), (61, None)]
    got = substring.remove_repeats(frame(spark, rows)).select("doc_id", "repeats.*").collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, substring.WINDOW)


def test_a_long_run_is_a_few_stretches(spark):
    docs = frame(spark, [(1, "ha " * 80_000), (2, "ha " * 80_000 + "b")])
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs, texts=False).select("doc_id", "repeats.*").collect()}
    assert got == {1: (80_000, 0), 2: (80_001, 80_000)}
