"""Token counts in chunks against the library, on every text of the small table and on texts without spaces."""

import json
import os
import random
import time

import pytest

from hiresift.llm import token_counts
from hiresift.llm.bpe import vocabulary_path

NAME = "word_bpe_49k.json"
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.loaded(NAME)


def library(tokenizer, text):
    return len(tokenizer.tokenizer.encode(text, add_special_tokens=False).ids)


def hostile(seed, n):
    """Text without pattern: letters, marks that compose, jamo, digits, contractions, added tokens and parts of them."""
    rng = random.Random(seed)
    parts = ["a", "é", "é", "́", "̣́", "ᄀ", "ᅡ", "ᆨ", "가", "中", "。", "1", "'s", "'", " ", "\n", "<|endoftext|>", "<|start", "|>", "İ", "Σ", "the", "X!", " ", "😀"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (64, 20), (300, 50)])
def test_hostile_texts(tokenizer, chunk, overlap):
    for seed in range(60):
        text = hostile(seed, 900)
        assert token_counts.count_tokens(text, tokenizer, chunk, overlap) == library(tokenizer, text)


def test_whole_small_table(spark):
    if not os.path.exists(DOCUMENTS):
        pytest.skip("no table")
    docs = spark.read.parquet(DOCUMENTS).select("doc_id", "text")
    own = token_counts.loaded(NAME)
    for chunk, overlap in ((32_768, 256), (200, 30)):
        for r in token_counts.with_counts(docs, NAME, chunk=chunk, overlap=overlap).collect():
            assert r.n_tokens == library(own, r.text or "")


@pytest.mark.parametrize("kind", ["base64", "chinese", "one run", "no breaks"])
def test_long_texts_without_spaces_cost_a_bounded_multiple(tokenizer, kind):
    rng = random.Random(3)
    letters = {"base64": "ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/", "chinese": "天地玄黄宇宙洪荒日月盈昃。，", "one run": "abcdefghij", "no breaks": "天地玄黄宇宙洪荒"}[kind]
    text = "".join(rng.choices(letters, k=300_000))
    begin = time.process_time()
    want = library(tokenizer, text)
    whole = time.process_time() - begin
    begin = time.process_time()
    assert token_counts.count_tokens(text, tokenizer) == want
    assert time.process_time() - begin <= 5 * whole + 0.5


def test_other_settings_are_encoded_whole(tokenizer):
    with open(vocabulary_path(NAME), encoding="utf-8") as file:
        settings = json.load(file)
    assert token_counts.has_stable_boundaries(settings) and tokenizer.cuttable
    changed = [
        {"post_processor": {"type": "BertProcessing"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}},
        {"normalizer": {"type": "NFKC"}},
        {"model": settings["model"] | {"end_of_word_suffix": None}},
        {"added_tokens": [settings["added_tokens"][0] | {"lstrip": True}]},
    ]
    assert not any(token_counts.has_stable_boundaries(settings | c) for c in changed)
    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        assert not token_counts.has_stable_boundaries(json.load(file))


def test_other_vocabulary_counts_like_the_library(spark):
    docs = spark.createDataFrame([(1, "some text  of words " * 4000), (2, None)], "doc_id long, text string")
    own = token_counts.loaded("byte_bpe_50k.json")
    got = {r.doc_id: r.n_tokens for r in token_counts.with_counts(docs, "byte_bpe_50k.json").collect()}
    assert got == {1: library(own, "some text  of words " * 4000), 2: 0}
