"""I-Match against a plain version, and the order of documents with any ids."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from hiresift.llm import fingerprints as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_of(*values):
    """Spark's hash: each value seeds the next; a list counts as its members."""
    seed = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            data = x.encode() if isinstance(x, str) else x[0].to_bytes(x[1], "little", signed=True) if isinstance(x, tuple) else x.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed & (2**64 - 1))
    return signed(seed)


def brute(texts):
    sets = [sorted({hash_of(w) for w in WORD.findall(t.lower())}) for t in texts]
    counts = {}
    for s in sets:
        for t in s:
            counts[t] = counts.get(t, 0) + 1
    total = len(texts)
    least = max(2, -int(-fp.LOWEST * total // 1))
    most = max(least, int(fp.HIGHEST * total))
    lexicon = {t for t, n in counts.items() if least <= n <= most}

    def of(text):
        own = sorted({hash_of(w) for w in WORD.findall(text.lower())})
        kept = [t for t in own if t in lexicon]
        if not kept:
            return [hash_of(own)] * fp.HASHES
        out = [hash_of(kept)]
        for k in range(fp.ORDERS):
            ordered = [hash_of(t, (k, 4)) for t in kept]
            for level in fp.HALVINGS:
                chosen = [h for h in ordered if h & ((1 << level) - 1) == 0]
                out.append(hash_of(chosen) if chosen else 0)
        return out

    return of


def likeness(a, b):
    used = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in used) / len(used)


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(600)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 90))) for _ in range(150)]
    return [*texts, "", "", "only here", texts[3], texts[3] + " w1"]


@pytest.mark.parametrize("most", [400_000, 0])
def test_fingerprints_equal_a_plain_version(spark, monkeypatch, most):
    monkeypatch.setattr(fp, "LEXICON_TERMS", most)  # 0: the lexicon stays a table
    monkeypatch.setattr(fp, "ID_RANGE_ROWS", 20)
    texts = corpus()
    of = brute(texts)
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _kept string")
    rows = fp.edited_pairs(docs).select(
        "*", fp.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), fp.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next")
    ).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = r.doc_id // 3
        following = texts[i - 1]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + following[:half]
        assert r.edited == edited and r.next_text == following
        assert r.hashes == of(texts[i]) and r.edited_hashes == of(edited) and r.next_hashes == of(following)
        assert r.near_edited == pytest.approx(likeness(of(texts[i]), of(edited))) and r.near_next == pytest.approx(likeness(of(texts[i]), of(following)))


IDS = {
    "both ends": [-9_000_000_000_000_000_000, 9_000_000_000_000_000_000, -(1 << 63), (1 << 63) - 1, *range(40)],
    "clustered": [*range(200), 1 << 60],
    "null": [None] * 60 + list(range(20)),
    "repeated": [7] * 80 + [8, 6],
}


@pytest.mark.parametrize("kind", IDS)
def test_ranges_hold_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fp, "ID_RANGE_ROWS", 10)
    rows = [(i, f"t{n}") for n, i in enumerate(IDS[kind])] + [(IDS[kind][0], "t0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hash_of(r[1]), r[1]))
    want = sorted((i is None, i or 0, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n) for r in fp.with_next(docs, {"text": "n"}).collect())
    assert got == want
    sizes = docs.groupBy(fp._id_ranges(docs).alias("r")).count().collect()
    assert max(r["count"] for r in sizes) <= 45
