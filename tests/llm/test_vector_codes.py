"""Vector codes against plain Lloyd rounds, the heaps against sorting."""

import hashlib

import numpy as np
import pytest

from hiresift.llm import queries, slack_heaps, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes, errors and digest by whole Lloyd rounds over whole numbers of any size."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    x = [[int(np.floor(c * scale)) for c in v] for _, v in rows]
    size = len(x[0]) // parts
    seeds = [x[i] for i in range(len(rows)) if i == 0 or rows[i][0] != rows[i - 1][0]][:entries]
    codes, errors, flat = [[] for _ in rows], [0] * len(rows), []
    for p in range(parts):
        own = [tuple(v[p * size : (p + 1) * size]) for v in x]
        book = [tuple(v[p * size : (p + 1) * size]) for v in seeds]

        def assign(v):
            found = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
            return min(range(len(book)), key=lambda i: (found[i], i)), min(found)

        for _ in range(rounds):
            at = {v: assign(v)[0] for v in set(own)}
            for e in range(len(book)):
                members = [v for v in own if at[v] == e]
                if members:
                    book[e] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
        for i, v in enumerate(own):
            e, d = assign(v)
            codes[i].append(e)
            errors[i] += d
        flat += [c for e in book for c in e]
    return [(r[0], "".join(f"{c:02x}" for c in cs), e) for r, cs, e in zip(rows, codes, errors, strict=True)], hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def compare(spark, rows, **settings):
    table = spark.createDataFrame([(i, [float(c) for c in v], None) for i, v in rows], SCHEMA).repartition(3)
    got = vector_codes.encode(table, block_rows=50, **settings).collect()
    expected, digest = plain([(i, [float(c) for c in v]) for i, v in rows], **settings)
    assert sorted((r.vec_id, r.code, int(r.error)) for r in got) == sorted(expected)
    assert {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    compare(spark, list(enumerate(rng.normal(size=(400, 16)))))


def test_ties_repeated_rows_and_few_ids(spark):
    rng = np.random.default_rng(7)
    # Few values a component: many equal distances, whole groups of equal vectors.
    coarse = rng.integers(-1, 2, (300, 16)) / 4096
    compare(spark, list(enumerate(coarse)))
    compare(spark, [(i // 40, v) for i, v in enumerate(coarse)])
    compare(spark, list(enumerate(coarse[:3])))
    compare(spark, [(i, np.ones(8)) for i in range(100)])


def test_huge_components(spark):
    rng = np.random.default_rng(8)
    for size in (1e4, 1e9, 1e14):
        compare(spark, list(enumerate(rng.normal(size=(60, 8)) * size)), rounds=3)


def test_only_parts_that_drift_may_have_moved_are_popped(monkeypatch):
    """After the first rounds most parts of clustered data are never looked at again."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(16, 4)) * 4000
    vectors = np.floor(np.concatenate([centres, centres[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 4)) * 100])).astype("int64")
    books = {"own": vector_codes.Codebooks.start(vectors[:16], 1)}
    looked = []
    found = vector_codes.nearest
    monkeypatch.setattr(vector_codes, "nearest", lambda parts, entries: looked.append(len(parts)) or found(parts, entries))
    block, changes = vector_codes.Block.start(vectors, books["own"])
    for _ in range(6):
        books["own"] = books["own"].updated(changes)
        changes = block.advance(books["own"])
        assert (block.codes()[:, 0] == vector_codes.distances(vectors, books["own"].entries[0]).argmin(1)).all()
    assert looked[0] == len(vectors) and sum(looked[1:]) < len(vectors) // 4


def test_heap_pops_and_fills_like_a_sorted_list():
    rng = np.random.default_rng(10)
    keys, items = np.zeros(0), np.zeros(0, "int32")
    held, number = {}, 0
    for _ in range(60):
        limit = rng.choice([-np.inf, 0.2, 0.5, 2.0])
        holes = slack_heaps.at_most(keys, limit)
        assert sorted(items[holes]) == sorted(i for i, k in held.items() if k <= limit)
        new = rng.random(rng.integers(0, 50)).round(2)
        fresh = np.arange(number, number + len(new), dtype="int32")
        number += len(new)
        held = {i: k for i, k in held.items() if k > limit} | dict(zip(fresh.tolist(), new.tolist(), strict=True))
        keys, items = slack_heaps.exchange(keys, items, holes, new, fresh)
        assert dict(zip(items.tolist(), keys.tolist(), strict=True)) == held
        parents = (np.arange(1, len(keys)) - 1) // 2
        assert (keys[parents] <= keys[1:]).all()


def test_nulls_other_lengths_missing_ids_and_empty_tables(spark):
    rng = np.random.default_rng(11)
    fine = [(i, [float(c) for c in v], "a" if i % 2 else None) for i, v in enumerate(rng.normal(size=(30, 8)))]
    odd = [(100, None, "a"), (101, [], "a"), (102, [1.0, None] * 4, "a"), (103, [float("nan")] * 8, "a"), (104, [1.0] * 9, "a")]
    longer = [(200 + i, [float(c) for c in v], "b") for i, v in enumerate(rng.normal(size=(5, 16)))]
    rows = [*fine, *odd, *longer, (None, fine[3][1], "b"), (None, [0.0] * 24, "b")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", code int, width string")
    coded = vector_codes.encode(table, keep=("label",))
    got = vector_codes.with_group_totals(coded, "label", "error", "label_error").collect()
    assert sorted((r.vec_id for r in got if r.vec_id is not None)) == [*range(30), *range(200, 205)]
    by_id = {r.vec_id: r for r in got}
    assert sum(r.vec_id is None for r in got) == 1 and by_id[None].code == by_id[3].code
    assert len({r.codebooks_sha256 for r in got}) == 2
    for label in ("a", "b", None):
        of = [r for r in got if r.label == label]
        assert {r.label_error for r in of} == {sum(r.error for r in of)}
    assert vector_codes.encode(table.limit(0), keep=("label",)).columns == ["vec_id", "label", "code", "error", "codebooks_sha256"]
    assert vector_codes.encode(table.limit(0)).count() == 0


def test_totals_of_very_many_groups(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_GROUPS", 3)
    monkeypatch.setattr(vector_codes, "HEAVY_SHARE", 4)
    rows = spark.createDataFrame([(None if i % 2 else i % 8, i) for i in range(100)], "g int, v long")
    got = vector_codes.with_group_totals(rows, "g", "v", "total").collect()
    assert len(got) == 100
    for r in got:
        assert r.total == sum(i for i in range(100) if (None if i % 2 else i % 8) == r.g)


def test_query_returns_the_contract_columns(spark):
    rows = queries.op12_vector_codes(spark, "/root/testdata/sf0.001")
    assert dict(rows.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    expected, digest = plain([(r.vec_id, list(r.embedding)) for r in table])
    got = rows.collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(expected) and got[0].codebooks_sha256 == digest
