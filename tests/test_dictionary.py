"""Automata against naive loops over regular expressions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hiresift.functions.automaton import GUARDS, FirstPattern, Terms, WordTerms, leftmost_longest, required, word_guard
from hiresift.operators import dictionary, discovery, domains

WORDS = ["c", "c++", "java", "javascript", "java spring", "spring", "go", "r", "sql", "é", "été", "data", "node.js", ".net", "a_b", "c#", "big data"]
GAPS = [" ", "  ", ", ", "/", "", "-", ".", "_", "\n", "é"]


def naive(text, terms):
    """As said: not after an ASCII letter or digit; a term ending in a letter ends its word, any other meets none."""
    found = []
    for t in terms:
        after = r"\b" if t[-1].isalnum() else "(?![a-zA-Z0-9])"
        pattern = re.compile(f"(?=(?<![a-zA-Z0-9]){re.escape(t)}{after})")
        found += [(m.start(), m.start() + len(t), t) for m in pattern.finditer(text)]
    return sorted(found)


def texts(seed, n=200):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_spans_equal_naive_search():
    automaton = Terms(WORDS)
    for text in texts(1, 1000):
        assert sorted((b, e, automaton.terms[p]) for b, e, p in automaton.spans(text, word_guard)) == naive(text, WORDS)


def test_spaced_terms_stand_between_spaces_or_ends():
    automaton = Terms(["a", "b", "a b", "b b"], spaced=True)
    assert sorted((b, e, automaton.terms[p]) for b, e, p in automaton.spans("a b b ab b")) == [
        (0, 1, "a"), (0, 3, "a b"), (2, 3, "b"), (2, 5, "b b"), (4, 5, "b"), (9, 10, "b"),
    ]
    assert automaton.spans("") == [] and [s[:2] for s in automaton.spans("a")] == [(0, 1)]


@pytest.mark.parametrize("most", [None, 12])
def test_mentions_equal_naive_search_in_one_piece_or_many(spark, most):
    rows = [(i, t) for i, t in enumerate(texts(2))] + [(1000, None), (1001, ""), (1002, "JAVA Spring")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "id int, text string, mentions string")
    terms = spark.createDataFrame([(w, w[:1]) for w in WORDS] + [("java", "second"), ("Java", "j"), (None, "x"), ("", "x")], "term string, category string")
    for longest in (False, True):
        got = {r.id: [(m.begin, m.end, m.term, m.category) for m in r.mentions] for r in dictionary.mentions(docs, terms, contexts={}, longest=longest, most=most).collect()}
        for i, text in rows:
            want = naive((text or "").lower(), WORDS)
            if longest:
                taken = set(leftmost_longest({(b, e) for b, e, _ in want}))
                want = [w for w in want if w[:2] in taken]
            assert got[i] == sorted((b, e, t, c) for b, e, t in want for c in ([t[:1], "second"] if t == "java" else [t[:1]]))
    assert dictionary.mentions(docs.limit(0), terms).count() == 0 and dictionary.mentions(docs, terms.limit(0)).where("size(mentions) > 0").count() == 0


def test_contexts_confirm_letters(spark):
    rows = [(0, "langage C, vitamine C"), (1, "vitamine C"), (2, "I go there"), (3, "Go, Rust"), (4, "Python, R"), (5, "R. Smith")]
    docs = spark.createDataFrame(rows, "id int, text string")
    terms = spark.createDataFrame([("c", "l"), ("r", "l"), ("go", "l")], "term string, category string")
    assert {r.id: len(r.mentions) for r in dictionary.mentions(docs, terms).collect()} == {0: 2, 1: 0, 2: 0, 3: 1, 4: 1, 5: 0}


def test_leftmost_longest():
    assert leftmost_longest([(0, 4, 1), (0, 11, 2), (5, 11, 3), (12, 13, 4), (11, 20, 5)]) == [(0, 11, 2), (11, 20, 5)]


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        (r"\bdata (?:scientist|analyst)", {"scientist", "analyst"} | set()), (r"dev(?:op)?s", {"dev"}), (r"(?:ab|cd)+e?", {"ab", "cd"}), (r"a*b?", None),
        (r"(?:ab|c*)", None), ("Ingénieur", {"ing", "nieur"}), ("(?P<x>Java)[0-9]", {"java"}), ("[ab]c", {"c"}),
    ],
)
def test_required_literals(pattern, literals):
    found = required(pattern)
    assert found is None if literals is None else found and found <= literals | {"data "}


def test_first_pattern_equals_the_naive_loop(spark):
    rng = random.Random(4)
    atoms = ["java", "go", "s[qp]l", "(?:big|fast) data", "c\\+\\+", "é", "x*", "été?", "\\bnode", "(?i:SPRING)", "d.ta", "a_b|c#", "(?:java){2,}"]
    patterns = ["".join(rng.choice(atoms) + rng.choice(["", " ", ".*", "\\s+"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    patterns = [p for p in patterns if not re.fullmatch(p, "")]
    first = FirstPattern(patterns)
    found = texts(5, 500)
    for text in found:
        want = next((i for i, p in enumerate(patterns) if re.search(p, text, re.I)), None)
        assert first.first(text) == want
    naive_tries = sum(next((i + 1 for i, p in enumerate(patterns) if re.search(p, t, re.I)), len(patterns)) for t in found)
    assert first.tried < naive_tries / 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(found)] + [(-1, None)], "id int, text string")
    table = spark.createDataFrame([(i, p, str(i)) for i, p in enumerate(patterns)], "place int, pattern string, code string")
    got = {r.id: r.code for r in domains.first_pattern(docs, table).collect()}
    assert got == {i: (None if (x := first.first(t)) is None else str(x)) for i, t in enumerate(found)} | {-1: None if first.first("") is None else str(first.first(""))}


def test_domains_do_not_depend_on_where_the_dictionary_is_cut(spark):
    rng = random.Random(6)
    words = ["steel", "ring", "bolt", "gear", "red", "town", "old"]
    phrases = [" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(40)]
    keywords = spark.createDataFrame([(i, p, str(i)) for i, p in enumerate(phrases)], "place int, keyword string, code string")
    rows = spark.createDataFrame([(i, " ".join(rng.choices([*words, "sea", "sky"], k=rng.randrange(1, 6)))) for i in range(200)], "id int, text string")
    one, many = (sorted(map(tuple, domains.detect_domain(rows, keywords, most=most).select("id", "domain.code", "domain.score").collect())) for most in (None, 40))
    assert one == many and sum(r[1] is not None for r in one) > 100
    study = spark.createDataFrame([(i % 7, f"d{i % 7}", p) for i, p in enumerate(phrases)], "place int, domain string, keyword string")
    for specialty in (None, "text"):
        one, many = (sorted(map(tuple, domains.study_domain(rows, study, specialty=specialty, most=most).select("id", "study").collect())) for most in (None, 40))
        assert one == many


def test_cooccurrences_equal_brute_force_with_a_common_item(spark):
    rng = random.Random(7)
    baskets = [{f"i{rng.randrange(25)}" for _ in range(rng.randrange(1, 7))} | ({"all"} if k % 3 else set()) for k in range(300)]
    rows = [(k, i) for k, b in enumerate(baskets) for i in b for _ in range(1 + (i == "i3"))] + [(None, "i1"), (5, None)]
    table = spark.createDataFrame(rows, "k int, i string")
    got = {(r.a, r.b): (r.n_a, r.n_b, r.n, round(r.lift, 9)) for r in discovery.cooccurrences(table, "k", "i", 3, 1.2).collect()}
    names = sorted(set().union(*baskets))
    count = {i: sum(i in b for b in baskets) for i in names}
    want = {}
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            n = sum(a in s and b in s for s in baskets)
            lift = n * len(baskets) / (count[a] * count[b])
            if n >= 3 and lift >= 1.2:
                want[a, b] = (count[a], count[b], n, round(lift, 9))
    assert got == want and want
    known = spark.createDataFrame([("i1",), ("i2",)], "term string")
    for r in discovery.associated_terms(discovery.cooccurrences(table, "k", "i", 3, 1.2), known).collect():
        options = {p: v for p, v in want.items() if r.term in p and ({"i1", "i2"} & set(p)) and r.term not in ("i1", "i2")}
        assert r.lift == pytest.approx(max(v[3] for v in options.values()))


def test_terms_of_sections(spark):
    known = spark.createDataFrame([("Python",), ("sql",)], "term string")
    section = "Python, MonFramework, XYZ v3 | production de contenus; Outils divers\n• FastAPI / fastapi\nloisirs: lecture\nVue.js, sql, petit mot, et"
    rows = spark.createDataFrame([(1, section), (2, None), (3, "12, 2020")], "id int, section string")
    assert {(r.id, r.term) for r in discovery.section_terms(rows, known).collect()} == {
        (1, t) for t in ("MonFramework", "XYZ v3", "FastAPI", "loisirs: lecture", "Vue.js", "petit mot", "et")
    }
    assert {(r.id, r.term) for r in discovery.beside_known(rows, known).collect()} == {(1, "MonFramework"), (1, "XYZ v3"), (1, "Vue.js")}


def test_marked_words_count_as_guards_do():
    names = [*WORDS, "é", "été c", "a_b c", "c /", " go", "c# ", "_", "²", "the"]
    marked, plain = WordTerms(names), Terms(names)
    rng = random.Random(8)
    odd = "".join(map(chr, [*range(32, 127), *range(0x3B0, 0x3F0), 0x10FFFF, 0xE000, 0x301]))
    made = [*texts(9, 1000), "", "the", *("".join(rng.choice(["c", "go", "é", "_", " ", *odd]) for _ in range(rng.randrange(400))) for _ in range(200))]
    assert any(len(set(t)) > 60 for t in made)
    for text in made:
        assert marked.counts(text) == Counter(p for _, _, p in plain.spans(text, word_guard))
    # What stands inside other words is not even reported by the automaton.
    assert list(marked.automaton.iter(marked.marked("there bathe gone cc sqlr"))) == [] and not WordTerms([]).counts("a")


@pytest.mark.parametrize("most", [None, 12])
@pytest.mark.parametrize("guard", ["word", "space", "none"])
def test_counts_travel_by_numbers_of_terms(spark, guard, most):
    rows = [(i % 50, t) for i, t in enumerate(texts(10))] + [(1000, None), (1001, ""), (None, "java")]
    terms = spark.createDataFrame([(w, w[:1]) for w in WORDS] + [("java", "second"), ("go", None), (None, "x"), ("", "x")], "term string, category string")
    found = dictionary.counts(spark.createDataFrame(rows, "k int, text string"), terms, "k", guard=guard, most=most)
    plain = Terms(WORDS, GUARDS[guard][1])
    want = Counter()
    for k, text in rows:
        for _, _, p in plain.spans(text or "", GUARDS[guard][0]):
            for c in (w := WORDS[p])[:1], *(["second"] if w == "java" else [None] if w == "go" else []):
                want[k, w, c] += 1
    got = [tuple(r) for r in found.collect()]
    assert {r[:3]: r[3] for r in got} == want and len(got) == len(want) and found.columns == ["k", "term", "category", "n"]
    assert "hashpartitioning(k#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and not re.search(r"hashpartitioning\([^)]*term", plan)
    assert dictionary.counts(found.limit(0).select("k", F.col("term").alias("text")), terms.limit(0), "k").count() == 0
