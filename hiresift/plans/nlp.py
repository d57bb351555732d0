"""Queries of dictionaries met by automata, discovery of terms, and repair of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.operators import blocks, dictionary, discovery, domains, repair

from .recruiting import scan
from .registry import Registry

registry = Registry()
query = registry.query


def six(value: Column) -> Column:
    return F.floor(value * 1_000_000 + 0.5) / 1_000_000


_TERMS_SQL = r"""b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
    terms AS (SELECT DISTINCT unnest(w) AS term, 'word' AS category FROM b UNION ALL
      SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 'pair' FROM b)"""


def benchmark_terms(spark: SparkSession, d: str) -> DataFrame:
    """(term, category): all words of the benchmark and all pairs of neighbours, some thousands."""
    words = scan(spark, d, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    single = words.select(F.explode("w").alias("term"), F.lit("word").alias("category"))
    return single.unionByName(words.select(F.explode(pairs).alias("term"), F.lit("pair").alias("category"))).distinct()


@query(rf"""WITH {_TERMS_SQL},
    t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS x FROM documents),
    p AS (SELECT doc_id, x[i] AS a, x[i + 1] AS gap, x[i + 2] AS c FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM t) y WHERE regexp_matches(x[i], '^[\p{{L}}\p{{N}}_]')),
    s AS (SELECT doc_id, gap, c, unnest(CASE WHEN regexp_full_match(a, '[a-zA-Z0-9]+') THEN [a] ELSE list_transform(list_filter(range(1, length(a) + 1), lambda i: i = 1 OR NOT regexp_full_match(a[i - 1:i - 1], '[a-zA-Z0-9]')), lambda i: a[i:]) END) AS a FROM p),
    m AS (SELECT doc_id, term, category FROM s JOIN terms ON term = a AND category = 'word' UNION ALL SELECT doc_id, term, category FROM s JOIN terms ON category = 'pair' AND gap = ' ' AND term = a || ' ' || c)
    SELECT doc_id, category, count(*) AS n, count(DISTINCT term) AS n_terms, min(term) AS first_term FROM m GROUP BY doc_id, category""")
def dictionary_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions in whole documents of all words and word pairs of the benchmark, with the guards of the skill matcher."""
    docs = scan(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return dictionary.counts(docs, benchmark_terms(spark, d), "doc_id").groupBy("doc_id", "category").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_terms"), F.min("term").alias("first_term")
    )


#: (place, pattern, code) of the ordered patterns that documents and parts are looked up in.
PATTERNS = (
    (0, r"\bnot there pattern\b", "000"), (1, r"(?:cold|hot) (?:widget|gear)s?", "251"), (2, r"brass|copper|nickel", "721"), (3, r"red\s+gizmo", "911"),
    (4, r"ción.{0,3}que", "231"), (5, r"heit(?:en|s)? (?:der|die|das)", "262"), (6, r"the (?:of|and) [a-f]", "233"), (7, r"[0-9]{4}-[0-9]+", "331"),
    (8, r"les? [aeiou]u", "264"), (9, r"und|ist", "411"), (10, r"(?:tion|ment)s?\.", "512"), (11, r"small|large", "812"), (12, r"x{9,}", "999"),
)
_PATTERNS = " ".join(f"WHEN regexp_matches(x, '{p}', 'i') THEN '{c}'" for _, p, c in PATTERNS)


@query(f"""SELECT kind, id, CASE {_PATTERNS} END AS code FROM (SELECT 'd' AS kind, doc_id AS id, text AS x FROM documents
    UNION ALL SELECT 'p', p_partkey, p_name || ' ' || p_type FROM part) t""")
def pattern_domains(spark: SparkSession, d: str) -> DataFrame:
    """The first of the ordered patterns in whole documents and in part names."""
    docs = scan(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    parts = scan(spark, d, "part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("x"))
    patterns = spark.createDataFrame(list(PATTERNS), "place int, pattern string, code string")
    return domains.first_pattern(docs.unionByName(parts), patterns, "x").select("kind", "id", "code")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem UNION SELECT DISTINCT l_orderkey, -1 FROM lineitem WHERE l_orderkey % 3 <> 0),
    c AS (SELECT i, count(*) AS c FROM r GROUP BY i), n AS (SELECT count(DISTINCT k) AS n FROM r),
    p AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM (SELECT * FROM r WHERE i >= 0) x JOIN (SELECT * FROM r WHERE i >= 0) y ON x.k = y.k AND x.i < y.i GROUP BY x.i, y.i HAVING count(*) >= 2
      UNION ALL SELECT -1, i, count(*) FROM r x WHERE i >= 0 AND k % 3 <> 0 GROUP BY i HAVING count(*) >= 2)
    SELECT a, b, x.c AS n_a, y.c AS n_b, p.n, floor(p.n * n.n::DOUBLE / (x.c * y.c) * 1000000 + 0.5) / 1000000 AS lift FROM p JOIN c x ON x.i = a JOIN c y ON y.i = b CROSS JOIN n
    WHERE p.n * n.n::DOUBLE / (x.c * y.c) >= 2""")
def basket_lift(spark: SparkSession, d: str) -> DataFrame:
    """Parts ordered together, with one further item that two thirds of all orders hold."""
    lines = scan(spark, d, "lineitem")
    common = lines.where("l_orderkey % 3 <> 0").select("l_orderkey", F.lit(-1).cast("long").alias("l_partkey"))
    baskets = lines.select("l_orderkey", F.col("l_partkey").cast("long").alias("l_partkey")).unionByName(common)
    return discovery.cooccurrences(baskets, "l_orderkey", "l_partkey", 2, 2.0).withColumn("lift", six(F.col("lift")))


def broken(text: Column) -> Column:
    """The text with a space put inside about one in twelve of its words of five letters and more, by their hash and place."""

    def cut(word: Column, place: Column) -> Column:
        hit = F.rlike(word, F.lit(r"^\p{L}{5,}$")) & (F.pmod(F.xxhash64(word, place), F.lit(12)) == 0)
        at = (F.lit(2) + F.pmod(F.xxhash64(place, word), F.char_length(word) - 3)).cast("int")
        return F.when(hit, F.concat(F.substring(word, F.lit(1), at), F.lit(" "), F.substring(word, at + 1, F.char_length(word)))).otherwise(word)

    return F.array_join(F.transform(F.split(text, " "), cut), " ")


@query()
def repaired_words(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents broken, repaired by their own vocabulary, and compared; and whether the unbroken text stays as it is."""
    docs = scan(spark, d, "documents").select("doc_id", "text")
    words = repair.vocabulary(docs)
    found = repair.rejoined(docs.withColumn("broken", broken(F.col("text"))), words, "broken")
    found = repair.rejoined(found, words, "text", "same")
    pieces = lambda c: F.split(c, r"\s+")
    return found.select(
        "doc_id", F.size(pieces("text")).alias("n_words"), (F.size(pieces("broken")) - F.size(pieces("text"))).alias("n_broken"),
        (F.size(pieces("repaired")) - F.size(pieces("text"))).alias("n_left"), (F.col("repaired") == F.col("text")).alias("whole"), (F.col("same") == F.col("text")).alias("unchanged"),
    )


_FIRST = ("Manager chez Acme", "1995 - 1997", "Chef Projet 1999", "Analyste", "")
_SECOND = ("- Acme Corp", "Lyon 2001", "travail divers")
_THIRD = ("", "mission de production", "mission de production", "2003")


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TITLED, _YEARED, _RANGED, _COMPANY = (rf"regexp_matches(%s, '{p}')" for p in (r"\b(Manager|Chef|Analyste)\b", r"\b(19|20)[0-9]{2}\b", r"\b(19|20)[0-9]{2}\s*-\s*[0-9]{4}", r"\s+chez\s+"))


@query(rf"""WITH o AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, {_listed(_FIRST)}[o_orderkey % 5 + 1] AS a,
      {_listed(_SECOND)}[o_orderkey % 3 + 1] AS b, {_listed(_THIRD)}[o_orderkey % 4 + 1] AS c FROM orders),
    l AS (SELECT id, n * 3 AS pos, a AS line FROM o UNION ALL SELECT id, n * 3 + 1, b FROM o UNION ALL SELECT id, n * 3 + 2, c FROM o),
    w AS (SELECT *, COALESCE(lead(line) OVER (PARTITION BY id ORDER BY pos), '') AS below, lag(line) OVER (PARTITION BY id ORDER BY pos) AS above FROM l),
    s AS (SELECT *, {_TITLED % 'line'} AS title, {_YEARED % 'line'} AS year, above IS NULL OR above = '' OR ({_TITLED % 'line'} AND ({_COMPANY % 'line'} OR {_YEARED % 'below'} OR below = '- Acme Corp' OR {_YEARED % 'line'}))
      OR ({_RANGED % 'line'} AND {_TITLED % 'below'}) AS opens FROM w),
    b AS (SELECT *, sum(opens::INT) OVER (PARTITION BY id ORDER BY pos) AS block FROM s WHERE line <> ''),
    g AS (SELECT id, block, string_agg(line, chr(10) ORDER BY pos) AS t, NOT bool_or(title) AND bool_or(year) AND length(string_agg(line, chr(10))) < 60 AS d FROM b GROUP BY id, block),
    k AS (SELECT *, d AND (block - COALESCE(last_value(CASE WHEN NOT d THEN block END IGNORE NULLS) OVER (PARTITION BY id ORDER BY block), min(block) OVER (PARTITION BY id) - 1)) % 2 = 1 AS odd FROM g),
    j AS (SELECT *, sum(x::INT) OVER (PARTITION BY id ORDER BY block) AS grp FROM (SELECT *, NOT COALESCE(lag(odd) OVER (PARTITION BY id ORDER BY block), false) AS x FROM k) y),
    m AS (SELECT id, grp, string_agg(t, chr(10) ORDER BY block) AS t FROM j GROUP BY id, grp HAVING length(string_agg(t, chr(10))) > 10)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS block, t AS text FROM m""")
def experience_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Experience sections, made of a customer's orders at three lines each, cut into blocks."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values)).cast("int") + 1)
    orders = scan(spark, d, "orders").select("o_custkey", "o_orderkey", F.array(pick(_FIRST), pick(_SECOND), pick(_THIRD)).alias("own"))
    sections = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "own"))), lambda x: x["own"])), "\n").alias("section")
    )
    found = blocks.blocks(blocks.section_lines(sections, "id", "section"))
    return found.select("id", "block", F.array_join("lines", "\n").alias("text"))
