"""Queries over document texts: clean-up, quality, extraction, dictionary and similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.functions import similarity, text
from hiresift.operators import listings, matching, profiles

from .recruiting import AS_OF, scan
from .registry import Registry

registry = Registry()
query = registry.query

COMMON = "the of and to in is that for de la le et en que der die und das el los y".split()
_LIST = ", ".join(f"'{w}'" for w in COMMON)
_FR = ", ".join(f"'{w}'" for w in text.FRENCH_SIGNALS)
_EN = ", ".join(f"'{w}'" for w in text.ENGLISH_SIGNALS)
_PLACES = list(dict.fromkeys(s for s, _, _ in matching.SECTOR_WEIGHTS))
TERMS = (("the", "article"), ("of the", "phrase"), ("de la", "phrase"), ("and", "link"), ("in the", "phrase"), ("que", "link"), ("and the of", "phrase"))
_TERMS = ", ".join(f"('{t}', '{c}')" for t, c in TERMS)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "documents")


@query(r"""SELECT doc_id, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS clean FROM documents""")
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", text.normalise(F.col("text")).alias("clean"))


@query("""SELECT doc_id, strip_accents(text) AS plain FROM documents""")
def accent_free(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query(f"""SELECT doc_id, CASE WHEN total = 0 THEN 0.0 ELSE floor((letters / total * 50 + least(known / greatest(n, 1) * 2, 1.0) * 30
        + least(total / 500, 1.0) * 20) * 10 + 0.5) / 10 END AS quality FROM (
    SELECT doc_id, length(clean)::DOUBLE AS total, length(regexp_replace(clean, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g'))::DOUBLE AS letters,
           len(w)::DOUBLE AS n, len(list_filter(w, lambda x: x IN ({_LIST})))::DOUBLE AS known FROM (
      SELECT doc_id, trim(text) AS clean, regexp_extract_all(lower(trim(text)), '[a-zà-öø-ÿ]{{2,}}') AS w FROM documents) a) b""")
def ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", text.ocr_quality(F.col("text"), COMMON).alias("quality"))


@query(rf"""SELECT doc_id, CASE WHEN english > french THEN 'en' ELSE 'fr' END AS language, french, english FROM (
    SELECT doc_id, len(list_filter(w, lambda x: x IN ({_FR}))) AS french, len(list_filter(w, lambda x: x IN ({_EN}))) AS english FROM (
      SELECT doc_id, list_distinct(regexp_split_to_array(lower(substring(text, 1, 2000)), '\s+')) AS w FROM documents) a) b""")
def language_keywords(spark: SparkSession, d: str) -> DataFrame:
    found = documents(spark, d).select("doc_id", text.language_by_keywords(F.col("text")).alias("l"))
    return found.select("doc_id", "l.language", F.col("l.french").cast("long").alias("french"), F.col("l.english").cast("long").alias("english"))


@query(r"""SELECT DISTINCT doc_id, lower(rtrim(e, '.')) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS e FROM documents) x""")
def email_extract(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))


@query(r"""SELECT DISTINCT doc_id, p AS phone FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text,
    '(?:\+|00)\d{1,3}[\s\-.]?(?:\(?\d{1,4}\)?[\s\-.]?){1,4}\d{2,4}|\(?\d{2,4}\)?[\s\-.]?\d{2,4}[\s\-.]?\d{2,4}[\s\-.]?\d{2,4}|\d{2}[\s\-.]?\d{3}[\s\-.]?\d{3}')), '[^0-9]', '', 'g') AS p FROM documents) x
    WHERE length(p) >= 8 AND NOT regexp_matches(p, '^(19|20)[0-9]{6}$') AND NOT regexp_matches(p, '^0000')""")
def phone_digits(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.explode(text.phones(F.col("text"))).alias("phone"))


_ASKED = """(SELECT id, CASE id % 6 WHEN 0 THEN 'Nous cherchons ' || (id % 9 + 1) || ' ans en bases' WHEN 1 THEN (id % 5) || ',5 years of practice'
    WHEN 2 THEN 'bac + ' || (id % 6) || ' ou plus' WHEN 3 THEN 'Master en informatique' WHEN 4 THEN 'BTS ou DUT, 3+ ans' ELSE 'sans condition' END AS asked
    FROM (SELECT p_partkey AS id FROM part))"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return scan(spark, d, "part").select(
        key.alias("id"),
        F.when(key % 6 == 0, F.concat(F.lit("Nous cherchons "), (key % 9 + 1).cast("string"), F.lit(" ans en bases")))
        .when(key % 6 == 1, F.concat((key % 5).cast("string"), F.lit(",5 years of practice")))
        .when(key % 6 == 2, F.concat(F.lit("bac + "), (key % 6).cast("string"), F.lit(" ou plus")))
        .when(key % 6 == 3, "Master en informatique")
        .when(key % 6 == 4, "BTS ou DUT, 3+ ans")
        .otherwise("sans condition")
        .alias("asked"),
    )


@query(rf"""SELECT id, TRY_CAST(replace(NULLIF(regexp_extract(asked, '\b([0-9]+(?:[.,][0-9]+)?)\s*(?:\+\s*)?(?:ans|years?)\b', 1, 'i'), ''), ',', '.') AS DOUBLE) AS years FROM {_ASKED} a""")
def years_required(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("id", text.required_years(F.col("asked")).alias("years"))


@query(rf"""SELECT id, CASE WHEN regexp_extract(lower(asked), 'bac\s*\+\s*([0-9])', 1) <> '' THEN CAST(regexp_extract(lower(asked), 'bac\s*\+\s*([0-9])', 1) AS INTEGER)
    WHEN lower(asked) LIKE '%master%' THEN 5 WHEN regexp_matches(lower(asked), '\b(bts|dut)\b') THEN 2 END AS level FROM {_ASKED} a""")
def education_required(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("id", text.required_education(F.col("asked")).alias("level"))


@query(r"""SELECT page_id, length(regexp_replace(html, '\s+', '', 'g')) AS n_solid, length(html) < 2000 AS is_short FROM pages""")
def page_shape(spark: SparkSession, d: str) -> DataFrame:
    solid = F.regexp_replace("html", r"\s+", "")
    return scan(spark, d, "pages").select(
        "page_id", F.char_length(solid).cast("long").alias("n_solid"), (F.char_length("html") < 2000).alias("is_short")
    )


@query(r"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no_page' WHEN trim(text) = '' THEN 'no_text' WHEN length(text) < 100 THEN 'short' WHEN doc_id % 5 = 0 THEN 'no_page_with_text'
    WHEN doc_id % 7 >= 2 AND (doc_id % 5) / (doc_id % 7)::DOUBLE < 0.30 THEN 'few_pages_with_text'
    WHEN length(solid) < 600 AND length(regexp_replace(solid, '[^\p{L}]', '', 'g')) / length(solid)::DOUBLE < 0.30 THEN 'few_letters' END AS reason
    FROM (SELECT doc_id, text, regexp_replace(text, '\s+', '', 'g') AS solid FROM documents) x""")
def needs_ocr(spark: SparkSession, d: str) -> DataFrame:
    pages, filled = F.col("doc_id") % 7, F.col("doc_id") % 5
    return documents(spark, d).select("doc_id", text.needs_ocr(F.col("text"), pages, filled).alias("reason"))


@query(r"""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 1.0 WHEN contains(lower(c_name || ' ' || c_mktsegment), lower(n_name))
    OR (length(trim(split_part(lower(n_name), '_', 2))) >= 3 AND contains(lower(c_name || ' ' || c_mktsegment), trim(split_part(lower(n_name), '_', 2)))) THEN 1.0
    WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS score FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def location_score(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, d, "customer").join(scan(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    place = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Nowhere/"), F.col("c_mktsegment"))).otherwise(F.col("n_name"))
    return rows.select(F.col("c_custkey").alias("id"), text.location_score(place, F.concat_ws(" ", "c_name", "c_mktsegment")).alias("score"))


# Joins with dictionaries, strings and vectors.

_WORDS = r"""SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ+#.]+'), lambda x: x <> ''), lambda x: rtrim(x, '.')) AS w FROM documents"""


@query(rf"""SELECT doc_id, g.term, t.category, count(*) AS n FROM (
    SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
           list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM ({_WORDS}) a) g
    JOIN (VALUES {_TERMS}) t(term, category) ON t.term = g.term GROUP BY doc_id, g.term, t.category""")
def dictionary_matches(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame(list(TERMS), "term string, category string")
    return matching.dictionary_matches(documents(spark, d), terms, longest=3)


@query("""SELECT a.s AS name, b.s AS part FROM (SELECT DISTINCT p_name AS s FROM part) a
    JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS s FROM part) b ON contains(lower(a.s), lower(b.s)) OR contains(lower(b.s), lower(a.s))""")
def substring_join(spark: SparkSession, d: str) -> DataFrame:
    names = scan(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    parts = names.select(F.split_part("name", F.lit(" "), F.lit(2)).alias("part")).distinct()
    return matching.contains_either(names, parts, "name", "part").select("name", "part")


@query("""SELECT vec_id, other, floor(c * 1000000 + 0.5) / 1000000 AS cosine FROM (SELECT a.vec_id, b.vec_id AS other,
    list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))
    / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS c
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) x WHERE c >= 0.2""")
def cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    vectors = scan(spark, d, "embeddings")
    pairs = matching.vector_matches(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 0.2)
    return pairs.select(
        F.col("query_id").alias("vec_id"), F.col("vec_id").alias("other"), (F.floor(F.col("cosine") * 1_000_000 + 0.5) / 1_000_000).alias("cosine")
    )


@query(r"""WITH r AS (SELECT 'b' AS kind, item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda s: s <> '') AS w FROM benchmark
      UNION ALL SELECT 'd', doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda s: s <> '') FROM documents),
    h AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS run FROM r),
    k AS (SELECT DISTINCT x.id AS item_id, y.id AS doc_id FROM h x JOIN h y ON x.run = y.run WHERE x.kind = 'b' AND y.kind = 'd'),
    p AS (SELECT item_id, doc_id, b.text AS a, d.text AS b FROM k JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
    t AS (SELECT item_id, doc_id, 'x' AS side, list_filter(regexp_split_to_array(lower(a), '[^a-z0-9à-öø-ÿ]+'), lambda s: length(s) >= 2) AS w FROM p
          UNION ALL SELECT item_id, doc_id, 'y', list_filter(regexp_split_to_array(lower(b), '[^a-z0-9à-öø-ÿ]+'), lambda s: length(s) >= 2) FROM p),
    g AS (SELECT item_id, doc_id, side, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
    c AS (SELECT item_id, doc_id, term, side, ln(count(*)) + 1 AS tf FROM g GROUP BY ALL),
    m AS (SELECT item_id, doc_id, term, max(tf) FILTER (WHERE side = 'x') AS x, max(tf) FILTER (WHERE side = 'y') AS y FROM c GROUP BY ALL),
    i AS (SELECT item_id, doc_id, COALESCE(x, 0) * f AS x, COALESCE(y, 0) * f AS y FROM (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1.0 ELSE ln(1.5) + 1 END AS f FROM m) q),
    s AS (SELECT item_id, doc_id, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM i GROUP BY ALL)
    SELECT p.item_id, p.doc_id, COALESCE(floor(CASE WHEN xx * yy > 0 THEN xy / sqrt(xx * yy) ELSE 0 END * 1000000 + 0.5) / 1000000, 0.0) AS cosine FROM p LEFT JOIN s USING (item_id, doc_id)""")
def tfidf_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of whole texts, for the items and documents that share a run of five words."""
    items, docs = scan(spark, d, "benchmark").select("item_id", "text"), documents(spark, d).select("doc_id", "text")
    near = matching.shared_phrases(items, docs, "item_id", "doc_id")
    pairs = near.join(items.withColumnRenamed("text", "a"), "item_id").join(docs.withColumnRenamed("text", "b"), "doc_id")
    found = matching.tfidf_pairs(pairs, "a", "b", ["item_id", "doc_id"])
    return found.withColumn("cosine", F.floor(F.col("cosine") * 1_000_000 + 0.5) / 1_000_000)


@query("""SELECT a, b, distance FROM (SELECT x.n AS a, y.n AS b, levenshtein(x.n, y.n) AS distance,
    row_number() OVER (PARTITION BY x.n ORDER BY levenshtein(x.n, y.n), y.n) AS rn
    FROM (SELECT DISTINCT p_name AS n FROM part WHERE p_partkey % 100 = 0) x JOIN (SELECT DISTINCT p_name AS n FROM part) y ON x.n <> y.n) q WHERE rn = 1""")
def nearest_name(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the names of parts whose id is divisible by 100, against the names of all parts."""
    part = scan(spark, d, "part")
    asked = part.where("p_partkey % 100 = 0").select(F.col("p_name").alias("a"))
    return matching.nearest(asked, part.select(F.col("p_name").alias("b")), "a", "b")


@query()
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    names = scan(spark, d, "part").select(F.col("p_name").alias("term"))
    left = names.select(F.regexp_replace("term", "i", "").alias("term"))
    return matching.blocked_fuzzy(left, names, similarity.weighted_ratio_column, 82.0)


@query(f"""WITH w(place, sector, category, weight) AS (VALUES {", ".join(f"({_PLACES.index(s)}, '{s}', '{c}', {w})" for s, c, w in matching.SECTOR_WEIGHTS)}),
    c AS (SELECT l_suppkey AS id, CASE l_partkey % 6 WHEN 0 THEN 'langages' WHEN 1 THEN 'bases_de_donnees' WHEN 2 THEN 'data_ml_ia' WHEN 3 THEN 'devops_cloud' WHEN 4 THEN 'soft_skills' ELSE 'securite' END AS category, count(*) AS n FROM lineitem GROUP BY 1, 2),
    s AS (SELECT id, sector, place, sum(n * weight) AS score FROM c JOIN w USING (category) GROUP BY ALL),
    t AS (SELECT *, floor(score / sum(score) OVER (PARTITION BY id) * 10000 + 0.5) / 10000 AS share FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, place) AS rank FROM t)
    SELECT id, max(sector) FILTER (WHERE rank = 1) AS sector, max(share) FILTER (WHERE rank = 1) AS confidence,
           COALESCE(string_agg(sector, '|' ORDER BY rank) FILTER (WHERE rank > 1 AND share >= 0.15), '') AS secondary FROM r GROUP BY id""")
def sector_score(spark: SparkSession, d: str) -> DataFrame:
    names = ("langages", "bases_de_donnees", "data_ml_ia", "devops_cloud", "soft_skills", "securite")
    category = F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 6).cast("int") + 1)
    counts = scan(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), category.alias("category")).agg(F.count("*").alias("n"))
    return matching.sectors(counts)


@query()
def parsed_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Nested profiles of all documents, flattened to counts."""
    terms = spark.createDataFrame([(t, t.title(), c) for t, c in TERMS], "term string, name string, category string")
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"))
    parsed = profiles.parse(docs, terms, AS_OF)
    return parsed.select(
        "id", "error", "name", "email", F.coalesce(F.size("skills"), F.lit(0)).alias("n_skills"), F.coalesce(F.size("formations"), F.lit(0)).alias("n_formations"), "level", "years"
    )


@query(r"""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN '' ELSE array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 12), ' ') END AS words FROM conversations""")
def clipped_words(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "conversations").select("conv_id", "turn", text.clip_words(F.col("text"), 12).alias("words"))


@query(r"""SELECT n_name, trim(regexp_replace(strip_accents(lower(n_name)), '[''’`\-_/,;|\s]+', ' ', 'g')) AS code FROM nation""")
def domain_codes(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "nation").select("n_name", text.normalise_code(F.col("n_name")).alias("code"))


@query("""SELECT c_custkey AS id, CASE WHEN a % 3 = 1 THEN 'Anna Maria' WHEN a % 3 = 2 THEN 'x9' ELSE NULL END AS stored, 'Jean Paul' AS name_from FROM (SELECT c_custkey, c_custkey AS a FROM customer) x""")
def name_choice(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    stored = F.when(key % 3 == 1, "Anna Maria").when(key % 3 == 2, "x9")
    derived = text.name_from_email(F.lit("jean.paul75@example.com"))
    rows = scan(spark, d, "customer").select(key.alias("id"), stored.alias("stored"), derived.alias("name_from"))
    return rows


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 'Anna Maria' ELSE 'Jean Paul' END AS name FROM customer""")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    rows = name_choice(spark, d)
    chosen = listings.display_name(F.col("stored"), F.lit(None).cast("string"), F.col("name_from"), text.name_suspicious)
    return rows.select("id", chosen.alias("name"))
