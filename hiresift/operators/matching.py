"""Similarity and dictionary joins: blocked before anything is compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import dictionary


def alias_join(left: DataFrame, right: DataFrame, aliases: DataFrame, skill: str = "skill") -> DataFrame:
    """Rows of both sides whose skills have one canonical form by an alias table (alias, canonical)."""

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(aliases.withColumnsRenamed({"alias": skill, "canonical": "_c"}), skill, "left").withColumn(
            "_c", F.coalesce("_c", skill)
        ).withColumnRenamed(skill, name)

    return spread_join(named(left, "left_skill"), named(right, "right_skill"), "_c").drop("_c")


#: Pairs of one task of a join of few and frequent keys.
TASK_PAIRS = 10_000_000


def spread_join(left: DataFrame, right: DataFrame, on: str, task_pairs: int = TASK_PAIRS, broadcast_rows: int | None = None) -> DataFrame:
    """The inner join of two sides by a key that few values may share, its pairs dealt to tasks of about as many.

    The side with fewer rows is broadcast if it is small: the other's rows are dealt to tasks by their
    keys and pairs, and travel once. Else a frequent key's rows are cut to slices on both sides, and each
    slice of the left meets each of the right: so many on either side that the fewest rows travel.
    """
    most = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    n = [side.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias(c)) for side, c in ((left, "_l"), (right, "_r"))]
    pairs = F.col("_l") * F.col("_r")
    keys = n[0].join(n[1], on).withColumn("_n", F.ceil(pairs / task_pairs))
    sums = keys.agg(F.sum(pairs).alias("pairs"), F.sum("_l").alias("left"), F.sum("_r").alias("right")).first()
    total = sums["pairs"] or 0
    if total <= task_pairs:
        return left.join(right, on)
    # Slices are spread evenly enough if each task has several.
    tasks = int(min(10_000, -(-total // task_pairs) * 2))
    place = lambda side, slices: F.pmod(F.xxhash64(*side.columns), F.coalesce(slices, F.lit(1))).cast("int")
    every = lambda slices: F.explode(F.sequence(F.lit(0), F.coalesce(slices, F.lit(1)) - 1))
    fewer, many = (left, right) if sums["left"] <= sums["right"] else (right, left)
    if min(sums["left"], sums["right"]) <= most and fewer.limit(most + 1).count() <= most:
        frequent = small(keys.where("_n > 1").select(on, F.col("_n").cast("int")))
        # A task's rows are of few keys, so that what it writes repeats itself.
        dealt = many.join(frequent, on, "left").repartition(tasks, on, place(many, F.col("_n"))).select(*many.columns)
        return F.broadcast(left).join(dealt, on) if fewer is left else dealt.join(F.broadcast(right), on)
    cuts = F.least(F.col("_n"), F.greatest(F.lit(1), F.round(F.sqrt(F.col("_n") * F.col("_l") / F.col("_r"))))).cast("int")
    frequent = small(keys.where("_n > 1").withColumn("_a", cuts).select(on, "_a", F.ceil(F.col("_n") / F.col("_a")).cast("int").alias("_b")))
    a, b = F.col("_a"), F.col("_b")
    own = left.join(frequent, on, "left").select(*left.columns, place(left, a).alias("_i"), every(b).alias("_j"))
    other = right.join(frequent, on, "left").select(*right.columns, every(a).alias("_i"), place(right, b).alias("_j"))
    met = [on, "_i", "_j"]
    return own.repartition(tasks, *met).join(other.hint("merge").repartition(tasks, *met), met).drop("_i", "_j")


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """A synonym relation in both directions."""
    return edges.select(a, b).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b))).where(F.col(a) != F.col(b)).distinct()


def enrich_dictionary(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, synonym) extended by an alias table in both directions; pairs that exist win."""
    new = symmetric(aliases.toDF("term", "synonym"), "term", "synonym")
    return terms.unionByName(new.join(terms, ["term", "synonym"], "left_anti"))


#: Rows up to which a dictionary or another small side is broadcast, by its count.
BROADCAST_ROWS = 200_000


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, broadcast if there are few of them."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


#: Rows of one task of a join that shuffles wide rows.
TASK_ROWS = 500_000


def looked_up(rows: DataFrame, own: DataFrame, key: str, about: int) -> DataFrame:
    """``rows``, about so many, with what ``own`` holds of their key: the inner join with a side whose size is told by its rows.

    Few rows are broadcast. Else no file size decides: both sides are dealt by the key to tasks of at most about
    ``TASK_ROWS`` rows and merged, so a task's memory does not grow with the tables.
    """
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(own), key)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-about // TASK_ROWS))
    return rows.repartition(tasks, key).join(own.repartition(tasks, key).hint("merge"), key)


def _spaced(text: str) -> Column:
    """The words of a text in lower case, joined by one space."""
    own = F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9à-öø-ÿ+#.]+"), lambda w: w != "")
    return F.array_join(F.transform(own, lambda w: F.rtrim(w, F.lit("."))), " ")


def _wanted(terms: DataFrame, longest: int) -> DataFrame:
    return terms.select(F.lower("term").alias("term"), "category").where(F.size(F.split("term", " ")) <= longest)


def dictionary_matches(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 4) -> DataFrame:
    """(key, term, category, n): how often each dictionary term of up to ``longest`` words occurs in a text.

    Words are joined by one space, and an automaton finds the terms between spaces.
    """
    return dictionary.counts(docs.select(key, _spaced(text).alias("text")), _wanted(terms, longest), key, guard="space")


def text_terms(docs: DataFrame, terms: DataFrame, text: str = "text", into: str = "terms", longest: int = 4) -> DataFrame:
    """The rows with the distinct (term, category) that ``dictionary_matches`` finds in a text, as an array."""
    return dictionary.held(docs.withColumn("_spaced", _spaced(text)), _wanted(terms, longest), "_spaced", into).drop("_spaced")


def _grams(words: str, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(F.col(words), i, n), " "))


#: Ratio from which on candidates are complete, if no other is asked for.
LEAST_RATIO = 82.0
#: Texts with a form shorter than this may share none, and weighted ratios end where one text is this many times as long.
TINY, MOST_SPAN = 4, 8


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "(?U)[\\s\\x1c-\\x1f]+"), lambda w: w != "")


def _forms(rows: DataFrame) -> DataFrame:
    """(term, form): a text as it is, with its words in order, and with its distinct words in order."""
    words = _words(F.col("term"))
    ordered = [F.array_join(F.array_sort(w), " ") for w in (words, F.array_distinct(words))]
    return rows.select("term", F.explode(F.array_distinct(F.array("term", *ordered))).alias("form"))


def _postings(forms: DataFrame) -> DataFrame:
    """(term, form, gram): the bigrams of each form, the second and later ones of a kind numbered."""
    starts = F.when(F.length("form") >= 2, F.sequence(F.lit(1), F.length("form") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = forms.withColumn("_g", F.transform(starts, lambda i: F.substring(F.col("form"), i, F.lit(2))))
    before = lambda g, i: F.size(F.filter(F.slice("_g", 1, i + 1), lambda x: x == g))
    return pairs.select("term", "form", F.explode(F.transform("_g", lambda g, i: F.concat(g, before(g, i).cast("string")))).alias("gram"))


def _rarest(postings: DataFrame, others: DataFrame, share: float) -> DataFrame:
    """(term, gram): so many of a form's bigrams, those rarest in the other texts first, that no near text misses all."""
    rarity = others.groupBy("gram").agg(F.count("*").alias("c"))
    marked = postings.join(rarity, "gram", "left").select("term", "form", F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram").alias("x"))
    held = marked.groupBy("term", "form").agg(F.sort_array(F.collect_list("x")).alias("all"))
    shared = F.greatest(F.lit(1), F.ceil(F.length("form") * share - 1 - 1e-9)).cast("int")
    first = F.slice("all", 1, F.size("all") - shared + 1)
    # A bigram that no other text has leads to none.
    return held.select("term", F.explode(F.filter(first, lambda x: x["c"] > 0)["gram"]).alias("gram")).distinct()


def fuzzy_candidates(a: DataFrame, b: DataFrame, ratio: float = LEAST_RATIO, sets: bool = False) -> DataFrame:
    """(a, b): distinct pairs of terms among which all of a weighted ratio of at least 82 are, or of a token-set ratio (``sets``).

    Such a ratio comes from one of three causes. A common word (a ratio of words in
    part is 100 then): such pairs meet by words of any length. A form of the shorter
    text, as it is or with its words in order, that fits a form of the longer or a
    stretch of it with a ratio of r >= 0.82: of m and n characters r * (m + n) / 2 match
    in order, at most (1 - r) * (m + n) do not, and each of these parts two neighbours
    at most once, so at least (1.5 * r - 1) * (m + n) - 1 bigrams are common, with n not
    below m. Hence of the shorter form's bigrams all but that many, the rarest first,
    hold a common one. Or a form of under four characters: these meet every text. Lengths
    more than eight times apart never reach the ratio. Token sets reach a ratio by a
    common word, whatever the lengths, or else by the forms of their distinct words.
    """
    # With r as a share, (1.5 * r - 1) * (m + n) is at least so much of the shorter form.
    share = 3 * ratio / 100 - 2
    if share * TINY <= 1:
        raise ValueError("at so low a ratio texts need not share a bigram")
    forms = {"a": _forms(a), "b": _forms(b)}
    grams = {side: _postings(f) for side, f in forms.items()}
    met = None
    for side, other in (("a", "b"), ("b", "a")):
        all_other = grams[other].select("term", "gram").distinct()
        ends = _rarest(grams[side], all_other, share).withColumnRenamed("term", side).join(all_other.withColumnRenamed("term", other), "gram").select("a", "b")
        met = ends if met is None else met.unionByName(ends)
    words = [x.select(F.col("term").alias(side), F.explode(F.array_distinct(_words(F.col("term")))).alias("w")) for side, x in (("a", a), ("b", b))]
    met = met.unionByName(words[0].join(words[1], "w").select("a", "b"))
    tiny = {side: f.where(F.length("form") < TINY).select(F.col("term").alias(side)).distinct() for side, f in forms.items()}
    # Texts of under four characters are few, however many rows there are.
    met = met.unionByName(b.select(F.col("term").alias("b")).join(small(tiny["a"]), F.lit(True)).select("a", "b"))
    met = met.unionByName(a.select(F.col("term").alias("a")).join(small(tiny["b"]), F.lit(True)).select("a", "b"))
    least, most = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    return met.where(least > 0 if sets else (least > 0) & (most <= MOST_SPAN * least)).distinct()


def blocked_fuzzy(left: DataFrame, right: DataFrame, score, least: float) -> DataFrame:
    """Best right term of each left term over a weighted ratio of at least 82, without loss.

    Both sides have a column ``term``; ``score(a, b)`` is a column from 0 to 100. Equal
    scores go to the right term that sorts first; null and empty terms have none.
    """
    if least < 82:
        raise ValueError("the candidates hold all pairs from 82 on only")
    a, b = (x.select("term").where("term <> ''").distinct() for x in (left, right))
    scored = fuzzy_candidates(a, b).withColumn("score", score(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("x"))
    return best.select("a", "x.b", (-F.col("x.s")).alias("score"))


def against_all(queries: DataFrame, rows: DataFrame, block_rows: int = 2_048) -> DataFrame:
    """A stated set of queries with every row, in blocks: each row meets each block of queries once.

    The queries are such as the offers of a day; neither side is held whole by a task.
    """
    blocks = max(1, -(-queries.count() // block_rows))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)))
    spread = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return spread.join(small(dealt), "_block").drop("_block")


def nearest(queries: DataFrame, rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, distance): of each query the nearest other text by edit distance, of equals the one that sorts first."""
    pairs = against_all(queries.select(a).distinct(), rows.select(b).distinct()).where(F.col(a) != F.col(b))
    best = F.min(F.struct(F.levenshtein(a, b).cast("long").alias("distance"), F.col(b).alias(b))).alias("best")
    return pairs.groupBy(a).agg(best).select(a, F.col(f"best.{b}").alias(b), "best.distance")


def contains_either(left: DataFrame, right: DataFrame, a: str, b: str, gram: int = 3) -> DataFrame:
    """Rows of which one text holds the other, without regard to case.

    A text that is held shares all its character n-grams with the holder, so its
    middle one meets those of the holder by an equi-join. Texts shorter than
    ``gram`` have none and are compared with every row of the other side.
    """

    def held(whole: DataFrame, part: DataFrame, w: str, p: str) -> DataFrame:
        text, piece = F.lower(F.col(w)), F.lower(F.col(p))
        starts = F.when(F.length(text) >= gram, F.sequence(F.lit(1), F.length(text) - (gram - 1)))
        grams = whole.withColumn("_g", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(gram))))))
        middle = F.substring(piece, F.floor((F.length(piece) - gram) / 2).cast("int") + 1, F.lit(gram))
        long = part.where(F.length(p) >= gram).withColumn("_g", middle)
        short = part.where(F.length(p) < gram)
        pairs = grams.join(long, "_g").drop("_g").unionByName(whole.join(short, F.lit(True)))
        return pairs.where(F.contains(text, piece)).select(*left.columns, *right.columns)

    return held(left, right, a, b).unionByName(held(right, left, b, a)).distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either has no length."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


#: Queries and vectors of one group of a vector search: so its pairs are bounded, and what they return.
QUERY_BLOCK, VECTOR_SLICE = 1_024, 8_192
#: Queries whose products with a slice are summed at once, for the processor's cache.
TILE = 8


def _by_size(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and components, a dimension a row, of the vectors of each size; null ones have the size -1."""
    sizes = np.array(pc.fill_null(pc.list_value_length(column), -1), dtype="int64")
    flat = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy()
    ends = np.cumsum(np.maximum(sizes, 0))
    out = {}
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        starts = (ends - np.maximum(sizes, 0))[places]
        out[int(size)] = places, np.ascontiguousarray(flat[np.arange(max(size, 0))[:, None] + starts[None, :]])
    return out


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two sets of vectors, summed from the first dimension to the last as a plain sum is."""
    total = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    held = np.empty_like(total)
    for x, y in zip(a, b, strict=True):
        np.multiply(x, y, out=held)
        total += held
    return total


def _cosines(q: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, cosines) of each tile of queries with all vectors; 0 where either has no length."""
    own, other = np.sqrt(_added(q, q)), np.sqrt(_added(v, v))
    for begin in range(0, q.shape[1], TILE):
        length = own[begin : begin + TILE, None] * other[None, :]
        found = _added(q[:, begin : begin + TILE, None], v[:, None, :])
        yield begin, np.divide(found, length, out=np.zeros_like(found), where=~(length <= 0))


def _group_matches(queries: pa.Table, vectors: pa.Table, least: float) -> pa.Table:
    """The pairs of a group that reach the cosine; as in SQL, one that is no number is above all."""
    a, b = _by_size(queries["_v"]), _by_size(vectors["_v"])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size, (rows, q) in a.items():
        for other, (columns, v) in b.items():
            if size == other >= 0:
                for begin, value in _cosines(q, v):
                    i, j = np.nonzero(~(value < least))
                    found.append((rows[begin + i], columns[j], value[i, j]))
            elif least <= 0:
                # A null vector has the cosine 0 with all; of two sizes, only one without length has.
                free = np.ones((len(rows), len(columns)), dtype=bool)
                if min(size, other) >= 0:
                    free = np.sqrt(_added(q, q))[:, None] * np.sqrt(_added(v, v))[None, :] <= 0
                i, j = np.nonzero(free)
                found.append((rows[i], columns[j], np.zeros(len(i))))
    i, j, value = (np.concatenate([f[n] for f in found] or [np.empty(0, dtype=kind)]) for n, kind in enumerate(("int64", "int64", "float64")))
    pairs = pa.table({"query_id": queries["_k"].take(pa.array(i)), "vec_id": vectors["_k"].take(pa.array(j)), "cosine": pa.array(value)})
    return pairs.filter(pc.not_equal(pairs["query_id"], pairs["vec_id"]))


def vector_matches(queries: DataFrame, vectors: DataFrame, key: str, vector: str, least: float, block: str | None = None) -> DataFrame:
    """Pairs of a query and a vector with at least a cosine, within equal values of ``block`` if given.

    The queries are a stated set, such as the offers of a day. Both sides are dealt to
    slices of bounded size; each two slices of a block meet once, as matrices.
    """

    def dealt(rows: DataFrame, slice_rows: int, into: str) -> tuple[DataFrame, DataFrame]:
        whole = F.when(F.forall(vector, lambda x: x.isNotNull()), F.col(vector))
        own = rows.select((F.col(block) if block else F.lit(0)).alias("_b"), F.col(key).alias("_k"), whole.alias("_v")).where(F.col("_b").isNotNull() & F.col("_k").isNotNull())
        slices = own.groupBy("_b").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias(f"_n{into}"))
        return own, slices

    (a, q), (b, v) = dealt(queries, QUERY_BLOCK, "q"), dealt(vectors, VECTOR_SLICE, "v")
    slices = small(q.join(v, "_b"))
    place = lambda n: F.pmod(F.xxhash64("_k", "_b"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["_b", "_q", "_s"]
    a = a.join(slices, "_b").withColumn("_q", place("_nq")).withColumn("_s", every("_nv")).select(*keys, "_k", "_v")
    b = b.join(slices, "_b").withColumn("_s", place("_nv")).withColumn("_q", every("_nq")).select(*keys, "_k", "_v")
    kinds = queries.select(F.col(key).alias("query_id")).schema.fields + vectors.select(F.col(key).alias("vec_id")).schema.fields
    found = StructType([StructField(f.name, f.dataType) for f in kinds] + [StructField("cosine", DoubleType())])
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda x, y: _group_matches(x, y, least), found)


def domain_relation(pairs: DataFrame, adjacency: DataFrame, a: str = "offer_domain", b: str = "candidate_domain") -> DataFrame:
    """Relation of two domain codes: same, adjacent (either direction), same_major (equal first two letters), different, unknown."""
    near = symmetric(adjacency.toDF(a, b), a, b).withColumn("_near", F.lit(True))
    kind = (
        F.when(F.col(a).isNull() | F.col(b).isNull(), "unknown")
        .when(F.col(a) == F.col(b), "same")
        .when(F.col("_near"), "adjacent")
        .when(F.substring(a, 1, 2) == F.substring(b, 1, 2), "same_major")
        .otherwise("different")
    )
    return pairs.join(small(near), [a, b], "left").withColumn("relation", kind).drop("_near")


def shared_phrases(items: DataFrame, docs: DataFrame, item: str, doc: str, size: int = 5) -> DataFrame:
    """(item, doc): pairs whose whole texts (column ``text``) share a run of ``size`` words; runs travel as hashes."""

    def runs(rows: DataFrame, key: str) -> DataFrame:
        own = F.filter(F.split(F.lower("text"), r"[^a-z0-9à-öø-ÿ]+"), lambda w: w != "")
        return rows.select(key, own.alias("w")).select(key, F.explode(F.array_distinct(F.transform(_grams("w", size), lambda g: F.xxhash64(g)))).alias("_h"))

    return runs(docs, doc).join(small(runs(items, item)), "_h").select(item, doc).distinct()


def tfidf_pairs(pairs: DataFrame, a: str, b: str, key: list[str], grams: int = 2) -> DataFrame:
    """Cosine of the TF-IDF vectors of each pair of texts, fitted on the two texts alone.

    Words and word pairs; sublinear counts; inverse document frequency
    ln(3 / (1 + df)) + 1, where df is 1 or 2.
    """

    def counted(text: str, side: str) -> DataFrame:
        own = F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9à-öø-ÿ]+"), lambda w: F.length(w) >= 2)
        rows = pairs.select(*key, own.alias("w"))
        terms = F.concat(*[_grams("w", n) for n in range(1, grams + 1)])
        return rows.select(*key, F.explode(terms).alias("term")).groupBy(*key, "term").agg((F.log(F.count("*")) + 1).alias(side))

    both = counted(a, "x").join(counted(b, "y"), [*key, "term"], "full")
    idf = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.lit(1.0)).otherwise(F.log(F.lit(1.5)) + 1)
    x, y = F.coalesce("x", F.lit(0.0)) * idf, F.coalesce("y", F.lit(0.0)) * idf
    sums = both.groupBy(*key).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    length = F.sqrt(F.col("xx") * F.col("yy"))
    found = sums.select(*key, F.when(length > 0, F.col("xy") / length).otherwise(F.lit(0.0)).alias("cosine"))
    return pairs.select(*key).join(found, key, "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


# Sector, skill category, weight of the category in the sector.
SECTOR_WEIGHTS = (
    ("informatique_dev", "langages", 3.0),
    ("informatique_dev", "frameworks_web", 3.0),
    ("informatique_dev", "frameworks_mobile", 3.0),
    ("informatique_dev", "bases_de_donnees", 2.0),
    ("informatique_dev", "outils_dev", 2.0),
    ("informatique_dev", "tests_qualite", 2.0),
    ("informatique_dev", "methodologies", 1.0),
    ("data_ia", "data_ml_ia", 5.0),
    ("data_ia", "langages", 0.5),
    ("data_ia", "bases_de_donnees", 0.5),
    ("devops_cloud", "devops_cloud", 5.0),
    ("devops_cloud", "systemes_reseaux", 3.0),
    ("devops_cloud", "methodologies", 0.5),
    ("cybersecurite", "securite", 5.0),
    ("cybersecurite", "systemes_reseaux", 2.0),
    ("marketing_digital", "marketing_digital", 5.0),
    ("marketing_digital", "soft_skills", 0.5),
    ("finance_comptabilite", "comptabilite_finance", 5.0),
    ("sante_medical", "sante_medical", 5.0),
    ("rh_recrutement", "rh_recrutement", 5.0),
    ("rh_recrutement", "soft_skills", 0.5),
    ("droit_juridique", "droit_juridique", 5.0),
    ("architecture_btp", "architecture_btp", 5.0),
    ("architecture_btp", "metiers_manuels", 0.5),
    ("sciences_recherche", "sciences_recherche", 5.0),
    ("enseignement", "enseignement_pedagogie", 5.0),
    ("logistique_supply_chain", "logistique_supply_chain", 5.0),
    ("logistique_supply_chain", "methodologies", 0.3),
    ("agroalimentaire_qualite", "agroalimentaire_qualite", 5.0),
    ("metiers_manuels", "metiers_manuels", 5.0),
)


def sector_weights(spark) -> DataFrame:
    """(place, sector, category, weight), sectors in their listed order."""
    order = list(dict.fromkeys(sector for sector, _, _ in SECTOR_WEIGHTS))
    rows = [(order.index(sector), sector, category, weight) for sector, category, weight in SECTOR_WEIGHTS]
    return spark.createDataFrame(rows, "place int, sector string, category string, weight double")


def sectors(counts: DataFrame, key: str = "id", signals: DataFrame | None = None, secondary: float = 0.15) -> DataFrame:
    """Sector of each profile from its numbers of skills by category (key, category, n) and text signals (key, sector, hits).

    Shares of the weighted sum; the first of equal sectors wins; sectors of at
    least ``secondary`` besides the first are listed by share.
    """
    weights = F.broadcast(sector_weights(counts.sparkSession))
    scored = counts.join(weights, "category").select(key, "sector", (F.col("n") * F.col("weight")).alias("score"))
    if signals is not None:
        scored = scored.unionByName(signals.select(key, "sector", (F.col("hits") * 8.0).alias("score")))
    places = weights.select("sector", "place").distinct()
    total = Window.partitionBy(key)
    shares = (
        scored.groupBy(key, "sector")
        .agg(F.sum("score").alias("score"))
        .join(F.broadcast(places), "sector")
        .withColumn("share", F.floor(F.col("score") / F.sum("score").over(total) * 10_000 + 0.5) / 10_000)
        .withColumn("rank", F.row_number().over(total.orderBy(F.col("share").desc(), "place")))
    )
    other = F.transform(
        F.sort_array(F.collect_list(F.when((F.col("rank") > 1) & (F.col("share") >= secondary), F.struct("rank", "sector")))), lambda s: s["sector"]
    )
    return shares.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("sector"))).alias("sector"),
        F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("confidence"),
        F.array_join(other, "|").alias("secondary"),
    )
