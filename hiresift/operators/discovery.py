"""Discovery of unknown skills: by their place in a skills section, and by what they occur together with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionary
from .matching import small

# Words that join others, second words of plain phrases, and pieces of names that are no skills.
JOINING = frozenset(
    "and or with for the a an to of in et ou de du des la le les un une en au aux par pour sur avec sans autres autre divers various including".split()
)
PHRASE_SECOND = frozenset("de des du la le les a aux en par pour sur avec sans dans et ou".split())
NO_SKILL = (
    r"compétences?|skills?|techniques?|outils?|tools?|baccalauréat|baccalaureat|licence|master|diplôme|diplome"
    r"|activités?|activites?|académique|academique|extra|tunisie|france|maroc|algerie|paris|tunis"
)
_EDGES = " \t-–—*►▪◆○●"


def _items(text: Column, separators: str) -> Column:
    """Pieces of a text between separators, trimmed, inner white space as one space."""
    trimmed = F.transform(F.split(text, separators), lambda t: F.btrim(F.regexp_replace(F.btrim(t, F.lit(_EDGES)), r"\s+", " ")))
    return F.filter(trimmed, lambda t: F.char_length(t).between(2, 40) & F.rlike(t, F.lit("[A-Za-zÀ-ÿ]")))


def _phrase(item: Column) -> Column:
    words = F.split(item, " ")
    return (F.size(words) >= 2) & F.lower(F.get(words, F.lit(1))).isin(sorted(PHRASE_SECOND))


def section_terms(sections: DataFrame, known: DataFrame, key: str = "id", section: str = "section") -> DataFrame:
    """(key, term): what a skills section lists and no dictionary term (term) equals, each once in its first spelling.

    Items stand between commas, bars, semicolons, bullets, slashes and line breaks, and
    have at most five words; plain phrases ("production de ...") count only if known.
    """
    held = sections.select(key, F.posexplode(_items(F.coalesce(F.col(section), F.lit("")), r"[,|;•·\n\r/]")).alias("place", "term"))
    low = F.lower("term")
    fine = (F.size(F.split("term", " ")) <= 5) & ~F.rlike(low, F.lit(NO_SKILL)) & ~_phrase(F.col("term"))
    first = held.where(fine).groupBy(key, low.alias("_t")).agg(F.min_by("term", "place").alias("term"))
    return first.join(known.select(F.lower("term").alias("_t")).distinct(), "_t", "left_anti").select(key, "term")


def beside_known(sections: DataFrame, known: DataFrame, key: str = "id", section: str = "section") -> DataFrame:
    """(key, term): terms of technical look that stand in one line of a section with a known term (term), each once.

    A term of technical look begins with a capital, is all capitals, or holds a digit or
    one of . - + # beside letters; it has at most three words and is none of the known ones.
    """
    lines = sections.select(key, F.explode(F.split(F.coalesce(F.col(section), F.lit("")), "[\n\r|•·►▪●◆]")).alias("line"))
    lines = lines.where(F.char_length(F.trim("line")).between(4, 300))
    long = known.where(F.char_length("term") >= 3).select("term", F.lit(None).cast("string").alias("category"))
    held = dictionary.mentions(lines, long, "line", into="_m", contexts={}).where(F.size("_m") > 0)
    found = held.select(key, F.explode(_items(F.col("line"), "[,;/]")).alias("term"))
    item = F.col("term")
    technical = F.rlike(item, F.lit(r"^\p{Lu}|[A-Za-z]\d|\d[A-Za-z]|[A-Za-z][.\-+#][A-Za-z]"))
    fine = (F.size(F.split(item, " ")) <= 3) & technical & ~_phrase(item) & ~F.lower(item).isin(sorted(JOINING))
    first = found.where(fine).groupBy(key, F.lower(item).alias("_t")).agg(F.min("term").alias("term"))
    return first.join(known.select(F.lower("term").alias("_t")).distinct(), "_t", "left_anti").select(key, "term")


#: Rows of baskets, and pairs formed from them, that one task holds about.
TASK_ROWS, TASK_PAIRS = 1_000_000, 3_000_000


def cooccurrences(baskets: DataFrame, key: str, item: str, least: int, lift: float) -> DataFrame:
    """(a, b, n_a, n_b, n, lift): pairs of items, a before b, that ``least`` baskets share and whose lift is at least ``lift``.

    The lift of a pair is n * baskets / (n_a * n_b). As a pair cannot be in more baskets than
    its rarer item, an item in more than baskets / lift of them reaches it with none: such
    items, fewer than lift * rows / baskets, leave before any pair is formed, without loss.
    So no item brings more than baskets / lift rows. Baskets are dealt to tasks by their rows
    and pairs; inside a basket each item meets those behind it in order, a row at a time, and
    counts are added up before they travel. Null keys and items take no part; an item counts
    once a basket.
    """
    if lift <= 0:
        raise ValueError("a lift above 0 is needed to leave items out without loss")
    rows = baskets.select(F.col(key).alias("k"), F.col(item).alias("i")).where(F.col("k").isNotNull() & F.col("i").isNotNull())
    least_tasks = baskets.sparkSession.sparkContext.defaultParallelism

    def dealt(tasks: int) -> DataFrame:
        own = rows.repartition(max(tasks, least_tasks), "k").distinct()
        return own.groupBy("k").agg(F.sort_array(F.collect_list("i")).alias("all"))

    def counted(held: DataFrame) -> DataFrame:
        """(i, c, p): items and their baskets; with a null item all baskets and their pairs."""
        size = F.size("all").cast("long")
        each = held.select(F.floor(size * (size - 1) / 2).alias("p"), F.explode(F.concat("all", F.array(F.lit(None)))).alias("i"))
        return each.groupBy("i").agg(F.count("*").alias("c"), F.sum(F.when(F.col("i").isNull(), F.col("p"))).alias("p"))

    tasks = -(-rows.count() // TASK_ROWS)
    counts = counted(dealt(tasks))
    whole = counts.where(F.col("i").isNull()).select(F.col("c").alias("total"), F.col("p").alias("formed"))
    often = F.col("i").isNull() | (F.col("c") * F.lit(float(lift)) > F.col("total") * (1 + 1e-9))
    known = counts.select("i", "c").join(F.broadcast(whole), often).collect()
    total, formed = (known[0]["total"], known[0]["formed"]) if known else (0, 0)
    held = dealt(max(tasks, -(-formed // TASK_PAIRS)))
    counts = counted(held).where(F.col("i").isNotNull())
    if frequent := [r["i"] for r in known if r["i"] is not None]:
        held = held.withColumn("all", F.array_except("all", F.array(*map(F.lit, frequent)).cast(held.schema["all"].dataType)))
    first = held.where(F.size("all") > 1).select("all", F.posexplode("all").alias("at", "a"))
    behind = F.slice("all", F.col("at") + 2, F.greatest(F.size("all") - F.col("at") - 1, F.lit(0)))
    found = first.select("a", F.explode(behind).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    for own, n in (("a", "n_a"), ("b", "n_b")):
        found = found.join(counts.select(F.col("i").alias(own), F.col("c").alias(n)), own)
    value = F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))
    return found.select("a", "b", "n_a", "n_b", "n").withColumn("lift", value).where(F.col("lift") >= lift)


def associated_terms(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(term, known, lift, n): unknown items with the known one (term) that they go best with, of equals the first."""
    both = pairs.select(F.col("a").alias("term"), F.col("b").alias("known"), "lift", "n").unionByName(
        pairs.select(F.col("b").alias("term"), F.col("a").alias("known"), "lift", "n")
    )
    names = small(known.select(F.col("term").alias("known")).distinct())
    open_ = both.join(names, "known", "left_semi").join(names.withColumnRenamed("known", "term"), "term", "left_anti")
    top = open_.groupBy("term").agg(F.max(F.struct("lift", "n")).alias("m")).join(open_, "term")
    top = top.where((F.col("lift") == F.col("m.lift")) & (F.col("n") == F.col("m.n")))
    return top.groupBy("term").agg(F.min("known").alias("known"), F.first("lift").alias("lift"), F.first("n").alias("n"))
