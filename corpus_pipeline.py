"""Documents to training tokens, stage by stage.

Each stage reads the rows that its predecessor kept and its decision takes
effect: rejected documents go, one document of each near-duplicate group stays,
repeated passages go, the mix repeats or leaves out documents, tokens are added.

Defined results, for every stage: an empty table gives no rows; further columns
pass through whatever their names, but the last stage replaces those named like
its own. A null text counts as an empty one and stays null where its row stays.
What a stage does with nulls, ties and repeated rows beyond that, it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm import bpe, minhash, mixing, quality, substring
from hiresift.llm.common import cut, free_name, table
from hiresift.llm.queries import BYTE_VOCABULARY


#: Words of a shingle in the near-dedup stage; op3's contract of two words binds that query only.
SHINGLE_WORDS = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (fitted on the labelled rows of the input): rejected documents go.

    Each row is judged by its text alone, so repeated rows stay or go together;
    empty and null texts by the score of an empty text; a score of 0.7 stays.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return quality.score(docs, model, into=name).where(F.col(name) >= 0.7).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five words: one document of each group of near-duplicates stays.

    That is the one with the smallest id, and of several rows with its id and text
    one. Empty and null texts and rows without id are in no group and stay.
    """
    kept = cut(minhash.near_duplicates(docs, size=SHINGLE_WORDS).where("kept").select("doc_id"))
    counts = kept.agg(F.count("doc_id").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    unnamed = docs.where(F.col("doc_id").isNull())
    named = docs.join(kept.distinct(), "doc_id", "left_semi").select(*docs.columns)
    if counts.rows > counts.ids:
        named = named.dropDuplicates(["doc_id", "text"])
    return named.unionByName(unnamed)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that a document with a smaller id holds go, and documents of which nothing is left.

    Texts that lose nothing stay as they are, empty and null ones too; rows without
    id lose nothing, and rows that share an id nothing to each other.
    """
    name = free_name(docs, "repeats")
    of = {field: F.col(f"{name}.{field}") for field in ("n_removed", "n_words", "kept")}
    done = substring.remove_repeats(docs, into=name).where((of["n_removed"] == 0) | (of["n_removed"] < of["n_words"]))
    text = F.when(of["n_removed"] > 0, of["kept"]).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(of["n_removed"] > 0, F.char_length(of["kept"]).cast("long")).otherwise(F.col("n_chars"))
    return done.withColumns(changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents are repeated or left out as the mix takes them.

    A null source is one source; empty and null texts are taken as often as whole
    copies of their source are; repeated rows are taken alike.
    """
    return mixing.apply_mix(docs)


def add_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: the rows with their ids, how many there are, and whether they decode to the text.

    Empty and null texts have no ids; repeated rows have equal ones.
    """
    name = free_name(docs, "bpe")
    coded = bpe.encode_checked(docs, BYTE_VOCABULARY, into=name)
    own = coded.schema[name].dataType.fieldNames()
    return coded.select(*[c for c in docs.columns if c.lower() not in own], f"{name}.*")


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", add_tokens),
]

#: The stages hold a fitted model, a search index, sampling and BPE: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
