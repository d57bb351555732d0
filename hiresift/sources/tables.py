"""Table sources and sinks: CSV, JSON dictionaries, tables by name, model artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PAIR_LABELS = "offre_titre string, candidat_nom string, offer_dom string, cand_dom string, model_score double, human_label double, timestamp string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def append_csv(rows: DataFrame, path: str) -> None:
    """Rows as further CSV files, each with its header."""
    rows.write.mode("append").csv(path, header=True)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, synonym) from a JSON object of lists; empty if the file is missing."""
    empty = spark.createDataFrame([], "term string, synonym string")
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    table = F.from_json("value", "map<string, array<string>>")
    return raw.select(F.explode(table).alias("term", "synonyms")).select("term", F.explode("synonyms").alias("synonym"))


def merge_discovered(old: DataFrame, new: DataFrame) -> DataFrame:
    """Discovered terms (term, n) with the counts of both tables added."""
    return old.unionByName(new).groupBy("term").agg(F.sum("n").alias("n"))


def load_pipeline(path: str):
    """A stored pipeline model with no reason, or None with the reason why it is not ready."""
    from pyspark.ml import PipelineModel

    try:
        return PipelineModel.load(path), None
    except Exception as error:  # a missing or unreadable artefact is a state, not a failure
        return None, type(error).__name__


def with_details(matches: DataFrame, schema: str, column: str = "details") -> DataFrame:
    """Matches with their JSON details as a struct; null where they cannot be read."""
    return matches.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def append_notifications(rows: DataFrame, table: str) -> None:
    rows.write.mode("append").saveAsTable(table)
