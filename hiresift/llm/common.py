"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A word is a run of characters other than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(rows: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it none of the rows' columns."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for an empty text."""
    return F.filter(F.split(text, GAP_PATTERN), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder of the session.

    The folder is the one that ``spark.checkpoint.dir`` names. Only in local mode
    may that be unset: executors of a cluster do not see the driver's temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hiresift-checkpoint-"))
    return df.checkpoint(eager=eager)


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of a column written as text, modulo a divisor (null: as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


#: Bytes of text that one call of a per-text function gets at least, if there are as many; a longer text comes alone.
SLICE_BYTES = 2_000_000


def text_slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in slices of bounded text, each with its texts; null texts count as empty."""
    begin = size = 0
    lengths = pa.compute.binary_length(texts).fill_null(0).to_pylist()
    for end, length in enumerate(lengths, 1):
        size += length
        if size >= SLICE_BYTES or end == len(lengths):
            yield batch.slice(begin, end - begin), [t or "" for t in texts.slice(begin, end - begin).to_pylist()]
            begin, size = end, 0
    pa.default_memory_pool().release_unused()


def map_texts(docs: DataFrame, column: str, into: str, kind: DataType, start: Callable[[], Callable[[list[str]], pa.Array]]) -> DataFrame:
    """The rows with a column computed from their whole texts, slice by slice of an Arrow batch.

    ``start`` runs once in each task and returns the function from a list of
    texts to an array of as many values. Null texts count as empty. A column of
    the name ``into`` is replaced; all others pass through untouched.
    """
    rows = docs.drop(into) if into != column else docs
    names = [f.name for f in rows.schema.fields if f.name != into]
    place = rows.columns.index(column)
    keep = [i for i, c in enumerate(rows.columns) if c != into]
    fields = [rows.schema.fields[i] for i in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            for part, texts in text_slices(batch, batch.column(place)):
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], function(texts)], names=[*names, into])

    return rows.mapInArrow(run, StructType([*fields, StructField(into, kind)]))
