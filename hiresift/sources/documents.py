"""CV files: routing by format, validation, and text of DOCX and other files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest upload in bytes, itself allowed.
MOST_BYTES = 10 * 1024 * 1024
FORMATS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "bmp": "image"}


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files of a folder with their format and the SHA-256 by which extractions are kept."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return routed(found).withColumn("sha256", F.sha2("content", 256))


def routed(found: DataFrame) -> DataFrame:
    """Rows with the format that their path's suffix names; null for one that is not supported."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return found.withColumn("format", F.try_element_at(table, suffix))


def validated(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and rejected ones with a reason."""
    reason = F.when(F.col("format").isNull(), "format").when(F.col("length") > MOST_BYTES, "size")
    marked = found.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, then cells of its tables that are not among them."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")

    def words(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()

    out = [w for p in body.findall(f"{_W}p") if (w := words(p))]
    seen = set(out)
    for cell in body.iter(f"{_W}tc"):
        w = words(cell)
        if w and w not in seen:
            seen.add(w)
            out.append(w)
    return "\n".join(out)


def plain_pdf_text(content: bytes) -> str:
    """Literal strings of uncompressed PDF pages; enough for simple files, to be replaced by an extractor of the user's."""
    return "\n".join(m.decode("latin-1") for m in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", content))


def extracted(found: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None, least: int = 1) -> DataFrame:
    """Rows with text, success and error; a file that cannot be read is an error row, never a failure.

    ``extractors`` adds or replaces functions by format; a format without one is
    an error row.
    """
    by_format = {"docx": docx_text, "pdf": plain_pdf_text} | (extractors or {})

    @F.pandas_udf("text string, success boolean, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, contents in batches:
            rows = []
            for kind, content in zip(kinds, contents, strict=True):
                try:
                    text = by_format[kind](bytes(content))
                    fine = len(text.strip()) >= least
                    rows.append((text, fine, None if fine else "too_short"))
                except KeyError:
                    rows.append((None, False, "unsupported"))
                except Exception as error:  # one broken file must not end the job
                    rows.append((None, False, type(error).__name__))
            yield pd.DataFrame(rows, columns=["text", "success", "error"])

    return found.withColumn("_r", read("format", "content")).select("*", "_r.*").drop("_r")


def cached(found: DataFrame, cache: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Texts by SHA-256: those kept, and those extracted now for files not seen before."""
    known = found.select("path", "sha256").join(cache.select("sha256", "text"), "sha256")
    fresh = extract(found.join(cache.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])).select("sha256", "text")
    return known.unionByName(found.select("path", "sha256").join(fresh, "sha256"))
