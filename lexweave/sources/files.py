"""Files to pages. PDF text needs the optional ``pypdf``; everything downstream takes any table of pages."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T

PDF_GLOB = "*.[pP][dD][fF]"
PAGES = "source_file string, page int, text string, error string"


def pdf_pages(content: bytes) -> list[str]:
    """Text of every page, empty where there is none."""
    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def text_pages(content: bytes) -> list[str]:
    """Plain text, one page per form feed."""
    return content.decode("utf-8", errors="replace").split("\f")


def list_files(spark: SparkSession, folder: str, glob: str = PDF_GLOB, limit: int | None = None) -> DataFrame:
    """Paths of the folder's files, in order, the first ``limit`` if given; contents aren't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime", "length")
    rows = rows.orderBy("path")
    return rows.limit(limit) if limit else rows


def latest_by_name(files: DataFrame) -> DataFrame:
    """One file per base name, the latest; ties by path."""
    w = Window.partitionBy("source_file").orderBy(F.desc("modificationTime"), F.desc("path"))
    return files.withColumn("source_file", T.base_name(F.col("path"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def only_pdf(names: DataFrame, column: str = "name") -> DataFrame:
    """Rows whose name ends in .pdf in any case; of equal names the last in order of ``seq``."""
    w = Window.partitionBy(column).orderBy(F.desc("seq"))
    return names.where(F.lower(column).endswith(".pdf")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_pages(files: DataFrame, parse: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """``files(path, content[, display_name])`` to pages numbered from 1. A file that can't be read is one row with an ``error``."""
    display = F.col("display_name") if "display_name" in files.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["source_file"], batch["content"]):
                try:
                    rows += [(name, k, t, None) for k, t in enumerate(parse(content), 1)]
                except Exception as e:  # the file's failure, kept with the file
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select(T.source_name(F.col("path"), display).alias("source_file"), "content").mapInPandas(run, PAGES)
