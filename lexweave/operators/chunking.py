"""Pages or whole texts to overlapping chunks with page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T


def page_words(pages: DataFrame) -> DataFrame:
    """``pages(source_file, page, text)`` to one row per source with its words and their pages, in page order.

    A source's words are gathered in one row, as its chunks run across pages; sources are spread over the cluster.
    """
    parts = pages.select("source_file", F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    words = F.flatten(F.transform("p", lambda p: F.transform(T.words(p["text"]), lambda w: F.struct(w.alias("word"), p["page"].alias("page")))))
    return parts.select("source_file", words.alias("words"))


def chunk_words(sources: DataFrame, size: int = 350, overlap: int = 50) -> DataFrame:
    """Chunks of ``sources(source_file, words: array<struct<word, page>>)``; a source without words has none.

    Further columns of a source are inherited by its chunks.
    """
    inherited = [c for c in sources.columns if c not in ("source_file", "words")]
    rows = sources.select("source_file", *inherited, F.posexplode(T.windows(F.col("words"), size, overlap)).alias("chunk_index", "w"))
    return rows.select(
        T.chunk_id(F.col("source_file"), F.col("chunk_index")).alias("chunk_id"),
        "source_file",
        "chunk_index",
        F.array_join(F.col("w.word"), " ").alias("text"),
        F.size("w").alias("word_count"),
        F.element_at("w", 1)["page"].alias("page_start"),
        F.element_at("w", -1)["page"].alias("page_end"),
        *inherited,
    )


def chunk_pages(pages: DataFrame, size: int = 350, overlap: int = 50) -> DataFrame:
    return chunk_words(page_words(pages), size, overlap)


def chunk_sections(sections: DataFrame, label: str = "classification", size: int = 350, overlap: int = 50) -> DataFrame:
    """Chunks of ``sections(source_file, section, text, <label>)`` that never cross a section: each inherits its label.

    Sections are numbered in order; the chunk index counts on through a source, so ids stay unique. A null text is
    empty and gives no chunk; a null label is inherited as it is. An empty table gives no rows.
    """
    worded = sections.select("source_file", "section", F.col(label).alias("_label"), T.words(F.coalesce("text", F.lit(""))).alias("words"))
    counted = worded.withColumn("_k", T.window_count(F.size("words"), size, overlap))
    before = Window.partitionBy("source_file").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("source_file", "section", "_k").groupBy("source_file", "section").agg(F.sum("_k").alias("_k"))
    first = first.withColumn("_first", F.coalesce(F.sum("_k").over(before), F.lit(0)).cast("int")).drop("_k")
    placed = worded.join(first, ["source_file", "section"])
    rows = placed.select("source_file", "section", "_label", "_first", F.posexplode(T.windows(F.col("words"), size, overlap)).alias("_i", "w"))
    index = (F.col("_first") + F.col("_i")).cast("int")
    return rows.select(
        T.chunk_id(F.col("source_file"), index).alias("chunk_id"), "source_file", index.alias("chunk_index"), "section", F.array_join("w", " ").alias("text"), F.size("w").alias("word_count"), F.col("_label").alias(label)
    )


def chunk_texts(docs: DataFrame, source: str = "source_file", text: str = "text", size: int = 350, overlap: int = 50) -> DataFrame:
    """Chunks of whole texts, without pages and without a shuffle: ``chunk_id, source_file, chunk_index, text, word_count``."""
    # the words are a column of their own: within the windows' expression the text would be split once per window
    worded = docs.select(F.col(source).alias("source_file"), T.words(F.col(text)).alias("words"))
    rows = worded.select("source_file", F.posexplode(T.windows(F.col("words"), size, overlap)).alias("chunk_index", "w"))
    return rows.select(
        T.chunk_id(F.col("source_file"), F.col("chunk_index")).alias("chunk_id"), "source_file", "chunk_index", F.array_join("w", " ").alias("text"), F.size("w").alias("word_count")
    )


def summaries(docs: DataFrame, source: str = "source_file", text: str = "text", size: int = 350, overlap: int = 50) -> DataFrame:
    """Totals per source: words and chunks, computed without building chunks."""
    n = F.size(T.words(F.coalesce(F.col(text), F.lit(""))))
    return docs.select(F.col(source).alias("source_file"), n.alias("total_words"), T.window_count(n, size, overlap).alias("chunk_count"))


def to_json(chunks: DataFrame) -> DataFrame:
    """One JSON payload per source: its file, totals and chunks in order."""
    fields = [c for c in ("chunk_index", "text", "word_count", "page_start", "page_end") if c in chunks.columns]
    grouped = chunks.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("chunks"))
    return grouped.select("source_file", F.to_json(F.struct("source_file", F.size("chunks").alias("chunk_count"), "chunks")).alias("payload"))
