"""Files landing in a folder to the chunk table, exactly once per source, with progress as a table.

A re-upload needs a fresh path in the landing folder, as a file stream ignores a path that it has seen: the folder of
an upload is its random part, the file's name its source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lexweave.config import Settings
from lexweave.functions.text import window_count
from lexweave.operators import candidates as C
from lexweave.operators import chunking, tables
from lexweave.sources.files import PDF_GLOB, pdf_pages, read_pages

_FILES = "path string, modificationTime timestamp, length long, content binary"


def landing_stream(spark: SparkSession, folder: str, glob: str = PDF_GLOB, files_per_trigger: int = 4) -> DataFrame:
    """New files of the folder and its sub-folders, a bounded number at a time."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", files_per_trigger).load(folder)


def ingest_batch(files: DataFrame, chunks_path: str, parse: Callable[[bytes], list[str]] = pdf_pages, embedder=None, settings: Settings = Settings()) -> DataFrame:
    """Replace the chunks of the files' sources and return one progress row per source. Running it again changes nothing."""
    pages = read_pages(files, parse).persist()
    try:
        good = pages.where("error is null").select("source_file", "page", "text")
        chunks = chunking.chunk_pages(good, settings.chunk_words, settings.overlap_words)
        if embedder is not None:
            chunks = C.embed(chunks, embedder, "text", "vector")
        # a source that has no chunk any more is replaced too; one that can't be read keeps what it had
        tables.write_replacing(chunks, chunks_path, sources=good.select("source_file"))
        words = chunking.page_words(good).select("source_file", F.size("words").alias("total_words"))
        n = words.select("source_file", "total_words", F.lit(None).cast("string").alias("error"))
        failed = pages.where("error is not null").select("source_file", F.lit(None).cast("int").alias("total_words"), "error")
        rows = n.unionByName(failed)
        kind = F.when(F.col("error").isNull(), "done").otherwise("error")
        count = F.when(F.col("error").isNull(), window_count(F.col("total_words"), settings.chunk_words, settings.overlap_words))
        out = rows.select(kind.alias("type"), F.col("source_file").alias("file"), "error", "total_words", count.alias("chunk_count"), F.current_timestamp().alias("timestamp"))
        return files.sparkSession.createDataFrame(out.collect(), out.schema)  # a few rows: at most the batch's files
    finally:
        pages.unpersist()


def start_ingest(spark: SparkSession, folder: str, chunks_path: str, progress_path: str, checkpoint: str, parse: Callable[[bytes], list[str]] = pdf_pages, glob: str = PDF_GLOB, embedder=None, settings: Settings = Settings()) -> StreamingQuery:
    """Ingest what is there and end (``availableNow``); started again, it takes up what came since."""

    def batch(files: DataFrame, number: int) -> None:
        progress = ingest_batch(files, chunks_path, parse, embedder, settings)
        progress.write.mode("overwrite").parquet(f"{progress_path}/batch={number}")

    stream = landing_stream(spark, folder, glob, settings.files_per_trigger)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressLog(StreamingQueryListener):
    """Keeps what a query reports of itself: the in-process side of progress events."""

    def __init__(self) -> None:
        self.events: list[dict] = []

    def onQueryStarted(self, event) -> None:
        self.events.append({"type": "start", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        self.events.append({"type": "progress", "id": str(event.progress.id), "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.events.append({"type": "error" if event.exception else "done", "id": str(event.id)})


def event_rows(events: DataFrame, uploads: DataFrame) -> DataFrame:
    """``events(file, ...)`` with the columns of ``uploads(file, ...)`` they belong to; events of unknown files are ignored.

    A null file belongs to nothing; repeated events stay, repeated uploads of one file give a row each.
    """
    return events.join(uploads, "file")


def upload_progress(events: DataFrame) -> DataFrame:
    """Per run of ``events(run, type)``: files started, done and failed, and the finished share."""
    started, done, failed = (F.count_if(F.col("type") == t) for t in ("start", "done", "error"))
    return events.groupBy("run").agg(started.alias("started"), done.alias("done"), failed.alias("failed"), F.round((done + failed) / F.greatest(started, F.lit(1)), 6).alias("share"))


def sse_frame(event: str) -> str:
    """One server-sent event of a JSON text."""
    return f"data: {event}\n\n"


def sse_events(received: list[str]) -> list[str]:
    """The events in received pieces: frames end at blank lines, may come in parts, and comments are left out."""
    out, rest = [], ""
    for piece in received:
        *frames, rest = (rest + piece).split("\n\n")
        out += [line[6:] for f in frames for line in f.split("\n") if line.startswith("data: ")]
    return out
