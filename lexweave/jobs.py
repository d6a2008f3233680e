"""Batch jobs over a folder of tables, each resumable: ``python -m lexweave.jobs ingest|extract|resolve ROOT ...``.

``ROOT/landing`` holds uploads, ``ROOT/chunks``, ``raw_extractions`` and ``processed`` are tables, ``ROOT/graph`` the
graph, ``ROOT/failures_*`` the last run's failures as JSON lines.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.config import Settings
from lexweave.durable import materialize
from lexweave.models import HashingEmbedder, HttpModel, RuleExtractor, RuleJudge
from lexweave.operators import candidates as C
from lexweave.operators import extraction, judgment, resolution, tables
from lexweave.sources.files import PDF_GLOB, pdf_pages, text_pages
from lexweave.streaming import ingest

_TABLES = {"raw_extractions": schemas.RAW_EXTRACTIONS, "processed": "chunk_id string", "chunks": schemas.CHUNKS}


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the folder, empty if it isn't there yet."""
    path = f"{root}/{table}"
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], _TABLES[table])


def run_extraction(spark: SparkSession, root: str, model, settings: Settings = Settings(), limit: int | None = None, count_done: bool = False) -> DataFrame:
    """Extract what has no extraction yet; returns the counters ``processed, skipped, failed``.

    A run that ends early loses nothing: the next one takes up what is left. ``limit`` bounds a run, over pending chunks
    or with ``count_done`` over all.
    """
    chunks, done = read(spark, root, "chunks"), read(spark, root, "raw_extractions")
    columns = ["chunk_id", "source_file", "chunk_index", "text"]
    rows = chunks.select(*columns)
    skipped = tables.present(rows, done, "chunk_id").count()
    if limit is None:
        todo = tables.pending(rows, done, "chunk_id")
    else:
        todo = tables.limited(rows, done, limit, "source_file", "chunk_index", count_done=count_done)
    # answers are written before use: the model is asked once per chunk
    answered = materialize(extraction.run_model(todo, model, settings.model_partitions).withColumnRenamed("error", "_call"), "answers")
    parsed = extraction.parse_entities(answered).withColumn("error", F.coalesce("_call", "error"))
    good, bad = parsed.where("error is null"), extraction.failures(parsed.where("error is not null"))
    extraction.finish(good, settings.extraction_model).write.mode("append").parquet(f"{root}/raw_extractions")
    tables.write_failures(bad, f"{root}/failures_extraction")
    status = parsed.select(F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("status"))
    return judgment.counters(status).withColumn("skipped", F.lit(skipped).cast("long"))


def run_resolution(spark: SparkSession, root: str, embedder, judge, settings: Settings = Settings(), size: int = 10_000) -> DataFrame:
    """Resolve the mentions of unprocessed chunks; returns ``chunk_id, complete`` of the chunks that it took up.

    A mention that has its edge already is not resolved again, so retrying a chunk of which one entity failed adds
    nothing twice. A chunk is processed once all its mentions have edges; one without entities is at once.
    """
    raw, done, chunks = (read(spark, root, t) for t in ("raw_extractions", "processed", "chunks"))
    todo = materialize(tables.pending(raw, done, "chunk_id"), "unprocessed")
    graph = resolution.Graph(spark, f"{root}/graph")
    found = resolution.mention_rows(extraction.mentions(todo, chunks, settings.snippet_words))
    edges = graph.read("mentioned_in").select("chunk_id", "entity_index")
    fresh = materialize(found.join(edges, ["chunk_id", "entity_index"], "left_anti"), "fresh")
    usable = C.embed(fresh.where("error is null").drop("error"), embedder, partitions=settings.model_partitions)
    last = graph.read("mentioned_in").agg(F.max("batch")).first()[0]
    errors = resolution.resolve_batches(usable, graph, judge, size, raw, settings, first=0 if last is None else last + 1)
    lost = fresh.where("error is not null").select("mention_id", "error")
    lost = lost if errors is None else lost.union(errors)
    named = fresh.select("mention_id", "chunk_id", "entity_index", F.col("name").alias("entity_name"))
    tables.write_failures(named.join(lost, "mention_id").drop("mention_id").withColumn("failed_at", F.current_timestamp()), f"{root}/failures_resolution")
    jobs = todo.select("chunk_id", F.posexplode_outer("entities").alias("entity_index", "_e")).drop("_e")
    results = graph.read("mentioned_in").select("chunk_id", "entity_index").distinct().withColumn("ok", F.lit(True))
    state = materialize(judgment.completion(jobs, results), "completion")
    state.where("complete").select("chunk_id").write.mode("append").parquet(f"{root}/processed")
    return state


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexweave", description=__doc__.splitlines()[0])
    p.add_argument("job", choices=("ingest", "extract", "resolve"))
    p.add_argument("root")
    p.add_argument("--limit", type=int, help="extract so many chunks at most")
    p.add_argument("--text", action="store_true", help="ingest .txt files, a form feed between pages, instead of PDF")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"lexweave-{args.job}").getOrCreate()
    s = Settings.load(spark)
    http = HttpModel(s.model_url, s.extraction_model, s.embedding_model) if s.model_url else None
    if args.job == "ingest":
        glob, parse = ("*.txt", text_pages) if args.text else (PDF_GLOB, pdf_pages)
        root = args.root
        embedder = http or HashingEmbedder(s.embedding_dim)
        ingest.start_ingest(spark, f"{root}/landing", f"{root}/chunks", f"{root}/progress", f"{root}/checkpoint", parse, glob, embedder, s).awaitTermination()
    elif args.job == "extract":
        run_extraction(spark, args.root, http or RuleExtractor(), s, args.limit).show()
    else:
        state = run_resolution(spark, args.root, http or HashingEmbedder(s.embedding_dim), http or RuleJudge(), s)
        state.groupBy("complete").count().show()


if __name__ == "__main__":
    main()
