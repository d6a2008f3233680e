"""Facts of fixed patterns, entities of a pluggable model, and what becomes of failures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.functions import text as T
from lexweave.models import Extractor

_ENTITIES = f"array<{schemas.ENTITY}>"


def patterns(chunks: DataFrame) -> DataFrame:
    """``chunks`` with their case numbers and dates; null texts have empty arrays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return chunks.withColumns({"docket_numbers": T.docket_numbers(text), "dates": T.dates(text)})


def parse_entities(rows: DataFrame, column: str = "content") -> DataFrame:
    """``rows`` with ``entities`` and ``error`` from a model's JSON: text that doesn't parse is an error, never an empty answer."""
    schema = f"struct<entities:{_ENTITIES},_bad:string>"
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("_parsed", parsed)
    bad = F.col("_parsed").isNull() | F.col("_parsed._bad").isNotNull() | F.col("_parsed.entities").isNull()
    return rows.withColumns(
        {"entities": F.when(~bad, F.col("_parsed.entities")), "error": F.when(bad, F.lit("the model's answer is no valid JSON"))}
    ).drop("_parsed")


def run_model(chunks: DataFrame, model: Extractor, partitions: int | None = None) -> DataFrame:
    """``chunks`` with the model's raw ``content`` and ``error``; ``partitions`` bounds how many calls run at once."""
    schema = chunks.drop("content", "error").select("*", *(F.lit(None).cast("string").alias(c) for c in ("content", "error"))).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [_ask(model, t) for t in batch["text"]]
            yield batch.assign(content=[a for a, _ in answers], error=[e for _, e in answers])

    rows = chunks.drop("content", "error")
    return (rows.coalesce(partitions) if partitions else rows).mapInPandas(run, schema)


def _ask(model: Extractor, text: str | None) -> tuple[str | None, str | None]:
    """Two budgets: the larger one is tried if the first answer doesn't parse, or holds no list of entities that could be
    filtered. A failed call is an error at once."""
    for budget in (1500, 3000):
        try:
            content = model.extract(text or "", budget)
        except Exception as e:  # the row's failure, kept with the row
            return None, f"{type(e).__name__}: {e}"
        if _usable(content):
            break
    return content, None


def _usable(content: str) -> bool:
    try:
        answer = json.loads(content)
    except ValueError:
        return False
    entities = answer.get("entities") if isinstance(answer, dict) else None
    return isinstance(entities, list) and all(isinstance(e, dict) for e in entities)


def extract(chunks: DataFrame, model: Extractor, partitions: int | None = None, model_name: str = "stub") -> tuple[DataFrame, DataFrame]:
    """(raw extractions, failures) of ``chunks(chunk_id, source_file, chunk_index, text)``.

    Materialise the answers (the caller's tables do) before using both: the model is called once per evaluation.
    """
    answered = run_model(chunks.select("chunk_id", "source_file", "chunk_index", "text"), model, partitions)
    answered = answered.withColumnRenamed("error", "_call")
    parsed = parse_entities(answered).withColumn("error", F.coalesce("_call", "error"))
    return finish(parsed.where("error is null"), model_name), failures(parsed.where("error is not null"))


def finish(parsed: DataFrame, model_name: str) -> DataFrame:
    """Rows of ``raw_extractions``: patterns, entities without noise, and the review flag."""
    rows = patterns(parsed).withColumn("entities", T.participants(F.col("entities")))
    return rows.select(
        "chunk_id", "source_file", "chunk_index", "docket_numbers", "dates", "entities", T.needs_review(F.col("entities")).alias("needs_review"),
        F.current_timestamp().alias("extracted_at"), F.lit(model_name).alias("model"), F.lit(None).cast("boolean").alias("dedup_processed"),
    )


def failures(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", "source_file", "chunk_index", "error", F.current_timestamp().alias("failed_at"))


def mentions(extractions: DataFrame, chunks: DataFrame, around: int = 15) -> DataFrame:
    """One row per entity of every extraction, with its place and snippet in the chunk.

    A chunk without text is a failure of each of its entities (``error``); a mention that isn't found has no snippet.
    """
    rows = extractions.select("chunk_id", "source_file", "chunk_index", "docket_numbers", "dates", F.posexplode("entities").alias("entity_index", "e"))
    rows = rows.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    place = T.locate(F.col("text"), F.col("e.textual_evidence"), F.col("e.name"))
    rows = rows.withColumn("_place", place)
    return rows.select(
        "chunk_id", "source_file", "chunk_index", "entity_index", F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.col("e.candidate_role").alias("role"),
        F.col("e.textual_evidence").alias("textual_evidence"), F.col("e.confidence").alias("confidence"), "docket_numbers", "dates",
        F.col("_place.matched").alias("mention_text"), T.snippet(F.col("text"), F.col("_place"), around).alias("snippet"), F.when(F.col("text").isNull(), F.lit("no text for this chunk")).alias("error"),
    )
