"""What a judge is told, what it answers, and what follows from the answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import similarity as S
from lexweave.functions import text as T
from lexweave.models import Judge


def enrich(candidates: DataFrame, entities: DataFrame, edges: DataFrame, extractions: DataFrame) -> DataFrame:
    """Candidate rows with a name where they had none, and role, evidence, case numbers and dates of the matched mention.

    ``edges`` must hold one edge per (entity, chunk): see ``tables.first_edge``. Candidates without ``chunk_id`` match
    nothing there, as a null equals nothing.
    """
    names = entities.select("entity_id", F.col("name").alias("_known"))
    roles = edges.select("entity_id", "chunk_id", "role", "textual_evidence")
    facts = extractions.select("chunk_id", "docket_numbers", "dates")
    rows = candidates.join(names, "entity_id", "left").join(roles, ["entity_id", "chunk_id"], "left").join(facts, "chunk_id", "left")
    return rows.withColumn("name", F.coalesce("name", "_known")).drop("_known")


def facts_text(position: Column, name: Column, snippet: Column, role: Column, evidence: Column, dockets: Column, dates: Column) -> Column:
    """A numbered block of what is known of a candidate; lines without a fact are left out. ``position`` counts from 1."""
    line = lambda label, value, shown: F.when(value.isNotNull(), F.concat(F.lit(f"   {label}: "), shown))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    return F.concat_ws(
        "\n",
        F.concat(position.cast("string"), F.lit(". name: "), F.coalesce(name, F.lit("(unknown)"))),
        line("matched context", F.nullif(snippet, F.lit("")), quoted(snippet)),
        line("role in that mention", role, role),
        line("textual evidence", role, quoted(evidence)),
        line("docket numbers in that chunk", dockets, F.to_json(dockets)),
        line("dates in that chunk", dates, F.to_json(dates)),
    )


def prompt(name: Column, kind: Column, evidence: Column, dockets: Column, dates: Column, blocks: Column) -> Column:
    """The question to a judge: the mention's facts and the candidates' blocks in order."""
    show = lambda label, value: F.concat(F.lit(f"  {label}: "), value)
    head = F.concat_ws(
        "\n", F.lit("New mention:"), show("name", F.coalesce(name, F.lit(""))), show("type", F.coalesce(kind, F.lit(""))),
        show("textual evidence", F.concat(F.lit('"'), F.coalesce(evidence, F.lit("")), F.lit('"'))), show("docket numbers in this chunk", F.to_json(dockets)), show("dates in this chunk", F.to_json(dates)),
    )
    return F.concat(head, F.lit("\n\nCandidates:\n"), F.array_join(blocks, "\n"))


def ask(rows: DataFrame, judge: Judge, partitions: int | None = None) -> DataFrame:
    """``rows(..., candidates)`` with ``judgments: array<struct<verdict, reason>>`` and ``error``. A failed call is an error row."""
    rows = rows.drop("judgments", "error")
    schema = rows.select("*", F.lit(None).cast("array<struct<verdict:string,reason:string>>").alias("judgments"), F.lit(None).cast("string").alias("error")).schema

    def plain(x):
        return x.asDict() if hasattr(x, "asDict") else dict(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for row in batch.to_dict("records"):
                try:
                    found = judge.judge(row, [plain(c) for c in row["candidates"]])
                    answers.append([{"verdict": v, "reason": r} for v, r in found])
                    errors.append(None)
                except Exception as e:  # the row's failure, kept with the row
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(judgments=answers, error=errors)

    return (rows.coalesce(partitions) if partitions else rows).mapInPandas(run, schema)


def zip_judgments(candidates: Column, judgments: Column) -> Column:
    """Candidates and judgments by position; null if their numbers differ, which is an error and never a guess."""
    return F.when(F.size(candidates) == F.size(judgments), F.zip_with(candidates, judgments, lambda c, j: F.struct(c.alias("candidate"), j.alias("judgment"))))


def count_mismatch(candidates: Column, judgments: Column) -> Column:
    """An error message where the numbers differ, else null."""
    differ = F.size(candidates) != F.size(judgments)
    return F.when(differ, F.concat(F.size(judgments).cast("string"), F.lit(" judgments for "), F.size(candidates).cast("string"), F.lit(" candidates")))


def doubtful(mention: Column, candidate: Column, source: Column, verdict: Column) -> Column:
    """Whether ``same`` rests on context alone though both names are specific: then the likeness of the names decides."""
    return (verdict == "same") & ~F.coalesce(source == "jaro_winkler", F.lit(False)) & ~T.looks_generic(mention) & ~T.looks_generic(candidate)


def guarded(mention: Column, candidate: Column, source: Column, verdict: Column, score: Column, threshold: float = 0.6) -> Column:
    """``same`` becomes ``unsure`` if it rests on context alone and both names are specific and unlike each other."""
    return F.when(doubtful(mention, candidate, source, verdict) & (score < threshold), F.lit("unsure")).otherwise(verdict)


def guard_reason(mention: Column, candidate: Column, verdict: Column, after: Column, reason: Column) -> Column:
    changed = F.concat(F.lit('only context supports "'), mention, F.lit('" being "'), candidate, F.lit('", the names are unlike'))
    return F.when((verdict == "same") & (after == "unsure"), changed).otherwise(reason)


def guard_rows(rows: DataFrame, threshold: float = 0.6, variant: S.Variant = S.PUBLISHED) -> DataFrame:
    """``rows(mention_name, name, source, verdict, reason)`` with verdict and reason after the guard."""
    # only the names that decide go to Python
    at_stake = doubtful(F.col("mention_name"), F.col("name"), F.col("source"), F.col("verdict"))
    scored = rows.withColumn("_asked", F.when(at_stake, F.col("mention_name")))
    scored = scored.withColumn("_score", S.jaro_winkler(variant)(F.col("_asked"), F.when(F.col("_asked").isNotNull(), F.col("name"))))
    after = F.when(F.col("_score") < threshold, F.lit("unsure")).otherwise(F.col("verdict"))
    scored = scored.withColumn("_after", after)
    reason = guard_reason(F.col("mention_name"), F.col("name"), F.col("verdict"), F.col("_after"), F.col("reason"))
    return scored.withColumn("reason", reason).withColumn("verdict", F.col("_after")).drop("_after", "_score", "_asked")


def outcome(judged: DataFrame) -> DataFrame:
    """``judged(mention_id, pos, entity_id, verdict, reason)`` to ``mention_id, merged_into, flags``.

    The first ``same`` wins; only without one are the ``unsure`` candidates flagged.
    """
    item = F.struct("pos", "entity_id", "verdict", "reason")
    rows = judged.groupBy("mention_id").agg(F.sort_array(F.collect_list(item)).alias("j"))
    same = F.try_element_at(F.filter("j", lambda x: x["verdict"] == "same"), F.lit(1))["entity_id"]
    unsure = F.transform(F.filter("j", lambda x: x["verdict"] == "unsure"), lambda x: F.struct(x["entity_id"].alias("entity_id"), x["reason"].alias("reason")))
    return rows.select("mention_id", same.alias("merged_into"), F.when(same.isNull(), unsure).otherwise(F.slice(unsure, 1, 0)).alias("flags"))


def flag_edges(outcomes: DataFrame) -> DataFrame:
    """``outcomes(entity_id, flags)`` to rows of ``possible_duplicates``."""
    rows = outcomes.select(F.col("entity_id").alias("src_entity_id"), F.explode("flags").alias("f"))
    return rows.select("src_entity_id", F.col("f.entity_id").alias("dst_entity_id"), F.col("f.reason").alias("reason"), F.current_timestamp().alias("flagged_at"), F.lit("pending_review").alias("status"))


def completion(jobs: DataFrame, results: DataFrame, key: str = "chunk_id", item: str = "entity_index") -> DataFrame:
    """Per chunk of ``jobs(key, item)`` whether all its items succeeded in ``results(key, item, ok)``.

    A null item stands for a chunk without any: it is complete. An item without a result is not done.
    """
    joined = jobs.join(results, [key, item], "left")
    done = F.when(F.col(item).isNull(), True).otherwise(F.coalesce("ok", F.lit(False)))
    return joined.groupBy(key).agg(F.bool_and(done).alias("complete"))


def counters(results: DataFrame) -> DataFrame:
    """Processed, skipped and failed rows of ``results(status)``."""
    return results.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("processed", "skipped", "failed")))
