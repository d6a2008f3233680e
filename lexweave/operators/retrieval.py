"""Answers from the graph under access rights: filters before ranking, checked hops, output screening, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import candidates as C

#: What must not leave the system: long card-like numbers, social security numbers, keys after a cue.
SCREENED = (r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", r"(?i)(?:password|token|api_key)\s*[:=]\s*\S+")


def visible(rows: DataFrame, groups: list[str], column: str = "acl_groups") -> DataFrame:
    """Rows that one of the groups may see; a row without groups is seen by nobody."""
    allowed = F.array(*map(F.lit, groups)) if groups else F.array().cast("array<string>")
    return rows.where(F.coalesce(F.arrays_overlap(column, allowed), F.lit(False)))


def visible_by_table(rows: DataFrame, acl: DataFrame, groups: list[str], key: str = "acl_id") -> DataFrame:
    """The same from a table ``acl(acl_id, group)``."""
    return rows.join(acl.where(F.col("group").isin(groups)).select(key).distinct(), key, "left_semi")


def search(queries: DataFrame, chunks: DataFrame, groups: list[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` nearest chunks of every query, out of those that the groups may see: ``query_id, chunk_id, distance, rank``.

    ``queries(query_id, vector)``, ``chunks(chunk_id, vector[, acl_groups])``. Rights are applied before the ranking.
    """
    seen = chunks if groups is None else visible(chunks, groups)
    q = queries.select("query_id", F.lit("chunk").alias("type"), "vector")
    v = seen.select(F.col("chunk_id").alias("vector_id"), F.lit("chunk").alias("type"), "vector")
    return C.nearest(q, v, k).withColumnRenamed("vector_id", "chunk_id")


def answer_facts(hits: DataFrame, mentioned_in: DataFrame, entities: DataFrame) -> DataFrame:
    """The hits with the entities mentioned in their chunks, as material for an answer with citations."""
    names = mentioned_in.select("chunk_id", "entity_id").distinct().join(entities.select("entity_id", "name", "type"), "entity_id")
    by_chunk = names.groupBy("chunk_id").agg(F.sort_array(F.collect_set(F.struct("type", "name"))).alias("entities"))
    return hits.join(by_chunk, "chunk_id", "left")


def hops(start: DataFrame, edges: DataFrame, groups: list[str], n: int = 2) -> DataFrame:
    """Nodes within ``n`` hops of ``start(node)`` over ``edges(src, dst, acl_groups)`` that the groups may see: ``node, hop``.

    Every hop is filtered, so what isn't visible can't be reached through either.
    """
    usable = visible(edges, groups).select("src", "dst")
    both = usable.union(usable.select("dst", "src")).toDF("src", "dst").distinct()
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, n + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.union(frontier)
    return seen


def screened(rows: DataFrame, column: str = "text") -> DataFrame:
    """``rows`` with ``leak``: whether the text holds what must not go out."""
    hit = F.lit(False)
    for pattern in SCREENED:
        hit = hit | F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return rows.withColumn("leak", hit)


def audit(hits: DataFrame, user: str) -> DataFrame:
    """One audit row per query: who, when, which chunks."""
    chunks = F.sort_array(F.collect_list(F.struct("rank", "chunk_id")))
    return hits.groupBy("query_id").agg(chunks.alias("c")).select("query_id", F.lit(user).alias("user"), F.col("c.chunk_id").alias("chunk_ids"), F.current_timestamp().alias("at"))


def canary_leaks(rows: DataFrame, canaries: list[str], column: str = "text") -> DataFrame:
    """Rows that hold a planted canary string: any is a failure."""
    hit = F.lit(False)
    for c in canaries:
        hit = hit | F.coalesce(F.contains(F.col(column), F.lit(c)), F.lit(False))
    return rows.where(hit)
