"""Removal of boilerplate lines that spread over many sites.

A line's spread is the number of distinct sites (``source``) that hold it. HyperLogLog sketches per line hash are built
map-side and merged by aggregation, so a line that a third of all rows hold costs one sketch per task. Lines whose
estimate lies near the threshold are counted exactly. Lines that reach the threshold are boilerplate: their first
occurrence stays, so that the corpus loses no text, and all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import broadcast_if_small, free_name, materialize

MIN_SITES = 10
#: log2 of the sketch's registers; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Estimates within so many standard errors of the threshold (and one site at least) are counted exactly.
SIGMAS = 6
#: A boilerplate line's rows are spread over so many salted groups where the join shuffles.
SALTS = 16
#: White space that doesn't count at either end of a line.
BLANKS = " \t\r\x0b\f"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of the trimmed line; null for a blank one."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.when(line != "", F.unhex(F.md5(line)))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, h, source, pos, key) of every line that isn't blank; ``h`` tells rows of one id with other texts apart."""
    parts = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("h"), F.col("source").cast("string").alias("source"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")
    )
    return parts.select("doc_id", "h", "source", "pos", _key(F.col("line")).alias("key")).where("key is not null")


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(key, first) of the lines on at least ``min_sites`` distinct sites; ``first`` is their first (doc_id, h, pos).

    A null source counts as one site of its own.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    spread = materialize(  # only what may reach the threshold is written
        found.groupBy("key")
        .agg(F.hll_sketch_agg(site, F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc_id", "h", "pos")).alias("first"))
        .select("key", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites - _margin(min_sites)),
        "line-spread",
    )
    near = F.abs(F.col("sites") - min_sites) <= _margin(min_sites)
    if spread.where(near).isEmpty():
        return spread.select("key", "first")
    unsure, _ = broadcast_if_small(spread.where(near).select("key", "first"))
    exact = (
        found.join(unsure.select("key"), "key", "left_semi")
        .select("key", site.alias("site"))
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
        .select("key")
    )
    return spread.where(~near).select("key", "first").union(spread.where(near).join(exact, "key").select("key", "first"))


def _margin(min_sites: int) -> int:
    return max(1, int(SIGMAS * 1.04 / (1 << LG_K) ** 0.5 * min_sites + 1))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with the repeats of boilerplate lines cut from ``text``, and ``n_removed``.

    Lines are told apart without the white space at their ends; blank lines stay. All rows stay, also those left with
    an empty text, and all other columns are carried along. Rows without id or text come back unchanged. Repeated rows
    are treated alike. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c != "n_removed"]
    # lines are cut from the texts in each pass: a table of all lines would be as large as the corpus
    found = occurrences(docs)
    common = boilerplate(found, min_sites)
    keys, small = broadcast_if_small(materialize(common, "boilerplate"))
    if small:
        hits = found.join(keys, "key")
    else:  # too many to broadcast: hot lines are spread over salted groups on both sides
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    h, key, gone = (free_name(docs, c) for c in ("_h", "_id", "_gone"))
    cut = (
        hits.where(F.struct("doc_id", "h", "pos") != F.col("first"))
        .groupBy(F.col("doc_id").alias(key), F.col("h").alias(h))
        .agg(F.collect_set("pos").alias(gone))
    )
    rows = docs.select(*columns).withColumn(h, F.xxhash64("text")).withColumn(key, F.col("doc_id"))
    joined = rows.join(cut, [key, h], "left")
    kept = F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*columns, F.coalesce(F.size(gone), F.lit(0)).alias("n_removed"))


ORACLE_SQL = rf"""
WITH parts AS (
  SELECT doc_id, source, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
), keyed AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM parts
), common AS (
  SELECT key, min({{'d': doc_id, 'p': pos}}) AS first FROM keyed WHERE key <> ''
  GROUP BY key HAVING count(DISTINCT coalesce('s' || source, '-')) >= {MIN_SITES}
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND {{'d': k.doc_id, 'p': k.pos}} <> c.first AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed
FROM marked GROUP BY doc_id
"""
