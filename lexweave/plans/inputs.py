"""Inputs of the registered queries, made from the driver's tables, each as a DataFrame and as SQL for DuckDB.

The tables hold no court filings: case numbers, dates, roles and citations are made up from order and part columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import chunking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".pdf")).alias("source_file"), "doc_id", "text", "lang")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_texts(sources(spark, sf_dir))


_SPLIT = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
SOURCES = "sources AS (SELECT 'doc' || doc_id || '.pdf' AS source_file, doc_id, text, lang FROM documents)"
CHUNKS = f"""{SOURCES},
worded AS (SELECT *, {_SPLIT.format("text")} AS w FROM sources),
counted AS (SELECT *, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 350 THEN 1 ELSE CAST(ceil((len(w) - 350) / 300.0) AS INTEGER) + 1 END AS k FROM worded),
numbered AS (SELECT *, unnest(range(k)) AS i FROM counted WHERE k > 0),
chunks AS (
  SELECT regexp_replace(source_file, '^(.+)\\.[^.]*$', '\\1') || '_' || i AS chunk_id, source_file, CAST(i AS INTEGER) AS chunk_index,
    array_to_string(w[i * 300 + 1 : i * 300 + 350], ' ') AS text, CAST(len(w[i * 300 + 1 : i * 300 + 350]) AS INTEGER) AS word_count
  FROM numbered
)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text with a case number and two dates per order."""
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit("Case No. 1:"), (key % 90 + 10).cast("string"), F.lit("-CV-"), F.lpad(key.cast("string"), 6, "0"), F.lit("-ABC filed "),
        F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" and "), F.date_format("o_orderdate", "MM/dd/yy"), F.lit(" and "), F.date_format("o_orderdate", "MM/dd/yy"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", text.alias("text"))


FILINGS = """filings AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  'Case No. 1:' || CAST(o_orderkey % 90 + 10 AS VARCHAR) || '-CV-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '-ABC filed ' || strftime(o_orderdate, '%B %-d, %Y')
  || ' and ' || strftime(o_orderdate, '%m/%d/%y') || ' and ' || strftime(o_orderdate, '%m/%d/%y') AS text FROM orders)"""

_CITED = (" v. Acme", " Dep. Tr.", " exhibit 4", " DE 338", ", 2013 WL 139", " F.3d", "", "", "")
_KINDS = ("person", "organization", "court", "reference")


def _case(key, values, default):
    out = F.lit(default)
    for n, v in reversed(list(enumerate(values))):
        out = F.when(key == n, F.lit(v)).otherwise(out)
    return out


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity per part: names with citations or role words in them, of four types."""
    key = F.col("p_partkey")
    cited = F.concat("p_name", _case(key % 9, _CITED, ""))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name"), cited.alias("cited"), _case(key % 4, _KINDS, "person").alias("type"),
        F.when(key % 11 == 0, "see Decl. at 3").otherwise(F.concat(F.lit("as "), "p_name")).alias("evidence"),
        F.when(key % 3 == 0, "resolved_from_context").otherwise("explicit").alias("confidence"),
        F.concat("p_name", F.when(key % 5 == 0, " counsel").when(key % 7 == 0, " of the Court").otherwise("")).alias("roled"),
        F.concat("p_name", F.lit(" of the "), "p_type").alias("long_name"),
    )


PARTS = f"""parts AS (SELECT p_partkey, p_name,
  p_name || CASE p_partkey % 9 {" ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(_CITED))} END AS cited,
  CASE p_partkey % 4 {" ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(_KINDS))} END AS type,
  CASE WHEN p_partkey % 11 = 0 THEN 'see Decl. at 3' ELSE 'as ' || p_name END AS evidence,
  CASE WHEN p_partkey % 3 = 0 THEN 'resolved_from_context' ELSE 'explicit' END AS confidence,
  p_name || CASE WHEN p_partkey % 5 = 0 THEN ' counsel' WHEN p_partkey % 7 = 0 THEN ' of the Court' ELSE '' END AS roled,
  p_name || ' of the ' || p_type AS long_name FROM part)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by name and brand; the order of founding is that of the smallest part."""
    rows = table(spark, sf_dir, "part").where("p_partkey is not null")
    rows = rows.groupBy(F.col("p_name").alias("name"), F.substring("p_brand", 1, 7).alias("type")).agg(F.min("p_partkey").alias("k"))
    return rows.select(F.concat(F.lit("e"), "k").alias("entity_id"), "name", "type", F.lpad(F.col("k").cast("string"), 12, "0").alias("founded"))


ENTITIES = """entities AS (SELECT 'e' || k AS entity_id, name, type, lpad(CAST(k AS VARCHAR), 12, '0') AS founded
  FROM (SELECT p_name AS name, substr(p_brand, 1, 7) AS type, min(p_partkey) AS k FROM part GROUP BY ALL))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("label").cast("string").alias("type"), F.col("embedding").alias("vector"))


VECTORS = "vectors AS (SELECT vec_id AS vector_id, CAST(label AS VARCHAR) AS type, embedding::DOUBLE[] AS vector FROM embeddings)"


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with something to find: a slice of the text as evidence, an absent or an empty one, and a slice as name."""
    key = F.col("doc_id")
    piece = F.substring("text", (key % 40 + 1).cast("int"), F.lit(12))
    evidence = F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, F.lit("absent words")).otherwise(piece)
    name = F.when(key % 8 == 1, F.lit("absent too")).otherwise(F.substring("text", (key % 25 + 3).cast("int"), F.lit(9)))
    return sources(spark, sf_dir).select("doc_id", "text", evidence.alias("evidence"), name.alias("name"))


LOCATED = f"""{SOURCES}, located AS (SELECT doc_id, text,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'absent words' ELSE substr(text, CAST(doc_id % 40 + 1 AS INTEGER), 12) END AS evidence,
  CASE WHEN doc_id % 8 = 1 THEN 'absent too' ELSE substr(text, CAST(doc_id % 25 + 3 AS INTEGER), 9) END AS name FROM sources),
placed AS (SELECT *, CASE WHEN evidence <> '' AND instr(text, evidence) > 0 THEN evidence WHEN name <> '' AND instr(text, name) > 0 THEN name END AS matched FROM located)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention per order and a judged candidate per line item: no model."""
    li = table(spark, sf_dir, "lineitem")
    pick = F.col("l_partkey") % 10
    verdict = F.when(pick < 2, "same").when(pick < 5, "unsure").otherwise("different")
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*cols))
    rows = li.select("l_orderkey", *cols, pos.alias("pos"))
    return rows.select(F.col("l_orderkey").alias("mention_id"), "pos", F.concat(F.lit("e"), "l_partkey").alias("entity_id"), verdict.alias("verdict"), F.concat(F.lit("r"), "l_suppkey").alias("reason"), "l_partkey", "l_suppkey", "l_linenumber")


VERDICTS = """verdicts AS (SELECT l_orderkey AS mention_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
  'e' || l_partkey AS entity_id, CASE WHEN l_partkey % 10 < 2 THEN 'same' WHEN l_partkey % 10 < 5 THEN 'unsure' ELSE 'different' END AS verdict,
  'r' || l_suppkey AS reason, l_partkey, l_suppkey, l_linenumber FROM lineitem)"""
