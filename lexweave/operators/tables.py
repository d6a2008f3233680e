"""Maintenance of the graph tables: idempotent replacement, upserts, lookups and checks. Tables are DataFrames or paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.durable import discard, materialize


#: Folders of a table on disk that is replaced by source: a source's rows lie in one of them.
BUCKETS = 64


def replace_by_source(old: DataFrame, new: DataFrame, key: str = "source_file", sources: DataFrame | None = None) -> DataFrame:
    """All rows of ``old`` but those of the processed ``sources(key)``, and all of ``new``: nothing old is left behind.

    ``sources`` are those of ``new`` if they aren't given; give them where a source may have no row any more. A row
    of ``old`` with a null key stays; repeated rows are carried along; empty tables leave the other one.
    """
    gone = (new if sources is None else sources).select(key).distinct()
    return old.join(gone, key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_replacing(new: DataFrame, path: str, key: str = "source_file", sources: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """The same on disk, in folders by a hash of the source: only those that hold a processed source are rewritten.

    Running it again changes nothing. A folder that is left without rows is deleted.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    gone = (new if sources is None else sources).select(key).distinct()
    touched = [r[0] for r in gone.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    disk = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = new.withColumn("bucket", bucket)
    if disk.exists(place(path)):
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        rows = old.join(gone, key, "left_anti").unionByName(rows, allowMissingColumns=True)
    rows = materialize(rows, "replacing")  # what is overwritten was read
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
    left = {r[0] for r in rows.select("bucket").distinct().collect()}
    for b in set(touched) - left:
        disk.delete(place(f"{path}/bucket={b}"), True)
    discard(rows)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys, nulls included, and are added otherwise."""
    fresh = new.select(*(F.col(k).alias(f"_new_{k}") for k in keys)).distinct()
    on = [old[k].eqNullSafe(fresh[f"_new_{k}"]) for k in keys]
    return old.join(fresh, on, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows without a counterpart in ``done``: what a resumed run still has to do.

    A null key equals a null key here, so a row with one is done once it was done. Repeated rows are carried along; an
    empty ``done`` leaves all rows, an empty ``rows`` none.
    """
    return rows.join(*_matched(rows, done, keys), "left_anti")


def present(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows with a counterpart in ``done``, nulls as above."""
    return rows.join(*_matched(rows, done, keys), "left_semi")


def _matched(rows: DataFrame, done: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, list]:
    other = done.select(*(F.col(k).alias(f"_done_{k}") for k in keys))
    return other, [rows[k].eqNullSafe(other[f"_done_{k}"]) for k in keys]


def limited(rows: DataFrame, done: DataFrame, n: int, *order: str, key: str = "chunk_id", count_done: bool = False) -> DataFrame:
    """The first ``n`` pending rows in order; with ``count_done`` rows that are done use up the limit as well.

    Null keys as in ``pending``; nulls come first in order; of rows that are equal in order any may be taken.
    """
    if count_done:
        return pending(rows.orderBy(*order).limit(n), done, key)
    return pending(rows, done, key).orderBy(*order).limit(n)


def random_pick(rows: DataFrame, key: str, seed: int = 0, n: int = 1) -> DataFrame:
    """``n`` rows picked at random: those with the smallest seeded hashes of their keys, so a run can be repeated."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def unprocessed(rows: DataFrame, flag: str = "dedup_processed") -> DataFrame:
    """Rows whose flag is null or false."""
    return rows.where(~F.col(flag).eqNullSafe(True))


def mark_processed(rows: DataFrame, finished: DataFrame, key: str = "chunk_id", flag: str = "dedup_processed") -> DataFrame:
    """``rows`` with the flag set where the key is in ``finished``; other flags stay as they are."""
    seen = finished.select(F.col(key).alias("_key")).distinct().withColumn("_done", F.lit(True))
    joined = rows.join(seen, rows[key] == seen["_key"], "left")
    return joined.withColumn(flag, F.when(F.col("_done"), F.lit(True)).otherwise(F.col(flag))).drop("_key", "_done")


def lookup(keys: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """Point reads as one left join: nulls where nothing is found."""
    return keys.join(table, list(on), "left")


def first_edge(edges: DataFrame, keys: DataFrame, on: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """For each key the first of its edges in the given order, or nulls."""
    ranked = edges.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where("_n = 1").drop("_n")
    return keys.join(ranked, list(on), "left")


def orphans(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose node doesn't exist; empty if the tables agree."""
    return edges.join(nodes.select(key), key, "left_anti")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side: no row if both have the same set."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def create(spark: SparkSession, name: str, ddl: str, partition: str | None = None) -> None:
    """Create a Parquet table if it isn't there; a partition column takes an index's place."""
    part = f" PARTITIONED BY ({partition})" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{part}")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_failures(failures: DataFrame, path: str) -> None:
    """The run's failures as JSON lines, in place of the last run's."""
    failures.write.mode("overwrite").json(path)


def erase_source(table: DataFrame, source: str, lineage: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """``table`` without rows of a source: by its own column, or by the keys that ``lineage(source_file, key)`` gives."""
    if lineage is None:
        return table.where(~F.col("source_file").eqNullSafe(source))
    return table.join(lineage.where(F.col("source_file") == source).select(key).distinct(), key, "left_anti")
