"""Intermediate tables that survive lost executors, and broadcasts with a checked size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []

#: A task's file on a local disk would make Hadoop start four ``chmod`` processes, for the file and its checksum file,
#: each of which is a copy of the executor for a moment. Without checksum files it is one. Other stores aren't touched.
_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and driver and executors are one process is it a temporary folder of the machine; on a
    cluster an unset folder is an error, as executors elsewhere couldn't read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexweave-{label}-{uuid.uuid4().hex}"
    df.write.options(**_LOCAL).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A materialised table with more rows: its plan doesn't grow."""
    rows.select(*table.columns).write.options(**_LOCAL).mode("append").parquet(table._written_at)
    out = table.sparkSession.read.schema(table.schema).parquet(table._written_at)
    out._written_at = table._written_at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later action reads, so that they don't stay until the program ends."""
    for table in tables:
        spark, path = table.sparkSession, table._written_at
        _delete(spark, path)
        _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before the interpreter
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: Rows and bytes of an Arrow batch: what a Python worker holds at once, also of runs of very long texts or of blocks.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches where the session doesn't: the same for all operators, as plans read it when they run."""
    for key, value in ARROW.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


#: Rows that a task sorts, where the number of partitions is given explicitly.
TASK_ROWS = 250_000


def partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of at most about ``TASK_ROWS`` rows, so that a task's memory doesn't grow with the table.

    Adaptive execution joins partitions by their compressed bytes, of which repeated values take few.
    """
    return min(max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), 20_000)


#: Bytes that a table of as many rows as may be broadcast can take at most, by the widths of its columns.
BROADCAST_BYTES = 64 << 20
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "double": 8, "float": 4, "date": 4, "timestamp": 8}


def broadcast_if_small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """``df`` and whether it may be broadcast: at most ``rows`` rows, and ``BROADCAST_BYTES`` in all; then it is marked.

    Counting stops at the bound. Columns of a fixed width need no look at the values; others are measured.
    """
    counted = df.limit(rows + 1)
    loose = [c for c, kind in df.dtypes if kind not in _WIDTHS]
    fixed = 16 + sum(8 for c, kind in df.dtypes if kind in _WIDTHS)
    size = F.lit(0).cast("long") if not loose else sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in loose), F.lit(0).cast("long"))
    n, extra = counted.agg(F.count("*"), F.sum(size)).first()
    small = n <= rows and n * fixed + (extra or 0) <= BROADCAST_BYTES
    return (F.broadcast(df) if small else df), small


def _fingerprint(edges: DataFrame) -> tuple:
    """Of a set of edges: their number and the xor of their hashes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a stretch of edges at a time: each node with the smallest id that it is linked to there."""
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        up: dict = {}

        def find(x):
            root = x
            while up.setdefault(root, root) != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for x, y in zip(a, b):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        pairs = [(x, find(x)) for x in up]
        kept = [(x, r) for x, r in pairs if x != r]
        columns = list(zip(*kept)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(0).type) for c in columns], ["a", "b"])


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` with the same components and at most one edge per node in each batch of a partition."""
    return edges.mapInArrow(_forest, edges.schema)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)`` with the smallest id of each component as root.

    Every partition first joins its own edges by union-find, a bounded batch at a time, which leaves a spanning forest
    of each batch. The forests are joined by alternating large-star and small-star steps (Kiveris et al., 2014) until a
    round changes nothing. Each round joins and aggregates by key, is written to the shared folder, and hot nodes are
    combined map-side before the shuffle; no task and no driver holds a whole component. Null ends and loops are
    ignored; isolated nodes aren't listed.
    """
    given = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(_contracted(given).distinct(), label)
    was = _fingerprint(now)
    while was[0]:
        # large-star: every neighbour above the node goes to the smallest of the node and its neighbours
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: a node's smaller neighbours, and the node, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.union(least.select("a", "m")).where("a <> b").distinct(), label)
        found = _fingerprint(after)
        discard(now)
        now = after
        if found == was:
            break
        was = found
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
